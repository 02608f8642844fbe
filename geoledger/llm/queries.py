"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from collections.abc import Callable

from geoledger.llm.ann import op4
from geoledger.llm.bpe import op8
from geoledger.llm.chat import OP7_SQL, op7
from geoledger.llm.common import small_batches
from geoledger.llm.idfile import op10
from geoledger.llm.langid import op3
from geoledger.llm.packing import op1
from geoledger.llm.quality import op6
from geoledger.llm.rules import op9
from geoledger.llm.simhash import op2
from geoledger.llm.toxicity import op5



def _registered(operator: Callable) -> Callable:
    """The operator as a query: texts go to Python in small batches, for which the session's setting is lowered."""

    def run(spark, sf_dir):
        small_batches(spark)
        return operator(spark, sf_dir)

    run.__doc__ = operator.__doc__
    return run


QUERIES = {
    "op1_packing": op1,
    "op2_simhash": op2,
    "op3_language_id": op3,
    "op4_nearest_neighbours": op4,
    "op5_toxicity": op5,
    "op6_quality": op6,
    "op7_chat_formatting": op7,
    "op8_byte_bpe": op8,
    "op9_quality_rules": op9,
    "op10_token_files": op10,
}
QUERIES = {name: _registered(operator) for name, operator in QUERIES.items()}

#: The others hash with XXH64, tokenize, learn or search, which SQL can't express; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op7_chat_formatting": OP7_SQL,
}
