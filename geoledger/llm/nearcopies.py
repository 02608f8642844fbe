"""Near copies for the pipeline: SimHash classes, widened by texts whose sets of 5-word shingles are alike.

Few texts with a similarity of 0.8 have fingerprints within two bits, so candidates come from MinHash instead: two texts
that agree in all minima of a band meet in one bucket. With 24 bands of 5 a pair at a Jaccard similarity of exactly 0.8
is missed with a probability of 0.00007, and more similar ones less often. Every candidate is verified on whole texts.

Texts that differ in case and white space only are one node. Buckets of large groups aren't multiplied out. Each bucket has
a centre, the node that meets most others, and first every node is compared with the centres it has. Then come the pairs
of a centre's nodes that aren't in one class by then. Of few nodes all pairs are compared. Of many, only those that can
be alike: with X and Y the shingles that x and y don't share with the centre (of either side), x and y differ in
|X| + |Y| - 2 |X & Y| shingles and are alike just if that is at most (|x| + |y|) / 9. So X and Y share at least
(|X| + |Y| - (|x| + |y|) / 9) / 2, which is above 0 if x or y isn't alike with the centre, and in any common order they meet
among the first |X| less so many, and one, of each. Shingles that few have come first in that order: x's own, then those
it lacks, and last what many of the centre's nodes have in common. No pair is lost: what doesn't meet so isn't alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.llm.common import checkpointed, text_slices, written
from geoledger.llm.components import components
from geoledger.llm.simhash import SEED, fingerprint, links

SHINGLE_WORDS = 5
#: Two sets are alike from ALIKE[0] / ALIKE[1] on.
ALIKE = (4, 5)
BANDS, BAND_ROWS = 24, 5
#: Nodes of a centre up to which all their pairs are compared; more meet by what sets them apart from it.
CROWD = 16
#: A difference is common if more than one in so many of a centre's nodes has it.
COMMON = 16
_BLOCK = 4_096
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 2**63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 2**63, BANDS * BAND_ROWS, np.uint64)


def _words(text: str) -> list[bytes]:
    """As the fingerprint sees them."""
    return text.encode("utf-8", "replace").lower().split()


def shingles(words: list[bytes], width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of the different runs of ``width`` words; fewer words are one run, none have none."""
    if not words:
        return np.zeros(0, np.uint64)
    runs = {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}
    found = np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), np.uint64, len(runs))
    return np.unique(found)


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed key for each band; no key for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        least = np.minimum(least, (hashes[at : at + _BLOCK, None] * _FACTORS + _SHIFTS).min(axis=0))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], np.uint64).view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return ALIKE[1] * both >= ALIKE[0] * (len(a) + len(b) - both)


def _marked(narrow: DataFrame) -> DataFrame:
    """(uid, doc_id, digest of the words, fp, bands) of each row; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            words = [_words(t) for t in texts]
            digests = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
            bits = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            bands = [band_keys(shingles(w)) for w in words]
            columns = [*batch.columns[:2], pa.array(digests, pa.binary()), pa.array(bits), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "digest", "fp", "bands"])

    return narrow.mapInArrow(run, "uid long, doc_id long, digest binary, fp long, bands array<long>")


def apart(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """What either of two sets has alone, as signed longs, x's own first; in one order for all sets x that are compared with a centre."""
    return np.concatenate((np.setdiff1d(x, centre, assume_unique=True), np.setdiff1d(centre, x, assume_unique=True))).view(np.int64)


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, crowded) of uids with whether their texts are alike, and if crowded what a differs in from b. texts: uid, text."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    some = texts.join(ids, "uid", "left_semi")
    left, right = some.select(F.col("uid").alias("a"), F.col("text").alias("text_a")), some.select(F.col("uid").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, None
        for batch, texts in text_slices(batches):
            out = []
            for a, b, b_text, crowded in zip(batch.column(3), batch.column(1).to_pylist(), texts, batch.column(2).to_pylist()):
                if b != last:  # pairs of one b mostly follow each other
                    last, centre = b, shingles(_words(b_text))
                x = shingles(_words(a.as_py() or ""))
                out.append((alike(x, centre), len(x), apart(x, centre).tolist() if crowded else []))
            columns = [*batch.columns[:3], *map(pa.array, map(list, zip(*out)), [pa.bool_(), pa.int64(), pa.list_(pa.int64())])]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "crowded", "same", "size", "differences"])

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "crowded", "text_a", "text")
    return both.mapInArrow(run, "a long, b long, crowded boolean, same boolean, size long, differences array<long>")


def _with_centres(nodes: DataFrame) -> DataFrame:
    """(a, b, crowded): each node a with the centres b of its buckets but itself. A bucket's centre is the node that meets most, of several the least."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = checkpointed(keys.join(buckets, "key"))
    meets = met.groupBy("node").agg(F.sum("n").alias("meets"))
    centres = met.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", (-F.col("node")).alias("less"))).alias("top")).select("key", (-F.col("top.less")).alias("b"))
    pairs = checkpointed(met.join(centres, "key").where("node != b").select(F.col("node").alias("a"), "b").distinct())
    return pairs.join(pairs.groupBy("b").agg((F.count("*") > CROWD).alias("crowded")), "b").select("a", "b", "crowded")


def _leading(crowd: DataFrame) -> DataFrame:
    """(b, a, root, same, size, differs, at, shingle): a row for each of the differences in which alike pairs meet first."""
    own = crowd.groupBy("b").agg(F.count("*").alias("n"))
    often = crowd.select("b", F.explode("differences").alias("shingle")).groupBy("b", "shingle").agg(F.count("*").alias("times"))
    often = often.join(own, "b").where(f"times > greatest(2, n div {COMMON})")
    often = often.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("times", "shingle")))["shingle"].alias("common"))
    order = "concat(array_except(differences, common), array_intersect(common, differences))"
    order = crowd.join(often, "b", "left").withColumn("ordered", F.expr(f"if(common is null, differences, {order})")).withColumn("differs", F.expr("cast(size(differences) as long)"))
    # bounds on where a pair meets that hold whatever the other one is
    leading = order.withColumn("leading", F.expr("slice(ordered, 1, cast(1 + if(same, 5 * differs div 9, size div 4) as int))"))
    return leading.select("b", "a", "root", "same", "size", "differs", F.posexplode("leading").alias("at", "shingle"))


def _open_pairs(compared: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b, crowded): pairs of a centre's nodes that are in different classes and may be alike; all that are alike are there."""
    known = roots.select(F.col("node").alias("a"), "root")
    rooted = compared.join(known, "a", "left").withColumn("root", F.coalesce("root", "a"))
    mixed = rooted.groupBy("b").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("b")
    rooted = checkpointed(rooted.join(mixed, "b", "left_semi"))
    few, other = rooted.where("not crowded").select("b", "a", "root"), "x.a > y.a and x.root != y.root"
    direct = few.alias("x").join(few.alias("y"), F.expr(f"x.b = y.b and {other}"))
    many = _leading(rooted.where("crowded"))
    least = "(9 * (x.differs + y.differs) - x.size - y.size)"  # 18 times what both share
    met = f"18 * (x.differs - x.at) >= {least} and 18 * (y.differs - y.at) >= {least}"
    by_shingle = many.alias("x").join(many.alias("y"), F.expr(f"x.b = y.b and x.shingle = y.shingle and {other} and {met}"))
    ends = ["x.a as a", "y.a as b"]
    pairs = direct.selectExpr(*ends).unionByName(by_shingle.selectExpr(*ends)).distinct()
    done = compared.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return pairs.join(done, ["a", "b"], "left_anti").withColumn("crowded", F.lit(False))


def _simhash_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links of nodes that connect what op2's rule connects."""
    lead = nodes.groupBy("fp").agg(F.min("node").alias("lead"))
    same = nodes.join(lead, "fp").where("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    one, other = lead.select(F.col("fp").alias("a"), F.col("lead").alias("x")), lead.select(F.col("fp").alias("b"), F.col("lead").alias("y"))
    across = links(lead.select("fp")).join(one, "a").join(other, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.unionByName(across)


def _roots(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of each node that a link reaches. nodes: node, fp, bands."""
    compared = checkpointed(_compared(checkpointed(_with_centres(nodes)), texts))
    found = checkpointed(_simhash_links(nodes).unionByName(compared.where("same").select("a", "b")))
    roots = components(found, "a", "b")
    more = checkpointed(_compared(checkpointed(_open_pairs(compared, roots)), texts).where("same").select("a", "b"))
    return components(found.unionByName(more), "a", "b") if more.take(1) else roots


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, of which one stays from each class of near copies.

    Linked are rows that simhash.near_duplicates links, and texts whose sets of 5-word shingles have a Jaccard similarity
    of 0.8 or more. The row with the least doc_id stays; one without an id only if its class has none with one. Of repeated
    rows one stays. docs must have doc_id and text.
    """
    uid = next(n for n in (f"_row{k}" for k in range(10**6)) if n not in docs.columns)
    stored = written(docs.withColumn(uid, F.monotonically_increasing_id()), "rows")
    narrow = stored.select(F.col(uid).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "uid", "fp", "bands")
    firsts = _marked(narrow).groupBy("digest").agg(F.min(row).alias("first")).select("first.*")
    nodes = checkpointed(firsts.withColumnRenamed("uid", "node"))
    roots = _roots(nodes.select("node", "fp", "bands"), narrow.select("uid", "text"))
    named = nodes.select("node", F.struct("nameless", "doc_id", F.col("node").alias("uid")).alias("first")).join(roots, "node", "left")
    stay = named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("least")).select(F.col("least.uid").alias(uid))
    return stored.join(stay, uid, "left_semi").drop(uid)
