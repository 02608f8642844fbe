"""Codelists as a DataFrame (codelist, id, label, codevalue): local ones built in, remote ones by an injected loader."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger.names import unused

SCHEMA = "codelist string, id string, label string, codevalue string"
TIERS = ["bronze", "silver", "gold"]
# Ids, labels and code values of the local codelists, and the addresses of the remote ones.
LOCAL = [
    ("tilgangsnivaa", "http://publications.europa.eu/resource/authority/access-right/PUBLIC", "Allmen tilgang", "public"),
    ("tilgangsnivaa", "http://publications.europa.eu/resource/authority/access-right/RESTRICTED", "betinget tilgang", "restricted"),
    ("tilgangsnivaa", "http://publications.europa.eu/resource/authority/access-right/NON_PUBLIC", "ikke-allmenn tilgang", "non_public"),
    ("sikkerhetsnivaa", "https://register.geonorge.no/metadata-kodelister/sikkerhetsnivaa/unclassified", "Ugradert", "unclassified"),
    ("sikkerhetsnivaa", "https://register.geonorge.no/metadata-kodelister/sikkerhetsnivaa/unclassified_sensitive", "Ungradert skjermingsverdig", "unclassified_sensitive"),
    ("geometri_encoding", "dataplattform/geometri_encoding/wkt", "Well-Known-Text", "WKT"),
    ("geometri_encoding", "dataplattform/geometri_encoding/wkb", "Well-Known-Binary", "WKB"),
    ("geometri_encoding", "dataplattform/geometri_encoding/geojson", "GeoJson", "geojson"),
    ("geometri_encoding", "dataplattform/geometri_encoding/s2", "S2-cell", "s2"),
]
REMOTE = {
    "hovedkategori": "https://register.geonorge.no/metadata-kodelister/tematisk-hovedkategori",
    "begrep": "https://register.geonorge.no/metadata-kodelister/nasjonal-temainndeling",
}


def items(document: dict, id_key: str = "id", label_key: str = "label") -> list[tuple[str | None, str | None, str | None]]:
    """(id, label, codevalue) of a codelist document; entries without an id stay."""
    return [(i.get(id_key), i.get(label_key), i.get("codevalue")) for i in document["containeditems"]]


def http_loader(url: str) -> dict:
    """Fetches a codelist document. Opt-in: nothing here goes to the network unless this loader is passed."""
    request = urllib.request.Request(url, headers={"Accept": "application/json"})
    with urllib.request.urlopen(request, timeout=30) as answer:
        return json.load(answer)


@dataclass
class Codelists:
    """All codelists of a session. Remote documents are loaded once each, on first use; without a loader they are empty."""

    spark: SparkSession
    loader: Callable[[str], dict] | None = None
    id_key: str = "id"
    label_key: str = "label"
    _loaded: dict[str, list] = field(default_factory=dict)

    def rows(self, key: str) -> list[tuple[str | None, str | None, str | None]] | None:
        """(id, label, codevalue) of one codelist; None for a key that names none."""
        if key in REMOTE:
            if key not in self._loaded:
                self._loaded[key] = items(self.loader(REMOTE[key]), self.id_key, self.label_key) if self.loader else []
            return self._loaded[key]
        if key == "medaljongnivaa":
            return [(t, t, t) for t in TIERS]
        return [r[1:] for r in LOCAL if r[0] == key] or None

    def frame(self) -> DataFrame:
        every = [(key, *row) for key in ("tilgangsnivaa", "sikkerhetsnivaa", "geometri_encoding", "medaljongnivaa", *REMOTE) for row in self.rows(key)]
        return self.spark.createDataFrame(every, SCHEMA)

    def get(self, key: str) -> DataFrame | None:
        """The rows of one codelist as (id, label, codevalue), or None."""
        return None if self.rows(key) is None else self.frame().where(F.col("codelist") == key).drop("codelist")

    @staticmethod
    def from_json(documents: DataFrame, column: str) -> DataFrame:
        """(id, label, codevalue) of codelist documents held as JSON text in a column."""
        shape = "containeditems array<struct<id: string, label: string, codevalue: string>>"
        return documents.select(F.inline(F.from_json(F.col(column), shape)["containeditems"]))


def lookup(values: DataFrame, column: str, codelist: DataFrame, out: str = "known") -> DataFrame:
    """values with ``out``: whether the value is the id of an entry. Null is not; compare is exact, by id, not by label."""
    entry, own = unused(values.columns, "entry_id"), [f"`{c}`" for c in values.columns if c != out]
    ids = codelist.where("id is not null").select(F.col("id").alias(entry)).distinct()
    joined = values.join(ids, F.col(f"`{column}`") == F.col(entry), "left")
    return joined.selectExpr(*own, f"{entry} is not null as `{out}`")
