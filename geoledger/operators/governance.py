"""Metadata governance for a whole catalogue in one plan: pivot of tags, column tags, tier rules, error rows."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoledger.sources.catalog import COLUMN_KEYS, TABLE_KEYS, Catalog
from geoledger.sources.codelists import LOCAL, TIERS, Codelists

#: Tags that become columns of a table's record, in order; the comment is the description.
FIELDS = ["tittel", "beskrivelse", "tilgangsnivaa", "medaljongnivaa", "hovedkategori", "emneord", "epsg_koder", "begrep", "sikkerhetsnivaa"]
IDENTITY = ["catalog", "schema", "table"]
COMMENT_FIELD, GATE, ENCODING = "beskrivelse", "medaljongnivaa", "geometri_encoding"
COLUMN_PROPERTIES = "map<string, struct<epsg: string, geometri_encoding: string>>"
#: Fields that a tier demands, in the order of the errors.
TIER_RULES = {
    "bronze": ["tittel", "beskrivelse", "sikkerhetsnivaa"],
    "silver": ["tittel", "beskrivelse", "emneord", "begrep", "sikkerhetsnivaa"],
    "gold": ["tittel", "beskrivelse", "hovedkategori", "emneord", "begrep", "tilgangsnivaa", "sikkerhetsnivaa", ENCODING],
}
# What messages call a field's type.
TYPE_LABELS = {
    "tittel": "string",
    "beskrivelse": "string",
    "emneord": "string",
    "tilgangsnivaa": "tilgangsrestriksjoner",
    "medaljongnivaa": "valør",
    "hovedkategori": "tematisk-hovedkategori",
    "sikkerhetsnivaa": "sikkerhetsniva",
    "begrep": "nasjonal-temainndeling",
    "geometri_encoding": "geometri_encoding",
}
#: Fields whose value must be an id of the codelist of the same name.
CODED = ["tilgangsnivaa", "hovedkategori", "sikkerhetsnivaa", "begrep"]
ENCODINGS = [code.lower() for name, _, _, code in LOCAL if name == ENCODING]
ERROR = "ord int, for_field string, reason string, column string, description string, solution string, valid_values array<struct<id: string, label: string>>"


#: Estimated bytes of the relations (Parquet's, which are far fewer than rows take in memory) that make one more part.
PART_BYTES = 128 * 1024
#: Up to so many parts a task that deals rows out holds none of them (Spark's spark.shuffle.sort.bypassMergeThreshold).
MOST_PARTS = 200
#: A larger estimate is none: Spark gives one to rows that don't come from files.
UNKNOWN_BYTES = 1 << 50


def is_feature_tag(name: Column) -> Column:
    """Tags of the storage format itself are left out."""
    return ~name.contains("delta.")


def _parts(*relations: DataFrame | None) -> int:
    """How many parts the relations are dealt out to, by their estimated size; a session that sets more shuffle partitions may get more."""
    known = [r for r in relations if r is not None]
    spark, size = known[0].sparkSession, sum(int(r._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for r in known)
    set_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if size > UNKNOWN_BYTES:
        return set_
    return max(1, min(max(MOST_PARTS, set_), max(spark.sparkContext.defaultParallelism, size // PART_BYTES)))


def _dealt(relation: DataFrame, parts: int) -> DataFrame:
    """The rows of a table together, in a fixed number of parts: what is grouped or joined by table next isn't shuffled again.

    The catalogue's name is left out: it is often a literal, which Spark puts in the key's place, and then it knows no more
    that a table's rows are together. Without this a task sorts all tags that it reads, as texts' maxima are found in sorted rows; and adaptive execution joins
    parts by their compressed bytes, which repeated texts make few.
    """
    return relation.repartition(parts, *TABLE_KEYS[1:])


def table_metadata(catalog: Catalog, with_columns: bool = False) -> DataFrame:
    """One record for each table: IDENTITY, FIELDS, column_properties and optional_params.

    A tag that a table has twice counts with its greatest value. The description is the table's comment, whatever a tag
    says. Tags without a field are in optional_params. column_properties is empty unless with_columns is set, which fills
    it from the tags of columns.
    """
    parts = _parts(catalog.tags, catalog.tables, catalog.column_tags if with_columns else None)
    tags = _dealt(catalog.tags.where(is_feature_tag(F.col("tag_name"))), parts)
    tags = tags.groupBy(*TABLE_KEYS, "tag_name").agg(F.max("tag_value").alias("tag_value"))
    picks = [F.max(F.when(F.col("tag_name") == f, F.col("tag_value"))).alias(f) for f in FIELDS if f != COMMENT_FIELD]
    left = F.collect_list(F.when(~F.col("tag_name").isin(FIELDS), F.struct("tag_name", "tag_value")))
    wide = tags.groupBy(*TABLE_KEYS).agg(*picks, F.map_from_entries(F.sort_array(left)).alias("optional_params"))
    tables = catalog.tables.select(F.col("table_catalog").alias("catalog_name"), F.col("table_schema").alias("schema_name"), "table_name", F.col("comment").alias(COMMENT_FIELD))
    out = _dealt(tables, parts).join(wide, TABLE_KEYS, "left")
    if with_columns:
        out = out.join(column_properties(catalog, parts), TABLE_KEYS, "left")
    else:
        out = out.withColumn("column_properties", F.lit(None).cast(COLUMN_PROPERTIES))
    names = dict(zip(TABLE_KEYS, IDENTITY))
    params = F.coalesce("optional_params", F.expr("cast(map() as map<string, string>)")).alias("optional_params")
    return out.select(*(F.col(a).alias(b) for a, b in names.items()), *FIELDS, "column_properties", params)


def column_metadata(catalog: Catalog) -> DataFrame:
    """Every column with each of its tags; a column without a tag is there once, with nulls."""
    keys = dict(zip(("table_catalog", "table_schema", "table_name", "column_name"), COLUMN_KEYS))
    columns = catalog.columns.withColumnsRenamed(keys)
    return columns.join(catalog.column_tags, COLUMN_KEYS, "left")


def column_properties(catalog: Catalog, parts: int | None = None) -> DataFrame:
    """(TABLE_KEYS, column_properties): the epsg and geometri_encoding tags of each table's columns, in so many parts."""
    tag = lambda name: F.max(F.when(F.col("tag_name") == name, F.col("tag_value"))).alias(name)
    dealt = _dealt(catalog.column_tags, parts or _parts(catalog.column_tags))
    each = dealt.groupBy(*COLUMN_KEYS).agg(tag("epsg"), tag(ENCODING))
    entry = F.struct("column_name", F.struct("epsg", ENCODING).alias("p"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(entry)))
    return each.groupBy(*TABLE_KEYS).agg(entries.cast(COLUMN_PROPERTIES).alias("column_properties"))


FACT = "ord int, for_field string, reason string, column string"
_FACT_TYPE = "struct<" + FACT.replace(" ", ": ").replace(",:", ",") + ">"
_LISTED = "map<string, array<struct<id: string, label: string>>>"


def _fact(name: str, order: int, reason: Column, column: Column) -> Column:
    """What is wrong with one field, as a struct like FACT."""
    return F.struct(F.lit(order).alias("ord"), F.lit(name).alias("for_field"), reason.alias("reason"), column.alias("column"))


def _field_fact(name: str, order: int) -> Column:
    return _fact(name, order, F.when(F.col(name).isNull(), "missing").otherwise("invalid"), F.lit(None).cast("string"))


def _encoding_facts(order: int) -> Column:
    """A fact for each column with an epsg code whose encoding, in any case, isn't a known one (or is absent)."""
    entries = F.coalesce(F.map_entries("column_properties"), F.expr(f"cast(array() as array<struct<key: string, value: struct<epsg: string, {ENCODING}: string>>>)"))
    bad = F.filter(entries, lambda e: e["value"]["epsg"].isNotNull() & ~F.lower(F.coalesce(e["value"][ENCODING], F.lit(""))).isin(ENCODINGS))
    return F.transform(bad, lambda e: _fact(ENCODING, order, F.lit("missing"), e["key"]))


def _passes(name: str, codelists: Codelists) -> Column:
    """Whether a field's rule holds. An empty text is a value."""
    if name in CODED:
        ids = [r[0] for r in codelists.rows(name) if r[0] is not None]
        return F.col(name).isNotNull() & F.col(name).isin(ids) if ids else F.lit(False)
    return F.col(name).isNotNull()


def _worded(facts: DataFrame, codelists: Codelists) -> DataFrame:
    """IDENTITY and ERROR of rows of IDENTITY and FACT. Codelists are one literal, whatever the number of rules."""
    listed = {name: [{"id": r[0], "label": r[1]} for r in codelists.rows(name)] for name in (*CODED, GATE)} | {ENCODING: [{"id": e, "label": e} for e in ENCODINGS]}
    values = F.from_json(F.lit(json.dumps({k: v for k, v in listed.items() if v})), _LISTED)
    labels = F.create_map(*(F.lit(x) for pair in TYPE_LABELS.items() for x in pair))
    field, place = F.col("for_field"), F.concat_ws(".", *(F.coalesce(F.col(c), F.lit("None")) for c in IDENTITY))
    wanted = F.concat(F.lit("'<"), F.upper(field), F.lit(">'"))
    comment = F.concat(F.lit("COMMENT ON TABLE "), place, F.lit(" IS "), wanted)
    tag = F.concat(F.lit("ALTER TABLE "), place, F.lit(" SET TAGS ('"), field, F.lit("' = "), wanted, F.lit(")"))
    property_ = F.concat(F.lit("ALTER TABLE "), place, F.lit(" SET TBLPROPERTIES ('columns."), F.col("column"), F.lit("."), field, F.lit("' = "), wanted, F.lit(")"))
    of_column = F.when(F.col("column").isNotNull(), F.concat(F.lit(" for column "), F.col("column"))).otherwise("")
    of_list = F.when(F.col("valid_values").isNotNull(), "; one of the listed values").otherwise("")
    said = F.concat(F.lit("Field '"), field, F.lit("' is "), F.col("reason"), of_column, F.lit("; type <"), F.try_element_at(labels, field), F.lit(">"), of_list)
    fix = F.when(field == COMMENT_FIELD, comment).when(F.col("column").isNotNull(), property_).otherwise(tag)
    rows = facts.withColumn("valid_values", F.try_element_at(values, field))
    return rows.select(*IDENTITY, "ord", "for_field", "reason", "column", said.alias("description"), fix.alias("solution"), "valid_values")


def validate(records: DataFrame, codelists: Codelists) -> DataFrame:
    """IDENTITY and ERROR: a row for each rule that a table's record breaks, ``ord`` in the order of its tier's rules.

    A record whose tier isn't one of the three gets that one error (ord 0) only. Two projections: no join and no shuffle.
    """
    none = F.expr(f"cast(array() as array<{_FACT_TYPE}>)")
    facts = F.when(F.col(GATE).isNull() | ~F.col(GATE).isin(TIERS), F.array(_field_fact(GATE, 0)))
    for tier, names in TIER_RULES.items():
        checks = [_encoding_facts(k) if name == ENCODING else F.when(_passes(name, codelists), none).otherwise(F.array(_field_fact(name, k))) for k, name in enumerate(names, 1)]
        facts = facts.when(F.col(GATE) == tier, F.concat(*checks))
    return _worded(records.select(*IDENTITY, F.explode(facts).alias("fact")).select(*IDENTITY, "fact.*"), codelists)


def missing_tables(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """IDENTITY and ERROR: an error (ord 0, for the field "table") for each of the tables wanted (IDENTITY) that has no record."""
    lost = wanted.select(*IDENTITY).distinct().join(records.select(*IDENTITY), IDENTITY, "left_anti")
    place = F.concat_ws(".", *(F.coalesce(F.col(c), F.lit("None")) for c in IDENTITY))
    nothing = [F.lit(None).cast("string").alias("column"), F.concat(F.lit("Table "), place, F.lit(" is missing from the catalogue")).alias("description")]
    fix = [F.concat(F.lit("CREATE TABLE "), place).alias("solution"), F.lit(None).cast("array<struct<id: string, label: string>>").alias("valid_values")]
    return lost.select(*IDENTITY, F.lit(0).alias("ord"), F.lit("table").alias("for_field"), F.lit("missing").alias("reason"), *nothing, *fix)


def mandatory_fields(codelists: Codelists, tier: str, properties: dict[str, dict] | None = None) -> DataFrame:
    """The first error of each field that an empty record of this tier has. An unknown tier is a KeyError."""
    bad = sorted(c for c, v in (properties or {}).items() if v.get("epsg") is not None and str(v.get(ENCODING) or "").lower() not in ENCODINGS)
    rows = [(None, None, None, k, name, "missing", bad[0] if name == ENCODING else None) for k, name in enumerate(TIER_RULES[tier], 1) if name != ENCODING or bad]
    facts = codelists.spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in IDENTITY) + f", {FACT}")
    return _worded(facts, codelists).drop(*IDENTITY)


@dataclass
class TableMetadata:
    """One table's record by hand. Unknown names are optional parameters, but for those of the storage format."""

    values: dict = field(default_factory=dict)
    column_properties: dict[str, dict] | None = None
    optional_params: dict = field(default_factory=dict)

    def __init__(self, column_properties: dict[str, dict] | None = None, **named):
        known = {*IDENTITY, *FIELDS}
        self.values = {k: named.get(k) for k in (*IDENTITY, *FIELDS)}
        self.column_properties = column_properties
        self.optional_params = {k: v for k, v in named.items() if k not in known and "delta." not in k}

    def frame(self, spark) -> DataFrame:
        properties = None if self.column_properties is None else {k: (v.get("epsg"), v.get(ENCODING)) for k, v in self.column_properties.items()}
        params = {k: None if v is None else str(v) for k, v in self.optional_params.items()}
        schema = ", ".join(f"`{n}` string" for n in self.values) + f", column_properties {COLUMN_PROPERTIES}, optional_params map<string, string>"
        return spark.createDataFrame([(*self.values.values(), properties, params)], schema)


@dataclass(frozen=True)
class Metadata:
    """One table of a catalogue."""

    source: Catalog
    codelists: Codelists
    catalog: str
    schema: str
    table: str

    def _own(self) -> Catalog:
        return self.source.only(self.catalog, self.schema, self.table)

    def get_table_metadata(self, with_columns: bool = False) -> DataFrame:
        """Its record: one row, or none if there is no such table."""
        return table_metadata(self._own(), with_columns)

    def get_table_column_metadata(self) -> DataFrame:
        return column_metadata(self._own())

    def validate(self, with_columns: bool = False) -> DataFrame:
        """Its errors; a table that isn't there is an error too."""
        records = self.get_table_metadata(with_columns)
        wanted = records.sparkSession.createDataFrame([(self.catalog, self.schema, self.table)], ", ".join(f"`{c}` string" for c in IDENTITY))
        return validate(records, self.codelists).unionByName(missing_tables(wanted, records))
