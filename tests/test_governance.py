"""Governance of metadata, codelists and contracts."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoledger.operators import governance as g
from geoledger.operators.json_schema import contract_violations, convert_json_schema_to_spark, fields
from geoledger.sources.catalog import Catalog, session_catalog
from geoledger.sources.codelists import Codelists, lookup

REGISTER = "https://register.geonorge.no/metadata-kodelister"
GOLD = {
    "catalog": "kart", "schema": "vann", "table": "innsjoer", "tittel": "Innsjøer og tjern", "beskrivelse": "Flater med areal og høyde",
    "tilgangsnivaa": "http://publications.europa.eu/resource/authority/access-right/RESTRICTED", "medaljongnivaa": "gold",
    "hovedkategori": f"{REGISTER}/tematisk-hovedkategori/lakes", "begrep": f"{REGISTER}/nasjonal-temainndeling/Hydrografi",
    "epsg_koder": "4258", "emneord": "ferskvann", "sikkerhetsnivaa": f"{REGISTER}/sikkerhetsnivaa/unclassified",
}
PROPERTIES = {"flate": {"epsg": "4258", "geometri_encoding": "wkb"}}


@pytest.fixture(scope="module")
def lists(spark):
    return Codelists(spark, lambda url: {"containeditems": [{"id": f"{url}/{k}", "label": k} for k in ("lakes", "Hydrografi")]})


def errors(lists, properties=PROPERTIES, **changes):
    record = g.TableMetadata(column_properties=properties, **(GOLD | changes))
    return [(r["for_field"], r["reason"], r["column"]) for r in g.validate(record.frame(lists.spark), lists).orderBy("ord", "column").collect()]


def test_gold_record(lists):
    assert errors(lists) == [] and errors(lists, ukjent="x") == []


@pytest.mark.parametrize(("changes", "want"), [
    ({"medaljongnivaa": None, "tittel": None}, [("medaljongnivaa", "missing", None)]), ({"medaljongnivaa": "Gold"}, [("medaljongnivaa", "invalid", None)]),
    ({"tilgangsnivaa": "Allmen tilgang"}, [("tilgangsnivaa", "invalid", None)]), ({"tittel": ""}, []), ({"sikkerhetsnivaa": None, "tittel": None}, [("tittel", "missing", None), ("sikkerhetsnivaa", "missing", None)]),
    ({"medaljongnivaa": "bronze", "begrep": None, "emneord": None}, []), ({"medaljongnivaa": "silver", "begrep": "x", "emneord": None}, [("emneord", "missing", None), ("begrep", "invalid", None)]),
])
def test_rules(lists, changes, want):
    assert errors(lists, **changes) == want


def test_encodings(lists):
    given = {"a": {"epsg": "1", "geometri_encoding": "GeoJson"}, "b": {"epsg": "1"}, "c": {"geometri_encoding": "no"}, "d": {"epsg": "1", "geometri_encoding": "shape"}}
    assert errors(lists, given) == [("geometri_encoding", "missing", "b"), ("geometri_encoding", "missing", "d")]
    assert errors(lists, None) == []


def test_error_texts(lists):
    row = g.validate(g.TableMetadata(**(GOLD | {"beskrivelse": None})).frame(lists.spark), lists).first()
    assert row["solution"].startswith("COMMENT ON TABLE kart.vann.innsjoer") and row["valid_values"] is None
    row = g.validate(g.TableMetadata(**(GOLD | {"tilgangsnivaa": None})).frame(lists.spark), lists).first()
    assert "SET TAGS" in row["solution"] and len(row["valid_values"]) == 3


def test_mandatory_fields(lists):
    got = {t: [r["for_field"] for r in g.mandatory_fields(lists, t).orderBy("ord").collect()] for t in g.TIER_RULES}
    assert got == {t: [f for f in names if f != "geometri_encoding"] for t, names in g.TIER_RULES.items()}
    assert "geometri_encoding" in [r["for_field"] for r in g.mandatory_fields(lists, "gold", {"x": {"epsg": "1"}}).collect()]
    with pytest.raises(KeyError):
        g.mandatory_fields(lists, "platinum")


def test_optional_parameters():
    made = g.TableMetadata(tittel="t", eier="x", **{"delta.y": "1"})
    assert made.values["tittel"] == "t" and made.optional_params == {"eier": "x"}


def test_one_table_of_a_catalogue(spark, lists):
    tags = [("c", "s", "t", "tittel", "a"), ("c", "s", "t", "tittel", "b"), ("c", "s", "t", "beskrivelse", "tag"), ("c", "s", "t", "medaljongnivaa", "bronze"), ("c", "s", "t", "x.delta.y", "1"), ("c", "s", "u", "tittel", "z")]
    catalog = Catalog(
        spark.createDataFrame(tags, "catalog_name string, schema_name string, table_name string, tag_name string, tag_value string"),
        spark.createDataFrame([("c", "s", "t", "comment"), ("c", "s", "u", None)], "table_catalog string, table_schema string, table_name string, comment string"),
        spark.createDataFrame([("c", "s", "t", "id"), ("c", "s", "t", "geom")], "table_catalog string, table_schema string, table_name string, column_name string"),
        spark.createDataFrame([("c", "s", "t", "geom", "epsg", "1"), ("c", "s", "t", "geom", "a", "2")], "catalog_name string, schema_name string, table_name string, column_name string, tag_name string, tag_value string"),
    )
    one = g.Metadata(catalog, lists, "c", "s", "t")
    row = one.get_table_metadata(with_columns=True).first()
    assert (row["tittel"], row["beskrivelse"], row["optional_params"]) == ("b", "comment", {}) and row["column_properties"]["geom"]["epsg"] == "1"
    assert sorted((r["column_name"], r["tag_name"]) for r in one.get_table_column_metadata().collect() if r["tag_name"]) == [("geom", "a"), ("geom", "epsg")]
    assert one.get_table_column_metadata().count() == 3
    assert [r["for_field"] for r in one.validate().collect()] == ["sikkerhetsnivaa"]
    assert [(r["table"], r["for_field"], r["reason"], r["column"]) for r in g.Metadata(catalog, lists, "c", "s", "none").validate().collect()] == [("none", "table", "missing", None)]


def test_a_session_catalogue(spark):
    spark.sql("drop table if exists governed")
    spark.sql("create table governed (id int, geom binary) using parquet comment 'words' tblproperties ('tittel' = 'T', 'columns.geom.epsg' = '25835')")
    catalog = session_catalog(spark)
    row = g.table_metadata(catalog, with_columns=True).where("table = 'governed'").first()
    assert row["tittel"] == "T" and row["beskrivelse"] == "words" and row["column_properties"]["geom"]["epsg"] == "25835"
    spark.sql("drop table governed")


def test_codelists(spark, lists):
    assert lists.get("unknown") is None and lists.get("medaljongnivaa").count() == 3 and lists.get("begrep").count() == 2
    values = spark.createDataFrame([(f"{REGISTER}/sikkerhetsnivaa/unclassified",), ("Ugradert",), (None,)], "v string")
    assert [r["known"] for r in lookup(values, "v", lists.get("sikkerhetsnivaa")).orderBy(values.v.desc()).collect()].count(True) == 1
    documents = spark.createDataFrame([('{"containeditems": [{"id": "a", "label": "A", "codevalue": "1"}, {"label": "B"}]}',)], "j string")
    assert [tuple(r) for r in Codelists.from_json(documents, "j").collect()] == [("a", "A", "1"), (None, "B", None)]


def test_lookup_beside_columns_of_any_name(spark, lists):
    values = spark.createDataFrame([("gold", 1, 2), ("Gold", 3, 4)], "`a b` string, entry_id int, Entry_id_1 int")
    got = lookup(values, "a b", lists.get("medaljongnivaa"))
    assert got.columns == ["a b", "entry_id", "Entry_id_1", "known"] and sorted(map(tuple, got.collect())) == [("Gold", 3, 4, False), ("gold", 1, 2, True)]


# Contracts


def kinds(document, **more):
    return {f.name: (f.dataType.simpleString(), f.nullable) for f in convert_json_schema_to_spark(document, **more)}


def test_primitives_and_requirements():
    document = {"properties": {k: {"type": k} for k in ("string", "number", "float", "integer", "boolean", "decimal", "date")}, "required": ["string"]}
    assert kinds(document) == {"string": ("string", False), "number": ("double", True), "float": ("float", True), "integer": ("bigint", True), "boolean": ("boolean", True), "decimal": ("string", True), "date": ("string", True)}
    assert all(not n for _, n in kinds(document, enforce_required_field=False).values())
    assert all(n for _, n in kinds(document, enforce_required_field=False, strict=True).values())
    assert kinds({"properties": {"x": {"type": ["string", "null"]}}}, default_type="timestamp") == {"x": ("timestamp", True)}
    assert kinds({"properties": {"x": {}}}, default_type="decimal") == {"x": ("decimal(10,0)", True)} and kinds({"properties": {"x": {}}}, default_type="odd") == {"x": ("string", True)}


def test_nesting_and_references():
    document = {
        "properties": {
            "gone": {"const": 1}, "e": {"enum": [1, 2]}, "list": {"type": "array", "items": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}}, "bare": {"type": "array"},
            "none": {"type": "object"}, "ref": {"$ref": "#/d/p", "description": "ignored"}, "lost": {"$ref": "#/d/q"}, "far": {"$ref": "other.json#/x"},
        },
        "d": {"p": {"type": "object", "required": ["ref"], "properties": {"n": {"type": "number"}}}}, "required": ["far"],
    }
    schema = convert_json_schema_to_spark(document, external_ref_base_uri="http://h", resolver=lambda url: {"x": {"type": "boolean"}} if url == "http://h/other.json" else {})
    got = {f.name: f.dataType.simpleString() for f in schema}
    assert got == {"e": "string", "list": "array<struct<a:bigint>>", "bare": "array<string>", "none": "struct<>", "ref": "struct<n:double>", "lost": "string", "far": "boolean"}
    assert schema["far"].nullable and not schema["ref"].nullable and schema["list"].dataType.containsNull
    assert schema["ref"].metadata == {"path": "#/properties/ref/$ref/#/d/p", "description": ""}
    assert ("list[].a", "bigint", False, "#/properties/list/items/properties/a", "") in fields(schema)


def test_bad_contracts():
    for document in ({}, {"properties": {}}, {"properties": {"a": {"$ref": "#/properties/a"}}}, {"properties": {"a": {"$ref": "http://x"}}}):
        with pytest.raises(ValueError):
            convert_json_schema_to_spark(document)


def test_violations(spark):
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("s", T.StructType([T.StructField("a", T.StringType(), False)])), T.StructField("l", T.ArrayType(T.StructType([T.StructField("b", T.StringType(), False)])))])
    rows = spark.createDataFrame([(1, None, ("x",), [("y",)]), (2, 5, (None,), None), (3, 6, None, [(None,), ("z",)])], "k int, id long, s struct<a: string>, l array<struct<b: string>>")
    assert sorted((r["k"], r["violation"]) for r in contract_violations(rows, schema, ["k"]).collect()) == [(1, "id"), (2, "s.a"), (3, "l[].b")]


def test_violations_at_any_depth(spark):
    inner = T.StructType([T.StructField("b", T.LongType(), False)])
    schema = T.StructType([
        T.StructField("l", T.ArrayType(T.StructType([T.StructField("s", inner, False)]))),
        T.StructField("g", T.ArrayType(T.ArrayType(inner, False))),
    ])
    rows = spark.createDataFrame(
        [(1, [(None,)], None), (2, [((None,),), None], [None, [(1,)]]), (3, [((1,),)], [[(None,), (2,)]]), (4, [], [[None, (3,)]]), (5, None, [[]])],
        "k int, l array<struct<s: struct<b: bigint>>>, g array<array<struct<b: bigint>>>",
    )
    got = sorted((r["k"], r["violation"]) for r in contract_violations(rows, schema, ["k"]).collect())
    assert got == [(1, "l[].s"), (2, "l[].s.b"), (3, "g[][].b"), (4, "g[][]")]


def test_a_circular_document_is_flat():
    document = {"properties": {"n": {"type": "integer"}, "o": {"type": "object", "properties": {"x": {}}}}}
    assert kinds(document, circular_references=["#"]) == {"n": ("string", True), "o": ("string", True)}
    assert kinds(document, circular_references=["#/o"]) == kinds(document)


def test_no_task_sorts_what_it_reads(spark):
    """Tags, tables and tags of columns are dealt out by table as they are read, once, in parts that adaptive execution doesn't join."""
    rows = spark.range(3000).selectExpr("'c' as catalog_name", "concat('s', id % 3) as schema_name", "concat('t', id) as table_name", "id")
    tags = rows.selectExpr("catalog_name", "schema_name", "table_name", "inline(array(struct('tittel' as tag_name, 'T' as tag_value), struct('tittel' as tag_name, 'U' as tag_value), struct('eier' as tag_name, cast(id as string) as tag_value)))")
    column_tags = rows.selectExpr("catalog_name", "schema_name", "table_name", "'geom' as column_name", "inline(array(struct('epsg' as tag_name, '1' as tag_value), struct('epsg' as tag_name, '2' as tag_value)))")
    tables = rows.selectExpr("catalog_name as table_catalog", "schema_name as table_schema", "table_name", "cast(null as string) as comment")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = g.table_metadata(Catalog(tags, tables, None, column_tags), with_columns=True)
        plan = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
        assert len(plan) == 3 and all("REPARTITION_BY_NUM" in line for line in plan), plan
        got = out.select("table", "tittel", F.expr("optional_params['eier']").alias("eier"), F.expr("column_properties['geom'].epsg").alias("epsg")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, got)) == sorted((f"t{k}", "U", str(k), "2") for k in range(3000))


def test_parts_grow_with_the_relations(spark):
    """They stay few enough to be dealt out without holding rows; an estimate that is none counts for nothing."""
    parts = lambda n: g._parts(spark.range(n))  # noqa: E731  8 bytes a row
    assert parts(10) == spark.sparkContext.defaultParallelism and parts(10 * g.PART_BYTES) == 80 and parts(10**10) == g.MOST_PARTS
    assert g._parts(spark.createDataFrame([(1,)], "a int"), None) == int(spark.conf.get("spark.sql.shuffle.partitions"))
