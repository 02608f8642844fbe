"""The registered queries of the geodata operators, over inputs derived from the given tables, and their SQL.

The tables hold no geometry, raster or tags, so both sides derive them by arithmetic on keys; the SQL states the expected
answer from that arithmetic and doesn't repeat the parsing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from geoledger.functions import contours, curves, wkb
from geoledger.functions.register import register_all
from geoledger.operators import governance, json_schema
from geoledger.plans.merge import plan_merge, plan_snapshot
from geoledger.plans.sql_text import Delivery
from geoledger.sources.catalog import Catalog
from geoledger.sources.codelists import Codelists, lookup
from geoledger.sources.geotiff import write
from geoledger.spread import spread

BASES = [*range(25), 102, 1025, 26, 99]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Geometry headers


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, wkb): every base type in plain, ISO and flagged form, both byte orders, some null and some short."""
    bases = ", ".join(f"{b}L" for b in BASES)
    extra = "element_at(array(0L, 1000L, 2000L, 3000L, 2147483648L, 1073741824L, 3221225472L, 536870912L), cast(p_partkey % 8 as int) + 1)"
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    code = part.selectExpr("*", f"lpad(hex(element_at(array({bases}), cast(p_partkey % {len(BASES)} as int) + 1) + {extra}), 8, '0') as h")
    swapped = "concat(substring(h, 7, 2), substring(h, 5, 2), substring(h, 3, 2), substring(h, 1, 2))"
    text = f"concat(if(p_size % 2 = 0, '00', '01'), if(p_size % 2 = 0, h, {swapped}), repeat('00', 16))"
    return code.selectExpr("p_partkey", f"case p_partkey % 50 when 0 then null when 1 then unhex('010100') else unhex({text}) end as wkb")


_EXPECTED = """
    case when p_partkey % 50 = 0 then 'Invalid (null input)'
         when p_partkey % 50 = 1 then 'Invalid (too short)'
         when p_partkey % 29 = 26 and p_partkey % 8 < 4
         then ['Unknown(25) Z', 'Unknown(25) M', 'Unknown(25) ZM', 'Unknown(4025)'][cast(p_partkey % 8 as int) + 1]
         else ['Geometry', 'Point', 'LineString', 'Polygon', 'MultiPoint', 'MultiLineString', 'MultiPolygon', 'GeometryCollection', 'CircularString', 'CompoundCurve',
               'CurvePolygon', 'MultiCurve', 'MultiSurface', 'Curve', 'Surface', 'PolyhedralSurface', 'TIN', 'Triangle', 'Circle', 'GeodesicString', 'EllipticalCurve',
               'NurbsCurve', 'Clothoid', 'SpiralCurve', 'CompoundSurface', 'AffinePlacement', 'BrepSolid', 'Unknown(26)', 'Unknown(99)'][cast(p_partkey % 29 as int) + 1]
              || ['', ' Z', ' M', ' ZM', ' Z', ' M', ' ZM', ''][cast(p_partkey % 8 as int) + 1]
    end"""


def wkb_geom_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wkb.with_geometry_type(_headers(spark, sf_dir), "wkb").select("p_partkey", "geom_type")


def wkb_geom_type_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _headers(spark, sf_dir).selectExpr("p_partkey", "hex(wkb) as h")
    text = whole.selectExpr(
        "p_partkey",
        r"""case p_partkey % 7 when 0 then h when 1 then lower(h) when 2 then regexp_replace(h, '(..)', ' $1\t') when 3 then concat('zz', h)
            when 4 then left(h, length(h) - 1) when 5 then null else ' ' end as h""",
    )
    return wkb.with_geometry_type_hex(text, "h").select("p_partkey", "geom_type")


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions under their SQL names: types of binary and hex headers, of a linearised half circle, and of no contours."""
    register_all(spark)
    return spark.sql(
        """select p_partkey, get_wkb_geom_type(wkb) as geom_type, get_wkb_geom_type_hex(hex(wkb)) as of_hex, hex(wkb_strip_srid(x'0101000020E6100000')) as stripped,
            get_wkb_geom_type(curved_to_linear_wkb(unhex(concat('010800000003000000', repeat('00', 16), '000000000000F03F000000000000F03F', '0000000000000040', repeat('00', 8))), 45D)) as linear,
            get_wkb_geom_type(generate_contours_udf(cast(null as binary), 10D, 0D)) as contours from {headers}""",
        headers=_headers(spark, sf_dir),
    )


def wkb_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wkb_geom_type(spark, sf_dir).groupBy("geom_type").agg(F.count("*").alias("n"))


def wkb_strip_srid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey",
        "lpad(hex(1 + s_suppkey % 7 + if(s_suppkey % 2 = 1, 2147483648L, 0L) + if(s_suppkey % 5 != 0, 536870912L, 0L)), 8, '0') as h",
        "lpad(hex(s_suppkey), 32, '0') as body",
        "concat('0', s_suppkey % 3) as ord",
    )
    swapped = "concat(substring(h, 7, 2), substring(h, 5, 2), substring(h, 3, 2), substring(h, 1, 2))"
    made = rows.selectExpr("s_suppkey", f"unhex(concat(ord, if(ord = '01', {swapped}, h), if(s_suppkey % 5 != 0, '000010E6', ''), body)) as wkb")
    return made.select("s_suppkey", F.hex(wkb.strip_srid("wkb")).alias("wkb_hex"))


def _curve(key: int) -> bytes:
    """One of five curved shapes made of half and full circles of radius 1 + key % 10 around (radius, 0)."""
    import struct

    r = 1.0 + key % 10
    line = lambda kind, *xy: struct.pack(f"<BII{len(xy)}d", 1, kind, len(xy) // 2, *xy)
    group = lambda kind, *members: struct.pack("<BII", 1, kind, len(members)) + b"".join(members)
    half, full = line(8, 0, 0, r, r, 2 * r, 0), group(10, line(8, 0, 0, 2 * r, 0, 0, 0))
    return [half, group(9, half, line(2, 2 * r, 0, 3 * r, 5)), full, group(12, full), group(11, line(2, 0, 0, r, 1), half)][key % 5]


def _vertices(data: bytes, at: int = 0) -> tuple[list[np.ndarray], int]:
    """All vertices of a little-endian linear geometry in order, as (n, 2) for each of its lines, and where it ends."""
    import struct

    _, kind, n = struct.unpack_from("<BII", data, at)
    at, out = at + 9, []
    for _ in range(1 if kind == 2 else n):
        if kind in (2, 3):
            size, at = (n, at) if kind == 2 else (struct.unpack_from("<I", data, at)[0], at + 4)
            out.append(np.frombuffer(data, "<f8", 2 * size, at).reshape(size, 2))
            at += 16 * size
        else:
            part, at = _vertices(data, at)
            out += part
    return out, at


def _points(lines: str) -> Column:
    """Array of (n, x, y) of a column's vertices."""

    def each(values: pa.Array) -> pa.Array:
        found = [[] if v is None else _vertices(v)[0] for v in values.to_pylist()]
        counts = np.array([sum(map(len, f)) for f in found], np.int64)
        starts = np.concatenate(([0], np.cumsum(counts)))
        xy = np.concatenate([np.zeros((0, 2)), *(part for f in found for part in f)])
        n = np.arange(len(xy)) - np.repeat(starts[:-1], counts)
        points = pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["n", "x", "y"])
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), points, mask=values.is_null())

    return F.arrow_udf(each, "array<struct<n: int, x: double, y: double>>")(lines)


def curve_linearize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circular strings, compound curves, curve polygons, multi-surfaces and multi-curves: the type and all vertices of what they become."""
    shapes = F.array(*(F.lit(_curve(k)) for k in range(10)))  # a curve is told by the last digit of its key
    keys = spread(table(spark, sf_dir, "customer").select("c_custkey"))
    made = keys.withColumn("wkb", F.element_at(shapes, F.expr("cast(c_custkey % 10 as int) + 1")))
    step = F.expr("element_at(array(45D, 30D, 10D, 0D), cast(c_custkey % 4 as int) + 1)")
    linear = curves.linearized(made, "wkb", step)
    points = linear.select("c_custkey", wkb.geometry_type("linear").alias("geom_type"), F.inline(_points("linear")))
    return points.selectExpr("c_custkey", "geom_type", "n", "round(x, 6) + 0D as x", "round(y, 6) + 0D as y")


def contour_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours of ramps that rise by 3 a column, one 5 x 4 tile for each nation."""
    tiles = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "5 as width", "4 as height", "transform(sequence(0, 19), k -> cast(n_nationkey + 0.5 + 3 * (k % 5) as double)) as values")
    out = contours.segments(tiles, "n_nationkey", 10.0)
    return out.select("n_nationkey", "level", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


def contours_wkb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ramps as raster files: the type of what they become, and every vertex."""

    def raster(key: pd.Series) -> pd.Series:
        return pd.Series([write(np.tile(k + 0.5 + 3.0 * np.arange(5), (4, 1))) for k in key], dtype=object)

    tiles = table(spark, sf_dir, "nation").select("n_nationkey", F.pandas_udf(raster, BinaryType())("n_nationkey").alias("tile"))
    made = tiles.select("n_nationkey", contours.generate_contours("tile", F.lit(10.0), F.lit(0.0)).alias("lines"))
    points = made.select("n_nationkey", wkb.geometry_type("lines").alias("geom_type"), F.inline_outer(_points("lines")))
    return points.selectExpr("n_nationkey", "geom_type", "round(x, 6) as x", "round(y, 6) as y")


# Governance

_REMOTE = "https://example.org/codelist/"


def codelists(spark: SparkSession) -> Codelists:
    """The local codelists, and stand-ins for the remote ones."""
    return Codelists(spark, lambda url: {"containeditems": [{"id": f"{_REMOTE}{k}", "label": k} for k in ("a", "b")]})


_TAGS = {
    "tittel": "if(p_partkey % 3 = 0, null, p_name)",
    "beskrivelse": "'a tag does not count'",
    "tilgangsnivaa": "element_at(array('http://publications.europa.eu/resource/authority/access-right/PUBLIC', 'PUBLIC', null), cast(p_partkey % 3 as int) + 1)",
    "medaljongnivaa": "element_at(array('bronze', 'silver', 'gold', 'Gold', null), cast(p_partkey % 5 as int) + 1)",
    "hovedkategori": f"element_at(array('{_REMOTE}a', 'a', null, '{_REMOTE}b'), cast(p_partkey % 4 as int) + 1)",
    "emneord": "if(p_partkey % 11 = 0, null, '')",
    "begrep": f"if(p_partkey % 2 = 0, '{_REMOTE}b', '{_REMOTE}c')",
    "sikkerhetsnivaa": "element_at(array('https://register.geonorge.no/metadata-kodelister/sikkerhetsnivaa/unclassified', 'Ugradert', null), cast(p_partkey % 3 as int) + 1)",
    "delta.feature": "'on'",
    "eier": "p_brand",
}


def _part_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Every part as a table with tags; and three columns of each, some with tags."""
    part = table(spark, sf_dir, "part")
    pairs = ", ".join(f"struct('{k}' as tag_name, {v} as tag_value)" for k, v in _TAGS.items())
    named = part.selectExpr("*", "'c' as catalog_name", "concat('s', p_partkey % 9) as schema_name", "concat('t', p_partkey) as table_name")
    tags = named.selectExpr("catalog_name", "schema_name", "table_name", f"inline(filter(array({pairs}), x -> x.tag_value is not null))")
    tables = named.selectExpr("catalog_name as table_catalog", "schema_name as table_schema", "table_name", "if(p_partkey % 7 = 0, null, p_type) as comment")
    columns = named.selectExpr("catalog_name as table_catalog", "schema_name as table_schema", "table_name", "explode(array('id', 'geom', 'area')) as column_name")
    given = {
        ("geom", "epsg"): "if(p_partkey % 4 = 0, null, '25835')",
        ("geom", "geometri_encoding"): "element_at(array('WKB', 'GeoJson', 'shape', null), cast(p_partkey % 4 as int) + 1)",
        ("area", "epsg"): "if(p_partkey % 6 = 0, '4326', null)",
    }
    entries = "array(" + ", ".join(f"struct('{c}' as column_name, '{t}' as tag_name, {v} as tag_value)" for (c, t), v in given.items()) + ")"
    column_tags = named.selectExpr("catalog_name", "schema_name", "table_name", f"inline(filter({entries}, x -> x.tag_value is not null))")
    return Catalog(tags, tables, columns, column_tags)


def meta_tags_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = governance.table_metadata(_part_catalog(spark, sf_dir))
    return out.select(*governance.IDENTITY, *governance.FIELDS, F.expr("optional_params['eier']").alias("eier"), F.size("optional_params").alias("n_params"))


def meta_column_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.column_metadata(_part_catalog(spark, sf_dir)).select("table_name", "column_name", "tag_name", "tag_value")


def meta_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = governance.validate(governance.table_metadata(_part_catalog(spark, sf_dir)), codelists(spark))
    return errors.select(F.col("table").alias("table_name"), "ord", "for_field", "reason", F.size(F.coalesce("valid_values", F.array())).alias("n_values"))


def meta_error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = governance.validate(governance.table_metadata(_part_catalog(spark, sf_dir), with_columns=True), codelists(spark))
    return errors.select(F.col("table").alias("table_name"), "for_field", "column", "description", "solution", F.expr("valid_values[0].id").alias("first_id"))


def meta_missing_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's table is asked for, and every tenth under a name that isn't there."""
    part = table(spark, sf_dir, "part")
    wanted = part.selectExpr("'c' as catalog", "concat('s', p_partkey % 9) as schema", "explode(if(p_partkey % 10 = 0, array(concat('t', p_partkey), concat('x', p_partkey)), array(concat('t', p_partkey)))) as table")
    lost = governance.missing_tables(wanted, governance.table_metadata(_part_catalog(spark, sf_dir)))
    return lost.select("catalog", "schema", F.col("table").alias("table_name"), "ord", "for_field", "reason", "description", "solution")


def meta_mandatory_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, out = codelists(spark), None
    for tier in governance.TIER_RULES:
        own = governance.mandatory_fields(lists, tier).select(F.lit(tier).alias("tier"), "ord", "for_field", "reason")
        out = own if out is None else out.unionByName(own)
    return out


def meta_geometry_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = governance.validate(governance.table_metadata(_part_catalog(spark, sf_dir), with_columns=True), codelists(spark))
    return errors.where("for_field = 'geometri_encoding'").select(F.col("table").alias("table_name"), "column", "ord")


def codelist_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_TAGS['tilgangsnivaa']} as value")
    return lookup(values, "value", codelists(spark).get("tilgangsnivaa"))


# Contracts

EVENT_CONTRACT = {
    "properties": {
        "k": {"type": "integer", "description": "a number"},
        "kind": {"enum": ["a", 1]},
        "version": {"const": 1},
        "where": {"type": "object", "required": ["x"], "properties": {"x": {"type": "number"}, "tags": {"type": "array", "items": {"type": "string"}}}},
        "who": {"$ref": "#/$defs/person"},
        "lost": {"$ref": "#/$defs/nobody"},
        "when": {"type": ["string", "null"], "format": "date-time"},
    },
    "required": ["k"],
    "$defs": {"person": {"type": "object", "properties": {"name": {"type": "string"}}}},
}


def json_schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = json_schema.fields(json_schema.convert_json_schema_to_spark(EVENT_CONTRACT))
    return spark.createDataFrame(rows, "name string, type string, nullable boolean, path string, description string")


def json_schema_parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = json_schema.convert_json_schema_to_spark(EVENT_CONTRACT)
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", schema)["k"].alias("k"))


def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = json_schema.convert_json_schema_to_spark({"properties": {"user_id": {"type": "integer"}, "event_type": {"type": "string"}, "value": {"type": "number"}}, "required": ["user_id", "event_type"]})
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "if(event_id % 5 = 0, null, user_id) as user_id", "if(event_id % 3 = 0, null, event_type) as event_type", "cast(null as double) as value")
    return json_schema.contract_violations(rows, schema, ["event_id"])


def contract_violations_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields below arrays of arrays, and below structs in arrays."""
    inner = {"type": "object", "required": ["v"], "properties": {"v": {"type": "number"}}}
    items = {"type": "object", "required": ["kind"], "properties": {"kind": {"type": "string"}, "deep": inner}}
    schema = json_schema.convert_json_schema_to_spark({"properties": {"list": {"type": "array", "items": items}, "grid": {"type": "array", "items": {"type": "array", "items": inner}}}})
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "array(struct('x' as kind, struct(1D as v) as deep), struct(if(event_id % 3 = 0, null, event_type) as kind, if(event_id % 2 = 0, null, struct(if(event_id % 5 = 0, null, value) as v)) as deep)) as list",
        "array(null, array(struct(2D as v), if(event_id % 4 = 0, null, struct(if(event_id % 7 = 0, null, 3D) as v)))) as grid",
    )
    return json_schema.contract_violations(rows, schema, ["event_id"])


def contract_external_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative and absolute references to other documents, and a document that is circular as a whole."""
    person = {"defs": {"person": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "description": "said"}}}}, "type": "integer"}
    document = {"properties": {"who": {"$ref": "people.json#/defs/person"}, "whole": {"$ref": "http://other/people.json"}}, "required": ["who"]}
    rows = json_schema.fields(json_schema.convert_json_schema_to_spark(document, external_ref_base_uri="http://base", resolver=lambda url: person))
    rows += json_schema.fields(json_schema.convert_json_schema_to_spark({"properties": {"n": {"type": "integer"}, "c": {"const": 1}}}, circular_references=["#"]))
    return spark.createDataFrame(rows, "name string, type string, nullable boolean, path string, description string")


# Delivery


def delivery_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements that a server gets, with odd names and a geometry."""
    text = Delivery("stage.orders", "public.orders", "op", 25833, ["geo m"])
    columns = ["id", 'a"b', "geo m", "op"]
    rows = [("snapshot", k, t) for k, t in enumerate(text.snapshot(columns))] + [("merge", 0, text.merge(columns, ["id"])), ("merge of keys only", 0, text.merge(["id", "op"], ["id"]))]
    return spark.createDataFrame(rows, "mode string, n int, statement string")


def sync_snapshot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", F.lit("update").alias("update_type"))
    return plan_snapshot(feed)


def sync_merge_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    feed = orders.where("o_orderkey % 6 < 5").selectExpr(
        "if(o_orderkey % 6 < 3, o_orderkey, o_orderkey + 1000000000) as o_orderkey",
        "o_totalprice + 1 as o_totalprice",
        "element_at(array('delete', 'update', null, 'insert', 'delete'), cast(o_orderkey % 6 as int) + 1) as update_type",
    )
    return plan_merge(orders, feed, ["o_orderkey"])


def sync_merge_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the target's and two thirds of the feed's keys are null; the feed lacks one column."""
    orders = table(spark, sf_dir, "orders")
    target = orders.selectExpr("if(o_orderkey % 2 = 0, null, o_orderkey) as k", "o_custkey as j", "o_totalprice", "o_orderstatus")
    feed = orders.selectExpr("if(o_orderkey % 3 > 0, null, o_orderkey) as k", "o_custkey as j", "-o_totalprice as o_totalprice", "element_at(array('update', 'delete', null), cast(o_orderkey % 5 % 3 as int) + 1) as update_type")
    return plan_merge(target, feed, ["k", "j"])


QUERIES = {
    f.__name__: f
    for f in (
        wkb_geom_type, wkb_geom_type_hex, wkb_type_histogram, sql_functions, wkb_strip_srid, curve_linearize, contour_segments, contours_wkb, meta_tags_pivot, meta_column_tags,
        meta_validate, meta_error_texts, meta_missing_tables, meta_mandatory_fields, meta_geometry_encoding, codelist_lookup, json_schema_fields, json_schema_parse_events, contract_violations,
        contract_violations_nested, contract_external_references, delivery_statements, sync_snapshot_orders, sync_merge_orders, sync_merge_null_keys,
    )
}

_PARTS = """select p_partkey, p_partkey as k, 't' || p_partkey as table_name, 's' || (p_partkey % 9) as schema_name, p_brand as eier,
    if(p_partkey % 7 = 0, null, p_type) as comment, if(p_partkey % 3 = 0, null, p_name) as tittel, if(p_partkey % 11 = 0, null, '') as emneord,
    ['http://publications.europa.eu/resource/authority/access-right/PUBLIC', 'PUBLIC', null][cast(p_partkey % 3 as int) + 1] as tilgangsnivaa,
    ['bronze', 'silver', 'gold', 'Gold', null][cast(p_partkey % 5 as int) + 1] as medaljongnivaa,
    ['https://example.org/codelist/a', 'a', null, 'https://example.org/codelist/b'][cast(p_partkey % 4 as int) + 1] as hovedkategori,
    if(p_partkey % 2 = 0, 'https://example.org/codelist/b', 'https://example.org/codelist/c') as begrep,
    ['https://register.geonorge.no/metadata-kodelister/sikkerhetsnivaa/unclassified', 'Ugradert', null][cast(p_partkey % 3 as int) + 1] as sikkerhetsnivaa from part"""
_RULES = """(values ('bronze', 1, 'tittel'), ('bronze', 2, 'beskrivelse'), ('bronze', 3, 'sikkerhetsnivaa'),
    ('silver', 1, 'tittel'), ('silver', 2, 'beskrivelse'), ('silver', 3, 'emneord'), ('silver', 4, 'begrep'), ('silver', 5, 'sikkerhetsnivaa'),
    ('gold', 1, 'tittel'), ('gold', 2, 'beskrivelse'), ('gold', 3, 'hovedkategori'), ('gold', 4, 'emneord'), ('gold', 5, 'begrep'), ('gold', 6, 'tilgangsnivaa'), ('gold', 7, 'sikkerhetsnivaa')) as r(tier, ord, for_field)"""
_BROKEN = f"""with t as ({_PARTS}), f as (
    select t.*, 'tittel' as for_field, 'string' as label, tittel is null as missing, 0 as n_values, null as first_id from t where tittel is null
    union all select t.*, 'beskrivelse', 'string', true, 0, null from t where comment is null
    union all select t.*, 'emneord', 'string', true, 0, null from t where emneord is null
    union all select t.*, 'hovedkategori', 'tematisk-hovedkategori', hovedkategori is null, 2, 'https://example.org/codelist/a' from t where k % 4 in (1, 2)
    union all select t.*, 'begrep', 'nasjonal-temainndeling', false, 2, 'https://example.org/codelist/a' from t where k % 2 = 1
    union all select t.*, 'tilgangsnivaa', 'tilgangsrestriksjoner', tilgangsnivaa is null, 3, 'http://publications.europa.eu/resource/authority/access-right/PUBLIC' from t where k % 3 > 0
    union all select t.*, 'sikkerhetsnivaa', 'sikkerhetsniva', sikkerhetsnivaa is null, 2, 'https://register.geonorge.no/metadata-kodelister/sikkerhetsnivaa/unclassified' from t where k % 3 > 0),
    e as (select f.*, r.ord from f join {_RULES} on r.tier = medaljongnivaa and r.for_field = f.for_field
    union all select t.*, 'medaljongnivaa', 'valør', medaljongnivaa is null, 3, 'bronze', 0 from t where k % 5 > 2)"""
_ENCODINGS = """select p_partkey as k, 'geom' as "column" from part where p_partkey % 5 = 2 and p_partkey % 4 in (2, 3) union all select p_partkey, 'area' from part where p_partkey % 5 = 2 and p_partkey % 6 = 0"""
_FIELD_ROWS = [
    ("k", "bigint", False, "#/properties/k", "a number"),
    ("kind", "string", True, "#/properties/kind", ""),
    ("where", "struct<x:double,tags:array<string>>", True, "#/properties/where", ""),
    ("where.x", "double", False, "#/properties/where/properties/x", ""),
    ("where.tags", "array<string>", True, "#/properties/where/properties/tags", ""),
    ("who", "struct<name:string>", True, "#/properties/who/$ref/#/$defs/person", ""),
    ("who.name", "string", True, "#/properties/who/$ref/#/$defs/person/properties/name", ""),
    ("lost", "string", True, "#/properties/lost/$ref/#/$defs/nobody", ""),
    ("when", "string", True, "#/properties/when", ""),
]

ORACLES = {
    "wkb_geom_type": f"select p_partkey, {_EXPECTED} as geom_type from part",
    "wkb_geom_type_hex": f"""select p_partkey, case when p_partkey % 7 = 6 then 'Invalid (too short)' when p_partkey % 7 = 5 or p_partkey % 50 = 0 then 'Invalid (null input)'
        when p_partkey % 7 > 2 then 'Invalid (not hex)' else {_EXPECTED} end as geom_type from part""",
    "sql_functions": f"""select p_partkey, {_EXPECTED} as geom_type, {_EXPECTED} as of_hex, '0101000000' as stripped, 'LineString' as linear, 'Invalid (null input)' as contours from part""",
    "wkb_type_histogram": f"select {_EXPECTED} as geom_type, count(*) as n from part group by 1",
    "wkb_strip_srid": """select s_suppkey, '0' || (s_suppkey % 3) || case when s_suppkey % 3 = 1
        then '0' || (1 + s_suppkey % 7) || '0000' || if(s_suppkey % 2 = 1, '80', '00') else if(s_suppkey % 2 = 1, '80', '00') || '00000' || (1 + s_suppkey % 7) end
        || upper(lpad(to_hex(s_suppkey), 32, '0')) as wkb_hex from supplier""",
    "curve_linearize": """with c as (select c_custkey, 1.0 + c_custkey % 10 as r, cast(c_custkey % 5 as int) as kind, [4, 6, 18, 45][cast(c_custkey % 4 as int) + 1] as half from customer),
        half as (select c_custkey, i, half, r, r + r * cos(pi() - pi() * i / half) as x, r * sin(pi() - pi() * i / half) as y from c, range(0, 46) as s(i) where i <= half and kind in (0, 1, 4)),
        v as (select h.c_custkey, i + if(kind = 4, 2, 0) as n, x, y from half h join c using (c_custkey)
            union all select c_custkey, half + 1, 3 * r, 5 from c where kind = 1
            union all select c_custkey, 0, 0, 0 from c where kind = 4 union all select c_custkey, 1, r, 1 from c where kind = 4
            union all select c_custkey, i, r + r * cos(pi() + pi() * i / half), r * sin(pi() + pi() * i / half) from c, range(0, 91) as s(i) where i <= 2 * half and kind in (2, 3))
        select c_custkey, ['LineString', 'LineString', 'Polygon', 'MultiPolygon', 'MultiLineString'][cast(c_custkey % 5 as int) + 1] as geom_type, cast(n as int) as n,
            cast(round(x, 6) as double) + 0.0 as x, cast(round(y, 6) as double) + 0.0 as y from v""",
    "contour_segments": """select n_nationkey, cast(l * 10 as double) as level, round((l * 10 - n_nationkey - 0.5) / 3.0, 6) as x1, cast(y as double) as y1,
        round((l * 10 - n_nationkey - 0.5) / 3.0, 6) as x2, cast(y + 1 as double) as y2
        from nation, range(0, 10) as r(l), range(0, 3) as s(y) where l * 10 > n_nationkey + 0.5 and l * 10 <= n_nationkey + 12.5""",
    "contours_wkb": """with l as (select n_nationkey, (l * 10 - n_nationkey - 0.5) / 3.0 + 0.5 as x, y from nation, range(0, 10) as r(l), range(0, 4) as s(y) where l * 10 > n_nationkey + 0.5 and l * 10 <= n_nationkey + 12.5)
        select n.n_nationkey, if(x is null, 'Invalid (null input)', 'MultiLineString') as geom_type, cast(round(x, 6) as double) as x, cast(-y - 0.5 as double) as y from nation n left join l on l.n_nationkey = n.n_nationkey""",
    "meta_tags_pivot": f"""select 'c' as catalog, schema_name as schema, table_name as "table", tittel, comment as beskrivelse, tilgangsnivaa, medaljongnivaa, hovedkategori,
        emneord, cast(null as varchar) as epsg_koder, begrep, sikkerhetsnivaa, eier, if(eier is null, 0, 1) as n_params from ({_PARTS})""",
    "meta_column_tags": """select 't' || p_partkey as table_name, c.column_name, t.tag_name, t.tag_value from part cross join (values ('id'), ('geom'), ('area')) as c(column_name)
        left join lateral (select * from (values ('geom', 'epsg', if(p_partkey % 4 = 0, null, '25835')),
            ('geom', 'geometri_encoding', ['WKB', 'GeoJson', 'shape', null][cast(p_partkey % 4 as int) + 1]), ('area', 'epsg', if(p_partkey % 6 = 0, '4326', null)))
            as v(column_name, tag_name, tag_value) where tag_value is not null and v.column_name = c.column_name) as t on true""",
    "meta_validate": f"{_BROKEN} select table_name, ord, for_field, if(missing, 'missing', 'invalid') as reason, n_values from e",
    "meta_error_texts": f"""{_BROKEN} select table_name, for_field, cast(null as varchar) as "column",
            'Field ' || chr(39) || for_field || chr(39) || ' is ' || if(missing, 'missing', 'invalid') || '; type <' || label || '>' || if(n_values > 0, '; one of the listed values', '') as description,
            if(for_field = 'beskrivelse', 'COMMENT ON TABLE c.' || schema_name || '.' || table_name || ' IS ' || chr(39) || '<BESKRIVELSE>' || chr(39),
                'ALTER TABLE c.' || schema_name || '.' || table_name || ' SET TAGS (' || chr(39) || for_field || chr(39) || ' = ' || chr(39) || '<' || upper(for_field) || '>' || chr(39) || ')') as solution, first_id from e
        union all select 't' || k, 'geometri_encoding', "column", 'Field ' || chr(39) || 'geometri_encoding' || chr(39) || ' is missing for column ' || "column" || '; type <geometri_encoding>; one of the listed values',
            'ALTER TABLE c.s' || (k % 9) || '.t' || k || ' SET TBLPROPERTIES (' || chr(39) || 'columns.' || "column" || '.geometri_encoding' || chr(39) || ' = ' || chr(39) || '<GEOMETRI_ENCODING>' || chr(39) || ')', 'wkt' from ({_ENCODINGS})""",
    "meta_missing_tables": """select 'c' as catalog, 's' || (p_partkey % 9) as schema, 'x' || p_partkey as table_name, 0 as ord, 'table' as for_field, 'missing' as reason,
        'Table c.s' || (p_partkey % 9) || '.x' || p_partkey || ' is missing from the catalogue' as description, 'CREATE TABLE c.s' || (p_partkey % 9) || '.x' || p_partkey as solution from part where p_partkey % 10 = 0""",
    "meta_mandatory_fields": f"select tier, ord, for_field, 'missing' as reason from {_RULES}",
    "meta_geometry_encoding": f"""select 't' || k as table_name, "column", 8 as ord from ({_ENCODINGS})""",
    "codelist_lookup": """select p_partkey, ['http://publications.europa.eu/resource/authority/access-right/PUBLIC', 'PUBLIC', null][cast(p_partkey % 3 as int) + 1] as value,
        p_partkey % 3 = 0 as known from part""",
    "json_schema_fields": "select * from (values " + ", ".join(f"('{n}', '{t}', {str(b).lower()}, '{p}', '{d}')" for n, t, b, p, d in _FIELD_ROWS) + ") as v(name, type, nullable, path, description)",
    "json_schema_parse_events": "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events",
    "contract_violations": "select event_id, 'user_id' as violation from events where event_id % 5 = 0 union all select event_id, 'event_type' from events where event_id % 3 = 0",
    "contract_violations_nested": """select event_id, 'list[].kind' as violation from events where event_id % 3 = 0
        union all select event_id, 'list[].deep.v' from events where event_id % 2 = 1 and event_id % 5 = 0 union all select event_id, 'grid[][].v' from events where event_id % 4 > 0 and event_id % 7 = 0""",
    "contract_external_references": """select * from (values ('who', 'struct<name:string>', true, '#/properties/who/file/http://base/people.json#/defs/person', ''),
        ('who.name', 'string', false, '#/properties/who/file/http://base/people.json#/defs/person/properties/name', 'said'),
        ('whole', 'bigint', true, '#/properties/whole/file/http://other/people.json', ''), ('n', 'string', true, '#/properties/n', '')) as v(name, type, nullable, path, description)""",
    "delivery_statements": """select * from (values ('snapshot', 0, 'TRUNCATE TABLE public.orders'),
        ('snapshot', 1, 'INSERT INTO public.orders ("id", "a""b", "geo m", "op") SELECT stage.orders."id", stage.orders."a""b", ST_GeomFromWKB(stage.orders."geo m", 25833), stage.orders."op" FROM stage.orders'),
        ('merge', 0, 'MERGE INTO public.orders USING stage.orders ON public.orders."id" = stage.orders."id" WHEN MATCHED AND stage.orders."op" = ''delete'' THEN DELETE'
            || ' WHEN MATCHED AND stage.orders."op" <> ''delete'' THEN UPDATE SET "a""b" = stage.orders."a""b", "geo m" = ST_GeomFromWKB(stage.orders."geo m", 25833)'
            || ' WHEN NOT MATCHED AND stage.orders."op" <> ''delete'' THEN INSERT ("id", "a""b", "geo m") VALUES (stage.orders."id", stage.orders."a""b", ST_GeomFromWKB(stage.orders."geo m", 25833))'),
        ('merge of keys only', 0, 'MERGE INTO public.orders USING stage.orders ON public.orders."id" = stage.orders."id" WHEN MATCHED AND stage.orders."op" = ''delete'' THEN DELETE'
            || ' WHEN NOT MATCHED AND stage.orders."op" <> ''delete'' THEN INSERT ("id") VALUES (stage.orders."id")')) as v(mode, n, statement)""",
    "sync_merge_null_keys": """with f as (select *, ['update', 'delete', null][cast(o_orderkey % 5 % 3 as int) + 1] as op from orders)
        select if(o_orderkey % 2 = 0, null, o_orderkey) as k, o_custkey as j, if(o_orderkey % 6 = 3 and op = 'update', -o_totalprice, o_totalprice) as o_totalprice, o_orderstatus from f
            where not (o_orderkey % 6 = 3 and coalesce(op, '') = 'delete')
        union all select if(o_orderkey % 3 > 0, null, o_orderkey), o_custkey, -o_totalprice, null from f where op = 'update' and o_orderkey % 6 <> 3""",
    "sync_snapshot_orders": "select o_orderkey, o_totalprice, 'update' as update_type from orders where o_orderstatus = 'F'",
    "sync_merge_orders": """select o_orderkey, if(o_orderkey % 6 = 1, o_totalprice + 1, o_totalprice) as o_totalprice, o_orderstatus from orders where o_orderkey % 6 > 0
        union all select o_orderkey + 1000000000, o_totalprice + 1, null from orders where o_orderkey % 6 = 3""",
}
