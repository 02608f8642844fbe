"""WKB and EWKB headers as native expressions: geometry type names, hex text, and removal of the SRID.

Each function takes the SQL of a column or expression and returns a Column; the same SQL text becomes the body of the
temporary SQL functions, so callers from SQL stay inside whole-stage code generation too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoledger.names import unused

# The geometry type codes of the WKB standard and of its SQL/MM extensions.
TYPE_NAMES = {
    0: "Geometry",
    1: "Point",
    2: "LineString",
    3: "Polygon",
    4: "MultiPoint",
    5: "MultiLineString",
    6: "MultiPolygon",
    7: "GeometryCollection",
    8: "CircularString",
    9: "CompoundCurve",
    10: "CurvePolygon",
    11: "MultiCurve",
    12: "MultiSurface",
    13: "Curve",
    14: "Surface",
    15: "PolyhedralSurface",
    16: "TIN",
    17: "Triangle",
    18: "Circle",
    19: "GeodesicString",
    20: "EllipticalCurve",
    21: "NurbsCurve",
    22: "Clothoid",
    23: "SpiralCurve",
    24: "CompoundSurface",
    102: "AffinePlacement",
    1025: "BrepSolid",
}
# The flag bits of the extended format.
Z_FLAG, M_FLAG, SRID_FLAG = 0x80000000, 0x40000000, 0x20000000
FLAGS = Z_FLAG | M_FLAG | SRID_FLAG

NULL_INPUT, NOT_HEX, TOO_SHORT = "Invalid (null input)", "Invalid (not hex)", "Invalid (too short)"
_HEX_TEXT = r"^\\s*([0-9A-Fa-f]{2}\\s*)*$"
#: What a value of a column type is called in the message about unsupported types.
_PYTHON_NAMES = {
    T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int", T.FloatType: "float", T.DoubleType: "float",
    T.BooleanType: "bool", T.DecimalType: "Decimal", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.DateType: "date",
    T.ArrayType: "list", T.MapType: "dict", T.StructType: "Row",
}


def _bound(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` standing for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _code(wkb: str, big: str) -> str:
    """SQL of the 32-bit type code: bytes 2 to 5, most significant first if ``big`` holds."""
    part = lambda k: f"hex(substring({wkb}, {k}, 1))"
    swapped = ", ".join(part(k) for k in (5, 4, 3, 2))
    return f"cast(conv(if({big}, hex(substring({wkb}, 2, 4)), concat({swapped})), 16, 10) as bigint)"


def _named(base: str) -> str:
    dense = [TYPE_NAMES[k] for k in range(len(TYPE_NAMES)) if k in TYPE_NAMES]
    rest = " ".join(f"when {base} = {k} then '{v}'" for k, v in TYPE_NAMES.items() if k >= len(dense))
    listed = ", ".join(f"'{v}'" for v in dense)
    return f"case when {base} < {len(dense)} then element_at(array({listed}), cast({base} + 1 as int)) {rest} else concat('Unknown(', {base}, ')') end"


def _base(code: str) -> str:
    """SQL of the base type of a type code."""
    return f"if(({code} & {FLAGS}L) != 0, {code} & {2**32 - 1 - FLAGS}L, if({code} between 1000 and 3999, {code} % 1000, {code}))"


def _dims(code: str) -> str:
    """SQL of the dimensions of a type code: bits 1 and 2 are M and Z, the flags' own or what a plain code's thousands stand for."""
    thousands = f"if({code} between 1000 and 3999, element_at(array(2L, 1L, 3L), cast({code} div 1000 as int)), 0L)"
    return f"if(({code} & {FLAGS}L) != 0, shiftright({code}, 30) & 3, {thousands})"


def _checked(wkb: str, named: str) -> str:
    return f"case when {wkb} is null then '{NULL_INPUT}' when octet_length({wkb}) < 5 then '{TOO_SHORT}' else {named} end"


def _type_name(base: str, dims: str) -> str:
    return f"concat({_named(base)}, element_at(array('', ' M', ' Z', ' ZM'), cast({dims} + 1 as int)))"


def _type_code(wkb: str) -> str:
    return _code(wkb, f"substring({wkb}, 1, 1) = x'00'")


def geometry_type_sql(wkb: str) -> str:
    return _checked(wkb, _bound(_type_code(wkb), "code", _bound(f"struct({_base('code')} as base, {_dims('code')} as dims)", "t", _type_name("t.base", "t.dims"))))


def geometry_type_hex_sql(text: str) -> str:
    decoded = f"unhex(regexp_replace({text}, '\\\\s', ''))"
    return f"case when {text} is null then '{NULL_INPUT}' when not rlike({text}, '{_HEX_TEXT}') then '{NOT_HEX}' else {_bound(decoded, 'w', geometry_type_sql('w'))} end"


def strip_srid_sql(wkb: str) -> str:
    big = f"hex(substring({wkb}, 1, 1)) != '01'"
    code = _code(wkb, big)
    plain = f"lpad(hex({code} & {2**32 - 1 - SRID_FLAG}L), 8, '0')"
    swapped = ", ".join(f"substring({plain}, {k}, 2)" for k in (7, 5, 3, 1))
    stripped = f"unhex(concat(hex(substring({wkb}, 1, 1)), if({big}, {plain}, concat({swapped})), hex(substring({wkb}, 10))))"
    return f"case when octet_length({wkb}) >= 9 and ({code} & {SRID_FLAG}L) != 0 then {stripped} else {wkb} end"


def geometry_type(wkb: str) -> Column:
    """The type's name with its dimensions. Null and short values give a message; an order byte other than 0 is little-endian."""
    return F.expr(geometry_type_sql(wkb))


def with_geometry_type(df: DataFrame, column: str, out: str = "geom_type") -> DataFrame:
    """df with the type's name of a binary column in ``out``: the same as geometry_type, in steps that are all generated code."""
    own = [f"`{c}`" for c in df.columns if c != out]
    return _stepwise(df, f"`{column}`").selectExpr(*own, f"{_checked(f'`{column}`', _type_name(*_helpers(df)[1:]))} as `{out}`")


def _helpers(df: DataFrame) -> list[str]:
    return [unused(df.columns, name) for name in ("wkb_code", "wkb_base", "wkb_dims")]


def _stepwise(df: DataFrame, wkb: str) -> DataFrame:
    """df with the code, the base type and the dimensions of a binary column in helper columns."""
    code, base, dims = _helpers(df)
    return df.selectExpr("*", f"{_type_code(wkb)} as {code}").selectExpr("*", f"{_base(code)} as {base}", f"{_dims(code)} as {dims}")


def with_geometry_type_hex(df: DataFrame, column: str, out: str = "geom_type") -> DataFrame:
    """The same for a column of hex text: the same as geometry_type_hex, in steps that are all generated code."""
    text, wkb = f"`{column}`", unused(df.columns, "wkb_bytes")
    own = [f"`{c}`" for c in df.columns if c != out]
    bytes_ = df.selectExpr("*", f"if(rlike({text}, '{_HEX_TEXT}'), unhex(regexp_replace({text}, '\\\\s', '')), null) as {wkb}")
    named = f"case when octet_length({wkb}) < 5 then '{TOO_SHORT}' else {_type_name(*_helpers(bytes_)[1:])} end"
    return _stepwise(bytes_, wkb).selectExpr(*own, f"case when {text} is null then '{NULL_INPUT}' when {wkb} is null then '{NOT_HEX}' else {named} end as `{out}`")


def geometry_type_hex(text: str) -> Column:
    """The same for hex text, in which white space may stand between bytes."""
    return F.expr(geometry_type_hex_sql(text))


def strip_srid(wkb: str) -> Column:
    """EWKB without its outermost SRID, byte order and dimension flags kept; other values as they are, null stays null.

    Here an order byte other than 1 is big-endian, as in the conversion of curves.
    """
    return F.expr(strip_srid_sql(wkb))


def inspect(df: DataFrame, column: str) -> Column:
    """The type inspector for a column of any kind: binary, hex text, or a message that names what it holds instead."""
    kind, quoted = df.schema[column].dataType, f"`{column}`"
    if isinstance(kind, T.BinaryType):
        return geometry_type(quoted)
    if isinstance(kind, T.StringType):
        return geometry_type_hex(quoted)
    if isinstance(kind, T.NullType):
        return F.lit(NULL_INPUT)
    name = _PYTHON_NAMES.get(type(kind), kind.typeName())
    return F.when(F.col(quoted).isNull(), NULL_INPUT).otherwise(f"Invalid (unsupported type: {name})")
