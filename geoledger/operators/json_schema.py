"""JSON Schema contracts as Spark schemas, and the rows that break what a schema alone doesn't enforce."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATOMIC = {
    "string": T.StringType(), "number": T.DoubleType(), "float": T.FloatType(), "integer": T.LongType(), "boolean": T.BooleanType(),
    "decimal": T.DecimalType(), "timestamp": T.TimestampType(), "date": T.DateType(),
}
#: Types that a node may name; the others can only be the default type.
NAMED = {"string", "number", "float", "integer", "boolean"}
Resolver = Callable[[str], dict]


def http_resolver(url: str) -> dict:
    """Fetches an external schema. Opt-in."""
    with urllib.request.urlopen(url, timeout=30) as answer:
        if answer.status != 200:
            raise ValueError(f"{url} answered {answer.status} instead of a schema")
        return json.load(answer)


class Contract:
    """A JSON Schema document on its way to a StructType.

    strict=False keeps the usual converter's conventions: a field is nullable unless it is required, but with
    enforce_required_field=False every field of an object that has a ``required`` list is non-nullable; and a local
    reference's nullability comes from its target's own list. strict=True makes nothing non-nullable when requirements
    aren't enforced, and takes a reference's nullability from the object that refers.

    circular_references has no effect but for the entry "#", the document itself, which makes every field that is neither
    a constant nor a reference a string.
    """

    def __init__(self, document: dict, enforce_required_field: bool = True, default_type: str = "string", defs_location: str = "$def",
                 external_ref_base_uri: str = "", circular_references: list[str] | None = None, resolver: Resolver | None = None, strict: bool = False):
        self._root, self._enforce, self._strict = document, enforce_required_field, strict
        self._default = ATOMIC.get(default_type, T.StringType())
        self._base, self._resolver, self._fetched = external_ref_base_uri, resolver, {}
        self._open: list[str] = []
        self._flat = "#" in (circular_references or [])
        del defs_location  # accepted and without effect

    def schema(self) -> T.StructType:
        if not self._root.get("properties"):
            raise ValueError("the schema has no properties")
        return self._object(self._root, "#")

    def _object(self, node: dict, path: str) -> T.StructType:
        required = node.get("required")
        fields = (self._field(name, child, required, f"{path}/properties/{name}") for name, child in node.get("properties", {}).items())
        return T.StructType([f for f in fields if f is not None])

    def _nullable(self, name: str, required: list | None) -> bool:
        if required is None or (self._strict and not self._enforce):
            return True
        return name not in required and self._enforce

    def _field(self, name: str, node: dict, required: list | None, path: str) -> T.StructField | None:
        if "const" in node:
            return None
        if "$ref" in node:
            return self._reference(name, node["$ref"], required, path)
        kind = self._type(node, path)
        return T.StructField(name, kind, self._nullable(name, required), {"path": path, "description": node.get("description", "")})

    def _type(self, node: dict, path: str) -> T.DataType:
        kind = node.get("type")
        if "enum" in node or self._flat:
            return T.StringType()
        if isinstance(kind, str) and kind in NAMED:
            return ATOMIC[kind]
        if kind == "object":
            return self._object(node, path)
        if kind == "array":
            items = node.get("items")
            element = self._field("item", items, None, f"{path}/items") if isinstance(items, dict) else None
            return T.ArrayType(element.dataType if element else self._default, True)
        return self._default

    @staticmethod
    def _walk(document: dict, fragment: str) -> dict:
        at = document
        for key in filter(None, fragment.split("/")):
            at = at.get(key, {}) if isinstance(at, dict) else {}
        return at if isinstance(at, dict) else {}

    def _reference(self, name: str, ref: str, required: list | None, path: str) -> T.StructField | None:
        if ref in self._open:
            raise ValueError(f"the reference {ref} at {path} leads back to itself")
        self._open.append(ref)
        try:
            if ref.startswith("#"):
                node = self._walk(self._root, ref[1:])
                return self._field(name, node, required if self._strict else node.get("required"), f"{path}/$ref/{ref}")
            full = ref if ref.startswith("http") else f"{self._base}/{ref}"
            url, _, fragment = full.partition("#")
            if url not in self._fetched:
                if self._resolver is None:
                    raise ValueError(f"no resolver for the external reference {url}")
                self._fetched[url] = self._resolver(url)
            return self._field(name, self._walk(self._fetched[url], fragment), None, f"{path}/file/{full}")
        finally:
            self._open.pop()


def convert_json_schema_to_spark(document: dict, enforce_required_field: bool = True, default_type: str = "string", defs_location: str = "$def", **more) -> T.StructType:
    return Contract(document, enforce_required_field, default_type, defs_location, **more).schema()


def fields(schema: T.StructType, prefix: str = "") -> list[tuple[str, str, bool, str, str]]:
    """(name, type, nullable, path, description) of every field, nested ones after their parent."""
    out = []
    for f in schema:
        name = f"{prefix}{f.name}"
        out.append((name, f.dataType.simpleString(), f.nullable, f.metadata.get("path", ""), f.metadata.get("description", "")))
        kind, inner = f.dataType, f"{name}."
        while isinstance(kind, T.ArrayType):
            kind, inner = kind.elementType, f"{inner[:-1]}[]."
        if isinstance(kind, T.StructType):
            out += fields(kind, inner)
    return out


Check = Callable[[Column], Column]


def _checks(kind: T.DataType, name: str) -> list[tuple[str, Check]]:
    """(path, condition on a value of this type that isn't null) of every required field below it, at any depth."""
    if isinstance(kind, T.StructType):
        return [found for f in kind for found in _field_checks(f.name, f.dataType, f.nullable, f"{name}.{f.name}")]
    if not isinstance(kind, T.ArrayType):
        return []
    inside = _checks(kind.elementType, f"{name}[]")
    every = [(path, lambda v, c=c: F.exists(v, lambda e: e.isNotNull() & c(e))) for path, c in inside]
    return every if kind.containsNull else [(f"{name}[]", lambda v: F.exists(v, lambda e: e.isNull())), *every]


def _field_checks(field: str, kind: T.DataType, nullable: bool, path: str) -> list[tuple[str, Check]]:
    """The same for one field of a struct."""
    own = [] if nullable else [(path, lambda v: v[field].isNull())]
    return own + [(p, lambda v, c=c: v[field].isNotNull() & c(v[field])) for p, c in _checks(kind, path)]


def contract_violations(df: DataFrame, schema: T.StructType, keys: list[str]) -> DataFrame:
    """keys and ``violation``: a row for each required field that a row lacks. Readers make every field nullable, so this is where requirements hold."""
    checks = []
    for f in schema:
        value = F.col(f"`{f.name}`")
        checks += [] if f.nullable else [(f.name, value.isNull())]
        checks += [(path, value.isNotNull() & c(value)) for path, c in _checks(f.dataType, f.name)]
    none = F.array().cast("array<string>")
    found = reduce(F.concat, [F.when(c, F.array(F.lit(n))).otherwise(none) for n, c in checks], none)
    return df.select(*(F.col(f"`{k}`") for k in keys), F.explode(found).alias("violation"))
