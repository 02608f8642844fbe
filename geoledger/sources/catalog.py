"""Where table metadata comes from: tag, comment, column and column-tag relations of a whole catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_KEYS = ["catalog_name", "schema_name", "table_name"]
COLUMN_KEYS = [*TABLE_KEYS, "column_name"]


@dataclass(frozen=True)
class Catalog:
    """Relations of a catalogue.

    tags: TABLE_KEYS, tag_name, tag_value. tables: table_catalog, table_schema, table_name, comment. columns:
    table_catalog, table_schema, table_name, column_name and more. column_tags: COLUMN_KEYS, tag_name, tag_value.
    """

    tags: DataFrame
    tables: DataFrame
    columns: DataFrame | None = None
    column_tags: DataFrame | None = None

    def only(self, catalog: str, schema: str, table: str) -> Catalog:
        """The same relations of one table; the predicates reach the scans."""

        def own(df: DataFrame | None, a: str, b: str, c: str) -> DataFrame | None:
            return df if df is None else df.where((F.col(a) == catalog) & (F.col(b) == schema) & (F.col(c) == table))

        named = ("table_catalog", "table_schema", "table_name")
        return Catalog(own(self.tags, *TABLE_KEYS), own(self.tables, *named), own(self.columns, *named), own(self.column_tags, *TABLE_KEYS))


def information_schema(spark: SparkSession, root: str = "system.information_schema") -> Catalog:
    """Relations of a catalogue that has an information schema with tags."""
    read = lambda name: spark.table(f"{root}.{name}")
    return Catalog(read("table_tags"), read("tables"), read("columns"), read("column_tags"))


def session_catalog(spark: SparkSession, database: str = "default") -> Catalog:
    """Relations of an open-source session's catalogue: comments, and table properties in place of tags.

    A property ``columns.<column>.<tag>`` is a tag of that column.
    """
    tables, tags, columns, column_tags = [], [], [], []
    catalog = spark.catalog.currentCatalog()
    for t in spark.catalog.listTables(database):
        if t.isTemporary:
            continue
        tables.append((catalog, database, t.name, t.description))
        for row in spark.sql(f"show tblproperties `{database}`.`{t.name}`").collect():  # a table's properties: a few rows
            place = row["key"].split(".")
            if len(place) == 3 and place[0] == "columns":
                column_tags.append((catalog, database, t.name, place[1], place[2], row["value"]))
            else:
                tags.append((catalog, database, t.name, row["key"], row["value"]))
        columns += [(catalog, database, t.name, c.name) for c in spark.catalog.listColumns(f"{database}.{t.name}")]
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    named = ["table_catalog", "table_schema", "table_name"]
    return Catalog(
        frame(tags, [*TABLE_KEYS, "tag_name", "tag_value"]),
        frame(tables, [*named, "comment"]),
        frame(columns, [*named, "column_name"]),
        frame(column_tags, [*COLUMN_KEYS, "tag_name", "tag_value"]),
    )

