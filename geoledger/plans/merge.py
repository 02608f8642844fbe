"""Delivery as logical plans: a full snapshot, or a merge of updates and deletes, from a feed into a target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATION = "update_type"
DELETE = "delete"
#: What the operation is called beside a feed's columns of any name.
OPERATION_FIELD = "(operation)"


def plan_snapshot(feed: DataFrame, target_columns: list[str] | None = None) -> DataFrame:
    """What the target becomes: the feed's columns, the operation column too if it is there, in the target's order."""
    return feed.select(*(F.col(f"`{c}`") for c in target_columns or feed.columns))


def duplicate_keys(feed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a feed has more than once, which a merge can't order."""
    named = [F.col(f"`{k}`") for k in keys]
    present = feed.select(*named).dropna(how="any")
    return present.groupBy(*named).count().where("count > 1")


def _whole(keys: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(f"`{k}`").isNotNull() for k in keys))


def _one_each(feed: DataFrame, keys: list[str], names: list[str], operation: str) -> DataFrame:
    """(keys, change) of the feed's rows with whole keys: one row each, and an error on running if a key is there twice."""
    change = F.struct(*(F.col(f"`{c}`") for c in names), F.col(f"`{operation}`").alias(OPERATION_FIELD))
    grouped = feed.where(_whole(keys)).groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.first(change).alias("change"), F.count("*").alias("n"))
    twice = F.raise_error(F.concat(F.lit("the feed has a key more than once: "), F.to_json(F.struct(*(F.col(f"`{k}`") for k in keys)))))
    return grouped.select(*(F.col(f"`{k}`") for k in keys), F.when(F.col("n") > 1, twice.cast("boolean")).otherwise(True).alias("single"), "change").where("single").drop("single")


def plan_merge(target: DataFrame, feed: DataFrame, keys: list[str], operation: str = OPERATION) -> DataFrame:
    """The target after the feed's rows: matched rows are deleted or updated, unmatched ones inserted.

    'delete' deletes, null does nothing, anything else updates or inserts; an unmatched delete does nothing. Keys match by
    plain equality, so a null key never does and its row is inserted. Target columns that the feed lacks keep their value
    on a match and are null on an insert. A key that the feed has twice is an error when the plan runs.

    The target meets the feed in a left join, which leaves it where it is if the feed's measured size allows a broadcast
    and splits skew otherwise; feed rows are inserts if the target's keys, looked up in the feed, don't hold theirs. Rows
    with a null key on either side meet nothing and are only added.
    """
    if not keys:
        raise ValueError("a merge needs keys")
    named = [c for c in feed.columns if c != operation]
    changes = _one_each(feed, keys, named, operation)
    quoted = [F.col(f"`{k}`") for k in keys]
    t = target.select(F.struct(*(F.col(f"`{c}`") for c in target.columns)).alias("t"), *(F.col(f"`{k}`").alias(f"key {k}") for k in keys))
    c = changes.select("change", *(F.col(f"`{k}`").alias(f"feed {k}") for k in keys))
    met = t.where(_whole([f"key {k}" for k in keys])).join(c, [F.col(f"`key {k}`") == F.col(f"`feed {k}`") for k in keys], "left")
    op = F.col(f"change.`{OPERATION_FIELD}`")
    kept = met.where(op.isNull() | (op != DELETE))
    value = lambda n: F.when(op.isNotNull(), F.col(f"change.`{n}`")).otherwise(F.col(f"t.`{n}`")) if n in named and n not in keys else F.col(f"t.`{n}`")
    kept = kept.select(*(value(n).alias(n) for n in target.columns))

    found = target.select(*quoted).where(_whole(keys)).join(changes.select(*quoted), keys, "left_semi").distinct()
    new = changes.where(op.isNotNull() & (op != DELETE)).join(found, keys, "left_anti").select("change.*").drop(OPERATION_FIELD)
    loose = feed.where(~_whole(keys) & F.col(f"`{operation}`").isNotNull() & (F.col(f"`{operation}`") != DELETE))
    kinds = {f.name: f.dataType for f in target.schema}
    fitted = lambda df: df.select(*((F.col(f"`{n}`") if n in named else F.lit(None)).cast(kinds[n]).alias(n) for n in target.columns))
    return kept.unionByName(target.where(~_whole(keys))).unionByName(fitted(new)).unionByName(fitted(loose))


def merge_into(feed: DataFrame, table: str, keys: list[str], operation: str = OPERATION) -> None:
    """The same merge by the table itself, for catalogues whose tables take row-level changes."""
    if not keys:
        raise ValueError("a merge needs keys")
    names = [c for c in feed.columns if c != operation]
    op, alias = F.col(f"feed.`{operation}`"), feed.alias("feed")
    sets = {f"`{c}`": F.col(f"feed.`{c}`") for c in names}
    on = reduce(Column.__and__, (F.col(f"{table}.`{k}`") == F.col(f"feed.`{k}`") for k in keys))
    merge = alias.mergeInto(table, on).whenMatched(op == DELETE).delete()
    if update := {f"`{c}`": F.col(f"feed.`{c}`") for c in names if c not in keys}:
        merge = merge.whenMatched(op != DELETE).update(update)
    merge.whenNotMatched(op != DELETE).insert(sets).merge()
