"""Upsert by key, expressed as joins over immutable frames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from saleskiln.functions.text import ColumnOrName, as_column
from saleskiln.operators.dedup import free_name

INSERTED, UPDATED, KEPT = "inserted", "updated", "kept"


@dataclass(frozen=True)
class UpsertRule:
    """What an upsert writes.

    Every column the source shares with the target is written on insert. On update the ``keys`` and the
    ``insert_only`` columns keep their target value, all others take the source value, NULL included.
    ``touch`` is set to the update time on update and left NULL on insert.
    """

    keys: tuple[str, ...]
    insert_only: tuple[str, ...] = ()
    touch: str | None = None

    def check(self, target: Sequence[str], source: Sequence[str]) -> None:
        surplus = [name for name in source if name not in target or name == self.touch]
        missing = [name for name in self.keys if name not in source or name not in target]
        if surplus or missing:
            raise ValueError(f"columns the target cannot take: {surplus}, missing keys: {missing}")

    def updated_columns(self, source: Sequence[str]) -> list[str]:
        fixed = {*self.keys, *self.insert_only, self.touch}
        return [name for name in source if name not in fixed]


def update_time(now: ColumnOrName | None) -> Column:
    return F.current_timestamp() if now is None else as_column(now)


def as_stored(value: Column, target: DataFrame, name: str) -> Column:
    """``value`` in the type of the target's column, in every form of the upsert: a batch of another width never changes
    a stored type. Under ANSI a value that does not fit fails the job."""
    return value.cast(target.schema[name].dataType).alias(name)


def upsert(target: DataFrame, source: DataFrame, rule: UpsertRule, now: ColumnOrName | None = None) -> DataFrame:
    """Target after the upsert, plus ``merge_action``: one full outer join on the key.

    The source holds at most one row per key. Keys are unique on both sides, so no key is hot; NULL keys
    match nothing and are therefore inserted.
    """
    rule.check(target.columns, source.columns)
    was, now_in = free_name(target, "in_target"), free_name(source, "in_source")
    old = target.withColumn(was, F.lit(True)).alias("old")
    new = source.withColumn(now_in, F.lit(True)).alias("new")
    same_key = [F.col(f"old.{key}") == F.col(f"new.{key}") for key in rule.keys]
    joined = old.join(new, same_key, "full")

    is_new, is_old = F.col(f"new.{now_in}").isNotNull(), F.col(f"old.{was}").isNotNull()
    updated = set(rule.updated_columns(source.columns))

    def value(name: str) -> Column:
        before = F.col(f"old.{name}")
        if name == rule.touch:
            return F.when(is_new & is_old, update_time(now)).otherwise(before)
        if name not in source.columns:
            return before
        after = F.col(f"new.{name}")
        return F.when(is_new, after).otherwise(before) if name in updated else F.when(is_old, before).otherwise(after)

    action = F.when(~is_new, KEPT).when(is_old, UPDATED).otherwise(INSERTED)
    return joined.select(*[as_stored(value(name), target, name) for name in target.columns], action.alias("merge_action"))


def upsert_small_batch(target: DataFrame, source: DataFrame, rule: UpsertRule, now: ColumnOrName | None = None) -> DataFrame:
    """Same rows as ``upsert`` for a source that is small next to the target.

    A full outer join can never broadcast. A left join of the target can: the target is then rewritten
    task by task without a shuffle, and a second, key-only scan of it finds the source rows to insert. A
    caller that has checked the size of the source hints the broadcast; otherwise Spark decides by its own
    threshold and shuffles above it, with the same rows.
    """
    rule.check(target.columns, source.columns)
    keys = list(rule.keys)
    now_in = free_name(source, "in_source")
    new = source.withColumn(now_in, F.lit(True)).alias("new")
    same_key = [F.col(f"old.{key}") == F.col(f"new.{key}") for key in keys]
    hit = F.col(f"new.{now_in}").isNotNull()
    updated = set(rule.updated_columns(source.columns))

    def value(name: str) -> Column:
        before = F.col(f"old.{name}")
        if name == rule.touch:
            return F.when(hit, update_time(now)).otherwise(before)
        return F.when(hit, F.col(f"new.{name}")).otherwise(before) if name in updated else before

    rewritten = target.alias("old").join(new, same_key, "left").select(
        *[as_stored(value(name), target, name) for name in target.columns],
        F.when(hit, UPDATED).otherwise(KEPT).alias("merge_action"),
    )
    present = target.select(keys).join(source.select(keys), keys, "left_semi")
    inserted = source.join(present, keys, "left_anti").select(
        *[as_stored(F.col(name) if name in source.columns else F.lit(None), target, name) for name in target.columns],
        F.lit(INSERTED).alias("merge_action"),
    )
    return rewritten.unionByName(inserted)


def insert_all(target: DataFrame, source: DataFrame, rule: UpsertRule) -> DataFrame:
    """Upsert into a target without rows: a projection, no join."""
    rule.check(target.columns, source.columns)
    return source.select(
        *[as_stored(F.col(name) if name in source.columns else F.lit(None), target, name) for name in target.columns]
    )


def merge_metrics(merged: DataFrame) -> DataFrame:
    """One row counted from ``merge_action``: inserted, updated, kept and source rows."""

    def rows(action: str) -> Column:
        return F.count_if(F.col("merge_action") == action)

    return merged.agg(
        rows(INSERTED).alias("rows_inserted"),
        rows(UPDATED).alias("rows_updated"),
        rows(KEPT).alias("rows_kept"),
        F.count_if(F.col("merge_action") != KEPT).alias("source_rows"),
    )
