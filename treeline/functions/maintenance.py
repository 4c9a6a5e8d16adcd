"""Data maintenance on immutable tables: each operation returns the table's new version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def update_in_place(table: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Slowly changing dimension, type 1: values of `columns` replaced where updates (unique in key) has one that is not NULL; new keys added."""
    new = updates.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns))
    changed = table.join(new, F.col(key) == F.col("_k"), "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns))
    added = updates.join(table.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    return changed.unionByName(added, allowMissingColumns=True)


def close_and_insert(table: DataFrame, updates: DataFrame, key: str, start: str, end: str, at: Column) -> DataFrame:
    """Slowly changing dimension, type 2: open rows (end is NULL) of an updated key end at `at`; the update's begin then."""
    keys = updates.select(F.col(key).alias("_k")).distinct()
    marked = table.join(keys, F.col(key) == F.col("_k"), "left")
    closed = marked.withColumn(end, F.when(F.col("_k").isNotNull() & F.col(end).isNull(), at).otherwise(F.col(end))).drop("_k")
    fresh = updates.withColumn(start, at).withColumn(end, F.lit(None).cast(table.schema[end].dataType))
    return closed.unionByName(fresh.select(*table.columns))


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """A refresh's insert set added."""
    return table.unionByName(rows)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a refresh's delete set taken out."""
    return table.join(keys.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def without_duplicates(table: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row a key."""
    return table.dropDuplicates(list(key))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Referential integrity: rows of child whose key is not NULL and not in parent."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("_k")), F.col(child_key) == F.col("_k"), "left_anti")


def template(sql: str, **values) -> str:
    """Query text with [NAME] substitutions, each of them given."""
    for k, v in values.items():
        sql = sql.replace(f"[{k.upper()}]", str(v))
    if "[" in sql and (left := [w.split("]")[0] for w in sql.split("[")[1:] if w.split("]")[0].isupper()]):
        raise ValueError(f"no value for {', '.join(left)}")
    return sql
