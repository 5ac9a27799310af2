"""Datasets, and statements about whole tables: identity, scope, references, counts, latest rows, hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

IDENTITY = ("system", "country", "version", "revision", "edition", "language")


def same_identity(left: DataFrame, right: DataFrame, keys: Sequence[str] = IDENTITY) -> Column:
    """Condition: all identity columns equal, null equal to null."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """The rows whose identity the table does not have."""
    return rows.join(table, same_identity(rows, table, keys), "left_anti")


def repeated_identities(table: DataFrame, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """Identities, nulls alike, that more than one row has."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def list_datasets(table: DataFrame, system: str | None = None, country: str | None = None, version: str | None = None, language: str | None = None, statuses: Sequence[str] = (), limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Datasets by case-insensitive system and country and by exact version, language and status; newest version first."""
    for name, value in (("system", system), ("country", country)):
        if value is not None:
            table = table.where(F.upper(name) == value.upper())
    for name, value in (("version", version), ("language", language)):
        if value is not None:
            table = table.where(F.col(name) == value)
    if statuses:
        table = table.where(F.col("status").isin(*statuses))
    table = table.orderBy(F.asc_nulls_last("system"), F.desc_nulls_first("version"), "id").offset(offset)
    return table if limit is None else table.limit(limit)


def unresolved(rows: DataFrame, key: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows whose non-null key is no target."""
    return rows.where(F.col(key).isNotNull()).join(targets.select(F.col(target).alias(key)).distinct(), key, "left_anti")


def latest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group in an order that is total."""
    return rows.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def first_of_hash(rows: DataFrame, column: str, key: str) -> DataFrame:
    """``content_hash``, the smallest key with it and the number of rows; only hashes are shuffled."""
    hashed = rows.select(key, text.content_hash(F.coalesce(F.col(column), F.lit(""))).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("n_copies"))


def changed(rows: DataFrame, stored: DataFrame, key: str, identity: Column, known: str = "identity_hash") -> DataFrame:
    """Rows whose identity hash is not the stored one of their key: what an incremental run has to do."""
    hashed = rows.withColumn(known, identity)
    return hashed.join(stored.select(key, known).distinct(), [key, known], "left_anti")


def coverage(rows: DataFrame, keys: Sequence[str], tests: Mapping[str, Column]) -> DataFrame:
    """By keys the number of rows, and of those that pass each test."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *(F.sum(F.coalesce(t, F.lit(False)).cast("long")).alias(n) for n, t in tests.items()))


def conflicting(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Groups with more than one value, with the values in order."""
    found = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("values"))
    return found.where(F.size("values") > 1)


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Name and number of rows of each table."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def version_diff(old: DataFrame, new: DataFrame, key: str = "code", compared: Sequence[str] = ("title",)) -> DataFrame:
    """``key`` and ``change`` (added, removed or changed) between two versions."""
    a = old.select(F.col(key).alias("_ka"), *(F.col(c).alias(f"a_{c}") for c in compared))
    b = new.select(F.col(key).alias("_kb"), *(F.col(c).alias(f"b_{c}") for c in compared))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    change = F.when(F.col("_ka").isNull(), "added").when(F.col("_kb").isNull(), "removed").when(~same, "changed")
    return a.join(b, F.col("_ka") == F.col("_kb"), "full_outer").select(F.coalesce("_ka", "_kb").alias(key), change.alias("change")).where("change is not null")


def systems(datasets: DataFrame, system: str = "system") -> DataFrame:
    """The distinct systems."""
    return datasets.select(system).distinct()


def get_many(rows: DataFrame, ids: DataFrame, key: str = "node_id") -> DataFrame:
    """The rows whose key is among ``ids``."""
    return rows.join(ids.select(key), key, "left_semi")
