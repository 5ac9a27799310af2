"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard draws a number from (0, 1) for each key; its score is ``-weight / ln(number)`` and the
highest score wins, the lower shard on a tie.  A shard that is added changes no other's score, so
it takes rows only into itself, and a shard gets rows in proportion to its weight.

Slots number the rows of a shard without gaps.  They are dealt in two steps, so that no task ever
holds a whole shard: counts by shard and key bucket give each bucket its first slot, and rows are
numbered within their bucket only.

Defined cases: a null key is a key like any other; rows with equal keys share a shard and get
different slots; a null text has size 8 and checksum 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a shard that are numbered together, about, and the most buckets of a shard; their product over
#: all shards bounds the table of first slots, which is broadcast (24 shards: under 100,000 rows).
BUCKET_ROWS = 5_000
MAX_BUCKETS = 4_096


def scores(key: Column, weights: Sequence[float]) -> Column:
    """Array of the shards' scores for a key."""

    def score(shard: int, weight: float) -> Column:
        drawn = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.lit(-float(weight)) / F.log(drawn)

    return F.array(*(score(i, w) for i, w in enumerate(weights)))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that wins a key."""
    held = F.transform(F.array(scores(key, weights)), lambda s: F.array_position(s, F.array_max(s)) - 1)
    return held[0].cast("int")


def with_slots(rows: DataFrame, key: str, shard: str, n_shards: int, order: Sequence[str], n_rows: int) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard.  ``n_rows``: about how many rows there are."""
    buckets = min(MAX_BUCKETS, max(1, math.ceil(n_rows / n_shards / BUCKET_ROWS)))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit("slot"), F.col(key)), F.lit(buckets)).cast("int"))
    before = W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    first = dealt.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    first = first.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(W.partitionBy(shard, "_bucket").orderBy(*order))
    numbered = dealt.withColumn("_within", within)
    joined = numbered.join(F.broadcast(first), [shard, "_bucket"])
    return joined.withColumn("slot", F.col("_first") + F.col("_within") - 1).drop("_bucket", "_first", "_within")


def assign(documents: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown: float | None = None) -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard`` (with one more shard of weight ``grown``) of every row."""
    weights = [float(w) for w in weights]
    if not weights or min(weights) <= 0:
        raise ValueError("a shard's weight is over 0")
    grown = sum(weights) / len(weights) if grown is None else float(grown)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        key,
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        shard_of(F.col(key), weights).alias("shard"),
        shard_of(F.col(key), [*weights, grown]).alias("grown_shard"),
    )
    return with_slots(rows, key, "shard", len(weights), [key, "text_crc32", "size"], documents.count())


def write(documents: DataFrame, weights: Sequence[float], path: str, key: str = "doc_id") -> None:
    """Write all columns as one Parquet folder for each shard, under ``shard=N``."""
    marked = documents.withColumn("shard", shard_of(F.col(key), weights))
    marked.write.partitionBy("shard").mode("overwrite").parquet(path)
