"""Ranking and safety metrics over tables of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text


def recall_at(rank: Column, k: int) -> Column:
    """Share of rows whose expected item has a rank up to k; a null rank is a miss."""
    return F.coalesce(F.avg(F.when(rank <= k, F.lit(1.0)).otherwise(F.lit(0.0))), F.lit(0.0))


def mrr(rank: Column) -> Column:
    return F.coalesce(F.avg(F.coalesce(F.lit(1.0) / rank, F.lit(0.0))), F.lit(0.0))


def rate(hit: Column, counted: Column | None = None) -> Column:
    """Share of counted rows that are hits; 0 where none is counted."""
    counted = F.lit(True) if counted is None else counted
    n = F.sum(counted.cast("int"))
    return F.when(n > 0, F.sum((hit & counted).cast("int")) / n).otherwise(F.lit(0.0))


def ranks_summary(ranks: DataFrame, keys: Sequence[str], ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Recalls, reciprocal rank and count by ``keys`` of rows with a ``rank``."""
    return ranks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.round(recall_at(F.col("rank"), k), 4).alias(f"recall_at_{k}") for k in ks), F.round(mrr(F.col("rank")), 4).alias("mrr"))


def by_tag(ranks: DataFrame, keys: Sequence[str] = (), tags: str = "tags") -> DataFrame:
    """:func:`ranks_summary` for each tag of an array column."""
    return ranks_summary(ranks.withColumn("tag", F.explode(tags)), [*keys, "tag"])


def agreement(rows: DataFrame, ours: str, theirs: str) -> DataFrame:
    """Share of rows with a coder's code where ours is the same."""
    return rows.agg(F.round(rate(F.col(ours).eqNullSafe(F.col(theirs)), F.col(theirs).isNotNull()), 4).alias("agreement"))


def latency(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, exact median and 95th percentile (linear), and maximum."""
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 2).alias("mean"), F.round(F.percentile(value, F.lit(0.5)), 2).alias("p50"), F.round(F.percentile(value, F.lit(0.95)), 2).alias("p95"), F.max(value).alias("most")
    )


def element_at_share(rows: DataFrame, keys: Sequence[str], value: str, share: float = 0.95) -> DataFrame:
    """The element at ``int(share * n)``, from 0, of each group's sorted values, at most the last."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(value)) - 1
    placed = rows.where(F.col(value).isNotNull()).withColumns({"_n": n, "_place": place})
    wanted = F.least(F.floor(F.col("_n") * share), F.col("_n") - 1)
    return placed.where(F.col("_place") == wanted).select(*keys, F.col(value).alias("element"))


def status_metrics(rows: DataFrame, expected: str, found: str, positive: Sequence[str]) -> DataFrame:
    """Precision and recall of a set of statuses."""
    want, got = F.col(expected).isin(*positive), F.col(found).isin(*positive)
    return rows.agg(F.round(rate(want, got), 4).alias("precision"), F.round(rate(got, want), 4).alias("recall"))


def gates(counts: dict[str, DataFrame]) -> DataFrame:
    """One row for each gate: its number of offending rows, and whether it holds (none)."""
    out = None
    for name, rows in counts.items():
        one = rows.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("gate"), "value", (F.col("value") == 0).alias("holds"))
        out = one if out is None else out.unionByName(one)
    return out


def first_failure(rows: DataFrame, keys: Sequence[str], stages: Sequence[str]) -> DataFrame:
    """The earliest failing stage of each case; ``rows``: keys, stage."""
    order = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    return rows.where(order > 0).groupBy(*keys).agg(F.min_by("stage", order).alias("stage"))


def singular(word: Column) -> Column:
    """A word of over three letters without its final s."""
    return F.regexp_replace(word, "^(.{3,})s$", "$1")


def concept_similarity(expected: Column, found: Column, most_context: int = 3) -> Column:
    """Jaccard of the words, without a final s, or containment of the expected ones where there are few others."""
    a, b = (F.array_distinct(F.transform(text.tokens(t), singular)) for t in (expected, found))
    common = F.size(F.array_intersect(a, b))
    jaccard = common / F.size(F.array_union(a, b))
    within = F.when(F.size(F.array_except(b, a)) <= most_context, common / F.size(a)).otherwise(F.lit(0.0))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.greatest(jaccard, within)).otherwise(F.lit(0.0))


def near_ties(ranked: DataFrame, keys: Sequence[str], score: str, gap: float = 0.05) -> DataFrame:
    """Groups whose best and second score lie closer than ``gap``."""
    order = W.partitionBy(*keys).orderBy(F.desc(score))
    placed = ranked.withColumns({"_place": F.row_number().over(order), "_next": F.lead(score).over(order)})
    return placed.where((F.col("_place") == 1) & (F.col(score) - F.col("_next") < gap)).select(*keys, score, F.col("_next").alias("second"))
