"""Records and datasets as they are shown: one row each, with what belongs to them as arrays."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instructions import RULE_TYPES
from . import catalog

RUN = ("run_id", "status", "started_at", "completed_at", "records_seen", "records_inserted", "error_summary")


def _listed(rows: DataFrame, wanted: dict[str, tuple[Column, Column]], order: str) -> DataFrame:
    """By node_id, an array for each name of the values whose test holds, in the order of a column, then of themselves."""
    made = {n: F.array_sort(F.collect_list(F.when(test, F.struct(F.col(order).alias("at"), value.alias("value"))))) for n, (test, value) in wanted.items()}
    return rows.groupBy("node_id").agg(*(F.transform(a, lambda e: e["value"]).alias(n) for n, a in made.items()))


def records(nodes: DataFrame, closed: DataFrame, terms: DataFrame, rules: DataFrame, entries: DataFrame, instructions: Mapping[str, str] | None = None) -> DataFrame:
    """Each record with ``hierarchy`` from the root, ``inclusions``, ``synonyms``, ``exclusions``, ``instructions`` and ``index_terms``.

    ``nodes``: node_id, code, title, level and what else is to be shown; ``closed``: node, ancestor, lvl; ``terms``: node_id,
    term_type, term, at; ``rules``: node_id, rule_type, rule_text, target_code, at; ``entries``: node_id, lead_term, at.
    ``instructions`` names rule types as they are shown, by default by the type of their instruction.  A record without any has empty arrays.
    """
    item = F.struct(F.col("lvl"), F.struct(F.col("_a.node_id").alias("record_id"), F.col("_a.code").alias("code"), F.col("_a.title").alias("title"), F.col("_a.level").alias("level")).alias("item"))
    above = closed.join(nodes.select(F.col("node_id").alias("ancestor"), F.struct("node_id", "code", "title", "level").alias("_a")), "ancestor")
    path = above.groupBy(F.col("node").alias("node_id")).agg(F.transform(F.sort_array(F.collect_list(item), asc=False), lambda e: e["item"]).alias("hierarchy"))
    kind = F.col("term_type")
    said = _listed(terms, {"inclusions": (kind == "INCLUSION", F.col("term")), "synonyms": (kind.isin("SYNONYM", "ABBREVIATION"), F.col("term"))}, "at")
    shown = F.col("rule_type")
    for name, spelled in ({v: k for k, v in RULE_TYPES.items()} if instructions is None else instructions).items():
        shown = F.when(F.col("rule_type") == name, spelled).otherwise(shown)
    rule, excludes = F.struct(shown.alias("type"), F.col("rule_text").alias("text"), F.col("target_code")), F.col("rule_type") == "EXCLUDE"
    ruled = _listed(rules, {"exclusions": (excludes, rule), "instructions": (~excludes, rule)}, "at")
    led = _listed(entries, {"index_terms": (F.lit(True), F.col("lead_term"))}, "at")
    out = nodes
    for part in (path, said, ruled, led):
        out = out.join(part, "node_id", "left")
        out = out.withColumns({c: F.coalesce(F.col(c), F.array().cast(t)) for c, t in part.dtypes if c != "node_id"})
    return out


def dataset_details(datasets: DataFrame, nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """Each dataset with ``record_counts`` (a map by level), and its latest run, null where there is none.

    ``datasets``: dataset_id and what else is to be shown; ``nodes``: dataset_id, level; ``runs``: dataset_id and :data:`RUN`.
    """
    counts = nodes.groupBy("dataset_id", "level").agg(F.count(F.lit(1)).alias("n")).groupBy("dataset_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("record_counts"))
    latest = catalog.latest(runs, ["dataset_id"], F.desc("started_at"), F.desc("run_id")).select("dataset_id", F.struct(*RUN).alias("latest_ingestion"))
    out = datasets.join(counts, "dataset_id", "left").join(latest, "dataset_id", "left")
    return out.withColumn("record_counts", F.coalesce("record_counts", F.create_map().cast("map<string,bigint>")))
