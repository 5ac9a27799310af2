"""The tree of records: parents from the source or inferred, ancestors, checks, and what follows from position.

Every step is a join or a window over all records.  Ancestors are materialised once as a closure (node,
ancestor, distance), by as many joins as the tree is deep; everything else reads it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codes
from ..scratch import cut

MAX_DEPTH = 50
#: Level -> level whose range may contain it.
CONTAINERS = {"CATEGORY": "BLOCK", "SUBCATEGORY": "BLOCK", "CODE": "BLOCK", "BLOCK": "CHAPTER"}
ISSUE = ("severity", "code", "message", "record_key", "record_code")


def issue(rows: DataFrame, severity: str, code: str, message: Column) -> DataFrame:
    """Issue rows (``ISSUE``) for records (key, code)."""
    return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"), F.col("key").alias("record_key"), F.col("code").alias("record_code"))


def closure(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id", depth: int = MAX_DEPTH) -> DataFrame:
    """``node``, ``ancestor`` and ``lvl`` (1 for the parent) of every node up to ``depth``; a cycle shows as a node that is its own ancestor."""
    edges = nodes.where(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("ancestor"))
    up = edges.select(F.col("node").alias("_n"), F.col("ancestor").alias("_a"))
    step = cut(edges.withColumn("lvl", F.lit(1)), "closure")
    found = step
    for lvl in range(2, depth + 1):
        # a node that met itself goes no further
        onward = step.where("node <> ancestor")
        step = cut(onward.join(up, onward["ancestor"] == up["_n"]).select("node", F.col("_a").alias("ancestor"), F.lit(lvl).alias("lvl")), "closure")
        if step.isEmpty():
            break
        found = found.unionByName(step)
    return found


def ancestors(closed: DataFrame, of: DataFrame, node: str = "node_id") -> DataFrame:
    """Ancestors of the nodes in ``of``, with ``place`` from the root."""
    rows = closed.join(of.select(F.col(node).alias("node")).distinct(), "node", "left_semi")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("node").orderBy(F.desc("lvl"))))


def descendants(closed: DataFrame, of: DataFrame, node: str = "node_id") -> DataFrame:
    """``root``, ``node`` and ``lvl`` of all nodes below those in ``of``."""
    return closed.join(of.select(F.col(node).alias("ancestor")).distinct(), "ancestor", "left_semi").select(F.col("ancestor").alias("root"), "node", "lvl")


def children(nodes: DataFrame, of: DataFrame, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """The rows of ``nodes`` right below those in ``of``."""
    return nodes.join(of.select(F.col(node).alias(parent)).distinct(), parent, "left_semi")


def first_of_key(records: DataFrame, key: str = "key", order: str = "sort_order") -> tuple[DataFrame, DataFrame]:
    """The first record of each key, and the later ones."""
    placed = records.withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy(order)))
    return placed.where("_place = 1").drop("_place"), placed.where("_place > 1").drop("_place")


def _lookup(records: DataFrame) -> DataFrame:
    """``_form``, and key, level, rank and order of the record that has it: with the level's rules, and without."""
    forms = F.array_distinct(F.array(codes.normalize_code(F.col("code"), F.col("level")), codes.normalize_code(F.col("code"))))
    return records.where("code is not null").select(
        F.explode(forms).alias("_form"), F.col("key").alias("p_key"), F.col("level").alias("p_level"), F.coalesce(codes.rank(F.col("level")), F.lit(4)).alias("p_rank"), F.col("sort_order").alias("p_order"),
        F.col("code").alias("p_code"), F.col("range_start").alias("p_start"), F.col("range_end").alias("p_end"),
    )


def _best(met: DataFrame, *before: Column) -> DataFrame:
    """One parent for each child: by ``before``, then ranked above the child, then first in the source."""
    above = (F.col("p_rank") >= F.coalesce(codes.rank(F.col("level")), F.lit(4))).cast("int")
    place = F.row_number().over(W.partitionBy("key").orderBy(*before, above, F.col("p_order")))
    return met.withColumn("_place", place).where("_place = 1").select("key", F.col("p_key").alias("parent_key"))


def explicit_parents(records: DataFrame) -> DataFrame:
    """``key`` and ``parent_key`` of the records whose ``parent_code`` is in the source."""
    asked = records.where("parent_code is not null")
    own = codes.normalize_code(F.col("parent_code"), F.col("parent_level"))
    forms = F.array_distinct(F.array(own, codes.normalize_code(F.col("parent_code"))))
    spread = asked.select("key", "level", "parent_level", F.posexplode(forms).alias("_at", "_form"))
    met = spread.join(_lookup(records), "_form").where("p_key <> key")
    other_level = F.when(F.col("parent_level").isNotNull() & (F.col("p_level") != F.col("parent_level")), 1).otherwise(0)
    return _best(met, F.col("_at"), other_level)


def truncation_parents(records: DataFrame) -> DataFrame:
    """``key`` and ``parent_key`` by the nearest shorter code that is in the source."""
    asked = records.where(codes.is_classification(F.col("level")) & F.col("code").isNotNull())
    spread = asked.select("key", "level", F.posexplode(codes.truncations(F.col("code"))).alias("_at", "_short")).withColumn("_form", codes.normalize_code(F.col("_short")))
    met = spread.join(_lookup(records).where(codes.is_classification(F.col("p_level"))), "_form").where("p_key <> key")
    return _best(met, F.col("_at"))


def record_range(code: Column, start: Column, end: Column) -> Column:
    """Struct of ``low`` and ``high``: as stated, else from the code."""
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("low"), end.alias("high"))).otherwise(codes.range_bounds(code))


def containing(probes: DataFrame, ranges: DataFrame) -> DataFrame:
    """``probe_id`` and ``range_id`` where exactly one range of the probe's ``target`` level contains it.

    ``probes``: probe_id, code, target; ``ranges``: range_id, level, low, high.  They meet on the letters that a range
    spans, so a probe sees the ranges of its own letter only.
    """
    keyed = probes.withColumn("_k", codes.sort_key(F.col("code"))).withColumn("_letter", F.col("_k.letter"))
    bounds = ranges.withColumn("_lo", codes.sort_key(F.col("low"))).withColumn("_hi", codes.sort_key(F.col("high")))
    span = F.when(F.ascii(F.col("_lo.letter")) <= F.ascii(F.col("_hi.letter")), F.sequence(F.ascii(F.col("_lo.letter")), F.ascii(F.col("_hi.letter"))))
    spread = bounds.select("range_id", F.col("level").alias("target"), "_lo", "_hi", F.explode(span).alias("_point")).withColumn("_letter", F.char(F.col("_point")))
    met = keyed.join(spread, ["_letter", "target"]).where((F.col("_lo") <= F.col("_k")) & (F.col("_k") <= F.col("_hi")))
    return met.groupBy("probe_id").agg(F.count(F.lit(1)).alias("_n"), F.min("range_id").alias("range_id")).where("_n = 1").drop("_n")


def range_parents(records: DataFrame) -> DataFrame:
    """``key`` and ``parent_key`` by the only block or chapter whose range contains the record."""
    target = F.try_element_at(F.create_map(*(F.lit(x) for pair in CONTAINERS.items() for x in pair)), F.col("level"))
    of_block = F.when(F.col("level") == "BLOCK", codes.range_bounds(F.col("code"))["low"])
    probes = records.select(F.col("key").alias("probe_id"), F.coalesce("range_start", of_block, "code").alias("code"), target.alias("target")).where("code is not null and target is not null")
    span = record_range(F.col("code"), F.col("range_start"), F.col("range_end"))
    ranges = records.withColumn("_r", span).where("_r is not null").select(F.col("key").alias("range_id"), "level", F.col("_r.low").alias("low"), F.col("_r.high").alias("high"))
    return containing(probes, ranges).select(F.col("probe_id").alias("key"), F.col("range_id").alias("parent_key"))


def level_issues(linked: DataFrame) -> DataFrame:
    """Issues of parent links; ``linked``: child (key, code, level) with p_key, p_code, p_level, p_start, p_end."""
    child, parent = codes.rank(F.col("level")), codes.rank(F.col("p_level"))
    inverted = (child < parent) | ((child == parent) & (F.col("level") != "BLOCK"))
    classed = codes.is_classification(F.col("level"))
    both = classed & codes.is_classification(F.col("p_level"))
    mismatch = both & ~codes.normalize_code(F.col("code")).startswith(codes.normalize_code(F.col("p_code")))
    span = record_range(F.col("p_code"), F.col("p_start"), F.col("p_end"))
    outside = classed & F.col("code").isNotNull() & span.isNotNull() & ~codes.in_range(F.col("code"), span["low"], span["high"])
    right = ~F.coalesce(inverted, F.lit(False))
    return (
        issue(linked.where(inverted), "ERROR", "HIERARCHY_LEVEL_INCONSISTENT", F.format_string("%s %s cannot be a child of %s %s.", "level", "key", "p_level", "p_key"))
        .unionByName(issue(linked.where(right & mismatch), "WARNING", "HIERARCHY_CODE_MISMATCH", F.format_string("Code %s does not extend its parent code %s.", codes.clean_code(F.col("code")), codes.clean_code(F.col("p_code")))))
        .unionByName(issue(linked.where(right & outside), "WARNING", "CODE_OUTSIDE_PARENT_RANGE", F.format_string("Code %s lies outside the range %s-%s of its parent.", codes.clean_code(F.col("code")), span["low"], span["high"])))
    )


def build(records: DataFrame, infer_parents: bool = False, leaves_selectable: bool = True) -> tuple[DataFrame, DataFrame]:
    """The nodes and the issues of a source.

    ``records``: key, code, level, title, parent_code, parent_level, range_start, range_end, is_selectable, sort_order.
    Nodes: those columns of the first record of each key, ``parent_key``, ``parent_inferred``, ``depth``, ``chapter_key``,
    ``block_key``, ``category_key``, ``selectable``, ``n_children``.
    """
    records = cut(records, "records")
    kept, again = first_of_key(records)
    kept = cut(kept, "kept")
    issues = issue(again, "ERROR", "DUPLICATE_CODE", F.format_string("Record %s comes again; the first one is kept.", "key"))

    stated = explicit_parents(kept).withColumn("_inferred", F.lit(False))
    missing = kept.where("parent_code is not null").join(stated, "key", "left_anti")
    issues = issues.unionByName(issue(missing, "ERROR", "MISSING_PARENT", F.format_string("Parent %s of %s is not in the source.", "parent_code", "key")))
    free = kept.where("parent_code is null and (level is null or level <> 'CHAPTER')")
    parents = stated
    if infer_parents:
        near = truncation_parents(kept).withColumn("_way", F.lit(0)).unionByName(range_parents(kept).withColumn("_way", F.lit(1)))
        near = near.join(free.select("key"), "key", "left_semi")
        guessed = near.groupBy("key").agg(F.min_by("parent_key", "_way").alias("parent_key")).withColumn("_inferred", F.lit(True))
        parents = parents.unionByName(guessed)
        free = free.join(guessed, "key", "left_anti")
    grouped = kept.where(F.col("level").isin("CHAPTER", "BLOCK")).limit(1).select(F.lit(1).alias("_one"))
    issues = issues.unionByName(issue(free.join(F.broadcast(grouped), F.lit(True), "left_semi"), "ERROR", "ORPHAN_RECORD", F.format_string("%s has no parent although the source has chapters or blocks.", "key")))
    parents = cut(parents, "parents")
    guesses = kept.join(parents.where("_inferred"), "key")
    issues = issues.unionByName(issue(guesses, "INFO", "PARENT_INFERRED", F.format_string("Parent of %s inferred as %s.", "key", "parent_key")))
    above = kept.select(F.col("key").alias("p_key"), F.col("code").alias("p_code"), F.col("level").alias("p_level"), F.col("range_start").alias("p_start"), F.col("range_end").alias("p_end"))
    linked = kept.join(parents, "key").join(above, F.col("parent_key") == F.col("p_key"))
    issues = issues.unionByName(level_issues(linked))

    closed = closure(parents, "key", "parent_key")
    rings = closed.where("node = ancestor").select(F.col("node").alias("key")).distinct()
    rings = cut(rings, "rings")
    issues = issues.unionByName(issue(kept.join(rings, "key"), "ERROR", "HIERARCHY_CYCLE", F.format_string("%s is its own ancestor.", "key")))
    if not rings.isEmpty():
        parents = cut(parents.join(rings, "key", "left_anti"), "parents")
        closed = closure(parents, "key", "parent_key")

    levels = kept.select(F.col("key").alias("ancestor"), F.col("level").alias("_level"))
    near = [F.min_by(F.when(F.col("_level") == x, F.col("ancestor")), F.when(F.col("_level") == x, F.col("lvl"))).alias(f"{x.lower()}_key") for x in ("CHAPTER", "BLOCK", "CATEGORY")]
    placed = closed.join(levels, "ancestor").groupBy(F.col("node").alias("key")).agg(F.max("lvl").alias("depth"), *near)
    below = parents.groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = kept.join(parents, "key", "left").join(placed, "key", "left").join(below, "key", "left")
    leaf = F.lit(leaves_selectable) & codes.is_classification(F.col("level")) & (F.col("n_children") == 0)
    nodes = nodes.withColumns({"depth": F.coalesce("depth", F.lit(0)), "n_children": F.coalesce("n_children", F.lit(0)), "parent_inferred": F.coalesce("_inferred", F.lit(False))}).drop("_inferred")
    return nodes.withColumn("selectable", F.coalesce("is_selectable", leaf)), issues


def insert_order(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``node_id``: by depth, then source order, gapless from 1."""
    counts = nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select("depth", F.coalesce(F.sum("_n").over(W.orderBy("depth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    placed = nodes.withColumn("_place", F.row_number().over(W.partitionBy("depth").orderBy("sort_order")))
    return placed.join(F.broadcast(first), "depth").withColumn("node_id", F.col("_first") + F.col("_place")).drop("_first", "_place")


def conflicts(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one node has, with their number."""
    return nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
