"""Validation: every check is a filter or an anti join that yields issue rows."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from .hierarchy import issue

#: Issues of a run that are kept.
MAX_ISSUES = 5_000


@dataclass(frozen=True)
class System:
    """The shapes of a coding system's codes."""

    name: str
    code: str
    chapter: str = r"^([IVXLC]+|[0-9]{1,2})$"
    block: str = r"^[A-Z][0-9]{2}(\.[0-9A-Z]{1,4})?-[A-Z][0-9]{2}(\.[0-9A-Z]{1,4})?$"


_SYSTEMS: dict[str, System] = {}


def register_system(system: System) -> None:
    """Add a coding system, or put another in its place."""
    _SYSTEMS[system.name.upper()] = system


# Shapes by system, fixed values.
for _name, _code in (
    ("ICD-10", r"^[A-Z][0-9]{2}(\.[0-9]{1,2})?$"),
    ("ICD-10-CA", r"^[A-Z][0-9]{2}(\.[0-9A-Z]{1,3})?$"),
    ("ICD-10-CM", r"^[A-Z][0-9][0-9A-Z](\.[0-9A-Z]{1,4})?$"),
    ("SYNTH-ICD", r"^[A-Z][0-9]{2}(\.[0-9]{1,2})?$"),
    ("SYNTH-ALT", r"^[A-Z][0-9]{2}(\.[0-9]{1,2})?$"),
):
    register_system(System(_name, _code))


def system_for(name: str) -> System | None:
    return _SYSTEMS.get(name.upper())


def supported_systems() -> list[str]:
    return sorted(_SYSTEMS)


def metadata_issues(dataset: Mapping[str, object]) -> list[tuple[str, str]]:
    """Code and message for each fault of a dataset's description; checked on the driver."""
    out = []
    if system_for(str(dataset.get("coding_system") or "")) is None:
        out.append(("UNSUPPORTED_CODING_SYSTEM", f"No rules for the coding system {dataset.get('coding_system')!r}."))
    if not dataset.get("source_sha256"):
        out.append(("INVALID_DATASET_METADATA", "The source has no SHA-256 digest."))
    if not re.fullmatch(r"[a-z]{2,3}(-[A-Za-z]{2,4})?", str(dataset.get("language") or "")):
        out.append(("INVALID_DATASET_METADATA", f"{dataset.get('language')!r} is no language tag."))
    start, end = dataset.get("effective_from"), dataset.get("effective_to")
    if start and end and str(end) < str(start):
        out.append(("INVALID_DATASET_METADATA", "The effective range ends before it starts."))
    return out


def record_issues(records: DataFrame, system: System, pages: int | None = None) -> DataFrame:
    """Issues of the records of a source (``schemas.RECORD``), duplicates included."""
    level, code = F.col("level"), F.col("code")
    classed = codes.is_classification(level)
    shape = F.when(classed, code.rlike(system.code)).when(level == "CHAPTER", code.rlike(system.chapter)).otherwise(code.rlike(system.block) | code.rlike(system.code))
    out = issue(records.where(level.isNull() & F.col("invalid_level").isNull()), "ERROR", "INVALID_LEVEL", F.lit("The record has no level."))
    out = out.unionByName(issue(records.where("invalid_level is not null"), "ERROR", "INVALID_LEVEL", F.format_string("Unknown level %s.", "invalid_level")))
    out = out.unionByName(issue(records.where(classed & code.isNull()), "ERROR", "MISSING_CODE", F.lit("A classification record has no code.")))
    out = out.unionByName(issue(records.where("title is null"), "ERROR", "MISSING_TITLE", F.lit("The record has no title.")))
    out = out.unionByName(issue(records.where(level.isNotNull() & code.isNotNull() & ~shape), "ERROR", "MALFORMED_CODE", F.format_string("%s is no %s code of this system.", "code", "level")))
    # spellings that become the same code; equal keys are the hierarchy's business
    named = records.where(classed & code.isNotNull()).withColumn("_form", codes.normalize_code(code))
    clashing = named.groupBy("_form").agg(F.countDistinct("code").alias("_n"), F.min_by(F.struct("key", "code"), "sort_order").alias("_r")).where("_n > 1").select("_r.key", "_r.code")
    out = out.unionByName(issue(clashing, "ERROR", "DUPLICATE_NORMALIZED_CODE", F.format_string("%s collides with another spelling of the same code.", "code")))
    none = records.where(classed).limit(1).select(F.lit(1).alias("_one"))
    empty = records.sparkSession.range(1).select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("code")).join(F.broadcast(none), F.lit(True), "left_anti")
    out = out.unionByName(issue(empty, "ERROR", "EMPTY_DATASET", F.lit("The source has no classification record.")))
    return out.unionByName(provenance_issues(records, pages))


def provenance_issues(records: DataFrame, pages: int | None = None) -> DataFrame:
    """Records without provenance, or with pages or rows that cannot be."""
    first, last, row = (F.col(f"provenance.{c}") for c in ("page_start", "page_end", "row"))
    out = issue(records.where("provenance is null"), "ERROR", "RECORD_WITHOUT_PROVENANCE", F.lit("The record has no provenance."))
    outside = (first < 1) | (last < 1) | ((first > pages) | (last > pages) if pages else F.lit(False))
    for bad, message in ((outside, "A page lies outside the source."), (last < first, "The page range ends before it starts."), (row < 1, "A row is below 1.")):
        out = out.unionByName(issue(records.where(F.coalesce(bad, F.lit(False))), "ERROR", "INVALID_SOURCE_LOCATOR", F.lit(message)))
    return out


def reference_issues(records: DataFrame, system: System) -> DataFrame:
    """Warnings about targets that are no codes, or that the source does not have."""
    aimed = F.concat(
        F.transform("instructions", lambda i: F.struct(i["target_code"].alias("target"), i["instruction_type"].alias("kind"))),
        F.transform("terms", lambda t: F.struct(t["target_code"].alias("target"), F.lit("index term").alias("kind"))),
    )
    spread = records.select("key", "code", F.explode(aimed).alias("a")).select("key", "code", "a.target", "a.kind").where("target is not null")
    known = records.where("code is not null").select(F.explode(F.array(codes.normalize_code(F.col("code")), codes.normalize_code(F.col("code"), F.col("level")))).alias("_form")).distinct()
    well = codes.range_bounds(F.col("target")).isNotNull() | codes.clean_code(F.col("target")).rlike(system.code)
    out = issue(spread.where(~well), "WARNING", "INVALID_CROSS_REFERENCE", F.format_string("%s target %s is no code.", "kind", "target"))
    lost = spread.where(well).withColumn("_form", codes.normalize_code(F.col("target"))).join(known, "_form", "left_anti")
    lost = lost.withColumn("_form", codes.clean_code(F.col("target"))).join(known, "_form", "left_anti")
    return out.unionByName(issue(lost, "WARNING", "UNRESOLVED_CROSS_REFERENCE", F.format_string("%s target %s is not in this dataset.", "kind", "target")))


def hierarchy_issues(nodes: DataFrame) -> DataFrame:
    """Sections without records, and leaves that may not be selected."""
    leaf = F.col("n_children") == 0
    out = issue(nodes.where(F.col("level").isin("CHAPTER", "BLOCK") & leaf), "WARNING", "EMPTY_SECTION", F.format_string("%s has no records below.", "key"))
    return out.unionByName(issue(nodes.where(codes.is_classification(F.col("level")) & leaf & ~F.col("selectable")), "INFO", "NON_SELECTABLE_LEAF", F.format_string("The source does not let leaf %s be selected.", "key")))


def blocks_import(issues: DataFrame) -> bool:
    """Whether any issue is an error."""
    return not issues.where("severity = 'ERROR'").isEmpty()


def statistics(records: DataFrame, issues: DataFrame) -> DataFrame:
    """One row of counters: records by level, list sizes, issues by severity and code, as maps."""
    by_level = records.groupBy(F.coalesce("level", F.lit("NONE")).alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("levels"))
    sizes = records.agg(F.count(F.lit(1)).alias("records"), *(F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c) for c in ("inclusions", "instructions", "terms")))
    tallies = [issues.groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias(name)) for c, name in (("severity", "severities"), ("code", "issue_codes"))]
    out = sizes
    for one in (by_level, *tallies):  # one row each
        out = out.join(F.broadcast(one), F.lit(True), "left")
    return out
