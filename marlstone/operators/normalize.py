"""From mapped source rows to normalised records, terms and rules, in one projection and one join.

Source rows carry the fields of ``RECORD_FIELDS`` as text (or arrays of text), a row number and their
provenance.  Rows of a separate rules table are joined with their owners and folded into them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codes, instructions, text
from ..schemas import INSTRUCTION, INSTRUCTION_FIELDS, PROVENANCE, RECORD, RECORD_FIELDS, RULE_FIELDS, TERM, TERM_FIELDS
from ..scratch import cut

TERM_KINDS = tuple(TERM_FIELDS.values())


def project(rows: DataFrame, fields: tuple[str, ...] = RECORD_FIELDS, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Source columns under their canonical names, null where the source has none; other columns with a leading ``_`` stay."""
    columns = columns or {}
    own = set(rows.columns)
    named = [F.col(f"`{columns.get(f, f)}`").alias(f) if columns.get(f, f) in own else F.lit(None).cast("string").alias(f) for f in fields]
    return rows.select(*named, *(c for c in rows.columns if c.startswith("_")))


def level_of(label: Column, code: Column, values: Mapping[str, str] | None = None, from_shape: bool = True) -> Column:
    """A level by the mapping, by its own name, or for a missing label by the code's shape; an unknown label is null."""
    cleaned = text.clean(label)
    mapped = F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), cleaned) if values else F.lit(None).cast("string")
    named = F.when(F.upper(cleaned).isin(*codes.LEVELS), F.upper(cleaned))
    shape = codes.level_from_shape(code) if from_shape else F.lit(None).cast("string")
    return F.when(cleaned.isNotNull(), F.coalesce(mapped, named)).when(code.isNotNull(), shape)


def _cells(rows: DataFrame, field: str, separator: str) -> Column:
    """The parts of a field that is a cell of text or an array."""
    if rows.schema[field].dataType.typeName() == "array":
        return F.coalesce(F.filter(F.transform(F.col(field), text.clean), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return text.clean_list(F.col(field), separator)


def _instructions(parts: Column, kind: str) -> Column:
    none = F.lit(None).cast("string")
    return F.transform(parts, lambda t: instructions.item(t, none, F.lit(kind), none)).cast(f"array<{INSTRUCTION}>")


def _terms(parts: Column, kind: str) -> Column:
    return F.transform(parts, lambda t: F.struct(t.alias("term"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("target_code"))).cast(f"array<{TERM}>")


def records(rows: DataFrame, separator: str = "|", level_values: Mapping[str, str] | None = None, level_from_shape: bool = True) -> DataFrame:
    """Normalised records (``schemas.RECORD``) of projected rows with ``_order`` and ``_provenance``.

    ``invalid_level`` keeps a label that names no level.
    """
    code = codes.clean_code(text.clean(F.col("code")))
    level = level_of(F.col("level"), code, level_values, level_from_shape)
    label = text.clean(F.col("level"))
    kinds = [_instructions(_cells(rows, "exclusions", separator), "EXCLUDES"), *(_instructions(_cells(rows, f, separator), k) for f, k in INSTRUCTION_FIELDS.items())]
    head = rows.withColumns({"_code": code, "_level": level})
    return head.select(
        codes.record_key(F.col("_level"), F.col("_code"), F.col("_order")).alias("key"), F.col("_code").alias("code"), codes.normalize_code(F.col("_code"), F.col("_level")).alias("normalized_code"),
        text.clean(F.col("title")).alias("title"), text.clean(F.col("description")).alias("description"), F.col("_level").alias("level"), codes.clean_code(text.clean(F.col("parent_code"))).alias("parent_code"),
        level_of(F.col("parent_level"), F.lit(None).cast("string"), level_values).alias("parent_level"), text.clean(F.col("range_start")).alias("range_start"), text.clean(F.col("range_end")).alias("range_end"),
        text.flag(F.col("selectable")).alias("is_selectable"), F.when(F.lower(text.clean(F.col("status"))).isin("disabled", "inactive", "retired"), "DISABLED").otherwise("ACTIVE").alias("status"),
        F.col("_order").cast("long").alias("sort_order"), _cells(rows, "inclusions", separator).alias("inclusions"), F.concat(*kinds).alias("instructions"),
        F.concat(*(_terms(_cells(rows, f, separator), k) for f, k in TERM_FIELDS.items())).alias("terms"), F.col("_provenance").cast(PROVENANCE).alias("provenance"),
        F.when(label.isNotNull() & F.col("_level").isNull(), label).alias("invalid_level"),
    ).select(*(F.col(c).cast(t).alias(c) for c, t in RECORD.items()))


def from_source(rows: DataFrame, manifest) -> tuple[DataFrame, DataFrame]:
    """Normalised records of a source's rows, with items that state a target of their own, and issue rows of the parser."""
    whole = rows.where("_issue is null")
    found = records(whole, manifest.list_separator, manifest.level_values, manifest.level_from_shape)
    kinds = F.create_map(*(F.lit(x) for pair in ({"exclusions": "EXCLUDES"} | INSTRUCTION_FIELDS).items() for x in pair))
    names = F.create_map(*(F.lit(x) for pair in TERM_FIELDS.items() for x in pair))
    own = F.col("_structured")
    made = F.transform(
        F.filter(own, lambda x: F.try_element_at(kinds, x["field"]).isNotNull()),
        lambda x: instructions.item(x["text"], x["target_code"], F.try_element_at(kinds, x["field"]), instructions.exclusion_type(F.coalesce(x["exclusion_type"], F.lit("")))),
    ).cast(f"array<{INSTRUCTION}>")
    named = F.filter(own, lambda x: F.try_element_at(names, x["field"]).isNotNull())
    terms = F.transform(named, lambda x: F.struct(x["text"].alias("term"), F.try_element_at(names, x["field"]).alias("kind"), codes.clean_code(x["target_code"]).alias("target_code"))).cast(f"array<{TERM}>")
    plain = F.transform(F.filter(own, lambda x: x["field"] == "inclusions"), lambda x: x["text"])
    extra = whole.where(F.size("_structured") > 0).select(F.col("_order").cast("long").alias("sort_order"), F.col("_file").alias("_f"), made.alias("_i"), terms.alias("_t"), plain.alias("_p"))
    joined = found.join(extra, (found["sort_order"] == extra["sort_order"]) & (F.col("provenance.source_filename") == F.col("_f")), "left").drop(extra["sort_order"])
    none = F.array()
    out = joined.withColumns({"instructions": F.concat("instructions", F.coalesce("_i", none)), "terms": F.concat("terms", F.coalesce("_t", none)), "inclusions": F.concat("inclusions", F.coalesce("_p", none))})
    bad = rows.where("_issue is not null")
    severity = F.when(F.col("_issue") == "MODIFIERS_NOT_EXPANDED", "WARNING").otherwise("ERROR")
    none = F.lit(None).cast("string")
    return out.select(*found.columns), bad.select(severity.alias("severity"), F.col("_issue").alias("code"), F.format_string("Item %d could not be read as a record.", "_order").alias("message"), none.alias("record_key"), none.alias("record_code"))


def attach_rules(found: DataFrame, rules: DataFrame, columns: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Records with the rows of a rules table folded in, in row order, and the issues of rows that cannot be.

    A row's kind routes it: inclusion, term, or instruction.  Its owner is the first record with its code, of its level
    where there is one.
    """
    rows = project(rules, RULE_FIELDS, columns)
    if "_order" not in rows.columns:
        raise ValueError("rows of a rules table carry their number as _order")
    kind = F.regexp_replace(F.upper(F.coalesce(text.clean(F.col("rule_type")), F.lit(""))), " ", "_")
    stated = codes.clean_code(text.clean(F.col("target_code")))
    rows = rows.select(
        "_order", text.clean(F.col("owner_code")).alias("owner"), level_of(F.col("owner_level"), F.lit(None).cast("string")).alias("owner_level"), text.clean(F.col("text")).alias("text"), stated.alias("target_code"),
        F.when(kind.isin("INCLUSION", "INCLUSION_TERM"), "INCLUSION").when(kind.isin(*TERM_KINDS), kind).otherwise(instructions.instruction_type(F.coalesce(F.col("rule_type"), F.lit("")))).alias("kind"),
        instructions.exclusion_type(F.coalesce(text.clean(F.col("exclusion_type")), F.col("rule_type"), F.lit(""))).alias("exclusion"), F.col("rule_type").alias("label"),
    )
    rows = cut(rows, "rules")
    firsts = found.where("code is not null").withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy("sort_order"))).where("_n = 1")
    owners = firsts.select(F.col("key").alias("owner_key"), codes.normalize_code(F.col("code")).alias("_form"), F.col("level").alias("_level"), F.col("sort_order").alias("_at"))
    whole = rows.where("text is not null and owner is not null").withColumn("_form", codes.normalize_code(F.col("owner")))
    other = F.when(F.col("owner_level").isNotNull() & ~F.col("_level").eqNullSafe(F.col("owner_level")), 1).otherwise(0)
    owned = whole.join(owners, "_form").withColumn("_n", F.row_number().over(W.partitionBy("_order").orderBy(other, "_at"))).where("_n = 1")

    def issue(some: DataFrame, code: str, message: str) -> DataFrame:
        return some.select(F.lit("ERROR").alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit(None).cast("string").alias("record_key"), F.col("owner").alias("record_code"))

    issues = (
        issue(rows.where("text is null"), "EMPTY_RULE", "A rule row has no text.")
        .unionByName(issue(rows.where("text is not null and owner is null"), "RULE_WITHOUT_OWNER", "A rule row has no owner code."))
        .unionByName(issue(whole.join(owned.select("_order"), "_order", "left_anti"), "RULE_WITHOUT_OWNER", "The owner of a rule is not in the source."))
        .unionByName(issue(owned.where("kind is null"), "UNKNOWN_RULE_TYPE", "A rule row has an unknown type."))
    )
    is_term = F.col("kind").isin(*TERM_KINDS)
    made = F.struct(
        F.col("_order").alias("at"), F.when(F.col("kind") == "INCLUSION", F.col("text")).alias("inclusion"),
        F.when(is_term, F.struct(F.col("text").alias("term"), F.col("kind").alias("kind"), F.col("target_code")).cast(TERM)).alias("term"),
        F.when(~is_term & (F.col("kind") != "INCLUSION"), instructions.item(F.col("text"), F.col("target_code"), F.col("kind"), F.when(F.col("kind") == "EXCLUDES", F.col("exclusion"))).cast(INSTRUCTION)).alias("instruction"),
    )
    folded = owned.where("kind is not null").groupBy("owner_key").agg(F.array_sort(F.collect_list(made)).alias("_made"))
    pick = lambda name: F.filter(F.transform(F.coalesce(F.col("_made"), F.array()), lambda m: m[name]), lambda x: x.isNotNull())
    is_first = F.row_number().over(W.partitionBy("key").orderBy("sort_order")) == 1
    joined = found.withColumn("_first", is_first).join(folded, (F.col("key") == F.col("owner_key")) & F.col("_first"), "left")
    out = joined.withColumns({"inclusions": F.concat("inclusions", pick("inclusion")), "terms": F.concat("terms", pick("term")), "instructions": F.concat("instructions", pick("instruction"))})
    return out.select(*found.columns), issues


def terms_and_entries(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms of nodes (inclusions, and synonyms and abbreviations without target of their own) and index entries (the rest)."""
    inclusions = found.select("key", F.explode("inclusions").alias("term")).withColumn("term_type", F.lit("INCLUSION"))
    spread = found.select("key", "code", F.explode("terms").alias("t")).select("key", "code", "t.*")
    own = F.col("kind").isin("SYNONYM", "ABBREVIATION") & F.col("target_code").isNull()
    terms = inclusions.unionByName(spread.where(own).select("key", "term", F.col("kind").alias("term_type")))
    entries = spread.where(~own).select("key", F.col("term").alias("lead_term"), F.coalesce("target_code", "code").alias("candidate_code"))
    norm = lambda c: text.normalize_text(F.col(c)).alias("normalized_term")
    return terms.select("*", norm("term")), entries.select("*", norm("lead_term"))


def rules_of(found: DataFrame) -> DataFrame:
    """One row for each instruction: key, rule_type, rule_text, exclusion_type, target_code."""
    spread = found.select("key", F.explode("instructions").alias("i")).select("key", "i.*")
    kinds = F.create_map(*(F.lit(x) for pair in instructions.RULE_TYPES.items() for x in pair))
    return spread.select("key", F.try_element_at(kinds, F.col("instruction_type")).alias("rule_type"), F.col("text").alias("rule_text"), "exclusion_type", "target_code")


def resolve_targets(rows: DataFrame, nodes: DataFrame, code: str = "target_code", into: str = "target_key") -> DataFrame:
    """``rows`` with the key of the classification record that a code names, null if there is none."""
    known = nodes.where(codes.is_classification(F.col("level"))).groupBy(codes.normalize_code(F.col("code")).alias("_form")).agg(F.min("key").alias(into))
    return rows.withColumn("_form", codes.normalize_code(F.col(code))).join(known, "_form", "left").drop("_form")
