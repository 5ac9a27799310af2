"""Coding instructions: markers at the start of a line, type labels, targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import all_references, clean_code, single_target

#: Instruction types, and the rule type that each is stored as.
RULE_TYPES = {
    "INCLUDES": "INCLUDE", "EXCLUDES": "EXCLUDE", "NOTE": "NOTE", "CODE_ALSO": "CODE_ALSO", "USE_ADDITIONAL_CODE": "USE_ADDITIONAL_CODE",
    "CODE_FIRST": "CODE_FIRST", "SEE": "SEE", "SEE_ALSO": "SEE_ALSO", "OTHER": "OTHER",
}
# Markers, fixed values: (pattern, type, exclusion type, whether the rest of the line is the text); the first that fits counts.
MARKERS = (
    (r"(?i)^excludes\s*1\s*:?\s*", "EXCLUDES", "EXCLUDES1", True),
    (r"(?i)^excludes\s*2\s*:?\s*", "EXCLUDES", "EXCLUDES2", True),
    (r"(?i)^(?:excludes|excl\.)\s*:\s*", "EXCLUDES", None, True),
    (r"(?i)^excludes\s*$", "EXCLUDES", None, True),
    (r"(?i)^(?:includes|incl\.)\s*:\s*", "INCLUDES", None, True),
    (r"(?i)^includes\s*$", "INCLUDES", None, True),
    (r"(?i)^notes?\s*:\s*", "NOTE", None, True),
    (r"(?i)^notes?\s*$", "NOTE", None, True),
    (r"(?i)^use\s+additional\s+code\b", "USE_ADDITIONAL_CODE", None, False),
    (r"(?i)^code\s+first\b", "CODE_FIRST", None, False),
    (r"(?i)^code\s+also\b", "CODE_ALSO", None, False),
    (r"(?i)^see\s+also\b", "SEE_ALSO", None, False),
    (r"(?i)^see\b(?!\s+also)", "SEE", None, False),
)
#: Labels besides the types themselves, without anything but letters and digits.
ALIASES = {"INCLUDE": "INCLUDES", "INCLUSION": "INCLUDES", "EXCLUDE": "EXCLUDES", "EXCLUSION": "EXCLUDES", "EXCLUDES1": "EXCLUDES", "EXCLUDES2": "EXCLUDES", "NOTES": "NOTE"}


def match_marker(line: Column) -> Column:
    """Struct of ``type``, ``exclusion_type``, ``text`` and ``is_label``; null for a line without marker."""
    stripped = F.trim(line)
    chain = F
    for pattern, kind, exclusion, label in MARKERS:
        text = F.regexp_replace(stripped, pattern, "") if label else stripped
        chain = chain.when(stripped.rlike(pattern), F.struct(F.lit(kind).alias("type"), F.lit(exclusion).cast("string").alias("exclusion_type"), text.alias("text"), F.lit(label).alias("is_label")))
    return chain.otherwise(F.lit(None))


def instruction_type(label: Column) -> Column:
    """The type that a label of structured data names; null if none."""
    names = {k.replace("_", ""): k for k in RULE_TYPES} | ALIASES
    key = F.regexp_replace(F.upper(label), "[^A-Z0-9]", "")
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key)


def exclusion_type(label: Column) -> Column:
    key = F.regexp_replace(F.upper(label), "[^A-Z0-9]", "")
    return F.when(key.isin("EXCLUDES1", "EXCLUDES2"), key)


def target(text: Column, explicit: Column) -> Column:
    """The stated target, else the only code of the text."""
    return F.coalesce(clean_code(explicit), single_target(text))


def item(text: Column, explicit: Column, kind: Column, exclusion: Column) -> Column:
    """An instruction as a struct."""
    return F.struct(
        kind.alias("instruction_type"), F.trim(text).alias("text"), exclusion.alias("exclusion_type"), target(text, explicit).alias("target_code"), all_references(text).alias("referenced_codes")
    )
