"""Code formats as column expressions; what is a valid code is decided by a system's rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that decorate printed codes, dashes, and the shape of a code token.
DECORATIONS = "†‡*✝+"
DASHES = "–—‐‑−"
TOKEN = r"[A-Z][0-9][0-9A-Z](?:\.[0-9A-Z]{1,4})?"
REFERENCE = rf"(?<![A-Za-z0-9.])({TOKEN})(?:\.-|-(?![A-Z0-9]))?(?![A-Za-z0-9])"
RANGE = rf"(?<![A-Za-z0-9.])({TOKEN})\s*-\s*({TOKEN})(?![A-Za-z0-9])"

LEVELS = ("CHAPTER", "BLOCK", "CATEGORY", "SUBCATEGORY", "CODE")
CLASSIFICATION = LEVELS[2:]


def rank(level: Column) -> Column:
    """Place of a level in ``LEVELS``, from 0; null for any other."""
    return F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), level), F.lit(0)).cast("int") - 1


def is_classification(level: Column) -> Column:
    return F.coalesce(level.isin(*CLASSIFICATION), F.lit(False))


def plain_dashes(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


def clean_code(code: Column) -> Column:
    """Without decorations and white space, dashes alike, upper case."""
    return F.upper(F.regexp_replace(plain_dashes(F.translate(code, DECORATIONS, "")), r"(?U)\s+", ""))


def normalize_code(code: Column, level: Column | None = None) -> Column:
    """Form for look-ups: classification codes lose punctuation, groupings and full ranges keep it."""
    cleaned = clean_code(code)
    bare = F.when(cleaned.rlike(f"^{TOKEN}-{TOKEN}$"), cleaned).otherwise(F.regexp_replace(cleaned, "[^A-Z0-9]", ""))
    return bare if level is None else F.when(level.isNotNull() & ~is_classification(level), cleaned).otherwise(bare)


def record_key(level: Column, code: Column, fallback: Column) -> Column:
    """``LEVEL:code``, or ``LEVEL:#n`` for a record without code."""
    head = F.coalesce(level, F.lit("UNKNOWN"))
    return F.when(F.coalesce(code, F.lit("")) != "", F.concat(head, F.lit(":"), normalize_code(code, level))).otherwise(F.concat(head, F.lit(":#"), fallback.cast("string")))


def ranges(text: Column) -> Column:
    """``start-end`` of the ranges written in a text, in order."""
    plain = plain_dashes(text)
    starts, ends = (F.regexp_extract_all(plain, F.lit(RANGE), F.lit(g)) for g in (1, 2))
    return F.zip_with(starts, ends, lambda a, b: F.concat(a, F.lit("-"), b))


def references(text: Column) -> Column:
    """The distinct single codes written in a text outside ranges, in order."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(plain_dashes(text), RANGE, " "), F.lit(REFERENCE), F.lit(1)))


def all_references(text: Column) -> Column:
    return F.concat(references(text), ranges(text))


def single_target(text: Column) -> Column:
    """The code of a text that has exactly one and no range; else null."""
    found = references(text)
    return F.when((F.size(found) == 1) & (F.size(ranges(text)) == 0), F.get(found, F.lit(0)))


def range_bounds(code: Column) -> Column:
    """Struct of ``low`` and ``high`` of a code that is a range; else null."""
    cleaned = clean_code(code)
    part = lambda g: F.regexp_extract(cleaned, f"^({TOKEN})-({TOKEN})$", g)
    return F.when(cleaned.rlike(f"^{TOKEN}-{TOKEN}$"), F.struct(part(1).alias("low"), part(2).alias("high")))


def sort_key(code: Column) -> Column:
    """Struct of letter and number; a code of another shape is its own letter, with number 0."""
    bare, shape = normalize_code(code), "^([A-Z])([0-9]{2})"
    fits = bare.rlike(shape)
    letter = F.when(fits, F.regexp_extract(bare, shape, 1)).otherwise(code)
    return F.struct(letter.alias("letter"), F.when(fits, F.regexp_extract(bare, shape, 2).cast("int")).otherwise(F.lit(0)).alias("number"))


def in_range(code: Column, low: Column, high: Column) -> Column:
    key = sort_key(code)
    return (sort_key(low) <= key) & (key <= sort_key(high))


def truncations(code: Column) -> Column:
    """Codes that a code extends, nearest first: ``A00.10`` -> ``A00.1``, ``A00``."""
    cleaned = clean_code(code)
    dot = F.instr(cleaned, ".")
    lengths = F.when(F.length(cleaned) - dot > 1, F.sequence(F.length(cleaned) - 1, dot + 1, F.lit(-1))).otherwise(F.array().cast("array<int>"))
    longer = F.transform(lengths, lambda n: F.substring(cleaned, F.lit(1), n))
    return F.when(dot > 0, F.concat(longer, F.array(F.substring(cleaned, F.lit(1), dot - 1)))).otherwise(F.array().cast("array<string>"))


def level_from_shape(code: Column) -> Column:
    suffix = F.length(clean_code(code)) - F.instr(clean_code(code), ".")
    return F.when(F.instr(clean_code(code), ".") == 0, F.lit("CATEGORY")).when(suffix == 1, F.lit("SUBCATEGORY")).otherwise(F.lit("CODE"))


def looks_like_code(text: Column) -> Column:
    return clean_code(text).rlike(rf"^{TOKEN}(?:\.-|-)?$")
