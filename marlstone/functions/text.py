"""Text normalisation as column expressions: accents, case, tokens, stems, trigrams."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stemming import ENGLISH_STOPWORDS, english

#: Text-search configuration by language, fixed values; every other language has ``simple``.
TS_CONFIGS = {"en": "english", "fr": "french", "de": "german", "es": "spanish", "pt": "portuguese"}


def once(body: Callable[..., Column], *values: Column) -> Column:
    """``body(*values)`` with each value computed once a row: Spark puts a column's whole expression at each of its uses."""
    held = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    return F.element_at(F.transform(F.array(held), lambda h: body(*(h[f"v{i}"] for i in range(len(values))))), 1)


@cache
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters of the basic plane that decompose to ASCII: those with one letter each, then the others."""
    single, several = {}, []
    for point in range(0x80, 0x10000):
        c = chr(point)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        base = "".join(x if x.isascii() else " " for x in base) if base != c else c
        if base != c and any(x.isalnum() for x in base):
            if len(base) == 1:
                single[c] = base
            else:
                several.append((c, base))
    return "".join(single), "".join(single.values()), tuple(several)


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition without combining marks, for letters that become ASCII.

    What decomposes to other scripts stays as it is, and a part that is not ASCII becomes a blank;
    :func:`normalize_text` blanks both anyway.
    """
    sources, targets, several = _folds()
    # ligatures, squared units and the like are rare; only texts with a character of their neighbourhoods are walked
    pairs = F.split(F.lit("\n".join(c + base for c, base in several)), "\n")
    spelled = F.aggregate(pairs, text, lambda done, p: F.replace(done, F.substring(p, 1, 1), F.substring(p, F.lit(2), F.length(p))))
    whole = F.when(text.rlike(_neighbourhoods("".join(c for c, _ in several))), spelled).otherwise(text)
    # most texts are ASCII, and then nothing of this is done
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(F.translate(whole, sources, targets), r"\p{Mn}+", ""))


def _neighbourhoods(characters: str, gap: int = 24) -> str:
    """A class of few ranges that holds all the characters: a long class of single ones is slow to match."""
    points, spans = sorted(map(ord, characters)), []
    for p in points:
        if spans and p - spans[-1][1] <= gap:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


def normalize_text(text: Column) -> Column:
    """Lower-case, free of accents, with single blanks for everything but ASCII letters and digits."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(text)), "[^0-9a-z]+", " "))


def words(normalized: Column) -> Column:
    """The words of a text of :func:`normalize_text`, in order."""
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def tokens(text: Column) -> Column:
    """The words of :func:`normalize_text`, in order."""
    return words(normalize_text(text))


def stem(token: Column) -> Column:
    """``ies`` -> ``y``, ``es`` and ``s`` dropped, where three letters stay."""
    n = F.length(token)
    return (
        F.when(token.endswith("ies") & (n >= 6), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y")))
        .when(token.endswith("es") & (n >= 5), F.substring(token, F.lit(1), n - 2))
        .when(token.endswith("s") & (n >= 4), F.substring(token, F.lit(1), n - 1))
        .otherwise(token)
    )


def stems(text: Column) -> Column:
    """The distinct stems of a text."""
    return F.array_distinct(F.transform(tokens(text), stem))


def lexemes(text: Column, config: str = "simple") -> Column:
    """The words of :func:`tokens`; with ``english`` their stems, without its stopwords."""
    if config != "english":
        return tokens(text)
    kept = F.filter(tokens(text), lambda t: ~t.isin(*ENGLISH_STOPWORDS))
    return english_stems(kept)


@F.pandas_udf(T.ArrayType(T.StringType()))
def english_stems(words: pd.Series) -> pd.Series:
    """:func:`stemming.english` of arrays of words; the rules depend on what earlier ones left, which no built-in can say."""
    return words.map(lambda own: None if own is None else [english(w) for w in own])


def ts_config(language: Column) -> Column:
    """Text-search configuration of a language tag (``en-CA`` -> ``english``)."""
    pairs = [F.lit(x) for pair in TS_CONFIGS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.split(language, "-")[0])), F.lit("simple"))


def trigrams(text: Column) -> Column:
    """The set of trigrams of the lower-cased words, each padded by two blanks in front and one behind."""
    words = F.filter(F.split(F.lower(text), "[^0-9a-z\\p{L}]+"), lambda x: x != "")

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def similarity(a: Column, b: Column) -> Column:
    """Share of two trigram sets that they have in common; 0 where both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, common / (F.size(a) + F.size(b) - common)).otherwise(F.lit(0.0))


def _trigram_list(text: str) -> list[str]:
    words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    return [p[i : i + 3] for w in words for p in [f"  {w} "] for i in range(len(p) - 2)]


def extent_similarity(needle: str, hay: str) -> float:
    """Largest similarity of the needle's trigram set to a run of the other text's trigrams, in order."""
    want, line = set(_trigram_list(needle)), _trigram_list(hay)
    if not want or not line:
        return 0.0
    best, hits = 0.0, [i for i, g in enumerate(line) if g in want]
    for first in hits:  # a best run starts and ends with a shared trigram
        seen: set[str] = set()
        common = 0
        for last in range(first, len(line)):
            if line[last] not in seen:
                seen.add(line[last])
                common += line[last] in want
            if line[last] in want:
                best = max(best, common / (len(want) + len(seen) - common))
    return best


@F.pandas_udf(T.DoubleType())
def word_similarity(needle: pd.Series, hay: pd.Series) -> pd.Series:
    """:func:`extent_similarity` of two columns; there is no built-in scan over extents."""
    return pd.Series([extent_similarity(a or "", b or "") for a, b in zip(needle, hay, strict=True)])


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def content_hash(*parts: Column) -> Column:
    """SHA-256 of parts joined by line feeds."""
    return F.sha2(F.concat_ws("\n", *parts), 256)


def clean(value: Column) -> Column:
    """White space collapsed and trimmed; null for what is then empty."""
    return F.nullif(F.trim(F.regexp_replace(value.cast("string"), r"(?U)\s+", " ")), F.lit(""))


def clean_list(value: Column, separator: str = "|") -> Column:
    """The cleaned, non-empty parts of a cell with several values."""
    import re

    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(value, re.escape(separator)), clean), lambda x: x.isNotNull()))


def flag(value: Column) -> Column:
    """True and false words; null for the empty cell and any other."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin("1", "true", "t", "yes", "y", "x"), True).when(word.isin("0", "false", "f", "no", "n"), False)
