"""Quality rules with thresholds that follow the data.

One pass measures every text.  Mergeable KLL sketches of each measure are built per language and
source, and merged by language and over all.  A group's fences are the mean of its own and its language's,
weighted by its documents against ``PRIOR``, and its language's likewise with those of all, so they pass to
the group's own smoothly as it grows, with no size from which a verdict turns.  A measure's fence lies beyond the upper (or lower) quartile by ``SPREADS`` interquartile
ranges, or by the least margin of the measure where that is more, so a group whose texts are all alike
loses none.  The documents are joined with their group's fences and filtered.

The fences are a table with one row for each language and source.  It joins as any table: broadcast
only if the runtime finds it small, otherwise by a shuffle whose hot keys adaptive execution splits.

Defined cases: a null text has no words and fails the base rules; null languages or sources are a group
of their own; a text without words has ratios of 0; repeated rows get equal verdicts; an empty table
gives no rows.  Columns besides those asked for are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut
from .batches import slices

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"
#: Base rules: fewest words, most repeated words in a hundred.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Documents of a group at which its own fences weigh as much as those of the larger group.
PRIOR = 200
SPREADS = 4.0
#: Measure -> (upper fence's least margin, lower fence's or none).
MARGINS: dict[str, tuple[float, float | None]] = {"symbol_ratio": (0.04, None), "dup_line_ratio": (0.4, None), "repeat_ratio": (0.25, None), "mean_word": (3.0, 2.0)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Sequence[bytes]) -> int:
    """Words in windows of three that the text has twice or more, the first included."""
    if len(words) < 4:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    if len(codes) < 1 << 21:
        keys = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:
        pairs = np.unique(ids[:-2] * len(codes) + ids[1:-1], return_inverse=True)[1].astype(np.int64)
        keys = pairs * len(codes) + ids[2:]
    order = np.argsort(keys, kind="stable")
    equal = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:]] = equal
    twice[order[:-1]] |= equal
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(ids) - 2 + shift] |= twice
    return int(covered.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of a text."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return (len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words))


def measure(documents: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id", "lang", "source")) -> DataFrame:
    """The ``carry`` columns with ``COUNTS`` of every row."""
    kept = [documents.schema[c] for c in carry]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    n, names = len(kept), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            rows = np.array([counts(x) for x in batch.column(n).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(rows[:, j]) for j in range(len(COUNTS)))], names=names)

    return documents.select(*carry, F.col(text).alias("_text")).mapInArrow(run, schema)


def ratios(measured: DataFrame) -> DataFrame:
    """``measured`` with the measures of ``MARGINS``."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return measured.withColumns(
        {"symbol_ratio": share("n_symbols", "word_chars"), "dup_line_ratio": share("n_dup_lines", "n_lines"), "repeat_ratio": share("n_repeat_words", "n_words"), "mean_word": share("word_chars", "n_words")}
    )


def _fences(sketches: dict[str, Column]) -> list[Column]:
    out = []
    for name, (above, below) in MARGINS.items():
        # an empty sketch, of an empty table, has no quantile; its fences are null
        q = lambda p, s=sketches[name]: F.when(F.kll_sketch_get_n_double(s) > 0, F.kll_sketch_get_quantile_double(s, F.lit(p)))
        spread = (q(0.75) - q(0.25)) * SPREADS
        out.append((q(0.75) + F.greatest(spread, F.lit(above))).alias(f"{name}_most"))
        out.append((q(0.25) - F.greatest(spread, F.lit(below)) if below is not None else F.lit(float("-inf"))).alias(f"{name}_least"))
    return out


def fences(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row for each language and source: ``_lang``, ``_source`` and the fences of each measure.

    Documents that fail the base rules do not count.
    """
    rows = ratios(measured.where(~base_failed()))
    keys = [F.col(lang).alias("_lang"), F.col(source).alias("_source")]
    sketched = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.kll_sketch_agg_double(m).alias(m) for m in MARGINS))
    merged = [F.kll_merge_agg_double(m).alias(m) for m in MARGINS]
    by_lang = sketched.groupBy(F.col("_lang").alias("_l")).agg(F.sum("_n").alias("_ln"), *merged)
    by_lang = by_lang.select("_l", "_ln", F.struct(*_fences({m: F.col(m) for m in MARGINS})).alias("_of_lang"))
    overall = sketched.agg(*merged).select(F.struct(*_fences({m: F.col(m) for m in MARGINS})).alias("_of_all"))
    own = sketched.select("_lang", "_source", "_n", F.struct(*_fences({m: F.col(m) for m in MARGINS})).alias("_own"))
    # one row, so the join cannot multiply
    chosen = own.join(by_lang, F.col("_lang").eqNullSafe(F.col("_l")), "left").join(F.broadcast(overall), F.lit(True), "left")
    weight = lambda n: F.col(n) / (F.col(n) + F.lit(float(PRIOR)))

    def blended(name: str) -> Column:
        of_lang = weight("_ln") * F.col(f"_of_lang.{name}") + (1 - weight("_ln")) * F.col(f"_of_all.{name}")
        return (weight("_n") * F.col(f"_own.{name}") + (1 - weight("_n")) * of_lang).alias(name)

    return chosen.select("_lang", "_source", *(blended(f"{m}_{end}") for m in MARGINS for end in ("most", "least")))


def base_failed() -> Column:
    """The fixed rules: too few words, or too many in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)


def judge(documents: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), lang: str = "lang", source: str = "source") -> DataFrame:
    """The ``carry`` columns, the counts, the measures, ``base_failed`` and ``kept`` of every row."""
    columns = list(dict.fromkeys([*carry, lang, source]))
    measured = cut(measure(documents, text, columns), "quality")
    limits = fences(measured, lang, source)
    joined = ratios(measured).join(limits, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for m in MARGINS:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"{m}_least"), F.col(f"{m}_most")), F.lit(True))
    return joined.select(*carry, *COUNTS, *MARGINS, base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"))
