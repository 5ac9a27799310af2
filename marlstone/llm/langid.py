"""Language identification by multilingual mixture inference.

A text is a bag of n-grams (one to three lower-cased letters, with word edges), each hashed into one of
``BUCKETS`` classes.  Training counts the classes by language over all training rows; the counts are
summed per task before the shuffle.  The model, smoothed log-likelihoods of languages x buckets, has a
size fixed by ``BUCKETS`` and ``MAX_LANGUAGES`` (at most 64 MB) and is broadcast.

For each document expectation-maximisation estimates the proportions of the languages from the n-gram
likelihoods.  The language set is chosen by penalised likelihood: from the languages of the full mixture
the smallest is dropped as long as the loss in log-likelihood is below the penalty of a language
(half the logarithm of the number of n-grams, times ``PENALTY``, as neighbouring n-grams overlap).
The prediction is the language with the largest proportion in that set; its proportion is the score.

Defined cases: null texts and texts without a letter are ``und`` with score 0; with no training rows
every text is ``und``; ties go to the language first in the alphabet; language, source and id of a row
are never inputs of its prediction; columns besides those asked for are not carried.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices

UNDETERMINED = "und"
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
MAX_LANGUAGES = 128
SMOOTHING = 0.05
EM_ROUNDS = 12
PENALTY = 8.0
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if unicodedata.category(c)[0] == "L":
            table[point] = ord(c.lower()[0])
    return table


def grams(text: str | None) -> np.ndarray:
    """The buckets of all n-grams of a text; empty if it has no letter."""
    if not text:
        return np.empty(0, np.uint32)
    points = letters()[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    word = points > 0
    if not word.any():
        return np.empty(0, np.uint32)
    line = np.zeros(len(points) + 2, np.uint64)  # 0 marks an edge
    line[1:-1] = points
    held = np.zeros(len(line), bool)
    held[1:-1] = word
    with np.errstate(over="ignore"):
        one = line * _MIX[0]
        two = (line[:-1] * _MIX[1]) ^ (one[1:] + np.uint64(2))
        three = (line[:-2] * _MIX[2]) ^ (two[1:] * _MIX[0])
        # pairs with a letter on either side, triples with one in the middle
        keys = np.concatenate((one[held], two[held[:-1] | held[1:]], three[held[1:-1]]))
        return ((keys * _MIX[1]) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32)


def held_out(key: Column) -> Column:
    """Whether a row is kept from training: the checksum of its id, as text, leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def count(rows: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang``, ``bucket`` and ``n`` over all rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "_text"):
            langs = np.array(batch.column(1).to_pylist(), object)
            texts = batch.column(0).to_pylist()
            for name in set(langs):
                own = np.concatenate([grams(texts[i]) for i in np.flatnonzero(langs == name)])
                if name not in sums:
                    sums[name] = np.zeros(BUCKETS, np.int64)
                sums[name] += np.bincount(own, minlength=BUCKETS)
        for name, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(found[at])], names=["lang", "bucket", "n"])

    partial = rows.select(F.col(text).alias("_text"), F.col(lang).alias("_lang")).where("_lang is not null and _text is not null")
    return partial.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages, and the log-likelihood of each bucket (rows) in each language (columns)."""
    names = sorted(r[0] for r in rows.where(F.col(lang).isNotNull()).select(lang).distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    place = {x: i for i, x in enumerate(names)}
    counts = np.zeros((BUCKETS, max(1, len(names))))
    found = count(rows, text, lang).toArrow()  # at most BUCKETS rows a language, whatever the corpus
    if found.num_rows:
        columns = np.array([place[x] for x in found.column("lang").to_pylist()])
        counts[found.column("bucket").to_numpy(), columns] = found.column("n").to_numpy()
    counts += SMOOTHING
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _mixture(likely: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions, and the log-likelihood, after the rounds; ``likely``: n-grams x languages."""
    total = n.sum()
    for _ in range(EM_ROUNDS):
        weighted = likely * share
        share = (n / weighted.sum(axis=1)) @ weighted / total
    return share, float(n @ np.log((likely * share).sum(axis=1)))


def infer(buckets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Proportions of the languages, 0 for those outside the chosen set.  ``table``: as from :func:`train`."""
    found, n = np.unique(buckets, return_counts=True)
    logs = table[found].astype(np.float64)
    likely = np.exp(logs - logs.max(axis=1, keepdims=True))
    width = table.shape[1]
    chosen = np.arange(width)
    share, fit = _mixture(likely, n, np.full(width, 1 / width))
    penalty = PENALTY * np.log(n.sum() + 1) / 2
    alone = n @ np.log(np.maximum(likely, 1e-300))
    if fit - alone.max() < penalty:  # one language explains the text
        out = np.zeros(width)
        out[int(alone.argmax())] = 1.0
        return out
    while len(chosen) > 1:
        rest = np.delete(np.arange(len(chosen)), int(share.argmin()))
        less, worse = _mixture(likely[:, chosen[rest]], n, share[rest] / share[rest].sum() if share[rest].sum() > 0 else np.full(len(rest), 1 / len(rest)))
        if fit - worse >= penalty:
            break
        chosen, share, fit = chosen[rest], less, worse
    out = np.zeros(width)
    out[chosen] = share
    return out


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns (``text`` may be one), ``lang_pred``, ``score`` and ``shares`` (language -> proportion, of the chosen set) of every row."""
    names, table = model
    shared = documents.sparkSession.sparkContext.broadcast(table)
    kept = [documents.schema[c] for c in carry]
    schema = T.StructType(
        [*(T.StructField(f.name, f.dataType) for f in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("shares", T.MapType(T.StringType(), T.DoubleType()))]
    )
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            langs, scores, shares = [], [], []
            for text in batch.column(n).to_pylist():
                found = grams(text)
                if not len(found) or not names:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    shares.append([])
                    continue
                share = infer(found, shared.value)
                best = int(share.argmax())
                langs.append(names[best])
                scores.append(min(1.0, float(share[best])))
                shares.append([(names[i], float(share[i])) for i in np.flatnonzero(share)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))], names=schema.names)

    return documents.select(*carry, F.col(text).alias("_text")).mapInArrow(run, schema)
