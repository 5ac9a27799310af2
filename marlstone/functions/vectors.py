"""Vectors: distances as expressions, normalising, and the hashing embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import local

DISTANCES = ("cosine", "l2", "inner_product")
DIMENSION = 256


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(a: Column, b: Column, distance: str = "cosine") -> Column:
    """1 - cosine distance, 1 / (1 + Euclidean distance), or the inner product."""
    if distance == "cosine":
        return dot(a, b) / (norm(a) * norm(b))
    if distance == "l2":
        gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
        return F.lit(1.0) / (F.lit(1.0) + norm(gap))
    if distance == "inner_product":
        return dot(a, b)
    raise ValueError(f"no such distance: {distance}")


def l2_normalise(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(a.cast("array<double>"))


def is_finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


# Prefix and weight of each kind of feature.
FEATURE_WEIGHTS = {"w:": 1.0, "b:": 0.7, "c:": 0.3}


def features(text: str) -> Iterator[tuple[str, float]]:
    """Words, neighbouring words joined by ``_``, and trigrams of words between ``#``, of the normalised text."""
    words = local.tokens(text)
    grams = ("#" + w + "#" for w in words)
    kinds = {"w:": words, "b:": map("_".join, zip(words, words[1:])), "c:": (g[i : i + 3] for g in grams for i in range(len(g) - 2))}
    for prefix, names in kinds.items():
        for name in names:
            yield prefix + name, FEATURE_WEIGHTS[prefix]


def hash_embedding(text: str, dimension: int = DIMENSION) -> np.ndarray:
    """Signed feature hashing at length 1: of a feature's BLAKE2b-64 digest, big-endian, bit 0 is the sign and the rest the bucket."""
    out = np.zeros(dimension)
    for name, weight in features(text):
        bucket, positive = divmod(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big"), 2)
        out[bucket % dimension] += weight if positive else -weight
    length = np.linalg.norm(out)
    return out / length if length else out


def embed(dimension: int = DIMENSION):
    """Column function: the hashing embedding of a text; Spark has no BLAKE2b."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_embedding(t or "", dimension).tolist())

    return run


#: Bytes of the query vectors of one broadcast, which each partition of the documents is compared with.
QUERY_BYTES = 16 << 20
#: Documents and queries of one matrix product: a task holds a few matrices of this size, whatever the batch and the block.
TILE_ROWS, TILE_QUERIES = 2_048, 256


def _compared(own: np.ndarray, asked: np.ndarray, distance: str) -> np.ndarray:
    """Similarity to six places, a row for each query."""
    found = asked @ own.T
    if distance == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            found /= np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(own, axis=1)
    elif distance == "l2":
        found *= -2
        found += (asked * asked).sum(axis=1)[:, None] + (own * own).sum(axis=1)
        found = 1 / (1 + np.sqrt(np.maximum(found, 0, out=found), out=found))
    return np.round(found, 6, out=found)


class _Nearest:
    """The k nearest documents so far of each query of a block, ties to the smaller key."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, distance: str) -> None:
        self.ids, self.matrix, self.k, self.distance = ids, matrix, k, distance
        self.scores: np.ndarray = np.full((len(ids), k), -np.inf)
        self.keys: np.ndarray = np.zeros((len(ids), k), np.int64)
        self.there: np.ndarray = np.zeros((len(ids), k), bool)

    def add(self, keys: np.ndarray, own: np.ndarray) -> None:
        for a in range(0, len(keys), TILE_ROWS):
            for b in range(0, len(self.ids), TILE_QUERIES):
                rows, some = slice(b, b + TILE_QUERIES), slice(a, a + TILE_ROWS)
                found = _compared(own[some], self.matrix[rows], self.distance)
                # NaN, of a vector without length, comes last
                found[np.isnan(found)] = -np.inf
                self._merge(rows, keys[some], found)

    def _merge(self, rows: slice, keys: np.ndarray, found: np.ndarray) -> None:
        k, n = self.k, found.shape[1]
        worst, last, full = self.scores[rows, -1:], self.keys[rows, -1:], self.there[rows, -1:]
        better = ~full | (found > worst) | ((found == worst) & (keys < last))
        if n > k and np.count_nonzero(better) > 4 * k * len(found):
            better &= found >= np.partition(found, n - k, axis=1)[:, n - k, None]
        q, d = np.nonzero(better)
        if not len(q):
            return
        old_q, old_d = np.nonzero(self.there[rows])
        q, scores, named = np.concatenate([old_q, q]), np.concatenate([self.scores[rows][old_q, old_d], found[q, d]]), np.concatenate([self.keys[rows][old_q, old_d], keys[d]])
        order = np.lexsort((named, -scores, q))
        q, scores, named = q[order], scores[order], named[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < k
        q, place = q[kept] + rows.start, place[kept]
        self.scores[q, place], self.keys[q, place], self.there[q, place] = scores[kept], named[kept], True

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query ids, keys and scores, some thousand queries at a time."""
        for b in range(0, len(self.ids), 4_096):
            q, place = np.nonzero(self.there[b : b + 4_096])
            yield self.ids[q + b], self.keys[q + b, place], self.scores[q + b, place]


def top_k(documents: DataFrame, queries: DataFrame, k: int, distance: str = "cosine", key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """``query_key``, ``key``, ``similarity`` (six places) and ``place`` of the k nearest documents of each query, exactly.

    Queries (``query_key``, ``vector``) go out in blocks of ``QUERY_BYTES``; a task compares its documents with a block
    by tiles and keeps k rows a query, so neither its memory nor what is shuffled grows with the documents of a batch or
    a task.  Ties go to the smaller key.  A query's vectors of another length than a document's are an error.
    """
    from pyspark.sql import Window as W

    if distance not in DISTANCES:
        raise ValueError(f"no such distance: {distance}")
    spark, schema = documents.sparkSession, f"{query_key} long, {key} long, similarity double"
    parts, held = [], []

    def compare(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for batch in batches:
                if len(batch):
                    best = best or _Nearest(*shared.value, k, distance)
                    for a in range(0, len(batch), TILE_ROWS):
                        some = batch.iloc[a : a + TILE_ROWS]
                        best.add(some[key].to_numpy(), np.stack(some[vector].to_numpy()).astype(np.float64))
            for ids, keys, scores in best.rows() if best else ():
                yield pd.DataFrame({query_key: ids, key: keys, "similarity": np.where(np.isneginf(scores), np.nan, scores)})

        return run

    def flush() -> None:
        block = (np.array([r[0] for r in held]), np.stack([r[1] for r in held]))
        parts.append(documents.select(key, vector).where(F.col(vector).isNotNull()).mapInPandas(compare(spark.sparkContext.broadcast(block)), schema))
        held.clear()

    for row in queries.select(query_key, vector).where(F.col(vector).isNotNull()).toLocalIterator():
        held.append((row[0], np.array(row[1], np.float64)))
        if len(held) * held[0][1].nbytes >= QUERY_BYTES:
            flush()
    if held:
        flush()
    if not parts:
        return spark.createDataFrame([], schema + ", place int")
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    order = W.partitionBy(query_key).orderBy(F.desc("similarity"), F.asc(key))
    return merged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).withColumn("similarity", F.round("similarity", 6))
