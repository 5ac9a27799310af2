"""Benchmark decontamination by SimHash over item-sized windows.

Each benchmark item is a run of words; its fingerprint is the SimHash of its shingles of ``SHINGLE``
words, repeats included (a shorter item is one shingle).  In each document the windows with as many
words as an item get fingerprints from running sums of the shingles' bits.  Fingerprints of items are
indexed by four blocks of 16 bits: of two fingerprints within ``RADIUS`` bits one block differs in
``RADIUS // 4`` bits at most, so probing all blocks finds every item within the radius.  Each candidate
is then verified exactly: weighted Jaccard similarity of the two multisets of shingles, at least
``SIMILARITY``.

A window without any shingle of an item cannot pass, so only windows that overlap a shared shingle are
fingerprinted, in sizes of the items that have such a shingle there; this drops no match.

The benchmark is the stated query set, held against all rows in blocks of at most ``BLOCK_WORDS`` words,
each broadcast (a few dozen bytes a word); it is not a corpus and grows with no table.  Documents are
neither shuffled nor joined.

A text shorter than an item is one window itself, and is verified against every item of that length if
enough of its shingles are in such items for the similarity; this misses none.

SimHash misses a pair whose fingerprints differ in more than the radius.  At similarity 0.8 two
fingerprints differ in 9.7 bits on average with a deviation of 2.9, so 22 bits are over four deviations.

Defined cases: null or empty texts match nothing; items without a word or null items are never matched;
equal items are reported each; of several windows the most similar one counts, then the first; repeated
rows give repeated results; columns besides those asked for are not carried.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .batches import lower_words, slices

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 22
BLOCK_WORDS = 2_000_000
#: Words of a document whose windows are fingerprinted at a time.
REGION_WORDS = 1 << 14
#: Bytes of index answers that the items of one length keep.
NEAR_BYTES = 8 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(words: Sequence[bytes], size: int) -> np.ndarray:
    """Hash of each shingle of ``size`` words."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(words[i : i + size])) for i in range(len(words) - size + 1)), np.uint64, max(0, len(words) - size + 1))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _pack(sums: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints from rows of 64 sums over ``n`` hashes each."""
    return np.packbits(sums * 2 > n, axis=1, bitorder="little").view("<u8").ravel()


class Items:
    """Items of one length in words, with the fingerprint index."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.size = min(length, SHINGLE)
        self.ids: list = []
        self.shingles: list[Counter] = []
        self.fps = np.empty(0, np.uint64)
        self.near: dict[tuple[int, int], np.ndarray] = {}
        self.near_bytes = 0

    def add(self, item: object, words: Sequence[bytes]) -> None:
        self.ids.append(item)
        hashes = _hashes(words, self.size)
        self.shingles.append(Counter(hashes.tolist()))
        self.fps = np.append(self.fps, _pack(_bits(hashes).sum(axis=0, dtype=np.int64)[None, :], len(hashes)))

    def within(self, fp: int) -> np.ndarray:
        """Places of the items within the radius: those near in some block, then compared in full."""
        found = []
        for block in range(4):
            value = fp >> (16 * block) & 0xFFFF
            places = self.near.get((block, value))
            if places is None:
                own = (self.fps >> np.uint64(16 * block)) & np.uint64(0xFFFF)
                places = np.flatnonzero(np.bitwise_count(own ^ np.uint64(value)) <= RADIUS // 4).astype(np.int32)
                self.near_bytes += places.nbytes + 200
                if self.near_bytes > NEAR_BYTES:
                    self.near.clear()
                    self.near_bytes = places.nbytes + 200
                self.near[block, value] = places
            found.append(places)
        places = np.unique(np.concatenate(found))
        return places[np.bitwise_count(self.fps[places] ^ np.uint64(fp)) <= RADIUS]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    common = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return common / (a.total() + b.total() - common)


class Index:
    """A block of the benchmark."""

    def __init__(self, items: Sequence[tuple[int, str]]) -> None:
        self.codes: dict[bytes, int] = {}
        self.of_length: dict[int, Items] = {}
        rows = [(item, words) for item, text in items if (words := lower_words(text))]
        for item, words in rows:
            self.of_length.setdefault(len(words), Items(len(words))).add(item, words)
            for w in words:
                self.codes.setdefault(w, len(self.codes) + 1)
        #: Shingle size -> sorted keys, and for each key the lengths of the items that have it.
        self.keys: dict[int, np.ndarray] = {}
        self.lengths: dict[int, list[tuple[int, ...]]] = {}
        by_size: dict[int, dict[int, set[int]]] = {}
        for _, words in rows:
            size = min(len(words), SHINGLE)
            for key in self.shingle_keys(self.encode(words), size)[0].tolist():
                by_size.setdefault(size, {}).setdefault(key, set()).add(len(words))
        for size, found in by_size.items():
            self.keys[size] = np.array(sorted(found), np.uint64)
            self.lengths[size] = [tuple(sorted(found[k])) for k in sorted(found)]

    def encode(self, words: Sequence[bytes]) -> np.ndarray:
        get = self.codes.get
        return np.fromiter((get(w, 0) for w in words), np.uint64, len(words))

    @staticmethod
    def shingle_keys(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the shingles of which each word is known, and their places."""
        n = len(codes) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        known = codes > 0
        whole = known[:n].copy()
        for i in range(1, size):
            whole &= known[i : i + n]
        at = np.flatnonzero(whole)
        key = np.zeros(len(at), np.uint64)
        for i in range(size):
            key = (key ^ codes[at + i]) * _MIX
            key ^= key >> np.uint64(29)
        return key, at

    def shared(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """Length of items -> places in the text of shingles that such an item has."""
        out: dict[int, list[int]] = {}
        for size, keys in self.keys.items():
            found, at = self.shingle_keys(codes, size)
            if not len(found):
                continue
            place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            hit = keys[place] == found
            for p, a in zip(place[hit].tolist(), at[hit].tolist(), strict=True):
                for length in self.lengths[size][p]:
                    out.setdefault(length, []).append(a)
        return {k: np.array(v) for k, v in out.items()}

    def search(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """Item, similarity, first word and number of words for each item that the text has."""
        words = lower_words(text)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for length, places in self.shared(self.encode(words)).items() if words else ():
            items = self.of_length[length]
            last = len(words) - length  # the last start of a window
            if last < 0:
                self._whole(items, words, len(places), best)
                continue
            # windows that overlap a shared shingle, as runs of starts
            low = np.maximum(places + items.size - length, 0)
            high = np.minimum(places, last)
            order = np.argsort(low, kind="stable")
            low, high = low[order], np.maximum.accumulate(high[order])
            new = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1] + 1)))
            for first, end in zip(low[new].tolist(), high[np.append(new[1:] - 1, len(high) - 1)].tolist(), strict=True):
                for start in range(first, end + 1, REGION_WORDS):
                    self._windows(items, words, start, min(end, start + REGION_WORDS - 1), best)
        ids = self.of_length
        return sorted((ids[length].ids[place], s, -at, min(length, len(words))) for (length, place), (s, at) in best.items())

    @staticmethod
    def _whole(items: Items, words: list[bytes], known: int, best: dict) -> None:
        """The whole text as the window, where it is shorter than the items; ``known`` of its shingles are in one of them."""
        if known < SIMILARITY * (items.length - items.size + 1):
            return
        own = Counter(_hashes(words, items.size).tolist())
        for place, shingles in enumerate(items.shingles):
            found = similarity(own, shingles)
            if found >= SIMILARITY:
                best[items.length, place] = (found, 0)

    @staticmethod
    def _windows(items: Items, words: list[bytes], first: int, last: int, best: dict) -> None:
        """Windows with starts from ``first`` to ``last``."""
        per = items.length - items.size + 1
        hashes = _hashes(words[first : last + items.length], items.size)
        sums = np.zeros((len(hashes) + 1, 64), np.int32)
        np.cumsum(_bits(hashes), axis=0, out=sums[1:])
        fps = _pack(sums[per:] - sums[:-per], per)
        for i, fp in enumerate(fps.tolist()):
            for place in items.within(fp).tolist():
                own = similarity(Counter(hashes[i : i + per].tolist()), items.shingles[place])
                if own >= SIMILARITY:
                    key = (items.length, place)
                    best[key] = max(best.get(key, (0.0, 0)), (own, -(first + i)))


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", words: int = BLOCK_WORDS) -> Iterator[Index]:
    """The benchmark, a block at a time, in the order of its items."""
    held, n = [], 0
    for row in benchmark.select(item, text).where(F.col(text).isNotNull() & F.col(item).isNotNull()).orderBy(item, text).toLocalIterator():
        held.append((row[0], row[1]))
        n += row[1].count(" ") + 1
        if n >= words:
            yield Index(held)
            held, n = [], 0
    if held:
        yield Index(held)


def matches(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """``key``, ``item_id``, ``similarity``, ``start`` and ``n_words`` (in words, of the most similar window) for each document and item that it has.

    Ids are of any type; a ``key`` that is named like one of the other columns comes as ``key_`` and that name.
    """
    spark = documents.sparkSession
    found_there = (("item_id", benchmark.schema[item].dataType), ("similarity", T.DoubleType()), ("start", T.LongType()), ("n_words", T.LongType()))
    name = f"key_{key}" if key in dict(found_there) else key
    schema = T.StructType([T.StructField(name, documents.schema[key].dataType), *(T.StructField(n, t) for n, t in found_there)])
    of_item = to_arrow_type(benchmark.schema[item].dataType)
    rows, out = documents.select(F.col(key).alias(name), F.col(text).alias("_text")), None

    def searching(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "_text"):
                found = [(i, *m) for i, t in enumerate(batch.column(1).to_pylist()) for m in shared.value.search(t)]
                if found:
                    at, items, similar, start, n = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(items, of_item), pa.array(similar, pa.float64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())], names=schema.names)

        return run

    for index in blocks(benchmark, item):
        found = rows.mapInArrow(searching(spark.sparkContext.broadcast(index)), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def without(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``documents`` that have no item, with all columns."""
    spark, names = documents.sparkSession, documents.columns
    at = names.index(text)

    def sifting(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                clean = [not shared.value.search(t) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    out = documents
    for index in blocks(benchmark):
        out = out.mapInArrow(sifting(spark.sparkContext.broadcast(index)), documents.schema)
    return out
