"""Language-model scores from a log-frequency Bloom filter.

Training counts words and pairs of neighbouring words over all training rows.  A task sums what it
reads, packs hashes and counts by segment of the hash, and only these packed blocks are shuffled, so a
word in every text costs a row a task.  There are as many segments as keep ``SEGMENT_BYTES`` of training
text in each, so what a task sums at a time does not grow with the corpus (up to ``MAX_SEGMENTS``).  A count
c is quantised to level 1 + floor(log2 c); an n-gram of level q goes into the filter once for each level up
to q, and a reader probes level 1, 2, ... until one is missing.  The filter has one part for each segment,
built where the segment's counts are, of ``BITS_AN_ENTRY`` bits for each insertion: it grows with the
insertions and errs alike at every size (a missing n-gram passes a level with a chance of 1.2 %).  All
pairs are inserted, those seen once at level 1.

A token's probability given the one before mixes the pair's share of its first word with the smoothed
share of the word, both from probes.  The base score takes exact counts of words instead, which each
segment keeps beside its part.

The parts are broadcast to the workers where they have ``MAX_FILTER_BYTES`` at most, and words
``MAX_TABLE_ENTRIES`` at most (12 bytes each).  Beyond, the same probes are made where the parts are: chunks
of texts, packed, are dealt once; each sends its distinct n-grams to the segments, salted by chunks, and
meets the answers where it lies, so the texts move once (:func:`asked`).  The scores are the same.

Words are compared by 64-bit hashes (among four million words two share one with a chance of 1 in two
million), pairs by 56 bits, in which a stranger is taken for one of a billion pairs with a chance of 1 in
70 million, far below what the filter errs.

Defined cases: null and empty texts have the end token only; with no training row all counts are 0 and
N is 0; repeated rows count each; columns besides those asked for are not carried, and names of carried
columns must differ from those of the results.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut
from .batches import lower_words, slices

#: Training text of a segment, and bounds of the number of segments (powers of two).
SEGMENT_BYTES, MIN_SEGMENTS, MAX_SEGMENTS = 16 << 20, 256, 1 << 14
#: Tokens that a task sums at a time.
FLUSH_TOKENS = 3_000_000
BITS_AN_ENTRY = 10
PROBES = 4
#: Bytes of the filter, and distinct words, up to which the model is broadcast.
MAX_FILTER_BYTES, MAX_TABLE_ENTRIES = 128 << 20, 8_000_000
#: Bytes of text that ask for their n-grams together, and text whose chunks ask one copy of a part, where the model is not broadcast.
CHUNK_BYTES, SALT_BYTES = 4 << 20, 100 << 30
MAX_LEVEL = 48
PAIR_WEIGHT = 0.4
#: Bits of the hashes of words (1) and pairs (2).
HASH_BITS = {1: 64, 2: 56}
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: The end token: the hash of what can be no word.
END = np.uint64(xxhash.xxh64_intdigest(b" "))


def held_out(key: Column) -> Column:
    """Whether a row is kept from training: the checksum of its id, as text, leaves 1 when divided by 5."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 1, F.lit(False))


def tokens(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts in a row, each text closed by ``END``, and the places where texts start."""
    digest, end = xxhash.xxh64_intdigest, int(END)
    flat: list[int] = []
    starts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        starts[i] = len(flat)
        flat += map(digest, lower_words(text))
        flat.append(end)
    return np.array(flat, np.uint64), starts


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def before(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The token before each; the end token before the first of a text."""
    out = np.empty_like(hashes)
    out[1:] = hashes[:-1]
    out[starts] = END
    return out


def pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _stir(first * _M3 + second) >> np.uint64(64 - HASH_BITS[2])


def segment_of(hashes: np.ndarray, order: int, segments: int) -> np.ndarray:
    """The highest bits of a hash."""
    return (hashes >> np.uint64(HASH_BITS[order] - segments.bit_length() + 1)).astype(np.int64)


def by_segment(hashes: np.ndarray, order: int, segments: int) -> list[int]:
    """Where each segment starts in ascending hashes, and the end."""
    return np.searchsorted(segment_of(hashes, order, segments), np.arange(segments + 1)).tolist()


def pack(hashes: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Ascending hashes as the first and the gaps, in as many bytes as the widest needs; then counts in 1, 4 or 8 bytes."""
    gaps = np.diff(hashes)
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    wide = 0 if counts is None else next(w for w in (1, 4, 8) if int(counts.max()) < 1 << 8 * w)
    body = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
    return struct.pack("<QBB", int(hashes[0]), width, wide) + body + (counts.astype(f"<u{wide}").tobytes() if wide else b"")


def unpack(block: bytes, n: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The ``n`` hashes of a block, and their counts."""
    first, width, wide = struct.unpack_from("<QBB", block)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[1:, :width] = np.frombuffer(block, np.uint8, (n - 1) * width, 10).reshape(n - 1, width)
    hashes = gaps.view("<u8").ravel()
    hashes[0] = first
    np.cumsum(hashes, out=hashes)
    return hashes, np.frombuffer(block, f"<u{wide}", n, 10 + (n - 1) * width).astype(np.int64) if wide else None


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, with the sums of their counts."""
    if not held:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    return hashes[first], np.add.reduceat(counts, first)


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c)."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], MAX_LEVEL)


#: What a level stands for: the middle of its counts; level 0 for none.
LEVEL_VALUES = np.array([0.0, 1.0, *(1.5 * 2.0 ** (q - 1) for q in range(2, MAX_LEVEL + 1))])


def _probes(hashes: np.ndarray, order: int, level: int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bit places, within its segment's part, of an n-gram at a level."""
    a = _stir(hashes + np.uint64((order * 64 + level) * int(_M3) & 0xFFFFFFFFFFFFFFFF))
    step = (a >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield ((a + np.uint64(k) * step) % np.uint64(bits) if isinstance(bits, int) else (a + np.uint64(k) * step) % bits).astype(np.int64)


def part_of(counted: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A segment's part of the filter, as bytes, from the hashes and counts of each order."""
    quantised = {order: levels(counts) for order, (_, counts) in counted.items()}
    bits = np.zeros(8 * max(8, math.ceil(sum(int(q.sum()) for q in quantised.values()) * BITS_AN_ENTRY / 8)), bool)
    for order, (hashes, _) in counted.items():
        for level in range(1, int(quantised[order].max(initial=0)) + 1):
            for place in _probes(hashes[quantised[order] >= level], order, level, len(bits)):
                bits[place] = True
    return np.packbits(bits, bitorder="little")


def read_levels(flat: np.ndarray, base: np.ndarray, bits: np.ndarray, hashes: np.ndarray, order: int) -> np.ndarray:
    """Levels by repeated probes of the parts with ``bits`` bits that start at the bytes ``base``; 0 where a part has none."""
    out = np.zeros(len(hashes), np.uint8)
    at = np.flatnonzero(bits)
    bits = bits.astype(np.uint64)
    for level in range(1, MAX_LEVEL + 1):
        held = np.ones(len(at), bool)
        for spot in _probes(hashes[at], order, level, bits[at]):
            held &= (flat[base[at] + (spot >> 3)] >> (spot & 7).astype(np.uint8)) & 1 > 0
        at = at[held]
        if not len(at):
            break
        out[at] = level
    return out


def exact_counts(words: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of words, 0 where ``keys``, which ascend, lack them."""
    if not len(keys):
        return np.zeros(len(words), np.int64)
    place = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
    return np.where(keys[place] == words, counts[place], 0).astype(np.int64)


class Ngrams:
    """The distinct words, with the end token, and pairs of texts, in order, and the place of each token's."""

    def __init__(self, texts: Sequence[str | None]) -> None:
        hashes, self.starts = tokens(texts)
        self.words, of_word = np.unique(np.append(hashes, END), return_inverse=True)
        self.pairs, self.of_pair = np.unique(pairs(before(hashes, self.starts), hashes), return_inverse=True)
        self.of_end, self.of_word = of_word[-1], of_word[:-1]


@dataclass
class Model:
    """What scoring needs.  The parts of the filter lie in ``flat``, and ``keys`` has the words; where these are too large ``table`` has both by segment."""

    segments: int
    tokens: int
    words: int
    flat: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    base: np.ndarray | None = None
    width: np.ndarray | None = None
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    table: DataFrame | None = None

    def level(self, hashes: np.ndarray, order: int) -> np.ndarray:
        """Quantised counts, by repeated probes."""
        place = segment_of(hashes, order, self.segments)
        return read_levels(self.flat, self.base[place], self.width[place] * 8, hashes, order)

    def shares(self) -> Model:
        """The model without its table."""
        return Model(self.segments, self.tokens, self.words, self.flat, self.base, self.width, self.keys, self.counts)

    def log10s(self, found: Ngrams, word_levels: np.ndarray, pair_levels: np.ndarray) -> np.ndarray:
        """log10 probability of each token given the one before."""
        counts = LEVEL_VALUES[word_levels]
        of_first = np.empty_like(found.of_word)
        of_first[1:] = found.of_word[:-1]
        of_first[found.starts] = found.of_end
        pair_counts = LEVEL_VALUES[pair_levels][found.of_pair]
        share = np.minimum(1.0, pair_counts / np.maximum(counts[of_first], np.maximum(pair_counts, 1.0)))
        smooth = (counts[found.of_word] + 0.5) / (self.tokens + 0.5 * (self.words + 1))
        return np.log10(np.minimum(1.0, PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * smooth))

    def results(self, found: Ngrams, word_levels: np.ndarray, pair_levels: np.ndarray, exact: np.ndarray) -> list[pa.Array]:
        """The columns of ``NUMBERS`` for each text."""
        starts, own = found.starts, exact[found.of_word]
        base = np.log10((own + 0.5) / (self.tokens + 0.5 * (self.words + 1)))
        sums = [np.diff(np.append(starts, len(own))), np.add.reduceat((own > 0).astype(np.int64), starts), np.full(len(starts), self.tokens, np.int64)]
        return [pa.array(x) for x in (*sums, np.add.reduceat(base, starts), np.add.reduceat(self.log10s(found, word_levels, pair_levels), starts))]


NUMBERS = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
_COUNTED = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("order", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("block", T.BinaryType())])
_TRAINED = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("words", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("known", T.BinaryType()), T.StructField("bits", T.BinaryType())])
_ASKED = T.StructType([T.StructField("_segment", T.IntegerType()), T.StructField("_salt", T.IntegerType()), T.StructField("_chunk", T.LongType()), *(T.StructField(c, t) for c, t in (("_n1", T.LongType()), ("_n2", T.LongType()), ("_words", T.BinaryType()), ("_pairs", T.BinaryType())))])
_ANSWERED = T.StructType([T.StructField("_chunk", T.LongType()), T.StructField("_segment", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("_levels1", "_levels2", "_exact"))])


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names=schema.names)


def text_bytes(rows: DataFrame, text: str = "text") -> int:
    return rows.agg(F.sum(F.octet_length(text))).first()[0] or 0


def segments_for(size: int) -> int:
    """Segments for so many bytes of training text."""
    return min(MAX_SEGMENTS, max(MIN_SEGMENTS, 1 << max(0, math.ceil(size / SEGMENT_BYTES) - 1).bit_length()))


def count(rows: DataFrame, segments: int, text: str = "text") -> DataFrame:
    """For each segment its distinct ``words``, training ``tokens``, ``known`` (hashes and counts of the words) and ``bits`` (the part of the filter)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in slices(batches, "_text"):
            hashes, starts = tokens(batch.column(0).to_pylist())
            held.append((hashes, pairs(before(hashes, starts), hashes)))
            size += len(hashes)
            if size >= FLUSH_TOKENS:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rows = []
        for order in (1, 2):
            found, n = np.unique(np.concatenate([h[order - 1] for h in held]), return_counts=True)
            edges = by_segment(found, order, segments)
            rows += [(s, order, b - a, pack(found[a:b], n[a:b])) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
        return _batch(rows, _COUNTED)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {1: [], 2: []}
        for batch in batches:
            for segment, order, n, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != now and now is not None:
                    yield close(now, held)
                    held = {1: [], 2: []}
                now = segment
                held[order].append(unpack(block, n))
        if now is not None:
            yield close(now, held)

    def close(segment: int, held: dict[int, list]) -> pa.RecordBatch:
        counted = {order: summed(found) for order, found in held.items()}
        words, counts = counted[1]
        return _batch([(segment, len(words), int(counts.sum()), pack(words, counts) if len(words) else None, part_of(counted).tobytes())], _TRAINED)

    counted = rows.select(F.col(text).alias("_text")).mapInArrow(partial, _COUNTED)
    return counted.repartition("segment").sortWithinPartitions("segment", "order").mapInArrow(total, _TRAINED)


def train(rows: DataFrame, text: str = "text") -> Model:
    """The model of all ``rows``."""
    segments = segments_for(text_bytes(rows, text))
    table = cut(count(rows, segments, text), "ngrams")
    words, total, size = (x or 0 for x in table.agg(F.sum("words"), F.sum("tokens"), F.sum(F.length("bits"))).first())
    model = Model(segments, total, words, table=table)
    if size > MAX_FILTER_BYTES or words > MAX_TABLE_ENTRIES:
        return model
    model.table, model.width = None, np.zeros(segments, np.int64)
    model.flat, model.keys, counts = np.empty(size, np.uint8), np.empty(words, np.uint64), np.empty(words, np.int64)
    filled = known = 0
    for row in table.orderBy("segment").toLocalIterator():  # a partition at a time; MAX_FILTER_BYTES and 16 * MAX_TABLE_ENTRIES in all at most
        part = np.frombuffer(row["bits"], np.uint8)
        model.width[row["segment"]] = len(part)
        model.flat[filled : filled + len(part)] = part
        filled += len(part)
        if row["words"]:
            model.keys[known : known + row["words"]], counts[known : known + row["words"]] = unpack(row["known"], row["words"])
            known += row["words"]
    model.base = np.cumsum(model.width) - model.width
    model.counts = counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts
    return model


def score(documents: DataFrame, model: Model, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row."""
    kept = [T.StructField(c, documents.schema[c].dataType) for c in carry]
    done = T.StructType([*kept, *NUMBERS])
    rows = documents.select(*carry, F.col(text).alias("_text"))
    shared = documents.sparkSession.sparkContext.broadcast(model.shares())
    if model.table is not None:
        return asked(rows, model, shared, done, text_bytes(documents, text))
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "_text"):
            found = Ngrams(batch.column(n).to_pylist())
            sums = own.results(found, own.level(found.words, 1), own.level(found.pairs, 2), exact_counts(found.words, own.keys, own.counts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *sums], names=done.names)

    return rows.mapInArrow(run, done)


def asked(rows: DataFrame, model: Model, shared, done: T.StructType, size: int) -> DataFrame:
    """:func:`score` of ``rows``, whose last column is ``_text``, with ``size`` bytes of text, by probes where the parts are."""
    segments, salts = model.segments, max(1, math.ceil(size / SALT_BYTES))
    n = len(done) - len(NUMBERS)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 36
        for batch in slices(batches, "_text", CHUNK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["_chunk", "_texts"])
            chunk += 1

    def texts(packed: bytes) -> pa.RecordBatch:
        return pa.ipc.open_stream(packed).read_next_batch()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Ngrams(texts(packed.as_py()).column(n).to_pylist())
                places = [by_segment(h, o, segments) for o, h in ((1, found.words), (2, found.pairs))]
                out = []
                for s in range(segments):
                    words, both = found.words[places[0][s] : places[0][s + 1]], found.pairs[places[1][s] : places[1][s + 1]]
                    if len(words) or len(both):
                        out.append((s, chunk % salts, chunk, len(words), len(both), pack(words) if len(words) else None, pack(both) if len(both) else None))
                yield _batch(out, _ASKED)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, known = None, np.zeros(0, np.uint8), (np.empty(0, np.uint64), np.empty(0, np.int64))
        for batch in batches:
            out = []
            for segment, salt, chunk, n1, n2, words, both in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (segment, salt) != now:
                    now, part, known = (segment, salt), np.zeros(0, np.uint8), (np.empty(0, np.uint64), np.empty(0, np.int64))
                if chunk < 0:  # the segment's part comes first
                    part = np.frombuffer(both, np.uint8)
                    known = unpack(words, n1) if n1 else known
                    continue
                hashes = [unpack(b, k)[0] if k else np.empty(0, np.uint64) for b, k in ((words, n1), (both, n2))]
                found = [read_levels(part, np.zeros(len(h), np.int64), np.full(len(h), 8 * len(part)), h, order).tobytes() for order, h in enumerate(hashes, 1)]
                out.append((chunk, segment, *found, exact_counts(hashes[0], *known).astype("<i8").tobytes()))
            if out:
                yield _batch(out, _ANSWERED)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = texts(left.column("_texts")[0].as_py())
        right = right.sort_by("_segment")
        first, second, exact = (b"".join(right.column(c).to_pylist()) for c in ("_levels1", "_levels2", "_exact"))
        sums = shared.value.results(Ngrams(batch.column(n).to_pylist()), np.frombuffer(first, np.uint8), np.frombuffer(second, np.uint8), np.frombuffer(exact, "<i8"))
        return pa.Table.from_arrays([*batch.columns[:n], *sums], names=done.names)

    dealt = rows.mapInArrow(chunks, "_chunk long, _texts binary").repartition("_chunk")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    parts = model.table.select(F.col("segment").alias("_segment"), copies, F.lit(-1).cast("long").alias("_chunk"), F.col("words").alias("_n1"), F.lit(0).cast("long").alias("_n2"), F.col("known").alias("_words"), F.col("bits").alias("_pairs"))
    met = parts.unionByName(dealt.mapInArrow(send, _ASKED)).repartition("_segment", "_salt").sortWithinPartitions("_segment", "_salt", "_chunk")
    answers = met.mapInArrow(answer, _ANSWERED)
    return dealt.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(finish, done)
