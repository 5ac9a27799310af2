"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link at three differing bits or fewer.  Of the two halves one then
differs in one bit at most.  Each half, without its top bit, is a word of 31 bits; the anchors are the
code words of the Hamming code (31, 26), whose covering radius is 1.  A word is replicated to every
anchor within covering radius plus threshold, 1 + 1: 16 anchors, or itself where it is a code word.
Words that differ in one bit meet at the anchor nearest to either, so every link is found at some
anchor, and members of an anchor are compared over all 64 bits.

Equal fingerprints are collapsed first, so exact copies cost one row.  Anchors with over ``CHUNK``
members are dealt as pairs of chunks, so no task holds more than two chunks of an anchor; they are found
by counting, with sums per task first.  Each task reduces its links to a spanning forest before the
shuffle.  Components come from rounds of large-star and small-star over the forest, each round written
to the shared folder, so a lost executor costs part of a round.  Links, components and fingerprints
stay on the executors.

Work for n distinct fingerprints is 32 n rows, and comparisons within anchors; with 2^27 anchors a
billion fingerprints put about 240 in each.

:func:`keep_one` links documents whose sets of five-word shingles have a Jaccard similarity of
``SIMILAR`` or more.  Over 64 bits such documents differ in about 10, which anchors cannot cover: each
fingerprint would have over a thousand.  So beside the anchors, fingerprints of 1,024 bits of the sets
meet where one of ``BANDS`` bands of ``BAND`` smallest hashes is equal (0.995 of the pairs at 0.8, more
above).  At ``WIDE_THRESHOLD`` differing bits, well beyond the 155 expected at 0.8 (one deviation, 12
bits, is 0.025 of similarity), a pair is a candidate.  The bits of a small set estimate badly, as ties of
an even number of shingles go to 0: where a set has ``SMALL`` shingles or fewer, every pair that meets is
a candidate.  Sets whose sizes alone rule out ``SIMILAR`` are none.  Larger sets within ``SURE`` bits are
linked as they are: at a similarity of 0.8 that has a chance of a few in a million.  Other candidates do not
count until the sets have been compared exactly: each task names, of those that join trees of its sure
links, ``FORESTS`` edge-disjoint spanning forests of the closest, so their number grows with the members
and not with their pairs.  A block of members of which some were left out, and that still lies in several
components, is then compared whole, by counts of common shingles (:func:`rest_pairs`), so no candidate that
would join two components stays untested.  A set of shingles is one node, so copies and reordered repeats
cost one row.  Only documents named in a candidate that is not sure are read again for their sets, and texts
are shuffled once, to the documents that stay; scratch tables go when these are known.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and links like any
other; a text under ``SHINGLE`` words is one shingle; a component is named by its smallest id (null if
it has none); repeated rows and ids are members like others; columns besides those asked for are not
carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut, cut_at, drop, new_path, passing
from .batches import lower_words, slices

SHINGLE = 3
SEED = 42
THRESHOLD = 3
#: Jaccard similarity of sets of shingles from which texts are near copies.
SIMILAR = 0.8
#: Shingles of the 1024-bit fingerprints, in words; their bits in words of 64; differing bits of candidates, 155 at
#: similarity 0.8 (cosine 0.889 of sets of equal size, an angle of 0.1515 of a half turn) and over two deviations.
WIDE_SHINGLE, WIDE, WIDE_THRESHOLD = 5, 16, 180
#: Shingles of a set up to which its fingerprint rules out no pair.
SMALL = 64
#: Differing bits up to which larger sets are similar without a comparison: nearly five deviations below what 0.8 gives.
SURE = 100
#: Spanning forests of candidates that each task names.
FORESTS = 2
#: Rows of a written table (24 bytes each) up to which it is broadcast.
BROADCAST_ROWS = 1_000_000
#: Bands of smallest hashes, and hashes in each.
BANDS, BAND = 10, 4
#: What names a block of members that a task compares.
BLOCK = ("anchor", "i", "j")
#: Members of an anchor that are compared with another such number at a time.
CHUNK = 1024
#: Links that a task holds before it reduces them.
HELD = 1 << 17
#: Places of shingles that are counted at a time where a block is compared whole.
GATHERED = 1 << 21
#: Rounds of star contraction after which something is wrong.
MAX_ROUNDS = 60

_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANE = (np.arange(8) * 256).astype(np.int64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * BAND + WIDE, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_hashes(words: Sequence[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole where there are fewer words; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    text = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(text, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - shingle])).tolist()
    return np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes; 0 without hashes."""
    lanes = hashes.view(np.uint8).reshape(-1, 8) + _LANE
    sums = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BIT
    return int(np.packbits(sums.ravel() * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(words: Sequence[bytes], shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of the word shingles, as an unsigned number."""
    return majority(shingle_hashes(words, shingle))


def sketch(words: Sequence[bytes]) -> tuple[int, int, bytes, list[int]]:
    """Of the five-word shingles: number of the set (0 for none), 64-bit fingerprint, 1024-bit fingerprint of the set, its bands (none without words)."""
    return _sketch(words)[:4]


def _sketch(words: Sequence[bytes]) -> tuple[int, int, bytes, list[int], int]:
    """What :func:`sketch` gives, and the size of the set."""
    hashes = shingle_hashes(words, WIDE_SHINGLE)
    own = np.unique(hashes)
    if not len(own):
        return 0, 0, bytes(8 * WIDE), [], 0
    wide = np.empty(WIDE, np.uint64)
    for i, odd in enumerate(_ODD[:WIDE]):
        mixed = (own ^ (own >> np.uint64(31))) * odd
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
        wide[i] = majority(mixed ^ (mixed >> np.uint64(32)))
    least = [int((own * odd).min()) for odd in _ODD[WIDE:]]
    bands = [xxhash.xxh64_intdigest(np.array(least[i * BAND : (i + 1) * BAND], np.uint64).tobytes(), i) for i in range(BANDS)]
    return xxhash.xxh64_intdigest(own.tobytes(), SEED), majority(hashes), wide.tobytes(), bands, len(own)


def fingerprints(documents: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and ``fp`` (the fingerprint as a signed long) of every row."""
    return _marked(documents, text, carry, [T.StructField("fp", T.LongType())], lambda texts: [_signed([fingerprint(lower_words(x)) for x in texts])])


def sketches(documents: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, ``node`` (the set of five-word shingles), ``fp``, ``size`` of the set, ``wide`` (the 1024-bit fingerprint) and ``bands`` of every row."""

    def mark(texts: list[str | None]) -> list[pa.Array]:
        nodes, fps, wide, bands, sizes = zip(*(_sketch(lower_words(x)) for x in texts), strict=True) if texts else ((), (), (), (), ())
        offsets = np.cumsum([0, *map(len, bands)])
        return [_signed(nodes), _signed(fps), pa.array(sizes, pa.int64()), pa.array(wide, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _signed([x for b in bands for x in b]))]

    longs = [T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("size", T.LongType())]
    return _marked(documents, text, carry, [*longs, T.StructField("wide", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))], mark)


def _signed(values: Sequence[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _marked(documents: DataFrame, text: str, carry: Sequence[str], added: list[T.StructField], mark: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """The ``carry`` columns and those that ``mark`` makes of the texts."""
    kept = [documents.schema[c] for c in carry]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), *added])
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *mark(batch.column(n).to_pylist())], names=schema.names)
            del batch
        pa.default_memory_pool().release_unused()  # the worker lives on

    return documents.select(*carry, F.col(text).alias("_text")).mapInArrow(run, schema)


def _masks() -> np.ndarray:
    """For each syndrome of the Hamming code what turns a word into the code words within two bits; 0 fills up."""
    out = np.zeros((32, 16), np.uint32)
    for s in range(1, 32):
        pairs = [(1 << (s - 1))] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s]
        out[s, : len(pairs)] = pairs
    return out


_MASKS = _masks()


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor (half above 31 bits of code word) and place in ``fps``, for every replica of unsigned fingerprints."""
    found, at = [], []
    for half in range(2):
        word = ((fps >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
        syndrome = np.zeros(len(word), np.uint32)
        for i in range(1, 32):
            syndrome ^= ((word >> np.uint32(i - 1)) & np.uint32(1)) * np.uint32(i)
        masks = _MASKS[syndrome]
        valid = masks > 0
        valid[:, 0] = True
        code = (word[:, None] ^ masks)[valid].astype(np.int64)
        found.append(code | half << 31)
        at.append(np.nonzero(valid)[0])
    return np.concatenate(found), np.concatenate(at)


def replicas(distinct: DataFrame) -> DataFrame:
    """``anchor`` and ``fp`` for every anchor of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for start in range(0, len(fps), 4096):
                own = fps[start : start + 4096]
                anchor, at = anchors(own.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(own[at])], names=["anchor", "fp"])

    return distinct.select("fp").mapInArrow(run, "anchor long, fp long")


def _settled(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest member of the component of each of ``n`` nodes under the links x - y."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        if (new == root).all():
            return root
        root = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, smallest member) with the same components as the links a - b."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = _settled(len(nodes), ends[: len(a)], ends[len(a) :])
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def closest(a: np.ndarray, b: np.ndarray, apart: np.ndarray, sure: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the pairs a - b, which are ``apart``: a forest of those that are ``sure``, and of the others, where they join its trees, ``FORESTS`` edge-disjoint forests, each the closest of what is left.

    Last, the groups of pairs between trees that were left out.
    """
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    trees = _settled(len(nodes), x[sure], y[sure])
    kept = np.zeros(len(a), bool)
    order = np.argsort(apart, kind="stable")
    spans = order[sure[order]]
    _span(x, y, spans, np.arange(len(nodes)), kept)
    between = order[~sure[order] & (trees[x[order]] != trees[y[order]])]
    for _ in range(FORESTS):
        _span(x, y, between[~kept[between]], trees, kept)
    left = np.unique(group[between[~kept[between]]])
    return a[kept], b[kept], apart[kept], sure[kept], group[kept], left


def _span(x: np.ndarray, y: np.ndarray, live: np.ndarray, root: np.ndarray, kept: np.ndarray) -> None:
    """Mark in ``kept`` a forest of the pairs x - y at the places ``live``, the first of them before others, over the trees ``root``."""
    root = root.copy()
    while len(live := live[root[x[live]] != root[y[live]]]):
        # each tree takes its first pair that leaves it
        first = np.full(len(root), len(live))
        np.minimum.at(first, root[x[live]], np.arange(len(live)))
        np.minimum.at(first, root[y[live]], np.arange(len(live)))
        chosen = live[np.unique(first[first < len(live)])]
        kept[chosen] = True
        root = _settled(len(root), root[x[chosen]], root[y[chosen]])[root]


def judged(apart: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether sets of ``x`` and ``y`` shingles, whose wide fingerprints are ``apart``, may be similar, and whether they surely are."""
    less, more = np.minimum(x, y), np.maximum(x, y)
    may = (less >= SIMILAR * more) & ((apart <= WIDE_THRESHOLD) | (less <= SMALL))
    return may, may & (apart <= SURE) & (less > SMALL)


def compare(groups: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within runs of equal ``groups``."""
    found = [(np.empty(0, np.int64),) * 2]
    held, at, step = 0, np.arange(len(fps)), 1
    own = fps.view(np.uint64)
    while len(at := at[at + step < len(fps)]) and len(at := at[groups[at] == groups[at + step]]):
        hit = at[np.bitwise_count(own[at] ^ own[at + step]) <= THRESHOLD]
        found.append((fps[hit], fps[hit + step]))
        held += len(hit)
        if held > HELD:
            found = [forest(*map(np.concatenate, zip(*found, strict=True)))]
            held = len(found[0][0])
        step += 1
    return forest(*map(np.concatenate, zip(*found, strict=True)))


def compare_pairs(groups: np.ndarray, members: np.ndarray, wide: np.ndarray, sizes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The :func:`closest` pairs within runs of equal ``groups`` and whether they surely are similar: pairs that may be so by ``wide`` (rows of words) and ``sizes``, or without sizes those within the threshold.

    Last, the groups with a pair between trees that is not among them.
    """
    none = np.empty(0, np.int64)
    found: list[tuple[np.ndarray, ...]] = [(none, none, none, np.empty(0, bool), none)]
    left = [none]
    held, at, step = 0, np.arange(len(members)), 1

    def fewer() -> tuple[np.ndarray, ...]:
        *kept, more = closest(*map(np.concatenate, zip(*found, strict=True)))
        left.append(more)
        return tuple(kept)

    while len(at := at[at + step < len(members)]) and len(at := at[groups[at] == groups[at + step]]):
        apart = np.bitwise_count(wide[at] ^ wide[at + step]).sum(axis=1, dtype=np.int64)
        may, sure = (apart <= THRESHOLD, np.zeros(len(at), bool)) if sizes is None else judged(apart, sizes[at], sizes[at + step])
        hit = at[may]
        found.append((members[hit], members[hit + step], apart[may], sure[may], groups[hit]))
        held += len(hit)
        if held > HELD:
            found = [fewer()]
            held = len(found[0][0])
        step += 1
    child, root, _, sure, _ = fewer()
    return child, root, sure, np.unique(np.concatenate(left))


def links(distinct: DataFrame) -> DataFrame:
    """``child`` and ``root``: links with the components of all pairs of fingerprints within the threshold."""
    return meet(deal(replicas(distinct)))


def deal(replicated: DataFrame) -> DataFrame:
    """The members of each ``anchor`` of ``replicated`` (anchor, fp) in blocks ``anchor``, ``i``, ``j``: every two members meet in one."""
    hot = replicated.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
    hot = cut(hot.select("anchor", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts")), "anchors")
    return _blocks(replicated.join(hot, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1))), "fp")


def _blocks(members: DataFrame, name: str) -> DataFrame:
    """``members`` (anchor, ``name``, parts) in the blocks of the chunks that they fall into."""
    own = F.when(F.col("parts") > 1, F.pmod(F.xxhash64(name), F.col("parts"))).otherwise(F.lit(0)).cast("int")
    tagged = members.select("anchor", name, own.alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    return tagged.select("anchor", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), name)


def _runs(batches: Iterator[pa.RecordBatch], arrays: Callable[[pa.RecordBatch], list[np.ndarray]]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Whole blocks of sorted batches: the number of each row's block, and the columns, of which the first three name it."""
    rest: list[np.ndarray] = []  # of the block that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.concatenate(x) for x in zip(rest, arrays(batch), strict=True)] if rest else arrays(batch)
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
        last = int(np.flatnonzero(new)[-1])
        group = np.cumsum(new)
        rest = [c[last:] for c in columns]
        if last:
            yield group[:last], [c[:last] for c in columns]
    if rest:
        yield np.zeros(len(rest[0]), np.int64), rest


def meet(dealt: DataFrame) -> DataFrame:
    """``child`` and ``root`` of the links within each block of :func:`deal`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, columns in _runs(batches, lambda b: [c.to_numpy().astype(np.int64) for c in b.columns]):
            child, root = compare(group, columns[3])
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(root)], names=["child", "root"])

    return dealt.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(run, "child long, root long")


def meet_pairs(dealt: DataFrame) -> DataFrame:
    """``child``, ``root`` and ``sure`` of the pairs that :func:`compare_pairs` names in each block of ``dealt`` (BLOCK and fp, or BLOCK, node, wide and size); ``anchor``, ``i``, ``j`` of the blocks in which it left some out, in rows of their own."""
    names = ["child", "root", "sure", *BLOCK]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32()]

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        numbers = [c.to_numpy().astype(np.int64) for c in batch.columns[:4]]
        if batch.num_columns == 4:
            return [*numbers, numbers[3].view(np.uint64)[:, None]]
        return [*numbers, np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(-1, WIDE), batch.column(5).to_numpy()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, columns in _runs(batches, arrays):
            child, root, sure, left = compare_pairs(group, *columns[3:5], columns[5] if len(columns) > 5 else None)
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(root), pa.array(sure), *(pa.nulls(len(child), t) for t in kinds[3:])], names=names)
            if len(left):
                at = np.searchsorted(group, left)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), t) for t in kinds[:3]] + [pa.array(c[at], t) for c, t in zip(columns[:3], kinds[3:], strict=True)], names=names)

    return dealt.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(run, "child long, root long, sure boolean, anchor long, i int, j int")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of ``edges`` (child, root) but the roots."""
    spark = edges.sparkSession
    now, path = cut_at(edges.where("child <> root").distinct(), "links")
    for _ in range(MAX_ROUNDS):
        # large star: each node gives its larger neighbours the smallest of itself and its neighbours
        both = now.select(F.col("child").alias("u"), F.col("root").alias("v")).unionByName(now.select(F.col("root").alias("u"), F.col("child").alias("v")))
        # a written table, so that neither side of the join has its dealing from the aggregate and AQE can split the centre of a large star
        least, least_path = cut_at(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("child"), F.col("m").alias("root"))
        # small star: each node links itself and its smaller neighbours to the smallest of these
        large = large.where("child <> root").distinct()
        small = large.groupBy(F.col("child").alias("u")).agg(F.min("root").alias("m"))
        joined = large.select(F.col("child").alias("u"), F.col("root").alias("v")).join(small, "u")
        moved = joined.select(F.col("v").alias("child"), F.col("m").alias("root")).unionByName(small.select(F.col("u").alias("child"), F.col("m").alias("root")))
        then, next_path = cut_at(moved.where("child <> root").distinct(), "links")
        # done when every child has one root, which is no child
        roots = then.select(F.col("root").alias("child")).distinct()
        done = then.join(roots, "child", "left_semi").limit(1).count() == 0 and then.groupBy("child").count().where("count > 1").limit(1).count() == 0
        drop(spark, path)
        drop(spark, least_path)
        now, path = then, next_path
        if done:
            return now.select(F.col("child").alias("node"), "root")
    raise RuntimeError("components did not settle")


def groups(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """``fp``, ``root`` (a fingerprint that names the component) and ``component_id`` for each fingerprint of ``marked`` (key, fp)."""
    nodes = cut(marked.groupBy("fp").agg(F.min(key).alias("_least")), "fingerprints")
    roots = components(links(nodes))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "_least")
    named = cut(placed.groupBy("root").agg(F.min("_least").alias("component_id")), "components")
    return placed.select("fp", "root").join(named, "root")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fp`` and ``component_id`` for every row."""
    marked = cut(fingerprints(documents, text, [key]), "documents")
    return marked.join(groups(marked, key).select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def similar_pairs(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``child`` and ``root``: links of ``nodes`` (node, fp, size, wide, bands) whose sets of shingles are similar, with the components of all that meet at an anchor or in a band.

    ``sets_of``: the sets (node, shingles) of a column ``node``.
    """
    named = cut(nodes.groupBy("fp").agg(F.min("node").alias("_name"), F.count(F.lit(1)).alias("_nodes")), "fingerprints")
    by_fp, by_band = deal(replicas(named)), banded(nodes)
    of_fps = cut(meet_pairs(by_fp), "anchored")
    of_bands = cut(meet_pairs(by_band.join(nodes.select("node", "wide", "size"), "node").select(*BLOCK, "node", "wide", "size")), "banded")
    # the first node of a fingerprint stands for it
    met = of_fps.where("child IS NOT NULL").select("child", "root")
    for end in ("child", "root"):
        met = met.join(named.select(F.col("fp").alias(end), F.col("_name").alias(f"_{end}")), end)
    same = nodes.join(named, "fp").select(F.col("node").alias("child"), F.col("_name").alias("root")).where("child <> root")
    at_anchors = weighed(met.select(F.col("_child").alias("child"), F.col("_root").alias("root")).unionByName(same), nodes)
    pairs = at_anchors.unionByName(of_bands.where("child IS NOT NULL").select("child", "root", "sure"))
    ordered = pairs.where("child <> root").select(F.greatest("child", "root").alias("child"), F.least("child", "root").alias("root"), "sure")
    asked = cut(ordered.groupBy("child", "root").agg(F.max("sure").alias("sure")), "candidates")
    sure = asked.where("sure").select("child", "root")
    # candidates within a component of sure links need no comparison
    part = components(sure)
    ends = asked.where("not sure").select("child", "root")
    for end in ("child", "root"):
        ends = ends.join(part.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end, "left")
    ends = cut(ends.where(F.coalesce("_child", "child") != F.coalesce("_root", "root")).select("child", "root"), "between")
    sets = sets_of(ends.select(F.col("child").alias("node")).unionByName(ends.select(F.col("root").alias("node"))))
    both = ends.join(sets.select(F.col("node").alias("child"), F.col("shingles").alias("_a")), "child").join(sets.select(F.col("node").alias("root"), F.col("shingles").alias("_b")), "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [alike(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["child", "root"]).filter(pa.array(near, pa.bool_()))

    linked = cut(sure.unionByName(both.select("child", "root", "_a", "_b").mapInArrow(run, "child long, root long")), "similar")
    # blocks of which some pairs were left out, and fingerprints of three nodes or more, as nodes were compared with the first of these only
    opened = lambda met: met.where("anchor IS NOT NULL").select(*BLOCK).distinct()
    left = by_band.join(opened(of_bands), list(BLOCK), "left_semi").unionByName(crowded(nodes, named.where("_nodes > 2").select("fp")))
    left = left.unionByName(by_fp.join(opened(of_fps), list(BLOCK), "left_semi").join(nodes.select("fp", "node"), "fp").select(*BLOCK, "node"))
    left = cut(left, "left")
    if not left.limit(1).count():
        return linked
    return linked.unionByName(rest_pairs(left, components(linked), sets_of))


def weighed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``pairs`` (child, root) of ``nodes`` that may be similar, with ``sure``."""
    for end, n in (("child", "1"), ("root", "2")):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("wide").alias(f"_w{n}"), F.col("size").alias(f"_s{n}")), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, WIDE) for c in (2, 4))
            may, sure = judged(np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64), batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sure)], names=["child", "root", "sure"]).filter(pa.array(may))

    return pairs.select("child", "root", "_w1", "_s1", "_w2", "_s2").mapInArrow(run, "child long, root long, sure boolean")


def crowded(nodes: DataFrame, fps: DataFrame) -> DataFrame:
    """Blocks (BLOCK, node) of the nodes of each of the fingerprints ``fps``."""
    members = nodes.join(fps, "fp").select(F.xxhash64(F.lit("same"), "fp").alias("anchor"), F.col("node").alias("fp"))
    return deal(members).withColumnRenamed("fp", "node")


def banded(nodes: DataFrame) -> DataFrame:
    """The ``nodes`` that share a band, in blocks (BLOCK, node)."""
    rows = nodes.select(F.explode("bands").alias("anchor"), "node")
    shared = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(shared.select("anchor", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts")), "bands")
    return _blocks(rows.join(shared, "anchor"), "node")


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, as distinct numbers, are ``SIMILAR``."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= SIMILAR * (len(x) + len(y) - common)


def shingle_sets(documents: DataFrame, key: str, text: str, mark: str, nodes: DataFrame, used: DataFrame) -> DataFrame:
    """``node`` and ``shingles`` (distinct hashes, ascending), written, for each ``node`` of ``used``, from the document that ``nodes`` (node, id, hash) names; ``mark``: the column of ``documents`` that holds the hash."""
    places = cut(nodes.select("node", "id", "hash").join(used.distinct(), "node", "left_semi"), "places")
    rows = documents.select(F.col(key).alias("_id"), F.col(mark).alias("_hash"), F.col(text).alias("_t"))
    small = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
    texts = rows.join(small, rows["_id"].eqNullSafe(small["id"]) & (rows["_hash"] == small["hash"])).select("node", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t"):
            sets = [np.unique(shingle_hashes(lower_words(t), WIDE_SHINGLE)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return cut(texts.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"]), "shingles")


def rest_pairs(left: DataFrame, roots: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``child`` and ``root``: links that join the components ``roots`` (node, root) as all similar pairs within the blocks of ``left`` (anchor, i, j, node) do."""
    labelled = cut(left.join(roots, "node", "left").select(*BLOCK, "node", F.coalesce("root", "node").alias("part")), "labelled")
    several = labelled.groupBy(*BLOCK).agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select(*BLOCK)
    members = cut(labelled.join(several, list(BLOCK), "left_semi"), "members")
    sets = sets_of(members.select("node"))
    rows = members.join(sets, "node").select(*BLOCK, "node", "part", "shingles").repartition(*BLOCK).sortWithinPartitions(*BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for batch in batches:
            for *own, node, part, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != place:
                    yield from close(held)
                    place, held = own, []
                held.append((node, part, np.frombuffer(shingles, np.uint64)))
        yield from close(held)

    def close(held: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if held:
            nodes, parts, sets = zip(*held, strict=True)
            a, b = joining(np.array(parts, np.int64), sets)
            nodes = np.array(nodes, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(nodes[a], nodes[b])), pa.array(np.minimum(nodes[a], nodes[b]))], names=["child", "root"])

    return rows.mapInArrow(run, "child long, root long")


def joining(parts: np.ndarray, sets: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of similar sets that join the ``parts`` of a block as all its similar pairs do."""
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)[np.argsort(number, kind="stable")]
    start = np.concatenate(([0], np.cumsum(np.bincount(number))))
    ends = np.concatenate(([0], np.cumsum(size)))
    names, part, times = np.unique(parts, return_inverse=True, return_counts=True)
    found: list[tuple[int, int]] = []
    # one end of every pair that joins lies outside of the largest part
    for i in np.flatnonzero(part != times.argmax()).tolist():
        own = number[ends[i] : ends[i + 1]]
        lengths = start[own + 1] - start[own]
        common, till = np.zeros(m, np.int64), np.cumsum(lengths)
        at = 0
        while at < len(own):
            end = max(at + 1, int(np.searchsorted(till, (till[at - 1] if at else 0) + GATHERED, side="right")))
            n = lengths[at:end]
            spots = np.arange(n.sum()) + np.repeat(start[own[at:end]] - np.cumsum(n) + n, n)
            common += np.bincount(owner[spots], minlength=m)
            at = end
        hit = np.flatnonzero((common >= SIMILAR * (size[i] + size - common)) & (part != part[i]))
        if len(hit):
            joined, first = np.unique(part[hit], return_index=True)
            found += [(i, j) for j in hit[first].tolist()]
            part[np.isin(part, joined)] = part[i]
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return a, b


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` with one row of each component of near copies, five-word shingles 0.8 similar: the one with the smallest id, then text hash."""
    spark, names = documents.sparkSession, documents.columns
    mark = "_hash"
    while mark in names:
        mark += "_"
    own = documents.withColumn(mark, F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull()))
    rows = own.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(mark).alias("hash"))
    stays = new_path(spark, "chosen")
    with passing(spark):
        marked = cut(sketches(rows, "text", ["id", "hash"]), "documents")
        first = F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "hash", "fp", "size", "wide", "bands")).alias("first")
        nodes = cut(marked.groupBy("node").agg(first).select("node", *(f"first.{c}" for c in ("missing", "id", "hash", "fp", "size", "wide", "bands"))), "nodes")
        roots = components(similar_pairs(nodes, lambda used: shingle_sets(own, key, text, mark, nodes, used)))
        rooted = nodes.select("node", F.struct("missing", "id", "hash").alias("first")).join(roots, "node", "left")
        chosen = rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select("first.id", "first.hash")
        again = marked.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
        chosen.join(again, chosen["id"].eqNullSafe(again["id"]) & (chosen["hash"] == again["hash"]), "left").select(chosen["id"].alias("_id"), chosen["hash"].alias("_h"), F.col("times").isNotNull().alias("_again")).write.parquet(stays)
    chosen = spark.read.parquet(stays)
    one = lambda which: own[key].eqNullSafe(which["_id"]) & (own[mark] == which["_h"])
    repeated = chosen.where("_again")
    if not repeated.limit(1).count():
        return own.join(chosen, one(chosen), "left_semi").select(*names)
    once = chosen.where("not _again")
    return own.join(once, one(once), "left_semi").select(*names).unionByName(own.join(repeated, one(repeated), "left_semi").dropDuplicates([key, mark]).select(*names))


def as_hex(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
