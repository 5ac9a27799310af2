"""URL filters by a sorted digest array.

The list (``host/path`` entries with a verdict) is written once as a file of sorted 64-bit xxhash
digests, verdicts and the full strings; Spark distributes the file to the executors, where workers map
it into memory, so all workers of a machine share its pages and the list may be larger than a worker's
memory.  A URL asks for its host and each parent domain, each with every beginning of its path that
some entry's path is as long as.  All questions of a batch are hashed, found by one vectorised binary
search, and confirmed against the stored strings, so a collision of digests never counts.

An entry fits its host and all subdomains where the URL's path starts with the entry's.  The longest
fitting entry wins.  URLs that no entry fits get the default verdict.

Defined cases: a null URL or one without ``://`` has empty host and path; letters A-Z of a host are
lower-cased; ports and user names count as part of the host; repeated entries must agree; columns
besides those asked for are not carried.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import new_path

MAGIC = b"MDIGEST1"
VERDICTS = ("allow", "block")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL as columns."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def packed_array(entries: Sequence[tuple[str, str]]) -> bytes:
    """The file's content: header, digests, ends of strings, verdicts, host lengths, path lengths in use, strings.

    ``entries``: ``host/path`` and verdict.
    """
    found: dict[str, str] = {}
    for entry, verdict in entries:
        if "/" not in entry or verdict not in VERDICTS or found.setdefault(entry, verdict) != verdict:
            raise ValueError(f"no entry, or one with two verdicts: {entry!r}")
    rows = sorted((xxhash.xxh64_intdigest(e.encode()), e.encode(), VERDICTS.index(v)) for e, v in found.items())
    lengths = sorted({len(e) - e.index(b"/") for _, e, _ in rows})
    parts = [MAGIC + struct.pack("<qq", len(rows), len(lengths))]
    parts.append(np.array([r[0] for r in rows], "<u8").tobytes())
    parts.append(np.cumsum([len(r[1]) for r in rows], dtype="<i8").astype("<i8").tobytes())
    parts += [np.array(lengths, "<i8").tobytes(), np.array([r[2] for r in rows], "u1").tobytes(), *(r[1] for r in rows)]
    return b"".join(parts)


class DigestArray:
    """A mapped file of :func:`packed_array`."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.uint8, "r")
        if data[:8].tobytes() != MAGIC:
            raise ValueError("no digest array")
        n, m = struct.unpack("<qq", data[8:24].tobytes())
        at = 24
        self.digests = data[at : at + 8 * n].view("<u8")
        self.ends = data[at + 8 * n : at + 16 * n].view("<i8")
        at += 16 * n
        self.lengths = data[at : at + 8 * m].view("<i8").tolist()
        self.verdicts = data[at + 8 * m : at + 8 * m + n]
        self.strings = data[at + 8 * m + n :]

    def entry(self, place: int) -> bytes:
        return self.strings[self.ends[place - 1] if place else 0 : self.ends[place]].tobytes()

    def questions(self, host: bytes, path: bytes) -> Iterator[bytes]:
        parts = host.split(b".")
        for length in self.lengths:
            if length <= len(path):
                for i in range(len(parts)):
                    yield b".".join(parts[i:]) + path[:length]

    def judge(self, pairs: Sequence[tuple[str | None, str | None]]) -> list[tuple[str, str] | None]:
        """For each host and path the longest fitting entry with its verdict."""
        asked, owner = [], []
        for i, (host, path) in enumerate(pairs):
            if host and path:
                for q in self.questions(host.encode(), path.encode()):
                    asked.append(q)
                    owner.append(i)
        out: list[tuple[str, str] | None] = [None] * len(pairs)
        if not asked or not len(self.digests):
            return out
        keys = np.fromiter(map(xxhash.xxh64_intdigest, asked), np.uint64, len(asked))
        place = np.searchsorted(self.digests, keys)
        hit = np.flatnonzero(self.digests[np.minimum(place, len(self.digests) - 1)] == keys)
        for at in hit.tolist():
            p = int(place[at])
            while p < len(self.digests) and self.digests[p] == keys[at]:  # equal digests lie side by side
                if self.entry(p) == asked[at]:
                    best = out[owner[at]]
                    if best is None or len(asked[at]) > len(best[0].encode()):
                        out[owner[at]] = (asked[at].decode(), VERDICTS[self.verdicts[p]])
                p += 1
        return out


def distribute(spark: SparkSession, entries: Sequence[tuple[str, str]]) -> str:
    """Write the array to the shared folder, have Spark send it to the executors, and return its name there."""
    path = new_path(spark, "digests")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray(packed_array(entries)))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def judge(pages: DataFrame, entries: Sequence[tuple[str, str]], default: str = "allow", url: str = "url", carry: Sequence[str] = ("page_id",)) -> DataFrame:
    """The ``carry`` columns, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` of every row."""
    name = distribute(pages.sparkSession, entries)
    kept = [pages.schema[c] for c in carry]
    n = len(kept)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])
    host, path = host_and_path(F.col(url))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            found = array.judge(list(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)))
            rules = pa.array([f[0] if f else None for f in found], pa.string())
            verdicts = pa.array([f[1] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rules, verdicts], names=schema.names)

    return pages.select(*carry, host.alias("host"), path.alias("path")).mapInArrow(run, schema)
