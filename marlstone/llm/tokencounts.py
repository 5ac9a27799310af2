"""Token counts as additive totals that signed changes keep up to date.

The totals hold documents and tokens by source, language and tokenizer version.  A batch of changes is
a table of signed rows: an insert adds a document and its tokens, a delete takes them away, a revision
takes the old count away and adds the new one.  The rows are summed by key before they are committed,
so the work of a batch follows the batch and not the corpus, and a hot source costs a row a task.

A commit writes the new totals, with a file that names the batch, to a folder of its own and renames it
to the next version; the rename is the commit, and it refuses a version that is there.  Of two writers
the slower one reads the new totals and adds its batch to them, so none is lost.  A batch id that is
already there is skipped, so a job may be run again after any failure.

Defined cases: null texts have the tokens of the empty text; null sources and languages are keys like
any other; keys whose documents and tokens are both zero leave the totals; repeated rows count each.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..commits import ATTEMPTS, publish
from .batches import slices
from .pieces import RoundTrip, splits_at_marks

KEYS = ("source", "lang", "tokenizer")
TOTALS = T.StructType([*(T.StructField(k, T.StringType()) for k in KEYS), T.StructField("documents", T.LongType()), T.StructField("tokens", T.LongType())])


def version_of(name: str, model: bytes) -> str:
    """A tokenizer's name with the start of its model's digest."""
    return f"{name}@{hashlib.sha256(model).hexdigest()[:12]}"


def counted(documents: DataFrame, models: Mapping[str, str], text: str = "text", carry: Sequence[str] = ("doc_id", "source", "lang")) -> DataFrame:
    """The ``carry`` columns, ``tokenizer`` and ``n_tokens`` (without begin and end) for every row and model (name -> path)."""
    loaded = {}
    for name, path in models.items():
        with open(path, "rb") as file:
            model = file.read()
        loaded[version_of(name, model)] = (model, splits_at_marks(model))
    kept = [documents.schema[c] for c in carry]
    n = len(kept)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = {v: RoundTrip(*m) for v, m in loaded.items()}
        for batch in slices(batches, "_text"):
            texts = batch.column(n).to_pylist()
            for version, coder in coders.items():
                found = np.fromiter((coder.count(t) for t in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([version] * len(texts)), pa.array(found)], names=schema.names)

    return documents.select(*carry, F.col(text).alias("_text")).mapInArrow(run, schema)


def inserts(rows: DataFrame) -> DataFrame:
    """Signed rows that add ``rows`` (KEYS, n_tokens)."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("documents"), F.col("n_tokens").alias("tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    """Signed rows that take ``rows`` away."""
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("documents"), (-F.col("n_tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that put ``new`` in the place of ``old``."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals under ``path``, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[tuple[str, str]]:
        """Folder name and batch id of each commit, in order."""
        found = self._files.globStatus(self._hadoop.Path(f"{self.path}/v*/_batch-*")) or []
        paths = [x.getPath() for x in found]
        return sorted((p.getParent().getName(), p.getName().removeprefix("_batch-")) for p in paths)

    def batches(self) -> list[str]:
        """The ids of the committed batches."""
        return [b for _, b in self._versions()]

    def totals(self) -> DataFrame:
        """KEYS, ``documents`` and ``tokens`` after the last commit."""
        return self._of(self._versions())

    def _of(self, versions: list[tuple[str, str]]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(f"{self.path}/{versions[-1][0]}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the signed rows of a batch; false if the batch was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError("a batch id has letters, digits, '_', '.' and '-' only")
        if batch in self.batches():
            return False
        own = f"{self.path}/.{batch}-{uuid.uuid4().hex}"
        summed = changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        summed.write.parquet(f"{own}/summed")  # a row a key: what is made anew if another writer is faster
        summed = self.spark.read.schema(TOTALS).parquet(f"{own}/summed")
        try:
            for attempt in range(ATTEMPTS):
                versions = self._versions()
                if batch in (b for _, b in versions):
                    return False
                added = self._of(versions).unionByName(summed).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
                staged, last = f"{own}/{attempt}", int(versions[-1][0][1:]) if versions else 0
                added.where("documents <> 0 or tokens <> 0").write.parquet(staged)
                self._files.create(self._hadoop.Path(f"{staged}/_batch-{batch}")).close()
                if publish(self.spark, staged, f"{self.path}/v{last + 1:09d}"):
                    return True
            raise RuntimeError("other writers kept committing; run the batch again")
        finally:
            self._files.delete(self._hadoop.Path(own), True)
