"""Datasets on storage: import once, audit, publish as a whole, archive, delete.

A store is a folder of Parquet tables that driver and executors share.  A release's content is written
under a new folder and becomes visible by one rename; the registry and the runs are small tables of which
each change writes the next version.  A version is put into place by a rename that refuses one that is
there, so of two writers the slower one reads again and makes its change anew; nothing is lost, ids are
given once, and of two imports of one dataset one is ``in_progress``.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..commits import ATTEMPTS, publish
from ..schemas import DATASET_STATUSES, ISSUE, ddl
from .catalog import IDENTITY
from .validate import MAX_ISSUES, blocks_import

STALE_AFTER = dt.timedelta(hours=2)
REGISTRY = {"id": "long", **dict.fromkeys(IDENTITY, "string"), "checksum": "string", "status": "string", "content": "string"}
RUNS = {"run_id": "string", "dataset_id": "long", "source": "string", "checksum": "string", "status": "string", "started_at": "timestamp", "completed_at": "timestamp", "records_seen": "long", "records_inserted": "long"}


class DuplicateDataset(ValueError):
    """The same file under another identity, or another file over a release that is served."""


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._files.exists(self._fs.Path(f"{self.path}/{name}"))

    def _versions(self, name: str) -> list[str]:
        root = self._fs.Path(f"{self.path}/{name}")
        return sorted(s.getPath().getName() for s in self._files.listStatus(root) if s.getPath().getName().startswith("v")) if self._files.exists(root) else []

    def table(self, name: str, columns: Mapping[str, str]) -> DataFrame:
        """The last version of a small table."""
        found = self._versions(name)
        if not found:
            return self.spark.createDataFrame([], ddl(columns))
        return self.spark.read.schema(ddl(columns)).parquet(f"{self.path}/{name}/{found[-1]}")

    def update(self, name: str, columns: Mapping[str, str], change: Callable[[DataFrame], DataFrame | None]) -> bool:
        """Put ``change`` of a small table in its place, made anew while other writers are faster; false, and nothing, where it gives None."""
        for _ in range(ATTEMPTS):
            found = self._versions(name)
            now = self.spark.read.schema(ddl(columns)).parquet(f"{self.path}/{name}/{found[-1]}") if found else self.spark.createDataFrame([], ddl(columns))
            rows = change(now)
            if rows is None:
                return False
            staged, last = f"{self.path}/{name}/.{uuid.uuid4().hex}", int(found[-1][1:]) if found else -1
            rows.coalesce(1).write.parquet(staged)
            if publish(self.spark, staged, f"{self.path}/{name}/v{last + 1:09d}"):
                return True
            self._files.delete(self._fs.Path(staged), True)
        raise RuntimeError(f"other writers kept replacing {name}")

    def datasets(self) -> DataFrame:
        return self.table("datasets", REGISTRY)

    def runs(self) -> DataFrame:
        return self.table("runs", RUNS)

    def issues(self) -> DataFrame:
        return self.table("issues", {"run_id": "string", **ISSUE})

    def _put(self, row: dict[str, object]) -> None:
        one = self.spark.createDataFrame([tuple(row[k] for k in REGISTRY)], ddl(REGISTRY))
        self.update("datasets", REGISTRY, lambda now: now.where(F.col("id") != row["id"]).unionByName(one))

    def register(self, identity: Mapping[str, str | None], checksum: str | None = None) -> dict[str, object]:
        """The registry row of an identity, made if it is not there."""
        same = F.lit(True)
        for k in IDENTITY:
            same = same & F.col(k).eqNullSafe(F.lit(identity.get(k)))
        row: dict[str, object] = {}

        def added(now: DataFrame) -> DataFrame | None:
            row.clear()
            found = now.where(same).first()
            if found:
                row.update(found.asDict())
                return None
            last = now.agg(F.max("id")).first()[0]
            row.update({"id": (last or 0) + 1, **{k: identity.get(k) for k in IDENTITY}, "checksum": checksum, "status": "PENDING", "content": None})
            return now.unionByName(self.spark.createDataFrame([tuple(row[k] for k in REGISTRY)], ddl(REGISTRY)))

        self.update("datasets", REGISTRY, added)
        return row

    def set_status(self, dataset_id: int, status: str) -> None:
        if status not in DATASET_STATUSES:
            raise ValueError(f"no such status: {status}")
        row = self.datasets().where(F.col("id") == dataset_id).first()
        if row is None:
            raise KeyError(dataset_id)
        self._put(row.asDict() | {"status": status})

    def archive(self, dataset_id: int) -> None:
        self.set_status(dataset_id, "ARCHIVED")

    def import_release(self, identity: Mapping[str, str | None], checksum: str, source: str, tables: Mapping[str, DataFrame], issues: DataFrame, licence: str | None = None) -> str:
        """``imported``, ``skipped`` (the same file is served), ``in_progress`` or ``validation_failed``.

        Needs a licence basis.  The same file under another identity, or another file over a served release, is refused.
        """
        if not licence:
            raise PermissionError("a release is not imported without a licence basis")
        owner = self.datasets().where(F.col("checksum") == checksum).first()
        row = self.register(identity)
        if owner and owner["id"] != row["id"]:
            raise DuplicateDataset(f"this file is dataset {owner['id']}")
        if row["status"] == "READY":
            if row["checksum"] == checksum:
                return "skipped"
            raise DuplicateDataset("another file is served under this identity; register a new revision")
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        run = {"run_id": uuid.uuid4().hex, "dataset_id": row["id"], "source": source, "checksum": checksum, "status": "RUNNING", "started_at": now, "completed_at": None, "records_seen": None, "records_inserted": None}
        running = (F.col("dataset_id") == row["id"]) & (F.col("status") == "RUNNING") & (F.col("started_at") > F.lit(now - STALE_AFTER))
        first = self.spark.createDataFrame([tuple(run[k] for k in RUNS)], ddl(RUNS))
        if not self.update("runs", RUNS, lambda rows: rows.unionByName(first) if rows.where(running).isEmpty() else None):
            return "in_progress"
        seen = tables["nodes"].count() if "nodes" in tables else 0
        noted = issues.limit(MAX_ISSUES).select(F.lit(run["run_id"]).alias("run_id"), *ISSUE)
        self.update("issues", {"run_id": "string", **ISSUE}, lambda rows: rows.unionByName(noted))
        if blocks_import(issues):
            self._put(row | {"checksum": checksum, "status": "VALIDATION_FAILED"})
            self._run(run | {"status": "VALIDATION_FAILED", "completed_at": now, "records_seen": seen, "records_inserted": 0})
            return "validation_failed"
        self._put(row | {"checksum": checksum, "status": "PROCESSING"})
        content = f"content/dataset_id={row['id']}-{run['run_id']}"
        try:
            for name, rows in tables.items():
                rows.write.mode("overwrite").parquet(f"{self.path}/.{run['run_id']}/{name}")
            self._files.mkdirs(self._fs.Path(f"{self.path}/content"))
            if not publish(self.spark, f"{self.path}/.{run['run_id']}", f"{self.path}/{content}"):
                raise RuntimeError("the content could not be put into place")
        except Exception:
            self._files.delete(self._fs.Path(f"{self.path}/.{run['run_id']}"), True)
            self._put(row | {"checksum": checksum, "status": "FAILED"})
            self._run(run | {"status": "FAILED", "completed_at": now, "records_seen": seen, "records_inserted": 0})
            raise
        self._put(row | {"checksum": checksum, "status": "READY", "content": content})
        self._run(run | {"status": "COMPLETED", "completed_at": now, "records_seen": seen, "records_inserted": seen})
        return "imported"

    def _run(self, run: dict[str, object]) -> None:
        one = self.spark.createDataFrame([tuple(run[k] for k in RUNS)], ddl(RUNS))
        self.update("runs", RUNS, lambda rows: rows.where(F.col("run_id") != run["run_id"]).unionByName(one))

    def content(self, dataset_id: int, name: str) -> DataFrame:
        """A table of a release that is served."""
        row = self.resolve(dataset_id=dataset_id)
        return self.spark.read.parquet(f"{self.path}/{row['content']}/{name}")

    def delete_content(self, dataset_id: int) -> None:
        row = self.datasets().where(F.col("id") == dataset_id).first()
        if row and row["content"]:
            self._files.delete(self._fs.Path(f"{self.path}/{row['content']}"), True)
            self._put(row.asDict() | {"content": None, "status": "PENDING"})

    def resolve(self, dataset_id: int | None = None, system: str | None = None, version: str | None = None, ready: bool = True) -> dict[str, object]:
        """The one dataset meant; not found, not ready and ambiguous are errors."""
        rows = self.datasets()
        if dataset_id is not None:
            rows = rows.where(F.col("id") == dataset_id)
        if system is not None:
            rows = rows.where(F.upper("system") == system.upper())
        if version is not None:
            rows = rows.where(F.col("version") == version)
        served = [r.asDict() for r in (rows.where("status = 'READY'") if ready else rows).limit(2).collect()]
        if not served:
            raise LookupError("no such dataset" if rows.isEmpty() else "the dataset is not ready")
        if len(served) > 1:
            raise LookupError("more than one dataset fits; name the version or the id")
        return served[0]

    def reindex(self, dataset_id: int, documents: Callable[[DataFrame], DataFrame], force: bool = False) -> tuple[int, int]:
        """Search documents of a served release made anew from its nodes: how many were written, and how many were there unchanged.

        ``documents`` gives rows with ``id`` and ``identity_hash``.  Without ``force`` a table that has the same identities stays.
        """
        row = self.resolve(dataset_id=dataset_id)
        made = documents(self.content(dataset_id, "nodes"))
        root = self._fs.Path(f"{self.path}/index/dataset_id={dataset_id}")
        found = sorted(x.getPath().getName() for x in self._files.listStatus(root) if x.getPath().getName().startswith("v")) if self._files.exists(root) else []
        n = made.count()
        if found and not force:
            held = self.spark.read.parquet(f"{root}/{found[-1]}").select("id", "identity_hash")
            same = made.join(held, ["id", "identity_hash"], "left_semi").count()
            if same == n == held.count():
                return 0, n
        staged = f"{root}/.{uuid.uuid4().hex}"
        made.withColumn("content", F.lit(row["content"])).write.parquet(staged)
        if not publish(self.spark, staged, f"{root}/v{int(found[-1][1:]) + 1 if found else 0:09d}"):
            raise RuntimeError("another writer indexed the release meanwhile; run it again")
        return n, 0

    def indexed(self, dataset_id: int) -> DataFrame:
        """The search documents of the last :meth:`reindex`."""
        root = self._fs.Path(f"{self.path}/index/dataset_id={dataset_id}")
        found = sorted(x.getPath().getName() for x in self._files.listStatus(root) if x.getPath().getName().startswith("v")) if self._files.exists(root) else []
        if not found:
            raise LookupError("the dataset has no index")
        return self.spark.read.parquet(f"{root}/{found[-1]}")
