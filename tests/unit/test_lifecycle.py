import pytest

from marlstone.operators import lifecycle
from marlstone.operators.catalog import IDENTITY
from marlstone.schemas import ISSUE, ddl


def identity(version):
    return dict.fromkeys(IDENTITY) | {"system": "SYN", "version": version}


def test_of_two_writers_neither_is_lost(spark, tmp_path, monkeypatch):
    one, two = (lifecycle.Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    one.register(identity("1"))
    real, between = lifecycle.publish, []

    def late(*names):
        if not between:
            between.append(1)
            assert two.register(identity("2"))["id"] == 2
        return real(*names)

    monkeypatch.setattr(lifecycle, "publish", late)
    assert one.register(identity("3"))["id"] == 3
    assert {(r["id"], r["version"]) for r in one.datasets().collect()} == {(1, "1"), (2, "2"), (3, "3")}


def test_of_two_imports_one_is_in_progress(spark, tmp_path, monkeypatch):
    one, two = (lifecycle.Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    one.register(identity("1"))
    nodes, none = spark.createDataFrame([(1, "A00")], "id long, code string"), spark.createDataFrame([], ddl(ISSUE))
    real, between, other = lifecycle.publish, [], []

    def late(session, staged, final):
        if "/runs/" in final and not between:
            between.append(1)
            monkeypatch.setattr(lifecycle.Store, "_run", lambda self, run: None)  # the other one does not end
            other.append(two.import_release(identity("1"), "c", "f", {"nodes": nodes}, none, licence="own"))
        return real(session, staged, final)

    monkeypatch.setattr(lifecycle, "publish", late)
    assert one.import_release(identity("1"), "c", "f", {"nodes": nodes}, none, licence="own") == "in_progress"
    assert other == ["imported"] and one.runs().count() == 1


def test_a_ready_release_beyond_a_hundred_is_found(spark, tmp_path):
    store = lifecycle.Store(spark, f"file://{tmp_path}/s")
    rows = [(i, "SYN", *[None] * (len(IDENTITY) - 1), None, "READY" if i == 150 else "PENDING", None) for i in range(1, 151)]
    table = spark.createDataFrame(rows, ddl(lifecycle.REGISTRY))
    store.update("datasets", lifecycle.REGISTRY, lambda now: table)
    assert store.resolve(system="syn")["id"] == 150
    with pytest.raises(LookupError, match="not ready"):
        store.resolve(dataset_id=3)
    with pytest.raises(LookupError, match="no such"):
        store.resolve(dataset_id=999)


def test_reindex_writes_what_changed(spark, tmp_path):
    store = lifecycle.Store(spark, f"file://{tmp_path}/s")
    nodes, none = spark.createDataFrame([(1, "A00"), (2, "A01")], "id long, code string"), spark.createDataFrame([], ddl(ISSUE))
    store.import_release(identity("1"), "c", "f", {"nodes": nodes}, none, licence="own")
    documents = lambda n: n.selectExpr("id", "code AS body", "sha2(code, 256) AS identity_hash")
    assert store.reindex(1, documents) == (2, 0)
    assert store.reindex(1, documents) == (0, 2)
    assert store.reindex(1, documents, force=True) == (2, 0)
    assert {r["body"] for r in store.indexed(1).collect()} == {"A00", "A01"}
    store.delete_content(1)
    with pytest.raises(LookupError):
        store.reindex(1, documents)
