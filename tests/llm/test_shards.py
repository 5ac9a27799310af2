import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import queries, shards


def test_query(spark, sf_dir):
    rows = queries.op2(spark, sf_dir).collect()
    docs = {r["doc_id"]: r["text"] for r in queries.documents(spark, sf_dir).collect()}
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        body = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 8, zlib.crc32(body), "key")
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r["grown_shard"] == 24 for r in rows)


def brute_shard(key, weights):
    """The shard with the highest score; a key is hashed as 8 bytes, a shard as 4 with that hash as the seed."""
    of_key = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    drawn = [((xxhash.xxh64_intdigest(struct.pack("<i", i), of_key) >> 11) + 0.5) / 2**53 for i in range(len(weights))]
    scores = [-w / math.log(d) for w, d in zip(weights, drawn, strict=True)]
    return scores.index(max(scores))


def test_shards_against_brute_force(spark, sf_dir):
    for r in queries.op2(spark, sf_dir).collect():
        assert (r["shard"], r["grown_shard"]) == (brute_shard(r["doc_id"], [1.0] * 24), brute_shard(r["doc_id"], [1.0] * 25))
    weights = [0.5, 2.0, 1.0, 7.0]
    for r in spark.range(-200, 500).select("id", shards.shard_of(F.col("id"), weights).alias("shard")).collect():
        assert r["shard"] == brute_shard(r["id"], weights)


def test_weights_and_growth(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "doc_id")
    weights = [1.0, 2.0, 1.0]
    two = keys.select("doc_id", shards.shard_of(F.col("doc_id"), weights).alias("a"), shards.shard_of(F.col("doc_id"), [*weights, 1.0]).alias("b")).collect()
    n = Counter(r["a"] for r in two)
    assert abs(n[1] / 40_000 - 0.5) < 0.02 and abs(n[0] / 40_000 - 0.25) < 0.02
    assert all(r["b"] in (r["a"], 3) for r in two)
    assert abs(sum(r["b"] == 3 for r in two) / 40_000 - 0.2) < 0.02


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_ROWS", 10)
    table = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    slots = defaultdict(list)
    for r in shards.assign(table, [1.0] * 3).collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 3


def test_odd_rows(odd, empty):
    rows = shards.assign(odd, [1.0] * 5).collect()
    assert len(rows) == odd.count()
    by_key = defaultdict(set)
    for r in rows:
        by_key[r["doc_id"]].add(r["shard"])
    assert all(len(s) == 1 for s in by_key.values())
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert shards.assign(empty, [1.0] * 5).count() == 0
    with pytest.raises(ValueError):
        shards.assign(empty, [1.0, 0.0])


def test_write(spark, make, tmp_path):
    docs = make([f"text {i}" for i in range(60)])
    shards.write(docs.drop("shard"), [1.0] * 4, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 60 and back.select("shard").distinct().count() == 4
