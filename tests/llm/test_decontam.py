import random
from collections import Counter

import pytest

from marlstone.llm import decontam, queries
from marlstone.llm.batches import lower_words


def shingles(words):
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(docs, items):
    """(doc, item) -> largest similarity of a window, over all windows."""
    out = {}
    for doc, text in docs:
        words = lower_words(text)
        for item, own in items:
            target = lower_words(own)
            want = shingles(target)
            best = 0.0
            for a in range(len(words) - len(target) + 1) if target else ():
                got = shingles(words[a : a + len(target)])
                common = sum((got & want).values())
                best = max(best, common / (got.total() + want.total() - common))
            if best >= 0.8:
                out[doc, item] = best
    return out


def same(rows, want):
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows}
    assert got == pytest.approx(want) and len(rows) == len(got)


def test_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in queries.documents(spark, sf_dir).collect() if len(r["text"] or "") < 3000]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    keys = {d for d, _ in docs}
    rows = queries.op10(spark, sf_dir).collect()
    same([r for r in rows if r["doc_id"] in keys], brute(docs, items))


def test_edited_items(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=k))) for i, k in enumerate([1, 2, 4, 5, 8, 15, 30, 60, 30])]
    docs = []
    for i in range(60):
        words = rng.choice(items)[1].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "NEW"
        docs.append((i, " ".join([*rng.choices(vocabulary, k=rng.randrange(40)), *words, *rng.choices(vocabulary, k=rng.randrange(40))]).upper()))
    docs += [(100, items[7][1] * 1 + " " + items[7][1]), (101, None), (102, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([*items, (50, items[6][1]), (51, None), (52, " ")], "item_id long, text string")
    want = brute(docs, [*items, (50, items[6][1])])
    same(decontam.matches(d, b).collect(), want)
    clean = {r["doc_id"] for r in decontam.without(d, b).collect()}
    assert clean == {k for k, _ in docs} - {k for k, _ in want}
    monkeypatch.setattr(decontam, "REGION_WORDS", 3)
    same(decontam.matches(d, b).collect(), want)


def test_blocks_of_the_benchmark(spark):
    b = spark.createDataFrame([(i, " ".join(f"x{i}y{j}" for j in range(20))) for i in range(10)], "item_id long, text string")
    assert sum(len(i.ids) for x in decontam.blocks(b, words=50) for i in x.of_length.values()) == 10
    assert len(list(decontam.blocks(b, words=50))) == 4


def test_index_finds_all_within_radius():
    rng = random.Random(2)
    items = decontam.Items(10)
    for i in range(200):
        items.add(i, [str(rng.randrange(50)).encode() for _ in range(10)])
    for _ in range(100):
        fp = rng.getrandbits(64)
        assert set(items.within(fp).tolist()) == {i for i, x in enumerate(items.fps.tolist()) if (x ^ fp).bit_count() <= decontam.RADIUS}


def test_odd_rows(spark, odd, empty, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontam.matches(odd, b).count() == 0
    kept = decontam.without(odd, b)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert decontam.matches(empty, b).count() == 0 and decontam.matches(odd, b.limit(0)).count() == 0
    assert decontam.without(odd, b.limit(0)).count() == odd.count()


def test_text_shorter_than_the_item(spark):
    words = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(words)), (2, " ".join(f"v{i}" for i in range(9))), (3, "one two three")]
    docs = [(0, " ".join(words[:29])), (1, " ".join(words[3:28])), (2, " ".join(words[:24])), (3, " ".join(f"v{i}" for i in range(8))), (4, " ".join(f"v{i}" for i in range(1, 8))), (5, "one two"), (6, " ".join(words[:25]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {(0, 1): (25 / 26, 0, 29), (1, 1): (21 / 26, 0, 25), (3, 2): (0.8, 0, 8), (6, 1): (21 / 26, 0, 25)}
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"], r["n_words"]) for r in decontam.matches(d, b).collect()} == want
    assert {r["doc_id"] for r in decontam.without(d, b).collect()} == {2, 4, 5}


def test_ids_of_any_type_and_clashing_names(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([("a", f"x y z {item} q"), ("b", "nothing")], "item_id string, text string")
    found = decontam.matches(docs, spark.createDataFrame([("one", item)], "item_id string, text string"), key="item_id")
    assert [tuple(r) for r in found.collect()] == [("a", "one", 1.0, 3, 30)] and found.columns[0] == "key_item_id"


def test_index_answers_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(decontam, "NEAR_BYTES", 2_000)
    items = decontam.Items(20)
    for i in range(50):
        items.add(i, [f"w{i}-{j}".encode() for j in range(20)])
    want = {fp: [i for i, own in enumerate(items.fps.tolist()) if (own ^ fp).bit_count() <= decontam.RADIUS] for fp in items.fps.tolist()}
    for fp in want:
        assert items.within(fp).tolist() == want[fp] and items.near_bytes <= 2_000
