import math
import zlib
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import lm, queries
from marlstone.llm.batches import lower_words


def brute(docs):
    """docs: (id, text) -> id -> held out, tokens, known, N, base score, score of the smoothed model without a filter."""
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in docs}
    counts, both = Counter(), Counter()
    for k, t in docs:
        if not held[k]:
            words = [*lower_words(t), None]
            counts.update(words)
            both.update(zip([None, *words], words))
    total, distinct = sum(counts.values()), len(counts)

    def value(c):
        return c if c < 2 else 1.5 * 2.0 ** (c.bit_length() - 1)

    def probability(first, word):
        pair = value(both[first, word])
        share = min(1.0, pair / max(value(counts[first]), pair, 1.0))
        return min(1.0, lm.PAIR_WEIGHT * share + (1 - lm.PAIR_WEIGHT) * (value(counts[word]) + 0.5) / (total + 0.5 * (distinct + 1)))

    out = {}
    for k, t in docs:
        words = [*lower_words(t), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        out[k] = (held[k], len(words), sum(counts[w] > 0 for w in words), total, base, sum(math.log10(probability(a, b)) for a, b in zip([None, *words], words)))
    return out


def same(rows, want):
    assert len(rows) == len(want)
    apart = []
    for r in rows:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9)
        apart.append(abs(r["score"] - w[5]) / w[1])
    # a false member lifts a level in 1.2 % of the probes, which moves a token's log10 by 0.3 or, if unseen, more
    assert np.mean(apart) < 0.02 and max(apart) < 0.3


def rows_of(spark, sf_dir):
    return queries.documents(spark, sf_dir).withColumn("held_out", lm.held_out(queries.F.col("doc_id")))


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in queries.documents(spark, sf_dir).collect()]
    same(queries.op9(spark, sf_dir).collect(), brute(docs))


@pytest.mark.parametrize("bound", ["MAX_FILTER_BYTES", "MAX_TABLE_ENTRIES"])
def test_beyond_a_bound_the_scores_are_the_same(spark, sf_dir, monkeypatch, bound):
    rows = rows_of(spark, sf_dir)
    whole = lm.score(rows, lm.train(rows.where("not held_out")), carry=("doc_id", "held_out")).collect()
    monkeypatch.setattr(lm, bound, 100)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(lm, "SALT_BYTES", 100_000)
    model = lm.train(rows.where("not held_out"))
    assert model.table is not None
    asked = lm.score(rows, model, carry=("doc_id", "held_out"))
    got = {r["doc_id"]: r for r in asked.collect()}
    assert len(got) == len(whole)
    for r in whole:
        assert got[r["doc_id"]][:4] == r[:4] and got[r["doc_id"]]["score"] == pytest.approx(r["score"], rel=1e-9)
        assert got[r["doc_id"]]["base_score"] == pytest.approx(r["base_score"], rel=1e-9)


def test_the_texts_are_dealt_once(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "MAX_FILTER_BYTES", 100)
    rows = rows_of(spark, sf_dir)
    execution = lm.score(rows, lm.train(rows))._jdf.queryExecution()
    execution.executedPlan().execute().count()
    assert "ReusedExchange" in execution.executedPlan().toString()


def test_more_segments_change_no_count(spark, sf_dir, monkeypatch):
    rows = rows_of(spark, sf_dir)
    few = {r["doc_id"]: r for r in lm.score(rows, lm.train(rows)).collect()}
    monkeypatch.setattr(lm, "MIN_SEGMENTS", 2048)
    model = lm.train(rows)
    assert model.segments == 2048
    for r in lm.score(rows, model).collect():
        assert r["base_score"] == pytest.approx(few[r["doc_id"]]["base_score"]) and r["n_known"] == few[r["doc_id"]]["n_known"]


def test_segments_grow_with_the_text():
    assert lm.segments_for(0) == lm.segments_for(1 << 30) == 256
    assert lm.segments_for(30 << 30) == 2048 and lm.segments_for(1 << 60) == lm.MAX_SEGMENTS


def test_filter_holds_quantised_counts(spark):
    texts = ["a b a b a b c", "a b d", "a b"] * 40 + ["e f"]
    model = lm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    words, pairs = Counter(), Counter()
    for t in texts:
        w = [lm.END, *(np.uint64(lm.xxhash.xxh64_intdigest(x)) for x in lower_words(t)), lm.END]
        words.update(int(x) for x in w[1:])
        pairs.update((int(a), int(b)) for a, b in zip(w, w[1:]))
    got, want = model.level(np.array(list(words), np.uint64), 1), lm.levels(np.array(list(words.values())))
    assert (got >= want).all() and (got == want).mean() > 0.8  # a Bloom filter never misses
    hashes = lm.pairs(*(np.array(x, np.uint64) for x in zip(*pairs)))
    assert (model.level(hashes, 2) >= lm.levels(np.array(list(pairs.values())))).all()
    assert (model.tokens, model.words) == (sum(words.values()), len(words))


def test_strangers_pass_a_level_as_often_as_stated(spark):
    model = lm.train(spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(20_000)))], "doc_id long, text string"))
    strangers = np.random.default_rng(1).integers(0, 1 << 56, 100_000, dtype=np.uint64)
    assert 0.005 < (model.level(strangers, 2) > 0).mean() < 0.02


def test_seen_texts_score_higher(spark):
    docs = spark.createDataFrame([(i, "one two three four five six seven eight") for i in range(30)], "doc_id long, text string")
    probe = spark.createDataFrame([(0, "one two three four five six seven eight"), (1, "eight one seven two six three five four"), (2, "q w e r t y u i")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in lm.score(probe, lm.train(docs)).collect()}
    assert score[0] > score[1] > score[2]


def test_blocks_give_back_what_was_packed():
    for hashes in ([7], [1, 2], [0, 1 << 63, (1 << 64) - 1], [5, 5 + (1 << 39), 6 + (1 << 40)]):
        for counts in (None, [1] * len(hashes), [300] * len(hashes), [1 << 40] * len(hashes)):
            own = np.array(hashes, np.uint64)
            a, b = lm.unpack(lm.pack(own, None if counts is None else np.array(counts)), len(own))
            assert (a == own).all() and (b is None if counts is None else b.tolist() == counts)


@pytest.mark.parametrize("most", [lm.MAX_FILTER_BYTES, 0])
def test_odd_rows(odd, empty, most, monkeypatch):
    monkeypatch.setattr(lm, "MAX_FILTER_BYTES", most)
    carry = ("doc_id", "lang", "shard")
    trained = lm.train(odd)
    assert len(lm.score(odd, trained, carry=carry).collect()) == odd.count()
    assert lm.score(empty, trained).count() == 0
    rows = lm.score(odd, lm.train(empty)).collect()
    assert len(rows) == odd.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)


def test_pairs_seen_once_are_held(spark):
    model = lm.train(spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(500)))], "doc_id long, text string"))
    words = np.array([lm.xxhash.xxh64_intdigest(f"w{i}") for i in range(500)], np.uint64)
    assert (model.level(lm.pairs(words[:-1], words[1:]), 2) >= 1).all()
