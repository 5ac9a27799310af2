import zlib

from pyspark.sql import functions as F

from marlstone.llm import langid, queries

EN, FR = "the cat and the dog were out in the morning with their friends ", "le chat et le chien sont dehors ce matin avec leurs petits amis "


def both(spark):
    return spark.createDataFrame([(i, (EN if i % 2 else FR) * 3, "en" if i % 2 else "fr") for i in range(20)], "doc_id long, text string, lang string")


def test_held_out_accuracy(spark, sf_dir):
    truth = {r["doc_id"]: r for r in queries.documents(spark, sf_dir).collect()}
    rows = queries.op6(spark, sf_dir).collect()
    assert len(rows) == len(truth)
    right = [r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in rows if r["held_out"] and truth[r["doc_id"]]["lang"]]
    assert right and sum(right) >= 0.95 * len(right)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)


def test_counts_are_those_of_all_texts(spark):
    rows = both(spark)
    found = {(r["lang"], r["bucket"]): r["n"] for r in langid.count(rows, "text", "lang").collect()}
    want = {}
    for r in rows.collect():
        for g in langid.grams(r["text"]).tolist():
            want[r["lang"], g] = want.get((r["lang"], g), 0) + 1
    assert found == want


def test_mixtures(spark):
    model = langid.train(both(spark))
    docs = spark.createDataFrame([(0, EN * 5), (1, FR * 5), (2, EN * 10 + FR * 5)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert rows[0]["shares"] == {"en": 1.0} and rows[1]["shares"] == {"fr": 1.0}
    assert set(rows[2]["shares"]) == {"en", "fr"} and rows[2]["lang_pred"] == "en" and 0.5 < rows[2]["score"] < 0.8


def test_likelihood_never_falls(spark):
    _, table = langid.train(both(spark))
    import numpy as np

    found, n = np.unique(langid.grams(EN + FR), return_counts=True)
    likely = np.exp(table[found].astype(float))
    share, last = np.full(2, 0.5), -np.inf
    for _ in range(10):
        fit = n @ np.log((likely * share).sum(axis=1))
        assert fit >= last - 1e-9
        last, weighted = fit, likely * share
        share = (n / weighted.sum(axis=1)) @ weighted / n.sum()


def test_odd_rows(spark, odd, empty):
    model = langid.train(both(spark))
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count()
    assert all((r["lang_pred"] == "und") == (r["score"] == 0) for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (None, 0, 1, 2, 3, 7)} == {"und"}
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.train(empty)).collect()} == {"und"}


def test_inputs_are_texts_only(spark):
    model = langid.train(both(spark))
    docs = both(spark)
    other = docs.withColumn("lang", F.lit("xx"))
    get = lambda d: sorted((r["doc_id"], r["lang_pred"]) for r in langid.identify(d, model).collect())
    assert get(docs) == get(other)
