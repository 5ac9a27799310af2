from collections import Counter

import pytest

from marlstone.llm import pieces, queries, tokencounts


def as_dict(totals):
    return {(r["source"], r["lang"]): (r["documents"], r["tokens"]) for r in totals.collect()}


def test_query_totals(spark, sf_dir):
    library = pieces.load(open(queries.piece_model(), "rb").read())
    n, tokens = Counter(), Counter()
    for r in queries.documents(spark, sf_dir).collect():
        n[r["source"], r["lang"]] += 1
        tokens[r["source"], r["lang"]] += len(library.encode(r["text"] or ""))
    assert as_dict(queries.op8(spark, sf_dir)) == {k: (n[k], tokens[k]) for k in n}


def rows(spark, *items):
    return spark.createDataFrame([(s, lang, "t@1", n) for s, lang, n in items], "source string, lang string, tokenizer string, n_tokens long")


def test_inserts_deletes_revisions(spark, tmp_path):
    rollup = tokencounts.Rollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0
    assert rollup.commit("a", tokencounts.inserts(rows(spark, ("x", "en", 5), ("x", "en", 7), (None, None, 1), ("y", "fr", 2))))
    assert rollup.commit("b", tokencounts.deletes(rows(spark, ("y", "fr", 2), ("x", "en", 5))))
    assert rollup.commit("c", tokencounts.revisions(rows(spark, ("x", "en", 7)), rows(spark, ("x", "de", 9))))
    assert as_dict(rollup.totals()) == {("x", "de"): (1, 9), (None, None): (1, 1)}
    assert rollup.batches() == ["a", "b", "c"]


def test_a_batch_counts_once(spark, tmp_path):
    rollup = tokencounts.Rollup(spark, f"file://{tmp_path}/r")
    changes = tokencounts.inserts(rows(spark, ("x", "en", 5)))
    assert rollup.commit("a", changes) and not rollup.commit("a", changes)
    assert not tokencounts.Rollup(spark, f"file://{tmp_path}/r").commit("a", changes)
    assert as_dict(rollup.totals()) == {("x", "en"): (1, 5)}


def test_a_failed_batch_runs_again(spark, tmp_path):
    rollup = tokencounts.Rollup(spark, f"file://{tmp_path}/r")
    changes = tokencounts.inserts(rows(spark, ("x", "en", 5)))
    changes.write.parquet(f"file://{tmp_path}/r/.a-lost/0")  # what a lost job leaves
    assert rollup.commit("a", changes) and as_dict(rollup.totals()) == {("x", "en"): (1, 5)}
    with pytest.raises(ValueError):
        rollup.commit("../x", changes)


def test_odd_rows(spark, odd, empty, tmp_path):
    found = tokencounts.counted(odd, {"m": queries.piece_model()})
    assert found.count() == odd.count() and found.where("n_tokens is null").count() == 0
    rollup = tokencounts.Rollup(spark, f"file://{tmp_path}/r")
    rollup.commit("none", tokencounts.inserts(tokencounts.counted(empty, {"m": queries.piece_model()})))
    assert rollup.totals().count() == 0


def test_the_slower_of_two_writers_adds_to_the_other(spark, tmp_path, monkeypatch):
    one, two = (tokencounts.Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    one.commit("first", tokencounts.inserts(rows(spark, ("x", "en", 1))))
    real, between = tokencounts.publish, []

    def late(*names):  # another writer takes the version just before
        if not between:
            between.append(1)
            assert two.commit("other", tokencounts.inserts(rows(spark, ("x", "en", 100), ("y", "en", 7))))
        return real(*names)

    monkeypatch.setattr(tokencounts, "publish", late)
    assert one.commit("late", tokencounts.inserts(rows(spark, ("x", "en", 10))))
    assert as_dict(one.totals()) == {("x", "en"): (3, 111), ("y", "en"): (1, 7)}
    assert two.batches() == ["first", "other", "late"]


def test_the_query_runs_deletes_and_revisions(spark, sf_dir, monkeypatch):
    seen = []
    real = tokencounts.Rollup.commit
    monkeypatch.setattr(tokencounts.Rollup, "commit", lambda self, batch, changes: seen.append((batch, changes.where("documents < 0").count())) or real(self, batch, changes))
    queries.op8(spark, sf_dir)
    assert [b for b, _ in seen] == ["load", "revise", "revise", "delete", "restore"] and seen[1][1] > 0 and seen[3][1] > 0
