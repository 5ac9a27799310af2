"""Audits: matching by words, cases from files, selection, reports as Markdown, records that exclusions lead to."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators import audit
from marlstone.plans import suggest


def brute_match(pairs):
    taken = {}
    for score, i, j in sorted(pairs, reverse=True):
        if score >= audit.CONCEPT_MATCH and i not in taken and j not in taken.values():
            taken[i] = j
    return taken


def test_pairs_and_matches(spark):
    expected = [("a", 0, "left knee pains"), ("a", 1, "knee pain"), ("b", 0, "gout"), ("c", 0, ""), ("d", 0, None)]
    found = [("a", 0, ["pain of the left knee", "knee pain"]), ("a", 1, ["left knee pain"]), ("b", 0, ["asthma"]), ("c", 0, [""]), ("d", 0, [])]
    left = spark.createDataFrame(expected, "case_id string, expected_at int, text string")
    right = spark.createDataFrame(found, "case_id string, found_at int, readings array<string>")
    pairs = audit.concept_pairs(left, right, ["case_id"]).collect()
    score = {(r["expected_at"], r["found_at"]): round(r["score"], 6) for r in pairs if r["case_id"] == "a"}
    # a final s does not count; every word of the expected text within a longer one is a full match
    assert score == {(0, 0): 1.0, (0, 1): 1.0, (1, 0): 1.0, (1, 1): 1.0}
    assert {r["case_id"] for r in pairs} == {"a"}
    matched = audit.match_concepts(spark.createDataFrame(pairs), ["case_id"]).collect()
    assert {r["expected_at"]: r["found_at"] for r in matched} == brute_match([(s, i, j) for (i, j), s in score.items()])


def test_matches_of_no_pairs(spark):
    assert audit.match_concepts(spark.createDataFrame([], "case_id string, expected_at int, found_at int, score double"), ["case_id"]).count() == 0


@pytest.mark.parametrize(
    ("title", "parent", "note", "found"),
    [
        ("Acute on chronic gout", "Gout", "acute gout", ["acuity: acute on chronic"]),
        ("Acute on chronic gout", "Gout", "acute-on-chronic gout", []),
        ("Chronic gout", "Gout", "long standing gout", []),
        ("Type 2 diabetes", "Diabetes", "T2DM", []),
        ("Type 2 diabetes", "Diabetes", "type I diabetes", ["subtype: 2"]),
        ("Gout without complication", "Gout", "gout", ["complication: without complication"]),
        ("Gout without complication", "Gout", "uncomplicated gout", []),
        ("Gout due to lead", "Gout", "gout from lead", []),
        ("Gout due to lead", "Gout", "gout", ["cause: due to lead"]),
        ("Gout of knee", "Gout", "gout, knees", []),
        ("Left gout", None, "gout", []),
        ("Left gout", "Gout", None, ["laterality: left"]),
    ],
)
def test_unsupported_details(spark, title, parent, note, found):
    row = spark.createDataFrame([(title, parent, note)], "title string, parent string, note string")
    out = row.select(audit.unsupported_specificity(F.col("title"), F.col("parent"), F.col("note"), F.array().cast("array<string>")).alias("u")).first()["u"]
    assert out == found


@pytest.mark.parametrize("suffix", ["jsonl", "csv"])
def test_cases(spark, tmp_path, suffix):
    path = tmp_path / f"cases.{suffix}"
    if suffix == "csv":
        path.write_text('case_id,note,version\nx,"a, ""b""\nc",1\n,d,\n', encoding="utf-8")
    else:
        path.write_text("\n".join(json.dumps(r) for r in ({"case_id": "x", "note": 'a, "b"\nc', "version": "1"}, {"note": "d"})) + "\n\n", encoding="utf-8")
    rows = audit.load_cases(spark, str(path), "case_id string, note string, version string, expected_code string").collect()
    assert [(r["note"], r["version"], r["expected_code"]) for r in rows] == [('a, "b"\nc', "1", None), ("d", None, None)]
    assert rows[0]["case_id"] == "x" and rows[1]["case_id"].startswith("line-")


def test_selected_cases(spark):
    rows = spark.createDataFrame([(1, ["typo"], "Who", "1"), (2, ["typo", "code"], "other", "1"), (3, None, "WHO", "2")], "id int, tags array<string>, coding_system string, version string")
    ids = lambda **k: [r["id"] for r in audit.select_cases(rows, **k).orderBy("id").collect()]
    assert (ids(), ids(tags=["code"]), ids(system="who"), ids(version="1", tags=["typo"])) == ([1, 2, 3], [2], [1, 3], [1, 2])


def test_markdown(spark):
    rows = spark.createDataFrame([("a|b", 1, 0.5), ("c", None, 2.0)], "k string, n int, share double")
    made = audit.markdown(audit.report({"one": (rows, ["k"]), "two": (rows.agg(F.max("share").alias("most")), [])}))
    assert made.startswith("## one\n\n| item | metric | value |\n|-|-|-|\n| a\\|b | n | 1 |\n| a\\|b | share | 0.5 |\n| c | share | 2 |\n\n## two\n")


def test_gates_of_no_suggestions(spark):
    empty = spark.createDataFrame(
        [], "known boolean, same_version boolean, same_system boolean, ready boolean, fatal_rule boolean, invalid_target boolean, unsupported array<string>, expected_status string, family_code boolean, history_code boolean, forbidden boolean, fabricated int, incorrect int, dataset_resolved boolean"
    )
    rows = audit.safety_report(empty).collect()
    assert len(rows) == 14 and all(r["value"] == 0 and r["holds"] for r in rows)


def test_redirects(spark):
    judged = spark.createDataFrame([(1, "A00", ["A01.1", "B10"]), (1, "B10", None), (2, "A01.1", ["A01.1", "Z99"])], "concept_id long, code string, redirects array<string>")
    nodes = spark.createDataFrame([(7, "A01.1", "ACTIVE"), (8, "B10", "ACTIVE"), (9, "Z99", "DEPRECATED")], "node_id long, code string, status string")
    assert [tuple(r) for r in suggest.redirects(judged, nodes).collect()] == [(1, 7)]
