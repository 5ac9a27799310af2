import pytest

from marlstone import sources
from marlstone.operators import hierarchy, normalize, validate
from marlstone.sources import Manifest, SourceError, parsers

from . import fixture

XML = Manifest(format="xml", columns={"code": "@code", "level": "@level"})
FORMATS = {
    "csv": (fixture.as_delimited, Manifest()), "tsv": (lambda: fixture.as_delimited("\t"), Manifest()), "json": (fixture.as_json, Manifest()), "xml": (fixture.as_xml, XML),
    "claml.xml": (fixture.as_claml, Manifest()), "xlsx": (fixture.as_xlsx, Manifest()), "txt": (lambda: fixture.TEXT.encode(), Manifest()),
}


def built(spark, tmp_path, name, infer=False):
    make, manifest = FORMATS[name]
    path = tmp_path / f"list.{name}"
    path.write_bytes(make())
    records, issues = normalize.from_source(sources.read_rows(spark, str(path), manifest), manifest)
    nodes, more = hierarchy.build(records, infer)
    return records, nodes, issues.unionByName(more)


@pytest.mark.parametrize("name", list(FORMATS))
def test_formats_give_the_same_tree(spark, tmp_path, name):
    records, nodes, issues = built(spark, tmp_path, name)
    got = {r["code"]: (r["level"], r["title"], (r["parent_key"] or ":").split(":", 1)[1] or None, r["depth"]) for r in nodes.collect()}
    depth = {"CHAPTER": 0, "BLOCK": 1, "CATEGORY": 2, "SUBCATEGORY": 3}
    assert got == {c: (lv, t, p, depth[lv]) for lv, c, t, p, _ in fixture.TREE}
    assert not [r for r in issues.collect() if r["severity"] == "ERROR"]
    by_code = {r["code"]: r for r in records.collect()}
    assert by_code["A00"]["inclusions"] == ["stripped wheel teeth"]
    excluded = [(i["text"], i["target_code"]) for i in by_code["A00"]["instructions"] if i["instruction_type"] == "EXCLUDES"]
    assert excluded == [("broken mainspring (A01.1)", "A01.1")]
    last = [i for i in by_code["A01"]["instructions"] if i["instruction_type"] == "USE_ADDITIONAL_CODE"][0]
    assert last["target_code"] is None and last["referenced_codes"] == ["B10-B11"]
    if name == "claml.xml":
        assert [r["code"] for r in issues.collect()] == ["MODIFIERS_NOT_EXPANDED"]


def test_positions(spark, tmp_path):
    _, nodes, _ = built(spark, tmp_path, "csv")
    rows = {r["code"]: r for r in hierarchy.insert_order(nodes).collect()}
    assert rows["A00.1"]["category_key"] == "CATEGORY:A00" and rows["A00.1"]["block_key"] == "BLOCK:A00-A09" and rows["A00.1"]["chapter_key"] == "CHAPTER:I"
    assert [rows[c]["selectable"] for c in ("A00", "A00.0", "B10", "B11")] == [False, True, False, True]
    assert sorted(r["node_id"] for r in rows.values()) == list(range(1, 12)) and rows["I"]["node_id"] == 1


def test_validation_of_a_sound_source(spark, tmp_path):
    records, nodes, _ = built(spark, tmp_path, "json")
    system = validate.system_for("synth-icd")
    found = validate.record_issues(records, system).unionByName(validate.reference_issues(records, system)).unionByName(validate.hierarchy_issues(nodes))
    assert [(r["code"], r["record_code"]) for r in found.collect()] == [("NON_SELECTABLE_LEAF", "B10")]
    assert not validate.blocks_import(found) and validate.metadata_issues(fixture.DATASET) == []
    row = validate.statistics(records, found).first()
    assert row["records"] == 11 and row["levels"]["CATEGORY"] == 4 and row["severities"] == {"INFO": 1}


def test_every_fault_is_found(spark):
    rows = [
        ("CATEGORY", "A00", "one", None, None), ("CATEGORY", "A00", "again", None, None), ("CATEGORY", "A0-0", "clash", None, None), ("CATEGORY", "ZZZ", "malformed", None, None), ("CATEGORY", None, "no code", None, None),
        ("CATEGORY", "A03", None, None, None), ("ODD", "A04", "bad level", None, None), ("SUBCATEGORY", "A05.1", "lost", "A05", None), ("CATEGORY", "A06", "ring", "A07", None), ("CATEGORY", "A07", "ring", "A06", None),
        ("CHAPTER", "I", "empty", None, None), ("CATEGORY", "B00", "refers", None, "x (Q99.9)"), ("BLOCK", "A00-A02", "inverted", "A00", None), ("SUBCATEGORY", "C01.1", "mismatch", "A03", None),
    ]
    table = spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], "level string, code string, title string, parent_code string, exclusions string, _order long")
    from pyspark.sql import functions as F

    from marlstone.schemas import PROVENANCE

    records = normalize.records(normalize.project(table.withColumn("_provenance", F.lit(None).cast(PROVENANCE))))
    system = validate.system_for("SYNTH-ICD")
    nodes, issues = hierarchy.build(records)
    found = issues.unionByName(validate.record_issues(records, system)).unionByName(validate.reference_issues(records, system)).unionByName(validate.hierarchy_issues(nodes))
    codes = {r["code"] for r in found.collect()}
    assert codes >= {
        "DUPLICATE_CODE", "DUPLICATE_NORMALIZED_CODE", "MALFORMED_CODE", "MISSING_CODE", "MISSING_TITLE", "INVALID_LEVEL", "MISSING_PARENT", "HIERARCHY_CYCLE", "EMPTY_SECTION", "UNRESOLVED_CROSS_REFERENCE", "HIERARCHY_LEVEL_INCONSISTENT",
        "HIERARCHY_CODE_MISMATCH", "ORPHAN_RECORD", "RECORD_WITHOUT_PROVENANCE",
    }
    assert validate.blocks_import(found)
    empty = validate.record_issues(records.where("level = 'CHAPTER'"), system)
    assert "EMPTY_DATASET" in {r["code"] for r in empty.collect()}


def test_parents_are_inferred(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("level,code,title,range_start,range_end\nCHAPTER,I,c,A00,A19\nBLOCK,A00-A09,b,A00,A09\n,A01,x,,\n,A01.2,y,,\n,B05,z,,\n")
    records, _ = normalize.from_source(sources.read_rows(spark, str(path)), Manifest())
    nodes, issues = hierarchy.build(records, infer_parents=True)
    assert {r["code"]: r["parent_key"] for r in nodes.collect()} == {"I": None, "A00-A09": "CHAPTER:I", "A01": "BLOCK:A00-A09", "A01.2": "CATEGORY:A01", "B05": None}
    assert sorted(r["code"] for r in issues.collect()) == ["ORPHAN_RECORD", *["PARENT_INFERRED"] * 3]


def test_rules_table(spark, tmp_path):
    records, _, _ = built(spark, tmp_path, "csv")
    rules = spark.createDataFrame(
        [("A00", None, "Excludes1", "lost key", "B11", None, 1), ("a01", "category", "inclusion", "snapped spring", None, None, 2), ("B11", None, "synonym", "key gone", None, None, 3), ("B11", None, "index term", "key, lost", "B11", None, 4),
         ("Z99", None, "note", "x", None, None, 5), ("A00", None, "odd", "x", None, None, 6), ("A00", None, "note", " ", None, None, 7), (None, None, "note", "x", None, None, 8)],
        "owner_code string, owner_level string, rule_type string, text string, target_code string, exclusion_type string, _order int",
    )
    out, issues = normalize.attach_rules(records, rules)
    by_code = {r["code"]: r for r in out.collect()}
    assert out.count() == records.count() and by_code["A01"]["inclusions"] == ["snapped spring"]
    added = by_code["A00"]["instructions"][-1]
    assert (added["instruction_type"], added["exclusion_type"], added["target_code"]) == ("EXCLUDES", "EXCLUDES1", "B11")
    assert sorted(r["code"] for r in issues.collect()) == ["EMPTY_RULE", "RULE_WITHOUT_OWNER", "RULE_WITHOUT_OWNER", "UNKNOWN_RULE_TYPE"]
    terms, entries = normalize.terms_and_entries(out)
    assert {(r["key"], r["term"]) for r in terms.where("term_type = 'SYNONYM'").collect()} == {("CATEGORY:A00", "gear wear"), ("CATEGORY:B11", "key gone")}
    assert {r["lead_term"]: r["candidate_code"] for r in entries.collect()} == {"spring, snapped": "A01.1", "key, lost": "B11"}


def test_encodings_detection_and_refusals(spark, tmp_path):
    path = tmp_path / "legacy.csv"
    path.write_bytes("code,title\nA00,Café – lamp\n".encode("cp1252"))
    assert sources.read_rows(spark, str(path)).first()["title"] == "Café – lamp"
    assert sources.detect("a.xlsx", b"PK\x03")["xlsx"] == 0.9 and sources.detect("a.xlsx", b"no")["xlsx"] == 0.1 and sources.detect("x", b"%PDF-1")["pdf"] == 0.9
    unsafe = tmp_path / "u.xml"
    unsafe.write_text('<!DOCTYPE a [<!ENTITY b SYSTEM "file:///etc/passwd">]><a>&b;</a>')
    with pytest.raises(SourceError):
        list(parsers.xml_records(unsafe.read_bytes(), "u.xml", Manifest()))
    with pytest.raises(SourceError):
        list(parsers.delimited(",")(b"", "e.csv", Manifest()))
    (tmp_path / "a.bin").write_bytes(b"??")
    with pytest.raises(SourceError):
        sources.select_format(spark, str(tmp_path / "a.bin"))
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    with pytest.raises(SourceError):
        sources.read_rows(spark, str(tmp_path / "a.pdf"))
    import hashlib

    assert sources.digest(spark, str(path)).first()["sha256"] == hashlib.sha256(path.read_bytes()).hexdigest()
