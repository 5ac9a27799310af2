"""An invented classification in every format: workshop faults, no clinical content."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from xml.sax.saxutils import escape

#: (level, code, title, parent, fields)
TREE = [
    ("CHAPTER", "I", "Faults of clocks", None, {"range_start": "A00", "range_end": "A19"}),
    ("BLOCK", "A00-A09", "Faults of the movement", "I", {"range_start": "A00", "range_end": "A09", "notes": ["Report the maker as well."]}),
    ("CATEGORY", "A00", "Worn gear train", "A00-A09", {"inclusions": ["stripped wheel teeth"], "exclusions": ["broken mainspring (A01.1)"], "synonyms": ["gear wear"]}),
    ("SUBCATEGORY", "A00.0", "Worn left gear train", "A00", {}),
    ("SUBCATEGORY", "A00.1", "Worn right gear train", "A00", {"code_first": ["Code first the fall (B10)"]}),
    ("CATEGORY", "A01", "Broken mainspring", "A00-A09", {"abbreviations": ["BMS"], "use_additional_code": ["Use additional code for the key (B10-B11)"]}),
    ("SUBCATEGORY", "A01.1", "Broken mainspring with cracked barrel", "A01", {"index_terms": ["spring, snapped"]}),
    ("CHAPTER", "II", "Outside causes", None, {"range_start": "B10", "range_end": "B19"}),
    ("BLOCK", "B10-B19", "Accidents", "II", {"range_start": "B10", "range_end": "B19"}),
    ("CATEGORY", "B10", "Fall from a shelf", "B10-B19", {"selectable": "false"}),
    ("CATEGORY", "B11", "Lost winding key", "B10-B19", {}),
]
DATASET = {"coding_system": "SYNTH-ICD", "country": "XX", "version": "1", "language": "en", "source_sha256": "0" * 64}


def flat():
    return [{"level": lv, "code": c, "title": t, "parent_code": p, **{k: "|".join(v) if isinstance(v, list) else v for k, v in f.items()}} for lv, c, t, p, f in TREE]


def as_delimited(separator=","):
    names = ["level", "code", "title", "parent_code", "range_start", "range_end", "selectable", "notes", "inclusions", "exclusions", "synonyms", "abbreviations", "index_terms", "code_first", "use_additional_code"]
    out = io.StringIO()
    writer = csv.DictWriter(out, names, delimiter=separator)
    writer.writeheader()
    writer.writerows(flat())
    return out.getvalue().encode()


def as_json():
    nodes = {c: {"code": c, "level": lv, "title": t, **f, "children": []} for lv, c, t, _, f in TREE}
    for _, c, _, p, _ in TREE:
        if p:
            nodes[p]["children"].append(nodes[c])
    return json.dumps({"dataset": DATASET, "chapters": [nodes[c] for _, c, _, p, _ in TREE if not p]}).encode()


def as_xml():
    rows = []
    for lv, c, t, p, f in TREE:
        parts = "".join(f"<{k}>{escape(x)}</{k}>" for k, v in f.items() for x in (v if isinstance(v, list) else [v]))
        rows.append(f'<record code="{c}" level="{lv}"><title>{escape(t)}</title>' + (f"<parent_code>{p}</parent_code>" if p else "") + parts + "</record>")
    return ("<list>" + "".join(rows) + "</list>").encode()


def as_claml():
    kinds = {"CHAPTER": "chapter", "BLOCK": "block"}
    rubrics = {"inclusions": "inclusion", "exclusions": "exclusion", "notes": "note", "synonyms": "synonym", "code_first": "code-first", "use_additional_code": "use-additional"}
    rows = []
    for lv, c, t, p, f in TREE:
        body = f'<Rubric kind="preferred"><Label>{escape(t)}</Label></Rubric>'
        body += "".join(f'<Rubric kind="{rubrics[k]}"><Label>{escape(x)}</Label></Rubric>' for k, v in f.items() if k in rubrics for x in v)
        rows.append(f'<Class code="{c}" kind="{kinds.get(lv, "category")}">' + (f'<SuperClass code="{p}"/>' if p else "") + body + "</Class>")
    return ("<ClaML>" + "".join(rows) + "<ModifierClass code='x'/></ClaML>").encode()


def as_xlsx():
    names = list(dict.fromkeys(k for r in flat() for k in r))
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda v: f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>' if v else "<c/>"
    lines = [names, *([r.get(n) for n in names] for r in flat())]
    rows = "".join(f'<row r="{i + 1}">' + "".join(map(cell, line)) + "</row>" for i, line in enumerate(lines))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="records" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


TEXT = """Workshop list            page 1

Chapter I  Faults of clocks
A00-A09 Faults of the movement
  Note: Report the maker as well.
A00 Worn gear train
    Includes: stripped wheel teeth
    Excludes: broken mainspring (A01.1)
A00.0 Worn left gear train
A00.1 Worn right gear
    train
    Code first the fall (B10)
\fWorkshop list            page 2

A01 Broken mainspring
    Use additional code for the key (B10-B11)
A01.1 Broken mainspring with cracked bar-
    rel
Chapter II  Outside causes
B10-B19 Accidents
B10 Fall from a shelf
B11 Lost winding key
"""
