"""One parser for each format: the bytes of a file in, rows out."""

from __future__ import annotations

import csv
import io
import json
import re
import unicodedata
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from ..schemas import RECORD_FIELDS as _FIELDS
from .base import LIST_FIELDS, Manifest, SourceError, record

Parser = Callable[[bytes, str, Manifest], Iterator[dict]]


def decoded(content: bytes, encoding: str | None = None) -> str:
    """Text by the stated encoding, else the first of UTF-8, Windows-1252 and Latin-1 that fits."""
    for name in [encoding] if encoding else ["utf-8-sig", "cp1252", "latin-1"]:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    raise SourceError(f"the file is not in {encoding}")


def split_list(value: object, separator: str) -> list[str]:
    if value is None:
        return []
    parts = value if isinstance(value, list | tuple) else str(value).split(separator) if separator else [value]
    return [t for t in (" ".join(str(p).split()) for p in parts) if t]


def _mapped(source: dict, manifest: Manifest) -> dict[str, object]:
    """Canonical values of a source row: text, whole floats as integers, lists split."""
    out: dict[str, object] = {}
    for name, value in ((f, source.get(manifest.source_field(f))) for f in _FIELDS):
        if name in LIST_FIELDS:
            out[name] = split_list(value, manifest.list_separator)
        elif value is not None:
            out[name] = str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)
    return out


def delimited(separator: str) -> Parser:
    def parse(content: bytes, file: str, manifest: Manifest) -> Iterator[dict]:
        reader = csv.reader(io.StringIO(decoded(content, manifest.encoding), newline=""), delimiter=separator)
        header = next(reader, None)
        if not header or not any(h.strip() for h in header):
            raise SourceError(f"{file} has no header")
        names = [h.strip() for h in header]
        for n, cells in enumerate(reader, 1):
            if any(c.strip() for c in cells):
                yield record(_mapped(dict(zip(names, cells)), manifest), n, file, "csv" if separator == "," else "tsv", row=n)

    return parse


def delimited_rules(content: bytes, separator: str, encoding: str | None = None) -> list[dict[str, str]]:
    """Rows of a separate rules table, with ``_order``."""
    reader = csv.DictReader(io.StringIO(decoded(content, encoding), newline=""), delimiter=separator)
    return [{k.strip(): v for k, v in r.items() if k} | {"_order": n} for n, r in enumerate(reader, 1)]


def _dig(document: object, path: str) -> object:
    for step in filter(None, path.split(".")):
        document = document.get(step) if isinstance(document, dict) else None
    return document


def json_records(content: bytes, file: str, manifest: Manifest) -> Iterator[dict]:
    """Nested records in depth-first order; nesting gives the parent where none is stated."""
    roots = _dig(json.loads(decoded(content, manifest.encoding)), manifest.records_path)
    if not isinstance(roots, list):
        raise SourceError(f"{file} has no list at {manifest.records_path!r}")
    order = 0
    stack = [(x, None, None, f"{manifest.records_path}[{i}]") for i, x in reversed(list(enumerate(roots)))]
    while stack:
        item, parent, parent_level, path = stack.pop()
        order += 1
        if not isinstance(item, dict):
            yield record({}, order, file, "json", issue="PARSER_FAILURE", element_path=path)
            continue
        structured = [(f, str(x.get("text") or ""), x.get("target_code"), x.get("exclusion_type")) for f in LIST_FIELDS for x in item.get(manifest.source_field(f)) or [] if isinstance(x, dict)]
        plain = {k: [x for x in v if not isinstance(x, dict)] if isinstance(v, list) else v for k, v in item.items()}
        values = _mapped(plain, manifest)
        if not values.get("parent_code") and parent:
            values |= {"parent_code": parent, "parent_level": parent_level}
        yield record(values, order, file, "json", structured, element_path=path)
        below = item.get(manifest.children_key) or []
        stack += [(x, values.get("code"), values.get("level"), f"{path}.{manifest.children_key}[{i}]") for i, x in reversed(list(enumerate(below)))]


def json_dataset(content: bytes, manifest: Manifest) -> dict:
    """The dataset's own description inside a JSON file."""
    found = _dig(json.loads(decoded(content, manifest.encoding)), manifest.dataset_path)
    return found if isinstance(found, dict) else {}


def _safe_xml(content: bytes, file: str) -> ElementTree.Element:
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", content, re.I):
        raise SourceError(f"{file} declares a document type or entities, which are not read")
    return ElementTree.fromstring(content)


def _text(element: ElementTree.Element) -> str:
    return " ".join("".join(element.itertext()).split())


def _at(element: ElementTree.Element, path: str) -> list[str]:
    """Texts or attributes at ``a/b``, ``@x`` or ``a/@x``."""
    steps, _, attribute = path.partition("@")
    found = element.findall(steps.rstrip("/")) if steps.rstrip("/") else [element]
    return [v for v in ((e.get(attribute) or "" if attribute else _text(e)) for e in found) if v]


def xml_records(content: bytes, file: str, manifest: Manifest) -> Iterator[dict]:
    root = _safe_xml(content, file)
    if manifest.claml or root.tag.rsplit("}", 1)[-1] == "ClaML":
        yield from claml_records(root, file)
        return
    order = 0
    stack = [(e, None) for e in reversed(root.findall(manifest.record_path))]
    while stack:
        element, parent = stack.pop()
        order += 1
        values: dict[str, object] = {}
        for f in _FIELDS:
            found = _at(element, manifest.source_field(f))
            if found:
                values[f] = found if f in LIST_FIELDS else found[0]
        if parent and not values.get("parent_code"):
            values["parent_code"] = parent
        yield record(values, order, file, "xml", element_path=f"{manifest.record_path}[{order}]")
        if manifest.children_path:
            stack += [(e, values.get("code")) for e in reversed(element.findall(manifest.children_path))]


#: Rubric kind -> field, fixed values.
RUBRICS = {
    "preferred": "title", "inclusion": "inclusions", "exclusion": "exclusions", "note": "notes", "text": "notes", "coding-hint": "other_instructions", "definition": "description", "introduction": "notes",
    "code-first": "code_first", "code-also": "code_also", "use-additional": "use_additional_code", "synonym": "synonyms",
}
CLASS_LEVELS = {"chapter": "CHAPTER", "block": "BLOCK"}


def claml_records(root: ElementTree.Element, file: str) -> Iterator[dict]:
    """Classes with their rubrics; modifiers are reported and not expanded."""
    order = 0
    for n, _ in enumerate(root.iter("ModifierClass"), 1):
        if n == 1:
            yield record({}, 0, file, "xml", issue="MODIFIERS_NOT_EXPANDED")
    for element in root.iter("Class"):
        order += 1
        values: dict[str, object] = {"code": element.get("code"), "level": CLASS_LEVELS.get(element.get("kind") or "")}
        above = element.find("SuperClass")
        if above is not None:
            values["parent_code"] = above.get("code")
        structured = []
        for rubric in element.findall("Rubric"):
            name = RUBRICS.get(rubric.get("kind") or "", "other_instructions")
            for label in rubric.findall("Label"):
                targets = [_text(r) for r in label.iter("Reference")]
                if name in LIST_FIELDS and len(targets) == 1:
                    structured.append((name, _text(label), targets[0], None))
                elif name in LIST_FIELDS:
                    values.setdefault(name, []).append(_text(label))
                else:
                    values.setdefault(name, _text(label))
        yield record(values, order, file, "xml", structured, element_path=f"Class[{order}]")


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheets(content: bytes, file: str) -> Iterator[tuple[str, list[list[object]]]]:
    """Name and rows of each sheet of a workbook, by the standard library's zip and XML readers."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        part = lambda name: _safe_xml(book.read(name), file)
        strings = [_text(x) for x in part("xl/sharedStrings.xml").findall(f"{_MAIN}si")] if "xl/sharedStrings.xml" in book.namelist() else []
        places = {r.get("Id"): r.get("Target") for r in part("xl/_rels/workbook.xml.rels")}
        for sheet in part("xl/workbook.xml").iter(f"{_MAIN}sheet"):
            rows: list[list[object]] = []
            for row in part("xl/" + places[sheet.get(_REL)].removeprefix("/xl/")).iter(f"{_MAIN}row"):
                while len(rows) < int(row.get("r") or len(rows) + 1) - 1:
                    rows.append([])
                cells: list[object] = []
                for cell in row.findall(f"{_MAIN}c"):
                    at = 0
                    for letter in re.match("[A-Z]*", cell.get("r") or "")[0]:
                        at = at * 26 + ord(letter) - 64
                    cells += [None] * ((at or len(cells) + 1) - 1 - len(cells))
                    value = cell.find(f"{_MAIN}v")
                    kind = cell.get("t")
                    if kind == "inlineStr":
                        cells.append(_text(cell))
                    elif value is None:
                        cells.append(None)
                    else:
                        cells.append(strings[int(value.text)] if kind == "s" else value.text if kind in ("str", "b", "e") else float(value.text))
                rows.append(cells)
            yield sheet.get("name"), rows


def xlsx_records(content: bytes, file: str, manifest: Manifest) -> Iterator[dict]:
    order = 0
    for name, rows in sheets(content, file):
        if name == manifest.rules_sheet or manifest.sheet not in (None, name):
            continue
        header = [str(h or "").strip() for h in rows[manifest.header_row - 1]] if len(rows) >= manifest.header_row else []
        for n, cells in enumerate(rows[manifest.header_row :], manifest.header_row + 1):
            if any(c not in (None, "") for c in cells):
                order += 1
                yield record(_mapped(dict(zip(header, cells)), manifest), order, file, "xlsx", row=n, sheet=name)


# --- indented text: pages, lines, then a state machine over headings ---------------------------

INDENT_POINTS, TAB = 5.0, 4
MARGIN_LINES, REPEAT_SHARE = 2, 0.5
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def tidy(text: str) -> str:
    for a, b in _LIGATURES.items():
        text = text.replace(a, b)
    return " ".join(unicodedata.normalize("NFC", text).replace("­", "").split())


def signature(text: str) -> str:
    """A margin line with its numbers, also a Roman one at the end, made alike."""
    return re.sub(r"(?<![a-z])[ivxlcdm]{1,7}$", "#", re.sub(r"\d+", "#", text.lower()))


def clean_pages(content: str) -> list[tuple[int, int, float, str]]:
    """Page, line, indentation and text of the lines that are no running heads or feet, hyphenated words joined."""
    pages = []
    for p, page in enumerate(content.split("\f"), 1):
        lines = [(p, n, (len(x) - len(x.lstrip(" "))) * INDENT_POINTS, tidy(x)) for n, x in enumerate((y.expandtabs(TAB) for y in page.split("\n")), 1)]
        pages.append([x for x in lines if x[3]])
    edges = [set(range(min(MARGIN_LINES, len(p)))) | (set(range(len(p) - MARGIN_LINES, len(p))) if len(p) > MARGIN_LINES else set()) for p in pages]
    seen = Counter(s for p, e in zip(pages, edges, strict=True) for s in {signature(p[i][3]) for i in e})
    least = max(2, -int(-REPEAT_SHARE * len(pages) // 1))
    kept = [(*x[:3], re.sub(r"\s*\((?:continued|cont\.?)\)\s*$", "", x[3], flags=re.I)) for p, e in zip(pages, edges, strict=True) for i, x in enumerate(p) if i not in e or seen[signature(x[3])] < least]
    out: list[list] = []
    for page, line, indent, text in kept:
        if out and len(out[-1][3]) > 1 and out[-1][3][-1] == "-" and out[-1][3][-2].isalpha() and text[:1].islower():
            word, _, text = text.partition(" ")
            out[-1][3] = out[-1][3][:-1] + word
        if text:
            out.append([page, line, indent, text])
    return [tuple(x) for x in out]


_CHAPTER = re.compile(r"^chapter\s+([IVXLC]+|[0-9]{1,2})\b[\s:.-]*(.*)$", re.I)
_RANGE = re.compile(r"^\(?([A-Z][0-9][0-9A-Z])\s*[-–]\s*([A-Z][0-9][0-9A-Z])\)?[\s:.-]+(\S.*)$")
_RANGE_AFTER = re.compile(r"^(\S.*?)\s*\(([A-Z][0-9][0-9A-Z])\s*[-–]\s*([A-Z][0-9][0-9A-Z])\)$")
_CODE = re.compile(r"^([A-Z][0-9][0-9A-Z](?:\.[0-9A-Z]{1,4})?)\s+(\S.*)$")
#: Marker -> list field, fixed values; the first that fits counts.
_MARKS = (
    (re.compile(r"^(?:includes|incl\.)\s*:?\s*", re.I), "inclusions"), (re.compile(r"^(?:excludes\s*[12]?|excl\.)\s*:?\s*", re.I), "exclusions"), (re.compile(r"^notes?\s*:\s*", re.I), "notes"),
    (re.compile(r"^(?=use\s+additional\s+code\b)", re.I), "use_additional_code"), (re.compile(r"^(?=code\s+first\b)", re.I), "code_first"), (re.compile(r"^(?=code\s+also\b)", re.I), "code_also"), (re.compile(r"^(?=see\s+also\b)", re.I), "see_also"),
)


def text_records(content: bytes, file: str, manifest: Manifest) -> Iterator[dict]:
    """Chapters, blocks and codes from headings; items below them by markers and indentation."""
    order, current, field, item_indent = 0, None, None, 0.0
    above: dict[str, str] = {}
    codes: list[str] = []
    place: dict[str, int] = {}

    def close() -> Iterator[dict]:
        if current is not None:
            yield record(current, order, file, "text", **place)

    for page, line, indent, text in clean_pages(decoded(content, manifest.encoding)):
        new: dict[str, object] | None = None
        if found := _CHAPTER.match(text):
            new = {"level": "CHAPTER", "code": found[1].upper(), "title": found[2] or None}
            above, codes = {"CHAPTER": found[1].upper()}, []
        elif found := _RANGE.match(text) or _RANGE_AFTER.match(text):
            a, b, title = (found[2], found[3], found[1]) if found.re is _RANGE_AFTER else found.groups()
            if found.re is _RANGE or above and current is not None and current.get("level") in ("CHAPTER", "BLOCK") and indent == 0:
                new = {"level": "BLOCK", "code": f"{a}-{b}", "title": title, "range_start": a, "range_end": b, "parent_code": above.get("CHAPTER"), "parent_level": "CHAPTER" if "CHAPTER" in above else None}
                above["BLOCK"], codes = f"{a}-{b}", []
        elif found := _CODE.match(text):
            code = found[1]
            codes = [c for c in codes if code.replace(".", "").startswith(c.replace(".", "")) and c != code]
            new = {"code": code, "title": found[2], "parent_code": codes[-1] if codes else above.get("BLOCK") or above.get("CHAPTER")}
            codes.append(code)
        if new is not None:
            yield from close()
            order, current, field = order + 1, new, None
            place = {"page_start": page, "page_end": page, "line": line}
            continue
        if current is None:
            continue
        place["page_end"] = page
        mark = next(((m, f) for m, f in _MARKS if m.match(text)), None)
        if mark:
            field, item_indent = mark[1], indent
            text = mark[0].sub("", text, count=1)
            if text:
                current.setdefault(field, []).append(text)
        elif field is not None and current.get(field) and indent > item_indent + INDENT_POINTS * 4:
            current[field][-1] += " " + text  # a wrapped item
        elif field is not None:
            current.setdefault(field, []).append(text)
        elif current.get("title") is None or current.get("level") in ("CHAPTER", "BLOCK") or text[:1].islower():
            current["title"] = f"{current.get('title') or ''} {text}".strip()  # a wrapped title; an inclusion without marker starts upper case
        else:
            current.setdefault("inclusions", []).append(text)
    yield from close()


PARSERS: dict[str, Parser] = {"csv": delimited(","), "tsv": delimited("\t"), "json": json_records, "xml": xml_records, "xlsx": xlsx_records, "text": text_records}
