"""What all sources share: the manifest, format detection, and the rows they yield.

A source is one release in one file, so a file is the unit of work: its bytes are read by Spark's
``binaryFile`` reader and parsed by one task, several files in parallel.  Rows have the fields of
``RECORD_FIELDS``, lists as arrays, with ``_order``, ``_provenance``, ``_structured`` (list items with
a target of their own) and ``_file``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import INSTRUCTION_FIELDS, PROVENANCE, RECORD_FIELDS, TERM_FIELDS

#: Largest file that one task parses.
MAX_BYTES = 512 << 20
LIST_FIELDS = ("inclusions", "exclusions", *INSTRUCTION_FIELDS, *TERM_FIELDS)
STRUCTURED = "array<struct<field: string, text: string, target_code: string, exclusion_type: string>>"
ROW = {f: "array<string>" if f in LIST_FIELDS else "string" for f in RECORD_FIELDS} | {"_order": "long", "_provenance": PROVENANCE, "_structured": STRUCTURED, "_file": "string", "_issue": "string"}
PLACES = ("source_filename", "kind", "page_start", "page_end", "row", "sheet", "element_path", "line")


class SourceError(ValueError):
    """A source that cannot, or must not, be read."""


@dataclass(frozen=True)
class Manifest:
    """How to read a source; an unmapped field has the source field of its own name."""

    format: str | None = None
    dataset: Mapping[str, object] = field(default_factory=dict)
    columns: Mapping[str, str] = field(default_factory=dict)
    rule_columns: Mapping[str, str] = field(default_factory=dict)
    list_separator: str = "|"
    level_values: Mapping[str, str] = field(default_factory=dict)
    level_from_shape: bool = True
    encoding: str | None = None
    rules_file: str | None = None
    dataset_path: str = "dataset"
    records_path: str = "chapters"
    children_key: str = "children"
    record_path: str = ".//record"
    children_path: str | None = None
    claml: bool = False
    sheet: str | None = None
    rules_sheet: str | None = None
    header_row: int = 1
    infer_parents: bool = False
    leaves_selectable: bool = True

    def source_field(self, name: str) -> str:
        return self.columns.get(name, name)


#: Format -> file name endings.
ENDINGS = {"csv": (".csv",), "tsv": (".tsv", ".tab"), "json": (".json",), "xml": (".xml",), "xlsx": (".xlsx",), "text": (".txt", ".text"), "pdf": (".pdf",)}


def detect(name: str, head: bytes) -> dict[str, float]:
    """Confidence of each format: 0.6 for the ending, and what the first bytes say instead for xlsx, xml and pdf.  OCR is never found so."""
    out = {f: 0.6 if name.lower().endswith(ends) else 0.0 for f, ends in ENDINGS.items()}
    for fmt, magic in (("xlsx", b"PK"), ("xml", b"<"), ("pdf", b"%PDF")):
        found = head.removeprefix(b"\xef\xbb\xbf").lstrip().startswith(magic)
        if fmt == "pdf":
            out[fmt] = 0.9 if found else 0.0
        elif out[fmt]:
            out[fmt] = 0.9 if found else 0.1
    return out


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def select_format(spark: SparkSession, path: str, manifest: Manifest | None = None) -> str:
    """The manifest's format, else the most likely one."""
    if manifest and manifest.format:
        return manifest.format
    row = _files(spark, path).select("path", F.substring("content", 1, 64).alias("head")).first()
    if row is None:
        raise SourceError(f"no file at {path}")
    scores = detect(row["path"], bytes(row["head"]))
    best = max(scores, key=scores.get)
    if scores[best] <= 0:
        raise SourceError(f"no format for {path}; name one in the manifest")
    return best


def digest(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``bytes`` and ``sha256`` of each file."""
    return _files(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def dataset_metadata(embedded: Mapping[str, object] | None, manifest: Manifest) -> dict[str, object]:
    """The dataset's description: the manifest's over the file's own; never from the file name."""
    merged = {**(embedded or {}), **manifest.dataset}
    lacking = [k for k in ("coding_system", "country", "version", "language") if not merged.get(k)]
    if lacking:
        raise SourceError(f"the dataset's description lacks {', '.join(lacking)}")
    return merged


def record(values: Mapping[str, object], order: int, file: str, kind: str, structured: list[tuple] = (), issue: str | None = None, **place) -> dict:
    """A row from field values, with lists where the fields are lists."""
    out: dict[str, object] = {f: values.get(f) for f in RECORD_FIELDS}
    for f in LIST_FIELDS:
        v = out[f]
        out[f] = [] if v is None else list(v) if isinstance(v, list | tuple) else [v]
    where = {"source_filename": file, "kind": kind, **place}
    return out | {"_order": order, "_provenance": tuple(where.get(p) for p in PLACES), "_structured": list(structured), "_file": file, "_issue": issue}


def read_rows(spark: SparkSession, path: str, manifest: Manifest | None = None) -> DataFrame:
    """The rows of the files at ``path``."""
    from . import parsers

    manifest = manifest or Manifest()
    fmt = select_format(spark, path, manifest)
    parse = parsers.PARSERS.get(fmt)
    if parse is None:
        raise SourceError(f"{fmt} needs a reader that is not part of this library")
    names, schema = list(ROW), ", ".join(f"`{k}` {v}" for k, v in ROW.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, size, content in zip(batch["path"], batch["length"], batch["content"], strict=True):
                if size > MAX_BYTES:
                    raise SourceError(f"{file} has over {MAX_BYTES} bytes")
                rows = list(parse(bytes(content), file.rsplit("/", 1)[-1], manifest))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return _files(spark, path).select("path", "length", "content").mapInPandas(run, schema)
