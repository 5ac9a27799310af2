"""Schemas of the classification tables, and their enumerated values."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations: fixed values.
DATASET_STATUSES = ("PENDING", "PROCESSING", "VALIDATION_FAILED", "INDEXING", "READY", "FAILED", "ARCHIVED")
RUN_STATUSES = ("PENDING", "RUNNING", "COMPLETED", "FAILED", "VALIDATION_FAILED", "SKIPPED")
SEVERITIES = ("ERROR", "WARNING", "INFO")
ASSERTIONS = ("DOCUMENTED", "SUSPECTED", "UNCERTAIN", "NEGATED", "RULED_OUT", "HISTORY", "FAMILY_HISTORY")
CONCEPT_TYPES = ("DIAGNOSIS", "SYMPTOM", "PROCEDURE", "FINDING")

#: Fields of a source record that a mapping may name; all are read as text.
RECORD_FIELDS = (
    "code", "title", "description", "level", "parent_code", "parent_level", "range_start", "range_end", "selectable", "status", "sort_order", "inclusions", "exclusions", "includes_notes", "notes",
    "code_also", "use_additional_code", "code_first", "see", "see_also", "other_instructions", "index_terms", "synonyms", "abbreviations",
)
#: Fields of a table with one rule a row.
RULE_FIELDS = ("owner_code", "owner_level", "rule_type", "text", "target_code", "exclusion_type")
#: Field -> instruction type, and field -> kind of term.
INSTRUCTION_FIELDS = {
    "includes_notes": "INCLUDES", "notes": "NOTE", "code_also": "CODE_ALSO", "use_additional_code": "USE_ADDITIONAL_CODE", "code_first": "CODE_FIRST", "see": "SEE", "see_also": "SEE_ALSO", "other_instructions": "OTHER",
}
TERM_FIELDS = {"index_terms": "INDEX_TERM", "synonyms": "SYNONYM", "abbreviations": "ABBREVIATION"}


def _struct(**fields: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in fields.items()))


PROVENANCE = "struct<source_filename: string, kind: string, page_start: int, page_end: int, row: int, sheet: string, element_path: string, line: int>"
INSTRUCTION = "struct<instruction_type: string, text: string, exclusion_type: string, target_code: string, referenced_codes: array<string>>"
TERM = "struct<term: string, kind: string, target_code: string>"
#: Columns of a normalised record, as DDL types.
RECORD = {
    "key": "string", "code": "string", "normalized_code": "string", "title": "string", "description": "string", "level": "string", "parent_code": "string", "parent_level": "string", "range_start": "string", "range_end": "string",
    "is_selectable": "boolean", "status": "string", "sort_order": "long", "inclusions": "array<string>", "instructions": f"array<{INSTRUCTION}>", "terms": f"array<{TERM}>", "provenance": PROVENANCE, "invalid_level": "string",
}
ISSUE = {"severity": "string", "code": "string", "message": "string", "record_key": "string", "record_code": "string"}
#: Attributes of a concept found in a note.
ATTRIBUTES = (
    "struct<laterality: string, severity: string, acuity: string, encounter: string, subtype: string, stage: string, anatomy: array<string>, complications: array<string>, causes: array<string>, explicit_absence: array<string>, conflicts: array<string>>"
)
CONCEPT = {
    "concept_index": "int", "text": "string", "concept_type": "string", "status": "string", "section": "string", "sentence_index": "int", "start": "int", "end": "int", "evidence": "string", "cues": "array<string>",
    "expansions": "array<string>", "attributes": ATTRIBUTES,
}


def ddl(columns: dict[str, str]) -> str:
    """A DDL schema of named types."""
    return ", ".join(f"`{k}` {v}" for k, v in columns.items())
