"""Classification sources: delimited text, JSON, XML, XLSX and indented text, each read into the same rows."""

from .base import Manifest, SourceError, detect, digest, read_rows, select_format

__all__ = ["Manifest", "SourceError", "detect", "digest", "read_rows", "select_format"]
