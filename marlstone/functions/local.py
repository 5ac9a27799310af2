"""The text functions for single strings, for Python operators that need them inside a worker."""

from __future__ import annotations

import re
import unicodedata

_OTHER = re.compile("[^0-9a-z]+")


def normalize_text(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _OTHER.sub(" ", plain.lower()).strip()


def tokens(text: str) -> list[str]:
    return normalize_text(text).split()


def stem(token: str) -> str:
    for suffix, put in (("ies", "y"), ("es", ""), ("s", "")):
        if token.endswith(suffix) and len(token) >= len(suffix) + 3:
            return token[: -len(suffix)] + put
    return token


def stems(text: str) -> set[str]:
    return set(map(stem, tokens(text)))
