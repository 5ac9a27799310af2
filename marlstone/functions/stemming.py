"""The English stemmer known as Porter2, after its published description, for words of lower-case ASCII letters."""

from __future__ import annotations

import re
from functools import lru_cache

# English stopwords of text search.
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

# Words with stems of their own, and words that step 1a leaves final.
_IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_INVARIANT = frozenset("sky news howe atlas cosmos bias andes".split())
_FINAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Suffixes and what takes their place, by step; the longest suffix of a step decides.
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")
_BEFORE_LI = frozenset("cdeghkmnrt")
_VOWEL, _DOUBLE = "[aeiouy]", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _region(word: str) -> int:
    """Where what follows the first consonant after a vowel starts."""
    m = re.search("[aeiouy][^aeiouy]", word)
    return m.end() if m else len(word)


def _longest(word: str, suffixes: dict[str, str]) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(1 << 16)
def english(word: str) -> str:
    """The stem of a word; words of two letters and fewer stay."""
    if len(word) < 3 or word in _INVARIANT:
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    word = re.sub("(^|[aeiouy])y", r"\1Y", word)
    special = re.match("gener|commun|arsen", word)
    r1 = special.end() if special else _region(word)
    r2 = r1 + _region(word[r1:])
    word = _plural(word)
    if word.lower() in _FINAL:
        return word.lower()
    word = _tense(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    word = _derived(word, r1, r2)
    return _ending(word, r1, r2).lower()


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_VOWEL, word[:-2]):
        return word[:-1]
    return word


def _tense(word: str, r1: int) -> str:
    for suffix in ("eedly", "eed"):
        if word.endswith(suffix):
            return word[: -len(suffix)] + "ee" if len(word) - len(suffix) >= r1 else word
    suffix = next((s for s in ("ingly", "edly", "ing", "ed") if word.endswith(s)), None)
    if suffix is None or not re.search(_VOWEL, word[: -len(suffix)]):
        return word
    word = word[: -len(suffix)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if word.endswith(_DOUBLE):
        return word[:-1]
    return word + "e" if r1 >= len(word) and _SHORT_END.search(word) else word


def _derived(word: str, r1: int, r2: int) -> str:
    """Steps 2 to 4."""
    suffix = _longest(word, _STEP2)
    if suffix and len(word) - len(suffix) >= r1:
        before = word[-len(suffix) - 1 : -len(suffix)]
        if (suffix != "ogi" or before == "l") and (suffix != "li" or before in _BEFORE_LI):
            word = word[: -len(suffix)] + _STEP2[suffix]
    suffix = _longest(word, _STEP3)
    if suffix and len(word) - len(suffix) >= (r2 if suffix == "ative" else r1):
        word = word[: -len(suffix)] + _STEP3[suffix]
    suffix = _longest(word, _STEP4)
    if suffix and len(word) - len(suffix) >= r2 and (suffix != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(suffix)]
    return word


def _ending(word: str, r1: int, r2: int) -> str:
    """Step 5: a last e, or the second of two l."""
    at = len(word) - 1
    if word.endswith("e") and (at >= r2 or at >= r1 and not _SHORT_END.search(word[:-1])):
        return word[:-1]
    return word[:-1] if word.endswith("ll") and at >= r2 else word
