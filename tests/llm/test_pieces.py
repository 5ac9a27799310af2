import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import pieces, queries

TEXTS = ["", " ", "  a  b ", "▁x y", "a\nb\t c", "é漢😀", "\x00a", "<s> x</s>", "a▁▁b", "x" * 200, "trailing ", "<0x41>", "don't  stop"]


@pytest.fixture(scope="module")
def model():
    with open(queries.piece_model(), "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def library(model):
    return pieces.load(model)


def whole(library, text):
    return [library.bos_id(), *library.encode(text or ""), library.eos_id()]


def test_model_splits_at_marks(model):
    assert pieces.splits_at_marks(model)


@given(st.one_of(st.text(max_size=60), st.text("ab ▁\n.", max_size=40)))
@settings(max_examples=300, deadline=None)
def test_same_as_library(text):
    coder = test_same_as_library.__dict__.setdefault("coder", pieces.RoundTrip(open(queries.piece_model(), "rb").read(), True))
    packed, decoded = coder(text)
    ids = list(struct.unpack(f"<{len(packed) // 4}I", packed))
    assert ids == whole(coder.processor, text)
    assert decoded == coder.processor.decode(ids)
    assert coder.count(text) == len(ids) - 2


def test_table_is_emptied(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_ENTRIES", 3)
    coder = pieces.RoundTrip(model, True)
    for text in ("a b c d e f g", "f g a b"):
        packed, decoded = coder(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == whole(library, text) and decoded == text
        assert len(coder.table) <= 3


def test_query_digests(spark, sf_dir, library):
    rows = {r["doc_id"]: r for r in queries.op1(spark, sf_dir).collect()}
    docs = queries.documents(spark, sf_dir).select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        ids = whole(library, doc["text"])
        row = rows[doc["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(odd, empty, library):
    done = pieces.encode(odd, queries.piece_model())
    for row, source in zip(sorted(done.collect(), key=str), sorted(odd.collect(), key=str), strict=True):
        assert row["doc_id"] is None or row["n_tokens"] == len(row["ids"])
    assert {tuple(r["ids"]) for r in done.collect() if r["doc_id"] in (None, 0, 1)} == {(1, 2)}
    back = pieces.decode(done, queries.piece_model()).collect()
    assert {r["doc_id"]: r["decoded"] for r in back} == {r["doc_id"]: r["decoded"] for r in done.collect()}
    assert pieces.encode(empty, queries.piece_model()).count() == 0


def test_other_models_take_whole_texts(model, library):
    coder = pieces.RoundTrip(model, False)
    packed, decoded = coder(" two  words")
    assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == whole(library, " two  words") and decoded == " two  words"
