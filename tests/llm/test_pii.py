import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in text.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def base_of(docs):
    return docs.select("doc_id", pii.joined(pii.base_spans(F.coalesce("text", F.lit("")))).alias("s"))


HARD = [
    "a@b.c_d@e.f x@y.z.w..q@r", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 0.0.0.0", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (425) 555-9684 +44.20.7946.0958 +1+2345678901",
    "é漢😀 me@x.org 漢 10.0.0.1", "4111111111111111", "@a.b", "a@b", "+12", "+1234567", "+12345678", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "x" * 300 + "@h.i", "1.2.3.4 4111 1111 1111 1111",
]


def test_hard_cases(make):
    assert [r["s"] for r in base_of(make(HARD)).orderBy("doc_id").collect()] == [",".join(brute(t)) for t in HARD]


@given(st.lists(st.text("ab1234567890@.-+() _", max_size=60), min_size=30, max_size=30))
@settings(max_examples=8, deadline=None)
def test_random_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["s"] for r in base_of(docs).orderBy("doc_id").collect()] == [",".join(brute(t)) for t in texts]


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in queries.documents(spark, sf_dir).collect()}
    rows = queries.op3(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        assert r["spans"].split(",")[: len(want)] == want or not want


def test_no_python_in_the_plan(spark, sf_dir):
    plan = pii.find(queries.documents(spark, sf_dir), {"kind:secret": 1.0})._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_reliabilities_and_classifier():
    counts = [("secret", "11111", 50), ("secret", "1110-", 4), ("secret", "000--", 40), ("card", "111--", 60), ("card", "100--", 30)]
    post, reliability = pii.estimate(counts)
    assert post["secret", "11111"] > 0.95 > 0.5 > post["secret", "000--"]
    assert all(0.5 < a <= 0.99 and 0.5 < b <= 0.99 for a, b in reliability)
    weights = pii.fit(counts, post)
    assert sum(weights[f] for f in ("kind:secret", "format=1", "structure=1", "gazetteer=1", "context=1", "edges=1")) > 0
    assert pii.estimate([])[0] == {} and pii.fit([], {}) == {}


def test_secrets_are_added_and_masked(make):
    docs = make([f'token = "{"0a1b2c3d" * 5}" here', "mail me@x.org or +1 (425) 555-9684 now", "no data", "dead beef"] * 5)
    found = pii.find(docs, pii.train(docs))
    rows = found.select("doc_id", pii.joined(F.concat("base", "added")).alias("s"), pii.masked(F.col("body"), F.concat("base", "added")).alias("m")).orderBy("doc_id").collect()
    assert rows[0]["s"] == "secret:9:49" and rows[0]["m"] == 'token = "[SECRET]" here'
    assert rows[1]["m"] == "mail [EMAIL] or [PHONE] now" and rows[2]["m"] == "no data"


def test_overlapping_spans_are_one_mask(make):
    text = "é x 1.2.3.4 4111 1111 1111 1111 y"
    spans = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("").alias("text")) for k, a, b in (("ip", 4, 11), ("card", 10, 31))))
    assert make([text]).select(pii.masked(F.col("text"), spans)).first()[0] == "é x [IP] y"


def test_many_spans_in_one_text(make):
    text = " ".join(f"1.2.3.{i % 256}" for i in range(3000))
    row = base_of(make([text])).first()
    assert row["s"] == ",".join(brute(text))


def test_odd_rows(odd, empty):
    weights = pii.train(odd)
    rows = pii.find(odd, weights).collect()
    assert len(rows) == odd.count() and all(isinstance(r["base"], list) for r in rows)
    assert pii.find(empty, pii.train(empty)).count() == 0


@pytest.mark.parametrize("size", [15_000])
def test_long_runs_do_not_recurse(make, size):
    docs = make(["1" * size, "1 " * size, "a." * size + "@", "x@" + "a." * size, "+" + "1" * size, "1.1." * (size // 2)])
    assert [r["s"] for r in base_of(docs).orderBy("doc_id").collect()] == [",".join(brute(r["text"])) for r in docs.orderBy("doc_id").collect()]


def test_long_keys_are_secrets_too(make):
    docs = make(["password = " + "a1b2c3d4" * 32 + " end", "x"])
    found = pii.find(docs, pii.train(docs))
    spans = {r["doc_id"]: r["s"] for r in found.select("doc_id", pii.joined(pii.F.col("added")).alias("s")).collect()}
    assert spans == {0: "secret:11:267", 1: ""}
