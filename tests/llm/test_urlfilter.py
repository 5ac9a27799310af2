import duckdb
import pytest
import xxhash

from marlstone.llm import queries, urlfilter

URLS = ["http://a.example.com/en/1?x#y", "https://WWW.Example.com/en/", "http://example.com/fr", "http://example.com", "x://net/es/q", "ftp://u@x.net:80/fr/", "http://x.net/fr/a", None, "", "no scheme/en/", "://com/", "a://b://com/x", "http://com/\n/en/", "http://notexample.com/en/2", "http://www.example.com/enx", "http://.com/a"]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(r, v) for r, v in queries.URL_RULES if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_hard_cases(spark):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    rows = urlfilter.judge(pages, queries.URL_RULES).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in rows] == [brute(u) for u in URLS]
    assert urlfilter.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_same_as_sql(spark, sf_dir):
    got = sorted(tuple(r) for r in queries.op7(spark, sf_dir).select("page_id", "host", "path", "rule", "verdict").collect())
    base = duckdb.connect()
    base.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    assert got == sorted(base.execute(queries.OP7_SQL).fetchall())


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda *_: 7)
    (tmp_path / "d").write_bytes(urlfilter.packed_array([("a.com/", "block"), ("b.com/", "allow"), ("c.com/", "block")]))
    array = urlfilter.DigestArray(str(tmp_path / "d"))
    assert array.judge([("b.com", "/x"), ("z.com", "/"), ("c.com", "/")]) == [("b.com/", "allow"), None, ("c.com/", "block")]


def test_large_list(tmp_path):
    entries = [(f"h{i}.org/p{i % 7}/", "block") for i in range(20_000)]
    (tmp_path / "d").write_bytes(urlfilter.packed_array(entries))
    array = urlfilter.DigestArray(str(tmp_path / "d"))
    assert array.judge([(f"x.h{i}.org", f"/p{i % 7}/z") for i in range(0, 20_000, 97)]) == [entries[i] for i in range(0, 20_000, 97)]
    assert array.judge([(f"h{i}.org", "/other/") for i in range(50)]) == [None] * 50


def test_lists_that_contradict(tmp_path):
    with pytest.raises(ValueError):
        urlfilter.packed_array([("a/", "block"), ("a/", "allow")])
    (tmp_path / "e").write_bytes(urlfilter.packed_array([]))
    assert urlfilter.DigestArray(str(tmp_path / "e")).judge([("a", "/")]) == [None]
