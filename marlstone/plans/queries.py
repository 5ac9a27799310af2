"""Queries over the driver's tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, text, vectors
from ..operators import annotate, catalog, evaluate, hierarchy, retrieval
from ..scratch import cut
from .tables import misspelt, part_nodes, table, tree

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


# SQL that several oracles share.
_CODE = "substr(p_type, 1, 1) || lpad(p_size::varchar, 2, '0') || '.' || (p_partkey % 10)::varchar"
_NORM = "trim(regexp_replace(lower(strip_accents({0})), '[^0-9a-z]+', ' ', 'g'))"
_TOKENS = "list_filter(string_split(" + _NORM + ", ' '), lambda x: x <> '')"
_GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^0-9a-z]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i::integer, 3)))))"
_MISSPELT = "SELECT min(p_partkey) AS query_id, substr(p_name, 1, 1) || substr(p_name, 3) AS query FROM part GROUP BY p_name"
_TREE = """
  SELECT r_regionkey::bigint AS node_id, NULL::bigint AS parent_id FROM region
  UNION ALL SELECT n_nationkey + 100, n_regionkey FROM nation
  UNION ALL SELECT c_custkey + 1000, c_nationkey + 100 FROM customer"""
_CLOSURE = f"""WITH RECURSIVE tree AS ({_TREE}), up AS (
  SELECT node_id AS node, parent_id AS ancestor, 1 AS lvl FROM tree WHERE parent_id IS NOT NULL
  UNION ALL SELECT up.node, t.parent_id, up.lvl + 1 FROM up JOIN tree t ON t.node_id = up.ancestor WHERE t.parent_id IS NOT NULL)"""


@query(f"""
WITH nodes AS (SELECT p_partkey AS node_id, {_CODE} AS code, p_partkey % 3 AS depth FROM part),
asked AS (SELECT min(node_id) AS query_id, code FROM nodes GROUP BY code),
hits AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY depth DESC, node_id) AS place FROM asked JOIN nodes USING (code))
SELECT query_id, node_id, 1.0::double AS score FROM hits WHERE place <= 5""")
def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes written with marks, blanks and in lower case find their records."""
    nodes = part_nodes(spark, sf_dir)
    asked = nodes.groupBy("code").agg(F.min("node_id").alias("query_id")).select("query_id", F.concat(F.lit(" "), F.lower("code"), F.lit(" †")).alias("query"))
    return retrieval.exact(asked, nodes)


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS normalized_md5, len({_TOKENS.format('text')})::bigint AS n_tokens, len(list_distinct({_TOKENS.format('text')}))::bigint AS n_distinct FROM documents")
def normalize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accents, case and punctuation."""
    words = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("normalized_md5"), F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


@query(f"""
WITH p AS (SELECT p_partkey, {_CODE} AS code, lpad(p_size::varchar, 2, '0') AS n FROM part)
SELECT p_partkey, code || ',' || 'D' || n AS codes, 'B' || n || '-C' || n AS ranges, NULL::varchar AS single, 'A00' || '|' || 'A00.' || right(code, 1) AS shorter FROM p""")
def code_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and ranges written in text, the single target, truncations."""
    from .tables import part_code

    n = F.lpad(F.col("p_size").cast("string"), 2, "0")
    written = F.concat(F.lit("Excludes: item ("), part_code(), F.lit("), see B"), n, F.lit(" – C"), n, F.lit(" or D"), n, F.lit(".- and "), part_code(), F.lit("; not XA11.2"))
    rows = table(spark, sf_dir, "part").select("p_partkey", written.alias("t"), F.concat(F.lit("a00."), (F.col("p_partkey") % 10).cast("string"), F.lit("9")).alias("c"))
    return rows.select(
        "p_partkey", F.array_join(codes.references(F.col("t")), ",").alias("codes"), F.array_join(codes.ranges(F.col("t")), ",").alias("ranges"),
        codes.single_target(F.col("t")).alias("single"), F.array_join(F.reverse(codes.truncations(F.col("c"))), "|").alias("shorter"),
    )


_SPLIT_TEXT = "split_part(text, chr(10), 1) AS head, substr(text, length(split_part(text, chr(10), 1)) + 1) AS rest"


@query(f"""
WITH docs AS (SELECT doc_id, {_SPLIT_TEXT} FROM documents),
words AS (
  SELECT doc_id, unnest({_TOKENS.format("coalesce(head, '')")}) AS lexeme, 1.0::double AS weight, 1 AS named FROM docs
  UNION ALL SELECT doc_id, unnest({_TOKENS.format("coalesce(rest, '')")}), 0.1::double, 0 FROM docs),
postings AS (SELECT doc_id, lexeme, sum(weight) AS weight, max(named) AS named FROM words GROUP BY 1, 2),
asked AS (SELECT item_id AS query_id, list_distinct({_TOKENS.format('text')}) AS lexemes FROM benchmark),
spread AS (SELECT query_id, len(lexemes) AS n, unnest(lexemes) AS lexeme FROM asked),
met AS (SELECT query_id, doc_id, round(sum(weight), 6) AS r, sum(named) AS k, first(n) AS n FROM spread JOIN postings USING (lexeme) GROUP BY 1, 2),
scored AS (SELECT query_id, doc_id, round(least(k / n, 1.0) * 0.75 + (r / (r + 1)) * 0.25, 4) AS score FROM met),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT query_id, doc_id, score FROM placed WHERE place <= 30""")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against documents, first lines weighing more."""
    docs = table(spark, sf_dir, "documents")
    head = F.split("text", "\n")[0]
    parts = docs.select("doc_id", head.alias("head"), F.expr("substring(text, length(split(text, '\\n')[0]) + 1)").alias("rest"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.lexical(asked, retrieval.postings(parts, [("head", "A"), ("rest", "D")], "doc_id"), key="doc_id")


_SIMILAR = f"""
WITH asked AS (SELECT query_id, {_GRAMS.format('query')} AS a FROM ({_MISSPELT})),
titles AS (SELECT p_partkey AS node_id, {_GRAMS.format('p_name')} AS b FROM part),
scored AS (SELECT query_id, node_id, len(list_intersect(a, b)) AS n, len(a) AS na, len(b) AS nb FROM asked, titles),
kept AS (SELECT query_id, node_id, (n / (na + nb - n))::double AS score FROM scored WHERE n / (na + nb - n) >= 0.3),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS place FROM kept)"""


@query(_SIMILAR + " SELECT query_id, node_id, round(score, 6) AS score FROM placed WHERE place <= 30")
def trigram_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4 (set similarity), F17: misspelt names against all titles, by shared trigrams."""
    found = retrieval.trigram(misspelt(spark, sf_dir), part_nodes(spark, sf_dir))
    return found.select("query_id", "node_id", F.round("score", 6).alias("score"))


@query()
def trigram_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4 with similarity to the best run of the other text; SQL has no scan over extents."""
    distinct = part_nodes(spark, sf_dir).groupBy("title").agg(F.min("node_id").alias("node_id"))
    return retrieval.trigram(misspelt(spark, sf_dir), distinct, words=True).select("query_id", "node_id", F.round("score", 6).alias("score"))


@query(f"""
WITH asked AS (SELECT query_id, {_GRAMS.format('query')} AS a, query FROM (SELECT min(p_partkey) AS query_id, p_name AS query FROM part GROUP BY p_name)),
pooled AS (SELECT DISTINCT node_id, title FROM (SELECT p_partkey AS node_id, {_NORM.format('p_type')} AS title FROM part UNION ALL SELECT s_suppkey, {_NORM.format("'Small ring ' || s_name")} FROM supplier)),
titles AS (SELECT title, {_GRAMS.format('title')} AS b FROM (SELECT DISTINCT title FROM pooled)),
near AS (SELECT query_id, title, CASE WHEN query = title THEN 1.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS score FROM asked, titles),
best AS (SELECT query_id, node_id, max(score) AS score FROM near JOIN pooled USING (title) WHERE score >= 0.3 GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS place FROM best)
SELECT query_id, node_id, round(score, 6)::double AS score FROM placed WHERE place <= 30""")
def source_terms_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and index entries as one pool."""
    part = table(spark, sf_dir, "part")
    asked = part.groupBy(F.col("p_name").alias("query")).agg(F.min("p_partkey").alias("query_id"))
    entries = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target_node_id"), F.concat(F.lit("Small ring "), "s_name").alias("term"))
    found = retrieval.source_terms(asked, part.select(F.col("p_partkey").alias("node_id"), F.col("p_type").alias("term")), entries)
    return found.select("query_id", "node_id", F.round("score", 6).alias("score"))


def _vector_sql(expression: str) -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, round({expression}, 6) AS similarity FROM v q, v WHERE q.vec_id % 50 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM scored)
SELECT query_id, vec_id, similarity, place::integer AS place FROM placed WHERE place <= 10"""


def _nearest(spark: SparkSession, sf_dir: str, distance: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.top_k(rows, asked, 10, distance)


@query(_vector_sql("list_cosine_similarity(q.e, v.e)"))
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all vectors."""
    return _nearest(spark, sf_dir, "cosine")


@query(_vector_sql("1 / (1 + list_distance(q.e, v.e))"))
def vector_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 by Euclidean distance."""
    return _nearest(spark, sf_dir, "l2")


@query(_vector_sql("list_inner_product(q.e, v.e)"))
def vector_topk_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 by inner product."""
    return _nearest(spark, sf_dir, "inner_product")


#: The columns of ``tables.part_nodes`` that are searched for words, with their parts.
PART_TEXTS = [("title", "A"), ("kind", "C")]


def fused(spark: SparkSession, sf_dir: str, top_k: int = 5) -> DataFrame:
    """Misspelt names and codes against all parts: exact, lexical and trigram signals with the ancestors' score."""
    nodes = part_nodes(spark, sf_dir)
    by_code = nodes.where("node_id % 50 = 0").select((F.col("node_id") + 10_000_000).alias("query_id"), F.lower("code").alias("query"))
    asked = misspelt(spark, sf_dir).unionByName(by_code)
    titles = nodes.select("node_id", "title")
    generated = {"exact": retrieval.exact(asked, nodes), "lexical": retrieval.lexical_documents(asked, nodes, PART_TEXTS), "fuzzy": retrieval.trigram(asked, titles)}
    pool = None
    for rows in generated.values():
        pool = rows.select("query_id", "node_id") if pool is None else pool.unionByName(rows.select("query_id", "node_id"))
    pool = cut(pool.distinct(), "pool")
    # every component again, for the pairs of the pool and without cut or threshold; only the pool's records are needed
    nodes = nodes.join(pool.select("node_id").distinct(), "node_id", "left_semi")
    titles, index = nodes.select("node_id", "title"), retrieval.postings(nodes, PART_TEXTS)
    complete = {"exact": generated["exact"], "lexical": retrieval.lexical(asked, index, pool=pool), "fuzzy": retrieval.trigram(asked, titles, threshold=0.0, pool=pool)}
    named = nodes.select("node_id", "code", F.array_distinct(text.tokens(F.col("kind"))).alias("ancestor_tokens"))
    return retrieval.fuse(asked, named, complete, top_k).select("query_id", "node_id", "exact", "lexical", "fuzzy", "hierarchy", "hybrid", "place")


_FUSED = f"""
WITH nodes AS (SELECT p_partkey AS node_id, {_CODE} AS code, p_partkey % 3 AS depth, p_name AS title, p_type AS kind FROM part),
asked AS ({_MISSPELT} UNION ALL SELECT node_id + 10000000, lower(code) FROM nodes WHERE node_id % 50 = 0),
q AS (SELECT query_id, query, list_distinct({_TOKENS.format('query')}) AS lex, {_GRAMS.format('query')} AS a FROM asked),
d AS (SELECT node_id, code, {_TOKENS.format('title')} AS ta, {_TOKENS.format('kind')} AS tc, {_GRAMS.format('title')} AS b, depth FROM nodes),
pairs AS (
  SELECT query_id, node_id, code, lex, tc,
    CASE WHEN upper(query) = code THEN 1.0 ELSE 0.0 END AS is_code, depth,
    len(list_filter(lex, lambda x: list_contains(ta, x))) AS k, len(lex) AS n,
    round(len(list_filter(ta, lambda x: list_contains(lex, x))) * 1.0::double + len(list_filter(tc, lambda x: list_contains(lex, x))) * 0.2::double, 6) AS r,
    len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS sim
  FROM q, d),
scored AS (SELECT *, CASE WHEN r > 0 THEN round(k / n * 0.75 + r / (r + 1) * 0.25, 4) END AS lex_score, CASE WHEN sim > 0 THEN sim END AS sim_score FROM pairs),
ranked AS (SELECT *,
    row_number() OVER (PARTITION BY query_id ORDER BY is_code DESC, depth DESC, node_id) AS pe,
    row_number() OVER (PARTITION BY query_id ORDER BY lex_score DESC NULLS LAST, node_id) AS pl,
    row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN sim >= 0.3 THEN sim END DESC NULLS LAST, node_id) AS pf FROM scored),
pool AS (SELECT query_id, node_id, code, lex, tc,
    CASE WHEN is_code = 1 AND pe <= 5 THEN 1.0 ELSE 0.0 END AS exact, coalesce(lex_score, 0.0) AS lexical,
    round(least(greatest((coalesce(sim_score, 0.0) - 0.3) / 0.7, 0.0), 1.0), 4) AS fuzzy
  FROM ranked WHERE (is_code = 1 AND pe <= 5) OR (lex_score IS NOT NULL AND pl <= 30) OR (sim >= 0.3 AND pf <= 30)),
graded AS (SELECT *, round(len(list_filter(lex, lambda x: list_contains(tc, x))) / len(lex), 4) AS hierarchy FROM pool),
mixed AS (SELECT *, round((exact * 0.30 + lexical * 0.25 + fuzzy * 0.20 + hierarchy * 0.05) / (0.30 + 0.25 + 0.20 + 0.05 + 0.05), 4) AS hybrid FROM graded),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, hybrid DESC, code, node_id) AS place FROM mixed)"""


@query(_FUSED + " SELECT query_id, node_id, exact::double AS exact, lexical::double AS lexical, fuzzy::double AS fuzzy, hierarchy::double AS hierarchy, hybrid::double AS hybrid, place::integer AS place FROM placed WHERE place <= 5")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by each signal, completed over the pool, fused and cut."""
    return fused(spark, sf_dir)


@query(_FUSED + """, nexts AS (SELECT *, lead(hybrid) OVER (PARTITION BY query_id ORDER BY hybrid DESC) AS second, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC) AS best FROM placed WHERE place <= 5)
SELECT query_id, hybrid::double AS hybrid, second::double AS second FROM nexts WHERE best = 1 AND hybrid - second < 0.05""")
def near_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose two best candidates are close."""
    return evaluate.near_ties(fused(spark, sf_dir), ["query_id"], "hybrid")


@query(_CLOSURE + " SELECT node, ancestor, lvl, row_number() OVER (PARTITION BY node ORDER BY lvl DESC)::integer AS place FROM up")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors, from the root."""
    nodes = tree(spark, sf_dir)
    return hierarchy.ancestors(hierarchy.closure(nodes), nodes)


@query(_CLOSURE + " SELECT ancestor AS root, node, lvl FROM up WHERE ancestor < 100")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3: everything below the roots."""
    nodes = tree(spark, sf_dir)
    return hierarchy.descendants(hierarchy.closure(nodes), nodes.where("parent_id is null"))


@query(f"WITH tree AS ({_TREE}) SELECT parent_id, count(*) AS n, min(node_id) AS first_id FROM tree WHERE parent_id < 100 GROUP BY parent_id")
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: one level below the roots."""
    nodes = tree(spark, sf_dir)
    return hierarchy.children(nodes, nodes.where("parent_id is null")).groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first_id"))


@query(f"""
WITH probes AS (SELECT p_partkey AS probe_id, substr(p_type, 1, 1) AS l, p_size AS n FROM part),
ranges AS (SELECT n_nationkey AS range_id, chr(65 + n_nationkey) AS l1, (n_nationkey * 2) % 50 AS n1, chr(66 + n_nationkey) AS l2, (n_nationkey * 3) % 50 AS n2 FROM nation)
SELECT probe_id, min(range_id) AS range_id FROM probes JOIN ranges ON (l1, n1) <= (l, n) AND (l, n) <= (l2, n2) GROUP BY probe_id HAVING count(*) = 1""")
def range_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only range, which may span letters, that contains a code."""
    from .tables import part_code

    n = F.col("n_nationkey")
    code = lambda letter, number: F.concat(F.char(letter), F.lpad((number % 50).cast("string"), 2, "0"))
    ranges = table(spark, sf_dir, "nation").select(n.alias("range_id"), F.lit("BLOCK").alias("level"), code(n + 65, n * 2).alias("low"), code(n + 66, n * 3).alias("high"))
    probes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("probe_id"), part_code().alias("code"), F.lit("BLOCK").alias("target"))
    return hierarchy.containing(probes, ranges)


@query("SELECT segment, c_nationkey, count(*) AS n FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS segment, c_nationkey FROM customer) GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9, 1.4: identities that come twice, nulls alike."""
    rows = table(spark, sf_dir, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), "c_nationkey")
    return catalog.repeated_identities(rows, ["segment", "c_nationkey"])


@query("""
WITH c AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, c_nationkey AS nation FROM customer), t AS (SELECT segment, nation FROM c WHERE nation < 10)
SELECT c_custkey, segment, nation FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.segment IS NOT DISTINCT FROM c.segment AND t.nation IS NOT DISTINCT FROM c.nation)""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose identity, with nulls, is not there yet."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.col("c_nationkey").alias("nation"))
    there = table(spark, sf_dir, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.col("c_nationkey").alias("nation")).where("nation < 10")
    return catalog.insert_if_absent(there, rows, ["segment", "nation"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unresolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without target."""
    return catalog.unresolved(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS first_id, count(*) AS n_copies FROM documents GROUP BY 1")
def first_of_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies by digest."""
    return catalog.first_of_hash(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each group."""
    return catalog.latest(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT l_partkey) AS n_parts
FROM lineitem GROUP BY 1, 2""")
def stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by group."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("l_partkey").alias("n_parts")
    )


@query("SELECT 'nation' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders")
def content_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: rows of each table."""
    return catalog.counts({n: table(spark, sf_dir, n) for n in ("nation", "part", "orders")})


_RANKS = "SELECT toxic, CASE WHEN quality = 1 THEN doc_id % 13 + 1 END AS rank FROM labels"


@query(f"""
SELECT toxic, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_3,
  round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_10, round(avg(coalesce(1.0 / rank, 0.0)), 4) AS mrr
FROM ({_RANKS}) GROUP BY toxic""")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at k and mean reciprocal rank by group."""
    ranks = table(spark, sf_dir, "labels").select("toxic", F.when(F.col("quality") == 1, F.col("doc_id") % 13 + 1).alias("rank"))
    return evaluate.ranks_summary(ranks, ["toxic"])


@query("SELECT event_type, count(value) AS n, round(avg(value), 2) AS mean, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.95), 2) AS p95, max(value) AS most FROM events GROUP BY event_type")
def percentile_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear percentiles."""
    return evaluate.latency(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("SELECT event_type, list_sort(list(value))[least(floor(count(value) * 0.95), count(value) - 1)::bigint + 1] AS element FROM events WHERE value IS NOT NULL GROUP BY event_type")
def element_at_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element at 95 in a hundred, not interpolated."""
    return evaluate.element_at_share(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("""
SELECT source, count(*) AS total, count(*) FILTER (WHERE quality IS NOT NULL) AS labelled, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE lang <> 'en') AS foreign_rows
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def coverage_filter_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: counts with filters beside the total."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return catalog.coverage(rows, ["source"], {"labelled": F.col("quality").isNotNull(), "good": F.col("quality") == 1, "foreign_rows": F.col("lang") != "en"})


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events WHERE value > 10 GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose values contradict."""
    found = catalog.conflicting(table(spark, sf_dir, "events").where("value > 10"), ["user_id"], "event_type")
    return found.select("user_id", F.array_join("values", ",").alias("kinds"))


@query("SELECT doc_id, sha256('space' || chr(10) || coalesce(text, '')) AS identity_hash FROM documents WHERE NOT (lang = 'en' AND n_chars < 2000)")
def incremental_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose stored identity hash is missing or another."""
    docs = table(spark, sf_dir, "documents")
    identity = text.content_hash(F.lit("space"), F.coalesce(F.col("text"), F.lit("")))
    stored = docs.select("doc_id", F.when((F.col("lang") == "en") & (F.col("n_chars") < 2000), identity).otherwise(F.lit("old")).alias("identity_hash"))
    return catalog.changed(docs.select("doc_id", "text"), stored, "doc_id", identity).select("doc_id", "identity_hash")


@query("""
SELECT c_custkey AS id, c_mktsegment AS system, c_nationkey::varchar AS version, 'READY' AS status FROM customer WHERE upper(c_mktsegment) = 'HOUSEHOLD' AND c_acctbal > 0
ORDER BY system, version DESC, id LIMIT 20 OFFSET 5""")
def list_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered and paged; the page is the feature."""
    rows = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("system"), F.col("c_nationkey").cast("string").alias("version"), F.lit("READY").alias("status"))
    return catalog.list_datasets(rows, system="household", statuses=["READY"], limit=20, offset=5)


@query("""
WITH a AS (SELECT p_partkey AS code, p_name AS title FROM part WHERE p_size < 40), b AS (SELECT p_partkey AS code, CASE WHEN p_size = 20 THEN p_name || ' x' ELSE p_name END AS title FROM part WHERE p_size > 10)
SELECT coalesce(a.code, b.code) AS code, CASE WHEN a.code IS NULL THEN 'added' WHEN b.code IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.code = b.code WHERE a.code IS NULL OR b.code IS NULL OR a.title IS DISTINCT FROM b.title""")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two versions."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "code")
    new = part.where("p_size > 10").select("code", F.when(F.col("p_size") == 20, F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_name")).alias("title"))
    return catalog.version_diff(part.where("p_size < 40").select("code", F.col("p_name").alias("title")), new)


@query("""
WITH words AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(p_name || ' ' || lower(p_type) || ' set', ' ')) AS b FROM part)
SELECT p_partkey, round(greatest(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), CASE WHEN len(list_filter(b, lambda x: NOT list_contains(a, x))) <= 3 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END), 6)::double AS similarity FROM words""")
def concept_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard or containment of words."""
    longer = F.concat_ws(" ", "p_name", "p_type", F.lit("set"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(evaluate.concept_similarity(F.col("p_name"), longer), 6).alias("similarity"))


@query("""
SELECT 'negative_quantity' AS gate, count(*) AS value, count(*) = 0 AS holds FROM lineitem WHERE l_quantity < 0
UNION ALL SELECT 'order_without_line', count(*), count(*) = 0 FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def safety_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gate counts its offending rows."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return evaluate.gates({"negative_quantity": lines.where("l_quantity < 0"), "order_without_line": catalog.unresolved(orders, "o_orderkey", lines, "l_orderkey")})


@query("""
WITH s AS (SELECT user_id, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 END AS k FROM events)
SELECT user_id, CASE min(k) WHEN 1 THEN 'error' WHEN 2 THEN 'view' ELSE 'click' END AS stage FROM s WHERE k IS NOT NULL GROUP BY user_id""")
def first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest stage that failed."""
    return evaluate.first_failure(table(spark, sf_dir, "events").withColumnRenamed("event_type", "stage"), ["user_id"], ["error", "view", "click"])


@query()
def annotate_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of every turn of the conversations; scope runs from clause to clause, which SQL cannot express."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1_000 + F.col("turn")).alias("note_id"), "text")
    found = annotate.query_variants(annotate.annotate(turns)).withColumn("not_codable", annotate.not_codable())
    return found.select("note_id", "concept_index", "text", "concept_type", "status", "section", "start", "end", F.size("variants").alias("n_variants"), "not_codable")
