"""Operators on their own, over records, scores and texts made of the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, text, vectors
from ..operators import catalog, coding, evaluate, hierarchy, normalize, retrieval, validate
from .queries import _CODE, query
from .tables import part_code, table

_STEM = "CASE WHEN ends_with({0}, 'ies') AND length({0}) >= 6 THEN left({0}, length({0}) - 3) || 'y' WHEN ends_with({0}, 'es') AND length({0}) >= 5 THEN left({0}, length({0}) - 2) WHEN ends_with({0}, 's') AND length({0}) >= 4 THEN left({0}, length({0}) - 1) ELSE {0} END"


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(p_name || 's ladies dishes', ' '), lambda w: {_STEM.format('w')}))), ' ') AS stems FROM part")
def title_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """distinct stems of a title."""
    titles = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("s Ladies dishes")).alias("title"))
    return titles.select("p_partkey", F.array_join(F.array_sort(text.stems(F.col("title"))), " ").alias("stems"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' WHEN 'es' THEN 'spanish' WHEN 'pt' THEN 'portuguese' ELSE 'simple' END AS config FROM documents")
def text_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the text-search configuration of a language tag with a region."""
    return table(spark, sf_dir, "documents").select("doc_id", text.ts_config(F.concat(F.upper("lang"), F.lit("-CA"))).alias("config"))


@query("""
SELECT o_orderkey, nullif(trim(regexp_replace(o_orderpriority, '\\s+', ' ', 'g')), '') AS cell, o_orderstatus || '|' || o_orderpriority AS parts,
  CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM orders""")
def cleaned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with white space, lists, and words for true and false."""
    orders = table(spark, sf_dir, "orders")
    untidy = F.concat(F.lit("  "), F.regexp_replace("o_orderpriority", " ", "\t \n"), F.lit(" "))
    listed = F.concat_ws("|", F.lit(" "), "o_orderstatus", F.lit(""), untidy)
    said = F.element_at(F.array(*map(F.lit, ("Yes", " f ", "perhaps", ""))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return orders.select("o_orderkey", text.clean(untidy).alias("cell"), F.array_join(text.clean_list(listed), "|").alias("parts"), text.flag(said).alias("flag"))


@query("""
SELECT p_partkey, 'SUBCATEGORY:' || replace(code, '.', '') AS key, 'CATEGORY:' || left(code, 3) AS above, 'CHAPTER:#' || p_partkey AS numbered, 'SUBCATEGORY' AS shaped, 'CODE' AS longer
FROM (SELECT p_partkey, """ + _CODE + """ AS code FROM part)""")
def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keys of records with and without code, and levels read from a code's shape."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower(part_code()).alias("code"))
    key = lambda level, code: codes.record_key(F.lit(level), code, F.col("p_partkey"))
    return rows.select(
        "p_partkey", key("SUBCATEGORY", F.col("code")).alias("key"), key("CATEGORY", F.substring("code", 1, 3)).alias("above"), key("CHAPTER", F.lit(None).cast("string")).alias("numbered"),
        codes.level_from_shape(F.col("code")).alias("shaped"), codes.level_from_shape(F.concat("code", F.lit("1"))).alias("longer"),
    )


@query("SELECT round(sum(CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END) / sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END), 4) AS precision, round(sum(CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END) / sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 4) AS recall FROM labels")
def status_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of a set of statuses."""
    rows = table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "NEGATED").otherwise("DOCUMENTED").alias("expected"), F.when(F.col("quality") == 0, "NEGATED").otherwise("DOCUMENTED").alias("found"))
    return evaluate.status_metrics(rows, "expected", "found", ["NEGATED", "RULED_OUT"])


@query("SELECT DISTINCT c_mktsegment AS system FROM customer")
def distinct_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the systems that datasets have."""
    return catalog.systems(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "system"))


@query("SELECT c_custkey AS node_id, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def many_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a list of ids, in which an id may come twice."""
    ids = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("node_id"))
    return catalog.get_many(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), "c_name"), ids)


_VECTOR = "list_transform(embedding, lambda x: x::double)"


@query(f"SELECT vec_id, 1.0::double AS length, round(list_sum({_VECTOR}) / sqrt(list_sum(list_transform({_VECTOR}, lambda x: x * x))), 6) AS total, true AS finite FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: vectors brought to length 1, and whether they are finite."""
    unit = vectors.l2_normalise(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", unit.alias("unit"))
    total = F.aggregate("unit", F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.round(vectors.norm(F.col("unit")), 6).alias("length"), F.round(total, 6).alias("total"), vectors.is_finite(F.col("embedding")).alias("finite"))


@query("SELECT user_id AS note_id, event_type AS final_id, min(event_id) AS concept_index FROM events GROUP BY user_id, event_type")
def one_per_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record is suggested once for a note, by its first concept."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("note_id"), F.col("event_type").alias("final_id"), F.col("event_id").alias("concept_index"))
    return coding.once_per_note(rows)


@query("""
WITH once AS (SELECT user_id, event_type AS type, (event_id % 3)::varchar AS text, max(value) AS score FROM events WHERE value IS NOT NULL GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, type, text) AS place FROM once)
SELECT user_id, string_agg(type || ':' || text, ',' ORDER BY place) AS evidence FROM placed WHERE place <= 5 GROUP BY user_id""")
def best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five pieces of evidence, each type and text once."""
    rows = table(spark, sf_dir, "events").where("value is not null").select("user_id", F.col("event_type").alias("type"), (F.col("event_id") % 3).cast("string").alias("text"), F.col("value").alias("score"))
    found = retrieval.evidence(rows, ["user_id"])
    return found.select("user_id", F.array_join(F.transform("evidence", lambda e: F.concat(e["type"], F.lit(":"), e["text"])), ",").alias("evidence"))


def _scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as candidates: features between 0 and 1 of their numbers."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 101 / 100).alias("hybrid"), (F.col("l_suppkey") % 11 / 10).alias("overlap"), (F.col("l_linenumber") % 2 == 1).alias("odd"), (F.col("l_partkey") % 3 == 0).alias("third"),
        F.when(F.col("l_returnflag") == "R", "UNCERTAIN").otherwise("DOCUMENTED").alias("status"),
    )


_LINES = "SELECT l_orderkey, l_linenumber, l_partkey % 101 / 100 AS hybrid, l_suppkey % 11 / 10 AS overlap, l_linenumber % 2 = 1 AS odd, l_partkey % 3 = 0 AS third, l_returnflag = 'R' AS unsure FROM lineitem"


@query(f"""
WITH s AS (SELECT *, round(least(greatest(hybrid * 0.45 + odd::int * 0.25 + overlap * 0.15 + third::int * 0.1 + odd::int * 0.05 - third::int * 0.2, 0), 1), 4) AS rerank FROM ({_LINES}))
SELECT l_orderkey, l_linenumber, rerank::double AS rerank, CASE WHEN NOT odd THEN 'LOW' WHEN rerank >= 0.55 AND third AND NOT unsure THEN 'HIGH' WHEN rerank >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  hybrid >= 0.4 OR overlap >= 1 OR overlap >= 0.15 AS evidence FROM s""")
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted features, what confidence they give, and whether one signal is enough."""
    rows, c = _scored_lines(spark, sf_dir), F.col
    features = {"hybrid": c("hybrid"), "exact_terminology": c("odd"), "concept_overlap": c("overlap"), "inclusion_match": c("third"), "documented_specificity": c("odd"), "unsupported_specificity": c("third")}
    features |= {n: F.lit(None) for n in ("selectable", "less_specific", "rule_warning")}
    rows = rows.withColumn("rerank", coding.rerank(features))
    sure = coding.confidence(c("rerank"), c("third"), F.lit(True), F.lit(True), F.lit(True), c("odd"), c("status"))
    enough = coding.has_evidence({"lexical": c("hybrid"), "exact": c("overlap"), "fuzzy": c("overlap")})
    return rows.select("l_orderkey", "l_linenumber", "rerank", sure.alias("confidence"), enough.alias("evidence"))


@query("""
WITH t AS (SELECT p_partkey, p_size % 3 AS kind, p_partkey % 3 AS says FROM part)
SELECT p_partkey, CASE WHEN says = 0 AND kind <> 0 THEN 'family' WHEN says = 1 AND kind = 0 THEN 'personal' WHEN says = 1 AND kind <> 1 THEN 'active' WHEN says = 2 AND kind <> 2 THEN 'current' END AS reason FROM t""")
def status_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family history, personal history and current conditions fit titles of their own kind only."""
    part = table(spark, sf_dir, "part")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % 3 + 1).cast("int"))
    title = F.concat(pick(("Family history of ", "Personal history of ", ""), F.col("p_size")), "p_name")
    reason = coding.status_gate(pick(("FAMILY_HISTORY", "HISTORY", "DOCUMENTED"), F.col("p_partkey")), F.col("p_name"), title, F.array().cast("array<string>"))
    short = F.when(reason.startswith("Only"), "family").when(reason.startswith("Family"), "personal").when(reason.contains("active"), "active").when(reason.contains("current"), "current")
    return part.select("p_partkey", short.alias("reason"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a classification: a chapter, two blocks a letter, categories and subcategories, the first of which only name their parent."""
    at = table(spark, sf_dir, "part").groupBy(part_code().alias("code")).agg(F.min("p_partkey").alias("sort_order"))
    category = F.substring("code", 1, 3)
    block = F.when(F.substring("code", 2, 2) < "25", F.concat(F.substring("code", 1, 1), F.lit("00-"), F.substring("code", 1, 1), F.lit("24"))).otherwise(F.concat(F.substring("code", 1, 1), F.lit("25-"), F.substring("code", 1, 1), F.lit("99")))

    def of(code: Column, level: str, parent: Column | None, low: str | None = None, high: str | None = None) -> DataFrame:
        rows = at.select(code.alias("code"), (F.lit(None) if parent is None else parent).cast("string").alias("parent_code"), "sort_order").groupBy("code").agg(F.min("parent_code").alias("parent_code"), F.min("sort_order").alias("sort_order"))
        made = rows.withColumns({"level": F.lit(level), "range_start": F.lit(low).cast("string"), "range_end": F.lit(high).cast("string"), "parent_level": F.lit(None).cast("string"), "is_selectable": F.lit(None).cast("boolean")})
        return made.withColumns({"key": codes.record_key(F.col("level"), F.col("code"), F.col("sort_order")), "title": F.concat(F.lit("Title "), "code")})

    return of(F.lit("1"), "CHAPTER", None, "A00", "Z99").unionByName(of(block, "BLOCK", None)).unionByName(of(category, "CATEGORY", None)).unionByName(of(F.col("code"), "SUBCATEGORY", category))


_RECORDS = f"""WITH c AS (SELECT DISTINCT {_CODE} AS code FROM part),
s AS (SELECT 'SUBCATEGORY:' || replace(code, '.', '') AS key, 'CATEGORY:' || left(code, 3) AS cat, 'BLOCK:' || left(code, 1) || CASE WHEN substr(code, 2, 2) < '25' THEN '00-' || left(code, 1) || '24' ELSE '25-' || left(code, 1) || '99' END AS block FROM c),
nodes AS (
  SELECT key, cat AS parent_key, 3 AS depth, cat AS category_key, block AS block_key, 'CHAPTER:1' AS chapter_key, false AS inferred, true AS selectable, 0 AS n_children FROM s
  UNION ALL SELECT cat, min(block), 2, NULL, min(block), 'CHAPTER:1', true, false, count(*) FROM s GROUP BY cat
  UNION ALL SELECT block, 'CHAPTER:1', 1, NULL, NULL, 'CHAPTER:1', true, false, count(DISTINCT cat) FROM s GROUP BY block
  UNION ALL SELECT 'CHAPTER:1', NULL, 0, NULL, NULL, NULL, false, false, count(DISTINCT block) FROM s)"""


@query(_RECORDS + " SELECT key, parent_key, depth, category_key, block_key, chapter_key, inferred, selectable, n_children FROM nodes")
def hierarchy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents as named or by the range that holds a code, depths, sections above, leaves."""
    nodes, _ = hierarchy.build(_records(spark, sf_dir), infer_parents=True)
    return nodes.select("key", "parent_key", "depth", "category_key", "block_key", "chapter_key", F.col("parent_inferred").alias("inferred"), "selectable", "n_children")


@query(f"SELECT DISTINCT 'SUBCATEGORY:' || replace({_CODE}, '.', '') AS key, 'CATEGORY:' || left({_CODE}, 3) AS parent_key FROM part")
def truncation_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest shorter code is the parent."""
    return hierarchy.truncation_parents(_records(spark, sf_dir))


@query(_RECORDS + """, kinds AS (
  SELECT 'ERROR' AS severity, 'DUPLICATE_CODE' AS code, count(*) FILTER (WHERE ends_with(key, '7')) AS n FROM s
  UNION ALL SELECT 'ERROR', 'MISSING_PARENT', count(*) FILTER (WHERE ends_with(key, '3')) FROM s
  UNION ALL SELECT 'INFO', 'PARENT_INFERRED', count(*) FROM nodes WHERE inferred
  UNION ALL SELECT 'WARNING', 'HIERARCHY_CODE_MISMATCH', 0 FROM s WHERE false)
SELECT severity, code, n FROM kinds WHERE n > 0""")
def hierarchy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6, V9: keys that come again and parents that are not there, among a whole hierarchy's findings."""
    records = _records(spark, sf_dir)
    sub = F.col("level") == "SUBCATEGORY"
    records = records.withColumn("parent_code", F.when(sub & F.col("code").endswith("3"), "0-0").otherwise(F.col("parent_code")))
    again = records.where(sub & F.col("code").endswith("7")).withColumn("sort_order", F.col("sort_order") + 1_000_000_000)
    _, issues = hierarchy.build(records.unionByName(again), infer_parents=True)
    return issues.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH r AS (SELECT p_partkey, {_CODE} AS code, p_size FROM part)
SELECT code, n FROM (
  SELECT 'MISSING_TITLE' AS code, count(*) FILTER (WHERE p_size = 7) AS n FROM r
  UNION ALL SELECT 'MALFORMED_CODE', count(*) FILTER (WHERE p_size = 8) FROM r
  UNION ALL SELECT 'MISSING_CODE', count(*) FILTER (WHERE p_size = 9) FROM r
  UNION ALL SELECT 'INVALID_LEVEL', count(*) FILTER (WHERE p_size = 10) FROM r
  UNION ALL SELECT 'RECORD_WITHOUT_PROVENANCE', count(*) FILTER (WHERE p_size = 11) FROM r
  UNION ALL SELECT 'INVALID_SOURCE_LOCATOR', count(*) FILTER (WHERE p_size = 12) + count(*) FILTER (WHERE p_size = 13) FROM r
  UNION ALL SELECT 'DUPLICATE_NORMALIZED_CODE', count(DISTINCT code) FILTER (WHERE p_size = 14) FROM r WHERE code IN (SELECT code FROM r GROUP BY code HAVING min(p_partkey % 20) <> max(p_partkey % 20))
) WHERE n > 0""")
def record_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1-V6: faults of records, each kind planted in parts of one size, counted by code."""
    size = F.col("p_size")
    # two spellings of one code in size 14: with the dot, and without it
    spelled = F.when((size == 14) & (F.col("p_partkey") % 20 >= 10), F.regexp_replace("code", r"\.", "")).when(size == 8, "??").when(size == 9, F.lit(None)).otherwise(F.col("code"))
    place = F.struct(F.when(size == 12, 99).otherwise(1).cast("int").alias("page_start"), F.lit(2).cast("int").alias("page_end"), F.when(size == 13, 0).otherwise(5).cast("int").alias("row"))
    rows = table(spark, sf_dir, "part").withColumn("code", part_code()).select(
        F.col("p_partkey").cast("string").alias("key"), spelled.alias("code"), F.when(size != 7, F.col("p_name")).alias("title"), F.when(size != 10, "SUBCATEGORY").alias("level"), F.lit(None).cast("string").alias("invalid_level"),
        F.col("p_partkey").alias("sort_order"), F.when(size != 11, place).alias("provenance"),
    )
    found = validate.record_issues(rows, validate.System("test", r"^[A-Z][0-9]{2}(\.?[0-9]{1,2})?$"), pages=10)
    # a page that starts after it ends is reported as such too; each record counts once
    return found.select("code", "record_key").distinct().groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH n AS (SELECT {_CODE} AS code, p_partkey FROM part), m AS (SELECT code, min(lpad(p_partkey::varchar, 9, '0')) AS target_key FROM n GROUP BY code)
SELECT p_partkey, target_key FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Q99.9' ELSE {_CODE} END AS code FROM part) LEFT JOIN m USING (code)""")
def resolved_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written codes lead to the first record that has them, or to none."""
    part = table(spark, sf_dir, "part").withColumn("code", part_code())
    nodes = part.select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("key"), "code", F.lit("SUBCATEGORY").alias("level"))
    asked = part.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "Q99.9").otherwise(F.lower("code")).alias("target_code"))
    return normalize.resolve_targets(asked, nodes).select("p_partkey", "target_key")
