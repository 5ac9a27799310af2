"""Audits over cases made of the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, coding, evaluate, hierarchy, index, presentation, retrieval
from .queries import _FUSED, _NORM, PART_TEXTS, query
from .tables import misspelt, part_nodes, table, tree

_PAIRS = """pairs AS (
  SELECT a.l_orderkey AS case_id, a.l_linenumber AS i, b.l_linenumber AS j, (a.l_partkey * 7 + b.l_suppkey * 13) % 11 / 10 AS score
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber % 2 = 1 AND b.l_linenumber % 2 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, i DESC, j DESC) AS n FROM pairs WHERE score >= 0.6)"""


@query(f"""
WITH RECURSIVE {_PAIRS},
walk AS (
  SELECT case_id, n, i, j, score, [i] AS is_used, [j] AS js_used, true AS taken FROM placed WHERE n = 1
  UNION ALL
  SELECT p.case_id, p.n, p.i, p.j, p.score, CASE WHEN NOT list_contains(w.is_used, p.i) AND NOT list_contains(w.js_used, p.j) THEN list_append(w.is_used, p.i) ELSE w.is_used END,
    CASE WHEN NOT list_contains(w.is_used, p.i) AND NOT list_contains(w.js_used, p.j) THEN list_append(w.js_used, p.j) ELSE w.js_used END,
    NOT list_contains(w.is_used, p.i) AND NOT list_contains(w.js_used, p.j)
  FROM walk w JOIN placed p ON p.case_id = w.case_id AND p.n = w.n + 1)
SELECT case_id, i AS expected_at, j AS found_at, score::double AS score FROM walk WHERE taken""")
def greedy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches of expected and found concepts, the closest first, with ties."""
    lines = table(spark, sf_dir, "lineitem")
    left = lines.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("expected_at"), "l_partkey")
    right = lines.where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("found_at"), "l_suppkey")
    pairs = left.join(right, "case_id").withColumn("score", (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 11 / 10)
    return audit.match_concepts(pairs, ["case_id"])


@query("""
SELECT p_partkey, p_partkey % 4 <> 0 AS laterality, p_partkey % 4 <> 1 AS stage, p_partkey % 4 <> 2 AS absence, p_partkey % 4 <> 3 AS site, true AS conflicting FROM part""")
def genuine_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a detail reported as missing is in the note after all."""
    notes = F.element_at(F.array(*map(F.lit, ("pain, Lt side", "CKD stage 3", "uncomplicated", "sore ankles"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    genuine = lambda item: audit.missing_is_genuine(F.lit(item), F.concat(notes, F.lit("; "), "p_name"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", genuine("laterality").alias("laterality"), genuine("stage").alias("stage"), genuine("absence of complication").alias("absence"),
        genuine("anatomical site (ankle)").alias("site"), genuine("laterality (conflicting)").alias("conflicting"),
    )


@query("""
WITH t AS (SELECT p_partkey, p_partkey % 3 AS side, p_size % 3 AS said, p_partkey % 7 AS stage, p_size % 7 AS stage_said, p_partkey % 5 = 0 AS vague, p_partkey % 11 = 0 AS cited FROM part)
SELECT p_partkey, CASE WHEN vague OR cited THEN '' ELSE concat_ws('; ',
  CASE WHEN side = 0 AND said <> 0 THEN 'laterality: left' WHEN side = 1 AND said <> 1 THEN 'laterality: right' WHEN side = 2 AND said <> 2 THEN 'laterality: bilateral' END,
  CASE WHEN stage > 0 AND stage <> stage_said THEN 'stage: ' || stage END,
  CASE WHEN said = 0 THEN 'complication: with gout' END) END AS unsupported FROM t""")
def unsupported_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a title adds to its category's and the note does not say."""
    at = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    stage = lambda n: F.when(n % 7 > 0, F.concat(F.lit(", stage "), (n % 7).cast("string"))).otherwise("")
    title = F.concat(at(("Left", "Right", "Bilateral"), key), F.lit(" harm"), stage(key), F.when(key % 5 == 0, ", unspecified").otherwise(""), F.lit(", with gout"))
    note = F.concat(at(("lt harm and gout", "rt harm with gout", "both sides, harm with gout"), size), stage(size), F.when(key % 11 == 0, " known as Harm of Part").otherwise(""))
    found = audit.unsupported_specificity(title, F.lit("Harm"), note, F.array(F.lit("harm of part")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, "; ").alias("unsupported"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey % 10 / 10 AS lexical, l_suppkey % 10 / 10 AS semantic, l_linenumber % 4 = 0 AS tie, l_linenumber % 3 = 0 AS gap, l_returnflag <> 'R' AS passed, l_partkey % 2 = 0 AS term,
  CASE l_partkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, CASE WHEN l_suppkey % 5 = 0 THEN 'LOW' END AS most FROM lineitem)
SELECT l_orderkey, l_linenumber, lexical >= 0.6 AND semantic >= 0.5 AS agree, (confidence = 'HIGH' AND ((lexical < 0.6 AND NOT term) OR tie OR gap OR NOT passed)) OR (most IS NOT NULL AND confidence <> 'LOW') AS violation FROM r""")
def confidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence without the signals for it, or above what the case allows."""
    key, none = F.col("l_partkey"), F.lit(None).cast("double")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", none.alias("exact"), (key % 10 / 10).alias("lexical"), none.alias("index_term"), F.lit(0.1).alias("fuzzy"), (F.col("l_suppkey") % 10 / 10).alias("semantic"), (F.col("l_linenumber") % 4 == 0).alias("near_tie"),
        F.when(F.col("l_linenumber") % 3 == 0, F.array(F.lit("stage"))).otherwise(F.array().cast("array<string>")).alias("missing"), F.when(F.col("l_returnflag") == "R", "warning").otherwise("passed").alias("rule_status"), (key % 2 == 0).alias("terminology_support"),
        F.when(key % 3 == 0, "HIGH").when(key % 3 == 1, "MEDIUM").otherwise("LOW").alias("confidence"), F.when(F.col("l_suppkey") % 5 == 0, "LOW").alias("max_confidence"),
    )
    return audit.audit_confidence(rows).select("l_orderkey", "l_linenumber", "agree", "violation")


def _evidence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A piece of evidence for each line of an order: its record is the line's part, its note the same for all."""
    once = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    lines = once.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey")
    n = F.col("l_linenumber") % 6
    return lines.select(
        F.struct("l_orderkey", "l_linenumber").alias("item_id"), F.col("l_orderkey").alias("note_id"), F.array("l_partkey", F.col("l_partkey") + 1).alias("record_ids"),
        F.when(n == 0, "clinical_text").when(n == 1, "matched_term").when(n == 2, "inclusion_term").when(n == 3, "documented_specificity").when(n == 4, "guess").otherwise("matched_term").alias("type"),
        F.when(n == 0, F.substring(F.lit("seen in the note"), 5, 6)).when(n == 1, F.upper("p_name")).when(n == 2, F.col("p_name")).otherwise(F.col("p_type")).alias("text"),
        F.when(n == 0, F.when(F.col("l_partkey") % 2 == 0, 4).otherwise(5)).alias("start"), F.when(n == 0, F.when(F.col("l_partkey") % 2 == 0, 10).otherwise(11)).alias("end"),
        F.when((n == 3) & (F.col("l_partkey") % 3 == 0), F.array(F.lit("laterality=left"))).alias("details"),
    )


@query(f"""
WITH p AS (SELECT p_partkey, {_NORM.format('p_name')} AS name, {_NORM.format('p_type')} AS type FROM part),
i AS (SELECT l_orderkey, l_linenumber, l_linenumber % 6 AS n, l_partkey, a.name, a.type, b.type AS next_type, b.name AS next_name FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) JOIN p a ON a.p_partkey = l_partkey LEFT JOIN p b ON b.p_partkey = l_partkey + 1),
j AS (SELECT *, (l_partkey % 2 = 0 AND name = name) OR (l_partkey % 2 = 1 AND next_name = name) AS titled,
  (l_partkey % 4 = 0) OR ((l_partkey + 1) % 4 = 0 AND next_name = name) AS included, (l_partkey % 10 = 0) OR ((l_partkey + 1) % 10 = 0 AND next_type = type) AS excluded FROM i)
SELECT l_orderkey, l_linenumber, CASE n WHEN 0 THEN l_partkey % 2 = 0 WHEN 1 THEN coalesce(titled, false) OR coalesce(included, false) WHEN 2 THEN coalesce(included, false) WHEN 3 THEN l_partkey % 3 = 0 ELSE false END AS traceable,
  n = 5 AND coalesce(excluded, false) AS incorrect, n = 4 AS fabricated FROM j""")
def traced_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of evidence is found again in the note or the record, and no exclusion supports."""
    part = table(spark, sf_dir, "part")
    fact = lambda rows, kind, said: rows.select(F.col("p_partkey").alias("node_id"), F.lit(kind).alias("kind"), F.col(said).alias("text"))
    facts = fact(part.where("p_partkey % 2 = 0"), "TITLE", "p_name").unionByName(fact(part.where("p_partkey % 4 = 0"), "INCLUSION", "p_name")).unionByName(fact(part.where("p_partkey % 10 = 0"), "EXCLUDE", "p_type"))
    notes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note_id"), F.lit("seen in the note").alias("note"))
    return audit.trace_evidence(_evidence_items(spark, sf_dir), notes, facts).select("item_id.*", "traceable", "incorrect", "fabricated")


@query(_FUSED + """, found AS (
  SELECT 'lexical' AS mode, query_id, pl AS rank FROM ranked WHERE query_id = node_id AND lex_score IS NOT NULL AND pl <= 30
  UNION ALL SELECT 'fuzzy', query_id, pf FROM ranked WHERE query_id = node_id AND sim >= 0.3 AND pf <= 30),
modes AS (SELECT unnest(['lexical', 'fuzzy']) AS mode), asked2 AS (SELECT min(p_partkey) AS query_id FROM part GROUP BY p_name)
SELECT mode, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 4) AS recall_at_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 4) AS recall_at_3,
  round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 4) AS recall_at_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 4) AS recall_at_10, round(avg(coalesce(1.0 / rank, 0)), 4) AS mrr
FROM modes CROSS JOIN asked2 LEFT JOIN found USING (mode, query_id) GROUP BY mode""")
def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of the wanted record in the list of each mode, and recall by mode."""
    asked, nodes = misspelt(spark, sf_dir), part_nodes(spark, sf_dir)
    modes = {"lexical": retrieval.lexical_documents(asked, nodes, PART_TEXTS), "fuzzy": retrieval.trigram(asked, nodes.select("node_id", "title"))}
    return evaluate.ranks_summary(audit.mode_ranks(modes, asked.select("query_id", F.col("query_id").alias("node_id"))), ["mode"])


_GATED = {
    "unsupported_code": "l_partkey % 97 = 0", "cross_version": "l_partkey % 89 = 0", "cross_system": "false", "non_ready": "l_suppkey % 83 = 0", "fatal_rule_violation": "l_quantity > 49", "invalid_rule_target": "l_tax > 1",
    "unsupported_specificity": "l_linenumber = 7", "negated_as_active": "l_returnflag = 'R'", "family_history_as_active": "l_returnflag = 'A' AND l_partkey % 2 = 1", "history_as_active": "l_returnflag = 'N' AND l_suppkey % 2 = 1",
    "must_not_return": "l_discount > 0.09", "fabricated_evidence": "l_partkey % 7 > 3", "incorrect_evidence": "l_partkey < 0", "dataset_unresolved": "l_orderkey IS NULL",
}


@query(" UNION ALL ".join(f"SELECT '{g}' AS gate, count(*) FILTER (WHERE {c}) AS value, count(*) FILTER (WHERE {c}) = 0 AS holds FROM lineitem" for g, c in _GATED.items()))
def all_safety_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gates over one table of suggestions."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey % 97 <> 0 AS known", "l_partkey % 89 <> 0 AS same_version", "CAST(NULL AS BOOLEAN) AS same_system", "l_suppkey % 83 <> 0 AS ready", "l_quantity > 49 AS fatal_rule", "l_tax > 1 AS invalid_target",
        "IF(l_linenumber = 7, array('stage'), array()) AS unsupported", "decode(l_returnflag, 'R', 'RULED_OUT', 'A', 'FAMILY_HISTORY', 'HISTORY') AS expected_status", "l_partkey % 2 = 0 AS family_code", "l_suppkey % 2 = 0 AS history_code",
        "l_discount > 0.09 AS forbidden", "IF(l_partkey % 7 > 3, 1, 0) AS fabricated", "IF(l_partkey < 0, 1, 0) AS incorrect", "l_orderkey IS NOT NULL AS dataset_resolved",
    )
    return audit.safety_report(rows)


@query("""
SELECT 'status' AS section, o_orderstatus AS item, 'n' AS metric, count(*)::double AS value FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'latency', '', 'most', max(value) FROM events
UNION ALL SELECT 'latency', '', 'n', count(value)::double FROM events""")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of metrics as one table."""
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    status = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    times = events.agg(F.max("value").alias("most"), F.count("value").alias("n"))
    return audit.report({"status": (status, ["o_orderstatus"]), "latency": (times, [])})


@query("""
WITH c AS (SELECT l_orderkey AS k, l_partkey AS node_id, l_linenumber AS n, l_partkey % 10 / 10 AS score, l_suppkey % 3 AS tier FROM lineitem),
listed AS (
  SELECT k, node_id, 0 AS tier, n, NULL::double AS score, 'first' AS reason FROM c WHERE tier = 0
  UNION ALL SELECT k, node_id, 1, n, score, CASE WHEN n % 2 = 0 THEN 'Alternative candidate' ELSE 'Alternative; requires documentation of: stage, side' END FROM c WHERE tier = 1 AND score >= 0.2
  UNION ALL SELECT k, node_id, 2, n, NULL, 'A00 excludes this documentation; the exclusion refers to B10.' FROM c WHERE tier = 2),
once AS (SELECT *, row_number() OVER (PARTITION BY k, node_id ORDER BY tier, n) AS d FROM listed),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tier, n, node_id) AS place FROM once WHERE d = 1 AND NOT EXISTS (SELECT 1 FROM lineitem f WHERE f.l_orderkey = k AND f.l_linenumber = 1 AND f.l_partkey = node_id))
SELECT k AS concept_id, place::integer AS place, node_id, reason, score::double AS rerank FROM placed WHERE place <= 4""")
def alternative_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternatives of the resolution, of accepted candidates and of exclusions, each record once, and cut."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("concept_id"), F.col("l_partkey").alias("node_id"), F.col("l_linenumber").alias("at"), (F.col("l_partkey") % 10 / 10).alias("rerank"), (F.col("l_suppkey") % 3).alias("tier"))
    final = c.where("at = 1").select("concept_id", F.col("node_id").alias("final_id"))
    accepted = c.where("tier = 1").withColumns({"supported": F.col("at") % 2 == 0, "missing": F.array(F.lit("stage"), F.lit("side"))})
    aimed = c.where("tier = 2").withColumns({"code": F.lit("A00"), "target_code": F.lit("B10")})
    return coding.alternatives(final, c.where("tier = 0").withColumn("reason", F.lit("first")), accepted, aimed, top_k=2)


@query("""
WITH n AS (SELECT c_nationkey AS dataset_id, c_mktsegment AS level, count(*) AS n FROM customer GROUP BY ALL),
r AS (SELECT s_nationkey AS dataset_id, s_suppkey AS run_id, s_acctbal AS started_at FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey DESC) = 1)
SELECT n_nationkey AS dataset_id, coalesce(string_agg(level || '=' || n.n, ',' ORDER BY level), '') AS counts, any_value(run_id) AS run_id
FROM nation LEFT JOIN n ON n.dataset_id = n_nationkey LEFT JOIN r ON r.dataset_id = n_nationkey GROUP BY n_nationkey""")
def dataset_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets with their records by level and their latest run."""
    datasets = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("dataset_id"), "n_name")
    nodes = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("dataset_id"), F.col("c_mktsegment").alias("level"))
    runs = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("dataset_id"), F.col("s_suppkey").alias("run_id"), F.lit("COMPLETED").alias("status"), F.col("s_acctbal").alias("started_at"), *(F.lit(None).alias(c) for c in presentation.RUN[3:]))
    counts = F.array_join(F.transform(F.map_entries("record_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return presentation.dataset_details(datasets, nodes, runs).select("dataset_id", counts.alias("counts"), F.col("latest_ingestion.run_id").alias("run_id"))


@query("""
WITH t AS (SELECT o_custkey + 1000 AS node_id, o_orderstatus AS s, o_orderkey AS pos, o_orderpriority AS term FROM orders),
g AS (SELECT node_id, string_agg(term, '|' ORDER BY pos, term) FILTER (WHERE s = 'F') AS inclusions, string_agg(term, '|' ORDER BY pos, term) FILTER (WHERE s = 'O') AS synonyms, count(*) FILTER (WHERE s = 'P') AS n_exclusions,
  string_agg('note:' || term, '|' ORDER BY pos, term) FILTER (WHERE s = 'F') AS instructions FROM t GROUP BY node_id),
p AS (SELECT c_custkey + 1000 AS node_id, r_name || '>' || n_name AS path FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT n_nationkey + 100, r_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_regionkey, '' FROM region)
SELECT node_id, path, coalesce(inclusions, '') AS inclusions, coalesce(synonyms, '') AS synonyms, coalesce(n_exclusions, 0)::integer AS n_exclusions, coalesce(instructions, '') AS instructions FROM p LEFT JOIN g USING (node_id)""")
def record_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the path to them, their terms and their rules."""
    nodes = tree(spark, sf_dir).withColumns({"code": F.lit(None).cast("string"), "level": F.lit("CATEGORY")})
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 1000).alias("node_id"), "o_orderstatus", F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("said"))
    terms = orders.select("node_id", F.expr("decode(o_orderstatus, 'F', 'INCLUSION', 'O', 'SYNONYM', 'OTHER')").alias("term_type"), F.col("said").alias("term"), "at")
    rules = orders.where("o_orderstatus <> 'O'").select("node_id", F.expr("IF(o_orderstatus = 'P', 'EXCLUDE', 'NOTE')").alias("rule_type"), F.col("said").alias("rule_text"), F.lit(None).cast("string").alias("target_code"), "at")
    entries = orders.select("node_id", F.col("said").alias("lead_term"), "at")
    shown = presentation.records(nodes, hierarchy.closure(nodes), terms, rules, entries, {"NOTE": "note"})
    listed = F.array_join(F.transform("instructions", lambda r: F.concat_ws(":", r["type"], r["text"])), "|")
    return shown.select("node_id", F.array_join("hierarchy.title", ">").alias("path"), F.array_join("inclusions", "|").alias("inclusions"), F.array_join("synonyms", "|").alias("synonyms"), F.size("exclusions").alias("n_exclusions"), listed.alias("instructions"))


@query("SELECT count(*) AS documents, count(*) FILTER (WHERE coalesce(trim(text, ' '), '') <> '' AND doc_id % 3 <> 0) AS embedded, count(*) FILTER (WHERE coalesce(trim(text, ' '), '') <> '' AND doc_id % 3 = 0) AS skipped_unchanged, count(*) FILTER (WHERE coalesce(trim(text, ' '), '') = '') AS skipped_empty FROM documents")
def embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an embedding run does, where a third of the documents has its vectors and another third has those of other texts."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_key"), F.col("text").alias("semantic_text"))
    made_of = F.when(F.col("node_key") % 3 == 0, F.col("semantic_text")).otherwise(F.concat("semantic_text", F.lit("!")))
    stored = docs.where("node_key % 3 < 2").select("node_key", index.identity(index.HASHING, made_of).alias("identity_hash"))
    return index.embed_stats(docs, stored)
