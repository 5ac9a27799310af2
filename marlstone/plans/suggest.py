"""Suggestions for all notes at once: annotate, retrieve, judge, rerank, select, resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, scoring, text
from ..operators import annotate, coding, retrieval
from ..scratch import cut


def concepts_of(notes: DataFrame, include_uncertain: bool = True) -> DataFrame:
    """Concepts with ``concept_id`` (unique), variants and the reason they are not coded, if any."""
    found = annotate.query_variants(annotate.annotate(notes))
    keyed = found.withColumn("concept_id", F.xxhash64("note_id", "concept_index"))
    judged = keyed.withColumn("not_codable", annotate.not_codable(include_uncertain))
    return cut(judged.withColumnRenamed("status", "assertion"), "concepts")


def candidates(concepts: DataFrame, nodes: DataFrame, index: DataFrame, terms: DataFrame, closed: DataFrame, pool: int = 15, extra: DataFrame | None = None) -> DataFrame:
    """Fused candidates of each codable concept, the best over its variants; ``query_id`` is the concept.

    With ``extra`` (concept_id, node_id) these records join the pool, which has as many more places, and only they are given.

    ``nodes``: node_id, code, level, depth, title, parent_id; ``index``: postings; ``terms``: node_id, term; ``closed``:
    node, ancestor of ids.
    """
    asked = concepts.where("not_codable is null").select("concept_id", F.posexplode("variants").alias("at", "query"))
    asked = cut(asked.withColumn("query_id", F.xxhash64("concept_id", "at")), "variants")
    titles = nodes.select("node_id", "title")
    no_entries = terms.limit(0).select(F.col("node_id").alias("target_node_id"), "term")
    generated = {"exact": retrieval.exact(asked, nodes), "lexical": retrieval.lexical(asked, index), "fuzzy": retrieval.trigram(asked, titles, words=True), "index_term": retrieval.source_terms(asked, terms, no_entries, words=True)}
    of = asked.select("query_id", F.col("concept_id").alias("_c"))

    def best(rows: DataFrame) -> DataFrame:
        return rows.join(of, "query_id").groupBy(F.col("_c").alias("query_id"), "node_id").agg(F.max("score").alias("score"))

    generated = {n: cut(best(r), "generated") for n, r in generated.items()}
    found = None
    for rows in generated.values():
        found = rows.select("query_id", "node_id") if found is None else found.unionByName(rows.select("query_id", "node_id"))
    if extra is not None:
        found = found.unionByName(extra.select(F.col("concept_id").alias("query_id"), "node_id"))
    found = cut(found.distinct(), "pool")
    pairs = cut(found.withColumnRenamed("query_id", "_c").join(of, "_c").select("query_id", "node_id"), "pairs")
    whole = {"lexical": retrieval.lexical(asked, index, pool=pairs), "fuzzy": retrieval.trigram(asked, titles, threshold=0.0, words=True, pool=pairs), "index_term": retrieval.source_terms(asked, terms, no_entries, threshold=0.0, words=True, pool=pairs)}
    complete = {"exact": generated["exact"]} | {n: best(r) for n, r in whole.items()}
    above = closed.join(titles.withColumnRenamed("node_id", "ancestor"), "ancestor").groupBy(F.col("node").alias("node_id")).agg(F.array_distinct(F.flatten(F.collect_list(text.tokens(F.col("title"))))).alias("ancestor_tokens"))
    named = nodes.where("status = 'ACTIVE'").select("node_id", "code").join(above, "node_id", "left").withColumn("ancestor_tokens", F.coalesce("ancestor_tokens", F.array().cast("array<string>")))
    joined = concepts.select(F.col("concept_id").alias("query_id"), F.array_join("variants", " ").alias("query"))
    if extra is None:
        return retrieval.fuse(joined, named, complete, pool)
    places = extra.groupBy(F.col("concept_id").alias("query_id")).agg((F.count(F.lit(1)) + pool).alias("_places"))
    ranked = retrieval.fuse(joined, named, complete, None).join(places, "query_id").where(F.col("place") <= F.col("_places")).drop("_places")
    return ranked.join(extra.select(F.col("concept_id").alias("query_id"), "node_id"), ["query_id", "node_id"], "left_semi")


def judge(concepts: DataFrame, pooled: DataFrame, nodes: DataFrame, terms: DataFrame, rules: DataFrame, closed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each candidate with its features, score and the reason against it, if any; and what the rules find."""
    own = terms.groupBy("node_id").agg(F.array_sort(F.collect_list("term")).alias("terms"), F.array_sort(F.collect_list(F.when(F.col("term_type") == "INCLUSION", F.col("term")))).alias("inclusion_terms"))
    category = nodes.select(F.col("node_id").alias("category_id"), F.col("title").alias("category_title"))
    empty = F.array().cast("array<string>")
    facts = nodes.drop("code").join(own, "node_id", "left").join(category, "category_id", "left").withColumns({"terms": F.coalesce("terms", empty), "inclusion_terms": F.coalesce("inclusion_terms", empty)})
    classed = closed.join(nodes.where(codes.is_classification(F.col("level"))).select(F.col("node_id").alias("ancestor")), "ancestor", "left_semi")
    lines = nodes.select(F.col("node_id").alias("ancestor"), "title").join(own, F.col("ancestor") == own["node_id"], "left").select("ancestor", F.concat(F.array("title"), F.coalesce("terms", empty)).alias("_t"))
    above = classed.join(lines, "ancestor").groupBy(F.col("node").alias("node_id")).agg(F.flatten(F.collect_list("_t")).alias("above_texts"))
    words = coding.concept_stems(F.col("text"), F.col("expansions"))
    rows = pooled.withColumnRenamed("query_id", "concept_id").join(concepts.drop("variants").withColumn("concept_stems", words), "concept_id").join(facts, "node_id").join(above, "node_id", "left")
    rows = rows.withColumn("above_texts", F.coalesce("above_texts", empty))
    scope = classed.select(F.col("node").alias("node_id"), F.col("ancestor").alias("rule_node_id")).unionByName(nodes.select("node_id", F.col("node_id").alias("rule_node_id")))
    pairs = concepts.where("not_codable is null").select("note_id", "concept_id", words.alias("stems"))
    others = pairs.alias("a").join(pairs.alias("b"), (F.col("a.note_id") == F.col("b.note_id")) & (F.col("a.concept_id") != F.col("b.concept_id"))).select(F.col("a.concept_id").alias("concept_id"), F.col("b.stems").alias("other_stems"))
    findings = cut(coding.rule_findings(rows.select("concept_id", "node_id", "concept_stems"), scope, rules, others), "findings")
    status = coding.rule_status(findings)
    rows = rows.join(status, ["concept_id", "node_id"], "left").withColumn("rule_status", F.coalesce("rule_status", F.lit("passed")))
    base = F.when(F.col("category_id") != F.col("node_id"), F.col("category_title"))
    meant = F.struct(F.col("text"), F.col("evidence"), F.col("assertion").alias("status"), F.col("expansions"), F.col("attributes"))
    rows = rows.withColumn("detail", coding.specificity(meant, F.col("title"), base, F.col("terms")))
    said = F.concat(F.array("text"), F.col("expansions"))
    texts = F.concat(F.array("title"), F.col("terms"))
    rows = rows.withColumns({
        "included": F.exists("inclusion_terms", lambda t: coding.inclusion_match(F.col("text"), F.col("expansions"), F.col("assertion"), t)),
        "exact_terminology": coding.exact_terminology(F.col("text"), F.col("expansions"), texts), "overlap": coding.concept_overlap(F.col("concept_stems"), texts),
        "verdict": coding.condition_support(said, F.concat(texts, F.col("above_texts"))),
    })
    by_term = F.exists("detail.matched", lambda m: m.startswith("source term"))
    exempt = (F.col("exact") >= 1) | F.col("included") | (F.col("exact_terminology") > 0) | by_term
    features = {
        "hybrid": F.col("hybrid"), "exact_terminology": F.col("exact_terminology"), "concept_overlap": F.col("overlap"), "inclusion_match": F.col("included"), "documented_specificity": F.size("detail.matched") > 0,
        "selectable": F.col("selectable"), "unsupported_specificity": ~F.col("detail.supported"), "less_specific": F.size("detail.less_specific") > 0, "rule_warning": F.col("rule_status") == "warning",
    }
    scores = {n: F.col(n) for n in ("exact", "lexical", "fuzzy", "index_term")}
    reason = F.coalesce(
        F.when(F.col("rule_status") == "rejected", "The note matches an exclusion."), F.when(F.col("detail.contradicted"), F.array_join("detail.conflicts", "; ")),
        coding.status_gate(F.col("assertion"), F.col("text"), F.col("title"), F.col("terms")), coding.condition_gate(F.col("verdict"), exempt, F.col("assertion"), F.col("concept_type"), F.lit(None).cast("double")),
        F.when(~F.col("included") & ~coding.has_evidence(scores), "The evidence of retrieval is too weak."),
    )
    rows = rows.withColumns({"rerank": coding.rerank(features), "reason": reason, "condition": F.when(exempt, "exempt").otherwise(F.col("verdict")), "strong": (F.col("exact_terminology") > 0) | F.col("included") | by_term | ((F.col("lexical") >= 0.8) & (F.col("fuzzy") >= 0.8))})
    return cut(rows.drop("place"), "judged"), findings


def redirects(judged: DataFrame, nodes: DataFrame) -> DataFrame:
    """``concept_id``, ``node_id`` of the records that rejecting exclusions refer to and that are not among a concept's candidates."""
    aimed = judged.select("concept_id", F.explode("redirects").alias("code")).where("code is not null").distinct()
    unknown = aimed.join(judged.select("concept_id", "code"), ["concept_id", "code"], "left_anti")
    return unknown.join(nodes.where("status = 'ACTIVE'").select("node_id", "code"), "code").select("concept_id", "node_id").distinct()


def trace(notes: DataFrame, nodes: DataFrame, index: DataFrame, terms: DataFrame, rules: DataFrame, closed: DataFrame, top_k: int = 5, include_uncertain: bool = True) -> dict[str, DataFrame]:
    """All stages: concepts, candidates, findings of rules, judged candidates, and ``suggestions``, the accepted candidates
    of each concept in order, with their resolution and confidence.

    ``notes``: note_id, text; ``nodes``: node_id, parent_id, code, title, level, depth, status, selectable, category_id;
    ``terms``: node_id, term, term_type; ``rules``: node_id, rule_type, rule_text, target_code; ``closed``: node, ancestor, lvl.
    Records that an exclusion refers to are retrieved and judged as well.
    """
    concepts, texts = concepts_of(notes, include_uncertain), terms.select("node_id", "term")
    pooled = cut(candidates(concepts, nodes, index, texts, closed), "candidates")
    judged, findings = judge(concepts, pooled, nodes, terms, rules, closed)
    extra = cut(redirects(judged, nodes), "redirects")
    if not extra.isEmpty():
        asked = concepts.join(extra, "concept_id", "left_semi")
        more = cut(candidates(asked, nodes, index, texts, closed, extra=extra), "candidates")
        judged_more, found_more = judge(concepts, more, nodes, terms, rules, closed)
        pooled, judged, findings = pooled.unionByName(more), judged.unionByName(judged_more), findings.unionByName(found_more)
    judged = coding.drop_guesses(judged)
    ranked = coding.select_best(judged, top_k).select("note_id", "concept_id", "concept_index", "text", "assertion", "node_id", "code", "category_id", "rerank", "hybrid", "selectable", "strong", "rule_status", F.col("detail.supported").alias("supported"), F.col("detail.missing").alias("missing"), F.col("detail.matched").alias("matched"), "place")
    ended = coding.verified(coding.resolve(ranked, nodes, judged.where("detail.supported").select("concept_id", "node_id")), nodes)
    sure = coding.confidence(F.col("rerank"), F.col("strong"), F.size("missing") == 0, F.col("resolution") == "direct", F.col("rule_status") == "passed", F.col("selectable"), F.col("assertion"))
    suggestions = cut(ended.withColumn("confidence", sure), "suggestions")
    return {"concepts": concepts, "candidates": pooled, "findings": findings, "judged": judged, "suggestions": suggestions, "alternatives": other_records(suggestions, judged, findings, nodes, top_k)}


def other_records(suggestions: DataFrame, judged: DataFrame, findings: DataFrame, nodes: DataFrame, top_k: int = 5) -> DataFrame:
    """:func:`coding.alternatives` of each concept with a suggestion, with code and title."""
    best = suggestions.where("place = 1")
    given_up = best.where("resolution = 'parent_fallback'").select("concept_id", "node_id", F.concat(F.lit("More specific code; requires documentation of: "), F.array_join("missing", ", ")).alias("reason"), F.lit(1).alias("at"))
    accepted = coding.select_best(judged, 2**31 - 1).where("place > 1").select("concept_id", "node_id", "rerank", F.col("detail.supported").alias("supported"), F.col("detail.missing").alias("missing"), F.col("place").alias("at"))
    order = F.row_number().over(Window.partitionBy("concept_id").orderBy(F.desc("rerank"), "code", "target_code", "rule_text"))
    aimed = findings.where("severity = 'reject' AND target_code IS NOT NULL").join(judged.select("concept_id", "node_id", "code", "rerank"), ["concept_id", "node_id"]).withColumn("at", order).drop("node_id")
    redirected = aimed.join(nodes.where("status = 'ACTIVE'").select("node_id", F.col("code").alias("target_code")), "target_code")
    listed = coding.alternatives(best.select("concept_id", "final_id"), given_up, accepted, redirected, top_k)
    kept = listed.join(best.select("concept_id"), "concept_id", "left_semi")
    return kept.join(nodes.select("node_id", "code", "title"), "node_id")


# What is said beside a suggestion for a concept that is not simply documented.
POLICIES = {
    "UNCERTAIN": "Uncertain/suspected diagnosis: apply the applicable coding standard for uncertain diagnoses before assigning this code.",
    "SUSPECTED": "Uncertain/suspected diagnosis: apply the applicable coding standard for uncertain diagnoses before assigning this code.",
    "HISTORY": "Personal-history mention: only history codes were considered.",
    "FAMILY_HISTORY": "Family-history mention: only family-history codes were considered.",
}
NOT_FINAL = "Category-level record: not a valid final code; a more specific subdivision is required once documented."


def assemble(found: dict[str, DataFrame], nodes: DataFrame) -> DataFrame:
    """The first suggestion of each concept as it is shown: the final record, ``evidence``, ``policy``, ``warning``, ``alternatives``.

    ``found``: of :func:`trace`.  Evidence comes from the candidate retrieved: the note's clause, the inclusion term that says
    the same, the details that the note documents.
    """
    kind = "array<struct<type:string,text:string,start:int,end:int,details:array<string>>>"
    no_text, no_place, no_details = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("array<string>")
    clause = F.array(F.struct(F.lit("clinical_text"), "evidence", F.col("start").cast("int"), F.col("end").cast("int"), no_details)).cast(kind)
    said = F.filter("inclusion_terms", lambda t: coding.inclusion_match(F.col("text"), F.col("expansions"), F.col("assertion"), t))
    included = F.transform(F.slice(said, 1, 1), lambda t: F.struct(F.lit("inclusion_term"), t, no_place, no_place, no_details)).cast(kind)
    detail = F.col("detail.matched")
    documented = F.when(F.size(detail) > 0, F.array(F.struct(F.lit("documented_specificity"), no_text, no_place, no_place, detail)).cast(kind)).otherwise(F.array().cast(kind))
    shown = found["judged"].select("concept_id", "node_id", F.concat(clause, included, documented).alias("evidence"))
    entry = F.struct("place", "node_id", "code", "title", "reason", "rerank")
    listed = found["alternatives"].groupBy("concept_id").agg(F.array_sort(F.collect_list(entry)).alias("alternatives"))
    policies = F.create_map(*(F.lit(x) for pair in POLICIES.items() for x in pair))
    final = nodes.select(F.col("node_id").alias("final_id"), F.col("code").alias("final_code"), F.col("title").alias("final_title"), F.col("selectable").alias("final_selectable"))
    rows = found["suggestions"].where("place = 1").join(shown, ["concept_id", "node_id"]).join(listed, "concept_id", "left").join(final, "final_id")
    return rows.withColumns({"policy": F.try_element_at(policies, F.col("assertion")), "warning": F.when(~F.col("final_selectable"), NOT_FINAL)})


def suggest(notes: DataFrame, nodes: DataFrame, index: DataFrame, terms: DataFrame, rules: DataFrame, closed: DataFrame, top_k: int = 5, include_uncertain: bool = True) -> DataFrame:
    """The suggestions of :func:`trace`."""
    return trace(notes, nodes, index, terms, rules, closed, top_k, include_uncertain)["suggestions"]
