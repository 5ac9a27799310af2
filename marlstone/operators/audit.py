"""Audits of suggestions against labelled cases: matching, undocumented details, confidence, evidence, modes, gates, reports.

The checks of details read the words of the note again and share nothing with :mod:`coding`, so that a fault
there cannot hide itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from . import evaluate

# Thresholds.
CONCEPT_MATCH = 0.6
STRONG_LEXICAL, STRONG_VECTOR = 0.6, 0.5
CONFIDENCES = ("LOW", "MEDIUM", "HIGH")

# What a title's word claims, and the words of a note that document it.
CLAIMED_WORDS = {
    "laterality": {"left": "left lt", "right": "right rt", "both": "both bilateral bilaterally", "bilateral": "both bilateral bilaterally"},
    "severity": {"mild": "mild", "moderate": "moderate", "severe": "severe"},
    "encounter": {"initial": "initial", "subsequent": "subsequent", "sequela": "sequela sequelae", "sequelae": "sequelae sequela"},
    "anatomy": {
        "knee": "knee knees", "hip": "hip hips", "lung": "lung lungs pulmonary", "lungs": "lung lungs pulmonary",
        "kidney": "kidney kidneys renal ckd", "forearm": "forearm forearms radius ulna",
    },
    "acuity": {"acute": "acute", "chronic": "chronic", "subacute": "subacute"},
}
GENERIC = "complication complications involvement disorder a an the of".split()
ABSENCE = "without no uncomplicated denies".split()
TYPE, TYPE_SAID, STAGE = r"\btype\s*(\d+|i{1,2})\b", r"\btype\s*(\d+|i{1,2}|one|two)\b", r"\bstage\s*(\d+|i{1,3}v?|iv|v)\b"
ROMAN = {"i": "1", "ii": "2", "one": "1", "two": "2"}
TYPE_ABBREVIATIONS = {"t1dm": "1", "t2dm": "2"}
LONG_STANDING, ACUTE_ON_CHRONIC = r"long[\s-]standing", r"acute[\s-]+on[\s-]+chronic"
LINKED = r"\b(with|complicated by|due to|secondary to)\b"
PHRASES = {"with": r"\bwith\s+(?!out\b)([a-z][a-z\s-]*?)(?=$|,|;|\bwithout\b)", "without": r"\bwithout\s+([a-z][a-z\s-]*?)(?=$|,|;)", "due to": r"\bdue to\s+([a-z][a-z\s-]*?)(?=$|,|;)"}
# How an attribute that is reported as missing starts, and what would document it.
MISSING = r"(?i)^(laterality|severity|acuity|subtype|stage|encounter|anatomical site|complication|absence of|detail)\b"
DOCUMENTED = {
    "laterality": ("left right lt rt bilateral both", None), "severity": ("mild moderate severe", None), "acuity": ("acute chronic subacute", LONG_STANDING),
    "subtype": ("t1dm t2dm", TYPE_SAID), "stage": ("", STAGE), "encounter": ("initial subsequent sequela sequelae", None), "absence of": (" ".join(ABSENCE), None),
}


def _words(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def _any_of(words: Column, *wanted: str) -> Column:
    return F.arrays_overlap(words, _words(wanted))


def _singular(words: Column) -> Column:
    return F.array_distinct(F.transform(words, evaluate.singular))


def _only(words: Column, wanted: str) -> Column:
    return F.filter(words, lambda w: w == wanted)


def _after(word: str, phrase: Column) -> Column:
    return F.concat(F.lit(word + " "), phrase)


def _groups(found: Column) -> Column:
    return F.coalesce(found, F.array().cast("array<string>"))


def concept_pairs(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of a case that share a word: ``keys``, expected_at, found_at, ``score`` of the best reading.

    ``expected``: keys, expected_at, text; ``found``: keys, found_at, readings (an array).  Pairs without a common word
    score 0 and are not made.
    """
    def worded(rows: DataFrame, at: str, said: Column) -> DataFrame:
        return rows.select(*keys, at, F.explode(_singular(text.tokens(said))).alias("_w")).distinct()

    left = worded(expected, "expected_at", F.col("text"))
    right = worded(found, "found_at", F.array_join("readings", " "))
    met = left.join(right, [*keys, "_w"]).select(*keys, "expected_at", "found_at").distinct()
    both = met.join(expected.select(*keys, "expected_at", "text"), [*keys, "expected_at"]).join(found.select(*keys, "found_at", "readings"), [*keys, "found_at"])
    best = F.array_max(F.transform("readings", lambda r: evaluate.concept_similarity(F.col("text"), r)))
    return both.select(*keys, "expected_at", "found_at", best.alias("score"))


def match_concepts(pairs: DataFrame, keys: Sequence[str], at_least: float = CONCEPT_MATCH) -> DataFrame:
    """Greedy one-to-one matches: the closest pair first, of equal ones that with the later expected, then the later found concept.

    ``pairs``: keys, expected_at, found_at, score.  A case is one note, whose pairs are gathered and folded in one row.
    """
    kinds = dict(pairs.dtypes)
    kind = f"array<struct<score:double,expected_at:{kinds['expected_at']},found_at:{kinds['found_at']}>>"
    listed = F.sort_array(F.collect_list(F.struct(F.col("score").cast("double").alias("score"), "expected_at", "found_at")), asc=False).cast(kind)

    def take(taken: Column, pair: Column) -> Column:
        used = F.exists(taken, lambda t: (t["expected_at"] == pair["expected_at"]) | (t["found_at"] == pair["found_at"]))
        return F.when(used, taken).otherwise(F.concat(taken, F.array(pair))).cast(kind)

    cases = pairs.where(F.col("score") >= at_least).groupBy(*keys).agg(listed.alias("_pairs"))
    chosen = cases.select(*keys, F.explode(F.aggregate("_pairs", F.array().cast(kind), take)).alias("_m"))
    return chosen.select(*keys, "_m.expected_at", "_m.found_at", "_m.score")


def missing_is_genuine(item: Column, evidence: Column) -> Column:
    """Whether a detail that is reported as missing is not in the evidence; contradicting and unknown details are genuine."""
    evidence = F.coalesce(evidence, F.lit(""))
    said, kind = text.tokens(evidence), F.lower(F.regexp_extract(F.trim(item), MISSING, 1))
    inner = F.array_except(_singular(text.tokens(F.regexp_extract(item, r"\(([^)]*)\)", 1))), _words(GENERIC))
    there = (F.size(inner) > 0) & (F.size(F.array_except(inner, _singular(said))) == 0)
    documented = F.when(F.contains(item, F.lit("(conflicting)")) | (kind == ""), False)
    for name, (words, shape) in DOCUMENTED.items():
        by_word = _any_of(said, *words.split()) if words else F.lit(False)
        documented = documented.when(kind == name, by_word | evidence.rlike("(?i)" + shape) if shape else by_word)
    return ~documented.otherwise(there)


def unsupported_specificity(title: Column, parent: Column, evidence: Column, terms: Column) -> Column:
    """``attribute: detail`` of what a title adds to its parent's and the evidence does not say.

    Nothing without a parent, for a title that is unspecified, or where the evidence holds one of the record's ``terms``.
    """
    none = F.array().cast("array<string>")

    def read(title: Column, parent: Column, evidence: Column, terms: Column) -> Column:
        return text.once(partial(unless_silent, title, parent, evidence, terms), F.lower(title), text.normalize_text(evidence))

    def unless_silent(title: Column, parent: Column, evidence: Column, terms: Column, low: Column, clause: Column) -> Column:
        cited = F.exists(terms, lambda t: text.once(lambda n: (n != "") & F.contains(clause, n), text.normalize_text(t)))
        silent = parent.isNull() | low.rlike(r"\b(unspecified|nos)\b") | F.coalesce(cited, F.lit(False))
        return F.when(silent, none).otherwise(text.once(partial(worded, title, evidence, low), F.lower(parent), text.words(clause), _singular(text.tokens(parent))))

    def worded(title: Column, evidence: Column, low: Column, under: Column, said: Column, above: Column) -> Column:
        added = F.filter(text.tokens(title), lambda w: ~F.array_contains(above, evaluate.singular(w)))
        return text.once(partial(_open_details, evidence, low, under, said), added, F.lower(evidence), _singular(said))

    return text.once(read, title, parent, F.coalesce(evidence, F.lit("")), terms)


def _open_details(evidence: Column, low: Column, under: Column, said: Column, added: Column, heard: Column, stated: Column) -> Column:
    """The details of :func:`unsupported_specificity`, of columns that are computed: ``low`` title, ``under`` parent and ``heard`` evidence in lower case, the words ``said``, ``stated`` (singular) and ``added`` by the title."""
    none = F.array().cast("array<string>")
    told = lambda name, details: F.transform(details, lambda d: F.concat(F.lit(name + ": "), d))
    out = []
    for name, claims in CLAIMED_WORDS.items():
        # the words of the title whose claim none of the note's words documents
        open_words = _words([])
        for word, documents in claims.items():
            known = _any_of(said, *documents.split())
            if word == "chronic":
                known = known | evidence.rlike("(?i)" + LONG_STANDING)
            open_words = F.concat(open_words, F.when(known, none).otherwise(_only(added, word)))
        if name == "acuity":
            whole = F.when(evidence.rlike("(?i)" + ACUTE_ON_CHRONIC), none).otherwise(_words(["acute on chronic"]))
            open_words = F.when(F.contains(low, F.lit("acute on chronic")) & ~F.contains(under, F.lit("acute on chronic")), whole).otherwise(open_words)
        out.append(told(name, open_words))
    digits = F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair))
    number = lambda n: F.coalesce(F.try_element_at(digits, n), n)
    kinds = F.transform(F.regexp_extract_all(heard, F.lit(TYPE_SAID), 1), number)
    for word, kind in TYPE_ABBREVIATIONS.items():
        kinds = F.concat(kinds, F.when(F.array_contains(said, word), _words([kind])).otherwise(none))
    stages = F.regexp_extract_all(heard, F.lit(STAGE), 1)
    for name, shape, known, spelled in (("subtype", TYPE, kinds, number), ("stage", STAGE, stages, lambda n: n)):
        wanted = F.transform(F.slice(F.regexp_extract_all(low, F.lit(shape), 1), 1, 1), spelled)
        out.append(F.when(under.rlike(shape), none).otherwise(told(name, F.array_except(wanted, known))))
    for name, shape in PHRASES.items():
        new = F.filter(F.transform(_groups(F.regexp_extract_all(low, F.lit(shape), 1)), F.trim), lambda p: ~F.contains(under, p))
        here = lambda p: F.size(F.array_except(F.array_except(_singular(text.tokens(p)), _words(GENERIC)), stated)) == 0
        if name == "without":
            open_phrases = F.when(_any_of(said, *ABSENCE), none).otherwise(new)
        elif name == "with":
            open_phrases = F.when(evidence.rlike("(?i)" + LINKED), F.filter(new, lambda p: ~here(p))).otherwise(new)
        else:
            open_phrases = F.filter(new, lambda p: ~here(p))
        spelled = F.transform(open_phrases, partial(_after, name))
        out.append(told("cause" if name == "due to" else "complication", spelled))
    return F.concat(*out)


def audit_confidence(rows: DataFrame) -> DataFrame:
    """The signals behind each suggestion's confidence, and ``violation``: HIGH without them, or above what its case allows.

    ``rows``: exact, lexical, index_term, fuzzy, semantic (scores, may be null), near_tie, missing (array), rule_status,
    terminology_support, confidence, max_confidence (null: any).
    """
    score = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    strong = score("exact") >= 1
    for name in ("lexical", "index_term", "fuzzy"):
        strong = strong | (score(name) >= STRONG_LEXICAL)
    order = _words(CONFIDENCES)
    above = F.array_position(order, F.col("confidence")) > F.array_position(order, F.col("max_confidence"))
    signals = rows.withColumns({
        "lexical_strong": strong, "vector_strong": score("semantic") >= STRONG_VECTOR, "specificity_incomplete": F.coalesce(F.size("missing"), F.lit(0)) > 0,
        "rule_conflict": ~F.col("rule_status").eqNullSafe(F.lit("passed")),
    })
    weak = ~F.col("lexical_strong") & ~F.col("terminology_support")
    unjustified = (F.col("confidence") == "HIGH") & (weak | F.col("near_tie") | F.col("specificity_incomplete") | F.col("rule_conflict"))
    return signals.withColumns({"agree": F.col("lexical_strong") & F.col("vector_strong"), "violation": F.coalesce(unjustified, F.lit(False)) | F.coalesce(above, F.lit(False))})


def trace_evidence(items: DataFrame, notes: DataFrame, facts: DataFrame) -> DataFrame:
    """``item_id``, ``traceable``, ``incorrect`` (an exclusion as support) and ``fabricated`` (of no known type).

    ``items``: item_id (unique), note_id, record_ids (of the record suggested and the one retrieved), type, text, start, end, details;
    ``notes``: note_id, note; ``facts``: node_id, kind (TITLE, CODE, TERM, INCLUSION, INDEX or EXCLUDE), text.
    """
    keyed = items.where(F.col("type").isin("matched_term", "inclusion_term")).select("item_id", "type", F.explode(F.array_distinct("record_ids")).alias("node_id"), text.normalize_text(F.col("text")).alias("_key"))
    known = facts.select("node_id", "kind", text.normalize_text(F.col("text")).alias("_key"))
    supports = F.when(F.col("type") == "inclusion_term", F.col("kind") == "INCLUSION").otherwise(F.col("kind") != "EXCLUDE")
    held = keyed.join(known, ["node_id", "_key"]).groupBy("item_id").agg(F.bool_or(supports).alias("_held"), F.bool_or(F.col("kind") == "EXCLUDE").alias("_excluded"))
    cited = items.where("type = 'clinical_text'").select("item_id", "note_id", "text", "start", "end").join(notes.select("note_id", "note"), "note_id")
    span = F.substring(F.col("note"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    # code points, as the note's spans are; a span that ends before it starts or outside the note holds nothing
    quoted = cited.select("item_id", ((F.col("start") >= 0) & (F.col("end") >= F.col("start")) & span).alias("_quoted"))
    found = items.select("item_id", "type", "details").join(held, "item_id", "left").join(quoted, "item_id", "left")
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    traceable = F.when(F.col("type") == "clinical_text", yes("_quoted")).when(F.col("type") == "documented_specificity", F.col("details").isNotNull()).otherwise(yes("_held") & ~yes("_excluded"))
    known_type = F.coalesce(F.col("type").isin("clinical_text", "matched_term", "inclusion_term", "documented_specificity"), F.lit(False))
    return found.select("item_id", (known_type & traceable).alias("traceable"), yes("_excluded").alias("incorrect"), (~known_type).alias("fabricated"))


def mode_ranks(modes: Mapping[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """The rank of each wanted record in each mode's list, null where it is not in it: wanted's columns, ``mode``, ``rank``.

    ``modes``: name -> (query_id, node_id, score), the score the higher the better, ties by record; ``wanted``: query_id, node_id.
    """
    tagged = None
    for name, rows in modes.items():
        one = rows.select("query_id", "node_id", F.col("score").cast("double").alias("score"), F.lit(name).alias("mode"))
        tagged = one if tagged is None else tagged.unionByName(one)
    best = tagged.groupBy("mode", "query_id", "node_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("mode", "query_id").orderBy(F.desc("score"), "node_id"))
    named = wanted.withColumn("mode", F.explode(_words(list(modes))))
    return named.join(best.withColumn("rank", place).select("mode", "query_id", "node_id", "rank"), ["mode", "query_id", "node_id"], "left")


#: What must not happen, by gate, over one row for each suggestion (or case without any); fixed names.
GATES = {
    "unsupported_code": "NOT known", "cross_version": "NOT same_version", "cross_system": "NOT same_system", "non_ready": "NOT ready",
    "fatal_rule_violation": "fatal_rule", "invalid_rule_target": "invalid_target", "unsupported_specificity": "size(unsupported) > 0",
    "negated_as_active": "expected_status IN ('NEGATED', 'RULED_OUT')", "family_history_as_active": "expected_status = 'FAMILY_HISTORY' AND NOT family_code",
    "history_as_active": "expected_status = 'HISTORY' AND NOT history_code", "must_not_return": "forbidden", "fabricated_evidence": "fabricated > 0",
    "incorrect_evidence": "incorrect > 0", "dataset_unresolved": "NOT dataset_resolved",
}


def safety_report(checked: DataFrame) -> DataFrame:
    """``gate``, ``value`` (offending rows) and ``holds`` (none) of all :data:`GATES`, in one pass; a null offends no gate."""
    counts = checked.agg(*(F.count_if(F.coalesce(F.expr(test), F.lit(False))).alias(name) for name, test in GATES.items()))
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("gate"), F.col(n).alias("value")) for n in GATES))).alias("g"))
    return rows.select("g.gate", "g.value", (F.col("g.value") == 0).alias("holds"))


def report(sections: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Tables of metrics as one: ``section``, ``item`` (the keys' values), ``metric``, ``value``.

    ``sections``: name -> (table, its keys); every other number or truth value of the table is a metric, null ones are left out.
    """
    out = None
    for name, (rows, keys) in sections.items():
        metrics = [c for c, t in rows.dtypes if c not in keys and (t in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal"))]
        listed = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
        item = F.concat_ws("/", *(F.col(k).cast("string") for k in keys)) if keys else F.lit("")
        one = rows.select(F.lit(name).alias("section"), item.alias("item"), F.explode(listed).alias("m")).select("section", "item", "m.metric", "m.value").where("value is not null")
        out = one if out is None else out.unionByName(one)
    return out


def markdown(rows: DataFrame) -> str:
    """A :func:`report` as Markdown, a table for each section; it has as many rows as there are metrics, so the driver takes it."""
    lines: list[str] = []
    section = None
    for r in rows.orderBy("section", "item", "metric").collect():
        if r["section"] != section:
            section = r["section"]
            lines += [f"## {section}", "", "| item | metric | value |", "|-|-|-|"] if not lines else ["", f"## {section}", "", "| item | metric | value |", "|-|-|-|"]
        lines.append(f"| {r['item'].replace('|', chr(92) + '|')} | {r['metric']} | {r['value']:g} |")
    return "\n".join(lines) + ("\n" if lines else "")


def load_cases(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Labelled cases of JSON lines or CSV with a header; an empty cell is null, a case without ``case_id`` is named by its place.

    ``columns``: the schema, in which a CSV has strings only.  The place is that in Spark's reading order, unique in any case.
    """
    if path.lower().endswith(".csv"):
        read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        wanted = spark.createDataFrame([], columns).columns
        rows = read.select(*(F.col(f"`{c}`") if c in read.columns else F.lit(None).cast("string").alias(c) for c in wanted))
    else:
        rows = spark.read.schema(columns).json(path)
    named = F.coalesce("case_id", F.concat(F.lit("line-"), F.monotonically_increasing_id() + 1))
    return rows.withColumn("case_id", named)


def select_cases(cases: DataFrame, tags: Sequence[str] = (), system: str | None = None, version: str | None = None) -> DataFrame:
    """Cases with any of the tags, of a coding system in any case, and of a version."""
    if tags:
        cases = cases.where(_any_of(F.col("tags"), *tags))
    if system:
        cases = cases.where(F.upper("coding_system") == system.upper())
    return cases.where(F.col("version") == version) if version else cases
