"""Search documents: one for each node, with parts by weight, text for embedding, hashes, and vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, text, vectors

#: Children that a document lists.
MAX_CHILDREN = 25
SELF_DESCRIBING = ("INCLUDE", "NOTE")
#: Widest vector, and widest that an index serves.
MAX_DIMENSION, MAX_INDEXED = 16_000, 2_000


@dataclass(frozen=True)
class Space:
    """Vectors are comparable only in one space."""

    provider: str
    model: str
    dimension: int
    normalized: bool = True
    distance: str = "cosine"

    @property
    def key(self) -> str:
        return f"{self.provider}/{self.model}/{self.dimension}/{'normalized' if self.normalized else 'raw'}"

    def predicate(self) -> Column:
        """Rows embedded in this space."""
        return (F.col("provider") == self.provider) & (F.col("model") == self.model) & (F.col("dimension") == self.dimension) & (F.col("normalized") == self.normalized)


HASHING = Space("hashing", f"hashing-v1-{vectors.DIMENSION}", vectors.DIMENSION)


def _listed(rows: DataFrame, key: str, value: Column, name: str, *order: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("node_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("v")))), lambda x: x["v"]).alias(name))


def documents(nodes: DataFrame, closed: DataFrame, terms: DataFrame, entries: DataFrame, rules: DataFrame, dataset: str, language: str = "en") -> DataFrame:
    """One row for each node: ``content``, ``semantic_text``, ``part_a``, ``part_b``, ``part_c`` and ``content_hash``.

    ``nodes`` as from ``hierarchy.build``; ``closed``: node, ancestor, lvl of keys; ``terms``: key, term, term_type;
    ``entries``: target_key, lead_term; ``rules``: key, rule_type, rule_text.  Exclusions and instructions that name other
    conditions stay out of the text for embedding.  Synonyms of classification ancestors are inherited at part B.
    """
    kind = lambda name, t: _listed(terms.where(F.col("term_type") == t), "key", F.col("term"), name, "term")
    label = F.concat_ws(" ", F.when(F.col("level") == "CHAPTER", F.concat(F.lit("Chapter "), "code")).otherwise(F.col("code")), "title")
    labels = nodes.select(F.col("key").alias("ancestor"), label.alias("label"), codes.is_classification(F.col("level")).alias("_classed"), "title", "sort_order", F.col("parent_key"))
    path = _listed(closed.join(labels, "ancestor").withColumn("_up", -F.col("lvl")), "node", F.col("label"), "path", "_up")
    kids = _listed(labels.where("parent_key is not null"), "parent_key", F.struct("label", "title"), "kids", "sort_order")
    named = terms.where(F.col("term_type").isin("SYNONYM", "ABBREVIATION")).select("key", "term").unionByName(entries.where("target_key is not null").select(F.col("target_key").alias("key"), F.col("lead_term").alias("term")))
    above = closed.join(labels.where("_classed").select("ancestor"), "ancestor").join(named, F.col("ancestor") == F.col("key")).select("node", "lvl", "term").withColumn("_up", -F.col("lvl"))
    own_rules = lambda name, keep: _listed(rules.where(keep), "key", F.col("rule_text"), name, "rule_type", "rule_text")
    described = F.col("rule_type").isin(*SELF_DESCRIBING)
    parts = [
        path, kids, kind("inclusions", "INCLUSION"), kind("synonyms", "SYNONYM"), kind("abbreviations", "ABBREVIATION"),
        _listed(entries.where("target_key is not null"), "target_key", F.col("lead_term"), "index_terms", "lead_term"), _listed(above, "node", F.col("term"), "inherited", "_up", "term"),
        own_rules("notes", described), own_rules("instructions", ~described & (F.col("rule_type") != "EXCLUDE")), own_rules("exclusions", F.col("rule_type") == "EXCLUDE"),
    ]
    description = F.col("description") if "description" in nodes.columns else F.lit(None).cast("string")
    joined = nodes.select(F.col("key").alias("node_key"), "code", "level", "title", "selectable", description.alias("description"), F.trim(F.concat_ws(" ", "code", "title")).alias("_label"))
    for part in parts:
        joined = joined.join(part, "node_key", "left")
    some = lambda name, head, sep="; ": F.when(F.size(name) > 0, F.concat(F.lit(head), F.array_join(F.array_distinct(name), sep)))
    described_by = [F.col("_label"), F.col("description"), some("path", "Hierarchy: ", " > "), some("inclusions", "Includes: "), some("synonyms", "Synonyms: ")]
    described_by += [some("abbreviations", "Abbreviations: "), some("index_terms", "Index terms: "), some("inherited", "Parent terms: "), some("notes", "Notes: ", " | ")]
    kid_labels = F.transform(F.slice("kids", 1, MAX_CHILDREN), lambda k: k["label"])
    rest = [some("instructions", "Instructions: ", " | "), F.when(F.size("kids") > 0, F.concat(F.lit("Subdivisions: "), F.array_join(kid_labels, "; "))), some("exclusions", "Excludes: ", "\nExcludes: "), F.lit(f"Dataset: {dataset}")]
    empty = F.array().cast("array<string>")
    words = lambda *names: F.concat_ws(" ", *(F.array_join(F.coalesce(n, empty), " ") for n in names))
    kid_titles = F.array_join(F.transform(F.coalesce("kids", F.array().cast("array<struct<label:string,title:string>>")), lambda k: k["title"]), " ")
    out = joined.select(
        "node_key", "code", "level", "selectable", F.concat_ws("\n", *described_by, *rest).alias("content"), F.concat_ws("\n", *described_by).alias("semantic_text"),
        F.concat_ws(" ", "code", codes.normalize_code(F.col("code"), F.col("level")), "title", words("synonyms", "abbreviations", "index_terms")).alias("part_a"),
        F.concat_ws(" ", words("inclusions", "inherited"), described_by[1]).alias("part_b"), F.concat_ws(" ", F.array_join(F.coalesce("path", empty), " > "), words("notes"), kid_titles).alias("part_c"),
        text.ts_config(F.lit(language)).alias("config"),
    )
    return out.withColumn("content_hash", text.content_hash(F.col("content")))


def identity(space: Space, content: Column) -> Column:
    """Hash of what a vector was made from: the space and the text."""
    return text.content_hash(F.lit(space.key), content)


def embed_changed(docs: DataFrame, stored: DataFrame | None, space: Space = HASHING) -> DataFrame:
    """Vectors of the documents whose identity is not stored; empty texts are left out."""
    if space.provider != "hashing":
        raise ValueError("only the hashing provider works without a model")
    rows = docs.where(F.trim("semantic_text") != "").select("node_key", "semantic_text", identity(space, F.col("semantic_text")).alias("identity_hash"))
    if stored is not None:
        rows = rows.join(stored.select("node_key", "identity_hash"), ["node_key", "identity_hash"], "left_anti")
    vector = vectors.embed(space.dimension)("semantic_text")
    return rows.select("node_key", "identity_hash", vector.alias("embedding"), F.lit(space.provider).alias("provider"), F.lit(space.model).alias("model"), F.lit(space.dimension).alias("dimension"), F.lit(space.normalized).alias("normalized"))


def embed_stats(docs: DataFrame, stored: DataFrame | None, space: Space = HASHING) -> DataFrame:
    """What :func:`embed_changed` would do, in one row: documents, embedded, skipped_unchanged, skipped_empty; a null text is empty."""
    rows = docs.select("node_key", (F.trim(F.coalesce("semantic_text", F.lit(""))) == "").alias("_empty"), identity(space, F.col("semantic_text")).alias("identity_hash"))
    there = rows.withColumn("_there", F.lit(False))
    if stored is not None:
        known = stored.select("node_key", "identity_hash", F.lit(True).alias("_known")).distinct()
        there = rows.join(known, ["node_key", "identity_hash"], "left").withColumn("_there", F.coalesce("_known", F.lit(False)))
    empty, known = F.col("_empty"), F.col("_there")
    return there.agg(F.count(F.lit(1)).alias("documents"), F.count_if(~empty & ~known).alias("embedded"), F.count_if(~empty & known).alias("skipped_unchanged"), F.count_if(empty).alias("skipped_empty"))


def availability(embedded: DataFrame, docs: DataFrame, space: Space | None, required: bool = False) -> str:
    """Whether vectors may be used: ok, disabled, not_indexed or incomplete_index; where required, anything but ok is an error."""
    if space is None:
        state = "disabled"
    else:
        n, total = embedded.where(space.predicate()).select("node_key").distinct().count(), docs.count()
        state = "ok" if n == total and n else "incomplete_index" if n else "not_indexed"
    if required and state != "ok":
        raise RuntimeError(f"vectors are required but {state}")
    return state
