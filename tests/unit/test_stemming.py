import pytest

from marlstone.functions import text
from marlstone.functions.stemming import english
from marlstone.operators import retrieval

# words and stems as the published description of the algorithm lists them
KNOWN = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist", "consistent": "consist", "consistently": "consist",
    "consolation": "consol", "consolations": "consol", "consolatory": "consolatori", "console": "consol", "consoled": "consol", "consolidate": "consolid", "consolidated": "consolid", "consolingly": "consol", "consols": "consol",
    "conspicuous": "conspicu", "conspicuously": "conspicu", "conspiracy": "conspiraci", "conspirator": "conspir", "knack": "knack", "knackeries": "knackeri", "knavish": "knavish", "kneaded": "knead", "knees": "knee", "knell": "knell",
    "knelt": "knelt", "knightly": "knight", "knocked": "knock", "knots": "knot", "happy": "happi", "cries": "cri", "ties": "tie", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "hopping": "hop", "hoping": "hope", "hoped": "hope",
    "luxuriated": "luxuri", "generate": "generat", "generously": "generous", "communism": "communism", "skies": "sky", "dying": "die", "news": "news", "proceed": "proceed", "fractures": "fractur", "fracture": "fractur",
    "infections": "infect", "infection": "infect", "relational": "relat", "conditional": "condit", "agreed": "agre", "feed": "feed", "controlling": "control", "roll": "roll", "say": "say", "cry": "cri", "by": "by",
}


@pytest.mark.parametrize("word", KNOWN)
def test_known_stems(word):
    assert english(word) == KNOWN[word]


def test_lexemes_of_columns(spark):
    row = spark.createDataFrame([("The Fractures of both knees, not THE", None)], "a string, b string").select(text.lexemes(text.F.col("a"), "english"), text.lexemes(text.F.col("a")), text.lexemes(text.F.col("b"), "english")).first()
    assert row[0] == ["fractur", "knee"] and row[1] == ["the", "fractures", "of", "both", "knees", "not", "the"] and row[2] is None


def test_an_inflected_word_finds_its_base(spark):
    nodes = spark.createDataFrame([(1, "Fracture of the knee"), (2, "Burn of hand")], "node_id long, title string")
    asked = spark.createDataFrame([(7, "knees fractured")], "query_id long, query string")
    found = {c: [tuple(r)[:2] for r in retrieval.lexical(asked, retrieval.postings(nodes, [("title", "A")], config=c), config=c).collect()] for c in ("simple", "english")}
    assert found == {"simple": [], "english": [(7, 1)]}


def test_the_pool_is_scored_as_all_pairs_are(spark):
    nodes = spark.createDataFrame([(i, f"w{i % 3} shared x{i % 5} tail") for i in range(20)], "node_id long, title string")
    asked = spark.createDataFrame([(100 + i, f"w{i % 3} shard x{i} tail") for i in range(6)], "query_id long, query string")
    pool = asked.select("query_id").crossJoin(nodes.select("node_id")).where("(query_id + node_id) % 3 = 0")
    index = retrieval.postings(nodes, [("title", "A")])
    terms = nodes.selectExpr("node_id", "title AS term")
    none = terms.limit(0).selectExpr("node_id AS target_node_id", "term")
    for whole, some in (
        (retrieval.lexical(asked, index, None), retrieval.lexical(asked, index, pool=pool)),
        (retrieval.trigram(asked, nodes, None, 0.0, words=True), retrieval.trigram(asked, nodes, threshold=0.0, words=True, pool=pool)),
        (retrieval.source_terms(asked, terms, none, None, 0.0), retrieval.source_terms(asked, terms, none, threshold=0.0, pool=pool)),
    ):
        want = {tuple(r) for r in whole.join(pool, ["query_id", "node_id"], "left_semi").collect()}
        assert want and {tuple(r) for r in some.collect()} == want


def test_evidence_is_deduplicated_and_cut(spark):
    rows = spark.createDataFrame([(1, "term", f"t{i % 7}", float(i)) for i in range(14)] + [(2, "title", "x", 1.0)], "id long, type string, text string, score double")
    found = {r["id"]: [(e["text"], e["score"]) for e in r["evidence"]] for r in retrieval.evidence(rows, ["id"]).collect()}
    assert found == {1: [("t6", 13.0), ("t5", 12.0), ("t4", 11.0), ("t3", 10.0), ("t2", 9.0)], 2: [("x", 1.0)]}
