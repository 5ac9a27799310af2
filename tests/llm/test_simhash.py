import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import queries, simhash
from marlstone.llm.batches import lower_words

MASK = (1 << 64) - 1


def slow_fingerprint(text):
    words = lower_words(text)
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(a, b):
    return (a ^ b).bit_count() <= 3


def shingle_set(text):
    words = lower_words(text)
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar_sets(a, b):
    """Of sets of shingles: a Jaccard similarity of 0.8 or more; sets without words are alike."""
    return len(a & b) >= 0.8 * len(a | b)


def brute_components(members, near=near):
    """members: (id, fingerprint) -> smallest id of each one's component."""
    parent = list(range(len(members)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(members):
        for j in range(i):
            if near(a, members[j][1]):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(members):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [least.get(find(i)) for i in range(len(members))]


@given(st.one_of(st.none(), st.text("aB \n\té", max_size=50)))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(lower_words(text)) == slow_fingerprint(text)


@given(st.integers(0, MASK), st.lists(st.integers(0, 63), max_size=3))
@settings(max_examples=300, deadline=None)
def test_linked_fingerprints_share_an_anchor(fp, flips):
    other = fp
    for bit in set(flips):
        other ^= 1 << bit
    anchor, at = simhash.anchors(np.array([fp, other], np.uint64))
    assert set(anchor[at == 0]) & set(anchor[at == 1])


def test_masks_lead_to_code_words():
    def syndrome(word):
        s = 0
        for i in range(1, 32):
            s ^= i * (word >> (i - 1) & 1)
        return s

    rng = np.random.default_rng(1)
    for word in rng.integers(0, 1 << 31, 50).tolist():
        anchor, _ = simhash.anchors(np.array([word], np.uint64))
        own = [a for a in anchor.tolist() if a < 1 << 31]
        assert len(own) == len(set(own)) == (1 if syndrome(word) == 0 else 16)
        assert all(syndrome(a) == 0 and (a ^ word).bit_count() <= 2 for a in own)


def fingerprint_table(spark, fps):
    rows = [(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in enumerate(fps)]
    return spark.createDataFrame(rows, "doc_id long, fp long")


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 6).tolist()
    out = []
    for i in range(n):
        fp = centres[i % 6]
        for bit in rng.integers(0, 64, int(rng.integers(0, 6))).tolist():
            fp ^= 1 << bit
        out.append(fp)
    return out


def check_groups(spark, fps):
    table = fingerprint_table(spark, fps)
    named = {r["fp"]: r["component_id"] for r in simhash.groups(table).collect()}
    assert [named[r["fp"]] for r in table.orderBy("doc_id").collect()] == brute_components(list(enumerate(fps)))


def test_groups_of_near_fingerprints(spark):
    check_groups(spark, clustered(400, 3) + [0, 1, 3, 7, 15, MASK, MASK ^ 1 << 63])


def test_hot_anchors_are_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    check_groups(spark, clustered(300, 4))


def test_long_chain(spark):
    check_groups(spark, [(1 << (3 * i)) - 1 for i in range(22)])


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in queries.documents(spark, sf_dir).collect()}
    rows = {r["doc_id"]: r for r in queries.op5(spark, sf_dir).collect()}
    members = [(k, slow_fingerprint(t)) for k, t in sorted(docs.items())]
    assert len(rows) == len(docs)
    for (key, fp), component in zip(members, brute_components(members), strict=True):
        assert (rows[key]["fingerprint"], rows[key]["component_id"]) == (f"{fp:016x}", component)


def test_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    members = [(r["doc_id"], slow_fingerprint(r["text"])) for r in odd.collect()]
    want = dict(zip((m[1] for m in members), brute_components(members), strict=True))
    texts = {" ".join((r["text"] or "").lower().split()) for r in odd.collect()}
    assert len(rows) == len(members) and all(r["component_id"] == want[r["fp"] & MASK] for r in rows)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(texts)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_equal_ids_with_other_texts(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (1, "epsilon zeta eta theta"), (2, "alpha beta gamma delta"), (None, "x y z w")], "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 3


@given(st.lists(st.sampled_from([b"a", b"b", b"cc"]), max_size=40))
@settings(max_examples=100, deadline=None)
def test_sketch(words):
    node, fp, wide, bands = simhash.sketch(words)
    assert fp == simhash.fingerprint(words, 5) and len(wide) == 128 and len(bands) == (10 if words else 0)
    assert simhash.sketch(list(words)) == (node, fp, wide, bands)
    if not words:
        assert node == fp == 0 and not any(wide)


def copies(n, seed):
    """Pairs of texts with some words changed, and the similarity of their sets of shingles."""
    rng = np.random.default_rng(seed)
    for _ in range(n):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 900)))]
        other = list(words)
        for at in rng.integers(0, len(words), max(1, int(len(words) * rng.uniform(0, 0.12)))).tolist():
            other[at] = "changed" + str(at)
        a, b = " ".join(words), " ".join(other)
        yield a, b, len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b))


def test_candidates_hold_the_similar_sets():
    found = []
    for a, b, share in copies(400, 5):
        (_, x, wide_x, bands_x), (_, y, wide_y, bands_y) = (simhash.sketch(lower_words(t)) for t in (a, b))
        apart = (int.from_bytes(wide_x) ^ int.from_bytes(wide_y)).bit_count()
        found.append((share, near(x, y) or bool(set(bands_x) & set(bands_y)) and apart <= simhash.WIDE_THRESHOLD))
        assert simhash.alike(*(np.unique(simhash.shingle_hashes(lower_words(t), 5)) for t in (a, b))) == (share >= 0.8)
        _, sure = simhash.judged(np.array([apart]), np.array([len(shingle_set(a))]), np.array([len(shingle_set(b))]))
        assert share >= 0.8 or not sure[0]
    close = [hit for s, hit in found if s >= 0.8]
    assert len(close) > 50 and sum(close) / len(close) >= 0.98
    assert not any(hit for s, hit in found if s < 0.65)


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(0, 5), st.booleans()).filter(lambda t: t[0] != t[1]), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_closest_spans_by_the_closest(rows):
    a, b, apart, sure = (np.array(c) for c in zip(*rows, strict=True))
    *kept, left = simhash.closest(a, b, apart, sure, np.full(len(a), 7))
    got = set(zip(*(c.tolist() for c in kept[:4]), strict=True))
    assert got <= set(rows) and len(got) <= 3 * 12

    def label(edges):
        return brute_components([(n, n) for n in range(13)], lambda x, y: (x, y) in edges or (y, x) in edges)

    trees = label({r[:2] for r in rows if r[3]})
    assert label({r[:2] for r in got if r[3]}) == trees
    for most in range(6):  # at each distance what is kept connects all that the links connect
        within = {r[:2] for r in rows if r[3]}
        assert label(within | {r[:2] for r in got if r[2] <= most}) == label(within | {r[:2] for r in rows if r[2] <= most})
    out = {r for r in rows if not r[3] and trees[r[0]] != trees[r[1]]} - got
    assert bool(out) <= bool(len(left))


def test_keep_one_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)  # bands of the large group are dealt in chunks
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    texts = []
    for i in range(40):
        words = list(base)
        words[i * 9] = "changed"
        texts.append(" ".join(words))
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 5000, 400)) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == {0, *range(40, 45)}


def test_keep_one_against_brute_force(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    members = [(r["doc_id"], shingle_set(r["text"])) for r in docs.orderBy("doc_id").collect()]
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == set(brute_components(members, similar_sets))


def test_links_among_many_closer_looking_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    texts = []
    for i in range(250):
        words = list(base)
        for at in rng.choice(400, 6, replace=False).tolist():
            words[at] = f"new{i}x{at}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set(brute_components([(i, shingle_set(t)) for i, t in enumerate(texts)], similar_sets))
    assert 20 < len(want) < 230
    got = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert got == want
    monkeypatch.setattr(simhash, "CHUNK", 64)
    monkeypatch.setattr(simhash, "GATHERED", 1000)
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == want


def test_short_near_copies(spark):
    texts = []
    for i in range(40):
        words = [f"s{i}w{j}" for j in range(19)]
        texts += [" ".join(words[:8]), " ".join(words[:9]), " ".join(words[10:18]), " ".join(words[9:18])]
    texts = [t for i, t in enumerate(texts) if i % 4 < 2] + [t.replace("s", "t") for i, t in enumerate(texts) if i % 4 > 1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members = [(i, shingle_set(t)) for i, t in enumerate(texts)]
    # a pair of 4 and 5 shingles at exactly 0.8 shares a band with 0.995
    assert len(set(brute_components(members, similar_sets))) == 80
    assert 80 <= simhash.keep_one(docs).count() <= 82
