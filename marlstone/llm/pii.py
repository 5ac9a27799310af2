"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from regular expressions: the four base kinds (email, ip, card, phone), whose
checked matches always stay, and two kinds that the method may add (``secret``: long hexadecimal
runs; ``contact``: written-out addresses and phone numbers without ``+``).  Five labelers vote on
each candidate for, against or not at all: format, checksum or structure, a gazetteer of endings,
prefixes and lengths, words in front, and what touches it.  The counts of equal votes, a bounded
table (kinds x 3^5 rows), go to the driver; expectation-maximisation estimates each labeler's
sensitivity and specificity there, and a logistic span classifier is fitted to its posteriors.
The weights go back as literals, so the second pass is one projection without shuffle or join.

Offsets are code points, end exclusive.  They come from the lengths of the matches and of the text
between them, summed in blocks, so that the work is near linear in the length of the text.

Defined cases: a null text counts as empty and has no spans; repeated rows are judged alike; with no
candidate at all the classifier adds nothing.  ``doc_id`` plays no part; only the columns asked for
are carried.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "contact")
LABELERS = ("format", "structure", "gazetteer", "context", "edges")
#: Rounds of expectation-maximisation, and of fitting the classifier.
EM_ROUNDS, FIT_ROUNDS = 40, 400
#: Added spans are kept from this probability on.
KEEP_FROM = 0.5
BLOCK = 64

# A match starts where its first run of characters starts, or where the last match ended; so a failing
# run is not tried again from each of its characters.  Possessive quantifiers keep Java from recursing.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?>\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?>[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,}+(?![A-Za-z0-9])",
    "contact": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+ (?:at|\(at\)|\[at\]) [A-Za-z0-9-]{1,64}+ (?:dot|\(dot\)|\[dot\]) [A-Za-z]{2,16}"
    r"|(?<!\+[0-9]{1,3}[\x20.-]?)(?<![0-9(+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: A text without this has no match; cheaper than the pattern.
_GATES = {"email": r"@", "phone": r"\+", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "secret": r"[0-9A-Fa-f]{32}", "contact": r"[0-9]{3}[\x20.-][0-9]{4}|dot[\])]? [A-Za-z]"}

_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_OCTETS = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"

# Gazetteers: fixed values.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")
CARD_PREFIXES = ("3", "4", "5", "6")
CALLING_CODES = ("1", "33", "34", "44", "49")
SECRET_LENGTHS = (32, 40, 56, 64, 96, 128, 256, 512, 1024)
WORDS_BEFORE = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "account"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "secret": ("token", "secret", "password", "passwd", "key", "auth", "bearer"),
    "contact": ("phone", "tel", "call", "mobile", "fax", "mail", "contact", "write"),
}
WORDS_AGAINST = {
    "secret": ("sha1", "sha256", "md5", "commit", "checksum", "digest", "hash"),
    "contact": ("isbn", "order", "invoice", "page"),
    "ip": ("version", "release", "section"),
    "card": ("isbn", "serial", "order"),
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once for each row."""
    return F.transform(F.array(value), use)[0]


def before(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array what ``combine`` makes of those before it, from 0, by blocks."""
    zero = F.lit(0)

    def blocks(v: Column) -> Column:
        n = F.size(v)
        sums = F.transform(F.sequence(zero, F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), zero, combine))
        return let(
            sums,
            lambda s: let(
                F.transform(s, lambda _, b: F.aggregate(F.slice(s, F.lit(1), b), zero, combine)),
                lambda heads: F.transform(v, lambda _, i: F.aggregate(F.slice(v, (i - F.pmod(i, F.lit(BLOCK))) + 1, F.pmod(i, F.lit(BLOCK))), heads[F.floor(i / BLOCK).cast("int")], combine)),
            ),
        )

    return let(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(F.array().cast("array<int>")))


_SPAN = "array<struct<kind:string,start:int,end:int,text:string>>"


def _found(text: Column, kind: str) -> Column:
    """Leftmost, non-overlapping matches of a kind's pattern, with their offsets."""
    pattern = PATTERNS[kind]
    none = F.array().cast(_SPAN)

    def place(hits: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)

        def starts(g: Column) -> Column:
            steps = F.zip_with(F.slice(g, F.lit(1), F.size(hits)), F.transform(hits, F.length), lambda a, b: a + b)
            at = let(before(steps, lambda a, b: a + b), lambda p: F.transform(p, lambda x, i: x + g[i]))
            return F.zip_with(hits, at, lambda h, s: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(h)).alias("end"), h.alias("text")))

        return let(gaps, starts)

    hits = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: F.when(F.size(h) > 0, place(h)).otherwise(none))
    return F.when(text.rlike(_GATES[kind]), hits).otherwise(none)


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _passes(kind: str, span: Column) -> Column:
    if kind == "ip":
        return span["text"].rlike(_OCTETS)
    if kind == "card":
        return let(_digits(span["text"]), lambda d: F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(span["text"])).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The checked base matches, by kind as listed and then by start."""
    def checked(kind: str) -> Column:
        return F.filter(_found(text, kind), lambda s: _passes(kind, s))

    return F.concat(*map(checked, BASE_KINDS))


def added_candidates(text: Column) -> Column:
    """Candidates of the kinds that the method may add."""
    return F.concat(*(_found(text, k) for k in ADDED_KINDS))


def _any_word(text: Column, words: Sequence[str]) -> Column:
    return text.rlike(r"(?:^|[^a-z])(?:" + "|".join(words) + r")(?:[^a-z]|$)") if words else F.lit(False)


def _by_kind(kind: Column, cases: dict[str, Column], other: Column) -> Column:
    chain = F
    for k, value in cases.items():
        chain = chain.when(kind == k, value)
    return chain.otherwise(other)


def votes(text: Column, span: Column) -> Column:
    """The labelers' votes on a candidate: a string with ``1``, ``0`` or ``-`` (none) for each."""
    kind, hit = span["kind"], span["text"]
    digits = _digits(hit)
    front = F.lower(F.substring(text, F.greatest(span["start"] - 24, F.lit(0)) + 1, F.least(span["start"], F.lit(24))))
    touching = F.concat(F.when(span["start"] > 0, F.substring(text, span["start"], F.lit(1))).otherwise(" "), F.substring(text, span["end"] + 1, F.lit(1)))
    vote = lambda c: F.when(c, F.lit("1")).otherwise(F.lit("0"))
    only = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit("-"))
    both = hit.rlike("[0-9]") & hit.rlike("[A-Fa-f]")
    form = _by_kind(kind, {"secret": vote(both), "contact": vote(~hit.rlike(r"(?:^|[^0-9])(?:000|[01][0-9]{2})[\x20.)-]"))}, F.lit("1"))
    structure = _by_kind(kind, {
        "email": vote(~hit.rlike(r"^[.]|[.]{2}|[.-]@|@-")), "ip": vote(~hit.rlike(r"(?:^|\.)0[0-9]|^0\.|^255\.")), "card": vote(F.length(digits) == 16),
        "phone": vote(F.length(digits).between(10, 13)), "secret": vote(hit.rlike("^[a-f0-9]+$|^[A-F0-9]+$")), "contact": vote(F.length(digits).isin(0, 10)),
    }, F.lit("-"))
    gazetteer = _by_kind(kind, {
        "email": vote(F.lower(F.regexp_extract(hit, r"\.([A-Za-z0-9-]+)$", 1)).isin(*ENDINGS)), "card": vote(F.substring(digits, 1, 1).isin(*CARD_PREFIXES)),
        "phone": vote(digits.rlike("^(?:" + "|".join(CALLING_CODES) + ")")), "secret": vote(F.length(hit).isin(*SECRET_LENGTHS)), "contact": only(F.lower(hit).rlike(r"[ \])](?:" + "|".join(ENDINGS) + ")$"), "1"),
    }, F.lit("-"))
    context = F.when(_by_kind(kind, {k: _any_word(front, w) for k, w in WORDS_AGAINST.items()}, F.lit(False)), F.lit("0")).otherwise(
        only(_by_kind(kind, {k: _any_word(front, w) for k, w in WORDS_BEFORE.items()}, F.lit(False)), "1")
    )
    edges = F.when(touching.rlike("[A-Za-z0-9_#/]"), F.lit("0")).otherwise(only(touching.rlike("[\"'=:<(\\[]"), "1"))
    return F.concat(form, structure, gazetteer, context, edges)


def estimate(counts: Sequence[tuple[str, str, int]], rounds: int = EM_ROUNDS) -> tuple[dict[tuple[str, str], float], list[tuple[float, float]]]:
    """Expectation-maximisation over (kind, votes, count): posterior of each pattern; sensitivity and specificity of each labeler.

    Kinds have their own shares, labelers one reliability over all kinds.  Starts from majority votes.
    """
    post = {}
    for kind, pattern, _ in counts:
        yes, no = pattern.count("1"), pattern.count("0")
        post[kind, pattern] = (yes + 1) / (yes + no + 2)
    reliability = [(0.8, 0.8)] * len(LABELERS)
    for _ in range(rounds if counts else 0):
        share: dict[str, list[float]] = {}
        right = [[[1.0, 2.0], [1.0, 2.0]] for _ in LABELERS]  # [for true, for false] -> [votes that agree, votes]
        for kind, pattern, n in counts:
            p = post[kind, pattern]
            s = share.setdefault(kind, [1.0, 2.0])
            s[0] += n * p
            s[1] += n
            for j, v in enumerate(pattern):
                if v != "-":
                    right[j][0][0] += n * p * (v == "1")
                    right[j][0][1] += n * p
                    right[j][1][0] += n * (1 - p) * (v == "0")
                    right[j][1][1] += n * (1 - p)
        # a labeler is taken to be better than chance; else the two classes could swap
        reliability = [tuple(min(0.99, max(0.51, a / b)) for a, b in r) for r in right]
        for kind, pattern, _ in counts:
            odds = math.log(share[kind][0] / share[kind][1]) - math.log1p(-share[kind][0] / share[kind][1])
            for (sens, spec), v in zip(reliability, pattern, strict=True):
                odds += {"1": math.log(sens / (1 - spec)), "0": math.log((1 - sens) / spec), "-": 0.0}[v]
            post[kind, pattern] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, reliability


def fit(counts: Sequence[tuple[str, str, int]], post: dict[tuple[str, str], float], rounds: int = FIT_ROUNDS) -> dict[str, float]:
    """Logistic weights of the features ``kind:k`` and ``labeler=vote``, fitted to the posteriors by gradient steps."""
    rows = [([f"kind:{k}", *(f"{name}={v}" for name, v in zip(LABELERS, p, strict=True))], post[k, p], math.log1p(n)) for k, p, n in counts]
    total = sum(w for *_, w in rows) or 1.0
    weights = {f: 0.0 for features, *_ in rows for f in features}
    for _ in range(rounds):
        step = dict.fromkeys(weights, 0.0)
        for features, target, w in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[f] for f in features)))))
            for f in features:
                step[f] += w * (target - p)
        for f in weights:
            weights[f] += 4.0 * step[f] / total - 1e-3 * weights[f]
    return weights


def probability(kind: Column, pattern: Column, weights: dict[str, float]) -> Column:
    """The classifier's probability for a candidate; an unseen feature has weight 0."""
    total = F.lit(0.0)
    for feature, w in weights.items():
        if feature.startswith("kind:"):
            total = total + F.when(kind == feature[5:], F.lit(w)).otherwise(F.lit(0.0))
        else:
            name, v = feature.split("=")
            total = total + F.when(F.substring(pattern, LABELERS.index(name) + 1, 1) == v, F.lit(w)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def vote_counts(documents: DataFrame, text: str = "text") -> list[tuple[str, str, int]]:
    """How many candidates of the whole table have which kind and votes; a bounded number of rows."""
    body = documents.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    spans = F.concat(base_spans(F.col("t")), added_candidates(F.col("t")))
    marks = let(spans, lambda s: F.transform(s, lambda x: F.struct(x["kind"].alias("kind"), votes(F.col("t"), x).alias("votes"))))
    # explode() would have the optimiser compute the array once more, for a filter on its size
    counted = body.select(F.explode_outer(marks).alias("m")).groupBy("m.kind", "m.votes").agg(F.count(F.lit(1)).alias("n"))
    return sorted((r["kind"], r["votes"], r["n"]) for r in counted.collect() if r["kind"])


def train(documents: DataFrame, text: str = "text") -> dict[str, float]:
    """The span classifier's weights, from all rows."""
    counts = vote_counts(documents, text)
    return fit(counts, estimate(counts)[0])


def find(documents: DataFrame, weights: dict[str, float], text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns with ``base`` and ``added``, arrays of spans (kind, start, end, text), for every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(*carry, body.alias("_body"))
    keep = lambda x: probability(x["kind"], votes(F.col("_body"), x), weights) >= KEEP_FROM
    added = F.filter(added_candidates(F.col("_body")), keep) if weights else F.array().cast(_SPAN)
    return rows.select(*carry, base_spans(F.col("_body")).alias("base"), added.alias("added"), F.col("_body").alias("body"))


def masked(body: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``[KIND]`` of its first span."""

    def write(s: Column) -> Column:
        def pieces(chars: Column) -> Column:
            def join(free: Column) -> Column:
                parts = F.zip_with(
                    s, free,
                    lambda x, f: F.when(x["start"] >= f, F.concat(F.array_join(F.slice(chars, f + 1, x["start"] - f), ""), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit("")),
                )
                last = F.array_max(F.transform(s, lambda x: x["end"]))
                return F.concat(F.array_join(parts, ""), F.array_join(F.slice(chars, last + 1, F.greatest(F.size(chars) - last, F.lit(0))), ""))

            return let(before(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), join)

        return let(F.split(body, ""), pieces)

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return let(ordered, lambda s: F.when(F.size(s) > 0, write(s)).otherwise(body))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
