import corpus_pipeline
from marlstone.llm import decontam, pieces, pii, queries

from .test_decontam import brute as leaks
from .test_pii import brute as spans
from .test_simhash import brute_components, shingle_set, similar_sets


def test_stages_against_brute_force(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    kept = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = {r["doc_id"]: r for r in out.collect()}
        assert len(rows) == out.count()
        if name == "language ID":
            assert set(rows) == {k for k, r in kept.items() if any(c.isalpha() for c in r["text"] or "")}
        elif name == "SimHash near-dedup":
            members = [(k, shingle_set(r["text"])) for k, r in sorted(kept.items())]
            assert set(rows) == set(brute_components(members, similar_sets))
        elif name == "benchmark decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            short = [(k, r["text"]) for k, r in kept.items() if len(r["text"]) < 3000]
            gone = {k for k, _ in leaks(short, items)}
            assert {k for k, _ in short} & set(rows) == {k for k, _ in short} - gone
        elif name == "PII":
            assert set(rows) == set(kept)
            for k, r in rows.items():
                assert r["n_chars"] == len(r["text"]) and (spans(kept[k]["text"]) or "[SECRET]" in r["text"] or "[CONTACT]" in r["text"] or r["text"] == kept[k]["text"])
                assert not [s for s in spans(r["text"]) if not s.startswith("card")]
        else:
            library = pieces.load(open(queries.piece_model(), "rb").read())
            for k, r in rows.items():
                assert r["ids"] == [1, *library.encode(kept[k]["text"]), 2] and r["decoded"] == library.decode(r["ids"])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        docs, kept = out, rows


def test_odd_rows(spark, odd, empty, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf_dir).count() >= 0
        assert stage(spark, empty, sf_dir).count() == 0
