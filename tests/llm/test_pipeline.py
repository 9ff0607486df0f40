import brute
from samples import SCHEMA, as_rows, make_docs

import corpus_pipeline
from driftspan.llm import quality
from driftspan.llm import queries as Q


def test_stages_against_plain_versions(spark, tmp_path):
    pairs = make_docs(5, 80)
    docs, texts = spark.createDataFrame(as_rows(pairs), SCHEMA), dict(pairs)
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {}
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
        rows = list(before.items())
        if name == "quality":
            refs = quality.language_references(spark.createDataFrame(as_rows(pairs), SCHEMA))
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in quality.quality_verdicts(spark.createDataFrame(as_rows(pairs), SCHEMA), refs).where("kept").collect()}
            assert all(len(brute.words(texts[r["doc_id"]])) >= 50 for r in docs.collect())
        elif name == "near_duplicates":
            assert {r["doc_id"] for r in docs.collect()} == {c for _, c in brute.components(rows, 5, 80).values()}
        elif name == "substrings":
            expected = brute.repeats(rows, corpus_pipeline.WINDOW)
            assert {r["doc_id"]: brute.words(r["text"]) for r in docs.collect()} == {d: x[3] for d, x in expected.items()}
        else:
            assert {r["doc_id"] for r in docs.collect()} == set(before)
    assert 1 < len({r["doc_id"] for r in docs.collect()}) < len(pairs)


def test_empty_and_registry(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
    assert sorted(n.split("_")[0] for n in Q.queries()) == sorted(f"op{i}" for i in range(1, 11))
