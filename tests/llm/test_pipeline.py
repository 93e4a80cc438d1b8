"""The stages against brute force, on the smallest tables and on odd rows."""

import public_tokenizers
from tests.llm.test_near_copies import expected as joined
from tests.llm.test_substring_dedup import expected as cut

import corpus_pipeline
from gaugework.llm import packing, quality_rules
from gaugework.llm.ngram_join import JaccardJoin


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    model = quality_rules.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    judged = quality_rules.quality_rules(docs, model).select("doc_id", "quality.kept").collect()
    kept = stage["quality_rules"](spark, docs, sf)
    assert kept.columns == columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in judged if r["kept"]}

    rows = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    apart = stage["ngram_jaccard_join"](spark, kept, sf)
    assert apart.columns == columns
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(r[0] for r in joined(rows, JaccardJoin()) if r[0] == r[2])

    rows = [tuple(r) for r in apart.select("doc_id", "text").collect()]
    short = stage["substring_dedup"](spark, apart, sf)
    assert short.columns == columns
    got = {r["doc_id"]: r for r in short.collect()}
    for doc_id, _, _, left in cut(rows, 50):
        assert got[doc_id]["text"].encode().split() == left.encode().split() and got[doc_id]["n_chars"] == len(got[doc_id]["text"])

    clean = stage["secret_scan"](spark, short, sf)
    assert clean.columns == columns and clean.count() == len(got)
    from tests.llm.test_filters import base_spans

    assert not any(base_spans(r["text"]) for r in clean.collect())
    assert all(r["text"] == got[r["doc_id"]]["text"] for r in clean.collect() if not base_spans(got[r["doc_id"]]["text"]))

    packed = stage["best_fit_packing"](spark, clean, sf).collect()
    ids = packing.TokenIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in packed) == sum(len(ids.of(r["text"])) // 4 + 1 for r in clean.collect())
    assert len(corpus_pipeline.run(spark, sf).collect()) == len(packed)


def test_stages_of_odd_rows(spark, sf, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, docs, sf)
            assert left.columns == docs.columns and left.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()
    rows = corpus_pipeline.drop_near_copies(spark, odd, sf).select("doc_id", "text").collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == [1, 10, 3, 4, 5, 6, 8, 9, None, None]
    same = spark.createDataFrame([(1, "x y", None), (1, "x y", None)], "doc_id long, text string, n_chars long")
    assert corpus_pipeline.drop_near_copies(spark, same, sf).count() == 1
