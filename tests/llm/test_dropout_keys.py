"""Merge-dropout varies from document to document, and from copy to copy in the pipeline."""

import corpus_pipeline
from martwright.llm import pieces

TEXT = "considerable understanding of international organisations"


def test_each_document_is_cut_in_its_own_way(spark):
    df = spark.createDataFrame([(k, TEXT) for k in range(60)], "doc_id long, text string")
    cut = {tuple(r.ids) for r in pieces.encode(df, rate=0.3).collect()}
    assert len(cut) > 20
    assert all(r.lossless for r in pieces.round_trip(df, rate=0.3).collect())
    assert len({tuple(r.ids) for r in pieces.encode(df, rate=0.0).collect()}) == 1


def test_copies_of_the_mixture_are_cut_apart(spark):
    rows = [(7, TEXT * 3, "en", "s", 1)] * 12 + [(8, None, "en", "s", 0), (None, TEXT, "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    once, again = ([(r.doc_id, r["ids"]) for r in corpus_pipeline.tokens(spark, d, "").collect()] for d in (df, df.repartition(5)))
    assert len(once) == 14 and len({tuple(ids) for k, ids in once if k == 7}) == 12
    assert sorted(map(repr, once)) == sorted(map(repr, again))
