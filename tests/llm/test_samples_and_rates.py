"""Samples that hot ids can't take over, mixtures with any rate, and the mixture's order in the pipeline."""

import math
from collections import Counter

import corpus_pipeline
from martwright.llm import mixing, toxicity
from pyspark.sql import functions as F


def test_toxicity_sample_is_balanced(spark, monkeypatch):
    rows = [(1, "again and again")] * 60 + [(1, f"other text {k}") for k in range(60)] + [(k, f"clean {k}") for k in range(10, 30)] + [(k, f"foul {k}") for k in range(40, 60)]
    marks = [(1, 0), (1, 0), *((k, 0) for k in range(10, 30)), *((k, 1) for k in range(40, 60)), (59, 0), (99, 1)]
    seen = []
    monkeypatch.setattr(toxicity, "learnt", lambda held, train: seen.extend(held.collect()))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, sample=20) is None
    assert Counter(r.toxic for r in seen) == {0: 10, 1: 10} and len({r.text for r in seen}) == 20
    seen.clear()
    toxicity.fit(docs, labels, sample=1000)
    assert Counter(r.toxic for r in seen) == {0: 81, 1: 20}  # an id with both labels is toxic; rows that repeat count once


def test_any_rate_is_counted(spark):
    docs = spark.createDataFrame([(k, "x" * 1000, "big") for k in range(300)] + [(999, "ab", "tiny")], "doc_id long, text string, source string")
    counts, most, _, times, _ = mixing.counted(docs, total=2 * 10**13)
    got = {r.doc_id: r[times] for r in counts.select("doc_id", times).collect()}
    assert most == 5e12 and abs(got[999] - 5e12) < 6 * math.sqrt(5e12)
    assert all(abs(n - 1e13 / 300_000) < 6 * math.sqrt(1e13 / 300_000) for k, n in got.items() if k != 999)


def test_a_million_copies_are_made_by_many_tasks(spark):
    docs = spark.createDataFrame([(k, "x" * 1000, "big", "own") for k in range(100)] + [(999, "ab", "tiny", "own")], "doc_id long, text string, source string, chunk string")
    made = mixing.mix(docs, {"tiny": 20.0, "big": 1.0}, total=2_100_000, parts=4)
    tiny = made.where("doc_id = 999").agg(F.count("*"), F.countDistinct("copy"), F.min("copy"), F.max("copy"), F.countDistinct("mix_key")).first()
    n = tiny[0]
    assert abs(n - 10**6) < 6000 and tuple(tiny) == (n, n, 0, n - 1, n) and made.columns == ["doc_id", "text", "source", "chunk", "copy", "mix_key"]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 3 and "RepartitionByExpression" in plan


def test_quantiles(spark):
    def below(k: int, mean: float) -> float:
        return sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(k + 1))

    us = [1e-6, 0.01, 0.3, 0.5, 0.7, 0.99, 1 - 1e-6]
    rows = spark.createDataFrame([(u, m) for u in us for m in (501.0, 2000.0, 50_000.0)], "u double, m double")
    for r in rows.select("u", "m", mixing.drawn(F.col("u"), F.col("m"), F.lit(None).cast("array<double>")).alias("k")).collect():
        assert below(r.k - 2, r.m) <= r.u < below(r.k + 1, r.m)


def test_the_mixture_keeps_its_order(spark, tmp_path):
    rows = [(k, f"text of document {k} " * 3, "en", "few" if k % 25 == 0 else "many", 50) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    mixed.write.parquet(str(tmp_path / "mixed"))
    held = spark.read.parquet(str(tmp_path / "mixed"))

    def neighbours(df):
        return sum(a == b for part in df.select("doc_id", F.spark_partition_id()).groupBy(F.col("SPARK_PARTITION_ID()")).agg(F.collect_list("doc_id")).collect() for a, b in zip(part[1], part[1][1:], strict=False))

    out = corpus_pipeline.tokens(spark, held, "")
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in held.collect())
    assert neighbours(out) <= neighbours(held)
    cut = {}
    for r in out.collect():
        cut.setdefault(r.doc_id, set()).add(tuple(r.ids))
    assert sum(len(c) > 1 for k, c in cut.items() if k % 25 == 0) >= 10  # each copy in its own way


def test_the_plan_does_not_repeat_what_is_drawn(spark):
    rows = [(k, "x" * 1000, "big") for k in range(100)] + [(999, "ab", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for total in (None, 2_100_000):  # means in the table, and far over it
        plan = mixing.mix(docs, total=total)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("md5(") <= 6 and len(plan) < 60_000
