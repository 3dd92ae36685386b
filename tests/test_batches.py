"""Comparators on Arrow batches of cases against the comparators for one case and those on columns."""

import random

from martwright.operators import batches, cases, compare
from martwright.queries import comparators
from pyspark.sql import functions as F
from test_cases import cells, some_results
from test_growth import plan

RESULT = f"array<array<{cases.CELL}>>"


def test_against_single_cases(spark, monkeypatch):
    monkeypatch.setattr(batches, "PAIRS", 7)
    rng, who = random.Random(2), compare.Entities([])
    plain = [(g, [p, p[::-1], [r[::-1] for r in p], g]) for g, p in some_results(rng, 900)]
    frame = spark.createDataFrame([(k, cells(who, g), *(cells(who, p) for p in ps)) for k, (g, ps) in enumerate(plain)], f"id int, g {RESULT}, " + ", ".join(f"p{k} {RESULT}" for k in range(4))).repartition(3)
    preds = [F.col(f"p{k}") for k in range(4)]
    seen = set()
    for r in frame.select("id", batches.strict(F.col("g"), preds).alias("s"), batches.relaxed(F.col("g"), preds).alias("r")).collect():
        g, ps = plain[r["id"]]
        assert r["s"] == [compare.strict(compare.Case(), g, p) for p in ps], (g, ps)
        assert r["r"] == [compare.relaxed(compare.Case(), g, p) for p in ps], (g, ps)
        seen |= {*zip(r["s"], r["r"], strict=True)}
    assert seen == {(True, True), (False, True), (False, False)}


def test_twins_nulls_and_numbers_that_are_none(spark):
    who = compare.Entities([])
    wide = [[float(i), float(j % 2), *[9.0] * 30, "z"] for j, i in enumerate(range(6))]
    gold, other = [[9.0, r[-1], 9.0, r[0], 9.0] for r in wide], [[9.0, "no", 9.0, r[0], 9.0] for r in wide]
    nan, inf = [[(float("nan"), None, None)]], [[(float("inf"), None, None)]]
    odd, hole = [[(1.0, None, None), None]], [[(1.0, None, None), (None, None, None)]]
    rows = [(cells(who, gold), cells(who, wide[::-1])), (cells(who, other), cells(who, wide)), (nan, nan), (inf, inf), (odd, hole), ([None], [None]), (None, []), ([], None), ([], []), ([[]], [[]])]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"id int, g {RESULT}, p {RESULT}").coalesce(1)
    g, p = F.col("g"), F.col("p")
    made = frame.select("id", batches.strict(g, [p])[0].alias("s"), batches.relaxed(g, [p])[0].alias("r"), cases.strict(g, p).alias("cs"), cases.relaxed(g, p).alias("cr")).orderBy("id").collect()
    same = [False, False, False, False, True, False, False, False, True, True]
    assert [x["s"] for x in made] == [x["cs"] for x in made] == same
    assert [x["r"] for x in made] == [x["cr"] for x in made] == [True, *same[1:]]


def test_one_long_result_is_compared_in_blocks(spark):
    rows = F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.array(cases.cell(txt=i.cast("string")), cases.cell(i * 2.0)))
    frame = spark.range(1).select(rows.alias("g"), F.reverse(rows).alias("p"), F.slice(rows, 1, 2999).alias("q"))
    assert frame.select(batches.strict(F.col("g"), [F.col("p"), F.col("q")]).alias("m")).first()[0] == [True, False]


def test_results_are_made_and_compared_once_an_order(spark, small):
    for query in (comparators.c02, comparators.c03, comparators.c06, comparators.c07):
        made = plan(query(spark, small))
        assert "array_except" not in made and "array_sort" not in made  # what was tried of each pair of results
        exploded = query(spark, small)._jdf.queryExecution().executedPlan().toString().split("Generate explode")[1].split("\n")[0]
        assert "pred" not in exploded and "rows#" not in exploded.split("], ")[-1]  # no result goes with each shape's row


def test_dropped_columns_are_those_named(spark):
    frame = spark.createDataFrame([(["k", "uom"], [[(None, "a", None), (None, "usd", None)], [(None, "b", None), (None, "usd", None)]], [[(None, "a", None)], [(None, "b", None)]])], f"c array<string>, g {RESULT}, p {RESULT}")
    assert frame.select(cases.without_context(F.col("c"), F.col("g"), F.array(F.lit("k")), F.col("p")).alias("m")).first()[0]
