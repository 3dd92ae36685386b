"""What a step costs as its tables grow, as far as a small table or a plan shows it."""

from martwright.operators import cases, prefixes
from martwright.queries import evaluation, surface
from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_names_after_a_text_are_looked_up_in_one_pass(spark):
    names = spark.createDataFrame([("b",), ("d",)], "name string")
    texts = spark.createDataFrame([("a",), ("b",), ("c",), ("e",)], "said string")
    found = prefixes.first_at_or_after(texts, "said", names, "name", ["c"])
    assert {r.said: r.name for r in found.collect()} == {"a": "b", "b": "b", "c": "d", "e": None}
    assert "currentrow$(), unboundedfollowing$()" not in plan(found)  # computed anew for each row


def test_cuts_are_of_distinct_texts(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "SAMPLED", 64)
    own = spark.range(500).select(F.format_string("n%03d", "id").alias("name"))
    often = own.orderBy(F.xxhash64("name")).limit(1).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(200)))).select("name")
    assert len(prefixes.text_cuts(own.unionByName(often), "name", 16)) == 15


def test_results_to_compare_are_sorted_once(spark):
    kinds = "array<array<" + cases.CELL + ">>"
    frame = spark.createDataFrame([(1, [[(1.0, None, None)], [(2.0, None, None)]], [[(1.0, None, None)]] * 2)], f"k int, a {kinds}, b {kinds}").repartition(2)
    inf = F.array(F.array(cases.cell(F.lit(float("inf")))))
    made = frame.select(cases.float_equal(F.col("a"), F.col("b")).alias("m"), cases.float_equal(F.col("b"), F.reverse("b")).alias("n"), cases.strict(inf, inf).alias("s"))
    assert plan(made.select("m")).count("sort_array(") + plan(made.select("m")).count("array_sort(") == 2
    assert tuple(made.first()) == (False, True, False)  # the last: an infinite number isn't close to itself


def test_results_are_voted_on_where_their_lines_are(spark, small):
    made = evaluation.v01_vote(spark, small)
    assert plan(made).count("join") == 0 and made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_wide_rows_move_once(spark, small):
    for made in (surface.wide1(spark, small), surface.wide2(spark, small)):
        text = made._jdf.queryExecution().executedPlan().toString()  # small orders are broadcast: line items and a row an order move
        assert text.count("Exchange hashpartitioning") == text.count("REPARTITION_BY_COL") == 2


def test_texts_of_a_small_file_are_read_by_many_tasks(spark, small):
    assert "REPARTITION_BY_NUM" in evaluation.xs05(spark, small)._jdf.queryExecution().executedPlan().toString()


def test_answers_without_a_company_are_not_one_task_s(spark, small):
    made = surface.g04_tiers(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "_lot" in made and "_place" in made
