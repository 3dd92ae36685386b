"""The analyst mart, built from the raw tables: entities, filings, long facts and priority-resolved concept views.

Everything is lazy DataFrames, so filters and columns of a query reach the scans; names() registers them as views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

MONEY = "decimal(18,2)"  # exact in any order of summation


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cik, ticker, name, gics_sector), one row for each customer."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("cik"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("gics_sector"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(adsh, cik, form, fiscal_year, fiscal_period, period_end_date, filed_date), one row for each order."""
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_orderkey").cast("string").alias("adsh"), F.col("o_custkey").alias("cik"), F.col("o_orderpriority").alias("form"),
        F.year("o_orderdate").alias("fiscal_year"), F.col("o_orderstatus").alias("fiscal_period"), day.alias("period_end_date"), day.alias("filed_date"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cik, adsh, tag, ddate, qtrs, uom, value): line items summed to their order, then four tags a row each.

    Sums are taken before the join, so what is shuffled to meet the orders is a row an order.
    """
    lines = table(spark, sf_dir, "lineitem")
    tags = {"Quantity": "l_quantity", "ExtendedPrice": "l_extendedprice", "Discount": "l_discount", "Tax": "l_tax"}
    sums = lines.groupBy("l_orderkey").agg(*(F.sum(F.col(c).cast(MONEY)).alias(t) for t, c in tags.items()))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("ddate"))
    wide = sums.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    cells = F.array(*(F.struct(F.lit(t).alias("tag"), F.col(t).cast("double").alias("value")) for t in tags))
    long = wide.select(F.col("o_custkey").alias("cik"), F.col("o_orderkey").cast("string").alias("adsh"), "ddate", F.inline(cells))
    return long.select("cik", "adsh", "tag", "ddate", F.lit(4).alias("qtrs"), F.lit("USD").alias("uom"), "value")


def by_priority(rows: DataFrame, keys: list[str], choice: str, priority: list[str], *order: Column) -> DataFrame:
    """Of rows that share keys the one whose choice comes first in priority; order settles the rest and must be total."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(choice))
    w = Window.partitionBy(*keys).orderBy(rank, *order)
    return rows.where(F.col(choice).isin(priority)).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


REVENUE = ["A", "N", "R"]  # return flags as revenue tags: the best that a filing has wins


def tagged_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by (cik, fiscal_year, ddate, source_tag): the several tags under which one concept is reported."""
    lines = table(spark, sf_dir, "lineitem")
    per_order = lines.groupBy("l_orderkey", "l_returnflag").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).alias("value"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    keys = [F.col("o_custkey").alias("cik"), F.year("o_orderdate").alias("fiscal_year"), F.col("o_orderdate").cast("date").alias("ddate"), F.col("l_returnflag").alias("source_tag")]
    return rows.groupBy(*keys).agg(F.sum("value").alias("value"))


def concept(spark: SparkSession, sf_dir: str, priority: list[str] = REVENUE) -> DataFrame:
    """(cik, fiscal_year, ddate, source_tag, value): one row by tag priority, falling back where the better tag is absent."""
    return by_priority(tagged_revenue(spark, sf_dir), ["cik", "fiscal_year", "ddate"], "source_tag", priority, F.desc("value"))


MEASURES = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}


def wide(spark: SparkSession, sf_dir: str, period: Column) -> DataFrame:
    """A row for each (cik, fy, fp) with fourteen metrics: four sums for each of the three tags, which are flows, and the
    last order's total and key, which are instants. period: of an order, such as its quarter.

    Line items are summed to their order and tag, and orders to the period, before they meet. What is moved are the line items
    themselves and a row an order, which goes to its company's year: half-made sums would be wider and hardly fewer.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", *MEASURES.values()).repartition("l_orderkey")
    sums = lines.groupBy("l_orderkey").agg(*(F.sum(F.when(F.col("l_returnflag") == f, F.col(c).cast(MONEY))).alias(f"{m}_{f}") for f in REVENUE for m, c in MEASURES.items()))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cik"), F.year("o_orderdate").alias("fy"), period.alias("fp"), "o_orderdate", F.col("o_totalprice").cast(MONEY).alias("v"))
    both = o.join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey").repartition("cik", "fy")
    place = F.struct("o_orderdate", "o_orderkey")
    flows = [F.sum(f"{m}_{f}").alias(f"{m}_{f}") for f in REVENUE for m in MEASURES]
    return both.groupBy("cik", "fy", "fp").agg(*flows, F.max_by("v", place).alias("last_total"), F.max_by(F.col("o_orderkey").cast(MONEY), place).alias("last_key"))


def with_q4(annual: DataFrame, quarters: DataFrame, flows: list[str], instants: list[str]) -> DataFrame:
    """quarters, and a derived Q4 for each year: flows are the year's less the three quarters', where all are known;
    instants are the year's own. is_derived tells them apart."""
    three = quarters.groupBy("cik", "fy").agg(*(F.when(F.count(c) == 3, F.sum(c)).alias(f"_{c}") for c in flows))
    own = annual.join(three, ["cik", "fy"], "left").select("cik", "fy", F.lit("Q4").alias("fp"), *((F.col(c) - F.col(f"_{c}")).alias(c) for c in flows), *instants, F.lit(True).alias("is_derived"))
    return quarters.select("cik", "fy", "fp", *flows, *instants, F.lit(False).alias("is_derived")).unionByName(own)


def derived_q4(quarters: DataFrame, flows: list[str], instants: list[str]) -> DataFrame:
    """with_q4() where all four quarters are known: the year is made of them, so the rows are aggregated once.

    A year's flows are the sums of its quarters, its instants those of its last one. The four rows of a year, at most, meet in
    one and leave as the first three and the derived fourth.
    """
    early = F.col("fp") != "Q4"
    row = lambda fp, f, i, derived: F.struct(fp.alias("fp"), *(f(c).alias(c) for c in flows), *(i(c).alias(c) for c in instants), F.lit(derived).alias("is_derived"))
    three = lambda c: F.when(F.count(F.when(early, F.col(c))) == 3, F.sum(F.when(early, F.col(c))))
    kind = dict(quarters.dtypes)
    fourth = row(F.lit("Q4"), lambda c: (F.sum(c) - three(c)).cast(kind[c]), lambda c: F.max_by(c, "fp"), True)
    own = F.collect_list(F.when(early, row(F.col("fp"), F.col, F.col, False)))
    years = quarters.groupBy("cik", "fy").agg(own.alias("_own"), fourth.alias("_q4"))
    return years.select("cik", "fy", F.inline(F.concat("_own", F.array("_q4"))))


def keep_first(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The first row of each key in the order of an explicit ordinal column."""
    w = Window.partitionBy(key).orderBy(ordinal)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The mart's relations under the names that guarded SQL may use."""
    made = {"companies": companies(spark, sf_dir), "filings": filings(spark, sf_dir), "financial_facts": facts(spark, sf_dir)}
    c = made["companies"].select("cik", "ticker", "name")
    made["v_revenue"] = concept(spark, sf_dir).join(c, "cik").select("cik", "ticker", "name", "fiscal_year", F.col("ddate").alias("period_end_date"), F.col("value").cast("double").alias("value"), "source_tag")
    return made


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    """Registers the mart's views in the session; their names."""
    made = views(spark, sf_dir)
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return list(made)
