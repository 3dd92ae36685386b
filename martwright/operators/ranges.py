"""Global ranks and running sums without a single task: values are cut into ranges, and ranges are offset by their totals."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def cut_points(rows: DataFrame, by: str, ranges: int = RANGES) -> list[float]:
    """Approximate quantiles that cut the values into ranges; fewer where values repeat."""
    return sorted(set(rows.approxQuantile(by, [k / ranges for k in range(1, ranges)], 0.5 / ranges)))


def ranged_as(value: Column, cuts: list[float]) -> Column:
    """The number of cuts at or under the value; NULL comes after all."""
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= value)) if cuts else F.lit(0)
    return F.when(value.isNull(), len(cuts) + 1).otherwise(at).cast("int")


def ranged(rows: DataFrame, by: str, ranges: int = RANGES) -> DataFrame:
    """rows with _range: the number of cuts at or under the value; NULL comes after all. Cuts are approximate quantiles.

    Equal values always share a range, so one value that most rows have makes one large range.
    """
    return rows.withColumn("_range", ranged_as(F.col(by), cut_points(rows, by, ranges)))


def offsets(cut: DataFrame, total: Column) -> DataFrame:
    """(_range, _before): what all earlier ranges hold; a row for each range, so the window over them is small."""
    sums = cut.groupBy("_range").agg(total.alias("_total"))
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_range", F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_before"))


def row_numbers(rows: DataFrame, by: str, ties: list[str], name: str = "n") -> DataFrame:
    """rows with their place, from 1, in ascending order of by (NULLs last) and then ties, which must settle the order."""
    cut = ranged(rows, by)
    w = Window.partitionBy("_range").orderBy(F.asc_nulls_last(by), *ties)
    both = cut.withColumn("_own", F.row_number().over(w)).join(F.broadcast(offsets(cut, F.count("*"))), "_range")
    return both.withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def sums_before(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """rows with the sum of a value over all rows with a smaller by; by must be unique."""
    cut = ranged(rows, by)
    w = Window.partitionBy("_range").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    both = cut.withColumn("_own", F.coalesce(F.sum(value).over(w), F.lit(0))).join(F.broadcast(offsets(cut, F.sum(value))), "_range")
    return both.withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def median(rows: DataFrame, keys: list[str], value: str, name: str = "median", ranges: int = RANGES, few: int = 50_000) -> DataFrame:
    """(keys..., name): each group's exact median, a double, the mean of the middle two; NULL values don't count.

    Values are counted, and the counts summed by ranges of values. Of each group the range with the middle is kept (two, if it
    falls between them) and cut again, until no group has more than `few` distinct values left; only these are put in order in
    one place. NULL keys are a group; a group without a value has none. Per round a number comes to the driver.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    same = lambda left, right: reduce(and_, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)), F.lit(True))
    renamed = [f"_g{i}" for i in range(len(keys))]
    counts = rows.where(F.col(value).isNotNull()).groupBy(*(F.col(k).alias(n) for k, n in zip(keys, own, strict=True)), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    left = counts.withColumn("_before", F.lit(0).cast("long"))
    totals = counts.groupBy(*(F.col(a).alias(b) for a, b in zip(own, renamed, strict=True))).agg(F.sum("_n").alias("_all"))
    lower, upper = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    many = counts.groupBy(*own).agg(F.count("*").alias("_many")).agg(F.max("_many")).first()[0] or 0
    before = many + 1
    while few < many < before:  # not smaller: what is left can't be cut further
        before = many
        cut = ranged(left, "_v", ranges)
        sums = cut.groupBy(*own, "_range").agg(F.sum("_n").alias("_in"), F.count("*").alias("_values"), F.min("_before").alias("_base"))
        w = Window.partitionBy(*own).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
        placed = sums.withColumn("_first", F.col("_base") + F.coalesce(F.sum("_in").over(w), F.lit(0))).join(totals, same(own, renamed))
        kept = placed.where((F.col("_first") <= upper) & (F.col("_first") + F.col("_in") > lower))
        held = kept.select(*(F.col(a).alias(b) for a, b in zip(own, [f"_h{i}" for i in range(len(keys))], strict=True)), F.col("_range").alias("_kept"), F.min("_first").over(Window.partitionBy(*own)).alias("_from"), F.sum("_values").over(Window.partitionBy(*own)).alias("_many"))
        left = cut.join(held, same(own, [f"_h{i}" for i in range(len(keys))]) & (F.col("_range") == F.col("_kept"))).select(*own, "_v", "_n", F.col("_from").alias("_before"))
        many = held.agg(F.max("_many")).first()[0] or 0
    w = Window.partitionBy(*own).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    put = left.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_n").over(w), F.lit(0))).join(totals, same(own, renamed))
    has = lambda place: F.max(F.when((F.col("_at") <= place) & (F.col("_at") + F.col("_n") > place), F.col("_v")))
    return put.groupBy(*own).agg(((has(lower) + has(upper)) / 2).alias(name)).select(*(F.col(a).alias(b) for a, b in zip(own, keys, strict=True)), name)
