"""Names by their shortest unique beginnings: one row a name, found by a search in sorted order.

Of sorted names, all that begin alike are neighbours. So a beginning is one name's alone if it is longer than what the name
has in common with the one before it and the one after it. And of all names that begin with a text the first is the first
name at or after that text. Both are found in ranges of the order, cut at sampled names, with the edges of the ranges beside
them: no range has more than its part, and no row is made for each beginning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES, SAMPLED = 256, 8192


def text_cuts(texts: DataFrame, name: str, ranges: int = RANGES) -> list[str]:
    """At most ranges - 1 texts that cut the distinct texts into parts of about equal size, from the SAMPLED with the smallest hashes."""
    held = texts.select(F.col(name).alias("_t")).where("_t is not null").distinct().orderBy(F.xxhash64("_t")).limit(SAMPLED).collect()
    ordered = sorted({r["_t"] for r in held}, key=lambda t: t.encode())  # as Spark compares texts
    return sorted({ordered[k * len(ordered) // ranges] for k in range(1, ranges)}, key=lambda t: t.encode()) if ordered else []


def range_of(text: Column, cuts: list[str]) -> Column:
    """How many of the cuts are at or under the text, by halving the list."""
    if not cuts:
        return F.lit(0)
    held, steps = F.array(*map(F.lit, cuts)), F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(held, at + step - 1) <= text), at + step).otherwise(at))


def in_common(a: Column, b: Column) -> Column:
    """The length of two different texts' common beginning; 0 where one is null."""
    chars = lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(t, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    first = F.array_position(F.zip_with(chars(a), chars(b), lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.coalesce(F.when(first > 0, first - 1).otherwise(F.least(F.length(a), F.length(b))), F.lit(0)).cast("int")


def edges(sorted_names: DataFrame, name: str) -> DataFrame:
    """(_range, _low, _high, _earlier, _later): each range's first and last name, and the ones before and after it; a row a range."""
    ends = sorted_names.groupBy("_range").agg(F.min(name).alias("_low"), F.max(name).alias("_high"))
    w = Window.orderBy("_range")  # over a row for each range
    return ends.select("_range", "_low", "_high", F.lag("_high").over(w).alias("_earlier"), F.lead("_low").over(w).alias("_later"))


def beginnings(names: DataFrame, name: str, cuts: list[str] | None = None) -> DataFrame:
    """(name, unique_from): from how many characters on a beginning of a distinct name is its alone; more than it has where it begins another."""
    cuts = text_cuts(names, name) if cuts is None else cuts
    own = names.select(name).where(F.col(name).isNotNull()).distinct().withColumn("_range", range_of(F.col(name), cuts))
    w = Window.partitionBy("_range").orderBy(name)
    near = own.withColumn("_before", F.lag(name).over(w)).withColumn("_after", F.lead(name).over(w)).join(F.broadcast(edges(own, name).select("_range", "_earlier", "_later")), "_range")
    least = F.greatest(in_common(F.col(name), F.coalesce("_before", "_earlier")), in_common(F.col(name), F.coalesce("_after", "_later"))) + 1
    return near.select(name, least.alias("unique_from"))


def first_at_or_after(texts: DataFrame, text: str, names: DataFrame, name: str, cuts: list[str]) -> DataFrame:
    """(text, name) for distinct texts: the first of the distinct names at or after each, in sorted order; null if there is none."""
    own = names.select(F.col(name).alias("_t"), F.lit(1).alias("_side")).where("_t is not null").distinct()
    asked = texts.select(F.col(text).alias("_t"), F.lit(0).alias("_side")).where("_t is not null").distinct()
    both = own.unionByName(asked).withColumn("_range", range_of(F.col("_t"), cuts))
    w = Window.partitionBy("_range").orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)  # from the end on: a frame up to the end is computed anew for each row
    seen = both.withColumn("_next", F.last(F.when(F.col("_side") == 1, F.col("_t")), ignorenulls=True).over(w)).where("_side = 0")
    firsts = both.where("_side = 1").groupBy("_range").agg(F.min("_t").alias("_low"))
    later = both.select("_range").distinct().join(firsts, "_range", "left").select("_range", F.min("_low").over(Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)).alias("_later"))  # a row for each range
    met = seen.join(F.broadcast(later), "_range")
    return met.select(F.col("_t").alias(text), F.coalesce("_next", "_later").alias(name))


def resolved(texts: DataFrame, text: str, names: DataFrame, name: str, whole_first: bool = False, cuts: list[str] | None = None) -> DataFrame:
    """(text, name): distinct texts that begin exactly one row's name. whole_first: a text that is a name means that one, even if it begins others.

    Names that several rows have are no one's. Null and empty texts begin nothing. No side has to be small: the cuts are of
    both, as texts may lie where no name does.
    """
    cuts = text_cuts(names.select(F.col(name).alias("_t")).unionByName(texts.select(F.col(text).alias("_t"))), "_t") if cuts is None else cuts
    held = names.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_rows"))
    entries = held.join(beginnings(held, name, cuts), name)
    met = first_at_or_after(texts.where(F.col(text) != ""), text, held, name, cuts).join(entries, name)
    alone = F.startswith(F.col(name), F.col(text)) & (F.length(text) >= F.col("unique_from"))
    return met.where((F.col("_rows") == 1) & (alone | (F.col(text) == F.col(name)) if whole_first else alone)).select(text, name)
