"""Joins beyond plain equality: overlaps, prefixes, tolerance, containment, as-of. All keep an equality where one exists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prefixes
from .ranges import RANGES, cut_points, ranged_as


def overlaps(spans: DataFrame, key: str, node: str, start: str, end: str, ranges: int = RANGES) -> DataFrame:
    """(id_a, id_b, seconds): unordered pairs on one node that share some time, id_a < id_b.

    A sweep over starts, in ranges of time that hold about equally many of them: a pair is found where the later of its spans
    begins. A span is carried on from its own range into each later one that it reaches and in which its node has a start, so
    there are fewer carried rows than spans and pairs. In a range the partners of a span are the starts from its own to its
    end, a stretch of the sorted ones: work is linear but for the sort and the pairs themselves. A span of no length within
    another shares 0 seconds with it; spans that end before they start, or lack an end, are in no pair. Ids must be unique.
    """
    own = spans.select(F.col(key).alias("_id"), F.col(node).alias("_node"), F.col(start).cast("long").alias("_a"), F.col(end).cast("long").alias("_b")).where("_a <= _b and _node is not null and _id is not null")
    cuts = cut_points(own, "_a", ranges)
    cut, last = own.withColumn("_own", ranged_as(F.col("_a"), cuts)), ranged_as(F.col("_b"), cuts)
    there = cut.groupBy("_node").agg(F.array_sort(F.collect_set("_own")).alias("_ranges"))  # at most as many as there are ranges
    placed = cut.withColumn("_last", last).join(there, "_node")
    carried = placed.withColumn("_range", F.explode(F.filter("_ranges", lambda r: (r >= F.col("_own")) & (r <= F.col("_last")))))
    kind = spans.schema[key].dataType.simpleString()

    def sweep(group: pa.Table) -> pa.Table:
        a, b = group["_a"].to_numpy(), group["_b"].to_numpy()
        mine = group["_own"].to_numpy() == group["_range"].to_numpy()
        order = np.lexsort((b, a, mine))  # carried spans, then those that start here in order
        a, b, ids = a[order], b[order], group["_id"].combine_chunks().take(pa.array(order))
        first = int(np.count_nonzero(~mine))
        starts, lengths = a[first:], b[first:] - a[first:]
        begin = np.where(np.arange(len(a)) < first, 0, np.arange(len(a)) - first + 1)
        n = np.maximum(np.searchsorted(starts, b, "left") - begin, 0)
        x = np.repeat(np.arange(len(a)), n)
        y = first + np.arange(len(x)) - np.repeat(np.cumsum(n) - n - begin, n)
        held = (lengths[y - first] > 0) | (a[x] < a[y])
        x, y = x[held], y[held]
        left, right = ids.take(pa.array(x)), ids.take(pa.array(y))
        seconds = pa.array(np.minimum(b[x], b[y]) - a[y], pa.int64())
        swap = pc.less(right, left)
        return pa.table([pc.if_else(swap, right, left), pc.if_else(swap, left, right), seconds], ["id_a", "id_b", "seconds"])

    return carried.select("_id", "_node", "_a", "_b", "_own", "_range").groupBy("_node", "_range").applyInArrow(sweep, f"id_a {kind}, id_b {kind}, seconds long")


OPERANDS = 40  # of a result: its first distinct cells, which derived numbers are tried on


def derived(cells: DataFrame, claims: DataFrame, result: str, order: str, value: str, claim: str, tolerance: float) -> DataFrame:
    """(result, claim, form, a, b): claims that two cells of their result give, as a+b, a-b, a/b, 100a/b or 100(a-b)/b.

    Operands are the result's first OPERANDS distinct cells by order, so a result has a bounded number of pairs. a+b counts
    once, with the cell that comes first as a; the others are of ordered pairs.
    """
    once = cells.groupBy(result, F.col(value).alias("v")).agg(F.min(order).alias("k"))
    few = once.withColumn("n", F.row_number().over(Window.partitionBy(result).orderBy("k", "v"))).where(F.col("n") <= OPERANDS)
    pairs = few.select(result, F.col("n").alias("na"), F.col("v").alias("a")).join(few.select(result, F.col("n").alias("nb"), F.col("v").alias("b")), result).where("na <> nb")
    a, b = F.col("a"), F.col("b")
    forms = {"a+b": F.when(F.col("na") < F.col("nb"), a + b), "a-b": a - b, "a/b": F.try_divide(a, b), "100a/b": F.try_divide(100 * a, b), "100(a-b)/b": F.try_divide(100 * (a - b), b)}
    made = pairs.select(result, "a", "b", F.inline(F.array(*(F.struct(F.lit(n).alias("form"), x.alias("x")) for n, x in forms.items())))).where("x is not null")
    met = made.join(claims.select(result, F.col(claim).alias("claim")).distinct(), result)
    return met.where(F.abs(F.col("x") - F.col("claim")) <= tolerance).select(result, "claim", "form", "a", "b")


def unique_prefix(mentions: DataFrame, mention: str, names: DataFrame, name: str) -> DataFrame:
    """Mentions that begin exactly one name, with that row's columns. Found in the sorted names by their shortest unique beginnings."""
    found = prefixes.resolved(mentions, mention, names, name).withColumnRenamed(name, "_name")
    return mentions.distinct().join(found, mention).join(names, F.col("_name") == F.col(name)).drop("_name")

def tokens(name: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def word_classes(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, words): each row's class, its distinct words in order; rows without words are left out."""
    return rows.select(key, F.array_sort(tokens(F.col(name))).alias("words")).where(F.size("words") > 0)


def contained_classes(rows: DataFrame) -> DataFrame:
    """(small, large, pairs): classes of words whose words are all among another's, and how many pairs of different rows that makes.

    With the classes of the rows this stands for all pairs of rows, without a row for each. A class with several rows
    contains itself. Classes meet on the word of the smaller that the fewest classes have.
    """
    classes = rows.groupBy("words").agg(F.count("*").alias("n"))
    spread = classes.select("words", "n", F.explode("words").alias("word"))
    held = spread.groupBy("word").agg(F.count("*").alias("held"))
    rarest = spread.join(held, "word").groupBy(F.col("words").alias("small"), F.col("n").alias("n_small")).agg(F.min_by("word", F.struct("held", "word")).alias("word"))
    both = rarest.join(spread.select(F.col("words").alias("large"), F.col("n").alias("n_large"), "word"), "word").where(F.size(F.array_except("small", "large")) == 0)
    same = F.col("small") == F.col("large")
    pairs = F.when(same, F.col("n_small") * (F.col("n_small") - 1)).otherwise(F.col("n_small") * F.col("n_large"))
    return both.select("small", "large", pairs.alias("pairs")).where("pairs > 0")


def close(gold: Column, pred: Column, tolerance: float) -> Column:
    """Equal within a relative tolerance; both NULL is equal, one NULL is not."""
    near = F.abs(gold - pred) <= F.greatest(F.abs(gold) * tolerance, F.lit(1e-9))
    return F.when(gold.isNull() | pred.isNull(), gold.isNull() & pred.isNull()).otherwise(near)


def matched_within(gold: DataFrame, pred: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """gold's keys and value, and whether some row of pred with the same keys has its value within the tolerance."""
    both = gold.join(pred.select(*keys, F.col(value).alias("_pred"), F.lit(True).alias("_there")), keys, "left")
    hit = F.coalesce(F.col("_there") & close(F.col(value), F.col("_pred"), tolerance), F.lit(False))
    return both.groupBy(*keys, F.col(value).alias("gold")).agg(F.bool_or(hit).alias("matched"))


def sets_equal(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """(equal, unmatched): whether each row of either side has a partner on the other within the tolerance; repeats collapse."""
    both = matched_within(a, b, keys, value, tolerance).unionByName(matched_within(b, a, keys, value, tolerance))
    return both.agg((F.count_if(~F.col("matched")) == 0).alias("equal"), F.count_if(~F.col("matched")).alias("unmatched"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, left_id: str, right_id: str, days: int | None = None) -> DataFrame:
    """Each left row with the id of the latest right row of its key on or before it; rows without one are left out.

    Both sides become one sequence per key, in which the last right row seen is carried forward: one shuffle, no pairs.
    days: where single keys have too many rows for a task, sequences are cut into stretches of so many days, and each
    stretch begins with what the ones before it have last seen.
    """
    a = left.select(key, at, F.col(left_id), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[right_id].dataType).alias("_r"))
    b = right.select(key, at, F.lit(None).cast(left.schema[left_id].dataType).alias(left_id), F.lit(0).alias("_side"), F.col(right_id).alias("_r"))
    both, order = a.unionByName(b), (at, "_side", "_r", left_id)
    if not days:
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        seen = both.withColumn(right_id, F.last("_r", ignorenulls=True).over(w))
        return seen.where((F.col("_side") == 1) & F.col(right_id).isNotNull()).drop("_side", "_r")
    cut = both.withColumn("_stretch", F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / (86_400 * days)))
    w = Window.partitionBy(key, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = cut.withColumn("_own", F.last("_r", ignorenulls=True).over(w))
    last = cut.groupBy(key, "_stretch").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.struct(at, "_r"))).alias("_last"))
    earlier = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(key, "_stretch", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    met = seen.where("_side = 1").join(carried, [key, "_stretch"]).withColumn(right_id, F.coalesce("_own", "_before"))
    return met.where(F.col(right_id).isNotNull()).drop("_side", "_r", "_own", "_before", "_stretch")


def paired_cells(cells: Column) -> Column:
    """array<struct<label, value>> of a row's cells, an array of struct<label string, value double> with one of the two set.

    From left to right a value takes the label right before it, if no other value has; else the one right after it.
    """
    at = F.sequence(F.lit(1), F.size(cells))
    begin = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<label:string,value:double>>").alias("out"))

    def step(acc: Column, k: Column) -> Column:
        own, left, right = F.get(cells, k - 1), F.get(cells, k - 2), F.get(cells, k)
        takes_left = (k > 1) & left["label"].isNotNull() & (acc["used"] < k - 1)
        takes_right = right["label"].isNotNull()
        made = F.struct(F.when(takes_left, left["label"]).otherwise(right["label"]).alias("label"), own["value"].alias("value"))
        pairs = own["value"].isNotNull() & (F.coalesce(takes_left, F.lit(False)) | F.coalesce(takes_right, F.lit(False)))
        used = F.when(pairs, F.when(takes_left, k - 1).otherwise(k + 1)).otherwise(acc["used"])
        return F.struct(used.alias("used"), F.when(pairs, F.concat(acc["out"], F.array(made))).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(cells) > 0, F.aggregate(at, begin, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<label:string,value:double>>"))
