"""Aggregates of the evaluation side: modes, confusion, calibration, AUROC, bootstrap, caps and draws.

Empty denominators give 0.0, as everywhere in these metrics. What is drawn at random follows from hashes of a seed and of
what it is drawn for, so it is the same on any cluster, and no group has to be in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import sums_before


def ratio(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / F.when(d != 0, d))


def capped(rows: DataFrame, cap: int) -> DataFrame:
    """(truncated, n_rows) of a result that is read up to a cap: never more than cap + 1 rows are taken."""
    n = rows.limit(cap + 1).agg(F.count("*").alias("n"))
    return n.select((F.col("n") > cap).alias("truncated"), F.least("n", F.lit(cap)).cast("long").alias("n_rows"))


def mode_first_seen(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Each group's most frequent value and its count; among equals the one seen first."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "_first")
    return n.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*keys, F.col(value).alias("mode"), "n")


def frequent_values(rows: DataFrame, column: str, k: int) -> DataFrame:
    """(value, n, k): the k most frequent non-null values, ties by value; only k rows meet in the ranking."""
    top = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)
    return top.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "value")))


def confusion(rows: DataFrame, expected: str, observed: str, states: list[str]) -> DataFrame:
    return rows.groupBy(expected).agg(*(F.count_if(F.col(observed) == s).alias(s) for s in states))


def precision_recall(rows: DataFrame, said: Column, true: Column) -> DataFrame:
    c = rows.agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))
    return c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def calibration(rows: DataFrame, score: str, label: str, bins: int) -> DataFrame:
    """(bin, n, acc, conf, part) of fixed-width bins, 1.0 in the last; the expected calibration error is the sum of part."""
    b = rows.groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), (F.sum(label).cast("double") / F.count("*")).alias("acc"), (F.sum(F.col(score).cast("decimal(18,9)")).cast("double") / F.count("*")).alias("conf")
    )
    total = b.agg(F.sum("n").alias("_all"))
    return b.crossJoin(F.broadcast(total)).withColumn("part", F.round(F.col("n") * F.abs(F.col("acc") - F.col("conf")) / F.col("_all"), 9)).drop("_all")


def conditional_means(rows: DataFrame, score: str, label: str) -> DataFrame:
    def mean(y: int) -> Column:
        own = F.col(label) == y
        return F.round(F.sum(F.when(own, F.col(score).cast("decimal(18,9)"))).cast("double") / F.count_if(own), 9)

    return rows.agg(mean(1).alias("mean_right"), mean(0).alias("mean_wrong"))


def twin_consistency(rows: DataFrame, key: str, score: str, label: str) -> DataFrame:
    """Of neighbouring ids, the share of pairs that the score puts in the label's order."""
    b = rows.select((F.col(key) - 1).alias(key), F.col(score).alias("_s"), F.col(label).alias("_y"))
    same = (F.col(score) >= F.col("_s")) == (F.col(label) >= F.col("_y"))
    return rows.join(b, key).agg(F.count("*").alias("pairs"), F.round(F.avg(F.when(same, 1.0).otherwise(0.0)), 9).alias("consistent"))


def auroc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve, ties half, from average ranks; null where a class is missing.

    Ranks come from counts per distinct score, summed by ranges of scores.
    """
    c = rows.groupBy(score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    wins = sums_before(c, score, "n", "_below").withColumn("_won", F.col("p") * (F.col("_below") + F.col("n") / 2.0))
    area = wins.agg(F.sum("_won").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return area.select(F.round(F.try_divide(F.col("w"), (F.col("p") * F.col("n")).cast("double")), 9).alias("auroc"))


def _interval(values: Column, level: float = 0.95) -> tuple[Column, Column]:
    """The percentiles that leave so much between them."""
    held, cut = F.array_sort(values), (1 - level) / 2
    n = F.size(held)
    return F.get(held, F.floor(cut * n).cast("int")), F.get(held, F.least(n - 1, F.floor((1 - cut) * n)).cast("int"))


def _weights(seed: int, name: object, value: object, kind: object, count: float, resamples: int) -> np.ndarray:
    """How often each resample has a value that is there count times: Poisson counts, the same wherever they are drawn."""
    key = sha256(f"{seed}|{name}|{value!r}|{kind}".encode()).digest()
    return np.random.default_rng(int.from_bytes(key[:8], "big")).poisson(count, resamples).astype(float)


def bootstrap_mean(rows: DataFrame, name: str, value: str, resamples: int = 500, seed: int = 0) -> DataFrame:
    """(name, mean, low, high): percentile bootstrap of a mean per group. NULL values don't count.

    A resample has each distinct value a Poisson number of times with its count as mean, drawn from a hash of seed, group
    and value. Tasks give partial sums for each group and resample, so no task holds a group.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for own, x, n in batch.itertuples(index=False):
                w = _weights(seed, own, x, "", n, resamples)
                held = sums.setdefault(own, [np.zeros(resamples), np.zeros(resamples)])
                held[0] += w * x
                held[1] += w
        for own, (total, weight) in sums.items():
            yield pd.DataFrame({"name": own, "b": range(resamples), "total": total, "weight": weight})

    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(name).alias("name"), F.col(value).cast("double").alias("x")).agg(F.count("*").cast("double").alias("n"))
    kind = counted.schema["name"].dataType.simpleString()
    means = counted.mapInPandas(partial, f"name {kind}, b int, total double, weight double").groupBy("name", "b").agg(F.try_divide(F.sum("total"), F.sum("weight")).alias("m"))
    low, high = _interval(F.collect_list("m"))
    held = means.groupBy("name").agg(low.alias("low"), high.alias("high"))
    own = counted.groupBy("name").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"))
    return own.join(held, "name").select("name", "mean", "low", "high")


CUTS = 64  # ranges of scores, each a task's


def bootstrap_auroc(rows: DataFrame, name: str, score: str, label: str, resamples: int = 200, seed: int = 0) -> DataFrame:
    """(name, auroc, low, high) per group: AUROC, ties half, and its percentile bootstrap; NULLs where a class is missing.

    Resamples are Poisson as in bootstrap_mean, positives and negatives apart. Scores are cut into ranges; a range's task
    gives what its own positives win within it and how many of either class it has, and ranges are put together by sums
    over those before them.
    """
    counted = rows.where(F.col(score).isNotNull()).groupBy(F.col(name).alias("name"), F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    cuts = counted.groupBy("name").agg(F.percentile_approx("s", [k / CUTS for k in range(1, CUTS)], 1_000).alias("cuts"))
    cut = counted.join(cuts, "name").select("name", F.size(F.filter("cuts", lambda c: c <= F.col("s"))).alias("part"), "s", "p", "n")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("s")
        key = own["name"].iloc[0]
        pos, neg = (np.array([np.concatenate([[c], _weights(seed, key, s, kind, c, resamples)]) for s, c in zip(own["s"], own[kind], strict=True)]) for kind in ("p", "n"))
        won = (pos * (np.cumsum(neg, axis=0) - neg / 2)).sum(axis=0)
        return pd.DataFrame({"name": key, "part": own["part"].iloc[0], "b": range(resamples + 1), "won": won, "p": pos.sum(axis=0), "n": neg.sum(axis=0)})

    kind = counted.schema["name"].dataType.simpleString()
    parts = cut.groupBy("name", "part").applyInPandas(one, f"name {kind}, part int, b int, won double, p double, n double")
    before = Window.partitionBy("name", "b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = parts.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0.0))).groupBy("name", "b").agg(F.sum(F.col("won") + F.col("p") * F.col("below")).alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    areas = whole.select("name", "b", F.try_divide(F.col("won"), F.col("p") * F.col("n")).alias("area"))
    low, high = _interval(F.collect_list(F.when(F.col("b") > 0, F.col("area"))))
    return areas.groupBy("name").agg(F.max(F.when(F.col("b") == 0, F.col("area"))).alias("auroc"), low.alias("low"), high.alias("high"))


def _drawn(seed: int, *parts: str) -> Column:
    """The order of a draw: a hash of the seed and what is drawn."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") for p in parts)).cast("binary"))


def seeded_draw(rows: DataFrame, pool: str, item: str, k: int, seed: int) -> DataFrame:
    """(pool, item): k items of each pool drawn without replacement, those with the smallest hash; tasks keep k a pool."""
    w = Window.partitionBy("pool").orderBy(_drawn(seed, "pool", "item"), "item")
    kinds = rows.select(F.col(pool).alias("pool"), F.col(item).alias("item"))
    return kinds.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")


def one_per_run(rows: DataFrame, pool: str, run: str, item: str, k: int, seed: int) -> DataFrame:
    """(pool, run, item): of each pool k runs, and of each of them one item, drawn by hashes."""
    kinds = rows.select(F.col(pool).alias("pool"), F.col(run).alias("run"), F.col(item).alias("item"))
    first = Window.partitionBy("pool", "run").orderBy(_drawn(seed, "pool", "run", "item"), "item")
    each = kinds.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
    few = Window.partitionBy("pool").orderBy(_drawn(seed, "pool", "run"), "run")
    return each.withColumn("place", F.row_number().over(few)).where(F.col("place") <= k).drop("place")
