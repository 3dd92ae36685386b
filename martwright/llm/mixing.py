"""Mixing sources to target weights by Poisson replication.

The mixture shall have `total` code points (by default as many as the input), of which each source gives the share of its
weight. A source's mean repetition rate is weight * total / its own code points, and each of its documents is repeated
k times, where k is the Poisson distribution with that mean, inverted at a number that a keyed hash draws from the
document's id: the smallest k whose cumulative probability is over it. Means over TABLED are inverted by the Cornish-Fisher
expansion of the quantile, off by at most one there. A row that is repeated more than CHUNK times is exploded in two steps:
into chunks, which are dealt to all tasks, and those into copies. Rows are then dealt and sorted by another keyed
hash of (id, copy): a global shuffle that is the same in every run and on every cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stash, without

MOST_SOURCES = 10_000  # rates of more sources than this are joined, not broadcast
TABLED = 500.0  # means up to this are inverted in a table of cumulative probabilities
CHUNK = 1024  # copies that a task makes of a row at once; no mean that is tabled draws more
SALTS = 64  # parts of a source's rows in such a join


def unit(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the seed and the parts."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def cumulative(mean: Column) -> Column:
    """Poisson's cumulative probabilities of 0, 1, ... far into the tail, for means up to TABLED."""
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int"))
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(steps, start, step, lambda acc: acc["cdf"])


def normal_quantile(u: Column) -> Column:
    """The standard normal distribution's quantile by Acklam's rational approximations, with a relative error of about 1e-9."""
    # fixed values: the coefficients of the approximations, highest powers first
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def at(coefficients: tuple[float, ...], x: Column) -> Column:
        out = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * x + F.lit(k)
        return out

    half = u - 0.5
    tail = F.greatest(F.least(u, 1 - u), F.lit(2.0**-53))
    far = F.sqrt(-2 * F.log(tail))
    low = at(c, far) / at(d, far)
    return F.when(tail >= 0.02425, at(a, half * half) * half / at(b, half * half)).when(half < 0, low).otherwise(-low)


def tabled(u: Column, cdf: Column) -> Column:
    """The smallest k, a long, whose cumulative probability is over u."""
    return F.size(F.filter(cdf, lambda c: c <= u)).cast("long")


def drawn(u: Column, mean: Column, cdf: Column, z: Column | None = None) -> Column:
    """The smallest k, a long, whose cumulative probability is over u; cdf is used for means up to TABLED. z: u's normal quantile, where a column holds it."""
    z, root = normal_quantile(u) if z is None else z, F.sqrt(mean)
    far = mean + root * z + (z * z - 1) / 6 + (z - z * z * z) / (72 * root)
    return F.when(mean <= TABLED, tabled(u, cdf)).otherwise(F.greatest(F.lit(0.0), F.ceil(far - 0.5)).cast("long"))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", text_col: str = "text", total: int | None = None) -> DataFrame:
    """(_source, _rate): each source's mean repetition rate. Sources without text, or without a weight, have none.

    weights: relative, by source; sources that it doesn't name get 0. None: equal weights for all sources.
    """
    size = F.sum(F.length(F.coalesce(F.col(text_col), F.lit("")))).alias("_chars")
    own = stash(docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source")).agg(size), "sources")  # texts are read once
    if weights is None:
        own = own.withColumn("_weight", F.lit(1.0))
    else:
        named = docs.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "_source string, _weight double")
        own = own.join(named, "_source", "left").fillna(0.0, ["_weight"])
    live = own.where("_chars > 0 and _weight > 0")
    all_weights, all_chars = live.agg(F.sum("_weight")).first()[0] or 1.0, own.agg(F.sum("_chars")).first()[0] or 0
    goal = all_chars if total is None else total
    return live.select("_source", (F.col("_weight") / F.lit(all_weights) * F.lit(goal) / F.col("_chars")).alias("_rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", total: int | None = None, parts: int | None = None) -> DataFrame:
    """The mixture: docs' rows, each as often as drawn, with copy (int, from 0) and mix_key (double), in order of mix_key.

    Keys are spread evenly over [0, 1), so rows go to one of parts ranges of equal width (by default as many as the session
    has shuffle partitions) without a look at them first. Rows of equal keys, which are those of one id, source and copy,
    are in order of their texts. A null source is the source "". Rows with equal ids in one source draw the same count; a
    null id draws as the empty text; null and empty texts add nothing to their source's size, and are drawn like others. A
    document of a source without any text, or without weight, isn't in the mixture. An empty table gives an empty result.
    Rates have no bound: a tiny source's row may be repeated a million times, by all tasks; copy numbers go up to 2^31.
    Further columns stay, whatever their names; columns named copy or mix_key are replaced.
    """
    docs = docs.select(*without(docs.columns, "copy", "mix_key"))
    kept = docs.columns
    counts, most, source, times, chunk = counted(docs, weights, seed, id_col, source_col, text_col, total)

    def copies(df: DataFrame, first, n) -> DataFrame:
        return df.select(*kept, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: (first + k).cast("int"))).alias("copy"))

    few = counts.where(F.col(times) <= CHUNK) if most > TABLED else counts
    made = copies(few, F.lit(0).cast("long"), F.col(times))
    if most > TABLED:  # else no row is drawn so often
        parts_of = counts.where(F.col(times) > CHUNK).withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / CHUNK))))
        spread = parts_of.repartition(F.xxhash64(source, id_col, chunk))
        made = made.unionByName(copies(spread, F.col(chunk) * CHUNK, F.least(F.lit(CHUNK).cast("long"), F.col(times) - F.col(chunk) * CHUNK)))
    placed = made.withColumn("mix_key", unit(seed + "/order", F.col(source_col), F.col(id_col), F.col("copy")))
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionById(n, F.floor(F.col("mix_key") * n).cast("int")).sortWithinPartitions("mix_key", id_col, source_col, text_col)


def counted(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", total: int | None = None) -> tuple[DataFrame, float, str, str, str]:
    """(docs' rows that are drawn at all with how often, the largest mean, and the names of the columns of the source, of the number of times, and of one more that is free).

    The number drawn for a row and its normal quantile are columns: written out wherever they are used they would stand in the
    plan hundreds of times, which takes the driver's memory.
    """
    kept = docs.columns
    source, rate, cdf, times, salt, chunk, u, z = fresh([*kept, "copy", "mix_key"], "source_text", "rate", "cdf", "times", "salt", "chunk", "unit", "quantile")
    by_source = rates(docs, weights, source_col, text_col, total).select(F.col("_source").alias(source), F.col("_rate").alias(rate))
    sources, most = by_source.agg(F.count("*"), F.max(rate)).first()
    by_source = by_source.select(source, rate, F.when(F.col(rate) <= TABLED, cumulative(F.least(F.col(rate), F.lit(TABLED)))).alias(cdf))
    keyed = docs.withColumn(source, F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    keyed = keyed.withColumn(u, unit(seed, F.col(source), F.col(id_col), F.lit(0)))
    far = (most or 0.0) > TABLED
    if far:
        keyed = keyed.withColumn(z, normal_quantile(F.col(u)))
    if sources <= MOST_SOURCES:
        keyed = keyed.join(F.broadcast(by_source), source)
    else:
        dealt = by_source.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = keyed.withColumn(salt, F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(SALTS)).cast("int")).join(dealt, [source, salt])
    n = drawn(F.col(u), F.col(rate), F.col(cdf), F.col(z)) if far else tabled(F.col(u), F.col(cdf))
    counts = keyed.select(*kept, source, n.alias(times)).where(F.col(times) > 0)
    return counts, most or 0.0, source, times, chunk


def oracle(seed: str = "mix-1") -> str:
    """The mixture of all sources at equal weights, in DuckDB's SQL, for mean rates of at most 500."""

    def u(*parts: str) -> str:
        text = " || '|' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
        return f"CAST(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"

    return f"""
WITH RECURSIVE d AS (SELECT *, coalesce(source, '') AS s, length(coalesce(text, '')) AS n FROM documents),
c AS (SELECT s, sum(n) AS chars FROM d GROUP BY s),
r AS (SELECT s, 1.0::DOUBLE / (SELECT CAST(count(*) AS DOUBLE) FROM c WHERE chars > 0) * (SELECT CAST(sum(chars) AS DOUBLE) FROM c) / CAST(chars AS DOUBLE) AS rate FROM c WHERE chars > 0),
p AS (SELECT s, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM r
  UNION ALL SELECT s, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM p WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 30)),
l AS (SELECT s, list(cdf ORDER BY k) AS cdf FROM p GROUP BY s),
n AS (SELECT d.*, len(list_filter(l.cdf, lambda x: x <= {u(f"'{seed}'", "d.s", "d.doc_id", "0")})) AS times FROM d JOIN l ON d.s = l.s),
e AS (SELECT *, unnest(range(0, times)) AS copy FROM n)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, {u(f"'{seed}/order'", "source", "doc_id", "copy")} AS mix_key FROM e"""
