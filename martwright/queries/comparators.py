"""Comparators over tables of cases: each order is a case whose gold result is its lines, each customer one of totals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batches, cases
from ..registry import query
from ..session import table

# (o, n, k, v, w): the lines of each order, by number: a text and two numbers
LINES = "b AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS n, 'P' || l_partkey AS k, CAST(l_extendedprice AS DOUBLE) AS v, CAST(l_quantity AS DOUBLE) AS w FROM lineitem)"
ROOM = "abs({g} - {p}) <= greatest(abs({g}) * 1e-6, 1e-9)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o, rows): an order's lines as an array of (k, v, w), in order."""
    part, price, quantity = F.concat(F.lit("P"), F.col("l_partkey").cast("string")), F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    one = F.struct("l_linenumber", "l_partkey", "l_extendedprice", part.alias("k"), price.alias("v"), quantity.alias("w"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_list(one)).alias("rows"))


def result(rows: Column, *columns) -> Column:
    """The rows as a result; columns give a cell each."""
    return F.transform(rows, lambda r: F.array(*(c(r) for c in columns)))


def k(r: Column) -> Column:
    return cases.cell(txt=r["k"])


def v(r: Column) -> Column:
    return cases.cell(r["v"])


def w(r: Column) -> Column:
    return cases.cell(r["w"])


def scaled(by: Column):
    return lambda r: cases.cell(r["v"] * by)


def cut(rows: Column, o: Column) -> Column:
    """rows with each line's rows in the results of shapes(): gold, and in other columns or with other numbers."""
    near, off = scaled(1 + (o % 4) * 4e-7), scaled(F.lit(1.1))

    def line(c: Column, r: Column) -> Column:
        made = {"gold": (c["k"], c["v"]), "near": (c["k"], near(r)), "off": (c["k"], off(r)), "swapped": (c["v"], c["k"]), "extra": (c["k"], c["w"], c["v"]), "other": (c["k"], c["w"])}
        return F.struct(*(F.array(*cells).alias(n) for n, cells in made.items()))

    return F.transform(rows, lambda r: cases.let(F.struct(k(r).alias("k"), v(r).alias("v"), w(r).alias("w")), lambda c: line(c, r)))


def shapes(lines: Column) -> dict[str, Column]:
    """What candidates returned for an order, from its lines as cut() has them: the gold rows as they are, or changed in some way."""
    gold = lines["gold"]
    return {
        "same": gold, "reordered": F.reverse(gold), "near": lines["near"], "off": lines["off"], "swapped": lines["swapped"], "extra": lines["extra"],
        "repeated": F.concat(gold, F.slice(gold, 1, 1)), "short": F.slice(gold, 2, F.greatest(F.size(gold) - 1, F.lit(0))), "other": lines["other"],
    }


def judged(spark: SparkSession, sf_dir: str, names: Sequence[str], test: Callable[[Column, list[Column]], Column]) -> DataFrame:
    """(o, shape, matched): every order with each of the shapes, by a test of its lines and what the shapes predict, which gives
    an array. Results are made and compared where the order's lines are; only what the test says gets a row."""
    made = lines(spark, sf_dir).select("o", cut(F.col("rows"), F.col("o")).alias("lines"))
    preds = shapes(F.col("lines"))
    said = made.select("o", test(F.col("lines"), [preds[s] for s in names]).alias("matched"))
    return said.select("o", F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("shape"), F.col("matched"))).alias("s")).select("o", "s.shape", "s.matched")


def tolerant(strict_only: tuple[str, ...] = (), loose: dict[str, str] | None = None, gold: str = "v", t: str = "t") -> str:
    """SQL: t(o, shape, matched). Predicted lines as (k, v) for each shape; those in strict_only can't match. t names all parts."""
    preds = {"same": "v", "reordered": "v", "near": "v * (1 + (o % 4) * 4e-7)", "off": "v * 1.1", "repeated": "v", "other": "w"} | (loose or {})
    p = " UNION ALL ".join(f"SELECT o, '{s}' AS shape, k, {e} AS v FROM b" for s, e in preds.items()) + " UNION ALL SELECT o, 'short', k, v FROM b WHERE n > 1"
    near = ROOM.format(g=f"g.{gold}", p="p.v")
    names = ", ".join(f"('{s}')" for s in [*preds, "short"])
    never = "".join(f" UNION ALL SELECT DISTINCT o, '{s}', false FROM b" for s in strict_only)
    return f"""{t}p AS ({p}), {t}s AS (SELECT DISTINCT o, shape FROM b, (VALUES {names}) x(shape)),
{t}x AS (SELECT g.o, s.shape, g.n, coalesce(bool_or(p.k = g.k AND {near}), false) AS hit FROM b g JOIN {t}s s ON s.o = g.o LEFT JOIN {t}p p ON p.o = g.o AND p.shape = s.shape GROUP BY 1, 2, 3),
{t}y AS (SELECT p.o, p.shape, p.k, p.v, bool_or(p.k = g.k AND {near}) AS hit FROM {t}p p JOIN b g ON g.o = p.o GROUP BY 1, 2, 3, 4),
{t} AS (SELECT s.o, s.shape, coalesce((SELECT bool_and(hit) FROM {t}x x WHERE x.o = s.o AND x.shape = s.shape), true) AND coalesce((SELECT bool_and(hit) FROM {t}y y WHERE y.o = s.o AND y.shape = s.shape), true) AS matched FROM {t}s s{never})"""


ALL = ("same", "reordered", "near", "off", "swapped", "extra", "repeated", "short", "other")


@query("c02_strict", f"WITH {LINES}, {tolerant(('swapped', 'extra'))} SELECT * FROM t")
def c02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir, ALL, lambda lines, preds: batches.strict(lines["gold"], preds))


@query("c03_relaxed", f"WITH {LINES}, {tolerant(loose={'swapped': 'v', 'extra': 'v'})} SELECT * FROM t")
def c03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir, ALL, lambda lines, preds: batches.relaxed(lines["gold"], preds))


@query("c06_alternatives", f"WITH {LINES}, {tolerant(('swapped', 'extra'))}, {tolerant(('swapped', 'extra'), gold='w', t='u')} SELECT o, shape, t.matched OR u.matched AS matched FROM t JOIN u USING (o, shape)")
def c06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices or quantities: either is accepted."""
    return judged(spark, sf_dir, ALL, lambda lines, preds: F.zip_with(*(batches.strict(lines[g], preds) for g in ("gold", "other")), lambda a, b: a | b))


@query("c07_context", f"WITH {LINES}, c AS (SELECT o, count(DISTINCT n % 2) AS years, bool_and(n % 2 = 1) AS odd FROM b GROUP BY 1) SELECT o, 'constant' AS shape, true AS matched FROM c UNION ALL SELECT o, 'varying', years = 1 FROM c UNION ALL SELECT o, 'not_context', false FROM c UNION ALL SELECT o, 'both', true FROM c")
def c07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year beside the rows: constant, or one that varies if the order has more than one line; and one under another name."""
    plain = F.array(F.lit("k"), F.lit("v"))
    named = lambda name: F.array(F.lit("k"), F.lit(name), F.lit("v"))

    def line(r: Column, i: Column) -> Column:
        year = lambda n: F.array(r["k"], cases.cell(F.lit(1997.0) + n), r["v"])
        return F.struct(F.array(r["k"], r["v"]).alias("gold"), year(F.lit(0)).alias("year"), year(i % 2).alias("numbered"))

    def each(lines: Column) -> Column:
        tests = {"constant": (plain, lines["gold"], named("Fiscal_Year"), lines["year"]), "varying": (plain, lines["gold"], named("fiscal_year"), lines["numbered"]), "not_context": (plain, lines["gold"], named("season"), lines["year"]), "both": (named("uom"), lines["year"], named("fiscal_year"), lines["year"])}
        return F.array(*(F.struct(F.lit(s).alias("shape"), cases.without_context(*args).alias("matched")) for s, args in tests.items()))

    cells = F.transform("rows", lambda r: F.struct(k(r).alias("k"), v(r).alias("v")))
    return lines(spark, sf_dir).select("o", F.explode(cases.let(F.transform(cells, line), each)).alias("s")).select("o", "s.shape", "s.matched")


@query(
    "c08_float_equal",
    f"""WITH {LINES}, p AS (SELECT o, 'same' AS shape, k, v FROM b UNION ALL SELECT o, 'reordered', k, v FROM b UNION ALL SELECT o, 'near', k, v * (1 + (o % 4) * 4e-7) FROM b UNION ALL SELECT o, 'off', k, v * 1.1 FROM b
 UNION ALL SELECT o, 'repeated', k, v FROM b UNION ALL SELECT o, 'repeated', k, v FROM b WHERE n = 1 UNION ALL SELECT o, 'short', k, v FROM b WHERE n > 1 UNION ALL SELECT o, 'other', k, w FROM b),
g AS (SELECT o, k, v, row_number() OVER (PARTITION BY o ORDER BY k, round(v, 6)) AS i FROM b), q AS (SELECT *, row_number() OVER (PARTITION BY o, shape ORDER BY k, round(v, 6)) AS i FROM p),
s AS (SELECT o, shape, count(*) OVER (PARTITION BY o) AS sizes FROM (SELECT DISTINCT b.o, x.shape FROM b, (VALUES ('same'), ('reordered'), ('near'), ('off'), ('repeated'), ('short'), ('other')) x(shape)))
SELECT s.o, s.shape, (SELECT count(*) FROM g WHERE g.o = s.o) = (SELECT count(*) FROM q WHERE q.o = s.o AND q.shape = s.shape) AND coalesce((SELECT bool_and(g.k = q.k AND {ROOM.format(g="g.v", p="q.v")}) FROM g JOIN q ON q.o = g.o AND q.i = g.i WHERE g.o = s.o AND q.shape = s.shape), true) AS matched FROM s""",
)
def c08(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("same", "reordered", "near", "off", "repeated", "short", "other")
    return judged(spark, sf_dir, names, lambda lines, preds: F.array(*(cases.float_equal(lines["gold"], p) for p in preds)))


MODES = ("none", "empty", "count", "scalar", "scalar_or_null", "set", "ordered")


@query(
    "c01_v1_match",
    f"""WITH {LINES}, l AS (SELECT o, list({{'v': v, 'k': k}} ORDER BY n) AS g, list({{'v': v * 1.1, 'k': k}} ORDER BY n) AS off FROM b GROUP BY 1),
p AS (SELECT o, g, 'same' AS shape, g AS p FROM l UNION ALL SELECT o, g, 'reordered', list_reverse(g) FROM l UNION ALL SELECT o, g, 'off', off FROM l UNION ALL SELECT o, g, 'repeated', g || [g[1]] FROM l UNION ALL SELECT o, g, 'short', g[2:] FROM l)
SELECT o, shape, CASE o % 7 WHEN 0 THEN true WHEN 1 THEN len(p) = 0 WHEN 2 THEN len(p) = len(g) WHEN 5 THEN list_sort(list_distinct(g)) = list_sort(list_distinct(p)) WHEN 6 THEN g = p
  ELSE len(p) > 0 AND coalesce({ROOM.format(g="g[1].v", p="p[1].v")}, false) END AS matched FROM p""",
)
def c01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is compared in the mode that its number gives."""
    own, rows = lines(spark, sf_dir), F.col("rows")
    preds = {"same": result(rows, v, k), "reordered": result(F.reverse(rows), v, k), "off": result(rows, scaled(F.lit(1.1)), k), "repeated": result(F.concat(rows, F.slice(rows, 1, 1)), v, k), "short": result(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), v, k)}
    mode = F.get(F.array(*map(F.lit, MODES)), (F.col("o") % 7).cast("int"))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("shape"), p.alias("pred")) for s, p in preds.items())))
    return own.select("o", mode.alias("mode"), result(rows, v, k).alias("gold"), each.alias("s")).select("o", "s.shape", cases.v1(F.col("gold"), F.col("s.pred"), F.col("mode")).alias("matched"))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    "c05_pivot",
    f"""WITH g AS (SELECT o_custkey AS c, o_orderpriority AS label, CAST(sum(o_totalprice) AS DOUBLE) AS v, CAST(sum(o_totalprice) FILTER (o_orderstatus <> 'P') AS DOUBLE) AS f FROM orders GROUP BY 1, 2),
a AS (SELECT c, count(*) AS n, count(f) AS m, coalesce(bool_and(f IS NOT NULL AND {ROOM.format(g="v", p="f")}), true) AS ok FROM g GROUP BY 1)
SELECT c, shape, CASE shape WHEN 'wide' THEN ok AND n = 5 WHEN 'more' THEN false WHEN 'other' THEN m > 0 AND ok ELSE true END AS whole, CASE WHEN shape IN ('wide', 'other') THEN m > 0 AND ok ELSE true END AS part FROM a, (VALUES ('long'), ('wide'), ('row'), ('turned'), ('more'), ('other')) x(shape)""",
)
def c05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' totals by priority, in a row each, against other layouts; wide and other count only orders that aren't pending."""
    o = table(spark, sf_dir, "orders").withColumn("f", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("decimal(18,2)")))
    by = o.groupBy("o_custkey", "o_orderpriority").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"), F.sum("f").cast("double").alias("f"))
    held = by.groupBy(F.col("o_custkey").alias("c")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderpriority").alias("k"), "v", "f"))).alias("rows"))
    rows, text = F.col("rows"), lambda x: cases.cell(txt=x)
    counted = F.filter(rows, lambda r: r["f"].isNotNull())
    total = lambda r: cases.cell(r["f"])
    of = lambda p: F.get(F.filter(rows, lambda r: r["k"] == p), F.lit(0))
    wide = F.array(*(cases.cell(of(p)["f"]) for p in PRIORITIES))
    gold, plain = result(rows, k, v), F.array(F.lit("label"), F.lit("total"))
    layouts = {
        "long": (plain, result(F.reverse(rows), k, v)), "wide": (F.array(*(F.lit(f"total_{p.lower()}") for p in PRIORITIES)), F.array(wide)), "row": (plain, F.array(F.flatten(result(rows, k, v)))), "turned": (plain, result(rows, v, k)),
        "more": (plain, result(rows, k, v, lambda r: text(F.lit("left over")))), "other": (plain, result(counted, k, total)),
    }
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("shape"), c.alias("columns"), p.alias("pred")) for s, (c, p) in layouts.items())))
    spread = held.select("c", gold.alias("gold"), each.alias("s")).select("c", "gold", "s.*")
    tests = {n: cases.pivot(F.col("gold"), F.col("columns"), F.col("pred"), whole=n == "whole") for n in ("whole", "part")}
    return spread.select("c", "shape", *(t.alias(n) for n, t in tests.items()))
