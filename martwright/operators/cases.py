"""Comparators over tables of cases: does each case's predicted result answer the same question as its gold one.

A result is a column `rows` of type array<array<cell>>, a cell being a struct (num double, txt string, who long): a number, a
text (also dates and truth values, as written), or neither for null; who is the company that the cell names, where known().
Results are row-capped where they are taken (1,000 rows), so a case fits in a row; packed() makes them from one row a cell,
and everything else is a column expression over them: cases are compared where they are, without a shuffle or the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = "struct<num:double,txt:string,who:long>"
CONTEXT = ("fiscal_year", "name", "ticker", "uom")  # fixed values: columns that only say what the question said
RATIOS = (100.0, 0.01)  # a share and a percentage


def cell(num: Column | None = None, txt: Column | None = None, who: Column | None = None) -> Column:
    values = [(F.lit(None) if c is None else c).cast(t).alias(n) for c, n, t in ((num, "num", "double"), (txt, "txt", "string"), (who, "who", "long"))]
    return F.struct(*values)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once and not wherever the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def packed(cells: DataFrame, case: Sequence[str], row: str = "row", col: str = "col", num: str = "num", txt: str = "txt", who: str | None = None, name: str = "rows") -> DataFrame:
    """(case..., rows) from a row for each cell; rows and cells are in the order of their numbers. Repeated cells both count."""
    held = cells.select(*case, F.col(row).alias("_row"), F.struct(F.col(col).alias("at"), cell(F.col(num), F.col(txt), F.col(who) if who else None).alias("cell")).alias("_cell"))
    lines = held.groupBy(*case, "_row").agg(F.transform(F.array_sort(F.collect_list("_cell")), lambda c: c["cell"]).alias("_cells"))
    whole = lines.groupBy(*case).agg(F.array_sort(F.collect_list(F.struct(F.col("_row").alias("at"), F.col("_cells").alias("cells")))).alias(name))
    return whole.withColumn(name, F.transform(name, lambda r: r["cells"]))


def known(cells: DataFrame, companies: DataFrame, num: str = "num", txt: str = "txt", who: str = "who") -> DataFrame:
    """cells with the company that each names exactly: by its number, else its ticker, else its name.

    companies: (cik, ticker, name). A join with a dictionary of one row for each way to name one; a text that names two
    companies in one way names neither.
    """
    ways = [companies.select(F.lit(k).alias("_how"), F.col(c).cast("string").alias("_key"), F.col("cik").alias("_cik")) for k, c in enumerate(("cik", "ticker", "name"))]
    each = ways[0].unionByName(ways[1]).unionByName(ways[2]).where("_key is not null").groupBy("_key", "_how").agg(F.min("_cik").alias("_cik"), F.count_distinct("_cik").alias("_n"))
    dictionary = each.groupBy("_key").agg(F.min(F.struct("_how", F.when(F.col("_n") == 1, F.col("_cik")).alias("cik"))).alias("_best")).select("_key", F.col("_best.cik").alias(who))
    whole = (F.col(num) == F.floor(num)) & (F.abs(F.col(num)) < 2.0**53)
    key = F.coalesce(F.col(txt), F.when(whole, F.col(num).cast("long").cast("string")))
    return cells.withColumn("_key", key).join(dictionary, "_key", "left").drop("_key")


class Kinds:
    """What may differ between a gold and a predicted cell, by gold column: at which place, a Column or a number.

    entities: places that name companies; ratios: places of shares or percentages; scales: a map from place to another unit's
    factor. All are columns of the case (array<int>, array<int>, map<int,double>), or None.
    """

    def __init__(self, tolerance: float = 1e-6, absolute: bool = False, entities: Column | None = None, ratios: Column | None = None, scales: Column | None = None) -> None:
        self.tolerance, self.absolute, self.entities, self.ratios, self.scales = tolerance, absolute, entities, ratios, scales

    @property
    def plain(self) -> bool:
        """Whether a cell's place doesn't matter."""
        return self.entities is None and self.ratios is None and self.scales is None

    def close(self, gold: Column, pred: Column) -> Column:
        """Numbers within the tolerance; false, not null, where one is none. NaN, which Spark takes for the largest number, is close to none."""
        room = F.lit(self.tolerance) if self.absolute else F.greatest(F.nanvl(F.abs(gold) * self.tolerance, F.lit(0.0)), F.lit(1e-9))
        return F.coalesce(F.abs(gold - pred) <= room, F.lit(False))

    def same(self, place: Column | None, gold: Column, pred: Column) -> Column:
        plain = F.when(gold["num"].isNull(), pred["num"].isNull() & gold["txt"].eqNullSafe(pred["txt"])).otherwise(self.close(gold["num"], pred["num"]))
        if self.ratios is not None:
            plain = plain | (F.array_contains(self.ratios, place) & (self.close(gold["num"], pred["num"] * RATIOS[0]) | self.close(gold["num"], pred["num"] * RATIOS[1])))
        if self.scales is not None:
            plain = plain | self.close(gold["num"], pred["num"] * F.try_element_at(self.scales, place))
        if self.entities is not None:
            both = F.array_contains(self.entities, place) & gold["who"].isNotNull() & pred["who"].isNotNull()
            plain = F.when(both, gold["who"] == pred["who"]).otherwise(plain)
        return plain


def _row(kinds: Kinds, gold: Column, pred: Column) -> Column:
    """Whether a gold row's cells are the predicted row's, place by place."""
    if kinds.plain:
        return (F.size(gold) == F.size(pred)) & ~F.array_contains(F.zip_with(gold, pred, lambda g, p: kinds.same(None, g, p)), False)
    pairs = F.transform(F.arrays_zip(gold.alias("g"), pred.alias("p")), lambda x, i: kinds.same(i, x["g"], x["p"]))
    return (F.size(gold) == F.size(pred)) & ~F.array_contains(pairs, False)


def _lines(gold: Column, pred: Column, kinds: Kinds) -> Column:
    """Whether there are equally many rows and they match one by one; the first that don't end the search."""
    return (F.size(gold) == F.size(pred)) & F.forall(F.arrays_zip(gold.alias("g"), pred.alias("p")), lambda x: _row(kinds, x["g"], x["p"]))


def _both_ways(gold: Column, pred: Column, same: Callable[[Column, Column], Column]) -> Column:
    return F.forall(gold, lambda g: F.exists(pred, lambda p: same(g, p))) & F.forall(pred, lambda p: F.exists(gold, lambda g: same(g, p)))


def _as_sets(gold: Column, pred: Column, kinds: Kinds) -> Column:
    """Whether each row of some has a partner on the other side. The first gold row's is looked for first, as most that differ
    have none; rows that match in sorted order, without repeats, are partners; only others are tried against each."""
    ordered = lambda rows: F.sort_array(F.array_distinct(rows))
    first = F.exists(pred, lambda p: _row(kinds, F.get(gold, F.lit(0)), p))
    in_order = let(F.struct(ordered(gold).alias("g"), ordered(pred).alias("p")), lambda x: _lines(x["g"], x["p"], kinds))
    return F.when(~first, False).when(in_order, True).otherwise(_both_ways(gold, pred, lambda g, p: _row(kinds, g, p)))


def strict(gold: Column, pred: Column, kinds: Kinds | None = None, ordered: Column | bool = False) -> Column:
    """The same columns in the same order. ordered: row by row; else each row has a partner both ways, and repeats collapse.

    Two empty results are the same, whatever their columns; null (no result) is as no other result is.
    """
    kinds = kinds or Kinds()

    def test(gold: Column, pred: Column) -> Column:
        lines = _lines(gold, pred, kinds)
        empty = (F.size(gold) == 0) | (F.size(pred) == 0)
        as_set = F.when(empty, F.size(gold) == F.size(pred)).when(lines, True).otherwise(_as_sets(gold, pred, kinds))
        if isinstance(ordered, bool):
            return lines if ordered else as_set
        return F.when(ordered, lines).otherwise(as_set)

    return let(F.struct(gold.alias("g"), pred.alias("p")), lambda x: F.coalesce(F.when(x["g"].isNotNull() & x["p"].isNotNull(), test(x["g"], x["p"])), F.lit(False)))


def assignments(gold: Column, pred: Column, kinds: Kinds | None = None) -> Column:
    """array<array<int>>: the ways to find the gold columns among the predicted ones so that the rows are the same, as a set.

    Gold columns are placed one after the other. A way stays while the rows, cut to the columns placed so far, have partners
    on the other side, which is necessary for the whole and soon leaves one way. Of predicted columns with the same cells
    throughout only the first free one is tried, as the others would give the same rows; so ways don't multiply by them.
    """
    kinds = kinds or Kinds()
    places_of = let(F.size(F.get(pred, F.lit(0))), lambda wide: F.when(wide > 0, F.sequence(F.lit(0), wide - 1)).otherwise(F.array().cast("array<int>")))
    columns_of = F.transform(places_of, lambda j: F.transform(pred, lambda p: F.get(p, j)))
    twins = let(columns_of, lambda columns: F.transform(columns, lambda c: F.array_position(columns, c).cast("int") - 1))  # the first column that is the same

    def free(way: Column, j: Column, twin: Column) -> Column:
        earlier = (F.get(twin, j) < j) & F.exists(F.sequence(F.lit(0), j), lambda k: (k < j) & (F.get(twin, k) == F.get(twin, j)) & ~F.array_contains(way, k))
        return ~F.array_contains(way, j) & ~earlier

    def longer(ways: Column, twin: Column, upto: Column) -> Column:
        next_ways = F.flatten(F.transform(ways, lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.size(twin) - 1), lambda j: free(w, j, twin)), lambda j: F.concat(w, F.array(j)))))
        taken = lambda w: F.transform(pred, lambda p: F.transform(w, lambda j: F.get(p, j)))
        cut = F.transform(gold, lambda g: F.slice(g, F.lit(1), upto))
        return let(cut, lambda gs: F.filter(next_ways, lambda w: strict(gs, taken(w), kinds)))

    start = F.array(F.array().cast("array<int>"))
    return let(twins, lambda twin: F.aggregate(F.sequence(F.lit(1), F.size(F.get(gold, F.lit(0)))), start, lambda ways, n: longer(ways, twin, n)))


def _all_there(gold: Column, pred: Column, kinds: Kinds) -> Column:
    """Whether each cell of the first gold row is some predicted cell; if not, no assignment can place it."""
    first = F.get(gold, F.lit(0))
    if kinds.plain:
        return let(F.flatten(pred), lambda cells: F.forall(first, lambda g: F.exists(cells, lambda p: kinds.same(None, g, p))))
    return let(F.flatten(pred), lambda cells: ~F.array_contains(F.transform(first, lambda g, i: F.exists(cells, lambda p: kinds.same(i, g, p))), False))


def relaxed(gold: Column, pred: Column, kinds: Kinds | None = None) -> Column:
    """strict(), or the gold columns are found among the predicted ones, in any order; further columns are ignored.

    All rows of a result have equally many cells. Without rows on one side only strict() can hold.
    """
    kinds = kinds or Kinds()

    def test(gold: Column, pred: Column) -> Column:
        some = (F.size(gold) > 0) & (F.size(pred) > 0) & (F.size(F.get(gold, F.lit(0))) > 0) & (F.size(F.get(gold, F.lit(0))) <= F.size(F.get(pred, F.lit(0)))) & _all_there(gold, pred, kinds)
        return F.when(strict(gold, pred, kinds), True).otherwise(F.coalesce(F.when(some, F.size(assignments(gold, pred, kinds)) > 0), F.lit(False)))

    return let(F.struct(gold.alias("g"), pred.alias("p")), lambda x: test(x["g"], x["p"]))


def projected(columns: Column, rows: Column, names: Sequence[str] = CONTEXT) -> Column:
    """rows without the columns of context that are constant over them; columns: their names, array<string>."""
    constant = lambda i: let(F.get(F.get(rows, F.lit(0)), i), lambda first: F.forall(rows, lambda r: F.get(r, i).eqNullSafe(first)))
    dropped = F.filter(F.sequence(F.lit(0), F.size(columns) - 1), lambda i: F.lower(F.get(columns, i)).isin(*names) & constant(i))
    cut = lambda places: F.when(F.size(places) == 0, rows).otherwise(F.transform(rows, lambda r: F.filter(r, lambda _, i: ~F.array_contains(places, i))))
    return F.when(F.size(columns) > 0, let(dropped, cut)).otherwise(rows)


def without_context(gold_columns: Column, gold: Column, pred_columns: Column, pred: Column, kinds: Kinds | None = None) -> Column:
    """strict() as they are, or after constant columns of context are dropped on both sides. kinds go by the gold places left."""
    both = F.struct(gold_columns.alias("gc"), gold.alias("g"), pred_columns.alias("pc"), pred.alias("p"))
    return let(both, lambda x: strict(x["g"], x["p"], kinds) | strict(projected(x["gc"], x["g"]), projected(x["pc"], x["p"]), kinds))


def any_of(golds: Column, pred: Column, test: Callable[..., Column] = strict, kinds: Kinds | None = None) -> Column:
    """Whether one of the accepted results (an array of them) is the predicted one."""
    return F.exists(golds, lambda g: test(g, pred, kinds))


def v1(gold: Column, pred: Column, mode: Column, tolerance: float = 1e-6) -> Column:
    """The first edition, by its mode: none, empty, scalar, count, scalar_or_null, set, ordered; null for another mode."""
    kinds, first = Kinds(tolerance), F.lit(0)
    scalar = F.coalesce((F.size(gold) > 0) & (F.size(pred) > 0) & kinds.same(first, F.get(F.get(gold, first), first), F.get(F.get(pred, first), first)), F.lit(False))
    nothing = F.forall(pred, lambda r: F.forall(r, lambda c: c["num"].isNull() & c["txt"].isNull()))
    as_set = (F.size(F.array_except(gold, pred)) == 0) & (F.size(F.array_except(pred, gold)) == 0)
    out = F.when(mode == "none", True).when(mode == "empty", F.size(pred) == 0).when(mode == "count", F.size(gold) == F.size(pred)).when(mode == "scalar", scalar)
    out = out.when(mode == "scalar_or_null", F.when(F.size(gold) == 0, nothing).otherwise(scalar))
    return out.when(mode == "set", as_set).when(mode == "ordered", gold == pred)


def float_equal(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Equal in any order of rows, numbers within a relative tolerance; repeats count. Rows are sorted on both sides and compared one by one."""

    def line(rows: Column) -> Column:
        """Rows by their texts and rounded numbers; those that agree in these stay in their order."""
        key = lambda r: F.transform(r, lambda c: F.struct(c["num"].isNotNull().alias("n"), F.coalesce(c["txt"], F.lit("")).alias("t"), F.round(F.coalesce(c["num"], F.lit(0.0)), 6).alias("v")))
        keyed = F.transform(rows, lambda r, i: F.struct(key(r).alias("key"), i.alias("at"), r.alias("cells")))
        return F.transform(F.sort_array(keyed), lambda k: k["cells"])

    return strict(line(a), line(b), Kinds(tolerance), ordered=True)


def label_of(c: Column, entity: bool = False) -> Column:
    """What a cell says as a label: its company, or its text or whole number."""
    return c["who"].cast("string") if entity else F.coalesce(c["txt"], F.when(c["num"] == F.floor(c["num"]), c["num"].cast("long").cast("string")))


def _plain(c: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))


def labelled(gold: Column, label: int, entity: bool, columns: Column, rows: Column, words: Column | None = None) -> Column:
    """A predicted result in any layout as struct (pairs: array<struct<label,num>>, left: how many cells are in no pair).

    A number takes the label in the cell before it, if that is free, else the one in the cell after it, else the label that
    its column's header stands for. Labels are gold texts, whole numbers or, for entities, companies. A header stands for a
    label if it holds its words (words: array<struct<label,word>>; by default the labels' own) and those of no other label.
    A cell that is a label is no value.
    """
    labels_of = F.array_distinct(F.filter(F.transform(gold, lambda r: label_of(F.get(r, F.lit(label)), entity)), lambda x: x.isNotNull()))
    pair = "struct<label:string,num:double>"

    def heads_of(labels: Column) -> Column:
        own = F.transform(labels, lambda x: F.struct(x.alias("label"), x.alias("word"))) if words is None else F.filter(words, lambda w: F.array_contains(labels, w["label"]))

        def header(name: Column, plain_words: Column) -> Column:
            hits = let(_plain(name), lambda text: F.array_distinct(F.transform(F.filter(plain_words, lambda w: F.contains(text, w["word"])), lambda w: w["label"])))
            return let(hits, lambda h: F.when(F.size(h) == 1, F.get(h, F.lit(0))))

        plain_words = F.transform(own, lambda w: F.struct(w["label"].alias("label"), _plain(w["word"]).alias("word")))
        return F.coalesce(let(plain_words, lambda ws: F.transform(columns, lambda name: header(name, ws))), F.array().cast("array<string>"))

    def fold(r: Column, names: Column, heads: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<{pair}>").alias("pairs"), F.lit(0).alias("taken"))

        def place(acc: Column, i: Column) -> Column:
            free = lambda j: (j >= 0) & F.get(names, F.greatest(j, F.lit(0))).isNotNull() & ~F.array_contains(acc["used"], j)
            beside = F.when(free(i - 1), i - 1).when(free(i + 1), i + 1)
            name = lambda b: F.when(b.isNotNull(), F.get(names, b)).otherwise(F.get(heads, i))
            claimed = lambda b: F.struct(
                F.when(b.isNotNull(), F.concat(acc["used"], F.array(b))).otherwise(acc["used"]).alias("used"),
                F.when(name(b).isNotNull(), F.concat(acc["pairs"], F.array(F.struct(name(b).alias("label"), F.get(r, i)["num"].alias("num"))))).otherwise(acc["pairs"]).alias("pairs"),
                (acc["taken"] + F.when(b.isNotNull(), 2).when(name(b).isNotNull(), 1).otherwise(0)).alias("taken"),
            )
            return F.when(F.get(names, i).isNull() & F.get(r, i)["num"].isNotNull(), let(beside, claimed)).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(0), F.size(r) - 1), start, place, lambda acc: F.struct(acc["pairs"].alias("pairs"), (F.size(r) - acc["taken"]).alias("left")))

    def of_rows(labels: Column, heads: Column) -> Column:
        names = lambda r: F.transform(r, lambda c: let(label_of(c, entity), lambda x: F.when(F.array_contains(labels, x), x)))
        return F.transform(F.filter(rows, lambda r: F.size(r) > 0), lambda r: let(names(r), lambda n: fold(r, n, heads)))

    claimed = let(labels_of, lambda labels: let(heads_of(labels), lambda heads: of_rows(labels, heads)))
    return let(claimed, lambda c: F.struct(F.flatten(F.transform(c, lambda x: x["pairs"])).alias("pairs"), F.aggregate(c, F.lit(0), lambda n, x: n + x["left"]).alias("left")))


def pivot(gold: Column, columns: Column, pred: Column, label: int = 0, value: int = 1, entity: bool = False, words: Column | None = None, kinds: Kinds | None = None, whole: bool = True) -> Column:
    """A long gold result (label, value) against a prediction in another layout. whole: no cell of it may be left over."""
    kinds = kinds or Kinds()

    def same(g: Column, p: Column) -> Column:
        return label_of(F.get(g, F.lit(label)), entity).eqNullSafe(p["label"]) & kinds.same(F.lit(value), F.get(g, F.lit(value)), cell(p["num"]))

    def all_found(found: Column) -> Column:
        ok = (F.size(found["pairs"]) > 0) & _both_ways(gold, found["pairs"], same)
        return ok & (found["left"] == 0) if whole else ok

    return F.coalesce(let(labelled(gold, label, entity, columns, pred, words), all_found), F.lit(False))
