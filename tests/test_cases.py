"""Comparators on tables of cases against the comparators for one case, on random small results."""

import random

import pytest

from martwright.operators import cases, compare
from pyspark.sql import functions as F

COMPANIES = [(1, "AA", "Alpha Co"), (2, "BB", "Beta Co"), (3, "CC", "Gamma Co")]
SCHEMA = f"id int, gold array<array<{cases.CELL}>>, pred array<array<{cases.CELL}>>, gc array<string>, pc array<string>, mode string, entities array<int>, ratios array<int>, scales map<int,double>"


def cells(who, rows):
    def one(c):
        found = who.resolve(c)
        return (float(c), None, found and found[0]) if compare.is_number(c) else (None, c, found and found[0])

    return None if rows is None else [[one(c) for c in r] for r in rows]


def some_results(rng, n):
    values = [5.0, 5.0000001, 500.0, 0.05, 5.2, 0.0, 1e-10, 1.0, "AA", "Alpha Co", "BB", "x", "y", None, 7.0]
    for _ in range(n):
        wide, long = rng.randrange(1, 4), rng.randrange(0, 4)
        gold = [[rng.choice(values) for _ in range(wide)] for _ in range(long)]
        kind = rng.randrange(6)
        if kind == 0:
            pred = [[rng.choice(values) for _ in range(rng.choice([wide, wide + 1]))] for _ in range(rng.randrange(0, 4))]
            pred = [r for r in pred if len(r) == len(pred[0])]
        else:
            order = rng.sample(range(wide), wide)
            pred = [[r[j] for j in order] for r in gold] if kind > 2 else [list(r) for r in gold]
            if kind > 3:
                pred = [[rng.choice(values), *r, 1997.0] for r in pred]
            pred = [[c * (1 + 1e-8) if compare.is_number(c) and rng.random() < 0.3 else c for c in r] for r in pred]
            rng.shuffle(pred)
            if pred and rng.random() < 0.3:
                pred.append(list(pred[0]))
        yield gold, pred


@pytest.fixture(scope="module")
def both(spark):
    rng, who = random.Random(1), compare.Entities(COMPANIES)
    rows, plain = [], []
    for k, (gold, pred) in enumerate(some_results(rng, 700)):
        wide = len(gold[0]) if gold else 1
        pick = lambda: frozenset(i for i in range(wide) if rng.random() < 0.3)
        case = compare.Case(entities=pick(), ratios=pick(), scales={i: 1000.0 for i in pick()} if rng.random() < 0.3 else {})
        case = compare.Case(entities=case.entities, ratios=case.ratios, scales={i: f for i, f in case.scales.items() if i not in case.ratios and i not in case.entities})
        names = lambda rs, n: rng.sample(["fiscal_year", "Ticker", "v", "w", "uom"], len(rs[0]) if rs else n)
        gc, pc = names(gold, 1), names(pred, 1)
        mode = rng.choice(["none", "empty", "count", "scalar", "scalar_or_null", "set", "ordered"])
        plain.append((case, gold, pred, gc, pc, mode))
        rows.append((k, cells(who, gold), cells(who, pred), gc, pc, mode, sorted(case.entities), sorted(case.ratios), case.scales))
    return plain, spark.createDataFrame(rows, SCHEMA).repartition(3), who


def test_against_single_cases(both):
    plain, frame, who = both
    kinds = cases.Kinds(entities=F.col("entities"), ratios=F.col("ratios"), scales=F.col("scales"))
    g, p = F.col("gold"), F.col("pred")
    made = frame.select(
        "id", cases.strict(g, p, kinds).alias("strict"), cases.strict(g, p, kinds, ordered=True).alias("ordered"), cases.relaxed(g, p, kinds).alias("relaxed"),
        cases.without_context(F.col("gc"), g, F.col("pc"), p).alias("context"), cases.v1(g, p, F.col("mode")).alias("v1"), cases.float_equal(g, p).alias("float"),
        cases.any_of(F.array(g, F.transform(g, lambda r: F.slice(r, 1, 1))), p, cases.relaxed).alias("any"),
    ).collect()
    counts = {c: 0 for c in made[0].asDict() if c != "id"}
    for r in made:
        case, gold, pred, gc, pc, mode = plain[r["id"]]
        bare = compare.Case()
        in_order = compare.Case("ordered", entities=case.entities, ratios=case.ratios, scales=case.scales)
        want = {
            "strict": compare.strict(case, gold, pred, who), "ordered": compare.strict(in_order, gold, pred, who), "relaxed": compare.relaxed(case, gold, pred, who),
            "context": compare.without_context(bare, gc, gold, pc, pred), "v1": compare.v1(gold, pred, mode), "float": compare.float_equal(gold, pred),
            "any": compare.match(bare, gold, pred, None, "relaxed", alternatives=[[x[:1] for x in gold]]),
        }
        assert {c: r[c] for c in want} == want, (gold, pred, case, mode)
        for c, x in want.items():
            counts[c] += x
    assert all(40 < n < 660 for n in counts.values()), counts


def test_wide_predictions_and_twins(spark):
    wide = [[float(i), float(j % 2), *[9.0] * 30, "z"] for j, i in enumerate(range(6))]
    gold = [[9.0, r[-1], 9.0, r[0], 9.0] for r in wide]
    frame = spark.createDataFrame([(cells(compare.Entities([]), gold), cells(compare.Entities([]), wide[::-1]))], f"g array<array<{cases.CELL}>>, p array<array<{cases.CELL}>>")
    assert frame.select(cases.relaxed(F.col("g"), F.col("p")).alias("r"), cases.assignments(F.col("g"), F.col("p")).alias("a")).collect()[0] == (True, [[2, 32, 3, 0, 4]])
    assert not frame.select(cases.relaxed(F.col("p"), F.col("g")).alias("r")).first()[0]


def test_nulls_and_empty(spark):
    frame = spark.createDataFrame([(None, []), ([], []), ([], None), ([[(1.0, None, None)]], None)], f"g array<array<{cases.CELL}>>, p array<array<{cases.CELL}>>")
    got = frame.select(cases.strict(F.col("g"), F.col("p")).alias("s"), cases.relaxed(F.col("g"), F.col("p")).alias("r"), cases.float_equal(F.col("g"), F.col("p")).alias("f")).collect()
    assert [tuple(r) for r in got] == [(False,) * 3, (True,) * 3, (False,) * 3, (False,) * 3]


def test_pivot_against_single_cases(spark):
    rng, who = random.Random(8), compare.Entities(COMPANIES)
    rows, plain = [], []
    for k in range(500):
        entity = rng.random() < 0.5
        names = ["AA", "BB", "Gamma Co"] if entity else ["north", "south east", "q1"]
        gold = [[x, round(rng.uniform(1, 99), 2)] for x in rng.sample(names, rng.randrange(1, 4))]
        shape = rng.randrange(6)
        value = lambda v: v if rng.random() < 0.9 else v + 1
        if shape == 0:
            columns, pred = ["label", "v"], [[x, value(v)] for x, v in gold]
        elif shape == 1:
            columns, pred = [f"revenue_{x.replace(' ', '_')}" for x, _ in gold], [[value(v) for _, v in gold]]
        elif shape == 2:
            columns, pred = ["c"] * (2 * len(gold)), [[c for x, v in gold for c in (x, value(v))]]
        elif shape == 3:
            columns, pred = ["v", "label"], [[value(v), x] for x, v in gold]
        elif shape == 4:
            columns, pred = ["label", "v", "more"], [[x, value(v), "left"] for x, v in gold]
        else:
            columns, pred = ["a", "b", "c"], [[gold[0][0], 0.5, gold[0][1]], []]
        plain.append((gold, columns, pred, entity))
        words = [(str(c), w) for c, t, n in COMPANIES for w in (t, n)] if entity else None
        rows.append((k, cells(who, gold), cells(who, pred), columns, entity, words))
    schema = f"id int, gold array<array<{cases.CELL}>>, pred array<array<{cases.CELL}>>, columns array<string>, entity boolean, words array<struct<label:string,word:string>>"
    frame = spark.createDataFrame(rows, schema)
    seen = set()
    for entity in (False, True):
        words = F.col("words") if entity else None
        made = frame.where(F.col("entity") == entity).select("id", *(cases.pivot(F.col("gold"), F.col("columns"), F.col("pred"), entity=entity, words=words, whole=w).alias(n) for n, w in (("whole", True), ("part", False))))
        for r in made.collect():
            gold, columns, pred, _ = plain[r["id"]]
            want = [compare.pivot(compare.Case(), gold, columns, pred, compare.Pivot(entity=entity), who, m) for m in ("strict", "relaxed")]
            assert [r["whole"], r["part"]] == want, (gold, columns, pred)
            seen.add((r["whole"], r["part"]))
    assert seen == {(True, True), (False, True), (False, False)}


def test_packed_and_known(spark):
    rows = [(1, r, c, n, t) for r, line in enumerate([[("AA", None), (None, 2.0)], [("Beta Co", None), (None, None)], [("twice", None), (None, 0.5)]]) for c, (t, n) in enumerate(line)]
    rows += [(2, 0, 0, None, "one")]
    companies = spark.createDataFrame([*COMPANIES, (4, "T1", "twice"), (5, "T2", "twice"), (None, None, None)], "cik long, ticker string, name string")
    frame = spark.createDataFrame(rows, "case int, row int, col int, num double, txt string").repartition(3)
    made = cases.packed(cases.known(frame, companies), ["case"], who="who")
    got = {r["case"]: [[tuple(c) for c in line] for line in r["rows"]] for r in made.collect()}
    assert got[1] == [[(None, "AA", 1), (2.0, None, 2)], [(None, "Beta Co", 2), (None, None, None)], [(None, "twice", None), (0.5, None, None)]]
    assert got[2] == [[(None, "one", None)]]
