"""Selection, sweeps, beginnings and fingerprints against plain Python."""

import random
import statistics
from collections import Counter

import pytest

from martwright.functions import names as nm
from martwright.operators import joins, prefixes, ranges, voting
from pyspark.sql import functions as F


@pytest.mark.parametrize("few", [1, 7, 50_000])
def test_median(spark, few):
    rng = random.Random(few)
    rows = [(g, h, x) for g in ("a", None, "c") for h in (1, 2) for x in [*(rng.choice([rng.uniform(-5, 5), 2.0, 1e300, -1e-300, None]) for _ in range(rng.randrange(1, 300))), None]]
    rows += [("one", 1, 4.0), ("two", 1, 4.0), ("two", 1, 7.0), ("none", 1, None), *[("same", 1, 3.0)] * 90, ("same", 1, 9.0)]
    frame = spark.createDataFrame(rows, "g string, h int, x double").repartition(4)
    want: dict = {}
    for g, h, x in rows:
        if x is not None:
            want.setdefault((g, h), []).append(x)
    got = {(r.g, r.h): r.m for r in ranges.median(frame, ["g", "h"], "x", "m", ranges=8, few=few).collect()}
    assert got == {k: pytest.approx(statistics.median(v)) for k, v in want.items()}
    assert ranges.median(frame, [], "x", "m", ranges=8, few=few).first().m == pytest.approx(statistics.median([x for _, _, x in rows if x is not None]))
    assert ranges.median(frame.limit(0), ["g"], "x").collect() == []


def test_overlaps(spark):
    rng = random.Random(2)
    rows = []
    for k in range(600):
        a = rng.randrange(400)
        rows.append((k, rng.choice(["x", "x", "x", "y", None]), a, a + rng.choice([0, 0, 1, 5, 30, 390, -3])))
    rows += [(9000, "x", 0, None), (9001, "x", None, 5)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "id long, node string, a long, b long").repartition(3)
    live = [r for r in rows if None not in r and r[2] <= r[3]]
    want = Counter((min(i, j), max(i, j), min(b, d) - max(a, c)) for i, m, a, b in live for j, n, c, d in live if i < j and m == n and a < d and c < b)
    for n in (4, 64):
        assert Counter(map(tuple, joins.overlaps(frame, "id", "node", "a", "b", ranges=n).collect())) == want
    assert joins.overlaps(frame.limit(0), "id", "node", "a", "b").collect() == []


def test_a_long_span_among_many_short_ones(spark):
    short = spark.range(1, 100_001).selectExpr("id", "'n' AS node", "id * 2 AS a", "id * 2 + 1 AS b")
    whole = spark.createDataFrame([(0, "n", 0, 1 << 40)], "id long, node string, a long, b long")
    made = joins.overlaps(short.unionByName(whole), "id", "node", "a", "b", ranges=32)
    assert tuple(made.agg(F.count("*"), F.sum("seconds"), F.max("id_a")).first()) == (100_000, 100_000, 0)


def test_beginnings(spark):
    rng = random.Random(5)
    own = {"".join(rng.choices("abé", k=rng.randrange(1, 7))) for _ in range(300)} | {"customer0000001", "customer0000002", "customer00000021", "z"}
    frame = spark.createDataFrame([(n,) for n in own] + [(None,)], "name string").repartition(3)
    begins = {}
    for n in own:
        begins[n] = next((k for k in range(1, len(n) + 1) if sum(m.startswith(n[:k]) for m in own) == 1), len(n) + 1)
    cuts = prefixes.text_cuts(frame, "name", 16)
    assert 4 < len(cuts) < 16 and {r.name: r.unique_from for r in prefixes.beginnings(frame, "name", cuts).collect()} == begins
    rows = [*own, "aab", "aab", "twice", "twice"]
    table = spark.createDataFrame([(n,) for n in rows], "name string")
    asked = sorted({n[:k] for n in rows for k in range(1, len(n) + 1)} | {"", "zz", "nothing", "~"})
    texts = spark.createDataFrame([(t,) for t in [*asked, None, "cust"]], "said string")
    for whole_first in (False, True):
        want = {}
        for t in asked:
            hits = [n for n in rows if n.startswith(t)]
            exact = [n for n in rows if n == t]
            if t and (len(exact) == 1 if whole_first and exact else len(hits) == 1):
                want[t] = t if whole_first and exact else hits[0]
        got = {r.said: r.name for r in prefixes.resolved(texts, "said", table, "name", whole_first, cuts).collect()}
        assert got == want
    assert prefixes.resolved(texts, "said", table.limit(0), "name").collect() == [] and prefixes.text_cuts(table.limit(0), "name") == []


def test_unique_prefix_keeps_columns(spark):
    names = spark.createDataFrame([(1, "alpha"), (2, "alps"), (3, "beta")], "k int, name string")
    mentions = spark.createDataFrame([("alph", 1), ("alph", 1), ("al", 2), ("b", 3)], "said string, at int")
    assert sorted(map(tuple, joins.unique_prefix(mentions, "said", names, "name").select("said", "at", "k").collect())) == [("alph", 1, 1), ("b", 3, 3)]


def test_dictionary_has_a_row_for_each_key(spark):
    companies = spark.createDataFrame([(1, "AA", "Alpha Beta"), (2, "BB", "Alpha Beta Gamma"), (3, "CC", "Delta Force"), (4, "DD", "Delta Force")], "cik long, ticker string, name string")
    asked = spark.createDataFrame([("name", k) for k in ("alphabeta", "alphabetag", "alpha", "deltaforce", "al")], "how string, key string")
    got = {r.key: r.company.cik for r in nm.dictionary(companies, asked).where("how = 'name'").collect()}
    assert got == {"alphabeta": 1, "alphabetag": 2}


def test_fingerprints(spark):
    results = {"a": [("x", 1), ("y", None)], "b": [("y", None), ("x", 1)], "c": [("x", 1), ("x", 1), ("y", None)], "d": [("x1", None), ("y", None)], "e": [("x", 1), ("y", 1)], "f": [("2:x", 1), ("-", None)], "g": [(None, 1), ("2:x-", None)]}
    rows = [(k, *r) for k, rs in results.items() for r in rs] * 1
    random.Random(1).shuffle(rows)
    made = spark.createDataFrame(rows, "k string, s string, n int").repartition(4).groupBy("k").agg(voting.fingerprint(voting.row_text(F.col("s"), F.col("n"))).alias("print"))
    got = {r.k: r.print for r in made.collect()}
    assert got["a"] == got["b"] and len(set(got.values())) == len(results) - 1
    assert spark.range(0).agg(voting.fingerprint(F.col("id").cast("string")).alias("p")).first().p == "0-0-0-0-0"
