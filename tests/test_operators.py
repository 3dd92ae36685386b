"""Comparators, joins, metrics, sources and streams on small tables, and the whole catalogue's registration."""

import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from martwright.operators import aggregates, compare, joins, metrics, voting
from martwright.sources import filings, logs
from martwright.streaming import windows

CASE = compare.Case()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_comparators():
    gold = [("a", 1.0), ("b", 2.0)]
    assert compare.strict(CASE, gold, [("b", 2.0 + 1e-9), ("a", 1.0), ("a", 1.0)]) and not compare.strict(CASE, gold, [("a", 1.0)])
    assert not compare.strict(compare.Case("ordered"), gold, gold[::-1]) and compare.v1([(1,)], [(1.0000001,)], "scalar")
    assert compare.v1([], [(None,)], "scalar_or_null") and compare.v1([], [], "empty") and compare.v1([(1,)], [(9,)], "count") and compare.v1([], [(3,)], "none")
    who = compare.Entities([(7, "T7", "Seven Inc")])
    assert compare.strict(compare.Case(entities=frozenset({0})), [("T7", 1)], [("Seven Inc", 1)], who) and not compare.strict(CASE, [("T7", 1)], [(7, 1)], who)
    assert compare.strict(compare.Case(ratios=frozenset({0})), [(0.172,)], [(17.2,)]) and compare.strict(compare.Case(scales={0: 1e9}), [(416e9,)], [(416,)])
    assert compare.relaxed(CASE, gold, [(9, 1.0, "a"), (9, 2.0, "b")]) and not compare.relaxed(CASE, gold, [(9, 2.0, "a"), (9, 1.0, "b")])
    assert compare.pivot(CASE, gold, ["total_a", "total_b"], [(1.0, 2.0)]) and compare.match(CASE, [("z", 1)], gold, alternatives=[gold])
    assert compare.pivot(CASE, gold, None, [("a", 1.0, "b", 2.0)]) and compare.pivot(CASE, gold, None, [(1.0, "a", 2.0, "b")]) and not compare.pivot(CASE, gold, ["total_a", "total_b"], [(1.0, 3.0)])
    assert not compare.pivot(CASE, gold, ["a", "b", "year"], [(1.0, 2.0, 1997.0)]) and compare.pivot(CASE, gold, ["a", "b", "year"], [(1.0, 2.0, 1997.0)], mode="relaxed")
    who = compare.Entities([(1, "AA", "Alpha Co"), (2, "BB", "Beta")])
    by_name, entity = [("AA", 5.0), ("BB", 6.0)], compare.Pivot(entity=True)
    assert compare.pivot(CASE, by_name, ["alpha_co_total", "BB"], [(5.0, 6.0)], entity, who) and compare.pivot(CASE, by_name, None, [("Beta", 6.0), (1, 5.0)], entity, who)
    assert not compare.pivot(CASE, by_name, ["aa", "aa_bb"], [(5.0, 6.0)], entity, who) and compare.match(CASE, by_name, [(5.0, 6.0)], who, pred_cols=["AA", "BB"], how=entity)
    assert compare.float_equal([(1.0, None), (2.0, "x")], [(2.0 + 1e-9, "x"), (1.0, None)]) and not compare.float_equal([(1,)], [(1,), (1,)])
    assert compare.near(None, None, 0.1) and not compare.near(None, 1, 0.1) and not compare.near(True, 2, 5)


def test_joins(spark):
    left = spark.createDataFrame([("k", 5, 1), ("k", 1, 2), ("z", 9, 3)], "key string, at int, l int")
    right = spark.createDataFrame([("k", 2, 10), ("k", 5, 11), ("k", 7, 12)], "key string, at int, r int")
    assert [(x.l, x.r) for x in joins.as_of(left, right, "key", "at", "l", "r").collect()] == [(1, 11)]
    m = spark.createDataFrame([("ab",), ("a",)], "m string")
    n = spark.createDataFrame([(1, "abc"), (2, "axe")], "id int, name string")
    assert [(x.m, x.id) for x in joins.unique_prefix(m, "m", n, "name").collect()] == [("ab", 1)]
    g = spark.createDataFrame([("a", None), ("b", 1.0)], "k string, v double")
    assert {x.k: x.matched for x in joins.matched_within(g, g, ["k"], "v", 1e-6).collect()} == {"a": True, "b": True}
    far = spark.createDataFrame([("b", 1.1)], "k string, v double")
    assert {x.k: x.matched for x in joins.matched_within(g, far, ["k"], "v", 1e-6).collect()} == {"a": False, "b": False}


def area(pos, neg):
    """AUROC by all pairs, ties half."""
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_bootstrap_intervals(spark):
    """Against resamples drawn plainly, with replacement, by another generator; and the same from other partitions."""
    import random

    rng = random.Random(4)
    data = [(g, round(rng.gauss(0.1 * y, 0.3), 2), y) for g in "ab" for y in [int(rng.random() < 0.4) for _ in range(400)]] + [("c", 0.5, 1), ("c", None, 0)]
    df = spark.createDataFrame(data, "name string, s double, y int")
    means = {r.name: r for r in aggregates.bootstrap_mean(df, "name", "s").collect()}
    areas = {r.name: r for r in aggregates.bootstrap_auroc(df, "name", "s", "y").collect()}
    for r in aggregates.bootstrap_mean(df.repartition(7), "name", "s").collect():
        assert tuple(r)[1:] == pytest.approx(tuple(means[r.name])[1:])
    for r in aggregates.bootstrap_auroc(df.repartition(3), "name", "s", "y").where("name <> 'c'").collect():
        assert tuple(r)[1:] == pytest.approx(tuple(areas[r.name])[1:])
    for g in "ab":
        own = [(s, y) for n, s, y in data if n == g]
        plain = sorted(sum(s for s, _ in rng.choices(own, k=len(own))) / len(own) for _ in range(500))
        assert means[g].mean == pytest.approx(sum(s for s, _ in own) / len(own))
        assert abs(means[g].low - plain[12]) < 0.02 and abs(means[g].high - plain[487]) < 0.02
        pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
        some = sorted(area(rng.choices(pos, k=len(pos)), rng.choices(neg, k=len(neg))) for _ in range(100))
        assert areas[g].auroc == pytest.approx(area(pos, neg)) and abs(areas[g].low - some[2]) < 0.04 and abs(areas[g].high - some[97]) < 0.04
    assert areas["c"].auroc is None and means["c"].mean == 0.5


def test_overlaps_of_a_busy_node(spark):
    import random

    rng = random.Random(2)
    rows = [(k, "n", a, a + rng.choice([0, 1, 50, 9_000])) for k in range(80) for a in [rng.randrange(20_000)]]
    df = spark.createDataFrame(rows, "id int, node string, a long, b long")
    got = {(r.id_a, r.id_b): r.seconds for r in joins.overlaps(df, "id", "node", "a", "b").collect()}
    want = {(x[0], y[0]): min(x[3], y[3]) - max(x[2], y[2]) for x in rows for y in rows if x[0] < y[0] and x[2] < y[3] and y[2] < x[3]}
    assert got == want and len(got) > 100


def test_derived_numbers_take_the_first_forty(spark):
    cells = spark.createDataFrame([("r", k, float(2**k if k < 41 else 3)) for k in range(50)] + [("r", 99, 1.0), ("s", 0, 0.0), ("s", 1, 5.0)], "r string, k int, v double")
    claims = spark.createDataFrame([("r", 3.0), ("r", -1.0), ("r", float(2**40 + 1)), ("s", 5.0), ("s", 0.0), ("s", -100.0)], "r string, claim double")
    got = {(x.r, x.claim, x.form, x.a, x.b) for x in joins.derived(cells, claims, "r", "k", "v", "claim", 1e-9).collect()}
    assert got == {("r", 3.0, "a+b", 1.0, 2.0), ("r", 3.0, "a-b", 4.0, 1.0), ("r", -1.0, "a-b", 1.0, 2.0), ("s", 5.0, "a+b", 0.0, 5.0), ("s", 5.0, "a-b", 5.0, 0.0), ("s", 0.0, "a/b", 0.0, 5.0), ("s", 0.0, "100a/b", 0.0, 5.0), ("s", -100.0, "100(a-b)/b", 0.0, 5.0)}


def test_as_of_in_stretches(spark):
    import datetime as dt
    import random

    rng, day = random.Random(5), dt.datetime(2024, 1, 1)
    at = lambda: day + dt.timedelta(hours=rng.randrange(24 * 400))
    left = spark.createDataFrame([(k, "h" if k % 3 else "c", at()) for k in range(200)], "l int, key string, at timestamp")
    right = spark.createDataFrame([(k, "h" if k % 3 else "c", at()) for k in range(60)], "r int, key string, at timestamp")
    whole, cut = (sorted((x.l, x.r) for x in joins.as_of(left, right, "key", "at", "l", "r", days).collect()) for days in (None, 30))
    assert whole == cut and len(whole) > 150


def test_pairs_of_cells(spark):
    rows = [(0, ["a", 1.0, 2.0, "b"]), (1, [1.0, "a", 2.0, "b"]), (2, ["a", "b", 1.0, 2.0]), (3, []), (4, [None, 3.0]), (5, [1.0, "a", 2.0]), (6, ["a", 1.0, "b", 2.0])]
    cells = [(k, [{"label": c if isinstance(c, str) else None, "value": c if isinstance(c, float) else None} for c in row]) for k, row in rows]
    df = spark.createDataFrame(cells, "k int, cells array<struct<label:string,value:double>>")
    got = {r.k: [(p.label, p.value) for p in r.p] for r in df.select("k", joins.paired_cells(F.col("cells")).alias("p")).collect()}
    assert got == {0: [("a", 1.0), ("b", 2.0)], 1: [("a", 1.0), ("b", 2.0)], 2: [("b", 1.0)], 3: [], 4: [], 5: [("a", 1.0)], 6: [("a", 1.0), ("b", 2.0)]}


def test_cases_keep_the_first_line(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text("".join(f'{{"id": "c{k % 3}", "n": {k}}}\n' for k in range(30)))
    assert sorted((r.id, r.n) for r in logs.keyed(spark, str(path)).collect()) == [("c0", 0), ("c1", 1), ("c2", 2)]


def test_lookups_drop_no_rows(spark):
    from martwright.plans import shape
    from martwright.service import execute

    spark.range(1_500).selectExpr("id AS cik", "concat('T', id) AS ticker", "concat('Name ', id) AS name").createOrReplaceTempView("companies")
    assert shape.resolved(spark, shape.CompanyRefs(patterns={"name%"})).count() == 1_500
    assert len(execute.lookup(spark, "SELECT id FROM range(20000)")) == 20_000 and execute.lookup(spark, "SELECT nothing") == []
    with pytest.raises(ValueError):
        execute.lookup(spark, "SELECT id FROM range(200000)")


def test_sets_are_equal_both_ways(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 1.0), ("y", None)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0000001), ("y", None)], "k string, v double")
    more = b.unionByName(spark.createDataFrame([("z", 2.0)], "k string, v double"))
    assert joins.sets_equal(a, b, ["k"], "v", 1e-6).first()["equal"] and not joins.sets_equal(a, more, ["k"], "v", 1e-6).first()["equal"]


def test_auroc_and_bootstrap(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "s double, y int")
    assert aggregates.auroc(df, "s", F.col("y") == 1).first().auroc == pytest.approx(area([0.35, 0.8, 0.4], [0.1, 0.4]))
    assert aggregates.auroc(df.where("y = 1"), "s", F.col("y") == 1).first().auroc is None
    row = aggregates.bootstrap_mean(df.withColumn("name", F.lit("x")), "name", "s").first()
    assert row.low <= row.mean <= row.high


def test_vote_frame_equals_vote_list(spark):
    import random

    rng, rows, want = random.Random(1), [], {}
    for case in range(60):
        made = []
        for i in range(5):
            key = rng.choice([None, "p", "q", "r"])
            why = rng.choice(["EXEC_ERROR", "COST_LIMIT", None]) if key is None else None
            rows.append((case, i, key, why))
            made.append(voting.Candidate(str(i), key is not None, why, rows=None if key is None else [(key,)]))
        v = voting.settle(made)
        want[case] = (v.winner, v.agreement)
    got = {r.case_id: (r.winner_idx, r.agreement) for r in voting.vote(spark.createDataFrame(rows, "case_id int, idx int, key string, reason_code string")).collect()}
    assert got == want


def test_metrics_on_nothing(spark):
    none = spark.createDataFrame([], "expected string, state string, code string, accepted array<string>")
    assert metrics.abstain(none).first().precision == 0.0 and metrics.decide((0.1, 0.2), (-0.1, 0.2), (0.1, 0.05)) == "on" and metrics.decide((0.1, 0.2), (-0.3, -0.2), (0.1, -0.2)) == "off"


def test_archives(spark, tmp_path):
    num = 'adsh\ttag\tversion\tddate\tqtrs\tuom\tsegments\tcoreg\tvalue\tfootnote\n' + "\n".join(["a1\tRevenue\tv\t20241231\t4\tUSD\t\t\t5.5\t\"odd", "a1\tRevenue\tv\t20241231\t4\tUSD\t\t\t\t", "a1\tRevenue\tv\t20241231\tx\tUSD\t\t\t1\t", "a1\tRevenue\tv\t20241231\t4\tUSD\tseg\t\t9\t"])
    sub = "adsh\tcik\tname\tsic\tform\tperiod\tfy\tfp\tfiled\na1\t12\tA\t1\t10-K\t20241231\t2024\tFY\t20250101\na2\tbad\tB\t1\t10-K\t20241231\t2024\tFY\t20250101\na3\t99\tC\t1\t10-K/A\t20241231\t2024\tFY\t20250101\n"
    with zipfile.ZipFile(tmp_path / "2025q1.zip", "w") as z:
        z.writestr("num.txt", num)
        z.writestr("sub.txt", sub)
    n = filings.members(spark, str(tmp_path), "num.txt", [c.split()[0] for c in filings.NUM.split(", ")])
    typed = filings.typed_num(n)
    assert filings.stats(typed).first().asDict() == {"rows": 3, "null_values": 1, "skipped": 1} and n.first().quarter == "2025q1"
    s = filings.registrants(filings.members(spark, str(tmp_path), "sub.txt", [c.split()[0] for c in filings.SUB.split(", ")]), spark.createDataFrame([(12,)], "cik int"))
    facts = filings.annual_facts(s, typed.where("NOT bad")).collect()
    assert sorted((f.cik, f.value) for f in facts if f.value) == [(12, 5.5)] and len(facts) == 2
    out = str(tmp_path / "staged")
    for _ in range(2):
        filings.replace_partitions(n, out)
    assert spark.read.parquet(out).count() == 4
    (tmp_path / "t.txt").write_text(num)
    assert filings.tsv(spark, str(tmp_path / "t.txt"), filings.NUM).first().footnote == '"odd'
    filings.snapshot({"n": n}, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap/n")).count() == 4


def test_fetch(tmp_path):
    import io

    calls = []

    def source(quarter, broken=False):
        calls.append(quarter)
        if broken:
            raise OSError("no network")
        return io.BytesIO(b"zip")

    assert filings.quarters("2024q3", 4) == ["2024q3", "2024q4", "2025q1", "2025q2"]
    with pytest.raises(OSError):
        filings.fetch("2024q3", str(tmp_path), lambda q: source(q, True))
    assert not list(tmp_path.iterdir())
    for _ in range(2):
        assert filings.fetch("2024q3", str(tmp_path), source).read_bytes() == b"zip"
    assert len(calls) == 2


def test_logs_and_html(spark, tmp_path):
    (tmp_path / "j.txt").write_text("JobID|JobName|NodeList|Start|End|State|ExitCode\n1|run-30b|n1|2025-01-01T00:00:00|2025-01-01T01:00:00|DONE|0\n1.batch|x|n1|Unknown|Unknown|DONE|0\n2|xyz|n1|Unknown|2025-01-01T00:30:00|DONE|0\n")
    rows = logs.jobs(spark, str(tmp_path / "j.txt")).collect()
    assert [(r.JobID, r.model, r.Start is None) for r in rows] == [("1", "30b", False), ("2", "other", True)]
    assert logs.table_rows("<table><tr><th>a<td>b </tr><tr><td>c</td></tr></table>")[1] == ["c"]
    logs.append_records(spark.createDataFrame([("1", "x")], "id string, reason_code string"), str(tmp_path / "log"))
    logs.append_records(spark.createDataFrame([("2", None)], "id string, reason_code string"), str(tmp_path / "log"))
    assert logs.records(spark, str(tmp_path / "log")).count() == 2


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id":"1","timestamp":"2025-01-01T00:01:00Z","reason_code":"NO_DATA"}\n{"id":"2","timestamp":"2025-01-01T02:00:00Z","reason_code":"NO_DATA"}\n{"id":"3","timestamp":"2025-01-01T02:01:00Z"}\n')
    stream = windows.reasons(windows.audit_stream(spark, str(tmp_path / "in")))
    for _ in range(2):
        windows.write_available(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    (row,) = spark.read.parquet(str(tmp_path / "out")).collect()  # the second window is still open behind the watermark
    assert (row.reason_code, row.n) == ("NO_DATA", 1)


def test_entry_and_catalogue(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


SAMPLE = ["flagship_top_revenue", "w01_concept_priority", "j16_interval_overlap", "jx_asof_latest", "a22_auroc", "w03_vote_winner", "m04_pass_at_n", "g01_ground", "k3_session", "wide2_q4"]


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    rows = sorted(repr(dict(sorted(zip(names, r, strict=True)))) for r in want.fetchall())
    assert rows == sorted(repr(dict(sorted(r.asDict().items()))) for r in entry.queries()[name](spark, small).collect())
