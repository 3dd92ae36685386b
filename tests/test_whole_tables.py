"""Queries over whole tables: against their SQL, and against brute force where there is none."""

import duckdb
import pytest

import __spark_entry__ as entry
from martwright.operators import joins
from martwright.sources import logs

TABLES = ("customer", "orders", "part", "lineitem")
WHOLE = ("s17_evidence_pack", "j11_keyed_lookup", "j19_token_classes", "j19_token_containment", "e01_link", "g02_years", "x_s10_intent", "w04_adjacent_pairs", "e09_refusal_by_data", "o07_one_per_run")
MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", WHOLE)
def test_whole_table(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{MIDDLE}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    rows = sorted(repr(dict(sorted(zip(names, r, strict=True)))) for r in want.fetchall())
    got = entry.queries()[name](spark, MIDDLE).collect()
    assert rows == sorted(repr(dict(sorted(r.asDict().items()))) for r in got)


def test_class_containment_stands_for_all_pairs(spark):
    names = ["Red bolt", "bolt, red", "red", "old red bolt", "blue", "", "blue gear old", "red red", "old"]
    rows = list(enumerate(names))
    df = spark.createDataFrame(rows, "k int, name string")
    classes = joins.word_classes(df, "k", "name")
    of = {r.k: tuple(r.words) for r in classes.collect()}
    found = {(tuple(r.small), tuple(r.large)): r.pairs for r in joins.contained_classes(classes).collect()}
    want = [(a, b) for a in of for b in of if a != b and set(of[a]) <= set(of[b])]
    assert sorted(want) == sorted((a, b) for a in of for b in of if a != b and (of[a], of[b]) in found)
    assert sum(found.values()) == len(want) and set(of) == set(range(len(names))) - {5}


def test_html_tables_over_all_pages(spark, tmp_path):
    pages = [
        (0, "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td> 2  3 </td></tr></table>", [["a", "b"], ["1", "2 3"]]),
        (150, "<script>var x='<tr><td>no</td></tr>';</script><table><tr><td>1<td>2<tr><td>3</table>", [["1", "2"], ["3"]]),
        (200, "<!-- <tr><td>x</td></tr> --><p>none</p>", []),
        (300, None, []),
    ]
    df = spark.createDataFrame([p[:2] for p in pages], "page_id long, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.n_rows for r in entry.queries()["s19_html_tables"](spark, str(tmp_path)).collect()}
    assert got == {i: len(rows) for i, _, rows in pages}
    assert {r.page_id: r.t for r in df.select("page_id", logs.html_tables(df.html).alias("t")).collect()} == {i: rows for i, _, rows in pages}
    everything = entry.queries()["s19_html_tables"](spark, MIDDLE)
    assert everything.count() == spark.read.parquet(f"{MIDDLE}/pages.parquet").count() == 250
