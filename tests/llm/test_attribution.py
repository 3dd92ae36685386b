"""Attribution against a plain walk through the batches, with hot clients, ties, late, repeated and broken rows."""

import random
import zlib
from datetime import datetime, timedelta

import pytest

from martwright.llm import attribution as at

T0 = datetime(2024, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, Client string"


def micros(t):
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def by_definition(clicks, sales, batches=12):
    own = {}
    for number, ts, arrived, client, *_ in clicks:
        if ts is not None and client is not None:
            own.setdefault(number, (micros(arrived or ts), micros(ts), client))
    hour = lambda number, us: us // 3_600_000_000 + (240 if zlib.crc32(str(number).encode()) % 4 == 0 else 0)
    h = {n: hour(n, a) for n, (a, _, _) in own.items()}
    low, high = (min(h.values()), max(h.values())) if h else (0, 0)
    cut = lambda x: max(0, min(batches - 1, batches * (x - low) // (high - low + 1)))
    c_in = {n: cut(x) for n, x in h.items()}
    live = [(n, c, micros(sold), cut(hour(n, micros(arrived or sold)))) for n, c, sold, arrived, *_ in sales if c is not None and sold is not None]
    buffered, waiting, out, most_c, most_s = [], [], [], None, None

    def closed(sale, batch):
        n, client, sold, _ = sale
        hit = [(t, -k) for k, t, c in buffered if c == client and sold - at.LOOK_BACK <= t <= sold]
        return (n, batch, False, -max(hit)[1] if hit else None, len(hit))

    for b in range(batches):
        w = min(most_c, most_s) - at.DELAY if None not in (most_c, most_s) else None
        new = [(n, t, c) for n, (_, t, c) in own.items() if c_in[n] == b]
        buffered += [x for x in new if w is None or x[1] >= w]
        for s in (s for s in live if s[3] == b):
            if w is not None and s[2] < w:
                out.append((s[0], b, True, None, 0))
            else:
                waiting.append(s)
        if w is not None:
            out += [closed(s, b) for s in waiting if s[2] < w]
            waiting = [s for s in waiting if s[2] >= w]
            buffered = [x for x in buffered if x[1] >= w - at.LOOK_BACK]
        most_c = max([x[1] for x in new] + ([most_c] if most_c is not None else []), default=None)
        most_s = max([s[2] for s in live if s[3] == b] + ([most_s] if most_s is not None else []), default=None)
    return sorted([*out, *(closed(s, batches) for s in waiting)], key=str)


def run(spark, clicks, sales, **options):
    made = at.attribute(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(sales, SALES), **options)
    return sorted((tuple(r) for r in made.collect()), key=str)


@pytest.fixture(scope="module")
def shop():
    rng = random.Random(3)
    moment = lambda: T0 + timedelta(microseconds=rng.randrange(60 * at.DAY))
    client = lambda: rng.choice([7, 7, 7, *range(12), None])
    clicks, sales = [], []
    for n in range(2500):
        t = moment() if rng.random() < 0.9 or not clicks else clicks[-1][1]  # ties
        clicks.append((n, t, t + timedelta(minutes=rng.randrange(600)) if t else None, client(), "view"))
    for n in range(1200):
        t = moment() if rng.random() < 0.8 else rng.choice(clicks)[1]  # a click at the very moment of a sale
        late = timedelta(days=rng.choice([0, 0, 0, 9]), seconds=rng.randrange(9000))
        sales.append((n, client(), t, t + late, "x"))
    days = [(5000 + k, T0 + timedelta(days=k), T0 + timedelta(days=k), 3, "view") for k in range(60)]  # at the edges of pages
    sales += [(9000 + k, 3, T0 + timedelta(days=k + 7), T0 + timedelta(days=k + 7), "x") for k in range(50)]
    clicks += days + rng.sample(clicks, 50) + [(7777, None, T0, 3, "view"), (7778, T0 + timedelta(days=30), None, 3, "view")]
    sales += [sales[5], sales[5], (9999, 3, None, T0, "x"), (9998, None, T0, T0, "x"), (-4, 3, T0 - timedelta(days=400), T0, "x"), (-5, 3, T0 + timedelta(days=400), T0 + timedelta(days=400), None)]
    return clicks, sales


def test_by_definition(spark, shop):
    got = run(spark, *shop, buckets=16)  # client 7 has a third of the rows: dealt over cells
    assert got == by_definition(*shop)
    assert {b for _, b, *_ in got} >= {3, 6, 12} and any(late for _, _, late, *_ in got)


def test_hot_client_is_dealt_evenly(spark):
    rows = spark.range(3000).selectExpr("cast(id % 3 > 0 as int) AS kind", "if(id % 2 = 0, 7L, id + 10000) AS client", "id AS t", "id", "id AS row", "0 AS batch")
    made = at.dealt(rows, 64, 3000)
    assert made.where("client = 7 and kind = 0").groupBy("id").count().select("count").distinct().count() == 1
    by = [r["count"] for r in made.where("client = 7").groupBy("bucket").count().collect()]
    assert len(by) >= 49 and max(by) <= 3 * min(by)
    a = made.where("client = 7 and kind = 0").select("id", "bucket").withColumnRenamed("id", "a")
    met = a.join(made.where("client = 7 and kind = 1").select("id", "bucket"), "bucket").groupBy("a", "id").count()
    assert met.where("count > 1").isEmpty() and met.count() == 500 * 1000  # each click and sale meet in one cell


def test_empty_tables(spark, shop):
    clicks, sales = shop
    assert run(spark, clicks[:40], [], batches=2, buckets=2) == []
    got = run(spark, [], sales[:30], batches=2, buckets=2)
    assert got == by_definition([], sales[:30], 2) and {r[1] for r in got} == {2}


def test_pages():
    import numpy as np

    page = at.page_of(np.array([5, 2, 5, 5]), np.array([30, 10, 20, 30]), np.array([9, 1, 4, 3]))
    assert [x.tolist() for x in page] == [[2, 5], [0, 1, 4], [10, 20, 30, 30], [1, 4, 9, 3]]
    n, last = at.within(page, 0, np.array([5, 5, 2, 3, 9]), np.array([20, 21, 11, 0, 0]), np.array([30, 29, 50, 50, 50]))
    assert n.tolist() == [3, 0, 0, 0, 0] and page[3][last[0]] == 3
