"""The auditor over a table of answers against the auditor of one answer."""

import random
from collections import Counter
from decimal import Decimal

from martwright.operators import audit

TEXTS = ["It came to {a}.", "About {r} in all, {p}% more.", "FY{y} had {n} rows.", "Q3 and H1 were {a} million.", "{q}", "nothing", "Since {y2}-03-04 it was {m} billion.", "twenty-five percent", "about three hundred thousand", "It fell by {d} to {a}, or {s}.", "7 rows", "{y2} or FY26"]
YEARS = {1: {2024, 2025}, 2: {2023}}


def test_tables_against_single_answers(spark):
    rng = random.Random(4)
    rows, want = [], []
    for k in range(600):
        numbers = [rng.choice([Decimal(rng.randrange(-10**6, 10**9)).scaleb(-2), Decimal(rng.randrange(100)), Decimal("0.125"), Decimal("2.5"), Decimal(2024), Decimal(25)]) for _ in range(rng.randrange(0, 5))]
        strings = rng.choice([["Q3 2024"], [], ["north", None], ["2025"]])
        a, b = (numbers * 2 + [Decimal(3), Decimal(8)])[:2]
        text = rng.choice(TEXTS).format(a=rng.choice([a, f"{a:,.2f}", f"{a:.0f}", f"{a:.1f}"]), r=f"{round(a, -3):,}", p=round(b), y=rng.randrange(2022, 2028), y2=rng.randrange(2022, 2028), n=rng.randrange(1, 4), q=f"{a + b:.2f}", m=f"{a / 10**9:.2f}", d=f"{a - b:.2f}", s=f"{float(a) / float(b or 1):.3f}")
        n_rows, sql, company = rng.randrange(1, 8), rng.choice([None, "SELECT 2023, 'H1'"]), rng.choice([1, 2, 3, None])
        rows.append((k, text, numbers, strings, n_rows, sql, company))
        known = audit.Known(frozenset(YEARS.get(company, ())), frozenset({2023, 2024, 2025}), company is None)
        result = [(*numbers, *(s for s in strings if s))] + [()] * (n_rows - 1)
        want += [(k, c, t) for c, t in audit.audit(text, [], result, sql, known)]
    answers = spark.createDataFrame(rows, "id int, text string, numbers array<decimal(20,4)>, strings array<string>, n int, sql string, company int").repartition(3)
    labels = spark.createDataFrame([(c, y) for c, ys in YEARS.items() for y in ys] + [(None, 2024), (1, None)], "cik int, year int")
    got = [tuple(r) for r in audit.tiers(answers, "id", "text", "numbers", "strings", "n", "sql", "company", labels).collect()]
    assert Counter(got) == Counter(want)
    assert all(Counter(t for _, _, t in got)[t] >= 10 for t in audit.TIERS)
    assert audit.tiers(answers.limit(0), "id", "text", "numbers", "strings", "n", "sql", "company", labels).count() == 0
