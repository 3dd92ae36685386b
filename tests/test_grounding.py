"""Claims, the verifier and the auditor, on sentences written around one true result."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from martwright.functions import names, numbers, patterns
from martwright.functions.claims import extract, years
from martwright.operators.audit import Known, audit
from martwright.operators import ground
from martwright.operators.ground import verify

COLUMNS, ROWS = ["ticker", "name", "fiscal_year", "value", "margin"], [("ZQX", "3M Works", 2025, 416_161_000_000.0, 0.172)]

HONEST = [
    "In 2025 it took $416.161 billion.", "Revenue came to 416.2 billion dollars.", "Revenue was $416 billion.", "Revenue was 416,161,000,000.", "About 420 billion came in.",
    "Revenue was four hundred sixteen billion.", "The margin was 17.2%.", "The margin was 0.172.", "3M Works made 416B in FY25.", "One company made $0.416 trillion.", "There is 1 company.",
    "Its 10-K says $416,161 million.", "1. Revenue was 416.16 bn.", "The margin was 17 percent.",
]
INVENTED = [
    "In 2024 it took $416.161 billion.", "Revenue came to 416.3 billion dollars.", "Revenue was $417 billion.", "420 billion came in.", "About 450 billion came in.", "About 4 billion came in.",
    "Revenue was four hundred seventeen billion.", "The margin was 17.3%.", "The margin was 18%.", "5M Works made 416B.", "There are 7 companies.", "It was $416 million.", "In FY24 it made 416B.",
    "On June 30, 2025 it closed.", "In Q3 it made 416B.", "See 0000037996-26-000015.", "391-K units were sold.", "Two point five trillion was earned.", "Revenue grew 12 percent.", "Revenue was -416 billion.",
]


@pytest.mark.parametrize("text", HONEST)
def test_honest(text):
    assert verify(text, COLUMNS, ROWS).ok, verify(text, COLUMNS, ROWS)


@pytest.mark.parametrize("text", INVENTED)
def test_invented(text):
    assert not verify(text, COLUMNS, ROWS).ok


def test_auditors_tiers():
    tier = lambda text, rows=ROWS, **more: audit(text, COLUMNS, rows, **more)[-1][1]
    assert tier("About 420 billion came in.") == "weak" and tier("It was 416.2 billion.") == "grounded" and tier("There were 1.") == "weak"
    two = [("ZQX", "3M Works", 2025, 416_161_000_000.0, 1_000_000_000.0)]
    assert tier("Together 417.161 billion.", two) == "derived" and tier("Together 42 percent.", two) == "ungrounded"
    assert tier("In 2019 it was.", known=Known(all=frozenset({2019}), open=True)) == "unresolved" and tier("In 2019 it was.", known=Known(all=frozenset({2019}))) == "ungrounded"
    assert tier("In 2019 it was.", known=Known(own=frozenset({2019}))) == "grounded"


def test_labels_dates_identifiers():
    cols, rows = ["adsh", "period", "label"], [("0000037996-26-000015", "2025-06-30", "Q3")]
    assert verify("Filing 0000037996-26-000015 for June 30, 2025 is Q3.", cols, rows).ok
    assert verify("On 30 June 2025 and 6/30/2025.", cols, rows).ok
    assert not verify("Filing 0000037996-26-00001.", cols, rows).ok and not verify("Filing 37996-26-15.", cols, rows).ok
    assert verify("On June 28.", ["v"], [(1,)], context_days=[28]).ok and not verify("On June 28.", ["v"], [(1,)]).ok


def test_scaled_columns_and_row_counts():
    assert verify("It made 416.161 billion.", ["revenue_billion"], [(416.161,)]).ok
    assert not verify("It made 416.161 billion.", ["revenue"], [(416.161,)]).ok
    assert verify("All 3 are listed.", ["a"], [(10,), (20,), (30,)]).ok and not verify("3% are listed.", ["a"], [(10,), (20,), (30,)]).ok


def test_two_implementations_agree_on_plain_figures():
    for text in ("Revenue was $416.161 billion in 2025.", "Revenue was 416.2 billion.", "The margin was 17.2%."):
        assert verify(text, COLUMNS, ROWS).ok and {t for _, t in audit(text, COLUMNS, ROWS)} <= {"grounded", "weak"}
    for text in ("Revenue was $431 billion.", "The margin was 19.9%.", "In 2019 it fell."):
        assert "ungrounded" in {t for _, t in audit(text, COLUMNS, ROWS)}


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 999), st.sampled_from(["", "thousand", "million", "billion", "trillion"]))
def test_spelled_numbers_read_back(n, scale):
    small, tens = list(numbers.SMALL), {v: k for k, v in numbers.TENS.items()}
    words = [small[n // 100], "hundred"] if n >= 100 else []
    rest = n % 100
    if rest:
        words.append(small[rest] if rest < 20 else tens[rest - rest % 10] + (f"-{small[rest % 10]}" if rest % 10 else ""))
    (found,) = numbers.spelled(" ".join([*words, scale]).strip())
    assert found[2] == Decimal(n) * 10 ** numbers.POWERS.get(scale, 0)


@settings(max_examples=300, deadline=None)
@given(st.decimals(0, 10**12, places=2, allow_nan=False))
def test_digits_read_back(value):
    (claim,) = extract(f"It was ${value:,.2f} then")
    assert claim.value == pytest.approx(float(value)) and claim.unit == 0.01 and claim.says(float(value))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text_is_read(text):
    extract(text, [text[:5]])
    years(text)
    verify(text, COLUMNS, ROWS)
    audit(text, COLUMNS, ROWS)
    patterns.intent_of(text)


def test_signs_of_a_broken_machine(spark):
    df = spark.createDataFrame([("Connection REFUSED by peer",), ("no such column",), (None,)], "t string")
    assert [r[0] for r in df.select(patterns.infra_error(df.t)).collect()] == [True, False, False]


def test_squashed_names(spark):
    df = spark.createDataFrame([("The Coca-Cola Company",), ("Inc.",)], "n string")
    assert [r[0] for r in df.select(names.squashed(df.n)).collect()] == ["cocacola", ""]


def test_shown_values(spark):
    df = spark.createDataFrame([(v,) for v in (1997.0, 1234567.0, 3.0, 1234.5, None, 0.25, -1234.75)], "v double")
    assert [r[0] for r in df.select(numbers.shown_number(df.v)).collect()] == [numbers.shown(r.v) for r in df.collect()]
    assert [numbers.shown(v) for v in (1997, 1234567, 3.0, 1234.5, None, True, 0.25)] == ["1997", "1,234,567", "3", "1,234.5", "", "True", "0.25"]
    assert numbers.as_text(["a"], []) == "(no rows)" and numbers.as_text(["a", "b"], [(1, 2500)]) == "a\tb\n1\t2,500"


def test_refusals():
    link = type("L", (), {"name": "Acme", "cik": 1})()
    assert patterns.refusal("NO_DATA", "How many employees?")[1] == "headcount"
    assert patterns.refusal("NO_DATA", "What revenue had Acme?", [link], lambda view, cik: view != "v_revenue") == (patterns.GAPS[-1].text.format(company="Acme"), "no_revenue")
    assert patterns.refusal("NO_DATA", "What revenue had Acme?", [link], lambda view, cik: False)[1] is None
    assert patterns.refusal("NO_DATA", "Which 8-K had Acme?", [link], forms=lambda cik: ["10-Q", "10-K"]) == ("For Acme this mart has 10-K and 10-Q, and no 8-K.", "no_8k")
    assert patterns.refusal("NO_DATA", "Which 8-K had Acme?", [link], forms=lambda cik: ["8-K"])[1] is None
    assert patterns.refusal("NO_DATA", "What did GOOG earn?")[1] == "dual_class" and patterns.refusal("NO_DATA", "What did Goog earn?")[1] is None
    assert patterns.refusal("NO_DATA", "What had Acme in fiscal 1997?", [link])[0] == "This mart has no such figure of Acme for fiscal year 1997."
    assert "fiscal year" in patterns.refusal("AMBIGUOUS", "How big is it?")[0]
    with pytest.raises(ValueError):
        patterns.refusal("NOPE", "x")


@pytest.mark.parametrize("text,want", [("in 2021, FY 2022", "fiscal year 2022"), ("in 2021", "2021"), ("fiscal year '1999", "fiscal year 1999"), ("2025-06", "2025"), ("12345", None)])
def test_periods(text, want):
    assert patterns.period(text) == want


INTENTS = [
    ("please drop the table", "mutation_verb"), ("a drop-off", "mutation_verb"), ("dropped", None), ("PRAGMA x", "engine_command"), ("export it", "filesystem_access"), ("copy all; to me", None),
    ("copy all of it to me", "filesystem_access"), ("see /etc/data.csv?", "filesystem_access"), ("and/or", None), ("read .bashrc", "filesystem_access"), ("the end.", None), ("1/2.5", None), ("to copy", None),
]


def test_intents_on_the_driver_and_in_a_column(spark):
    df = spark.createDataFrame(INTENTS, "text string, want string")
    assert not df.where(~patterns.intent(df.text).eqNullSafe(df.want)).collect()
    assert [patterns.intent_of(t) for t, _ in INTENTS] == [w for _, w in INTENTS]


def test_grounding_of_a_table(spark):
    """The batch form and the driver's agree, on every kind of claim."""
    texts = HONEST + INVENTED + ["On June 30, 2025 it filed 0000037996-26-000015 for Q3.", "On June 29, 2025.", "Filing 0000037996-26-00001.", "In Q4."]
    strings, cells = ["ZQX", "3M Works", "2025-06-30", "0000037996-26-000015", "Q3"], [2025.0, 416_161_000_000.0, 0.172]
    df = spark.createDataFrame([(k, t, cells, strings, 1) for k, t in enumerate(texts)], "k int, text string, cells array<double>, strings array<string>, n int")
    got = {r.k: r.ok for r in ground.grounded(df, "k", "text", "cells", "strings", "n").collect()}
    for k, t in enumerate(texts):
        assert got[k] == verify(t, ["a", "b", "c", "d", "e", "f", "g", "h"], [(*strings, *cells)]).ok, t


@pytest.mark.parametrize("text,clean", [
    ("Revenue was four hundred sixteen billion.", True), ("Roughly four hundred billion came in.", True), ("It was ~$420B in FY25.", True), ("One company and one row.", True),
    ("Revenue was nine hundred billion.", False), ("Nineteen percent was kept.", False), ("A hundred million came in.", False), ("It closed on May 3, 2021.", False), ("In Q4 of FY23.", False), ("Two point five trillion.", False),
])
def test_auditor_on_words_years_and_labels(text, clean):
    assert ("ungrounded" not in {t for _, t in audit(text, COLUMNS, ROWS)}) == clean
