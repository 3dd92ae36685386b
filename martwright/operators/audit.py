"""An auditor of its own for grounding: other code than ground.py, so that the two can be held against each other.

Numbers are compared as decimal text, by rounding a candidate to the places the claim shows. A claim gets the first tier
that holds: grounded (a cell says it, or a label of the company that is meant), weak (a label, the row count or the SQL has
it, or a cell read as coarsely as a hedged round number allows), derived (sum, difference, ratio or change of two cells, for
claims of at least three significant digits), unresolved (a label that some company has, where it isn't known which one is
meant), else ungrounded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"(?P<sign>(?<![\w.])[-−])?(?<![\w.,])(?P<body>\d[\d,]*(?:\.\d+)?)(?:\s?(?P<mark>%|percent\b|trillion\b|billion\b|million\b|thousand\b|(?:[kmbt]|bn|mn)(?![A-Za-z0-9])))?", re.I)
_SKIP = re.compile(r"(?<![\w-])(?:10-[KQ](?:/A|T)?|8-K(?:/A)?|20-F|40-F|6-K|11-K)(?![\w-])|\b\d+(?:st|nd|rd|th)\b|\bFY ?\d{2}(?:\d{2})?\b|\d{4}-\d{2}-\d{2}|\b[QH][1-4]\b|\d+(?:-\d+){2,}|(?:[A-Z][a-z]+\.? \d{1,2}(?:, \d{4})?)(?!\d| (?:million|billion|trillion|thousand|percent))", re.M)
_PLACES = {"k": 3, "thousand": 3, "m": 6, "mn": 6, "million": 6, "b": 9, "bn": 9, "billion": 9, "t": 12, "trillion": 12}
_HEDGE = re.compile(r"(?:about|approximately|roughly|around|nearly|~)\s*[$€£]?$", re.I)
_LABELS = re.compile(r"\b(?:Q[1-4]|H[12])\b")
_YEARS = re.compile(r"\bFY ?(\d{4}|\d{2})\b|\b(?:\d{1,2} )?[A-Z][a-z]{2,8}\.? \d{1,2}?,? ?(20\d\d)\b|\b(20\d\d)-\d\d-\d\d\b|\b\d{1,2}/\d{1,2}/(20\d\d)\b")
_SAYS = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_SAYS |= {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_THOUSANDS = ("thousand", "million", "billion", "trillion")
OPERANDS = 40  # distinct cells that derived numbers are tried on, in the order of the result


@dataclass(frozen=True)
class Stated:
    text: str
    value: Decimal
    places: int  # the power of ten of the last place shown
    percent: bool
    year: bool
    loose: int | None = None  # the last place that isn't zero, where a round number is hedged

    @property
    def significant(self) -> int:
        """The digits that are stated; zeros at the end of a number in words aren't."""
        digits = str(abs(int(self.value.scaleb(-self.places)))).lstrip("0")
        return len(digits.rstrip("0") if self.text[:1].isalpha() and self.places >= 0 else digits)

    def matches(self, cell: Decimal, places: int | None = None) -> bool:
        step = Decimal(1).scaleb(self.places if places is None else places)
        near = {(cell / step).quantize(Decimal(1), rounding=r) * step for r in (ROUND_HALF_UP, ROUND_HALF_EVEN)}
        return self.value in near


def in_words(text: str) -> list[Stated]:
    """Numbers in words: a phrase is split at its magnitudes, and each part is a number under a thousand."""
    out, phrase, start = [], [], 0

    def close() -> None:
        words = [w for w in phrase if w != "and"]
        if not any(w in _SAYS for w in words) and not (words[:1] == ["a"] and len(words) > 1) or words == ["one"]:
            return
        percent, fraction = words[-1] == "percent", ""
        words = words[:-1] if percent else words
        if "point" in words:
            k = words.index("point")
            fraction = "".join(str(_SAYS[w]) for w in words[k + 1 :] if w in _SAYS)
            words = words[:k] + [w for w in words[k + 1 :] if w in _THOUSANDS]
        total, part, last = Decimal(0), Decimal(0), 0
        for w in words:
            if w in _THOUSANDS:
                last = 3 * (1 + _THOUSANDS.index(w))
                part = part if part or fraction else Decimal(1)
                total, part = total + (part + Decimal("0." + (fraction or "0"))).scaleb(last), Decimal(0)
            elif w == "hundred":
                part = max(part, Decimal(1)) * 100
            else:
                part += 1 if w == "a" and len(words) > 1 and words[1] not in (*_THOUSANDS, "hundred") else _SAYS.get(w, 0)
        total += part if not fraction or last else part + Decimal("0." + fraction)
        places = last - len(fraction) if fraction or not part else 0
        whole = str(int(total.scaleb(-places)))
        rounded = not fraction and _HEDGE.search(text[:start]) and len(whole) > 2 and (places or len(whole) > 3)
        out.append(Stated(" ".join(phrase), total, places, percent, False, places + len(whole) - len(whole.rstrip("0")) if rounded else None))

    for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]+", text + " ."):
        w = m[0].lower()
        if w in _SAYS or w in _THOUSANDS or w in ("hundred", "a") or phrase and w in ("and", "point", "percent"):
            start = start if phrase else m.start()
            phrase.append(w)
        elif not (w in (" ", "-") and phrase):
            close()
            phrase = []
    return out


def stated(answer: str, strings: list[str]) -> list[Stated]:
    text = answer
    for s in sorted((s for s in strings if re.search("[A-Za-z]", s)), key=len, reverse=True):
        text = re.sub(rf"(?<!\w){re.escape(s)}(?!\w)", lambda m: "_" * len(m[0]), text)
    out = [Stated(m[0], Decimal("20" + y[-2:]), 0, False, True) for m in _YEARS.finditer(text) if (y := next(filter(None, m.groups())))]
    text = _SKIP.sub(lambda m: " " * len(m[0]), text)
    out += in_words(text)
    for m in _TOKEN.finditer(text):
        body, mark = m["body"].rstrip(",").replace(",", ""), (m["mark"] or "").lower()
        power = _PLACES.get(mark, 0)
        value = Decimal(("-" if m["sign"] else "") + body).scaleb(power)
        year = not mark and bool(re.fullmatch(r"20\d\d", m["body"]))
        places = power - len(body.partition(".")[2])
        rounded = _HEDGE.search(text[: m.start()]) and "." not in body and (mark or len(body) > 3)
        out.append(Stated(m[0], value, places, mark in ("%", "percent"), year, places + len(body) - len(body.rstrip("0")) if rounded else None))
    return out


@dataclass(frozen=True)
class Known:
    """Years that companies have: the ones that are meant, all of them, and whether it is open which are meant."""

    own: frozenset[int] = frozenset()
    all: frozenset[int] = frozenset()
    open: bool = False


TIERS = ("grounded", "weak", "derived", "unresolved", "ungrounded")  # from the best on


def audit(answer: str, columns: list[str], rows: list[tuple], sql: str | None = None, known: Known = Known()) -> list[tuple[str, str]]:
    """(claim as written, tier) for every number, year and period label of an answer."""
    cells = [c for r in rows for c in r]
    numbers = [Decimal(str(c)) for c in cells if isinstance(c, int | float | Decimal) and not isinstance(c, bool) and Decimal(str(c)).is_finite()]
    strings = [c for c in cells if isinstance(c, str)]
    text = " ".join([*map(str, cells), sql or ""])
    some = list(dict.fromkeys(numbers))[:OPERANDS]
    derived: list[Decimal] | None = None
    out = [(m[0], "weak" if re.search(rf"\b{m[0]}\b", text) else "ungrounded") for m in _LABELS.finditer(answer)]
    for c in stated(answer, strings):
        pool = numbers + ([n * 100 for n in numbers] if c.percent else [])
        said = int(c.value) if c.year else None
        if any(map(c.matches, pool)) or said in known.own:
            tier = "grounded"
        elif (c.year and re.search(rf"(?<!\d){c.value}(?!\d)", text)) or (not c.percent and c.places == 0 and c.value == len(rows)):
            tier = "weak"
        elif c.loose is not None and any(c.matches(n, c.loose) for n in pool):
            tier = "weak"
        elif c.year:
            tier = "unresolved" if known.open and said in known.all else "ungrounded"
        else:
            if derived is None and c.significant >= 3:
                derived = [x for a, b in permutations(some, 2) for x in (a + b, a - b, *((a / b, 100 * a / b, 100 * (a - b) / b) if b else ()))]
            tier = "derived" if c.significant >= 3 and any(map(c.matches, derived)) else "ungrounded"
        out.append((c.text.strip(), tier))
    return out


def worst(text: Column, cells: Column, strings: Column) -> Column:
    """The worst tier of a text's claims against one row of numbers and strings; null without claims."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, numbers: pd.Series, words: pd.Series) -> pd.Series:
        out = []
        for t, n, w in zip(texts, numbers, words, strict=True):
            row = (*(float(x) for x in (n if n is not None else ())), *(w if w is not None else ()))
            tiers = [tier for _, tier in audit(t or "", [], [row])]
            out.append(max(tiers, key=TIERS.index) if tiers else None)
        return pd.Series(out, dtype=object)

    return run(text, cells, strings)


def company_labels(filings: DataFrame) -> DataFrame:
    """(cik, years, days): the fiscal years and the days on which periods end of each company, each once, in order."""
    return filings.groupBy("cik").agg(F.array_sort(F.collect_set("fiscal_year")).alias("years"), F.array_sort(F.collect_set("period_end_date")).alias("days"))


DECIMAL = "decimal(38,10)"
CLAIM = f"struct<text:string,value:{DECIMAL},half:{DECIMAL},even:boolean,loose_half:{DECIMAL},loose_even:boolean,percent:boolean,year:boolean,whole:boolean,significant:int,label:boolean>"
_LARGEST = Decimal(10) ** 28
SPREAD = 4096  # lots of rows that no join has to find anything for


def _even(value: Decimal, places: int) -> bool:
    """Whether a value is an even multiple of its last place, as rounding half to even gives."""
    return int((value / Decimal(1).scaleb(places)).to_integral_value()) % 2 == 0


def _claim(c: Stated) -> dict:
    half = lambda places: Decimal(5).scaleb(places - 1)
    fits = abs(c.value) < _LARGEST and -9 <= c.places and max(c.places, c.loose or 0) < 28
    return {
        "text": c.text.strip(), "value": c.value if fits else None, "half": half(c.places) if fits else None, "even": _even(c.value, c.places), "loose_half": half(c.loose) if fits and c.loose is not None else None,
        "loose_even": c.loose is not None and _even(c.value, c.loose), "percent": c.percent, "year": c.year, "whole": c.places == 0, "significant": c.significant, "label": False,
    }


def claims(text: Column, strings: Column) -> Column:
    """array of CLAIM: what a text states, outside the strings of its result. Numbers of over 28 digits or under ten billionths have no value."""

    @F.pandas_udf(f"array<{CLAIM}>")
    def run(texts: pd.Series, words: pd.Series) -> pd.Series:
        out = []
        for t, w in zip(texts, words, strict=True):
            none = dict.fromkeys(("value", "half", "loose_half")) | dict.fromkeys(("even", "loose_even", "percent", "year", "whole"), False) | {"significant": 0, "label": True}
            out.append([{"text": m[0]} | none for m in _LABELS.finditer(t or "")] + [_claim(c) for c in stated(t or "", [x for x in (w if w is not None else ()) if x])])
        return pd.Series(out)

    return run(text, strings)


def _says(value: Column, half: Column, even: Column, cell: Column) -> Column:
    """Whether a cell, rounded half up or half to even to the places that a claim shows, is its value: by their distance alone."""
    apart = F.abs(cell - value)
    return F.coalesce((apart < half) | ((apart == half) & (even | (F.abs(value) > F.abs(cell)))), F.lit(False))


def tiers(answers: DataFrame, key: str, text: str, numbers: str, strings: str, n_rows: str, sql: str, company: str, labels: DataFrame) -> DataFrame:
    """(key, claim, tier) for each claim of a table of answers: audit(), with each answer's company by a join.

    numbers: its result's cells (array<decimal>), strings: its texts, n_rows: its rows, sql: its statement, company: whom it is
    about (cik), null where that is open. labels: (cik, year), the years that companies have. An answer's own years come by its
    company, and whether anyone has a year, where no company is meant, by a join on the year; both sides may be of any size. Keys must be unique.
    """
    own = labels.where("cik is not null and year is not null").groupBy(F.col("cik").alias("_cik")).agg(F.collect_set(F.col("year").cast("int")).alias("_own"))
    read = answers.select(F.col(key).alias("_key"), F.transform(numbers, lambda n: n.cast(DECIMAL)).alias("_n"), F.col(strings).alias("_s"), F.col(n_rows).cast(DECIMAL).alias("_rows"), F.coalesce(F.col(sql), F.lit("")).alias("_sql"), F.col(company).alias("_company"), F.explode(claims(F.col(text), F.col(strings))).alias("_c"))
    years = labels.where("year is not null").select(F.col("year").cast("int").alias("_year")).distinct().withColumn("_anyone", F.lit(True))
    said = F.when(F.col("_c.year"), F.col("_c.value").cast("int"))
    # answers without a company and claims that need no year find nothing: they are spread, not sent to the one task of null
    spread = lambda asks: F.when(asks, F.lit(-1)).otherwise(F.pmod(F.xxhash64("_key"), F.lit(SPREAD)).cast("int"))
    by_company = (F.col("_company") == F.col("_cik")) & (F.col("_lot") == F.col("_own_lot"))
    with_own = read.withColumn("_lot", spread(F.col("_company").isNotNull())).join(own.withColumn("_own_lot", F.lit(-1)), by_company, "left").withColumn("_said", said)
    open_year = F.col("_company").isNull() & F.col("_said").isNotNull()
    by_year = (F.when(open_year, F.col("_said")) == F.col("_year")) & (F.col("_place") == F.col("_year_place"))
    met = with_own.withColumn("_place", spread(open_year)).join(years.withColumn("_year_place", F.lit(-1)), by_year, "left")
    c, cells = F.col("_c"), F.filter("_n", lambda n: n.isNotNull())
    pool = F.when(c["percent"], F.concat(cells, F.transform(cells, lambda n: (n * 100).cast(DECIMAL)))).otherwise(cells)
    found = lambda values, half, even: F.exists(values, lambda n: _says(c["value"], half, even, n))
    shown = F.concat_ws(" ", F.transform(cells, lambda n: n.cast("string")), F.col("_s"), F.col("_sql"))
    stands = lambda what, edge: F.regexp_like(shown, F.concat(F.lit(f"(?<!{edge})"), what, F.lit(f"(?!{edge})")))
    some = F.slice(F.array_distinct(cells), 1, OPERANDS)
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double")).cast(DECIMAL)
    forms = lambda a, b: F.array((a + b).cast(DECIMAL), (a - b).cast(DECIMAL), ratio(a, b), ratio(a * 100, b), ratio((a - b) * 100, b))
    pairs = F.exists(F.sequence(F.lit(0), F.size(some) - 1), lambda i: F.exists(F.sequence(F.lit(0), F.size(some) - 1), lambda j: (i != j) & found(forms(F.get(some, i), F.get(some, j)), c["half"], c["even"])))
    tier = (
        F.when(c["label"], F.when(stands(c["text"], r"\w"), "weak").otherwise("ungrounded"))
        .when(found(pool, c["half"], c["even"]) | F.coalesce(F.array_contains("_own", F.col("_said")), F.lit(False)), "grounded")
        .when(c["year"] & stands(F.col("_said").cast("string"), r"\d"), "weak")
        .when(~c["percent"] & c["whole"] & (c["value"] == F.col("_rows")), "weak")
        .when(c["loose_half"].isNotNull() & found(pool, c["loose_half"], c["loose_even"]), "weak")
        .when(c["year"], F.when(F.col("_company").isNull() & F.col("_anyone"), "unresolved").otherwise("ungrounded"))
        .when((c["significant"] >= 3) & (F.size(some) > 1) & pairs, "derived")
        .otherwise("ungrounded")
    )
    return met.select(F.col("_key").alias(key), F.col("_c.text").alias("claim"), tier.alias("tier"))
