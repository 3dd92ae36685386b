"""Company names: their distinctive words, shapes, display forms, and which stored names a question mentions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import prefixes

# Words that name a legal form, a share class or an article; words that open a question; brand aliases.
FORM_WORDS = frozenset("the inc incorporated corp corporation co company ltd limited plc holdings holding group llc lp class a b c de sa nv ag and of com".split())
QUESTION_WORDS = frozenset("what which who whom whose when where how why give show list compare among across did does do is are was were has have had can could will would from for with the and of in on by to at as per each every any all total combined most least highest lowest".split())
ALIASES = {"google": "GOOGL", "facebook": "META"}
LEAST_PREFIX, LEAST_TICKER = 4, 3


def words(name: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", name.lower()) if w and w not in FORM_WORDS]


def same_company(a: str, b: str) -> bool:
    """One name's distinctive words are all among the other's."""
    few, many = sorted((frozenset(words(a)), frozenset(words(b))), key=len)
    return bool(few) and many.issuperset(few)


def _parts(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*FORM_WORDS))


def tokens(name: Column) -> Column:
    """words() as a column, each once."""
    return F.array_distinct(_parts(name))


def squashed(name: Column) -> Column:
    """words() run together."""
    return F.array_join(_parts(name), "")


def shape(name: Column) -> Column:
    """The class of a name by its shape, first rule that fits."""
    return (
        F.when(name.rlike(r"\((?i:the)\)"), "inverted_the")
        .when(name.rlike(r"(?i)class [a-c]\b"), "share_class")
        .when(name.rlike(r"[&.,'!/-]"), "punctuated")
        .when(F.size(F.split(F.trim(name), r"\s+")) > 1, "multi_word")
        .otherwise("plain")
    )


def display(name: Column) -> Column:
    """`X (The)` as `The X`."""
    bare = F.regexp_extract(name, r"^(.*?)\s*\((?i:the)\)\s*$", 1)
    return F.when(bare != "", F.concat(F.lit("The "), bare)).otherwise(name)


class Company(NamedTuple):
    cik: int
    ticker: str
    name: str


class Hit(NamedTuple):
    mention: str
    how: str  # ticker, alias or name
    company: Company

    @property
    def ticker(self) -> str:
        return self.company.ticker

    @property
    def name(self) -> str:
        return self.company.name

    @property
    def cik(self) -> int:
        return self.company.cik


def name_runs(question: str) -> list[list[str]]:
    """The runs of words that begin with a capital letter or a digit, without possessives and closing stops."""
    bare = re.sub(r"['’]s\b", "", question)
    found = [w for w in (part.strip(".&-") for part in re.split(r"[^A-Za-z0-9&.\-]+", bare)) if w]
    return [list(own) for named, own in groupby(found, key=lambda w: w[0].isupper() or w[0].isdigit()) if named]


def mentions(question: str) -> list[list[tuple[int, int, str]]]:
    """For each run all stretches of its words that may be a mention, (first word, words, text): by first word, longest first.

    A word that opens questions is no mention by itself.
    """
    out = []
    for run in name_runs(question):
        own = [(a, n, " ".join(run[a : a + n])) for a in range(len(run)) for n in range(len(run) - a, 0, -1)]
        out.append([m for m in own if m[1] > 1 or m[2].lower() not in QUESTION_WORDS])
    return out


def keys(text: str, n_words: int) -> list[tuple[str, str]]:
    """What a mention is looked up as, in order: (how, key in the dictionary of names)."""
    single = [("ticker", text)] if n_words == 1 and text.isupper() and len(text) >= LEAST_TICKER else []
    if n_words == 1 and text.lower() in ALIASES:
        single.append(("alias", ALIASES[text.lower()]))
    run_together = "".join(words(text))
    return single + ([("name", run_together)] if run_together else [])


def settle(question: str, find: Callable[[str, str], Company | None]) -> list[Hit]:
    """The companies that a question mentions, each once: in each run the longest mention from the left that is found."""
    out: dict[str, Hit] = {}
    for own in mentions(question):
        free = 0
        for first, n, text in own:
            if first < free:
                continue
            hit = next((Hit(text, how, c) for how, key in keys(text, n) if (c := find(how, key))), None)
            if hit:
                out.setdefault(hit.ticker, hit)
                free = first + n
    return list(out.values())


class Linker:
    """Links a question's mentions to the companies it is given, from dictionaries on the driver.

    A mention is a company's if its distinctive words, run together, are the name's own, or begin the names of no others.
    """

    def __init__(self, companies: Iterable[tuple[int, str, str]]):
        self.tickers: dict[str, Company] = {}
        self.names: dict[str, set[Company]] = {}
        self.beginnings: dict[str, set[Company]] = {}
        for c in map(Company._make, companies):
            self.tickers[c.ticker] = c
            key = "".join(words(c.name))
            self.names.setdefault(key, set()).add(c)
            for n in range(LEAST_PREFIX, len(key) + 1):
                self.beginnings.setdefault(key[:n], set()).add(c)

    def find(self, how: str, key: str) -> Company | None:
        if how != "name":
            return self.tickers.get(key)
        found = self.names.get(key) or self.beginnings.get(key, ())
        return next(iter(found)) if len(found) == 1 else None

    def link(self, question: str) -> list[Hit]:
        return settle(question, self.find)


def hint(links: list[Hit]) -> str:
    """The lines that tell a query writer which stored rows a question means."""
    return "\n".join(f"- the question says {x.mention!r}: ticker {x.ticker!r}, stored as {x.name!r}" for x in links)


def dictionary(companies: DataFrame, asked: DataFrame) -> DataFrame:
    """(how, key, company) for the asked (how, key): tickers, and run-together names or beginnings of one that are one company's alone.

    Names are one row each; beginnings are found in their order. A key that is a name means that one, even if it begins others.
    """
    row = F.struct("cik", "ticker", "name").alias("company")
    named = companies.select(row, squashed(F.col("name")).alias("whole")).where("whole <> ''")
    said = asked.where("how = 'name'").select("key").distinct()
    found = prefixes.resolved(said, "key", named.select("whole"), "whole", whole_first=True).where((F.length("key") >= LEAST_PREFIX) | (F.col("key") == F.col("whole")))
    by_name = found.join(named, "whole").select(F.lit("name").alias("how"), "key", "company")
    return by_name.unionByName(companies.select(F.lit("ticker").alias("how"), F.col("ticker").alias("key"), row)).unionByName(companies.select(F.lit("alias").alias("how"), F.col("ticker").alias("key"), row))


def linked(questions: DataFrame, key: str, text: str, companies: DataFrame) -> DataFrame:
    """(key, mention, ticker, how) of a table of questions, whose keys are unique: a join of mentions with the dictionary.

    A question's mentions and what they were found as come together again in one row, where the longest ones win.
    """

    @F.pandas_udf("array<struct<how:string,entry:string>>")
    def asked(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"how": how, "entry": k} for how, k in dict.fromkeys(k for own in mentions(t or "") for _, n, said in own for k in keys(said, n))] for t in texts])

    @F.pandas_udf("array<struct<mention:string,ticker:string,how:string>>")
    def settled(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, rows in zip(texts, found, strict=True):
            held = {(r["how"], r["key"]): Company(r["company"]["cik"], r["company"]["ticker"], r["company"]["name"]) for r in rows}
            out.append([{"mention": h.mention, "ticker": h.ticker, "how": h.how} for h in settle(t or "", lambda how, k, held=held: held.get((how, k)))])
        return pd.Series(out)

    held = questions.select(F.col(key).alias("id"), F.col(text).alias("said")).repartition("id")  # a small file is one task's, but reading questions is work for all
    looked = held.select("id", "said", F.explode(asked("said")).alias("one")).select("id", "said", F.col("one.how").alias("how"), F.col("one.entry").alias("key"))
    met = looked.join(dictionary(companies, looked.select("how", "key")), ["how", "key"])
    rows = met.groupBy("id", "said").agg(F.collect_list(F.struct("how", "key", "company")).alias("found"))
    return rows.select(F.col("id").alias(key), F.inline(settled("said", "found")))
