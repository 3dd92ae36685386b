"""Text rules: intent of a question, years, fences, abstentions, rubrics, refusals."""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that change data, words that command the engine, the reasons of refusals, signs of a broken machine.
MUTATIONS = ("drop", "delete", "truncate", "alter", "update", "insert")
COMMANDS = ("pragma", "vacuum")
REASONS = ("OUT_OF_SCOPE", "SCHEMA_MISMATCH", "AMBIGUOUS", "NO_DATA", "COST_LIMIT", "LOW_AGREEMENT", "UNGROUNDED_ANSWER", "EXEC_ERROR")
INFRA = ("connection refused", "timed out", "connection reset", "out of memory", "service unavailable")
_PATH, _HIDDEN = r"^/[\w./-]*\.\w+", r"^[.][a-z][a-z0-9_-]+$"  # of a token: a rooted path to a file with an ending; a name behind a dot and nothing else


def intent(question: Column) -> Column:
    """The first thing a question's text must not ask for, or null.

    mutation_verb, engine_command: such a word. filesystem_access: the word export, copy and later to in one clause, or a
    token that is a path or a hidden file.
    """
    said = F.split(F.lower(question), r"\W+")
    tokens = F.transform(F.split(F.lower(question), r"[\s()\"'`,;]+"), lambda t: F.regexp_replace(t, r"[?!:]+$", ""))
    clauses = F.transform(F.split(F.lower(question), "[.;]"), lambda c: F.split(c, r"\W+"))
    copied = F.exists(clauses, lambda c: (F.array_position(c, "copy") > 0) & (F.array_position(F.slice(c, F.greatest(F.array_position(c, "copy"), F.lit(1)).cast("int"), F.size(c)), "to") > 1))
    files = F.array_contains(said, "export") | copied | F.exists(tokens, lambda t: t.rlike(_PATH) | t.rlike(_HIDDEN))

    def any_of(listed: tuple[str, ...]) -> Column:
        return F.arrays_overlap(said, F.array(*map(F.lit, listed)))

    return F.when(any_of(MUTATIONS), "mutation_verb").when(any_of(COMMANDS), "engine_command").when(files, "filesystem_access")


def intent_of(question: str) -> str | None:
    """intent() of one question, on the driver."""
    said = re.split(r"\W+", question.lower())
    tokens = [re.sub(r"[?!:]+$", "", t) for t in re.split(r"""[\s()"'`,;]+""", question.lower())]
    clauses = [re.split(r"\W+", c) for c in re.split("[.;]", question.lower())]
    copied = any("to" in c[c.index("copy") + 1 :] for c in clauses if "copy" in c)
    files = "export" in said or copied or any(re.search(_PATH, t) or re.search(_HIDDEN, t) for t in tokens)
    found = {"mutation_verb": set(MUTATIONS) & set(said), "engine_command": set(COMMANDS) & set(said), "filesystem_access": files}
    return next((event for event, hit in found.items() if hit), None)


def year_list(text: Column) -> Column:
    """Years 2000-2099 that stand alone, and FY25, in any order but without repeats."""
    four = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)(20\d{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int"))
    two = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9])FY ?(\d{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int") + 2000)
    return F.array_sort(F.array_distinct(F.concat(four, two)))


def period(question: str) -> str | None:
    """The fiscal year that a question names: one that is called so before any other year from 1900 to 2099."""
    said = [w.lower() for w in re.findall(r"[A-Za-z]+|\d+", question)]
    at = [k for k, w in enumerate(said) if len(w) == 4 and w[:2] in ("19", "20") and w.isdigit()]
    for k in at:
        lead = said[max(0, k - 2) : k]
        if lead[-1:] in (["fy"], ["fiscal"]) or lead == ["fiscal", "year"]:
            return f"fiscal year {said[k]}"
    return said[at[0]] if at else None


def unfenced(text: Column) -> Column:
    """The last complete fenced block of a reply, else the reply without stray fences."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```[a-zA-Z]*\s*\n?(.*?)```"), F.lit(1))
    bare = F.regexp_replace(text, r"```[a-zA-Z]*", "")
    return F.regexp_replace(F.when(F.size(blocks) > 0, F.element_at(blocks, -1)).otherwise(bare), r"^\s+|\s+$", "")


def normal_sql(sql: Column) -> Column:
    """For comparing statements: lower case, single spaces, no semicolon at the end."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.trim(sql), r";\s*$", ""), r"\s+", " ")))


def abstain_codes(accepted: Column) -> Column:
    """The codes of `ABSTAIN:CODE` among accepted alternatives."""
    return F.array_distinct(F.filter(F.transform(accepted, lambda a: F.regexp_extract(a, r"^ABSTAIN:([A-Z_]+)$", 1)), lambda c: c != ""))


def rubric(text: Column, groups: list[tuple[list[str], int]]) -> Column:
    """Every group has at least so many different lower-cased matches of its patterns."""

    def enough(patterns: list[str], least: int) -> Column:
        found = F.concat(*(F.transform(F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(0)), F.lower) for p in patterns))
        return F.size(F.array_distinct(found)) >= least

    out = F.lit(True)
    for patterns, least in groups:
        out = out & enough(patterns, least)
    return out


def judge_reply(reply: Column) -> Column:
    """True or false by a reply's first word, null for anything but yes or no."""
    first = F.lower(F.regexp_extract(reply, r"^\W*(\w+)", 1))
    return F.when(first == "yes", True).when(first == "no", False)


def infra_error(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(INFRA)), F.lit(False))


def error_class(error: Column) -> Column:
    return F.substring_index(error, ":", 1)


@dataclass(frozen=True)
class Gap:
    """Something that a mart is known not to hold: the words by which questions ask for it, and what to say.

    words: as a question has them, lower-cased, a star for any ending; with case: tickers as they are written.
    condition: none; "class": the word is a share class of SHARE_CLASSES; "no_rows:<view>": a company meant has no rows there
    but some in the facts; "no_form:<form>": a company meant has filings, but none of that form.
    """

    id: str
    words: tuple[str, ...]
    text: str
    condition: str | None = None
    case: bool = False

    def asked(self, question: str) -> str | None:
        """The first word of the question that asks for it."""
        for word in re.findall(r"[\w-]+", question):
            own = word if self.case else word.lower()
            if any(own.startswith(w[:-1]) if w.endswith("*") else own == w for w in self.words):
                return word
        return None

    def asks(self, question: Column) -> Column:
        said = F.split(question if self.case else F.lower(question), r"[^\w-]+")
        return F.exists(said, lambda t: functools.reduce(operator.or_, [t.startswith(w[:-1]) if w.endswith("*") else t == w for w in self.words]))


# Share classes that are not rows of their own, and the vocabulary of what isn't held, in the order it is looked for.
SHARE_CLASSES = {"GOOG": "GOOGL", "FOX": "FOXA", "NWS": "NWSA"}
GAPS = (
    Gap("dual_class", tuple(SHARE_CLASSES), "{mention} is a second share class; its company is listed here once, as {canonical}.", "class", True),
    Gap("staging_tables", ("stg_*", "staging"), "Staging tables are for whoever builds this mart; questions can't reach them."),
    Gap("no_8k", ("8-k",), "For {company} this mart has {forms}, and no 8-K.", "no_form:8-K"),
    Gap("headcount", ("employee", "employees", "headcount", "workforce"), "How many people work somewhere isn't in this mart, which holds orders and their figures."),
    Gap("annual_only", ("quarter", "quarters", "quarterly", "q1", "q2", "q3", "q4"), "Figures here are of whole years, so there is nothing to say about parts of one."),
    Gap("no_breakdowns", ("segment", "segments", "geograph*", "region", "regions", "regional", "country", "countries"), "Figures here are of companies as a whole; they can't be broken down."),
    Gap("no_revenue", ("revenue", "revenues", "sales", "margin", "margins"), "{company} reports nothing that this mart knows as revenue, and so nothing that is computed from it.", "no_rows:v_revenue"),
)
TEXTS = {
    "OUT_OF_SCOPE": "That isn't something this mart is for.",
    "SCHEMA_MISMATCH": "Nothing in this mart's tables holds what the question asks for.",
    "COST_LIMIT": "Answering this would read more than is allowed, so it wasn't tried.",
    "LOW_AGREEMENT": "Several attempts gave different answers; none of them is sure enough to show.",
    "UNGROUNDED_ANSWER": "The answer said things that its query's result doesn't, so it is held back.",
    "EXEC_ERROR": "The question's query failed.",
}


def listed(items: list[str]) -> str:
    *most, last = items
    return f"{', '.join(most)} and {last}" if most else last


def gap_of(question: str, links: list, has_rows=lambda view, cik: True, forms=lambda cik: []) -> tuple[Gap, str] | None:
    """The first known gap that explains why a question has no answer, by its words and by what the mart holds, and its text."""
    for gap in GAPS:
        word = gap.asked(question)
        if not word:
            continue
        kind, _, what = (gap.condition or "").partition(":")
        if kind == "class":
            return gap, gap.text.format(mention=word, canonical=SHARE_CLASSES[word])
        if not kind:
            return gap, gap.text
        for x in links:
            held = forms(x.cik) if kind == "no_form" else []
            if kind == "no_form" and held and what not in held or kind == "no_rows" and not has_rows(what, x.cik) and has_rows("financial_facts", x.cik):
                return gap, gap.text.format(company=x.name, forms=listed(sorted(held)) if held else "")
    return None


def refusal(reason: str, question: str, links: list | None = None, has_rows=lambda view, cik: True, forms=lambda cik: []) -> tuple[str, str | None]:
    """(text, gap id or None): the known gap that explains it, else the reason's sentence."""
    if reason not in REASONS:
        raise ValueError(f"unknown reason {reason!r}")
    found = gap_of(question, links or [], has_rows, forms)
    if found:
        return found[1], found[0].id
    when, who = period(question), listed([x.name for x in links]) if links else None
    if reason == "NO_DATA":
        of, at = f" of {who}" if who else "", f" for {when}" if who and when else ""
        return f"This mart has no such figure{of}{at}.", None
    if reason == "AMBIGUOUS":
        return "This can be meant in more than one way; name the " + ("company, the figure or the year that is meant." if when else "fiscal year that is meant."), None
    return TEXTS[reason], None


def refusal_reason(question: Column, reason: Column) -> Column:
    """The gap that explains a refusal by the question's text alone, else the reason itself."""
    out = reason
    for gap in reversed([g for g in GAPS if g.condition in (None, "class")]):
        out = F.when(gap.asks(question), gap.id).otherwise(out)
    return out


def refusals(asked: DataFrame, links: DataFrame, facts: DataFrame, filings: DataFrame, views: dict[str, DataFrame], id_col: str = "id", text_col: str = "text", reason_col: str = "reason") -> DataFrame:
    """(id, why): the first known gap that explains a refused question, else its reason, for tables of questions.

    links: (id, cik) of the companies that questions mean. Data conditions are semi and anti joins of the linked companies
    with the facts, the views and the filings' forms; a gap holds if it does for any company of the question.
    """
    want = asked.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(reason_col).alias("reason"))
    meant = links.select("id", "cik").distinct()
    holds = want.select("id").limit(0).withColumn("gap", F.lit(""))
    for gap in GAPS:
        kind, _, what = (gap.condition or "").partition(":")
        if kind == "no_rows":
            bare = meant.join(facts.select("cik").distinct(), "cik", "left_semi").join(views[what].select("cik").distinct(), "cik", "left_anti")
        elif kind == "no_form":
            bare = meant.join(filings.select("cik").distinct(), "cik", "left_semi").join(filings.where(F.col("form") == what).select("cik").distinct(), "cik", "left_anti")
        else:
            continue
        holds = holds.unionByName(bare.select("id", F.lit(gap.id).alias("gap")).distinct())
    flags = holds.groupBy("id").agg(F.collect_set("gap").alias("gaps"))
    why = F.col("reason")
    for gap in reversed(GAPS):
        told = gap.asks(F.col("text"))
        if gap.condition not in (None, "class"):
            told = told & F.coalesce(F.array_contains("gaps", gap.id), F.lit(False))
        why = F.when(told, gap.id).otherwise(why)
    return want.join(flags, "id", "left").select(F.col("id").alias(id_col), why.alias("why"))
