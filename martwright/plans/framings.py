"""framing.frame() for tables of questions: what answers should say about how their questions were read, as rows.

A reading is a row: id, question, views, tickers, years (arrays, of what its statement asks for), latest, sums, ranking
(booleans), scale (text), projects, columns (arrays of column names), n_rows, and links, an array of what the question
mentions: struct(mention, how, ticker, name). What rules look up comes by joins: a reading's companies with their names and
with a profile of each company and view (its years, the last day of each, its latest year, its units), its view with the
concept that the view stands for. Then each rule is an expression over the row, and clauses are exploded in the rules' order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import year_list
from ..operators.cases import let
from .framing import COMPARES, CONCEPTS, LATEST, SUMS, VAGUE, Concept

CLAUSE = "struct<kind:string,text:string,assumption:boolean>"


def text_of(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def listed(items: Column) -> Column:
    """a, b and c; null without items."""
    n = F.size(items)
    last = F.get(items, n - 1)
    return F.when(n == 1, last).when(n > 1, F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), last))


def ended(year: Column, day: Column) -> Column:
    return text_of("fiscal year ", year, " (to ", F.date_format(day, "MMMM d, yyyy"), ")")


def profiles(periods: DataFrame) -> DataFrame:
    """(view, ticker, profile): of each company in a view its years in order, each with its last day, and its units.

    periods: (view, ticker, fiscal_year, period_end_date, uom), repeats and all. A company has as many years as it has reported.
    """
    days = periods.where("ticker is not null").groupBy("view", "ticker", "fiscal_year").agg(F.max("period_end_date").alias("day"), F.collect_set("uom").alias("uoms"))
    year = F.struct(F.col("fiscal_year").cast("int").alias("year"), F.col("day").cast("date").alias("day"))
    return days.groupBy("view", "ticker").agg(F.struct(F.array_sort(F.collect_list(year)).alias("years"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("uoms")))).alias("units")).alias("profile"))


def frames(readings: DataFrame, companies: DataFrame, periods: DataFrame, concepts: dict[str, Concept] = CONCEPTS) -> DataFrame:
    """(id, place, kind, text, assumption): every clause of every reading, as frame() gives them; place is its order, from 0.

    companies: (ticker, name), of which the least name counts if a ticker has several; periods as in profiles(). Readings
    without a clause have no row; ids must be unique. Null arrays are empty, null booleans false.
    """
    spark = readings.sparkSession
    known = [(v, k, c.name, list(c.words), list(c.loose), c.balance) for k, (v, c) in enumerate(concepts.items())]
    rules = spark.createDataFrame(known, "view string, _k int, name string, words array<string>, loose array<string>, balance boolean")
    concept = rules.select(F.col("view").alias("_view"), F.struct("name", "words", "loose", "balance").alias("concept"))
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(f"array<{t}>")).alias(c)
    base = readings.select(
        "id", F.coalesce("question", F.lit("")).alias("question"), empty("views", "string"), empty("tickers", "string"), empty("years", "int"), empty("projects", "string"), empty("columns", "string"), "scale", "n_rows",
        *(F.coalesce(c, F.lit(False)).alias(c) for c in ("latest", "sums", "ranking")), empty("links", "struct<mention:string,how:string,ticker:string,name:string>"),
    )
    view = F.get(F.filter("views", lambda v: v.isin(*concepts)), F.lit(0))
    asked = F.array_distinct(F.when(F.size("tickers") > 0, F.col("tickers")).otherwise(F.transform("links", lambda x: x["ticker"])))
    old = F.transform(F.regexp_extract_all("question", F.lit(r"(?<!\d)(19\d\d)(?!\d)"), F.lit(1)), lambda y: y.cast("int"))
    read = base.withColumns({"view": view, "asked": asked, "said": F.concat(year_list(F.col("question")), old), "spoken": F.regexp_extract_all(F.lower("question"), F.lit(r"(\p{L}+)"), F.lit(1))})
    names = companies.groupBy(F.col("ticker").alias("_ticker")).agg(F.min("name").alias("_name"))
    wanted = read.select("id", "view", F.posexplode("asked").alias("at", "ticker"))
    held = profiles(periods).select(F.col("view").alias("_of"), F.col("ticker").alias("_who"), "profile")
    met = wanted.join(names, F.col("ticker") == F.col("_ticker"), "left").join(held, (F.col("view") == F.col("_of")) & (F.col("ticker") == F.col("_who")), "left")
    one = F.struct("at", "ticker", F.coalesce(F.regexp_replace("_name", r"\.+$", ""), F.col("ticker")).alias("name"), "profile.years", "profile.units")
    found = met.groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(one)).alias("companies"))  # as many as a question names
    ready = read.join(found, F.col("id") == F.col("_id"), "left").join(F.broadcast(concept), F.col("view") == F.col("_view"), "left")
    ready = ready.withColumn("companies", F.coalesce("companies", F.array().cast(dict(found.dtypes)["companies"])))
    clauses = F.flatten(F.array(*(rule() for rule in (period, entity, term, metric, unit, summed, balance, year_ends))))
    out = ready.select("id", F.posexplode(F.filter(clauses, lambda c: c.isNotNull())).alias("place", "c"))
    return out.select("id", "place", "c.kind", "c.text", "c.assumption")


def clause(kind: str, text: Column, assumption: Column | bool) -> Column:
    flag = F.lit(assumption) if isinstance(assumption, bool) else assumption
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"), flag.alias("assumption")).cast(CLAUSE)


def one(c: Column) -> Column:
    return F.array(c).cast(f"array<{CLAUSE}>")


def says(words: tuple[str, ...] | Column) -> Column:
    return F.arrays_overlap("spoken", F.array(*map(F.lit, words)) if isinstance(words, tuple) else words)


def period() -> Column:
    years, companies = F.col("years"), F.col("companies")
    texts = F.transform(years, lambda y: y.cast("string"))
    first = F.get(years, F.lit(0))
    end = F.when(F.size("asked") == 1, F.get(F.filter(F.get(companies, F.lit(0))["years"], lambda y: (y["year"] == first) & y["day"].isNotNull()), F.lit(0)))
    stated = F.when(F.size(F.array_except(years, "said")) > 0, clause("period", text_of("The question is taken to be about fiscal year ", listed(texts), "."), True))
    bare = ~says(("fiscal", "fy")) & (F.size(years) == 1)
    stated = stated.when(bare, clause("period", text_of(first, " is taken as ", F.coalesce(ended(end["year"], end["day"]), text_of("fiscal year ", first)), "."), True))
    stated = stated.otherwise(clause("period", text_of("The period is fiscal year ", listed(texts), "."), False))
    how = F.when(says(LATEST), "as asked").otherwise("as the question names none")
    last = lambda c: F.get(c["years"], F.size(c["years"]) - 1)
    with_end = F.filter(companies, lambda c: last(c)["day"].isNotNull())

    def latest(held: Column) -> Column:
        only = last(F.get(held, F.lit(0)))
        each = listed(F.transform(held, lambda c: text_of(c["name"], " ", ended(last(c)["year"], last(c)["day"]))))
        text = F.when(F.size(held) == 1, text_of("The year is the latest on record, ", how, ": ", ended(only["year"], only["day"]), "."))
        text = text.when(F.size(held) > 1, text_of("Each company's year is its latest on record, ", how, ": ", each, ".")).otherwise(text_of("The year is the latest on record, ", how, "."))
        return clause("period", text, True)

    unnamed = clause("period", F.lit("All fiscal years on record take part."), True)
    return one(F.when(F.size(years) > 0, stated).when(F.col("latest") & ~F.col("sums"), let(with_end, latest)).when(~F.col("latest") & F.col("ranking") & (F.size("asked") == 0) | F.col("latest") & F.col("sums") & F.col("ranking") & (F.size("asked") == 0), unnamed))


def entity() -> Column:
    aliases = F.transform(F.filter("links", lambda x: x["how"] == "alias"), lambda x: clause("entity", text_of(x["mention"], " is taken as ", F.regexp_replace(x["name"], r"\.+$", ""), " (", x["ticker"], ")."), True))
    linked = F.transform("links", lambda x: x["ticker"])
    unnamed = F.filter("tickers", lambda t: ~F.array_contains(linked, t) & ~F.contains("question", t))
    return F.concat(aliases.cast(f"array<{CLAUSE}>"), one(F.when(F.size(unnamed) > 0, clause("entity", text_of("The company is taken as ", listed(unnamed), "."), True))))


def term() -> Column:
    c = F.col("concept")
    loose = F.filter(c["loose"], lambda w: F.array_contains("spoken", w))
    return one(F.when((F.size(loose) > 0) & ~says(c["words"]), clause("term", text_of("By ", F.get(loose, F.lit(0)), " ", c["name"], " is meant."), True)))


def metric() -> Column:
    c = F.col("concept")
    open_ = c.isNotNull() & ~says(c["words"]) & ~says(c["loose"]) & (c["name"] != "the list of companies")
    vague = F.filter(F.array(*map(F.lit, VAGUE)), lambda w: F.array_contains("spoken", w))
    measured = clause("metric", text_of("What is ", F.get(vague, F.lit(0)), " is measured by ", c["name"], "."), True)
    return one(F.when(open_, F.when(F.col("ranking") & (F.size(vague) > 0) & (F.size("asked") == 0), measured).otherwise(clause("metric", text_of("The figure is ", c["name"], "."), True))))


def unit() -> Column:
    units = F.array_distinct(F.flatten(F.transform(F.filter("companies", lambda c: c["units"].isNotNull()), lambda c: c["units"])))
    asked = F.array_contains("projects", "uom") & F.col("view").isNotNull() & says(("unit", "units", "thousands", "millions"))
    stated = F.when(F.size(units) == 1, clause("unit", text_of("Figures are in ", F.get(units, F.lit(0)), ", not in thousands or millions of it."), False))
    scaled = clause("unit", text_of("Figures are in ", F.col("scale"), "s; the mart holds them whole."), False)
    return one(F.when(F.col("scale").isNotNull() & (F.col("scale") != ""), scaled).when(asked, stated))


def summed() -> Column:
    first = F.get("companies", F.lit(0))
    held = F.when((F.size("asked") == 1) & F.col("view").isNotNull(), F.transform(first["years"], lambda y: y["year"].cast("string")))
    over = clause("sum", text_of("The sum is over fiscal years ", listed(held), ", all that are on record for ", first["name"], "."), True)
    return one(F.when(F.col("sums") & (F.size("years") == 0), F.when(F.size(held) > 0, over).when(F.col("n_rows") == 1, clause("sum", F.lit("The figure is a sum over all that match."), ~says(SUMS)))))


def balance() -> Column:
    c = F.col("concept")
    name = F.concat(F.upper(F.substring(c["name"], 1, 1)), F.lower(F.substring(c["name"], 2, 1 << 20)))
    return one(F.when(c["balance"] & (F.size("years") > 1) & says(SUMS) & ~F.col("sums"), clause("balance", text_of(name, " is what there is on a day, which years don't add up to; each year stands by itself."), True)))


def year_ends() -> Column:
    several = (F.size("asked") > 1) & F.col("latest") & says(COMPARES)
    ranked = F.col("ranking") & ~F.array_contains("columns", "fiscal_year") & (F.size("years") == 0)
    return one(F.when(several | ranked, clause("fiscal_year_ends", F.lit("Companies end their fiscal years on different days, so the same year may not be the same months."), True)))
