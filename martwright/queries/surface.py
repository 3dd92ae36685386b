"""Sources, scalar functions, guarded statements, auditing, windows over time and the wide mart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, numbers, patterns
from ..operators import audit, ground, mart, metrics
from ..plans import guard, parser, shape
from ..registry import query
from ..session import scratch, table
from ..sources import filings, logs
from ..streaming import windows
from .relational import REV, shared


# Sources: text that is composed from the tables and parsed back.
@query("s01_csv_schema_scan", "SELECT c_mktsegment AS gics_sector, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = mart.companies(spark, sf_dir)
    line = F.to_csv(F.struct("ticker", "name", "cik", "gics_sector"))
    row = F.from_csv(line, "ticker string, name string, cik bigint, gics_sector string")
    return c.select(row.alias("r")).groupBy(F.col("r.gics_sector").alias("gics_sector")).agg(F.count("*").alias("n"), F.sum("r.cik").alias("keys"))


@query("s05_tsv_unquoted", "SELECT p_partkey, '\"' || p_name AS name, p_brand AS brand FROM part")
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), F.col("p_name")), F.col("p_brand"))
    row = F.from_csv(line, "k bigint, name string, brand string", {"sep": "\t", "quote": ""})
    return table(spark, sf_dir, "part").select(row.alias("r")).select(F.col("r.k").alias("p_partkey"), "r.name", "r.brand")


TYPED = "CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 10 = 1 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END"


@query("s08_ingest_stats", f"WITH t AS (SELECT {TYPED} AS v FROM events) SELECT count(*) FILTER (v <> 'n/a') AS rows, count(*) FILTER (v = '') AS null_values, count(*) FILTER (v = 'n/a') AS skipped FROM t")
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    raw = table(spark, sf_dir, "events").select(F.when(k % 10 == 0, "").when(k % 10 == 1, "n/a").otherwise(k.cast("string")).alias("value"), F.lit("4").alias("qtrs"))
    return filings.stats(filings.typed_num(raw))


EVENTS_TYPED = f"t AS (SELECT event_id, user_id, {TYPED} AS v FROM events)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    raw = table(spark, sf_dir, "events").select(k, (F.col("user_id") % 7).alias("quarter"), F.when(k % 10 == 0, "").when(k % 10 == 1, "n/a").otherwise(k.cast("string")).alias("value"), F.lit("4").alias("qtrs"))
    return filings.typed_num(raw)


@query("s08_ingest_observed", f"WITH {EVENTS_TYPED} SELECT count(*) FILTER (v <> 'n/a') AS rows, count(*) FILTER (v = '') AS null_values, count(*) FILTER (v = 'n/a') AS skipped, count(*) FILTER (v <> 'n/a') AS stored FROM t")
def s08_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted while the rows are written by partition, and the rows that are then there."""
    path = scratch(spark)
    seen = filings.ingest(_facts(spark, sf_dir), path)
    return spark.read.parquet(path).agg(*(F.lit(seen[c]).cast("long").alias(c) for c in ("rows", "null_values", "skipped")), F.count("*").alias("stored"))


@query("s07_partition_loads", f"WITH {EVENTS_TYPED} SELECT CAST(user_id % 7 AS INTEGER) AS quarter, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM t WHERE v <> 'n/a' AND (user_id % 7 <> 3 OR event_id % 2 = 0) GROUP BY 1")
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quarters are loaded twice, and then one again with fewer rows: partitions are replaced, others stay."""
    path, rows = scratch(spark), _facts(spark, sf_dir)
    for part in (rows, rows, rows.where("quarter = 3 AND event_id % 2 = 0")):
        filings.replace_partitions(part.where("NOT bad").select("event_id", "quarter"), path)
    return spark.read.parquet(path).groupBy("quarter").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("s05_tsv_file", "SELECT p_partkey, p_name || ' \"' || p_brand || '\" ' || chr(39) AS said, CAST(p_size AS VARCHAR) AS size FROM part")
def s05_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as tab-separated files, quotes and all, and read as such."""
    path = scratch(spark)
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(' "'), "p_brand", F.lit("\" '")).alias("said"), F.col("p_size").cast("string").alias("size"))
    part.write.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return filings.tsv(spark, path, "p_partkey long, said string, size string")


@query("f02_int_rejects", f"WITH t AS (SELECT TRY_CAST({TYPED} AS INT) AS v FROM events) SELECT count(v) AS kept, count(*) - count(v) AS rejected FROM t")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    raw = table(spark, sf_dir, "events").select(F.when(k % 10 == 0, "").when(k % 10 == 1, "n/a").otherwise(k.cast("string")).alias("v"))
    t = raw.select(F.expr("try_cast(v AS INT)").alias("v"))
    return t.agg(F.count("v").alias("kept"), (F.count("*") - F.count("v")).alias("rejected"))


@query("s17_evidence_pack", "SELECT o_custkey AS case_id, o_custkey % 3 AS model, o_orderpriority AS profile, count(*) AS n, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS members FROM orders GROUP BY 1, 2, 3")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("model"), F.col("o_orderpriority").alias("profile"), F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("idx"), F.lit("").alias("sql"), F.lit(True).alias("ok"))
    e = logs.evidence(runs)
    return e.select("case_id", "model", "profile", F.size("candidates").cast("long").alias("n"), F.array_join(F.transform("candidates", lambda c: c["idx"].cast("string")), ",").alias("members"))


@query("s19_html_tables")  # no SQL: what looks like a row inside a script or a comment is none
def s19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(logs.html_tables(F.col("html"))).alias("n_rows"))


# Scalar functions.
@query("x_s01_name_tokens", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''))), ' ') AS words FROM part")
def xs01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(names.tokens(F.col("p_name"))), " ").alias("words"))


@query("x_s11_unfenced", "SELECT p_partkey, 'SELECT ' || p_partkey AS sql FROM part")
def xs11(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = F.concat(F.lit("SELECT "), F.col("p_partkey").cast("string"))
    fenced = F.concat(F.lit("Either ```sql\nSELECT 0``` or\n```sql\n"), sql, F.lit("\n```\nas asked"))
    return table(spark, sf_dir, "part").select("p_partkey", patterns.unfenced(F.when(F.col("p_partkey") % 2 == 0, fenced).otherwise(sql)).alias("sql"))


@query("x_s12_normal_sql", "SELECT p_partkey, 'select ' || p_partkey || ' from t' AS sql FROM part")
def xs12(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  SELECT   "), F.col("p_partkey").cast("string"), F.lit("\n FROM  t ; "))
    return table(spark, sf_dir, "part").select("p_partkey", patterns.normal_sql(raw).alias("sql"))


@query("x_s16_name_class", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'inverted_the' WHEN 1 THEN 'share_class' WHEN 2 THEN 'punctuated' ELSE 'multi_word' END AS class FROM customer")
def xs16(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.element_at(F.array(F.lit(" Company (The)"), F.lit(" Class A"), F.lit(" & Sons"), F.lit(" Brothers")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", names.shape(F.concat(F.lit("Acme"), ends)).alias("class"))


@query("x_s17_display_name", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'The ' || c_mktsegment ELSE c_mktsegment END AS shown FROM customer")
def xs17(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(" (The)"))).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", names.display(stored).alias("shown"))


@query("x_s19_abstain_codes", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'NO_DATA' ELSE '' END AS codes FROM orders")
def xs19(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("ABSTAIN:NO_DATA"), F.lit("42"))).otherwise(F.array(F.lit("42")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(patterns.abstain_codes(accepted), ",").alias("codes"))


@query("x_s20_rubric", "SELECT doc_id, contains(lower(text), 'the') AND (contains(lower(text), 'idiot') OR contains(lower(text), 'scum')) AS passed FROM documents")
def xs20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", patterns.rubric(F.lower(F.col("text")), [(["the"], 1), (["idiot", "scum"], 1)]).alias("passed"))


@query("x_s21_judge_reply", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS verdict FROM orders")
def xs21(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(F.lit(" Yes, it does."), F.lit("**No**"), F.lit("Perhaps")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", patterns.judge_reply(said).alias("verdict"))


@query("x_s04_years", "SELECT o_orderkey, CAST(greatest(year(o_orderdate), 2000) AS INT) AS y FROM orders WHERE year(o_orderdate) >= 2000")
def xs04(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(F.year("o_orderdate") >= 2000)
    two = F.concat(F.lit("FY"), F.lpad((F.year("o_orderdate") - 2000).cast("string"), 2, "0"))
    return o.select("o_orderkey", F.element_at(patterns.year_list(F.concat(F.lit("In "), two, F.lit(" and item 120005"))), 1).alias("y"))


@query("x_d1_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders")
def xd1(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", F.expr("CAST(try_to_timestamp(t, 'yyyyMMdd') AS DATE)").alias("d"))


@query("x_d2_long_date", "SELECT o_orderkey, strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) AS d FROM orders")
def xd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMMM d, yyyy").alias("d"))


shared("x_d3_overlap_seconds", "SELECT event_id, CAST(minute(ts) * 60 + second(ts) AS BIGINT) AS into_hour FROM events")
shared("x_m1_precision", "SELECT o_orderkey, abs(round(o_totalprice / 1000) * 1000 - o_totalprice) <= 500 * (1 + 1e-9) AS states, abs(round(o_totalprice / 1000) * 1000 + 1000 - o_totalprice) <= 500 * (1 + 1e-9) AS off FROM orders")
shared("x_m4_ratio", "SELECT l_orderkey, l_linenumber, abs(l_discount - (l_discount * 100) * 0.01) <= 1e-9 AS as_percent, abs(l_discount - l_discount * 100) <= 1e-9 AS raw FROM lineitem")
shared("x_m5_scale", "SELECT o_orderkey, abs(o_totalprice - (o_totalprice / 1e6) * 1e6) <= greatest(o_totalprice * 1e-6, 1e-9) AS same FROM orders")


@query("x_h1_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def xh1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))




@query("x_s13_shown_values", "SELECT c_custkey, CASE WHEN c_custkey BETWEEN 1900 AND 2099 THEN CAST(c_custkey AS VARCHAR) ELSE format('{:,}', c_custkey) END AS shown FROM customer")
def xs13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.shown_number(F.col("c_custkey")).alias("shown"))


@query("x_j1_json", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events")
def xj1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(F.to_json(F.struct(F.from_json("props", "k int").alias("p"))), "$.p.k").cast("int").alias("k"))


# Guarded statements: a corpus, one for each way the guard can decide.
CORPUS = (
    ("anchored", "SELECT name FROM companies WHERE ticker = 'C1'", "ok", True),
    ("aggregate", "SELECT count(*) AS n FROM companies", "ok", False),
    ("cte", "WITH a AS (SELECT cik, max(fiscal_year) AS y FROM filings GROUP BY cik) SELECT y FROM a", "ok", False),
    ("union", "SELECT cik FROM companies WHERE cik = 1 UNION SELECT cik FROM filings WHERE cik = 2", "ok", True),
    ("comment", "SELECT name FROM companies WHERE cik = 5 -- ; DROP TABLE companies", "ok", True),
    ("two", "SELECT 1; SELECT 2", "single_statement", False),
    ("drop", "DROP TABLE companies", "read_only", False),
    ("except", "SELECT cik FROM companies EXCEPT SELECT cik FROM filings", "read_only", False),
    ("insert", "INSERT INTO companies SELECT * FROM companies", "read_only", False),
    ("raw_table", "SELECT c_name FROM customer LIMIT 5", "schema_allowlist", False),
    ("file", "SELECT * FROM csv.`/etc/passwd` LIMIT 1", "schema_allowlist", False),
    ("generator", "SELECT * FROM range(10) LIMIT 1", "schema_allowlist", False),
    ("inner", "SELECT name FROM companies WHERE cik = (SELECT max(k) FROM secret)", "schema_allowlist", True),
    ("column", "SELECT salary FROM companies WHERE cik = 1", "schema_allowlist", True),
    ("all_rows", "SELECT * FROM companies", "cost_limit", False),
    ("bare_table", "TABLE companies", "cost_limit", False),
    ("broken", "SELEC 1", "EXEC_ERROR", False),
)


# what the accepted statements of the corpus return, as counts
RETURNED = """SELECT 'anchored' AS name, count(*) AS n FROM customer WHERE 'C' || c_custkey = 'C1' UNION ALL SELECT 'aggregate', 1 UNION ALL SELECT 'cte', count(DISTINCT o_custkey) FROM orders
 UNION ALL SELECT 'union', count(*) FROM (SELECT c_custkey FROM customer WHERE c_custkey = 1 UNION SELECT o_custkey FROM orders WHERE o_custkey = 2) UNION ALL SELECT 'comment', count(*) FROM customer WHERE c_custkey = 5"""


def _executed(spark: SparkSession, statements: list[tuple[str, str]]) -> DataFrame:
    """(name, n): how many rows each statement returns, all in one query over the mart."""
    counts = [spark.sql(sql).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, sql in statements]
    return reduce(DataFrame.unionByName, counts)


@query("p06_guard_corpus", f"WITH r AS ({RETURNED}) SELECT t.*, r.n FROM (VALUES " + ", ".join(f"('{n}', '{v}', {str(a).lower()})" for n, _, v, a in CORPUS) + ") t(name, verdict, anchored) LEFT JOIN r ON r.name = t.name")
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard's verdicts, and what the statements that it lets through return when they run over the whole mart."""
    mart.register(spark, sf_dir)
    rows, passed = [], []
    for name, sql, _, _ in CORPUS:
        r = guard.validate(spark, sql)
        rows.append((name, "ok" if r.ok else (r.events[0] if r.events else r.reason_code), shape.entity_bound(spark, sql)))
        passed += [(name, sql)] if r.ok else []
    return spark.createDataFrame(rows, "name string, verdict string, anchored boolean").join(_executed(spark, passed), "name", "left")


EMPTY = (("false", "SELECT name FROM companies WHERE 1 = 0", True), ("nulls", "SELECT NULL AS a, NULL AS b", True), ("both", "SELECT name FROM companies WHERE cik = 1 AND 1 = 2", True), ("real", "SELECT name FROM companies WHERE cik = -1", False), ("value", "SELECT 1 AS a", False))


@query("f11_tautology", "SELECT t.name, t.empty, CASE t.name WHEN 'nulls' THEN 1 WHEN 'value' THEN 1 WHEN 'real' THEN (SELECT count(*) FROM customer WHERE c_custkey = -1) ELSE 0 END AS n FROM (VALUES " + ", ".join(f"('{n}', {str(v).lower()})" for n, _, v in EMPTY) + ") t(name, empty)")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is empty by its plan alone, beside what the statements return over the mart."""
    mart.register(spark, sf_dir)
    found = spark.createDataFrame([(n, shape.tautologically_empty(spark, sql)) for n, sql, _ in EMPTY], "name string, empty boolean")
    return found.join(_executed(spark, [(n, sql) for n, sql, _ in EMPTY]), "name")


@query("e06_sql_facts", f"WITH {REV} SELECT 'C' || cik AS ticker, CAST(sum(value) AS DOUBLE) / 1e9 AS b, 'v_revenue' AS views, '1997' AS years, true AS sums, 'billion' AS scale, true AS ranking, false AS latest FROM concept WHERE fiscal_year = 1997 GROUP BY cik ORDER BY b DESC, ticker LIMIT 30")
def e06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement's result over the mart, with the facts that its plan tells beside each row."""
    mart.register(spark, sf_dir)
    sql = "SELECT ticker, sum(value) / 1e9 AS b FROM v_revenue WHERE fiscal_year = 1997 GROUP BY ticker ORDER BY b DESC, ticker LIMIT 30"
    f = shape.facts(parser.parse(spark, sql))
    told = {"views": ",".join(f.views), "years": ",".join(map(str, f.years)), "sums": f.sums, "scale": f.scale, "ranking": f.ranking, "latest": f.latest}
    return spark.sql(sql).select("ticker", F.col("b").cast("double").alias("b"), *(F.lit(v).alias(k) for k, v in told.items()))


@query("g05_company_refs", "SELECT c_custkey AS cik FROM customer WHERE c_custkey IN (3, 4) OR c_name = (SELECT c_name FROM customer WHERE c_custkey = 5)")
def g05(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart.register(spark, sf_dir)
    name = spark.table("companies").where("cik = 5").first()["name"]
    refs = shape.company_refs(parser.parse(spark, f"SELECT 1 FROM companies WHERE (cik IN (3, 4) OR upper(name) = '{name}') AND NOT ticker = 'C9'"))
    return shape.resolved(spark, refs)


@query("e03_name_to_ticker", f"WITH {REV} SELECT 'C' || cik AS ticker, fiscal_year, CAST(sum(value) AS DOUBLE) AS value FROM concept WHERE cik IN (7, 8) GROUP BY cik, fiscal_year")
def e03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement that asks by names that the mart doesn't hold, rewritten to their tickers, and run."""
    mart.register(spark, sf_dir)
    asked = "SELECT ticker, fiscal_year, sum(value) AS value FROM v_revenue WHERE name = 'Acme' OR name = 'Bolt Works' GROUP BY ticker, fiscal_year"
    return spark.sql(shape.names_to_tickers(spark, asked, {"Acme": "C7", "Bolt Works": "C8"})).select("ticker", "fiscal_year", F.col("value").cast("double").alias("value"))


@query("g04_two_auditors", "SELECT s_suppkey, s_suppkey % 3 = 2 AS verified, CASE s_suppkey % 3 WHEN 0 THEN 'ungrounded' WHEN 1 THEN 'derived' ELSE 'grounded' END AS worst FROM supplier")
def g04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with a figure, a sum of two figures or neither, before the verifier and the auditor."""
    a = (F.col("s_suppkey") * 1_234_567 + 1_000_003).cast("decimal(18,0)") / 100
    b = (F.col("s_suppkey") * 31 + 17).cast("decimal(18,0)") / 100
    told = F.when(F.col("s_suppkey") % 3 == 0, a + 7).when(F.col("s_suppkey") % 3 == 1, a + b).otherwise(a)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.format_string("It came to $%s.", F.format_number(told, 2)).alias("text"), F.array(a.cast("double"), b.cast("double")).alias("cells"), F.array(F.col("s_name")).alias("strings"))
    verdicts = ground.grounded(s, "s_suppkey", "text", "cells", "strings").select("s_suppkey", F.col("ok").alias("verified"))
    return verdicts.join(s.select("s_suppkey", audit.worst(F.col("text"), F.col("cells"), F.col("strings")).alias("worst")), "s_suppkey")


# o_totalprice and the order's quantity are the result; texts by o_orderkey modulo 7
AUDITED = """q AS (SELECT l_orderkey AS k, CAST(sum(l_quantity) AS DECIMAL(18,2)) AS b FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, o_custkey AS cik, CAST(o_totalprice AS DECIMAL(18,2)) AS a, b, year(o_orderdate) + 10 AS y FROM orders JOIN q ON k = o_orderkey),
x AS (SELECT *, CASE WHEN k % 3 = 0 THEN NULL ELSE cik END AS company, CASE k % 7 WHEN 0 THEN a WHEN 1 THEN 1 WHEN 2 THEN a + b WHEN 3 THEN y WHEN 4 THEN a * 3 + 7.77 WHEN 5 THEN 2000 + k % 100 ELSE round(a, -3) END AS v,
 CASE k % 7 WHEN 1 THEN 0.5 WHEN 6 THEN CASE WHEN round(a, -3) = 0 THEN 0.5 ELSE 500 END ELSE 0.005 END AS h, k % 7 IN (3, 5) AS is_year FROM o),
l AS (SELECT DISTINCT cik, y FROM o), d AS (SELECT DISTINCT y FROM o),
f AS (SELECT x.*, unnest([a + b, a - b, b - a, CAST(CASE WHEN b <> 0 THEN CAST(a AS DOUBLE) / CAST(b AS DOUBLE) END AS DECIMAL(38,10)), CAST(CASE WHEN a <> 0 THEN CAST(b AS DOUBLE) / CAST(a AS DOUBLE) END AS DECIMAL(38,10)), CAST(CASE WHEN b <> 0 THEN 100 * CAST(a AS DOUBLE) / CAST(b AS DOUBLE) END AS DECIMAL(38,10)),
 CAST(CASE WHEN a <> 0 THEN 100 * CAST(b AS DOUBLE) / CAST(a AS DOUBLE) END AS DECIMAL(38,10)), CAST(CASE WHEN b <> 0 THEN 100 * CAST(a - b AS DOUBLE) / CAST(b AS DOUBLE) END AS DECIMAL(38,10)), CAST(CASE WHEN a <> 0 THEN 100 * CAST(b - a AS DOUBLE) / CAST(a AS DOUBLE) END AS DECIMAL(38,10))]) AS made FROM x),
g AS (SELECT k, bool_or(abs(made - v) <= h) AS derived FROM f WHERE a <> b GROUP BY 1)"""


@query(
    "g04_five_tiers",
    f"""WITH {AUDITED} SELECT x.k AS o_orderkey, CASE WHEN NOT is_year AND k % 7 <> 6 AND (abs(a - v) <= h OR abs(b - v) <= h) THEN 'grounded' WHEN is_year AND EXISTS (SELECT 1 FROM l WHERE l.cik = x.company AND l.y = x.v) THEN 'grounded'
 WHEN is_year AND (regexp_matches(CAST(a AS VARCHAR) || ' ' || CAST(b AS VARCHAR), '(^|[^0-9])' || CAST(CAST(v AS INTEGER) AS VARCHAR) || '($|[^0-9])') OR abs(a - v) < 0.5 OR abs(b - v) < 0.5) THEN CASE WHEN abs(a - v) <= 0.5 OR abs(b - v) <= 0.5 THEN 'grounded' ELSE 'weak' END
 WHEN k % 7 = 6 THEN CASE WHEN abs(a - v) <= 0.5 OR abs(b - v) <= 0.5 THEN 'grounded' WHEN abs(a - v) <= h OR abs(b - v) <= h THEN 'weak' ELSE 'ungrounded' END
 WHEN k % 7 = 1 THEN 'weak' WHEN is_year THEN CASE WHEN company IS NULL AND EXISTS (SELECT 1 FROM d WHERE d.y = x.v) THEN 'unresolved' ELSE 'ungrounded' END
 WHEN coalesce((SELECT derived FROM g WHERE g.k = x.k), false) THEN 'derived' ELSE 'ungrounded' END AS tier FROM x""",
)
def g04_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's answer against its total and quantity; two of three are about a company, whose years are those of its orders."""
    k, a, b = F.col("o_orderkey"), F.col("a"), F.col("b")
    money = "decimal(18,2)"
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("_k")).agg(F.sum("l_quantity").cast(money).alias("b"))
    o = table(spark, sf_dir, "orders").join(lines, k == F.col("_k")).withColumn("a", F.col("o_totalprice").cast(money)).withColumn("y", F.year("o_orderdate") + 10)
    price = lambda x: F.concat(F.lit("It came to "), x.cast(money).cast("string"), F.lit("."))
    year = lambda x: F.concat(F.lit("That was in FY"), x.cast("string"), F.lit("."))
    kinds = [price(a), F.lit("1 row has it."), price(a + b), year(F.col("y")), price(a * 3 + F.lit("7.77").cast(money)), year(F.lit(2000) + k % 100), F.concat(F.lit("It came to about "), F.round(a, -3).cast("long").cast("string"), F.lit("."))]
    said = o.select(k, F.get(F.array(*kinds), (k % 7).cast("int")).alias("text"), F.array(a, b).alias("numbers"), F.array("o_orderpriority").alias("strings"), F.lit(1).alias("n"), F.lit(None).cast("string").alias("sql"), F.when(k % 3 != 0, F.col("o_custkey")).alias("company"))
    labels = o.select(F.col("o_custkey").alias("cik"), F.col("y").alias("year"))
    return audit.tiers(said, "o_orderkey", "text", "numbers", "strings", "n", "sql", "company", labels).select("o_orderkey", "tier")


@query("g06_company_labels", "SELECT o_custkey AS cik, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ',' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS years FROM orders GROUP BY 1")
def g06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.company_labels(mart.filings(spark, sf_dir)).select("cik", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))


@query("g08_changed_verdicts", "SELECT CASE WHEN old = new THEN 'same' WHEN new THEN 'now_passes' ELSE 'now_fails' END AS change, count(*) AS n FROM (SELECT o_orderkey % 5 <> 0 AS old, o_orderkey % 7 <> 0 AS new FROM orders) GROUP BY 1")
def g08(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    change = F.when((k % 5 != 0) == (k % 7 != 0), "same").when(k % 7 != 0, "now_passes").otherwise("now_fails")
    return table(spark, sf_dir, "orders").groupBy(change.alias("change")).agg(F.count("*").alias("n"))


# Windows over event time, in their batch form.
@query("k1_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(_stamped(spark, sf_dir), "ts", "1 hour", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("k2_sliding", "SELECT b + INTERVAL (-30 * i) MINUTE AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b FROM events), (SELECT unnest([0, 1]) AS i) GROUP BY 1")
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding(_stamped(spark, sf_dir), "ts", "1 hour", "30 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("k3_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS begins, event_id FROM events),
s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(_stamped(spark, sf_dir), "ts", "2 hours", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# The wide mart.
FLOWS = [f"{m}_{f}" for f in "ANR" for m in ("quantity", "price", "discount", "tax")]
INSTANTS = ["last_total", "last_key"]
_SUMS = ", ".join(f"sum(CASE WHEN l_returnflag = '{f}' THEN CAST({c} AS DECIMAL(18,2)) END) AS {m}_{f}" for f in "ANR" for m, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount"), ("tax", "l_tax")))
_LAST = "max_by(CAST(o_totalprice AS DECIMAL(18,2)), (o_orderdate, o_orderkey)) AS last_total, CAST(max_by(o_orderkey, (o_orderdate, o_orderkey)) AS DECIMAL(18,2)) AS last_key"


def _wide(period: str) -> str:
    """The fourteen metrics by company, year and period, as common table expressions w_<period>."""
    p = "'Q' || quarter(o_orderdate)" if period == "q" else "'FY'"
    return f"""l_{period} AS (SELECT o_custkey AS cik, CAST(year(o_orderdate) AS INT) AS fy, {p} AS fp, {_SUMS} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
o_{period} AS (SELECT o_custkey AS cik, CAST(year(o_orderdate) AS INT) AS fy, {p} AS fp, {_LAST} FROM orders GROUP BY 1, 2, 3), w_{period} AS (SELECT * FROM o_{period} LEFT JOIN l_{period} USING (cik, fy, fp))"""


def _double(names: list[str], prefix: str = "") -> str:
    return ", ".join(f"CAST({prefix}{n} AS DOUBLE) AS {n}" for n in names)


@query("wide1_metrics", f"WITH {_wide('q')} SELECT cik, fy, fp, {_double(FLOWS + INSTANTS)} FROM w_q")
def wide1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.wide(spark, sf_dir, F.concat(F.lit("Q"), F.quarter("o_orderdate"))).select("cik", "fy", "fp", *(F.col(c).cast("double").alias(c) for c in FLOWS + INSTANTS))


@query("wide2_q4", f"""WITH {_wide('q')}, {_wide('y')}, early AS (SELECT * FROM w_q WHERE fp <> 'Q4'),
s AS (SELECT cik, fy, {", ".join(f"CASE WHEN count({n}) = 3 THEN sum({n}) END AS {n}" for n in FLOWS)} FROM early GROUP BY 1, 2)
SELECT cik, fy, fp, {_double(FLOWS + INSTANTS)}, false AS is_derived FROM early
UNION ALL SELECT w_y.cik, w_y.fy, 'Q4', {", ".join(f"CAST(w_y.{n} - s.{n} AS DOUBLE) AS {n}" for n in FLOWS)}, {_double(INSTANTS, "w_y.")}, true FROM w_y LEFT JOIN s USING (cik, fy)""")
def wide2(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = mart.derived_q4(mart.wide(spark, sf_dir, F.concat(F.lit("Q"), F.quarter("o_orderdate"))), FLOWS, INSTANTS)
    return both.select("cik", "fy", "fp", *(F.col(c).cast("double").alias(c) for c in FLOWS + INSTANTS), "is_derived")


@query("wide3_tag_dictionary", "SELECT tag, version, kind FROM (SELECT p_brand AS tag, p_size AS version, p_type AS kind, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey DESC) AS k FROM part) WHERE k = 1")
def wide3(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("tag"), F.col("p_size").alias("version"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("quarter"))
    return filings.tag_dictionary(p).select("tag", "version", "kind")


@query(
    "m08_decision",
    """WITH x AS (SELECT o_custkey AS c, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS arm, CAST(o_orderstatus = 'F' AS INT) AS strict, CAST(o_orderstatus <> 'O' OR o_orderkey % 5 = 0 AS INT) AS loose FROM orders),
g AS (SELECT c, count(*) FILTER (arm = 1) AS n1, count(*) FILTER (arm = 0) AS n0, avg(strict) FILTER (arm = 1) AS s1, avg(strict) FILTER (arm = 0) AS s0, avg(loose) FILTER (arm = 1) AS l1, avg(loose) FILTER (arm = 0) AS l0 FROM x GROUP BY 1),
d AS (SELECT c, s1 - s0 AS ds, 1.959964 * sqrt(s1 * (1 - s1) / n1 + s0 * (1 - s0) / n0) AS ws, l1 - l0 AS dl, 1.959964 * sqrt(l1 * (1 - l1) / n1 + l0 * (1 - l0) / n0) AS wl FROM g WHERE n1 > 0 AND n0 > 0)
SELECT c, CASE WHEN round(ds - ws, 9) > 0 AND round(dl - wl, 9) > 0 THEN 'on' WHEN round(ds + ws, 9) < 0 OR round(dl + wl, 9) < 0 THEN 'off' WHEN round(ds, 9) > 0 AND round(dl, 9) > 0 THEN 'on' ELSE 'off' END AS verdict FROM d""",
)
def m08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as records with a part on or off: would it be kept, by two measures of being right."""
    k = F.col("o_orderkey")
    x = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), (k % 2 == 0).alias("on"), (F.col("o_orderstatus") == "F").alias("strict"), ((F.col("o_orderstatus") != "O") | (k % 5 == 0)).alias("loose"))
    return metrics.decisions(x, "c", "on", "strict", "loose")


@query("m14_acceptance", """WITH t AS (SELECT o_orderpriority AS tier, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS "right" FROM orders GROUP BY 1)
SELECT *, "right" / total::DOUBLE AS rate, CAST(row_number() OVER (ORDER BY "right" DESC, tier) AS INT) AS place, "right" / total::DOUBLE >= CASE tier WHEN '1-URGENT' THEN 0.9 WHEN '2-HIGH' THEN 0.1 ELSE 0 END AS accepted FROM t""")
def m14(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.metrics import acceptance

    x = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("t"), (F.col("o_orderstatus") == "F").alias("ok"))
    return acceptance(x, "t", "ok", {"1-URGENT": 0.9, "2-HIGH": 0.1})
