"""Filters, joins, aggregates, windows, top-k and set operations over the mart and the raw tables.

Where both engines read the same text, a query is registered once with shared(); otherwise Spark's side is DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import joins, mart, ranges
from ..registry import query
from ..session import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# The mart as common table expressions, for the oracle and for shared texts.
CO = "co AS (SELECT c_custkey AS cik, concat('C', CAST(c_custkey AS VARCHAR(20))) AS ticker, c_name AS name, c_mktsegment AS gics_sector FROM customer)"
FI = "fi AS (SELECT CAST(o_orderkey AS VARCHAR(20)) AS adsh, o_custkey AS cik, o_orderpriority AS form, CAST(year(o_orderdate) AS INT) AS fiscal_year, o_orderstatus AS fiscal_period, CAST(o_orderdate AS DATE) AS period_end_date FROM orders)"
YR = "yr AS (SELECT o_custkey AS cik, CAST(year(o_orderdate) AS INT) AS fy, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1, 2)"
REV = """tagged AS (SELECT o_custkey AS cik, CAST(year(o_orderdate) AS INT) AS fiscal_year, CAST(o_orderdate AS DATE) AS ddate, l_returnflag AS source_tag, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cik, fiscal_year, ddate ORDER BY CASE source_tag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END, value DESC) AS k FROM tagged),
concept AS (SELECT cik, fiscal_year, ddate, source_tag, value FROM ranked WHERE k = 1)"""


def shared(name: str, text: str) -> None:
    """A query whose text means the same to both engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in text:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    run.__doc__ = text
    query(name, text)(run)


@query("flagship_top_revenue", f"WITH {CO}, {REV} SELECT co.ticker, co.name, c.fiscal_year, CAST(sum(c.value) AS DOUBLE) AS revenue FROM concept c JOIN co ON c.cik = co.cik WHERE c.fiscal_year = 1997 GROUP BY 1, 2, 3 ORDER BY sum(c.value) DESC, co.ticker LIMIT 10")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = mart.concept(spark, sf_dir).where("fiscal_year = 1997").groupBy("cik", "fiscal_year").agg(F.sum("value").alias("v"))
    named = year.join(mart.companies(spark, sf_dir), "cik")
    return named.orderBy(F.desc("v"), "ticker").limit(10).select("ticker", "name", "fiscal_year", F.col("v").cast("double").alias("revenue"))


@query("s10_mart_facts", """SELECT tag, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM (
 SELECT l_orderkey, unnest(['Quantity','ExtendedPrice','Discount','Tax']) AS tag,
  unnest([sum(CAST(l_quantity AS DECIMAL(18,2))), sum(CAST(l_extendedprice AS DECIMAL(18,2))), sum(CAST(l_discount AS DECIMAL(18,2))), sum(CAST(l_tax AS DECIMAL(18,2)))]) AS v
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey) GROUP BY tag""")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.facts(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n"), F.sum(F.col("value").cast(mart.MONEY)).cast("double").alias("total"))


@query("w01_concept_priority", f"WITH {REV} SELECT cik, fiscal_year, ddate, source_tag, CAST(value AS DOUBLE) AS value FROM concept")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.concept(spark, sf_dir).withColumn("value", F.col("value").cast("double"))


shared("s02_key_set", f"WITH {CO} SELECT DISTINCT cik FROM co")
shared("f01_projection_rename", f"WITH {FI} SELECT adsh, cik, form, fiscal_year FROM fi")
shared("f04_conjunction", "SELECT count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1")
shared("f05_in_list", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_returnflag")
shared("f06_range", "SELECT count(*) AS n, CAST(min(o_totalprice) AS DOUBLE) AS lowest FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 300000")
shared("f07_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'SMALL%' AND p_name NOT LIKE '%ring'")
shared("f08_all_null_result", """SELECT c_custkey, CAST(count(o_totalprice) AS BIGINT) AS known, count(o_totalprice) = 0 AS is_empty
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '2000-01-01 00:00:00' GROUP BY c_custkey""")
shared("f12_state_filter", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority IS NOT NULL GROUP BY o_orderstatus")
shared("j01_inner", "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
shared("j03_composite", f"WITH {YR}, n AS (SELECT o_custkey AS cik, CAST(year(o_orderdate) AS INT) AS fy, count(*) AS n FROM orders GROUP BY 1, 2) SELECT yr.cik, yr.fy, CAST(v AS DOUBLE) AS v, n FROM yr JOIN n ON yr.cik = n.cik AND yr.fy = n.fy")
shared("j04_left_null_ratio", f"WITH {YR} SELECT c_custkey, CAST(a.v AS DOUBLE) AS v97, CAST(b.v AS DOUBLE) AS v98, CAST(b.v AS DOUBLE) / nullif(CAST(a.v AS DOUBLE), 0) AS ratio FROM customer LEFT JOIN yr a ON a.cik = c_custkey AND a.fy = 1997 LEFT JOIN yr b ON b.cik = c_custkey AND b.fy = 1998")
shared("j05_yoy_self", f"WITH {YR} SELECT a.cik, CAST(b.v - a.v AS DOUBLE) AS change FROM yr a JOIN yr b ON a.cik = b.cik AND a.fy = 1997 AND b.fy = 1998 ORDER BY b.v - a.v DESC, a.cik LIMIT 20")
shared("j06_scalar_cross", f"WITH {YR}, a AS (SELECT sum(v) AS v FROM yr WHERE fy = 1997), b AS (SELECT sum(v) AS v FROM yr WHERE fy = 1998) SELECT CAST(a.v AS DOUBLE) AS v97, CAST(b.v AS DOUBLE) AS v98, CAST(b.v - a.v AS DOUBLE) AS change FROM a CROSS JOIN b")
shared("j07_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '2001-01-01 00:00:00')")
shared("j08_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '2001-01-01 00:00:00')")
shared("j09_scalar_sub", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
shared("j10_correlated_latest", "SELECT o.o_orderkey, o.o_custkey FROM orders o WHERE o.o_orderdate = (SELECT max(i.o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey)")
shared("j11_keyed_lookup", "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) x WHERE k = 1")
RUNS = "runs AS (SELECT o_orderkey AS id, o_custkey % 3 AS model, o_orderpriority AS expected, o_orderstatus AS answer, o_custkey % 7 AS picked FROM orders)"
shared("j12_record_gold", f"WITH {RUNS} SELECT r.expected, n.n_regionkey, count(*) AS n FROM runs r JOIN nation n ON n.n_nationkey = r.picked GROUP BY r.expected, n.n_regionkey")
shared("j13_same_case_runs", f"WITH {RUNS}, c AS (SELECT picked AS case_id, model, min(answer) AS answer FROM runs WHERE answer <> 'P' GROUP BY 1, 2) SELECT a.case_id, a.model AS model_a, b.model AS model_b, a.answer = b.answer AS same FROM c a JOIN c b ON a.case_id = b.case_id AND a.model < b.model")
shared("j14_three_way_bucket", f"""WITH {RUNS}, a AS (SELECT id, answer FROM runs WHERE model = 0), b AS (SELECT id - 1 AS id, answer FROM runs WHERE model = 1)
SELECT CASE WHEN b.id IS NULL OR b.answer = 'P' THEN 'other_abstained' WHEN a.answer = b.answer THEN 'agree' ELSE 'differ' END AS bucket, count(*) AS n FROM a LEFT JOIN b ON a.id = b.id GROUP BY 1""")
shared("j15_ordered_pairs", f"WITH {RUNS}, m AS (SELECT model, count(*) AS n FROM runs GROUP BY model) SELECT a.model AS model_a, b.model AS model_b, a.n - b.n AS ahead FROM m a CROSS JOIN m b WHERE a.model <> b.model")
shared("j21_paired_ab", f"WITH {RUNS} SELECT a.expected, CAST(count(*) FILTER (WHERE a.answer <> 'F' AND b.answer = 'F') AS BIGINT) AS gained, CAST(count(*) FILTER (WHERE a.answer = 'F' AND b.answer <> 'F') AS BIGINT) AS lost FROM runs a JOIN runs b ON b.id = a.id + 1 GROUP BY a.expected")
shared("j22_label_record_pattern", "SELECT l.toxic, count(*) AS n, CAST(count(*) FILTER (WHERE d.text LIKE '%idiot%') AS BIGINT) AS matched FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY l.toxic")
shared("a01_count_where", "SELECT count(*) AS n, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS done FROM orders")
shared("a02_having_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 2")
shared("a03_scaled_sum", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 1e9 AS billions FROM lineitem")
shared("a04_avg_by_sector", "SELECT c_mktsegment, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean FROM customer GROUP BY c_mktsegment")


@query("a05_median", "SELECT o_orderpriority, median(o_totalprice) AS middle FROM orders GROUP BY o_orderpriority")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.median(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", "middle")


shared("a06_min_max", f"WITH {FI} SELECT form, min(fiscal_year) AS first, max(fiscal_year) AS latest FROM fi GROUP BY form")
shared("a07_distinct", "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS forms FROM orders")
shared("a08_pivot_case", f"WITH {YR} SELECT cik, CAST(max(CASE WHEN fy = 1996 THEN v END) AS DOUBLE) AS v96, CAST(max(CASE WHEN fy = 1997 THEN v END) AS DOUBLE) AS v97 FROM yr GROUP BY cik")
shared("a09_cagr", f"WITH {YR}, p AS (SELECT cik, CAST(max(CASE WHEN fy = 1996 THEN v END) AS DOUBLE) AS a, CAST(max(CASE WHEN fy = 1999 THEN v END) AS DOUBLE) AS b FROM yr GROUP BY cik) SELECT cik, round(power(b / a, 1e0 / 3e0) - 1, 6) AS cagr FROM p WHERE a > 0 AND b > 0")
shared("a10_rate", "SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(*) AS share FROM orders GROUP BY o_orderpriority")
shared("a11_rollup_tier", "SELECT coalesce(o_orderpriority, 'overall') AS tier, count(*) AS total, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS pass_1 FROM orders GROUP BY ROLLUP (o_orderpriority)")
shared("a12_bool_or_and", "SELECT user_id, bool_or(event_type = 'purchase') AS any_purchase, bool_and(value >= 0) AS all_positive FROM events GROUP BY user_id")
shared("a24_outcome_partition", "SELECT CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS answered, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS abstained, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS assumed, count(*) AS total FROM orders")
shared("a27_cube", "SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
shared("w06_frames", "SELECT o_custkey, o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last_three, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS quarter FROM orders")
shared("o01_latest", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
shared("o02_top_n", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
shared("o03_top_by_aggregate", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 1")
shared("u01_union", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 1")
shared("u02_stray_names", "SELECT c_name AS stray FROM customer EXCEPT SELECT c_name FROM customer WHERE c_mktsegment <> 'BUILDING'")
shared("u06_intersect_except", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
shared("u05_symmetric_difference", "SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS only_right FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01 00:00:00') a FULL OUTER JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '2001-03-01 00:00:00') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
shared("u04_exact_set_equal", """SELECT (SELECT count(*) FROM (SELECT n_name FROM nation EXCEPT SELECT n_name FROM nation WHERE n_regionkey < 4) x) = 0
 AND (SELECT count(*) FROM (SELECT n_name FROM nation WHERE n_regionkey < 4 EXCEPT SELECT n_name FROM nation) y) = 0 AS equal""")


@query("j02_star", f"WITH {CO}, {FI} SELECT gics_sector, fiscal_year, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem JOIN fi ON adsh = CAST(l_orderkey AS VARCHAR(20)) JOIN co ON co.cik = fi.cik GROUP BY gics_sector, fiscal_year")
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts are summed to their order, and orders to their company and year, before they meet the next dimension."""
    per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast(mart.MONEY)).alias("v"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cik"), F.year("o_orderdate").alias("fiscal_year"))
    yearly = per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("cik", "fiscal_year").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    c = mart.companies(spark, sf_dir).select("cik", "gics_sector")
    return yearly.join(c, "cik").groupBy("gics_sector", "fiscal_year").agg(F.sum("n").alias("n"), F.sum("v").cast("double").alias("total"))


@query("w05_round_robin", "SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_size, p_partkey) - 1) % 10 AS INT) AS dealt_to FROM part")
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = ranges.row_numbers(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", ["p_partkey"], "n")
    return dealt.select("p_partkey", ((F.col("n") - 1) % 10).cast("int").alias("dealt_to"))


@query("o04_nulls_last", "SELECT o_custkey, CAST(k AS INT) AS k FROM (SELECT o_custkey, v, row_number() OVER (ORDER BY v ASC NULLS LAST, o_custkey) AS k FROM (SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS v FROM orders GROUP BY o_custkey) x) y")
def o04(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")))
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(urgent.alias("v"))
    return ranges.row_numbers(best, "v", ["o_custkey"], "k").select("o_custkey", F.col("k").cast("int").alias("k"))


@query("o05_cap_flag", "SELECT (SELECT count(*) FROM orders) > 1000 AS truncated, least((SELECT count(*) FROM orders), 1000) AS n_rows")
def o05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.capped(table(spark, sf_dir, "orders"), 1000)


@query("o06_canonical_rows", "SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ';' ORDER BY o_orderkey || ':' || o_orderstatus) AS canonical FROM orders GROUP BY o_custkey")
def o06(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.col("o_orderkey").cast("string"), F.lit(":"), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(cell)), ";").alias("canonical"))


@query("w02_keep_first", "SELECT * EXCLUDE (k) FROM (SELECT c_nationkey, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k = 1")
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.keep_first(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name"), "c_nationkey", "c_custkey")


CELLS = "c AS (SELECT o_orderkey, o_orderkey % 3 AS kind, o_orderstatus AS a, CAST(o_custkey AS DOUBLE) AS v, CAST(o_totalprice AS DOUBLE) AS w, o_orderpriority AS b FROM orders)"


@query("w04_adjacent_pairs", f"""WITH {CELLS} SELECT o_orderkey, CASE kind WHEN 0 THEN [a, b] WHEN 1 THEN [a, b] ELSE [a] END AS labels, CASE kind WHEN 0 THEN [v, w] WHEN 1 THEN [v, w] ELSE [v] END AS amounts FROM c""")
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of cells in three layouts: label, value, value, label; value, label, value, label; label, value, value."""
    label = lambda c: F.struct(F.col(c).alias("label"), F.lit(None).cast("double").alias("value"))
    value = lambda c: F.struct(F.lit(None).cast("string").alias("label"), F.col(c).cast("double").alias("value"))
    a, b, v, w = label("o_orderstatus"), label("o_orderpriority"), value("o_custkey"), value("o_totalprice")
    kind = F.col("o_orderkey") % 3
    cells = F.when(kind == 0, F.array(a, v, w, b)).when(kind == 1, F.array(v, a, w, b)).otherwise(F.array(a, v, w))
    pairs = table(spark, sf_dir, "orders").select("o_orderkey", joins.paired_cells(cells).alias("p"))
    return pairs.select("o_orderkey", F.col("p.label").alias("labels"), F.col("p.value").alias("amounts"))


SPANS = "s AS (SELECT user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, CAST(floor(min(epoch(ts))) AS BIGINT) AS a, CAST(floor(max(epoch(ts))) AS BIGINT) AS b, min(event_id) AS id FROM events GROUP BY 1, 2)"


@query("j16_interval_overlap", f"WITH {SPANS} SELECT x.id AS id_a, y.id AS id_b, least(x.b, y.b) - greatest(x.a, y.a) AS seconds FROM s x JOIN s y ON x.hour = y.hour AND x.id < y.id AND x.a < y.b AND y.a < x.b")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    spans = e.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.min(second).alias("a"), F.max(second).alias("b"), F.min("event_id").alias("id"))
    return joins.overlaps(spans, "id", "hour", "a", "b")


@query("j17_derived_pairs", """WITH c AS (SELECT n_regionkey AS r, n_nationkey AS k, CAST(n_nationkey * 7 % 25 AS DOUBLE) AS v FROM nation), q AS (SELECT DISTINCT r_regionkey AS r, unnest([12.0, 2.5, 75.0, 400.0, -50.0, 31.0])::DOUBLE AS claim FROM region),
p AS (SELECT a.r, a.k < b.k AS lower, a.v AS a, b.v AS b FROM c a JOIN c b ON a.r = b.r AND a.k <> b.k),
f AS (SELECT r, 'a+b' AS form, a, b, a + b AS x FROM p WHERE lower UNION ALL SELECT r, 'a-b', a, b, a - b FROM p UNION ALL SELECT r, 'a/b', a, b, a / b FROM p WHERE b <> 0
 UNION ALL SELECT r, '100a/b', a, b, 100 * a / b FROM p WHERE b <> 0 UNION ALL SELECT r, '100(a-b)/b', a, b, 100 * (a - b) / b FROM p WHERE b <> 0)
SELECT f.r AS result, claim, form, a, b FROM f JOIN q ON f.r = q.r AND abs(x - claim) <= 1.0""")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("result"), "n_nationkey", (F.col("n_nationkey") * 7 % 25).cast("double").alias("v"))
    claims = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("result"), F.explode(F.array(*(F.lit(float(x)) for x in (12, 2.5, 75, 400, -50, 31)))).alias("claim"))
    return joins.derived(n, claims, "result", "n_nationkey", "v", "claim", 1.0)


PREFIX = "m AS (SELECT DISTINCT substr(n_name, 1, 8) AS mention FROM nation)"


@query("j18_prefix_unique", f"WITH {PREFIX}, h AS (SELECT mention, n_nationkey, count(*) OVER (PARTITION BY mention) AS n FROM m JOIN nation ON starts_with(n_name, mention)) SELECT mention, n_nationkey FROM h WHERE n = 1")
def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    mentions = nation.select(F.substring("n_name", 1, 8).alias("mention")).distinct()
    return joins.unique_prefix(mentions, "mention", nation.select("n_nationkey", "n_name"), "n_name").select("mention", "n_nationkey")


CLASSES = """t AS (SELECT p_partkey, list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''))) AS w FROM part),
c AS (SELECT w, count(*) AS n FROM t WHERE len(w) > 0 GROUP BY w)"""


@query("j19_token_classes", f"WITH {CLASSES} SELECT p_partkey, array_to_string(w, ' ') AS words FROM t WHERE len(w) > 0")
def j19_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.word_classes(table(spark, sf_dir, "part"), "p_partkey", "p_name").select("p_partkey", F.array_join("words", " ").alias("words"))


@query("j19_token_containment", f"WITH {CLASSES} SELECT array_to_string(a.w, ' ') AS small, array_to_string(b.w, ' ') AS large, CASE WHEN a.w = b.w THEN a.n * (a.n - 1) ELSE a.n * b.n END AS pairs FROM c a JOIN c b ON list_has_all(b.w, a.w) WHERE a.w <> b.w OR a.n > 1")
def j19_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = joins.contained_classes(joins.word_classes(table(spark, sf_dir, "part"), "p_partkey", "p_name"))
    return found.select(F.array_join("small", " ").alias("small"), F.array_join("large", " ").alias("large"), "pairs")


AGG2 = "g AS (SELECT o_orderpriority AS k, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1), p AS (SELECT k, v * (CASE WHEN k LIKE '1%' THEN 1.1 ELSE 1.0000001 END) AS v FROM g)"


@query("j20_tolerance_set_equal", f"""WITH {AGG2} SELECT g.k, g.v AS gold, EXISTS (SELECT 1 FROM p WHERE p.k = g.k AND abs(g.v - p.v) <= greatest(abs(g.v) * 1e-6, 1e-9)) AS matched FROM g""")
def j20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.matched_within(*_two_sides(spark, sf_dir), ["k"], "v", 1e-6)


def _two_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.sum(F.col("o_totalprice").cast(mart.MONEY)).cast("double").alias("v"))
    return g, g.select("k", (F.col("v") * F.when(F.col("k").like("1%"), 1.1).otherwise(1.0000001)).alias("v"))


@query("u03_tolerant_set_equality", f"""WITH {AGG2}, m AS (SELECT EXISTS (SELECT 1 FROM p WHERE p.k = g.k AND abs(g.v - p.v) <= greatest(abs(g.v) * 1e-6, 1e-9)) AS ok FROM g
 UNION ALL SELECT EXISTS (SELECT 1 FROM g WHERE p.k = g.k AND abs(p.v - g.v) <= greatest(abs(p.v) * 1e-6, 1e-9)) FROM p)
SELECT count(*) FILTER (ok) = count(*) AS equal, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS unmatched FROM m""")
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = _two_sides(spark, sf_dir)
    return joins.sets_equal(g, p, ["k"], "v", 1e-6)


@query("jx_asof_latest", """SELECT event_id, o_orderkey FROM (SELECT e.event_id, o.o_orderkey, row_number() OVER (PARTITION BY e.event_id ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS k
 FROM (SELECT event_id, user_id, ts - INTERVAL 1200 DAY AS at FROM events) e JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.at) WHERE k = 1""")
def jx(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), (F.col("ts") - F.expr("INTERVAL 1200 DAY")).alias("at"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("at"))
    return joins.as_of(e, o, "key", "at", "event_id", "o_orderkey").select("event_id", "o_orderkey")


@query("a13_mode_first_seen", "SELECT user_id, event_type AS mode, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS k FROM events GROUP BY 1, 2) WHERE k = 1")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.mode_first_seen(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("a14_frequent_values", "SELECT o_orderpriority AS value, n, CAST(k AS INT) AS k FROM (SELECT o_orderpriority, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS k FROM orders GROUP BY 1) WHERE k <= 3")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.frequent_values(table(spark, sf_dir, "orders"), "o_orderpriority", 3)


@query("a15_confusion", "SELECT o_orderpriority AS expected, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS O, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS P FROM orders GROUP BY 1")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.confusion(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]).withColumnRenamed("o_orderpriority", "expected")


SCORED = "x AS (SELECT l.doc_id, l.quality AS y, least(d.n_chars / 5000.0, 1.0)::DOUBLE AS s FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).cast("double").alias("s"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("y"), "s")


@query("a16_prf", f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (s >= 0.2 AND y = 1) AS tp, count(*) FILTER (s >= 0.2 AND y = 0) AS fp, count(*) FILTER (s < 0.2 AND y = 1) AS fn, count(*) FILTER (s < 0.2 AND y = 0) AS tn FROM x)
SELECT tp, fp, fn, tn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall FROM c""")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.precision_recall(scored(spark, sf_dir), F.col("s") >= 0.2, F.col("y") == 1)


@query("a17_ece", f"""WITH {SCORED}, b AS (SELECT CAST(least(floor(s * 10), 9) AS INT) AS bin, count(*) AS n, CAST(sum(y) AS DOUBLE) / count(*) AS acc, CAST(sum(CAST(s AS DECIMAL(18,9))) AS DOUBLE) / count(*) AS conf FROM x GROUP BY 1)
SELECT bin, n, acc, conf, round(n * abs(acc - conf) / (SELECT sum(n) FROM b), 9) AS part FROM b""")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.calibration(scored(spark, sf_dir), "s", "y", 10)


@query("a18_conf_means", f"WITH {SCORED} SELECT round(CAST(sum(CASE WHEN y = 1 THEN CAST(s AS DECIMAL(18,9)) END) AS DOUBLE) / count(*) FILTER (y = 1), 9) AS mean_right, round(CAST(sum(CASE WHEN y = 0 THEN CAST(s AS DECIMAL(18,9)) END) AS DOUBLE) / count(*) FILTER (y = 0), 9) AS mean_wrong FROM x")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.conditional_means(scored(spark, sf_dir), "s", "y")


@query("a19_twin_consistency", f"WITH {SCORED} SELECT count(*) AS pairs, round(avg(CASE WHEN (a.s >= b.s) = (a.y >= b.y) THEN 1.0 ELSE 0.0 END), 9) AS consistent FROM x a JOIN x b ON b.doc_id = a.doc_id + 1")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.twin_consistency(scored(spark, sf_dir), "doc_id", "s", "y")


@query("a20_sorted_set", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("a22_auroc", f"""WITH {SCORED}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM x)
SELECT round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9)::DOUBLE AS auroc FROM r""")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.auroc(scored(spark, sf_dir), "s", F.col("y") == 1)


@query("a21_bootstrap")  # no SQL: tests hold it against the distribution of resampled means
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.bootstrap_mean(table(spark, sf_dir, "labels").select(F.lit("quality").alias("name"), F.col("quality").cast("double").alias("x")), "name", "x")


@query("a23_auroc_ci")  # no SQL: tests hold it against the distribution of resampled areas
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.bootstrap_auroc(scored(spark, sf_dir).withColumn("name", F.lit("n_chars")), "name", "s", "y")


@query("a25_error_class", "SELECT split_part(regexp_extract(props, '\"([a-z]+)\"', 1) || ':' || event_type, ':', 2) AS kind, count(*) AS n FROM events GROUP BY 1")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("event_type"), F.lit(": "), F.col("props"))
    return table(spark, sf_dir, "events").groupBy(F.substring_index(text, ":", 1).alias("kind")).agg(F.count("*").alias("n"))


@query("a26_union_solved", "SELECT CAST(o_custkey % 100 AS BIGINT) AS case_id, bool_or(o_orderstatus = 'P') AS solved FROM orders GROUP BY 1")
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("case_id")).agg(F.bool_or(F.col("o_orderstatus") == "P").alias("solved"))


@query("o07_seeded_draws", "SELECT pool, o_orderkey AS item FROM (SELECT o_custkey % 50 AS pool, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY md5('42|' || CAST(o_custkey % 50 AS VARCHAR) || '|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS k FROM orders) WHERE k <= 5")
def o07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.seeded_draw(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("pool"), "o_orderkey"), "pool", "o_orderkey", 5, 42)


@query("o07_one_per_run", """WITH x AS (SELECT o_custkey % 50 AS pool, o_orderkey % 9 AS run, o_orderkey AS item FROM orders),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool, run ORDER BY md5('42|' || CAST(pool AS VARCHAR) || '|' || CAST(run AS VARCHAR) || '|' || CAST(item AS VARCHAR)), item) AS k FROM x) WHERE k = 1)
SELECT pool, run, item FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY md5('42|' || CAST(pool AS VARCHAR) || '|' || CAST(run AS VARCHAR)), run) AS j FROM e) WHERE j <= 4""")
def o07_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("pool"), (F.col("o_orderkey") % 9).alias("run"), "o_orderkey")
    return agg.one_per_run(x, "pool", "run", "o_orderkey", 4, 42)
