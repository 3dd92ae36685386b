"""URL filters: a blocked Bloom filter in front of an exact hash join.

Lists hold canonical URLs: a host in lower case and a path prefix, joined, as in `example.com/en/`. A URL has one
canonical form for every ending of its host with as many labels as some listed host has, and every prefix of its path that
is as long as some listed path. The Bloom filter is a table of blocks of 256 bits: a hash picks the block, in which five
more bits must be set. It has 16 bits for each listed URL, so it is sized by the list, and meets the forms by block. What it
passes is joined with the list itself, which removes its false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, without

BLOCK_BITS = 256
PROBES = 5
FEW_BLOCKS = 1 << 17  # a filter of no more blocks (4 MB of bits) is broadcast
FEW_ENTRIES = 20_000  # a list of no more entries is broadcast for the exact join

# The rules of the contract, (verdict, host, path prefix).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
# The listed canonical URLs for pages that no rule fits: hosts whose names sell something.
LISTED = tuple((f"{name}.example.{tld}", "/") for name in ("spam-farm", "cheap-pills", "free-bets", "casino-win") for tld in ("com", "net", "org"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, in lower case (A-Z), and the path; both empty without a ://."""
    rest = F.coalesce(F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def entries(spark: SparkSession, rules=RULES, listed=LISTED) -> DataFrame:
    """(host, path, verdict, is_rule): rules first; a listed URL without a rule is blocked."""
    rows = [(h, p, v, True) for v, h, p in rules] + [(h, p, "block", False) for h, p in listed]
    return spark.createDataFrame(rows, "host string, path string, verdict string, is_rule boolean")


def _bits(canonical: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a canonical URL, and its bits in there: nine bits each of one hash, the low eight of which count."""
    h = F.xxhash64(canonical)
    g = F.xxhash64(canonical, F.lit("bits"))
    return F.pmod(h, F.lit(blocks)).cast("int"), [F.shiftrightunsigned(g, 9 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for i in range(PROBES)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, words array<long>): the filter's blocks with any bit set, each as four words."""
    block, bits = _bits(F.concat("host", "path"), blocks)
    rows = listed.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
    words = [F.coalesce(F.bit_or(F.when(F.shiftright("bit", 6) == k, F.expr("shiftleft(1L, bit & 63)"))), F.lit(0).cast("long")) for k in range(BLOCK_BITS // 64)]
    return rows.groupBy("block").agg(F.array(*words).alias("words"))


def blocks_for(n: int) -> int:
    """16 bits an entry."""
    return max(1, -(-n * 16 // BLOCK_BITS))


def _counted(listed: DataFrame, number: Column) -> list[int]:
    """The different values of a number of listed URLs, such as the lengths of their paths; they are at most as many as the longest is long."""
    return sorted(r[0] for r in listed.select(number.alias("n")).distinct().collect())


def _numbers(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<int>")


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url", blocks: int | None = None) -> DataFrame:
    """pages with host, path, rule (the longest rule that fits, or null) and verdict (allow or block).

    verdict is the rule's; where no rule fits, block if a listed URL fits and allow otherwise. listed as of entries().
    Null urls and urls without :// have empty host and path and are allowed. Urls of any length are judged whole. Repeated
    rows each keep their row. Of rules equal in host and path the one that blocks wins. An empty list allows everything, an
    empty table gives an empty result. Further columns stay, whatever their names; columns named host, path, rule or verdict
    are replaced.
    """
    n = listed.count()
    blocks = blocks or blocks_for(n)
    kept = without(pages.columns, "host", "path", "rule", "verdict")
    known_host, known_path, best = fresh([*kept, "host", "path", "rule", "verdict"], "known_host", "known_path", "best")
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    labels = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1
    counts, lengths = _counted(listed, F.size(F.split("host", "[.]", -1))), _counted(listed, F.length("path"))
    endings = F.transform(F.filter(_numbers(counts), lambda k: k <= labels), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    prefixes = F.transform(F.filter(_numbers(lengths), lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    forms = rows.select("host", "path", F.explode(endings).alias("h")).select("host", "path", "h", F.explode(prefixes).alias("p"))
    block, bits = _bits(F.concat("h", "p"), blocks)
    filled = bloom(listed, blocks)
    probed = forms.withColumn("block", block).join(F.broadcast(filled) if blocks <= FEW_BLOCKS else filled, "block")
    hit = F.lit(True)
    for bit in bits:
        word = F.element_at("words", F.shiftright(bit, 6) + 1)
        hit = hit & (F.expr("1L").bitwiseAND(_shift(word, bit.bitwiseAND(F.lit(63)))) == 1)
    possible = probed.where(hit).select("host", "path", "h", "p")
    exact = listed.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict", "is_rule")
    sure = possible.join(F.broadcast(exact) if n <= FEW_ENTRIES else exact, ["h", "p"])
    rank = F.struct("is_rule", (F.length("h") + F.length("p")).alias("n"), (F.col("verdict") == "block").alias("b"), F.concat("h", "p").alias("rule"), "verdict")
    known = sure.groupBy(F.col("host").alias(known_host), F.col("path").alias(known_path)).agg(F.max(rank).alias(best))
    out = rows.join(known, (F.col("host") == F.col(known_host)) & (F.col("path") == F.col(known_path)), "left")
    rule = F.when(F.col(best)["is_rule"], F.col(best)["rule"])
    return out.select(*kept, "host", "path", rule.alias("rule"), F.coalesce(F.col(best)["verdict"], F.lit("allow")).alias("verdict"))


def _shift(word: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, bits)


def oracle(rules=RULES, listed=LISTED) -> str:
    """The verdicts in DuckDB's SQL, from every rule against every page."""
    rows = ", ".join([f"('{h}', '{p}', '{v}', true)" for v, h, p in rules] + [f"('{h}', '{p}', 'block', false)" for h, p in listed])
    return f"""
WITH e(rh, rp, v, is_rule) AS (VALUES {rows}),
u AS (SELECT page_id, row_number() OVER () AS rid, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, rid, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT q.rid, e.*, row_number() OVER (PARTITION BY q.rid ORDER BY is_rule DESC, length(rh || rp) DESC, v DESC) AS k
  FROM q JOIN e ON (q.host = e.rh OR ends_with(q.host, '.' || e.rh)) AND starts_with(q.path, e.rp))
SELECT q.page_id, q.host, q.path, CASE WHEN m.is_rule THEN m.rh || m.rp END AS rule, coalesce(m.v, 'allow') AS verdict
FROM q LEFT JOIN m ON m.rid = q.rid AND m.k = 1"""
