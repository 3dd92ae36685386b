"""Quarterly archives: zip members with unquoted TSV, staged by quarter, with every rejected row counted."""

from __future__ import annotations

import shutil
from collections.abc import Callable
from pathlib import Path
from typing import IO

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import archives

SUB = "adsh string, cik string, name string, sic string, form string, period string, fy string, fp string, filed string"
NUM = "adsh string, tag string, version string, ddate string, qtrs string, uom string, segments string, coreg string, value string, footnote string"
TAG = "tag string, version string, custom string, abstract string, datatype string, iord string, crdr string, tlabel string, doc string"


def constituents(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, name, cik, gics_sector) of a CSV file with a header."""
    return spark.read.schema("ticker string, name string, cik int, gics_sector string").option("header", True).csv(path)


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated text in which a quote is a character like any other."""
    return spark.read.schema(schema).option("header", True).option("sep", "\t").option("quote", "").csv(path)


def members(spark: SparkSession, path: str, name: str, columns: list[str], part_bytes: int | None = None, only: list[str] | None = None) -> DataFrame:
    """The named columns, as text, of one member of every zip under a path, or of the quarters in only; (quarter) is the archive's own name.

    A large member is read by several tasks, each a part of its text, and no task holds an archive: see sources.archives.
    """
    archives.register(spark)
    schema = ", ".join(f"`{c}` string" for c in [*columns, archives.QUARTER])
    return spark.read.format("zip_member").schema(schema).option("member", name).option("part_bytes", part_bytes or archives.PART_BYTES).option("quarters", ",".join(only or [])).load(path)


def typed_num(num: DataFrame) -> DataFrame:
    """Facts with their types: a blank value is NULL and stays; a value or qtrs that isn't a number marks the row as bad."""
    blank = F.trim(F.coalesce("value", F.lit(""))) == ""
    value = F.when(~blank, F.expr("try_cast(value AS DOUBLE)"))
    qtrs = F.expr("try_cast(qtrs AS INT)")
    bad = (~blank & value.isNull()) | qtrs.isNull()
    return num.withColumns({"value": value, "qtrs": qtrs, "bad": bad, "blank": blank & ~bad})


def stats(typed: DataFrame) -> DataFrame:
    """(rows, null_values, skipped) in one pass."""
    return typed.agg(F.count_if(~F.col("bad")).alias("rows"), F.count_if("blank").alias("null_values"), F.count_if("bad").alias("skipped"))


def ingest(typed: DataFrame, path: str, column: str = "quarter") -> dict[str, int]:
    """Writes the rows that aren't bad by partition, as replace_partitions() does, and gives stats(): counted while they are written, in the same pass."""
    seen = Observation("ingest")
    counted = typed.observe(seen, F.count_if(~F.col("bad")).alias("rows"), F.count_if("blank").alias("null_values"), F.count_if("bad").alias("skipped"))
    replace_partitions(counted.where("NOT bad").drop("bad", "blank"), path, column)
    return seen.get


def registrants(sub: DataFrame, ciks: DataFrame) -> DataFrame:
    """Submissions whose cik is a number and in scope; joined as a semi join, not collected."""
    numbered = sub.withColumn("cik", F.expr("try_cast(cik AS INT)")).where("cik IS NOT NULL")
    return numbered.join(ciks.select("cik").distinct(), "cik", "left_semi")


def replace_partitions(rows: DataFrame, path: str, column: str = "quarter") -> None:
    """Writes rows by a partition column; partitions that they hold are replaced, others stay. Loading twice is loading once."""
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(column).parquet(path)


def annual_facts(sub: DataFrame, num: DataFrame) -> DataFrame:
    """Facts of the filings' own period, consolidated, from annual reports of the registrant."""
    facts = num.where((F.coalesce("segments", F.lit("")) == "") & (F.coalesce("coreg", F.lit("")) == ""))
    annual = sub.where("form = '10-K' AND fp = 'FY'").select("adsh", "cik", "period")
    both = facts.join(annual, "adsh").where("ddate = period")
    return both.select("cik", "adsh", "tag", F.to_date(F.expr("try_to_timestamp(ddate, 'yyyyMMdd')")).alias("ddate"), "qtrs", "uom", "value")


def snapshot(frames: dict[str, DataFrame], path: str) -> None:
    """Each relation as Parquet under a folder of its name."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def tag_dictionary(tags: DataFrame) -> DataFrame:
    """One row a tag and version: the latest quarter's."""
    best = F.max_by(F.struct(*[c for c in tags.columns if c not in ("tag", "version")]), F.col("quarter"))
    return tags.groupBy("tag", "version").agg(best.alias("_b")).select("tag", "version", "_b.*")


def quarters(first: str, n: int) -> list[str]:
    """The names of n quarters from one on, as in 2024q3."""
    year, q = int(first[:4]), int(first[5])
    return [f"{year + (q - 1 + k) // 4}q{(q - 1 + k) % 4 + 1}" for k in range(n)]


def fetch(quarter: str, cache_dir: str, open_url: Callable[[str], IO[bytes]]) -> Path:
    """A quarter's archive in the cache: not fetched twice, there whole or not at all. open_url gives its bytes."""
    target = Path(cache_dir) / f"{quarter}.zip"
    if not target.exists():
        part = target.with_suffix(".zip.part")
        try:
            with open_url(quarter) as source, part.open("wb") as out:
                shutil.copyfileobj(source, out)
            part.replace(target)
        finally:
            part.unlink(missing_ok=True)
    return target
