"""JSON Lines logs and records, job accounting, HTML tables."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "id string, timestamp timestamp, question string, state string, reason_code string, sql string, confidence double, truncated boolean, n_rows int, guardrail_events array<string>, candidates array<struct<sql:string,guard_ok:boolean,reason_code:string,exec_error:string,n_rows:int,empty:boolean>>"


def records(spark: SparkSession, path: str, schema: str | None = RECORD) -> DataFrame:
    """A log of records; without a schema it is inferred."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def append_records(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def keyed(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """Cases by their key, the first of each in the order of files and of their lines."""
    rows = spark.read.json(path)
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    first = rows.select("*", place.alias("_place")).groupBy(key).agg(F.min_by(F.struct(*rows.columns), "_place").alias("_row"))
    return first.select("_row.*")


def evidence(runs: DataFrame) -> DataFrame:
    """One row a (model, profile, case), its candidates in order, from one row a candidate."""
    cell = F.struct("idx", "sql", "ok")
    return runs.groupBy("model", "profile", "case_id").agg(F.array_sort(F.collect_list(cell)).alias("candidates"))


JOBS = "JobID string, JobName string, NodeList string, Start string, End string, State string, ExitCode string"


# Jobs by model: what a job's name has in it, in the order it is looked for.
MODELS = (("30b", "30b"), ("32b", "32b"), ("7b", "7b"))


def jobs(spark: SparkSession, path: str, models: tuple[tuple[str, str], ...] = MODELS, prefix: str = "") -> DataFrame:
    """Pipe-separated accounting: steps (ids with a dot) left out, times parsed or NULL, the model by the job's name.

    models: (expression, model), the first that a lower-cased name matches; names without the prefix, or with none of them,
    are other.
    """
    raw = spark.read.schema(JOBS).option("header", True).option("sep", "|").csv(path)
    name = F.lower("JobName")
    model = F.lit("other")
    for pattern, known in reversed(models):
        model = F.when(name.startswith(prefix) & name.rlike(pattern), known).otherwise(model)
    at = {c: F.expr(f"try_to_timestamp({c}, \"yyyy-MM-dd'T'HH:mm:ss\")") for c in ("Start", "End")}
    return raw.where(~F.col("JobID").contains(".")).withColumns({"model": model, **at})


class _Rows(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def flush(self) -> None:
        if self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("tr", "td", "th"):
            self.flush()  # cells and rows need not be closed
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def table_rows(html: str | None) -> list[list[str]]:
    parser = _Rows()
    parser.feed(html or "")
    parser.flush()
    return [r for r in parser.rows if r]


def html_tables(html: Column) -> Column:
    """array<array<string>>: the rows of all tables of a page, in Arrow batches."""

    @F.pandas_udf("array<array<string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(table_rows)

    return run(html)
