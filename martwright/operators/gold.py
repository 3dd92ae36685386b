"""Validation of gold cases: rules over their fields, over their statements, and over what these return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import guard

# The fields that a case must have, what may be expected of it, and how results may be compared.
REQUIRED = ("id", "tier", "question", "expected", "compare")
EXPECTED = ("ANSWER", "ABSTAIN", "ANSWER_WITH_ASSUMPTION")
COMPARES = ("none", "empty", "scalar", "count", "scalar_or_null", "set", "ordered")


def rules(cases: DataFrame) -> dict[str, Column]:
    """What can be wrong with a case's fields, each as a condition; fields that the table lacks count as missing."""

    def held(name: str) -> Column:
        return F.col(name) if name in cases.columns else F.lit(None).cast("string")

    sql, compare, expected = held("gold_sql"), held("compare"), held("expected")
    missing = {f"no {f}": held(f).isNull() | (held(f).cast("string") == "") for f in REQUIRED}
    return missing | {
        "unknown expectation": expected.isNotNull() & ~expected.isin(*EXPECTED),
        "unknown comparison": compare.isNotNull() & ~compare.isin(*COMPARES),
        "an abstention without a reason": (expected == "ABSTAIN") & held("reason_code").isNull(),
        "an answer without a statement": expected.isin("ANSWER", "ANSWER_WITH_ASSUMPTION") & sql.isNull(),
        "a comparison without a statement": sql.isNull() & (compare != "none"),
        "a statement that isn't compared": sql.isNotNull() & (compare == "none"),
    }


def violations(cases: DataFrame, key: str = "id") -> DataFrame:
    """(key, problem): a row for each rule that a case breaks; a second case of a key is one too."""
    found = F.filter(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules(cases).items())), lambda x: x.isNotNull())
    own = cases.select(F.col(key), F.explode(found).alias("problem"))
    again = cases.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("a repeated id").alias("problem"))
    return own.unionByName(again)


def result_problem(compare: str, rows: list[tuple], anchor: float | None = None) -> str | None:
    """What is wrong with a gold result for the way it is compared; anchor: what a scalar must come to, within a thousandth."""
    if compare == "empty":
        return f"{len(rows)} rows where none are expected" if rows else None
    if compare in ("scalar", "count", "scalar_or_null"):
        if len(rows) != 1 or len(rows[0]) != 1:
            return f"{len(rows)} rows where one value is expected"
        value = rows[0][0]
        if value is None:
            return None if compare == "scalar_or_null" else "a value that is NULL"
        if anchor is not None and abs(float(value) - anchor) > max(abs(anchor) / 1_000, 0.01):
            return f"{value} where {anchor} is known"
        return None
    return None if rows else "no rows: not loaded, or filtered wrongly"


def check(spark: SparkSession, case: dict, run: Callable[[str], tuple[list[tuple], str | None]]) -> list[str]:
    """All that is wrong with one case: its statement must be one that the guard lets pass and give a result of its kind.

    run(sql) gives (rows, error).
    """
    row = spark.createDataFrame([tuple(None if v is None else str(v) for v in case.values())], ", ".join(f"`{k}` string" for k in case))
    found = sorted(r.problem for r in violations(row).collect())
    sql = case.get("gold_sql")
    if not sql:
        return found
    checked = guard.validate(spark, sql)
    if not checked.ok:
        return [*found, f"the guard turns it down: {checked.reason_code}"]
    rows, error = run(sql)
    problem = f"it fails: {error}" if error else result_problem(case.get("compare") or "", rows, case.get("anchor_value"))
    return found + ([problem] if problem else [])
