"""The guard: one read-only statement over the mart's relations and columns, with some bound on what it returns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .parser import Node, ParseError, parse, statements

RELATIONS = frozenset({"companies", "filings", "financial_facts", "v_revenue"})
QUERY_ROOTS = frozenset({"Project", "Aggregate", "GlobalLimit", "LocalLimit", "Sort", "Distinct", "Union", "Filter", "UnresolvedWith", "UnresolvedHaving", "SubqueryAlias", "UnresolvedRelation", "WithWindowDefinition", "UnresolvedOrdinal", "Offset"})
BOUNDS = frozenset({"Filter", "GlobalLimit", "LocalLimit", "Aggregate", "UnresolvedHaving"})
AGGREGATES = frozenset("count sum avg mean min max median first last any_value stddev variance var_pop var_samp stddev_pop stddev_samp percentile approx_percentile mode bool_or bool_and collect_list collect_set count_if max_by min_by corr".split())


@dataclass
class GuardResult:
    ok: bool
    sql: str
    events: list[str] = field(default_factory=list)
    reason_code: str | None = None
    detail: str | None = None


def live_columns(spark: SparkSession, relations: frozenset[str] = RELATIONS) -> set[str]:
    return {f.lower() for name in relations if spark.catalog.tableExists(name) for f in spark.table(name).columns}


def stray_relations(plan: Node, allowed: frozenset[str]) -> set[str]:
    """Relations outside the allowed ones. Names of several parts (files, other catalogs) and table functions always are."""
    ctes = {c for n in plan.walk() for c in n.ctes}
    bad = {".".join(n.parts) for n in plan.all("UnresolvedRelation") if len(n.parts) > 1 or n.name not in allowed | ctes}
    return bad | {f"{n.name}()" for n in plan.all("UnresolvedTableValuedFunction")}


def unbounded(plan: Node) -> bool:
    """Neither WHERE nor LIMIT nor any aggregate, anywhere."""
    return not any(n.kind in BOUNDS or n.kind == "UnresolvedFunction" and n.name in AGGREGATES for n in plan.walk())


def validate(spark: SparkSession, sql: str, relations: frozenset[str] = RELATIONS, columns: set[str] | None = None) -> GuardResult:
    """The verdict on a statement, and the statement without comments and semicolon.

    Checked in this order: it parses; it is one statement; it only reads (SELECT or UNION; EXCEPT and INTERSECT are turned
    down); relations; columns, where a name that is also an alias in the statement is left to the analyzer; cost.
    """

    def no(event: str | None, reason: str, detail: str) -> GuardResult:
        return GuardResult(False, sql, [event] if event else [], reason, detail)

    parts = statements(sql)
    if len(parts) != 1:
        return no("single_statement", "OUT_OF_SCOPE", f"{len(parts)} statements, not one")
    try:
        plan = parse(spark, parts[0])
    except ParseError as e:
        return no(None, "EXEC_ERROR", str(e))
    if plan.kind not in QUERY_ROOTS or plan.all("Except", "Intersect"):
        return no("read_only", "OUT_OF_SCOPE", f"the statement is {plan.kind}, not SELECT")
    if stray := stray_relations(plan, relations):
        return no("schema_allowlist", "SCHEMA_MISMATCH", f"relations that aren't there: {sorted(stray)}")
    aliases = {n.name for n in plan.all("Alias", "SubqueryAlias")}
    known = live_columns(spark, relations) if columns is None else columns
    if bad := {n.name for n in plan.all("UnresolvedAttribute")} - aliases - known:
        return no("schema_allowlist", "SCHEMA_MISMATCH", f"columns that aren't there: {sorted(bad)}")
    if unbounded(plan):
        return no("cost_limit", "COST_LIMIT", "no WHERE, LIMIT or aggregate: it would return every row")
    return GuardResult(True, parts[0])
