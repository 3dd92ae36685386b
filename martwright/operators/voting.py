"""Voting over candidates and routing of what they returned, as columns over candidate tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.6  # agreement under which no answer is given


def row_text(*cells: Column) -> Column:
    """A row's cells as a text that no other row has: each as its length, a colon and itself; null is a dash."""
    texts = [c.cast("string") for c in cells]
    return F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t)) for t in texts))


def fingerprint(row: Column) -> Column:
    """An aggregate over a result's rows (texts of row_text()), whatever their order: how many there are, and four sums of 60-bit parts of their SHA-256.

    Sums add up, so partial results meet and the rows never do. Two different multisets agree in all four sums only if their
    240 bits of independent sums do: with n results the chance that any two collide is under n^2 / 2^240 (sums grow beyond 60
    bits and don't wrap around: 38 digits hold those of 10^19 rows). No rows: a count of 0.
    """
    digest = F.sha2(row.cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring(digest, k, 15), 16, 10).cast("decimal(38,0)")) for k in (1, 16, 31, 46)]
    return F.concat_ws("-", F.count(row).cast("string"), *(F.coalesce(p, F.lit(0)).cast("string") for p in parts))


def vote(candidates: DataFrame, case: str = "case_id", index: str = "idx", key: str = "key", reason: str = "reason_code") -> DataFrame:
    """(case, winner_idx, agreement, reason) from one row a candidate; key is null where it gave no result.

    The largest cluster of equal keys wins, among equals the one with the earliest member; agreement is its size over all
    candidates asked for. Without any result the reason is the most frequent named one, else EXEC_ERROR. All by grouped
    aggregates: a case's candidates never meet in a list.
    """
    c = candidates.select(F.col(case).alias("case_id"), F.col(index).alias("i"), F.col(key).alias("k"), F.col(reason).alias("r"))
    clusters = c.groupBy("case_id", "k").agg(F.count("*").alias("size"), F.min("i").alias("first"))
    asked = clusters.groupBy("case_id").agg(F.sum("size").alias("n"), F.max(F.when(F.col("k").isNotNull(), F.struct("size", (-F.col("first")).alias("late")))).alias("b"))
    named = c.where("r is not null").groupBy("case_id", "r").agg(F.count("*").alias("size"), F.min("i").alias("first"))
    why = named.groupBy("case_id").agg(F.max(F.struct((F.col("r") != "EXEC_ERROR").alias("named"), "size", (-F.col("first")).alias("late"), "r")).alias("w"))
    out = asked.join(why, "case_id", "left")
    failed = F.col("b").isNull()
    return out.select(
        "case_id", (-F.col("b.late")).alias("winner_idx"), F.coalesce(F.col("b.size") / F.col("n"), F.lit(0.0)).alias("agreement"),
        F.when(failed, F.coalesce(F.col("w.r"), F.lit("EXEC_ERROR"))).alias("reason"),
    )


def route(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """records with route: the first rule that holds, in the order the service applies them.

    Needs booleans tautology, entity_bound, survivors_empty, winner_empty, and agreement and reason of vote().
    """
    strong = F.col("agreement") >= threshold
    no_data = F.col("entity_bound") & (F.col("survivors_empty") | (F.col("winner_empty") & strong))
    rule = F.when(F.col("tautology"), "SCHEMA_MISMATCH").when(F.col("reason").isNull() & no_data, "NO_DATA")
    rule = rule.when(F.col("reason").isNotNull(), F.col("reason")).when(~strong, "LOW_AGREEMENT").otherwise("ANSWER")
    return records.withColumn("route", rule)


def state(answered: Column, assumed: Column) -> Column:
    """The three ways a question can end."""
    return F.when(~answered, "ABSTAINED").when(assumed, "ANSWERED_WITH_ASSUMPTION").otherwise("ANSWERED")


def replay(records: DataFrame, recorded: str = "recorded") -> DataFrame:
    """(route, n, mismatches): routes recomputed and held against the recorded ones."""
    r = route(records)
    return r.groupBy("route").agg(F.count("*").alias("n"), F.count_if(~F.col("route").eqNullSafe(F.col(recorded))).alias("mismatches"))


@dataclass
class Candidate:
    """One guarded and executed statement, on the driver."""

    sql: str
    ok: bool
    reason: str | None = None
    events: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] | None = None  # None: not executed, or failed
    truncated: bool = False
    error: str | None = None


@dataclass
class Consensus:
    winner: int | None
    agreement: float
    reason: str | None
    events: list[str]


def settle(candidates: list[Candidate]) -> Consensus:
    """vote() for the few candidates of one live question."""
    events = sorted({e for c in candidates for e in c.events})
    groups: dict[tuple, list[int]] = {}
    for i, c in enumerate(candidates):
        if c.rows is not None and c.error is None:
            groups.setdefault(tuple(sorted((tuple(r) for r in c.rows), key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])), []).append(i)
    if groups:
        members = max(groups.values(), key=lambda g: (len(g), -g[0]))
        return Consensus(members[0], len(members) / len(candidates), None, events)
    reasons = [c.reason for c in candidates if c.reason]
    named = [r for r in reasons if r != "EXEC_ERROR"] or reasons
    return Consensus(None, 0.0, max(named, key=lambda r: (named.count(r), -named.index(r))) if named else "EXEC_ERROR", events)


def repair_trigger(reason: str | None, candidates: list[Candidate], enabled: frozenset[str] = frozenset()) -> str | None:
    """Why a second try would be made. No trigger is enabled unless asked for."""
    kind = {"EXEC_ERROR": "exec_error", "SCHEMA_MISMATCH": "schema_mismatch"}.get(reason or "")
    return kind if kind in enabled and any(not c.ok or c.error for c in candidates) else None


def clusters(candidates: DataFrame, case: str, key: str) -> DataFrame:
    """(case, key, size, place): the clusters of a case from the largest on."""
    n = candidates.where(F.col(key).isNotNull()).groupBy(case, key).agg(F.count("*").alias("size"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(case).orderBy(F.desc("size"), key)))
