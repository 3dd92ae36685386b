"""A question to an answer: intent, scope, candidates, guard, execution, vote, routing, prose, verification, log.

Everything a model does is a callable that is passed in: generate(question, context, seed) -> SQL text,
write(columns, rows) -> sentence, classify(question) -> verdict text, repair(question, sql, error) -> SQL text. Only the statements themselves touch the cluster.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from ..functions import names, patterns
from ..functions.numbers import as_text
from ..operators import ground
from ..operators.voting import Candidate, repair_trigger, settle
from ..plans import framing, guard, shape
from ..plans.parser import ParseError, parse
from .execute import Config, execute, lookup

VERDICTS = ("OUT_OF_SCOPE", "AMBIGUOUS", "IN_SCOPE")


def scope(reply: str | None) -> str:
    """The first verdict that a classifier's reply contains; in scope if none."""
    found = [(reply.index(v), v) for v in VERDICTS if reply and v in reply]
    return min(found)[1] if found else "IN_SCOPE"


def unfenced(text: str) -> str:
    blocks = re.findall(r"```[a-zA-Z]*\s*\n?(.*?)```", text, re.S)
    return (blocks[-1] if blocks else re.sub(r"```[a-zA-Z]*", "", text)).strip()


def write_record(record: dict, path: str) -> str:
    """Appends a record to a JSON Lines log, with an id and the time; values JSON doesn't know become text."""
    key = uuid.uuid4().hex
    now = dt.datetime.now(dt.UTC).isoformat()
    with Path(path).open("a") as f:
        f.write(json.dumps({"id": key, "timestamp": now} | record, default=str) + "\n")
    return key


def ask(
    spark: SparkSession,
    question: str,
    generate: Callable[[str, str, int], str],
    write: Callable[[list[str], list[tuple]], str] = as_text,
    classify: Callable[[str], str] | None = None,
    linker: names.Linker | None = None,
    context: str = "",
    config: Config = Config(),
    repair: Callable[[str, str, str], str] | None = None,
) -> dict:
    """The answer, or why there is none: state, answer, refusal, reason_code, sql, columns, rows, truncated, assumptions,
    guardrail_events, confidence, candidates, blocked_draft and blocked_claims. Never raises; every call is logged."""
    out: dict = {"question": question, "state": "ABSTAINED", "answer": None, "refusal": None, "reason_code": None, "sql": None, "columns": [], "rows": [], "truncated": False, "assumptions": [], "guardrail_events": [], "confidence": None, "candidates": [], "blocked_draft": None, "blocked_claims": [], "repair": None}
    try:
        _answer(spark, question, generate, write, classify, linker, context, config, repair, out)
    except Exception as e:  # noqa: BLE001 - a question must end in one of its states
        out |= {"state": "ABSTAINED", "answer": None, "reason_code": "EXEC_ERROR", "error": str(e)}
    if out["reason_code"]:
        links = linker.link(question) if linker else []
        out["refusal"] = patterns.refusal(out["reason_code"], question, links, lambda view, cik: bool(lookup(spark, f"SELECT 1 FROM {view} WHERE cik = ? LIMIT 1", [cik])), lambda cik: [r[0] for r in lookup(spark, "SELECT DISTINCT form FROM filings WHERE cik = ?", [cik])])[0]
    if config.log:
        out["id"] = write_record({k: v for k, v in out.items() if k != "rows"} | {"n_rows": len(out["rows"])}, config.log)
    return out


def _answer(spark, question, generate, write, classify, linker, context, config, repair, out) -> None:
    event = patterns.intent_of(question)
    if event:
        out |= {"reason_code": "OUT_OF_SCOPE", "guardrail_events": [event]}
        return
    verdict = scope(classify(question)) if classify else "IN_SCOPE"
    if verdict != "IN_SCOPE":
        out["reason_code"] = verdict
        return
    links = linker.link(question) if linker else []
    told = "\n".join(x for x in (context, names.hint(links)) if x)
    candidates = [_candidate(spark, unfenced(generate(question, told, config.seed + i)), config) for i in range(config.candidates)]
    vote = settle(candidates)
    trigger = repair_trigger(vote.reason, candidates, config.repair_triggers) if repair else None
    if trigger:
        second = _repaired(spark, question, trigger, candidates, repair, config, out)
        if second:  # the one candidate that there is now
            candidates = [second]
            vote = settle(candidates)
    winner = candidates[vote.winner] if vote.winner is not None else None
    survivors = [c.rows for c in candidates if c.rows is not None]
    out |= {"guardrail_events": vote.events, "confidence": vote.agreement, "sql": winner.sql if winner else None}
    out["candidates"] = [{"sql": c.sql, "guard_ok": c.ok, "reason_code": c.reason, "events": c.events, "exec_error": c.error, "n_rows": None if c.rows is None else len(c.rows), "empty": None if c.rows is None else shape.empty_or_null(c.rows)} for c in candidates]
    if winner and shape.tautologically_empty(spark, winner.sql):
        out["reason_code"] = "SCHEMA_MISMATCH"
    elif winner and (shape.no_data(spark, winner.sql, survivors) or vote.agreement >= config.threshold and shape.empty_or_null(winner.rows) and shape.entity_bound(spark, winner.sql)):
        out["reason_code"] = "NO_DATA"
    elif vote.reason:
        out["reason_code"] = vote.reason
    elif vote.agreement < config.threshold:
        out["reason_code"] = "LOW_AGREEMENT"
    if out["reason_code"]:
        return
    draft = write(winner.columns, winner.rows)
    try:
        clauses = framing.frame(question, shape.facts(parse(spark, winner.sql)), links, winner.columns, len(winner.rows), lambda sql, args: lookup(spark, sql, args))
    except ParseError:
        clauses = []
    checked = ground.verify(draft, winner.columns, winner.rows, winner.sql, *framing.labels(clauses))
    out |= {"columns": winner.columns, "rows": winner.rows, "truncated": winner.truncated}
    if not checked.ok:
        out |= {"reason_code": "UNGROUNDED_ANSWER", "blocked_draft": draft, "blocked_claims": checked.claims}
        return
    assumed = [c.text for c in clauses if c.assumption]
    out |= {"answer": " ".join([draft, *(c.text for c in clauses)]), "assumptions": assumed, "state": "ANSWERED_WITH_ASSUMPTION" if assumed else "ANSWERED"}


def _repaired(spark, question, trigger, candidates, repair, config, out) -> Candidate | None:
    """A second try: repair(question, statement, what went wrong) gives another statement, which must pass and run like any.

    Nothing comes of one that fails, is turned down or is the same again; the first reason then stands.
    """
    failed = next((c for c in candidates if not c.ok), None) or next((c for c in candidates if c.error), candidates[0])
    out["repair"] = {"trigger": trigger, "sql": None, "succeeded": False}
    try:
        sql = unfenced(repair(question, failed.sql, failed.error or failed.reason or "it gave nothing"))
    except Exception as e:  # noqa: BLE001 - a repair that fails must not hide why it was needed
        out["repair"]["error"] = str(e)
        return None
    out["repair"]["sql"] = sql
    plain = lambda s: " ".join((s or "").rstrip("; \n").lower().split())
    if not sql or plain(sql) == plain(failed.sql):
        return None
    second = _candidate(spark, sql, config)
    out["repair"]["succeeded"] = second.ok and second.error is None
    return second if out["repair"]["succeeded"] else None


def _candidate(spark: SparkSession, sql: str, config: Config) -> Candidate:
    checked = guard.validate(spark, sql)
    made = Candidate(checked.sql, checked.ok, checked.reason_code, checked.events)
    if checked.ok:
        ran = execute(spark, checked.sql, config.timeout, config.row_cap)
        made.error = ran.error
        if not ran.error:
            made.columns, made.rows, made.truncated = ran.columns, ran.rows, ran.truncated
    return made
