"""Running one guarded statement: a deadline, a row cap, errors as values."""

from __future__ import annotations

import os
import threading
import time
import uuid
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    """What the service may be told: limits, votes, where the log goes."""

    timeout: float = 10.0
    row_cap: int = 1_000
    candidates: int = 5
    threshold: float = 0.6
    temperature: float = 0.7
    seed: int = 42
    repair_triggers: frozenset[str] = frozenset()
    log: str | None = None

    @classmethod
    def from_env(cls, environ: dict[str, str] | None = None, prefix: str = "MARTWRIGHT_") -> Config:
        """The settings that the environment names, such as MARTWRIGHT_TIMEOUT=5; others keep their defaults."""
        held = os.environ if environ is None else environ
        made = {}
        for f in fields(cls):
            text = held.get(prefix + f.name.upper())
            if text is not None:
                kind = type(f.default)
                made[f.name] = frozenset(x for x in text.split(",") if x) if kind is frozenset else kind(text) if kind in (int, float) else text
        return cls(**made)


@dataclass
class Execution:
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    error: str | None = None
    truncated: bool = False


def execute(spark: SparkSession, sql: str, timeout: float = 10.0, row_cap: int = 1_000) -> Execution:
    """The statement's first row_cap rows. At the deadline its jobs are cancelled and the call returns."""
    group, out, done = f"guarded-{uuid.uuid4().hex}", Execution(), threading.Event()

    def run() -> None:
        try:
            spark.sparkContext.setJobGroup(group, "guarded statement", interruptOnCancel=True)
            df = spark.sql(sql)
            rows = df.limit(row_cap + 1).collect()
            out.columns, out.rows, out.truncated = df.columns, [tuple(r) for r in rows[:row_cap]], len(rows) > row_cap
        except Exception as e:  # noqa: BLE001 - whatever a statement raises is its result
            out.error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
        finally:
            done.set()

    threading.Thread(target=inheritable_thread_target(spark)(run), daemon=True).start()
    if not done.wait(timeout):
        spark.sparkContext.cancelJobGroup(group)
        return Execution(error=f"timeout: no result within {timeout:g} s")
    return out


MOST_LABELS = 100_000


def lookup(spark: SparkSession, sql: str, args: list | None = None) -> list[tuple]:
    """A parameterised lookup of labels; any failure is no rows. Over MOST_LABELS rows aren't labels any more: that is an error."""
    try:
        found = spark.sql(sql, args=args or []).limit(MOST_LABELS + 1).collect()
    except Exception:  # noqa: BLE001 - a label that can't be read is a label that isn't there
        return []
    if len(found) > MOST_LABELS:
        raise ValueError(f"a lookup of over {MOST_LABELS} rows: {sql}")
    return [tuple(r) for r in found]


def attempt(run, sql: str, attempts: int = 3, pause: float = 0.0) -> tuple[str, Execution]:
    """(status, execution) of a scoring run: ok, error, timeout, or unstable if it timed out and then came back."""
    late = False
    for _ in range(attempts):
        result = run(sql)
        if not result.error:
            return ("unstable" if late else "ok"), result
        if not result.error.startswith("timeout"):
            return "error", result
        late = True
        time.sleep(pause)
    return "timeout", result


def schema_context(text: str, sections: tuple[str, ...]) -> str:
    """Of a schema document the text before its first H2 and the named H2 sections, in their order."""
    head, *parts = ("\n" + text).split("\n## ")
    titled = {p.split("\n", 1)[0].strip(): p for p in parts}
    return "\n\n".join([head.strip(), *("## " + titled[s].rstrip() for s in sections if s in titled)])


def introspect(spark: SparkSession, relations: list[str], samples: int = 3) -> dict[str, list[tuple[str, str, list]]]:
    """(column, type, most frequent values) of each relation; ties by value."""
    from ..operators.aggregates import frequent_values

    out = {}
    for name in relations:
        df = spark.table(name)
        out[name] = [(f.name, f.dataType.simpleString(), [r["value"] for r in frequent_values(df, f.name, samples).orderBy("k").collect()]) for f in df.schema.fields]
    return out


def as_ddl(schema: dict[str, list[tuple[str, str, list]]]) -> str:
    return "\n\n".join(f"CREATE TABLE {t} (\n" + ",\n".join(f"  {c} {kind}" for c, kind, _ in columns) + "\n);" for t, columns in schema.items())


def as_mschema(schema: dict[str, list[tuple[str, str, list]]], name: str = "mart") -> str:
    lines = [f"[DB_ID] {name}", "[Schema]"]
    for t, columns in schema.items():
        lines += [f"# Table: {t}", "[", ",\n".join(f"({c}:{kind.upper()}, examples: [{', '.join(map(str, examples))}])" for c, kind, examples in columns), "]"]
    return "\n".join(lines)


def digest(path: str) -> str | None:
    """SHA-256 of a file's bytes, for pins; None if it isn't there."""
    from hashlib import sha256

    p = Path(path)
    return sha256(p.read_bytes()).hexdigest() if p.is_file() else None
