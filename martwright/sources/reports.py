"""Report sinks: small result tables as Markdown, and records as JSON Lines; values that JSON doesn't know become text."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame

from ..functions.numbers import shown

MOST_ROWS = 10_000  # of a table in a report; results are aggregated before they are reported


def table_text(df: DataFrame) -> str:
    """A table in Markdown: numbers to the right, shares with four places, no line breaks or bars within cells."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report of over {MOST_ROWS} rows: aggregate first")
    right = [f.dataType.typeName() in ("integer", "long", "short", "byte", "double", "float") or f.dataType.typeName().startswith("decimal") for f in df.schema.fields]

    def cell(v: object) -> str:
        told = f"{v:.4f}" if isinstance(v, float) and abs(v) < 1_000 and v != int(v) else shown(v)
        return told.replace("|", "\\|").replace("\n", " ")

    lines = [df.columns, [("---:" if r else "---") for r in right], *([cell(v) for v in row] for row in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def write_report(path: str, title: str, sections: Iterable[tuple[str, str | DataFrame]]) -> None:
    """A Markdown file of headed sections, texts or tables."""
    parts = [f"# {title}", *(f"## {head}\n\n{body if isinstance(body, str) else table_text(body)}" for head, body in sections)]
    Path(path).write_text("\n\n".join(parts) + "\n")


def write_records(path: str, records: Iterable[dict]) -> int:
    """Records as JSON Lines, appended; how many."""
    n = 0
    with Path(path).open("a") as f:
        for record in records:
            f.write(json.dumps(record, default=str, ensure_ascii=False) + "\n")
            n += 1
    return n
