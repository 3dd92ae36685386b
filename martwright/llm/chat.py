r"""Chat formatting: conversations of turns become one text each, with a loss mask, by columnar byte assembly.

The template: a turn of the assistant is `<s>role\ntext</s>\n`, any other `[INST]role\ntext[/INST]\n`. Inside roles and texts
a backslash is put before each backslash and before each of the four marks (in roles also before line breaks), so an
unescaped mark is always the template's own and reading back loses nothing.

A batch of turns is assembled as columns: the escaped bytes of roles and texts, the lengths of the five segments of each
turn (mark, role, line break, text, mark), their running sum as offsets, and from these the place of every byte in one
buffer that is allocated once and becomes the Arrow column as it is. The loss mask holds the stretches of the assistant's
(escaped) texts, in code points of the formatted text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

TRAINED = "assistant"
MARKS = ("[INST]", "[/INST]", "<s>", "</s>")  # fixed values: around other turns, around trained turns
_ANY = re.compile(r"\\.|\[/?INST\]|</?s>", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
_ROLE = re.compile(r"(?:[^\\\n]|\\.)*", re.DOTALL)
LONG = 1 << 16  # bytes of a text that is copied as a slice, not by scatter indices
FORMATTED = "conv_id {kind}, formatted string, loss array<struct<start:long,end:long>>"


def scatter(out: np.ndarray, begin: np.ndarray, raw: np.ndarray, at: np.ndarray) -> None:
    """Copies row k of raw (from at[k] to at[k + 1]) to out from begin[k] on."""
    size = np.diff(at)
    long = np.flatnonzero(size > LONG)
    for k in long:
        out[begin[k] : begin[k] + size[k]] = raw[at[k] : at[k + 1]]
    short = np.where(size > LONG, 0, size)
    ends = np.cumsum(short)
    step = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - short, short)
    out[np.repeat(begin, short) + step] = raw[np.repeat(at[:-1], short) + step]


def escaped(raw: np.ndarray, at: np.ndarray, marks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes with a backslash put before each backslash and each mark that lies within a row."""
    stop = raw == ord("\\")
    for mark in marks:
        m = np.frombuffer(mark.encode(), np.uint8)
        hit = np.flatnonzero(raw[: len(raw) - len(m) + 1] == m[0]) if len(raw) >= len(m) else np.zeros(0, np.int64)
        for k in range(1, len(m)):
            hit = hit[raw[hit + k] == m[k]]
        if len(hit):
            stop[hit[hit + len(m) <= at[np.searchsorted(at, hit, "right")]]] = True
    where = np.flatnonzero(stop)
    if not len(where):
        return raw, at
    out = np.full(len(raw) + len(where), ord("\\"), np.uint8)
    step = np.cumsum(stop)
    out[np.arange(len(raw)) + step] = raw
    return out, at + np.searchsorted(where, at)


def assembled(first: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(formatted, loss) of conversations that begin at the rows first; roles and texts hold no nulls."""
    n = len(roles)
    trained = np.array([r == TRAINED for r in roles.to_pylist()], bool)
    role, role_at = escaped(*text_bytes(roles), (*MARKS, "\n"))
    text, text_at = escaped(*text_bytes(texts), MARKS)
    opening, closing = (np.where(trained, len(MARKS[2 + k]), len(MARKS[k])) for k in (0, 1))
    sizes = np.stack([opening, np.diff(role_at), np.ones(n, np.int64), np.diff(text_at), closing + 1], axis=1)
    ends = np.cumsum(sizes.ravel()).reshape(n, 5)
    begin = ends - sizes
    out = np.full(int(ends[-1, -1]) if n else 0, ord("\n"), np.uint8)  # line breaks are in place now
    for kind, rows in ((0, np.flatnonzero(~trained)), (2, np.flatnonzero(trained))):
        for segment, mark in ((0, MARKS[kind]), (4, MARKS[kind + 1])):
            m = np.frombuffer(mark.encode(), np.uint8)
            out[begin[rows, segment][:, None] + np.arange(len(m))] = m
    scatter(out, begin[:, 1], role, role_at)
    scatter(out, begin[:, 3], text, text_at)
    edges = np.concatenate([begin[first, 0], [len(out)]]).astype(np.int64)
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(edges), pa.py_buffer(out))
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])  # code points before each byte
    rows = np.flatnonzero(trained)
    conv = np.searchsorted(first, rows, "right") - 1
    base = points[edges[conv]]
    spans = pa.StructArray.from_arrays([pa.array(points[begin[rows, 3]] - base), pa.array(points[ends[rows, 3]] - base)], ["start", "end"])
    held = np.searchsorted(conv, np.arange(len(first) + 1))
    return formatted, pa.ListArray.from_arrays(pa.array(held, pa.int32()), spans)


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss): one row for each conversation, its turns in order of turn, then role, then text.

    Null roles and texts are empty; a null turn comes first; rows with a null conv_id are one conversation, whose id is null.
    Repeated rows are turns as often as they are there. Only the role `assistant`, in these letters, is trained on. An empty
    table gives an empty result; further columns are ignored, whatever their names. A conversation's turns are sorted by
    Spark, which spills, and gathered batch by batch; its text is one value, so a task holds the longest conversation (a
    string has at most 2 GB), but never several large ones at once.
    """
    kind = rows.schema[conv_col].dataType.simpleString()
    picked = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((role_col, "role"), (text_col, "text"))))

    def finished(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column(0).combine_chunks()
        first = starts(ids)
        formatted, loss = assembled(first, table.column(2).combine_chunks(), table.column(3).combine_chunks())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), formatted.cast(pa.string()), loss], ["conv_id", "formatted", "loss"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # turns of the last conversation, which may go on
        for batch in slices(batches, 4096, 3):
            first = starts(batch.column(0))
            goes_on = bool(held) and held[-1].column(0)[0] == batch.column(0)[0]
            if held and not goes_on:
                yield finished(held)
                held = []
            if len(first) == 1:
                held.append(batch)
                continue
            last = int(first[-1])
            yield finished([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        if held:
            yield finished(held)

    dealt = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, FORMATTED.format(kind=kind))


def starts(ids: pa.Array) -> np.ndarray:
    """The rows at which runs of equal ids begin (null equals null)."""
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) of each turn, read back from a formatted conversation."""
    begin = None
    for m in _ANY.finditer(formatted):
        if m[0][0] == "\\":
            continue
        if begin is None:
            begin = m.end()
        else:
            body = formatted[begin : m.start()]
            cut = _ROLE.match(body).end()
            yield unescaped(body[:cut]), unescaped(body[cut + 1 :])
            begin = None


def trained_text(formatted: str, loss: list[dict]) -> str:
    """All text under the loss mask, unescaped."""
    return "".join(unescaped(formatted[s["start"] : s["end"]]) for s in loss)


def read_back(chats: DataFrame) -> DataFrame:
    """For each row of format_chats(), digests of what is read back from its formatted text and its mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024, 1):
            out: list[list] = [[], [], [], [], []]
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                whole, n = hashlib.sha256(), 0
                for role, said in turns(text):
                    whole.update(f"{role}\n{said}\n".encode())
                    n += 1
                learnt = trained_text(text, loss)
                for column, value in zip(out, (n, whole.hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.select("conv_id", "formatted", "loss").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


FIXED = "</s>[INST] ok [/INST]"  # both turns of conversation -7


def with_fixed(rows: DataFrame) -> DataFrame:
    """The conversations with conversation -7: a user and an assistant who both say the marks."""
    more = rows.sparkSession.createDataFrame([(-7, 0, "user", FIXED), (-7, 1, TRAINED, FIXED)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(more)


def oracle() -> str:
    """The same in DuckDB's SQL; escapes are replacements there."""

    def esc(text: str, line_breaks: bool = False) -> str:
        for a in ("\\", *MARKS):
            text = f"replace({text}, '{a}', '\\{a}')"
        return f"replace({text}, chr(10), '\\' || chr(10))" if line_breaks else text

    said = "role || chr(10) || text || chr(10)"
    size = f"length({esc('role', True)}) + length({esc('text')}) + CASE WHEN role = '{TRAINED}' THEN {len(MARKS[2] + MARKS[3]) + 2} ELSE {len(MARKS[0] + MARKS[1]) + 2} END"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '{FIXED}' UNION ALL SELECT -7, 1, '{TRAINED}', '{FIXED}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg({said}, '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{TRAINED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{TRAINED}'), '')) AS loss_sha256,
  CAST(sum({size}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""
