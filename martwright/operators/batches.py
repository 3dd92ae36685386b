"""strict() and relaxed() of operators.cases for one gold and several predicted results a case, on Arrow batches of cases.

The same answers where a cell's place doesn't matter, at a fraction of the time: all cases of a batch are compared at once, as
arrays of cells, in blocks of at most PAIRS pairs of rows (or one row's pairs), whatever a result's length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRS = 1 << 19


class Results:
    """Results of all cases end to end: where each case's rows begin, where each row's cells begin, and the cells."""

    def __init__(self, column: pa.Array) -> None:
        rows = column.flatten()
        self.null = column.is_null().to_numpy(zero_copy_only=False)
        self.rows = self._ends(column)
        self.cells = self._ends(rows)
        self.wide = np.where(rows.is_null().to_numpy(zero_copy_only=False), -1, np.diff(self.cells))  # -1: no row, which is as none is
        cells = rows.flatten()
        there = cells.is_valid().to_numpy(zero_copy_only=False)
        number = cells.field("num")
        self.is_num = there & number.is_valid().to_numpy(zero_copy_only=False)
        self.num = number.fill_null(0.0).to_numpy(zero_copy_only=False)
        self.text = pc.if_else(cells.is_valid(), cells.field("txt"), None) if cells.null_count else cells.field("txt")
        self.code = np.zeros(0, np.int64)

    @staticmethod
    def _ends(lists: pa.Array) -> np.ndarray:
        """Offsets into what flatten() gives, which leaves out what null lists hide."""
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])

    def width(self) -> np.ndarray:
        """Each case's number of columns: -1 where its rows differ in it, or there are none."""
        n = np.diff(self.rows)
        first = np.full(len(n), -1, np.int64)
        first[n > 0] = self.wide[self.rows[:-1][n > 0]]
        odd = np.concatenate([[0], np.cumsum(self.wide != np.repeat(first, n))])
        return np.where(odd[self.rows[1:]] > odd[self.rows[:-1]], -1, first)


def numbered(results: Sequence[Results]) -> None:
    """Gives equal texts of all results equal codes; -1 is null."""
    codes = pa.concat_arrays([r.text for r in results]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    for r, own in zip(results, np.split(codes, np.cumsum([len(r.text) for r in results])[:-1]), strict=True):
        r.code, r.text = own, None


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): which (0, 0, 1, 1, 1) and the how-manieth of its own (0, 1, 0, 1, 2)."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def blocks(weights: np.ndarray) -> Iterator[slice]:
    ends, k = np.cumsum(weights), 0
    while k < len(weights):
        e = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
        yield slice(k, e)
        k = e


def same(g: Results, p: Results, at: np.ndarray, to: np.ndarray, tolerance: float) -> np.ndarray:
    """Whether g's cells at are p's cells to: numbers within the tolerance, texts and nulls alike."""
    number = g.is_num[at]
    x = g.num[at]
    close = np.abs(x - p.num[to]) <= np.maximum(np.abs(x) * tolerance, 1e-9)
    return (number == p.is_num[to]) & np.where(number, close, g.code[at] == p.code[to])


def both_ways(g: Results, p: Results, cases: np.ndarray, way: Sequence[int] | None, tolerance: float) -> np.ndarray:
    """For each of the cases, whether each row of one side has a partner on the other. way: the predicted columns that stand
    for the first gold ones; None: all columns of both, as they are."""
    case, nth = spread(np.diff(g.rows)[cases])
    row, others = g.rows[cases][case] + nth, np.diff(p.rows)[cases][case]
    found_g, found_p = np.zeros(len(row), bool), np.zeros(int(p.rows[-1]), bool)
    for b in blocks(others):
        which, nth = spread(others[b])
        i, j = row[b][which], p.rows[cases[case[b]]][which] + nth
        kept = np.flatnonzero((g.wide[i] >= 0) & ((g.wide[i] == p.wide[j]) if way is None else (p.wide[j] >= 0)))
        which, i, j = which[kept], i[kept], j[kept]
        for k in range(int(g.wide[i].max(initial=0)) if way is None else len(way)):
            ok = g.wide[i] <= k  # a narrower row has no such cell
            left = np.flatnonzero(~ok)
            ok[left] = same(g, p, g.cells[i[left]] + k, p.cells[j[left]] + (k if way is None else way[k]), tolerance)
            which, i, j = which[ok], i[ok], j[ok]
        found_g[b.start + which] = True
        found_p[j] = True
    missed = np.bincount(case, ~found_g, len(cases))
    case, nth = spread(np.diff(p.rows)[cases])
    missed += np.bincount(case, ~found_p[p.rows[cases][case] + nth], len(cases))
    return missed == 0


def twins(p: Results, cases: np.ndarray, width: int) -> np.ndarray:
    """For each case and column the first column that is the same in all rows."""
    out = np.tile(np.arange(width), (len(cases), 1))
    case, nth = spread(np.diff(p.rows)[cases])
    at = p.cells[p.rows[cases][case] + nth]
    for j in range(1, width):
        for k in range(j):
            differ = (p.is_num[at + j] != p.is_num[at + k]) | (p.num[at + j] != p.num[at + k]) | (p.code[at + j] != p.code[at + k])
            alike = (np.bincount(case, differ, len(cases)) == 0) & (out[:, j] == j) & (out[:, k] == k)
            out[alike, j] = k
    return out


def placed(g: Results, p: Results, cases: np.ndarray, gold_width: int, width: int, tolerance: float) -> np.ndarray:
    """Whether the gold columns are found among the predicted ones, in each of the cases, whose results are so wide.

    Columns are placed one after the other, and only cases whose rows so far have partners go on; of the predicted columns
    that are the same only the first free one is tried.
    """
    first, found = twins(p, cases, width), np.zeros(len(cases), bool)

    def place(alive: np.ndarray, way: list[int]) -> None:
        if len(way) == gold_width:
            found[alive] = True
            return
        for j in sorted(set(range(width)) - set(way)):
            own = alive[~found[alive]]
            free = [k for k in range(j) if k not in way]
            own = own[~(first[own][:, free] == first[own, j][:, None]).any(1)] if free else own
            if len(own):
                place(own[both_ways(g, p, cases[own], [*way, j], tolerance)], [*way, j])

    place(np.arange(len(cases)), [])
    return found


def judged(loose: bool, tolerance: float):
    """A function of Arrow columns, gold and predicted: for each case, whether each of the predicted results matches."""

    def judge(*columns: pa.Array) -> pa.Array:
        results = [Results(c) for c in columns]
        numbered(results)
        g, out = results[0], np.zeros((len(columns[0]), len(columns) - 1), bool)
        gold_width = g.width() if loose else None
        with np.errstate(all="ignore"):
            for k, p in enumerate(results[1:]):
                live = np.flatnonzero(~g.null & ~p.null)
                out[live, k] = both_ways(g, p, live, None, tolerance)
                if loose:
                    width = p.width()
                    rest = live[~out[live, k] & (gold_width[live] > 0) & (gold_width[live] <= width[live])]
                    for wg, wp in {*zip(gold_width[rest].tolist(), width[rest].tolist(), strict=True)}:
                        own = rest[(gold_width[rest] == wg) & (width[rest] == wp)]
                        out[own, k] = placed(g, p, own, wg, wp, tolerance)
        ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

    return judge


def _applied(loose: bool, tolerance: float, gold: Column, preds: Sequence[Column]) -> Column:
    judge = judged(loose, tolerance)

    def matched(*columns: pa.Array) -> pa.Array:
        return judge(*columns)

    return F.arrow_udf(matched, "array<boolean>")(gold, *preds)


def strict(gold: Column, preds: Sequence[Column], tolerance: float = 1e-6) -> Column:
    """array<boolean>: cases.strict() of gold and each of the predicted results."""
    return _applied(False, tolerance, gold, preds)


def relaxed(gold: Column, preds: Sequence[Column], tolerance: float = 1e-6) -> Column:
    """array<boolean>: cases.relaxed() of gold and each of the predicted results."""
    return _applied(True, tolerance, gold, preds)
