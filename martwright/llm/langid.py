"""Language identification by a byte convolutional network, trained here in numpy.

Text is UTF-8 bytes in windows of fixed length that overlap by the widest filter less one, so that no n-gram is lost.
Bytes are embedded; filters of several widths run over each window; each filter's maximum over the window feeds a
softmax over the languages. A text's probabilities are the mean of its windows', weighted by their bytes.
All filters are one matrix (narrow ones have zeros on their right), so a block of windows costs one matrix product.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, excerpt, learnt, sampled, slices, text_bytes

WIDTHS, FILTERS, EMBED = (2, 3, 4), 12, 6
WINDOW = 256
BLOCK = 32  # windows of one matrix product: their columns stay in the processor's cache
SAMPLE = 2_000  # labelled texts that the network is fitted on, the same number for any input
FIT_CHARS = 4_096  # of each of them, evenly spread over the whole text
SPAN = 4_096  # windows cut out of a slice's bytes at a time


@dataclass
class Model:
    langs: list[str]
    embed: np.ndarray  # (256, EMBED)
    conv: np.ndarray  # (widest * EMBED, filters)
    bias: np.ndarray
    out: np.ndarray  # (filters, languages)
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns, activations before the maximum, and maxima (n, filters) of windows (n, length) of bytes."""
        n, length = windows.shape
        wide, steps = self.conv.shape[0], length - max(WIDTHS) + 1
        x = self.embed[windows].reshape(n, -1)
        cols = np.lib.stride_tricks.as_strided(x, (n, steps, wide), (x.strides[0], EMBED * x.itemsize, x.itemsize)).reshape(-1, wide)
        act = (cols @ self.conv).reshape(n, steps, -1)
        return cols, act, act.max(axis=1)

    def probs(self, windows: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(windows)[2] + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def window_starts(at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, row, bytes) of the windows that hold every row's bytes whole."""
    hop = window - max(WIDTHS) + 1
    size = np.diff(at)
    n = np.where(size > 0, np.maximum(1, -(-(size - (window - hop)) // hop)), 0)
    row = np.repeat(np.arange(len(size)), n)
    begin = at[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * hop
    return begin, row, np.minimum(window, at[row + 1] - begin)


def cut(raw: np.ndarray, begin: np.ndarray, held: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The windows' bytes; those of fewer bytes are filled with zeros."""
    index = begin[:, None] + np.arange(window)
    return np.where(np.arange(window) < held[:, None], raw[np.minimum(index, max(0, len(raw) - 1))], 0).astype(np.uint8)


def train(texts: list[str], labels: list[str], seed: int = 7, steps: int = 500, batch: int = 96, rate: float = 0.01) -> Model:
    """Adam on windows drawn evenly from the languages. One language: a network that always says it."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    raw, at = text_bytes(pa.array(texts, pa.large_string()))
    begin, row, held = window_starts(at, 128)
    windows = cut(raw, begin, held, 128)
    y = np.array([langs.index(x) for x in labels], np.int64)[row] if len(row) else np.zeros(0, np.int64)
    wide, filters = max(WIDTHS) * EMBED, len(WIDTHS) * FILTERS
    mask = np.concatenate([np.repeat((np.arange(wide) < w * EMBED)[:, None], FILTERS, axis=1) for w in WIDTHS], axis=1)
    f32 = np.float32
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(f32),
        "conv": (rng.normal(0, 0.3, (wide, filters)) * mask).astype(f32),
        "bias": np.zeros(filters, f32),
        "out": rng.normal(0, 0.2, (filters, len(langs))).astype(f32),
        "out_bias": np.zeros(len(langs), f32),
    }
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    by = [np.flatnonzero(y == k) for k in range(len(langs))]
    by = [b for b in by if len(b)]
    for t in range(1, steps + 1 if len(by) > 1 else 1):
        pick = np.concatenate([rng.choice(b, batch // len(by) + 1) for b in by])
        x, target = windows[pick], y[pick]
        model = Model(langs, **p)
        cols, act, top = model.pooled(x)
        hidden = np.maximum(top + p["bias"], 0)
        z = hidden @ p["out"] + p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        dz = z / z.sum(axis=1, keepdims=True)
        dz[np.arange(len(x)), target] -= 1
        dz /= len(x)
        dh = (dz @ p["out"].T) * (hidden > 0)
        place = act.argmax(axis=1)  # (n, filters)
        steps_of = act.shape[1]
        rows = (np.arange(len(x))[:, None] * steps_of + place).ravel()
        which = np.tile(np.arange(filters), len(x))
        g = dh.ravel()
        dconv = np.zeros_like(p["conv"])
        np.add.at(dconv.T, which, cols[rows] * g[:, None])
        dcols = p["conv"].T[which] * g[:, None]  # (n * filters, wide)
        seen = x[np.repeat(np.arange(len(x)), filters)[:, None], place.ravel()[:, None] + np.arange(max(WIDTHS))]
        dembed = np.zeros_like(p["embed"])
        np.add.at(dembed, seen.ravel(), dcols.reshape(-1, EMBED))
        grads = {"embed": dembed, "conv": dconv * mask, "bias": dh.sum(0), "out": hidden.T @ dz, "out_bias": dz.sum(0)}
        pace = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for k, d in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            p[k] = (p[k] - pace * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(f32)
    return Model(langs, **p)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, chars: int = FIT_CHARS, **options) -> Model | None:
    """A network fitted on at most sample rows, those with the smallest hash of id and text; None if no row is labelled.

    Texts of any length are learnt from: of one with more than chars code points, eight parts spread over it, chars in all.
    The fitting runs in one task of the cluster.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    key = F.concat_ws(":", F.col(id_col).cast("string"), F.xxhash64(text_col).cast("string"))
    picked = sampled(rows, key, sample).select(excerpt(F.col(text_col), chars).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    raw = learnt(picked, lambda held: pickle.dumps(train([r["text"] for r in held], [r["lang"] for r in held], **options)))
    return pickle.loads(raw) if raw else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), one row for each row of docs, from the text alone.

    score is the probability of lang_pred. Texts that are null, empty or without any letter are `und` with score 0, and
    so is every text where no row was labelled. Repeated rows each give a row; ties go to the language first by name.
    Whole texts are read, of any length, in bounded blocks. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256, 1):
            texts = batch.column(1)
            n = len(texts)
            total = np.zeros((n, len(model.langs) if model else 1))
            if model:
                raw, at = text_bytes(texts)
                begin, row, held = window_starts(at)
                for a in range(0, len(begin), SPAN):
                    windows = cut(raw, begin[a : a + SPAN], held[a : a + SPAN])
                    for k in range(0, len(windows), BLOCK):
                        s = slice(a + k, min(a + k + BLOCK, a + SPAN))
                        np.add.at(total, row[s], model.probs(windows[k : k + BLOCK]) * held[s, None])
                total /= np.maximum(np.bincount(row, held, n), 1)[:, None]
            best = total.argmax(axis=1)
            letters = [bool(model) and t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()]
            names = [model.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            score = np.where(letters, np.minimum(total.max(axis=1), 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, **options) -> DataFrame:
    """predict() by a network fitted on docs' rows outside the held-out third, with held_out (crc32 of the id mod 3 = 1)."""
    model = fit(docs.where(bucket_of("doc_id", 3) != 1), **options)
    return predict(docs, model).withColumn("held_out", bucket_of("doc_id", 3) == 1).select("doc_id", "held_out", "lang_pred", "score")
