"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A text is a sequence of words (runs of letters, digits and all of non-ASCII; a run of over LONGEST bytes is cut into
words of so many). A word's input has two parts: the embedding of its
hash, and the sum of the embeddings of its 4-grams of characters (bytes), word boundaries included, so that words never
seen are known by their stems. Windows of WINDOW words begin every HOP words, so that all stretches of up to
WINDOW - HOP words are inside one window. Two gated recurrent layers read each window forwards and backwards, attention
pools their states, and a sigmoid scores the pooled state. A text's score is its highest window's.

Labels are of texts, not of windows: in training the gradient of a text goes to its windows by a softmax of their logits,
so it settles on those that carry the evidence. The first number of each embedding starts as the shrunk log odds of its
word or 4-gram among the labelled texts; all numbers are then trained.

All steps are arrays over whole batches: hashes are differences of a running polynomial, sums are reduceat.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, discard, excerpt, learnt, sampled, slices, stash, text_bytes

WORD_BITS, GRAM_BITS, EMBED, HIDDEN = 18, 18, 4, 8
WINDOW, HOP = 16, 8
BLOCK = 1024  # windows read at a time: their states stay in the processor's cache
LONGEST = 64  # bytes of a word
CHUNK = 1 << 21  # bytes of text in arrays at a time
SAMPLE = 3_000  # labelled texts that the network is fitted on, the same number for any input
FIT_CHARS = 16_384  # of each of them, evenly spread over the whole text
LEARNING = 64  # windows of a text that a step of the fit goes back through: those with the highest scores

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(raw: np.ndarray, at: np.ndarray, before: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, gram buckets, where each word's grams begin, where each row's words begin, where each word ends, in raw if that is one row).

    before: the byte that raw follows, where it is cut out of a text; a run that goes on there goes on at a word's end.
    """
    if len(at) > 2:  # a gap between rows as long as a gram looks ahead, so that none sees another's bytes
        raw, at = np.insert(raw, np.repeat(at[1:-1], 2), 32), at + 2 * np.minimum(np.arange(len(at)), len(at) - 2)
    low = np.concatenate([_LOWER[raw], np.zeros(1, np.uint8)])
    inside = _IN_WORD[low]
    inside[-1] = False
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(at), np.int64), np.zeros(0, np.int64)
    pieces = -(-(end - start) // LONGEST)
    if pieces.max() > 1:
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(start, pieces) + k * LONGEST
        end = np.minimum(np.repeat(end, pieces), start + LONGEST)
    powers = _powers(_P, len(low))
    run = np.concatenate([[np.uint64(0)], np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])
    h = (run[end] - run[start]) * _powers(_INVERSE, len(low))[start]
    word = (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    clean = np.where(inside, low, np.uint8(32)).astype(np.uint32)
    first_byte = _LOWER[before] if _IN_WORD[_LOWER[before]] else 32
    clean = np.concatenate([[np.uint32(first_byte)], clean, np.full(3, 32, np.uint32)])  # clean[i + 1] is byte i
    gram = clean[:-3] | clean[1:-2] << np.uint32(8) | clean[2:-1] << np.uint32(16) | clean[3:] << np.uint32(24)  # begins before byte i
    gram = (gram * np.uint32(0x9E3779B1) >> np.uint32(32 - GRAM_BITS)).astype(np.int32)
    n = np.maximum(end - start - 1, 1)  # with both boundaries a word of k bytes has k - 1 grams, one at least
    first = np.concatenate([[0], np.cumsum(n)])
    index = np.arange(first[-1]) + np.repeat(start - first[:-1], n)
    return word, gram[index], first[:-1], np.searchsorted(start, at), end


@dataclass
class Model:
    p: dict[str, np.ndarray]

    def inputs(self, word: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(word):
            return np.zeros((0, 2 * EMBED), np.float32)
        return np.concatenate([self.p["word"][word], np.add.reduceat(self.p["gram"][grams], first, axis=0)], axis=1)

    def logits(self, x: np.ndarray, start: np.ndarray, size: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Of windows that begin at rows start of x and have size words each. keep: gets what backward() needs."""
        p, n = self.p, len(start)
        states = []
        for d in ("f", "b"):
            gates = x @ p[f"{d}_in"] + p[f"{d}_bias"]
            h, own = np.zeros((n, HIDDEN), np.float32), []
            for t in range(WINDOW):
                live = (t < size)[:, None]
                at = np.where(live[:, 0], start + t if d == "f" else start + size - 1 - t, 0)
                g = gates[at]
                rz = 1 / (1 + np.exp(-(g[:, : 2 * HIDDEN] + h @ p[f"{d}_rz"])))
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ p[f"{d}_c"])
                new = np.where(live, h + z * (c - h), h)
                if keep is not None:
                    own.append((at, live, h, r, z, c))
                h = new
                states.append(h)
            if keep is not None:
                keep[d] = own
        both = np.concatenate([np.stack(states[:WINDOW], 1), np.stack(states[WINDOW:], 1)], axis=2)
        e = both @ p["attend"]
        e = np.where(np.arange(WINDOW) < size[:, None], e, -1e9)
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", a, both)
        if keep is not None:
            keep |= {"both": both, "a": a, "pooled": pooled}
        return pooled @ p["out"] + p["out_bias"]

    def backward(self, x: np.ndarray, dlogit: np.ndarray, keep: dict) -> tuple[dict[str, np.ndarray], np.ndarray]:
        p = self.p
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
        g["out"], g["out_bias"] = keep["pooled"].T @ dlogit, dlogit.sum(keepdims=True)
        dpool = dlogit[:, None] * p["out"]
        both, a = keep["both"], keep["a"]
        da = np.einsum("nh,nth->nt", dpool, both)
        de = a * (da - (a * da).sum(1, keepdims=True))
        g["attend"] = np.einsum("nt,nth->h", de, both)
        dboth = a[:, :, None] * dpool[:, None] + de[:, :, None] * p["attend"]
        dx = np.zeros_like(x)
        for d, part in (("f", dboth[:, :, :HIDDEN]), ("b", dboth[:, :, HIDDEN:])):
            dh, dgates = np.zeros_like(part[:, 0]), np.zeros((len(x), 3 * HIDDEN), np.float32)
            for t in range(WINDOW - 1, -1, -1):
                at, live, h, r, z, c = keep[d][t]
                dh = dh + part[:, t]
                own = np.where(live, dh, 0)
                dc = own * z * (1 - c * c)
                dz = own * (c - h) * z * (1 - z)
                drh = dc @ p[f"{d}_c"].T
                dr = drh * h * r * (1 - r)
                drz = np.concatenate([dr, dz], axis=1)
                g[f"{d}_c"] += (r * h).T @ dc
                g[f"{d}_rz"] += h.T @ drz
                dgates[at[live[:, 0]]] += np.concatenate([drz, dc], axis=1)[live[:, 0]]  # no two windows are at one word
                dh = np.where(live, own * (1 - z) + drh * r + drz @ p[f"{d}_rz"].T, dh)
            g[f"{d}_bias"] = dgates.sum(0)
            g[f"{d}_in"] = x.T @ dgates
            dx += dgates @ p[f"{d}_in"].T
        return g, dx


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, size, row) of all windows of rows whose words begin at first (one more than rows)."""
    size = np.diff(first)
    n = np.where(size > 0, np.maximum(1, -(-(size - (WINDOW - HOP)) // HOP)), 0)
    row = np.repeat(np.arange(len(size)), n)
    begin = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * HOP
    return begin, np.minimum(WINDOW, first[row + 1] - begin), row


def _odds(buckets: np.ndarray, first: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Log odds that a text with a bucket is toxic, against all texts, shrunk for buckets of few texts."""
    bad, seen = np.zeros(size), np.zeros(size)
    for k, toxic in enumerate(y):
        own = np.unique(buckets[first[k] : first[k + 1]])
        seen[own] += 1
        bad[own] += toxic
    odds = np.log((bad + 0.3) / (max(1, y.sum()) + 0.6)) - np.log((seen - bad + 0.3) / (max(1, len(y) - y.sum()) + 0.6))
    return np.where(seen > 2, odds * seen / (seen + 5), 0).astype(np.float32)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words() of many texts, a few at a time: word buckets, gram buckets, grams of each word, where each text's words begin."""
    parts, n_words = [], [0]
    for k in range(0, len(texts), 64):
        word, grams, first_gram, first, _ = words(*text_bytes(pa.array(texts[k : k + 64], pa.large_string())))
        parts.append((word, grams, np.diff(first_gram, append=len(grams)).astype(np.int32)))
        n_words += np.diff(first).tolist()
    word, grams, n = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int32) for i in range(3))
    return word, grams, n, np.cumsum(n_words)


def train(texts: list[str], toxic: list[int], seed: int = 3, steps: int = 300, batch: int = 32, rate: float = 0.01) -> Model:
    """Adam over texts, a quarter of each batch toxic. One class only: a network that says it."""
    rng, f32 = np.random.default_rng(seed), np.float32
    y = np.array(toxic, np.float64)
    word, grams, n_grams, first = words_of(texts)
    ends = np.concatenate([[0], np.cumsum(n_grams)])

    def init(*shape: int) -> np.ndarray:
        return rng.normal(0, 0.3, shape).astype(f32)

    p = {"word": init(1 << WORD_BITS, EMBED) * f32(0.1), "gram": init(1 << GRAM_BITS, EMBED) * f32(0.02)}
    if len(word):
        p["word"][:, 0] = 0.5 * _odds(word, first, y, 1 << WORD_BITS)
        p["gram"][:, 0] = 0.25 * _odds(grams, ends[first], y, 1 << GRAM_BITS)
    for d in "fb":
        p |= {f"{d}_in": init(2 * EMBED, 3 * HIDDEN), f"{d}_bias": np.zeros(3 * HIDDEN, f32), f"{d}_rz": init(HIDDEN, 2 * HIDDEN), f"{d}_c": init(HIDDEN, HIDDEN)}
    share = min(max(y.mean() if len(y) else 0, 1e-3), 1 - 1e-3)
    p |= {"attend": init(2 * HIDDEN), "out": init(2 * HIDDEN), "out_bias": np.array([np.log(share / (1 - share))], f32)}
    model = Model(p)
    if not 0 < y.sum() < len(y):
        p["out_bias"][:] = -9 if not y.sum() else 9
        p["out"][:] = 0
        return model
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    dense = [k for k in p if k not in ("word", "gram")]
    by = [np.flatnonzero((y == k) & (np.diff(first) > 0)) for k in (0, 1)]
    if not (len(by[0]) and len(by[1])):
        return model
    parts = (batch - batch // 4, batch // 4)
    turns = [np.concatenate([rng.permutation(b) for _ in range(-(-steps * n // len(b)))]) for b, n in zip(by, parts, strict=True)]
    for t in range(1, steps + 1):
        docs = np.concatenate([x[(t - 1) * n : t * n] for x, n in zip(turns, parts, strict=True)])
        pick = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
        own = np.concatenate([[0], np.cumsum(np.diff(first)[docs])])
        w, n = word[pick], n_grams[pick]
        begin_gram = np.concatenate([[0], np.cumsum(n)])[:-1]
        gr = grams[np.arange(n.sum()) + np.repeat(ends[pick] - begin_gram, n)]
        x = model.inputs(w, gr, begin_gram)
        begin, size, row = windows_of(own)
        begin, size, row = highest(model, x, begin, size, row)
        keep: dict = {}
        z = model.logits(x, begin, size, keep)
        at_doc = np.searchsorted(row, np.arange(len(docs)))
        top = np.maximum.reduceat(z, at_doc)
        soft = np.exp(2 * (z - top[row]))
        soft /= np.add.reduceat(soft, at_doc)[row]
        doc = np.add.reduceat(soft * z, at_doc)
        err = (1 / (1 + np.exp(-doc)) - y[docs]) / len(docs)
        grads, dx = model.backward(x, (err[row] * soft).astype(f32), keep)
        pace = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        scale = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        for name in dense:
            d = grads[name].astype(f32)
            m[name] = 0.9 * m[name] + 0.1 * d
            v[name] = 0.999 * v[name] + 0.001 * d * d
            p[name] -= (pace * scale * m[name] / (np.sqrt(v[name]) + 1e-8)).astype(f32)
        for name, ids, d in (("word", w, dx[:, :EMBED]), ("gram", gr, np.repeat(dx[:, EMBED:], n, axis=0))):
            at_id, inverse = np.unique(ids, return_inverse=True)
            total = np.zeros((len(at_id), EMBED), f32)
            np.add.at(total, inverse, d)
            v[name][at_id] += total * total  # rows of rare buckets keep their own pace
            p[name][at_id] -= (0.3 * pace * total / (np.sqrt(v[name][at_id]) + 1e-3)).astype(f32)
    return model


def highest(model: Model, x: np.ndarray, begin: np.ndarray, size: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with over LEARNING windows those that score highest, which carry nearly all of the gradient; all of others'."""
    n = np.bincount(row)
    if n.max(initial=0) <= LEARNING:
        return begin, size, row
    z = blocked(model, x, begin, size)
    by = np.lexsort((-z, row))
    rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    keep = np.sort(by[rank < LEARNING])
    return begin[keep], size[keep], row[keep]


def blocked(model: Model, x: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """logits() of windows in order, BLOCK at a time."""
    z = np.empty(len(begin), np.float32)
    for k in range(0, len(begin), BLOCK):
        e = min(k + BLOCK, len(begin))
        z[k:e] = model.logits(x[begin[k] : begin[e - 1] + size[e - 1]], begin[k:e] - begin[k], size[k:e])
    return z


def score_rows(model: Model | None, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores of rows of UTF-8 text: the highest window's; 0 without any word or without a model."""
    out = np.zeros(len(at) - 1)
    if model is None:
        return out
    word, grams, first_gram, first, _ = words(raw, at)
    if not len(word):
        return out
    begin, size, row = windows_of(first)
    best = np.full(len(out), -np.inf)
    np.maximum.at(best, row, blocked(model, model.inputs(word, grams, first_gram), begin, size))
    return sigmoid(best)


def sigmoid(best: np.ndarray) -> np.ndarray:
    return np.where(best > -np.inf, 1 / (1 + np.exp(-np.clip(best, -40, 40))), 0.0)


def score_long(model: Model | None, raw: np.ndarray, chunk: int = CHUNK) -> float:
    """The same as score_rows() of one text, chunk bytes at a time: the same words, the same windows.

    A part ends where its last word surely does, and the next one begins with the first window that wasn't whole.
    """
    if model is None:
        return 0.0
    best, at, seen = -np.inf, 0, 0
    size = chunk
    while at < len(raw):
        part = raw[at : at + size]
        last = at + size >= len(raw)
        word, grams, first_gram, _, end = words(part, np.array([0, len(part)]), int(raw[at - 1]) if at else 32)
        n = len(word) if last else int(np.searchsorted(end, len(part) - 1))  # a word at the very end may go on, and a gram reads one byte more
        whole = max(0, (n - WINDOW) // HOP + 1)  # windows with all their words in this part
        if not last and not whole:
            if n == 0 and not len(word):  # nothing but gaps
                at += len(part)
            else:
                size *= 2
            continue
        if last:
            begin, width, _ = windows_of(np.array([0, n]))
            if seen and n <= WINDOW - HOP:
                begin, width = begin[:0], width[:0]  # all its words were in the window before
        else:
            begin, width = np.arange(whole) * HOP, np.full(whole, WINDOW)
        if len(begin):
            x = model.inputs(word, grams, first_gram)
            best = max(best, float(blocked(model, x, begin, width).max()))
        if last:
            break
        at += int(end[whole * HOP - 1])
        seen += whole
        size = chunk
    return float(sigmoid(np.array([best]))[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, chars: int = FIT_CHARS, **options) -> Model | None:
    """A network fitted on at most sample labelled texts, half of each class, those with the smallest hash of id and text.

    Texts of any length are learnt from: of one with more than chars code points, eight parts spread over it, chars in all.
    An id with several labels counts as toxic if one says so. Of rows that repeat an id and text one is learnt from; other
    rows of one id each count. Rows with a null id have no label. The fitting runs in one task of the cluster.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash")).where(F.length("_text") > 0)
    marks = labels.where("toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    known = stash(texts.select("_id", "_hash").join(marks, "_id").distinct(), "labelled")
    key = F.concat_ws(":", F.col("_id").cast("string"), F.col("_hash").cast("string"))
    picked = [sampled(known.where(F.col("_toxic") == kind), key, sample // 2) for kind in (0, 1)]
    rows = texts.join(F.broadcast(picked[0].unionByName(picked[1])), ["_id", "_hash"]).select("_id", "_hash", "_toxic", excerpt(F.col("_text"), chars).alias("text"))
    rows = rows.groupBy("_id", "_hash", F.col("_toxic").cast("int").alias("toxic")).agg(F.min("text").alias("text")).select("text", "toxic")
    raw = learnt(rows, lambda held: pickle.dumps(train([r["text"] for r in held], [r["toxic"] for r in held], **options).p))
    discard(known)
    return Model(pickle.loads(raw)) if raw else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row of docs, from its whole text alone.

    Null and empty texts and texts without any word score 0, and so does all if no row was labelled. Repeated rows each
    give a row, equal texts score alike. Long texts are read a part at a time, in bounded memory, and scored as if whole.
    An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    run = scorer(docs.sparkSession, model, 1)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in run(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    return rows.mapInArrow(scores, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under the threshold; each row by its own text.

    Null and empty texts score 0 and stay, as does all without a model. Repeated rows stay or go together.
    """
    run = scorer(docs.sparkSession, model, docs.columns.index(text_col))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in run(batches):
            yield batch.filter(pa.array(out < threshold))

    return docs.mapInArrow(clean, docs.schema)


def scorer(spark: SparkSession, model: Model | None, text_at: int):
    """Gives slices of batches with the scores of the texts in a column of theirs."""
    wire = spark.sparkContext.broadcast(model.p if model else None)  # 8 MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        net = Model(wire.value) if wire.value else None
        for batch in slices(batches, 512, text_at, CHUNK):
            raw, at = text_bytes(batch.column(text_at))
            yield batch, score_rows(net, raw, at) if len(raw) <= 2 * CHUNK else np.array([score_long(net, raw)])

    return run


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """score() by a network fitted on docs' labelled rows outside the held-out fifth (crc32 of the id mod 5 = 0), with predicted."""
    model = fit(docs.where(bucket_of("doc_id", 5) != 0), labels, **options)
    out = score(docs, model).withColumn("held_out", bucket_of("doc_id", 5) == 0)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
