"""Exact top-k by inner product from an impact-ordered index, a score at a time.

Components are quantised to floor(64 x). For each block of vectors the index holds, for each dimension, its postings in
order of the component: runs of equal components are segments, and a query's weight times the component is a segment's
impact. A query goes through a block's segments in rounds of descending impact, from both ends of every dimension at
once, and adds them to the vectors' accumulators. What a vector has not met is smaller than the round's level, so each
vector has a lower and an upper bound. Vectors whose upper bound is under the k-th best lower bound, here or in the
blocks before, are out, by proof; the query stops when a small part of the block can still be members, and these are
rescored exactly from the vectors themselves. Blocks' answers meet in a window per query. Blocks hold so many components,
so a task's memory doesn't depend on the vectors' length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

SCALE = 64
EXACT = float(1 << 52)  # sums of products in double precision are exact where their sizes stay under this
COMPONENTS = 1 << 19  # in a block of the index, whatever the vectors' length
GROUP = 8  # blocks that one task goes through in a row, each with the k-th best score of those before it
ASKED = 1 << 14  # components in a part of the queries
LANE = 64  # parts, at most, that go through one copy of a group of blocks; fewer where there would be too few tasks
FIRST, FALL = 0.03, 0.6  # the first round goes down to so much of the greatest impact, each later one of the level before
FEW = 0.1  # a query stops when at most so much of the block may still be members, or k times 4


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, q array<double> of whole numbers) of the vectors that take part: not null, no null or non-finite component, id not null."""
    times = F.transform(F.col(vector_col), lambda c: c.cast("double") * SCALE)
    bad = F.exists(times, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(times, lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c))
    live = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(~bad)
    return live.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("q"))


def build(ids: np.ndarray, q: np.ndarray) -> dict:
    """A block's index: vectors in order of id, and for each dimension their numbers in order of the component."""
    by_id = np.argsort(ids, kind="stable")
    ids, q = ids[by_id], np.ascontiguousarray(q[by_id])
    order = np.argsort(q, axis=0, kind="stable").T.astype(np.int32)
    return {"ids": ids, "q": q, "order": np.ascontiguousarray(order)}


def pack(ids: np.ndarray, q: np.ndarray, order: np.ndarray | None = None) -> bytes:
    """Bytes of vectors, in 32 bits a component where those do, and of a block's order."""
    wide = bool(q.size and np.abs(q).max() >= 1 << 31)
    return np.array([*q.shape, wide], np.int64).tobytes() + ids.astype(np.int64).tobytes() + q.astype(np.float64 if wide else np.int32).tobytes() + (b"" if order is None else order.tobytes())


def unpack(raw: bytes) -> dict:
    n, d, wide = np.frombuffer(raw, np.int64, 3).tolist()
    ids = np.frombuffer(raw, np.int64, n, 24)
    q = np.frombuffer(raw, np.float64 if wide else np.int32, n * d, 24 + 8 * n).reshape(n, d)
    order = np.frombuffer(raw, np.int32, -1, 24 + 8 * n + q.nbytes)
    return {"ids": ids, "q": q.astype(np.float64), "order": order.reshape(d, n) if len(order) else order}


def opened(index: dict) -> dict:
    """The index with its postings' components beside them."""
    order = index["order"].astype(np.intp)
    return index | {"order": order, "held": np.take_along_axis(index["q"].T, order, axis=1)}


def search(index: dict, qid: int, w: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(ids, scores, postings read, vectors rescored) of an opened block's k best for one query, ties to the smaller id.

    Vectors with the query's own id are left out. floor: a score that k vectors elsewhere have reached; what is under it may
    be left out. Scores are 64-bit numbers, or Python's own where double precision can't hold all sums.
    """
    ids, q, order, held = index["ids"], index["q"], index["order"], index["held"]
    n, m = len(ids), len(w)
    with np.errstate(over="ignore"):
        most = np.abs(w) * np.maximum(np.abs(held[:, 0]), np.abs(held[:, -1]))  # each dimension's greatest impact
    own = ids == qid
    if not np.isfinite(4 * m * most.sum()):  # beyond double precision: no bounds
        return *best_of(ids[~own], exactly(q[~own], w), k), 0, n
    reach = np.divide(1.0, np.abs(w), out=np.full(m, np.inf), where=w != 0)
    low, high = np.zeros(m, np.int64), np.full(m, n)  # postings before low and from high on have been read
    acc, met, read = np.zeros(n), np.zeros(n), 0
    slack = 1e-9 * most.sum() if most.sum() >= EXACT else 0.0  # beyond that, sums in double precision aren't exact
    much = 2.0 ** np.ceil(np.log2(4 * most.sum() + 4))
    much = much if m * much < EXACT else 0.0  # else sums wouldn't be exact: then in two passes
    level = most.max(initial=0.0) * FIRST / FALL
    while True:
        level = level * FALL if level >= 2 else 0.0
        open_dims = np.flatnonzero((most >= level) & (w != 0))
        parts, adds = [], []
        for d in open_dims:
            a, b = (int(held[d].searchsorted(-level * reach[d], "right")), int(held[d].searchsorted(level * reach[d], "left"))) if level else (n, n)
            for x, y in ((low[d], min(a, high[d])), (max(a, b), high[d])):  # what has impacts of at least the level and hasn't been read
                if y > x:
                    parts.append(order[d, x:y])
                    adds.append(held[d, x:y] * w[d])
            low[d], high[d] = max(low[d], a), min(high[d], max(a, b))
        if parts:  # one sum holds both: what is added, and how often, in multiples of a number far larger
            postings = np.concatenate(parts)
            total = np.bincount(postings, np.concatenate(adds) + much, n)
            times = np.rint(total / much) if much else np.bincount(postings, minlength=n)
            acc += total - times * much
            met += times
            read += len(postings)
        # a dimension that hasn't been met gives less than the level, and one with no posting that large its greatest impact
        rest = ((len(open_dims) - met) * level + most[most < level].sum()) * (1 + 1e-12) if level else 0.0
        lower = np.where(own, -np.inf, acc - rest)
        best = max(np.partition(lower, n - k)[n - k] if n > k else -np.inf, floor)
        possible = ~own & (acc + rest + slack >= best)
        if not level or np.count_nonzero(possible) <= max(4 * k, FEW * n):
            break
    rows = np.flatnonzero(possible)
    exact = exactly(q[rows], w) if slack else (q[rows] @ w).astype(np.int64)
    return *best_of(ids[rows], exact, k), read, len(rows)


def exactly(q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Inner products in Python's whole numbers."""
    weights = [int(x) for x in w]
    return np.array([sum(int(x) * y for x, y in zip(row, weights, strict=True)) for row in q.tolist()] + [None], object)[:-1]


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if scores.dtype == object:
        top = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
    else:
        top = np.lexsort((ids, -scores))[:k]
    return ids[top], scores[top]


def reached(scores: np.ndarray, k: int) -> float:
    """The k-th score as a bound for others, a little less where it isn't exact."""
    if len(scores) < k:
        return -np.inf
    if scores.dtype != object:
        return float(scores[-1])
    return float(scores[-1]) - 1e-9 * abs(float(scores[-1])) if abs(scores[-1]) < 1e300 else -np.inf


def side_and_key(score: int) -> tuple[int, str | None]:
    """For scores that no long holds: 1 above and -1 below, and a text that sorts like the score."""
    if -(1 << 63) <= score < 1 << 63:
        return 0, None
    digits = str(abs(score))
    if score > 0:
        return 1, f"{len(digits):05d}{digits}"
    return -1, f"{99_999 - len(digits):05d}" + "".join(str(9 - int(c)) for c in digits)


def index_blocks(live: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, int]:
    """(dim, block, payload) for quantised vectors, dealt out row by row, and the number of blocks."""
    n = max(1, -(-(live.agg(F.sum(F.size("q"))).first()[0] or 0) // components))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        index = build(group["vec_id"].to_numpy(np.int64), np.stack(group["q"].to_list()))
        return pd.DataFrame({"dim": [int(group["dim"].iloc[0])], "block": [int(group["block"].iloc[0])], "payload": [pack(**index)]})

    dealt = live.select("vec_id", "q", F.size("q").alias("dim"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("block"))
    return dealt.groupBy("dim", "block").applyInPandas(one, "dim int, block int, payload binary"), n


FOUND = "query_id long, vec_id long, score long, side int, key string"


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by every, the k best rows of other ids by inner product.

    Ties go to the smaller id; with fewer than k others all are given. Vectors that are null or hold null or non-finite
    components (also those that are so times 64), and rows with a null id, take no part. Vectors are compared with those of
    their own length, empty ones with none. Repeated rows are candidates as often as they are there; an id asks once, with
    the least of its vectors, and rows with its id are never its results. Scores are exact, of any size: ranks go by them,
    and one that no long holds is given as the largest or smallest long. An empty table gives an empty result. Further
    columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    live = stash(quantised(vectors, id_col, vector_col).where(F.size("q") > 0), "quantised")
    blocks, n = index_blocks(live, components)
    asked = live.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q"))
    m = max(1, -(-(asked.agg(F.sum(F.size("q"))).first()[0] or 0) // ASKED))

    def bundle(group: pd.DataFrame) -> pd.DataFrame:
        payload = pack(group["vec_id"].to_numpy(np.int64), np.stack(group["q"].to_list()))
        return pd.DataFrame({"dim": [int(group["dim"].iloc[0])], "part": [int(group["part"].iloc[0])], "asked": [payload]})

    dealt = asked.select("vec_id", "q", F.size("q").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int").alias("part"))
    parts = dealt.groupBy("dim", "part").applyInPandas(bundle, "dim int, part int, asked binary")
    spans = -(-n // GROUP)
    lane = max(1, min(LANE, m * spans // (3 * spark.sparkContext.defaultParallelism)))  # parts that share a copy of the index
    lanes = parts.withColumn("lane", F.floor(F.col("part") / lane)).withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1)))).groupBy("dim", "span", "lane")
    copies = blocks.withColumn("span", F.floor(F.col("block") / GROUP).cast("int")).withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((m - 1) // lane).cast("long"))))

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        index = [opened(unpack(x.as_py())) for _, x in sorted(zip(held["block"].to_pylist(), held["payload"], strict=True), key=lambda p: p[0])]
        out: list[list] = [[], [], [], [], []]
        for raw in (x.as_py() for x in asked["asked"]) if index else ():
            queries = unpack(raw)
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries["ids"])  # each query's k best of the blocks so far
            for block in index:
                for i, (qid, w) in enumerate(zip(queries["ids"].tolist(), queries["q"], strict=True)):
                    ids, scores = best[i]
                    new, more, _, _ = search(block, qid, w, k, reached(scores, k))
                    best[i] = best_of(np.concatenate([ids, new]), np.concatenate([scores, more]), k)
            for qid, (ids, scores) in zip(queries["ids"].tolist(), best, strict=True):
                large = [side_and_key(int(x)) for x in scores] if scores.dtype == object else [(0, None)] * len(ids)
                held_scores = [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in scores]
                for column, values in zip(out, ([qid] * len(ids), ids.tolist(), held_scores, [x[0] for x in large], [x[1] for x in large]), strict=True):
                    column += values
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["query_id", "vec_id", "score", "side", "key"])

    found = copies.groupBy("dim", "span", "lane").cogroup(lanes).applyInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("score"), F.desc("key"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 20, every: int = 20) -> str:
    """The same by brute force in DuckDB's SQL, for vectors of finite components."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
a AS (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % {every} = 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
