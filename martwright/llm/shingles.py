"""Near copies by the Jaccard similarity of their word shingles, found by banded MinHash and verified exactly.

A text's set is the hashes of its distinct shingles of five words. Of 100 orders of the hashes the least hash of each is
kept, in 20 bands of 5; texts that agree in a band meet. At similarity 0.8 two texts agree in some band with probability
1 - (1 - 0.8^5)^20 = 0.9996, at 0.9 with all but 1e-7. All texts of a bucket are compared, whatever its size, by their
whole sets. Buckets of at most FEW texts give their pairs, which are joined with the sets. Of a larger one no pairs are
listed: its texts are dealt by size, as sets that differ by more than the similarity in size can't have it, and then into
blocks, and each two blocks are compared in a task by counting the shingles that every two texts share as a product of
matrices; only links that span the groups found there leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few, leave_out, slices, stash
from .simhash import components, hashes

BANDS, ROWS = 20, 5
FEW = 32  # texts of a bucket that gives its pairs
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21  # texts of a block, and hashes in their sets (more where one text has more)
COLUMNS = 4096  # of a matrix that is multiplied at a time
DENSE = 64  # a shingle that over 1 / DENSE of the texts have is a column of a matrix; the pairs of a rarer one are counted
ORDERS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    return np.unique(np.array(hashes(text or b"", width), np.uint64))


def band_keys(own: np.ndarray) -> list[int]:
    """One key a band, as signed longs; different bands' keys differ."""
    least = np.full(len(ORDERS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 4096):
        least = np.minimum(least, (own[None, k : k + 4096] * ORDERS[:, None]).min(axis=1))
    raw = least.tobytes()
    keys = [xxhash.xxh64_intdigest(raw[8 * ROWS * b : 8 * ROWS * (b + 1)], b) for b in range(BANDS)]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, keys): the size of a text's set and its bands' keys; texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256, 1):
            ids, n, keys = [], [], []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                own = shingle_set(raw, width)
                if len(own):
                    ids.append(key)
                    n.append(len(own))
                    keys.append(band_keys(own))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n long, keys array<long>")


def buckets(rows: DataFrame) -> DataFrame:
    """(key, id, n, held): the buckets of at least two texts, as a table."""
    members = rows.select("id", "n", F.explode("keys").alias("key"))
    return stash(members.join(members.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "key"), "buckets")


def candidates(sized: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: the pairs of small buckets whose sizes allow the similarity, as a table."""
    small = sized.where(F.col("held") <= FEW)
    a, b = small.select("key", F.col("id").alias("a"), F.col("n").alias("na")), small.select("key", F.col("id").alias("b"), F.col("n").alias("nb"))
    allowed = F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - 1e-9
    return stash(a.join(b, "key").where("a < b").where(allowed).select("a", "b").distinct(), "candidates")


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements every two of the sets have in common."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.float32)
    many = np.flatnonzero(held > max(1, n // DENSE))
    place = np.full(len(held), -1)
    place[many] = np.arange(len(many))
    at = place[column]
    for k in range(0, len(many), COLUMNS):
        mine = (at >= k) & (at < k + COLUMNS)
        part = np.zeros((n, min(COLUMNS, len(many) - k)), np.float32)
        part[row[mine], at[mine] - k] = 1
        out += part @ part.T
    order = np.argsort(column, kind="stable")
    first = np.cumsum(held) - held
    for f in range(2, max(1, n // DENSE) + 1):
        of = row[order[first[held == f][:, None] + np.arange(f)]]  # the rows of each shingle that f texts have
        for k in range(0, len(of), max(1, (1 << 22) // f**2)):
            pairs = (of[k : k + max(1, (1 << 22) // f**2), :, None] * n + of[k : k + max(1, (1 << 22) // f**2), None, :]).ravel()
            out += np.bincount(pairs, minlength=n * n).reshape(n, n)
    size = np.array([len(s) for s in sets])
    out[np.arange(n), np.arange(n)] = size
    return out


def spanning(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that span the groups of sets of which two have at least so much similarity."""
    both, size = shared(sets), np.array([len(s) for s in sets], np.float32)
    links, rest = [], np.arange(len(sets))
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            hit = both[x, rest] >= least * (size[x] + size[rest] - both[x, rest]) - 1e-6
            links += [(x, y) for y in rest[hit]]
            front += list(rest[hit])
            rest = rest[~hit]
    return links


def dense_links(large: DataFrame, sets: DataFrame, least: float, kind: str) -> DataFrame:
    """(a, b): links that span what is similar in buckets of more than FEW texts. sets: (id, held)."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-float(np.log(least))) + 1e-9).cast("long")  # texts of similar size are in one, or in neighbours
    dealt = large.select("key", "id", "n", F.explode(F.array(band, band + 1)).alias("band"))
    sized = dealt.join(dealt.groupBy("key", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"), F.count("*").alias("texts")).where("texts > 1"), ["key", "band"])
    mine = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    twice = sized.withColumn("m", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = twice.select("key", "band", F.least("m", "o").alias("x"), F.greatest("m", "o").alias("y"), "id").join(sets, "id")

    def compare(group: pa.Table) -> pa.Table:
        ids = group["id"].combine_chunks()
        links = spanning([np.frombuffer(x.as_buffer(), np.uint64) for x in group["held"]], least) if len(ids) > 1 else []
        a, b = (ids.take(pa.array([int(link[k]) for link in links], pa.int64())) for k in (0, 1))
        return pa.table([a, b], ["a", "b"])

    return blocks.groupBy("key", "band", "x", "y").applyInArrow(compare, f"a {kind}, b {kind}").where("a <> b")


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, held): the whole sets of the texts with these ids, as a table."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256, 1):
            held = [shingle_set(raw, width).tobytes() for raw in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], ["id", "held"])

    kind = docs.schema[id_col].dataType.simpleString()
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(few(ids), "id", "left_semi")
    return stash(wanted.mapInArrow(sets, f"id {kind}, held binary"), "sets")


def similar(pairs: DataFrame, sets: DataFrame, least: float, kind: str) -> DataFrame:
    """The pairs (a, b) whose sets have at least so much Jaccard similarity, compared whole."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64, 2):
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("held").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("held").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(compare, f"a {kind}, b {kind}")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, gone: DataFrame | None = None) -> DataFrame:
    """The ids, as a table, of texts linked by a similarity of at least `least`, but each group's smallest.

    Null ids have no links. gone: ids (one column) that count as not there; they are left out of the sketches, so that texts
    don't move for it. Other ids must be unique.
    """
    named = docs.where(F.col(id_col).isNotNull())
    kind = docs.schema[id_col].dataType.simpleString()
    held = stash(sketches(named, id_col, text_col, width), "sketches")
    sized = buckets(held if gone is None else leave_out(held, "id", gone))
    pairs = candidates(sized, least)
    large = sized.where(F.col("held") > FEW)
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(large.select("id")).distinct()
    sets = shingle_sets(named, ids, id_col, text_col, width)
    linked = similar(pairs, sets, least, kind)
    if not large.isEmpty():
        linked = linked.unionByName(dense_links(large, sets, least, kind))
    linked = stash(linked.distinct(), "similar")
    gone = stash(components(linked).select(F.col("node").alias("id")), "copies")
    discard(held, sized, pairs, sets, linked)
    return gone


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """docs without near copies: of texts linked by a similarity of at least `least`, the row with the smallest id.

    Ids must be unique; rows with a null id stay. Further columns stay, whatever their names.
    """
    return leave_out(docs, id_col, copies(docs, id_col, text_col, width, least))
