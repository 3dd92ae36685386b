"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments of 21, 21 and 22 bits, each held as a word of 23 bits (zeros above). The
binary Golay code of length 23 is perfect: every word is within 3 bits of one codeword. A word's keys are the index of
that codeword and, if it is 3 bits away, those of the five codewords 4 bits away: one or six keys. Any two words that
differ in at most 2 bits share a key (tests go through every syndrome and every error of 1 or 2 bits).

Pigeonhole, for at most 4 differing bits over three segments with a <= b <= c errors each:
* a = 0: then b <= 2, so one segment agrees exactly and another shares a key: 6 ordered pairs, 33 bits of key;
* a >= 1: then the errors are (1,1,1) or (1,1,2), so all three segments share a key: 36 bits of key.
A fingerprint has about 180 keys. Rows with equal keys meet by a shuffle on the key, and each bucket is searched breadth
first: an element is compared only with those that no earlier one has reached, and only a spanning forest of the bucket's
links is emitted, never all pairs. Links become components by large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few, fresh, leave_out, slices, stash

SEED = 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit, bits
GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1, generates the [23,12,7] Golay code
WHOLE_BUCKET = 1 << 12  # distinct fingerprints of a bucket searched in one task; larger buckets are dealt in blocks


def hashes(raw: bytes, width: int) -> list[int]:
    words = raw.lower().split()  # of bytes: A-Z, and the white space 0x20 0x09-0x0D
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    return [digest(line[a : b - 1], SEED) for a, b in zip([0, *ends], ends[width - 1 :], strict=False)]


def majority(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of counts hashes: a bit is 1 if it is in over half of them. No hashes: zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        at = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.uint32)
        out[full] = np.packbits(2 * ones > counts[full][:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed long. Null and empty texts: zero. Repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256, 1):
            values, counts = [], []
            for raw in batch.column(1).cast(pa.large_binary()).to_pylist():
                own = hashes(raw or b"", width)
                values += own
                counts.append(len(own))
            fp = majority(np.array(values, np.uint64), np.array(counts, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of all 23-bit words; by syndrome, the up to 6 error patterns that lead to a word's keys; how many."""
    words = np.arange(1 << 23, dtype=np.uint32)
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * np.uint32(GENERATOR << (bit - 11))
    syndrome = rest.astype(np.uint16)
    errors, n = np.zeros((2048, 6), np.uint32), np.zeros(2048, np.uint8)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = syndrome[e]
            if weight < 4 or bin(errors[s, 0]).count("1") == 3:  # perfect: one pattern of at most 3 bits each
                errors[s, n[s]] = e
                n[s] += 1
    return syndrome, errors, n


def codeword_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words, up to 6 codeword indices each (the 12 message bits) and which of the 6 count."""
    syndrome, errors, n = golay()
    s = syndrome[words]
    return ((words[:, None] ^ errors[s]) >> 11).astype(np.uint64), np.arange(6) < n[s][:, None]


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row number): equal keys for any two fingerprints at most 4 bits apart."""
    parts = [(fp >> np.uint64(a)) & np.uint64((1 << n) - 1) for a, n in SEGMENTS]
    near = [codeword_keys(p.astype(np.uint32)) for p in parts]
    keys, rows = [], []
    for tag, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        index, valid = near[j]
        key = np.uint64(tag) << np.uint64(40) | parts[i][:, None] << np.uint64(12) | index
        keys.append(key[valid])
        rows.append(np.nonzero(valid)[0])
    (a, va), (b, vb), (c, vc) = near
    key = np.uint64(6) << np.uint64(40) | a[:, :, None, None] << np.uint64(24) | b[:, None, :, None] << np.uint64(12) | c[:, None, None, :]
    valid = va[:, :, None, None] & vb[:, None, :, None] & vc[:, None, None, :]
    keys.append(key[valid])
    rows.append(np.nonzero(valid)[0])
    return np.concatenate(keys), np.concatenate(rows)


def forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that span the components of fp under at most so many differing bits."""
    links, rest = [], fp
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            hit = np.bitwise_count(rest ^ x) <= bits
            if hit.any():
                new = rest[hit]
                links += [(x, y) for y in new]
                front += list(new)
                rest = rest[~hit]
    return links


def bucket_links(bits: int, whole: int):
    """Over rows sorted by key: the links of each bucket; a bucket too large to search whole is passed on (big = true)."""

    def out(links: list, pairs: np.ndarray, big: list) -> pa.RecordBatch:
        a = np.concatenate([np.array([x[0] for x in links], np.uint64), pairs[:, 0], np.array([x[0] for x in big], np.uint64)])
        b = np.concatenate([np.array([x[1] for x in links], np.uint64), pairs[:, 1], np.array([x[1] for x in big], np.uint64)])
        flag = np.arange(len(a)) >= len(a) - len(big)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(flag)], ["a", "b", "big"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None  # over: key of a bucket being passed on
        none = np.zeros((0, 2), np.uint64)
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            if over is not None:
                n = int(np.searchsorted(key, over, "right"))
                if n:
                    yield out([], none, [(over, x) for x in fp[:n]])
                key, fp, over = key[n:], fp[n:], over if n == len(key) else None
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1], "left"))
            yield out(*found(key[:last], fp[:last]), [])
            key, fp = key[last:], fp[last:]
            if len(key) > whole:
                over = key[-1]
                yield out([], none, [(over, x) for x in fp])
                key, fp = key[:0], fp[:0]
        yield out(*found(key, fp), [])

    def found(key: np.ndarray, fp: np.ndarray) -> tuple[list, np.ndarray]:
        if not len(key):
            return [], np.zeros((0, 2), np.uint64)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.concatenate([at, [len(key)]]))
        two = at[n == 2]
        pairs = np.stack([fp[two], fp[two + 1]], axis=1)
        pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= bits]
        links = set()
        for a, m in zip(at[n > 2], n[n > 2], strict=True):
            links.update(forest(fp[a : a + m], bits))
        return list(links), np.unique(pairs, axis=0)

    return run


def block_links(big: DataFrame, bits: int, block: int) -> DataFrame:
    """Links of the buckets too large for one task: each is dealt into blocks, and every pair of blocks is searched."""
    import pandas as pd

    def search(group: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(group["fp"].to_numpy().view(np.uint64))
        links = np.array(forest(fp, bits), np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    sized = big.join(big.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("n")), "key")
    mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    dealt = sized.withColumn("m", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = dealt.select("key", F.least("m", "o").alias("x"), F.greatest("m", "o").alias("y"), "fp")
    return pairs.groupBy("key", "x", "y").applyInPandas(search, "a long, b long")


def links(prints: DataFrame, bits: int = 4, whole: int = WHOLE_BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that span every component of those <= bits apart."""
    if not 0 <= bits <= 4:
        raise ValueError("the segments' keys cover at most 4 differing bits")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            fp = batch.column(0).to_numpy().view(np.uint64)
            keys, rows = bucket_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp[rows].view(np.int64))], ["key", "fp"])

    dealt = prints.select("fp").mapInArrow(emit, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = stash(dealt.mapInArrow(bucket_links(bits, whole), "a long, b long, big boolean").distinct(), "links")
    small = found.where(~F.col("big")).select("a", "b")
    big = found.where("big").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    return small if big.isEmpty() else small.unionByName(block_links(big, bits, whole)).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): for every node of the edges (a, b) the smallest node it is connected to."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())

    e = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = state(e)
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, stash(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(last)
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs.

    component_id is the smallest non-null id reachable by links of at most bits differing bits. Null and empty texts have
    fingerprint zero and link like any other. Repeated rows each give a row; ties can't arise. A null id stays null and
    counts only if a component has no other, whose component_id is then null. An empty table gives an empty result.
    Further columns are ignored, whatever their names.
    """
    rows = stash(fingerprints(docs, id_col, text_col, width), "fingerprints")
    prints = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(prints, bits))
    linked = prints.join(roots, prints.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    tops = prints.join(roots.select(F.col("root").alias("fp")).distinct(), "fp", "left_semi").select("fp", "first")
    members = roots.join(prints, roots.node == prints.fp).select("root", "first").unionByName(tops.select(F.col("fp").alias("root"), "first"))
    least = members.groupBy("root").agg(F.min("first").alias("least"))
    known = linked.join(least, "root", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return rows.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """(the ids of all near-duplicates but each component's smallest, ids that stay but are there more than once), as tables."""
    found = stash(near_duplicates(docs, id_col, text_col, **options).select("doc_id", "component_id"), "components")
    gone = stash(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    again = stash(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    discard(found)
    return gone, again


def once(rows: DataFrame, id_col: str, text_col: str, repeated: DataFrame) -> DataFrame:
    """Of the rows with each repeated id one, the least by its text and then its other columns; all other rows."""
    if repeated.isEmpty():
        return rows
    (one,) = fresh(rows.columns, "one")
    again = rows.join(few(repeated.toDF(one)), F.col(id_col) == F.col(one), "left_semi")
    least = again.groupBy(id_col).agg(F.min(F.struct(text_col, *(c for c in rows.columns if c != text_col))).alias(one)).select(f"{one}.*")
    return leave_out(rows, id_col, repeated).unionByName(least.select(*rows.columns))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest id, one row if that id is repeated.

    Rows with a null id stay. The ids that go are joined out, so texts are read once more and not held in any state.
    """
    gone, again = copies(docs, id_col, text_col, **options)
    return once(leave_out(docs, id_col, gone), id_col, text_col, again)
