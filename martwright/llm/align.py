"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Both tokenizers cut the same bytes, a space and the text. The ends of both, united, cut them into elementary intervals, and
each interval has one owner in either cutting: it is one overlap of two tokens, and each overlap is one interval. Ends that
both share close groups; a group's tokens of one side cover the same bytes as its tokens of the other.

How often a pair of ids is linked is counted over the whole corpus, in documents. Documents are read and cut once: a task
numbers the pairs that it meets (a block of at most MOST_PAIRS pairs) and writes each document's pairs as numbers, and its
block's pairs with the number of documents that hold them. The blocks' numbers are summed by pair, and what each block needs
to know comes back to it by two shuffles of its distinct pairs, in which a pair has one row a block, however frequent it is.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, slices, stash

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: words of the byte-level vocabulary
SPACE = "▁"
TEXT_BYTES = 1 << 20  # text that is cut at a time
MOST_PAIRS = 1 << 20  # pairs of a block
ROW_PAIRS = 1 << 16  # pairs in a row of the table of blocks
SIGNS = (b",", b"|", b";", b"")


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary's entries stands for."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers, made from their files' contents: ids of texts, and each id's bytes."""

    def __init__(self, byte_bpe: bytes, pieces: bytes) -> None:
        import sentencepiece
        import tiktoken

        file = json.loads(byte_bpe)
        special, symbols = {t["content"] for t in file["added_tokens"]}, byte_symbols()
        entries = {i: bytes(symbols[c] for c in e) for e, i in file["model"]["vocab"].items() if e not in special}
        # merges are in the order of their ids, so ranks say the same
        self.a = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks={e: i for i, e in entries.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        n = self.b.get_piece_size()
        self.bytes_a = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        self.size_a, self.size_b = (np.array([len(x) for x in held], np.int64) for held in (self.bytes_a, self.bytes_b))
        self.signed = [str(i).encode() + s for held in (self.bytes_a, self.bytes_b) for i in range(len(held)) for s in SIGNS]

    def cut(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Both cuttings of each text; both empty if it is null or empty, or its tokens' bytes aren't a space and the text."""
        a = [self.a.encode_ordinary(" " + t) if t else [] for t in texts]
        b = self.b.encode([t or "" for t in texts], num_threads=1)
        for k, t in enumerate(texts):
            whole = (" " + t).encode() if t else b""
            if b"".join(map(self.bytes_a.__getitem__, a[k])) != whole or b"".join(map(self.bytes_b.__getitem__, b[k])) != whole:
                a[k], b[k] = [], []
        return a, b


@lru_cache(1)
def tokenizers(byte_bpe: bytes, pieces: bytes) -> Tokenizers:
    return Tokenizers(byte_bpe, pieces)


def files(spark: SparkSession, byte_bpe: str, pieces: str):
    """The contents of the two files, read on the driver, for tasks: 2 MB, whatever the data."""
    held = []
    for path in (byte_bpe, pieces):
        with open(path, "rb") as f:
            held.append(f.read())
    return spark.sparkContext.broadcast(tuple(held))


def united(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """np.union1d for two sorted arrays: a stable sort only merges them."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    return both[np.diff(both, prepend=both[0] - 1) != 0] if len(both) else both


class Overlaps:
    """The overlaps in texts that lie end to end: their bytes are counted on, so that texts' ends are shared ends.

    a, b: ids of all tokens; of_a, of_b: how many each text has; owner_a, owner_b: the tokens that each interval belongs to;
    link_end, group_end: where each text's links and groups end.
    """

    def __init__(self, t: Tokenizers, cut_a: list[list[int]], cut_b: list[list[int]]) -> None:
        self.t = t
        self.of_a, self.of_b = (np.array([len(x) for x in c], np.int64) for c in (cut_a, cut_b))
        self.a, self.b = (np.fromiter(chain.from_iterable(c), np.int64, int(n.sum())) for c, n in ((cut_a, self.of_a), (cut_b, self.of_b)))
        ends_a, ends_b = np.cumsum(t.size_a[self.a]), np.cumsum(t.size_b[self.b])
        ends = united(ends_a, ends_b)
        self.owner_a, self.owner_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        last_a, last_b = (e[o] == ends if len(ends) else np.zeros(0, bool) for e, o in ((ends_a, self.owner_a), (ends_b, self.owner_b)))
        self.shared = last_a & last_b
        group = np.cumsum(self.shared) - self.shared  # of each interval
        self.group_a, self.group_b = group[last_a], group[last_b]
        self.link_end = np.searchsorted(ends, np.concatenate([[0], ends_a])[np.cumsum(self.of_a)], "right")
        self.group_end = np.concatenate([[0], np.cumsum(self.shared)])[self.link_end]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both sides of each link, text by text."""
        return self.a[self.owner_a], self.b[self.owner_b]

    def in_groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens in order of groups, those of A before those of B in each: (group, place among a and then b, whether of B)."""
        group = np.concatenate([self.group_a, self.group_b])
        order = np.argsort(group, kind="stable")
        return group[order], order, order >= len(self.a)

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups written as `a1,a2|b1;a3|b2,b3`; of a text without tokens ''."""
        group, order, of_b = self.in_groups()
        ids = np.concatenate([self.a, self.b + len(self.t.bytes_a)])[order]
        sign = np.where(group[1:] != group[:-1], 2, of_b[1:] != of_b[:-1])
        end = np.cumsum(self.of_a + self.of_b)
        sign = np.append(sign, 2)
        sign[end[end > 0] - 1] = 3
        written = list(map(self.t.signed.__getitem__, (ids * len(SIGNS) + sign).tolist()))
        return [hashlib.sha256(b"".join(written[a:b])).hexdigest() if b > a else "" for a, b in zip([0, *end.tolist()], end.tolist(), strict=False)]


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers under 2^28 in one to four bytes of seven bits each, and how many bytes each has."""
    n = 1 + (values >= 1 << 7) + (values >= 1 << 14) + (values >= 1 << 21)
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(4):
        rows = np.flatnonzero(n > k)
        out[first[rows] + k] = (values[rows] >> 7 * k & 127) | np.where(n[rows] > k + 1, 128, 0)
    return out, n


def unpacked(raw: np.ndarray) -> np.ndarray:
    last = raw < 128
    end = np.flatnonzero(last)
    place = np.arange(len(raw)) - np.concatenate([[0], end + 1])[np.cumsum(last) - last]
    parts = (raw & 127).astype(np.int64) << 7 * place
    return np.add.reduceat(parts, np.concatenate([[0], end[:-1] + 1])) if len(end) else parts


def binaries(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of these sizes, end to end in raw."""
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw))])


class Block:
    """Numbers for the pairs that a task meets, in order of their first appearance, and the documents that hold each."""

    def __init__(self, name: int) -> None:
        self.name = name
        self.keys, self.number = np.zeros(0, np.int64), np.zeros(0, np.int64)  # sorted by key
        self.docs = np.zeros(0, np.int64)  # by number

    def numbers(self, pairs: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The numbers of distinct sorted pairs, held by so many more documents."""
        at = np.searchsorted(self.keys, pairs)
        new = np.append(self.keys, -1)[at] != pairs
        given = np.arange(len(self.docs), len(self.docs) + int(new.sum()))
        self.number = np.insert(self.number, at[new], given)
        self.keys = np.insert(self.keys, at[new], pairs[new])
        self.docs = np.concatenate([self.docs, np.zeros(len(given), np.int64)])
        out = self.number[np.searchsorted(self.keys, pairs)]
        self.docs[out] += docs
        return out

    def by_number(self) -> np.ndarray:
        out = np.zeros_like(self.keys)
        out[self.number] = self.keys
        return out


def cut_documents(docs: DataFrame, id_col: str, text_col: str, wire) -> DataFrame:
    """Rows of documents (first is null) and rows of blocks' pairs: see the columns below."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, numbers binary, times binary, first long, pairs array<long>, docs array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = tokenizers(*wire.value)
        task = TaskContext.get().partitionId() << 32
        block = Block(task)
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "numbers", "times", "first", "pairs", "docs"]

        def of_block(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            pairs = block.by_number()
            for k in range(0, len(pairs), ROW_PAIRS):
                none = [pa.nulls(1, x) for x in (id_type, *[pa.int64()] * 4, pa.string())]
                lists = [pa.array([x[k : k + ROW_PAIRS]], pa.list_(pa.int64())) for x in (pairs, block.docs)]
                yield pa.RecordBatch.from_arrays([*none, pa.array([block.name]), *(pa.nulls(1, pa.binary()),) * 2, pa.array([k]), *lists], names)

        id_type = None
        for batch in slices(batches, 4096, 1, TEXT_BYTES):
            id_type = batch.schema.field(0).type
            if len(block.docs) >= MOST_PAIRS:
                yield from of_block(id_type)
                block = Block(block.name + 1)
            o = Overlaps(t, *t.cut(batch.column(1).to_pylist()))
            a, b = o.links()
            n, all_pairs = batch.num_rows, len(t.bytes_a) * len(t.bytes_b)
            n_links = np.diff(o.link_end, prepend=0)
            held, times = np.unique(np.repeat(np.arange(n), n_links) * all_pairs + a * len(t.bytes_b) + b, return_counts=True)
            row = held // all_pairs
            pairs, place, many = np.unique(held - row * all_pairs, return_inverse=True, return_counts=True)
            number = block.numbers(pairs, many)[place]
            order = np.lexsort((number, row))
            row, number, times = row[order], number[order], times[order]
            step = number - np.where(np.diff(row, prepend=-1) != 0, 0, np.concatenate([[0], number[:-1]]))
            columns = []
            for values in (step, times):
                raw, size = packed(values)
                columns.append(binaries(raw, np.bincount(row, size, n).astype(np.int64)))
            longs = [pa.array(x) for x in (o.of_a, o.of_b, np.diff(o.group_end, prepend=0), n_links)]
            nulls = [pa.nulls(n, x) for x in (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(o.digests()), pa.array(np.full(n, block.name)), *columns, *nulls], names)
        if id_type is not None:
            yield from of_block(id_type)
        del block
        release()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


DIGEST = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """For each row of docs the numbers of its tokens, groups and links, and how its links stand in the corpus.

    A pair's count is the number of rows that hold it linked; n_best counts the links whose count is the highest of their
    id in A (ties included), count_sum adds up the counts of all links. Null and empty texts, and texts that a tokenizer
    doesn't keep byte for byte, have no tokens: zeros and ''. Repeated rows each count and each give a row; ids may be null.
    Long texts are cut whole, one at a time. An empty table gives an empty result. Further columns are ignored, whatever
    their names.
    """
    wire = files(docs.sparkSession, byte_bpe, pieces)
    cut = stash(cut_documents(docs, id_col, text_col, wire), "cut")
    own = cut.where("first is not null").select("block", "first", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "held"))
    own = own.select("block", (F.col("first") + F.col("at")).alias("number"), F.col("held.pairs").alias("pair"), F.col("held.docs").alias("docs"))
    counts = own.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.floor(F.col("pair") / F.lit(len_b(wire))))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A at most: its vocabulary bounds it
    ranked = stash(counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")
    back = own.select(F.col("block").alias("of"), "number", "pair").join(ranked, "pair").select("of", "number", "n", "best")
    kind = cut.schema["doc_id"].dataType.simpleString()
    rows = cut.where("first is null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "numbers", "times")

    def sums(held: pa.Table, known: pa.Table) -> pa.Table:
        number = known["number"].to_numpy()
        n, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        n[number], best[number] = known["n"].to_numpy(), known["best"].to_numpy(zero_copy_only=False)
        out: list[list] = [[], []]
        for numbers, times in zip(held["numbers"], held["times"], strict=True):
            at = np.cumsum(unpacked(np.frombuffer(numbers.as_buffer(), np.uint8)))
            many = unpacked(np.frombuffer(times.as_buffer(), np.uint8))
            out[0].append(int(many @ best[at]))
            out[1].append(int(many @ n[at]))
        columns = {c: held[c] for c in DIGEST if c in held.column_names} | {"n_best": pa.array(out[0], pa.int64()), "count_sum": pa.array(out[1], pa.int64())}
        return pa.table([columns[c] for c in DIGEST], list(DIGEST))

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(sums, schema)


def len_b(wire) -> int:
    return len(tokenizers(*wire.value).bytes_b)


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """docs with groups (array of a: ids of A, b: ids of B) and links (array of a, b), both in order of the bytes.

    Rows, nulls and long texts are as in digest(); a text without tokens has neither groups nor links. Further columns stay;
    ones named groups or links are replaced.
    """
    wire = files(docs.sparkSession, byte_bpe, pieces)
    kept = docs.select(*(c for c in docs.columns if c.lower() not in ("groups", "links")))
    text_at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(*wire.value)
        for batch in slices(batches, 1024, text_at, TEXT_BYTES):
            o = Overlaps(t, *t.cut(batch.column(text_at).cast(pa.large_string()).to_pylist()))
            n_groups = int(o.shared.sum())
            lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(group, np.arange(n_groups + 1)), pa.int32()), pa.array(ids, pa.int32())) for group, ids in ((o.group_a, o.a), (o.group_b, o.b))]
            groups = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], o.group_end]), pa.int32()), pa.StructArray.from_arrays(lists, ["a", "b"]))
            links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], o.link_end]), pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in o.links()], ["a", "b"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, groups, links], [*batch.schema.names, "groups", "links"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, groups array<struct<a:array<int>,b:array<int>>>, links array<struct<a:int,b:int>>")


def products(groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, group, a, b): each group of aligned() expanded to all pairs of its tokens, overlapping or not; groups are short."""
    each = groups.select(id_col, F.posexplode("groups").alias("group", "held")).select(id_col, "group", "held.b", F.explode("held.a").alias("a"))
    return each.select(id_col, "group", "a", F.explode("b").alias("b"))
