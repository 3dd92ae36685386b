"""What the operators of this subpackage share: reading, cutting lineage, Arrow batches, samples to learn from."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STASH_ROWS = 1024  # in the Arrow batches of jobs that write tables, so that a batch is a few MB of ordinary texts
SLICE_BYTES = 1 << 22  # text that Python turns into arrays or lists at a time; one longer text is a slice of its own


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a single-process master may do without: it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="martwright-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, Arrow batches hold at most so many rows (and, as always, so many bytes); then the session is as before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Gives a worker's freed memory back to the system, as the worker goes on to other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives the loss of any executor.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with arrow_rows(spark, STASH_ROWS):
        df.write.parquet(path)
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(held)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(*stashes: DataFrame) -> None:
    """Deletes what stash() has written, once nothing is read from it any more."""
    for df in stashes:
        held = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        held.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(held, True)


MOST_IDS = 1 << 20  # ids that are broadcast, 8 bytes each; more are shuffled


def few(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if there are at most MOST_IDS."""
    return F.broadcast(ids) if ids.limit(MOST_IDS + 1).count() <= MOST_IDS else ids


def leave_out(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id isn't among ids (one column); rows with a null id stay. Rows only move where the ids are many."""
    (gone,) = fresh(rows.columns, "gone")
    return rows.join(few(ids.toDF(gone)), F.col(id_col) == F.col(gone), "left_anti")


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of the columns, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(columns: Iterable[str], *names: str) -> list[str]:
    """The columns but those of these names, as Spark compares names."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end and where each row begins (one more than rows); null is empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return (raw[at[0] : at[-1]], at - at[0]) if len(column) else (raw[:0], np.zeros(1, np.int64))


def slices(batches: Iterable[pa.RecordBatch], rows: int, column: int | None = None, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows and, of a string or binary column, so many bytes (one row at least)."""
    for batch in batches:
        ends = None if column is None else np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        k = 0
        while k < batch.num_rows:
            e = min(batch.num_rows, k + rows)
            if ends is not None:
                e = min(e, max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + size, "right"))))
            yield batch.slice(k, e - k)
            k = e


def bucket_of(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


def excerpt(text: Column, chars: int, parts: int = 8) -> Column:
    """A text of at most so many code points whole; of a longer one so many parts of equal length, evenly spread, a line each."""
    size = chars // parts
    room = F.length(text) - size
    cuts = [F.substring(text, (F.floor(room * k / (parts - 1)) + 1).cast("int"), F.lit(size)) for k in range(parts)]
    return F.when(F.length(text) <= chars, text).otherwise(F.concat_ws("\n", *cuts))


def sampled(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """At most `most` of the rows, those with the smallest hash of key; all rows, if there are no more.

    Rows over a cut that lets about 1.3 times as many through are dropped where they are read, so that what is gathered
    doesn't grow with the table. Where equal keys leave too few under the cut, the cut is raised.
    """
    n = rows.count()
    h, full = F.xxhash64(key, F.lit("sample")), 1 << 40
    share = min(1.0, (1.3 * most + 60) / max(1, n))
    while True:
        held = rows.where(F.pmod(h, F.lit(full)) < int(share * full)) if share < 1 else rows
        if share >= 1 or held.count() >= min(n, most):
            return held.orderBy(h).limit(most)
        share = min(1.0, 16 * share)


def learnt(rows: DataFrame, train: Callable[[list[dict]], bytes | None]) -> bytes | None:
    """What train() makes of the rows, a sample of bounded size, in one task of the cluster; the driver only gets its bytes.

    Rows come in one order whatever their partitions. No rows: None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: [str(x) for x in r.values()])
        made = train(held) if held else None
        del held
        release()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(found[0][0]) if found and found[0][0] is not None else None
