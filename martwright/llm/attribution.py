"""Click-to-sale attribution as a stateful stream, its clicks held in pages of a day.

Clicks and sales arrive in batches. Each batch has a watermark W: the smaller of the largest click time and the largest sale
time of earlier batches, less DELAY. A sale waits until W has passed it, and then takes its client's latest click (ties to
the smaller id) of the LOOK_BACK before it, and their number.

State is kept for buckets of clients in three MapStates keyed by day. A page holds a day's clicks, sorted by client, time
and id, a summary each client's count and last click of that day, and a third map the sales that wait. The window of a sale
spans eight days: the six inner ones are answered from summaries, and only the two pages at its ends are searched. All due
sales of a day are answered together, as arrays. Clicks older than W - LOOK_BACK can't be in any later window; a page goes,
whole, when its day is.

A client with many rows is dealt over k x k cells of as many different buckets: a click goes to the k cells of its part, a
sale to one cell of every part, and the partial answers are added up afterwards. k grows with the root of the client's share
of all rows, so each row is copied at most sqrt(buckets) times.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .common import bucket_of, discard, shared_dir, stash

DAY = 86_400_000_000  # microseconds, as all times here
LOOK_BACK, DELAY = 7 * DAY, 6 * DAY // 24
NEVER, ALWAYS = -(1 << 63), (1 << 63) - 1  # watermarks before both streams have begun and after their end
CLICK, SALE, TICK = 0, 1, 2
BUCKETS, BUCKET_ROWS = 64, 50_000  # at least so many buckets, and about so many rows of a bucket in a batch
EVENT = "kind int, client long, t long, id long, row long, split boolean, bucket int"
FOUND = "row long, sale_id long, batch int, late boolean, split boolean, n long, last_t long, last_id long"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store sets 4 MB of disk aside at every start
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a start's stores aren't used again: the next one opens its own
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def micros(name: str, df: DataFrame) -> Column:
    """A timestamp as microseconds since 1970; one without a zone is taken as UTC."""
    c = F.col(name)
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    return F.unix_date(c.cast("date")).cast("long") * DAY + F.hour(c).cast("long") * (DAY // 24) + F.minute(c).cast("long") * (DAY // 1440) + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def _array(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def page_of(client: np.ndarray, t: np.ndarray, click: np.ndarray) -> tuple[np.ndarray, ...]:
    """(owner, start, t, id): clicks sorted by client, time and descending id; start has one more entry than owner."""
    order = np.lexsort((~click, t, client))
    client, t, click = client[order], t[order], click[order]
    owner, start = np.unique(client, return_index=True)
    return owner, np.append(start, len(client)), t, click


def within(page: tuple[np.ndarray, ...], day: int, client: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each asked (client, low, high): how many of the client's clicks lie in [low, high], and the last one's place in the page."""
    owner, start, t, _ = page
    who = np.minimum(np.searchsorted(owner, client), len(owner) - 1)
    place = np.repeat(np.arange(len(owner)), np.diff(start)) * DAY + (t - day * DAY)  # sorted: by client, then time
    a = np.searchsorted(place, who * DAY + np.clip(low - day * DAY, 0, DAY), "left")
    b = np.searchsorted(place, who * DAY + np.clip(high - day * DAY, -1, DAY - 1), "right")
    return np.where(owner[who] == client, np.maximum(0, b - a), 0), b - 1


class Attribution(StatefulProcessor):
    """One bucket's state; a batch's rows hold one TICK, whose t is the batch's watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "day int", "owner binary, start binary, t binary, id binary")
        self.summaries = handle.getMapState("summaries", "day int", "owner binary, n binary, t binary, id binary")
        self.waiting = handle.getMapState("waiting", "day int", "client binary, t binary, id binary, row binary, split binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [[df[c].to_numpy() for c in ("kind", "client", "t", "id", "row", "split", "batch")] for df in rows]
        kind, client, t, number, row, split, batch = (np.concatenate(x) for x in zip(*held, strict=True))
        w, now = int(t[kind == TICK].max()), int(batch.max())
        live = (kind == CLICK) & (t >= w)
        self.add(client[live], t[live], number[live])
        late, wait = (kind == SALE) & (t < w), (kind == SALE) & (t >= w)
        if late.any():
            none = np.zeros(late.sum(), np.int64)
            yield self.out(row[late], number[late], split[late], now, True, none, none, none)
        self.put(client[wait], t[wait], number[wait], row[wait], split[wait].astype(np.int64))
        yield from self.due(w, now)
        if NEVER < w < ALWAYS:
            for (day,) in list(self.pages.keys()):
                if (day + 1) * DAY <= w - LOOK_BACK:
                    self.pages.removeKey((day,))
                    self.summaries.removeKey((day,))

    @staticmethod
    def out(row, sale, split, batch, late, n, t, click) -> pd.DataFrame:
        return pd.DataFrame({"row": row, "sale_id": sale, "batch": np.full(len(row), batch, np.int32), "late": late, "split": split.astype(bool), "n": n, "last_t": t, "last_id": click})

    def add(self, client: np.ndarray, t: np.ndarray, click: np.ndarray) -> None:
        days = t // DAY
        for day in np.unique(days).tolist():
            mine = days == day
            new = [client[mine], t[mine], click[mine]]
            old = self.pages.getValue((day,))
            if old:
                owner, start, *rest = map(_array, old)
                new = [np.concatenate(x) for x in zip([np.repeat(owner, np.diff(start)), *rest], new, strict=True)]
            owner, start, ts, ids = page_of(*new)
            self.pages.updateValue((day,), (owner.tobytes(), start.tobytes(), ts.tobytes(), ids.tobytes()))
            last = start[1:] - 1
            self.summaries.updateValue((day,), (owner.tobytes(), np.diff(start).tobytes(), ts[last].tobytes(), ids[last].tobytes()))

    def put(self, *columns: np.ndarray) -> None:
        days = columns[1] // DAY
        for day in np.unique(days).tolist():
            new = [c[days == day] for c in columns]
            old = self.waiting.getValue((day,))
            if old:
                new = [np.concatenate([_array(a), b]) for a, b in zip(old, new, strict=True)]
            self.waiting.updateValue((day,), tuple(c.tobytes() for c in new))

    def due(self, w: int, batch: int) -> Iterator[pd.DataFrame]:
        for (day,) in sorted(self.waiting.keys()):
            if day * DAY >= w:
                break
            held = [_array(x) for x in self.waiting.getValue((day,))]
            ready = held[1] < w
            if ready.all():
                self.waiting.removeKey((day,))
            else:
                self.waiting.updateValue((day,), tuple(c[~ready].tobytes() for c in held))
            client, t, sale, row, split = (c[ready] for c in held)
            if len(t):
                yield self.out(row, sale, split, batch, False, *self.answer(day, client, t))

    def answer(self, day: int, client: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, last time, last id) for sales of one day, from the oldest day of their windows to the newest."""
        n, last_t, last_id = (np.zeros(len(t), np.int64) for _ in range(3))
        back = LOOK_BACK // DAY
        for d in range(day - back, day + 1):
            if d in (day - back, day):
                held = self.pages.getValue((d,))
                if not held:
                    continue
                page = tuple(map(_array, held))
                count, at = within(page, d, client, t - LOOK_BACK, t)
                ts, ids = page[2], page[3]
            else:
                held = self.summaries.getValue((d,))
                if not held:
                    continue
                owner, many, ts, ids = map(_array, held)
                at = np.minimum(np.searchsorted(owner, client), len(owner) - 1)
                count = np.where(owner[at] == client, many[at], 0)
            hit = count > 0
            n += count
            last_t[hit], last_id[hit] = ts[at[hit]], ids[at[hit]]
        return n, last_t, last_id


def events(clicks: DataFrame, sales: DataFrame) -> DataFrame:
    """(kind, client, t, id, row, arrived) of the rows that count, as a table: one for each click id, the earliest by arrival, time and client; none whose client or time is null.

    Without an arrival a row arrives at its own time. row: a number of its own for each sale row.
    """
    def columns(df: DataFrame, kind: int, number: str, time: str) -> DataFrame:
        late = F.when(bucket_of(number, 4) == 0, 240).otherwise(0)
        t = micros(time, df)
        hour = F.floor(F.coalesce(micros("arrived_at", df), t) / (DAY // 24)) + late
        return df.select(F.lit(kind).alias("kind"), F.col("client_id").cast("long").alias("client"), t.alias("t"), F.col(number).cast("long").alias("id"), hour.alias("arrived")).where("client is not null and t is not null")

    own = columns(clicks, CLICK, "click_id", "ts").groupBy("id").agg(F.min(F.struct("arrived", "t", "client")).alias("least"))
    own = own.select(F.lit(CLICK).alias("kind"), "least.client", "least.t", "id", "least.arrived")
    both = own.unionByName(columns(sales, SALE, "sale_id", "sold_at"))
    return stash(both.withColumn("row", F.monotonically_increasing_id()), "events")


def watermarks(rows: DataFrame, batches: int) -> list[int]:
    """W of each batch; ALWAYS for the end of the stream."""
    most = {r["batch"]: (r["c"], r["s"]) for r in rows.groupBy("batch").agg(F.max(F.when(F.col("kind") == CLICK, F.col("t"))).alias("c"), F.max(F.when(F.col("kind") == SALE, F.col("t"))).alias("s")).collect()}  # a row a batch
    out, seen = [], [None, None]
    for b in range(batches):
        out.append(min(seen) - DELAY if None not in seen else NEVER)
        seen = [max((x for x in (a, m) if x is not None), default=None) for a, m in zip(seen, most.get(b, (None, None)), strict=True)]
    return [*out, ALWAYS]


def dealt(rows: DataFrame, buckets: int, total: int) -> DataFrame:
    """rows with their bucket; rows of a client with over 1 / (2 * buckets) of all of them are copied to the cells they belong to.

    There are fewer than 2 * buckets such clients, so their table is broadcast.
    """
    counts = rows.groupBy("client").agg(F.count("*").alias("_n")).where(F.col("_n") * 2 * buckets > total)
    side = F.least(F.lit(int(buckets**0.5)), F.ceil(F.sqrt(F.col("_n") * F.lit(2.0 * buckets / max(1, total)))).cast("int"))
    hot = counts.select(F.col("client").alias("_client"), side.alias("_k"))
    k = F.coalesce(F.col("_k"), F.lit(1))
    own = F.pmod(F.xxhash64("id", "row"), k).cast("int")
    first = F.pmod(F.xxhash64("client"), F.lit(buckets)).cast("int")
    cells = F.transform(F.sequence(F.lit(0), k - 1), lambda x: F.pmod(first + F.when(F.col("kind") == CLICK, own * k + x).otherwise(x * k + own), F.lit(buckets)))
    joined = rows.join(F.broadcast(hot), F.col("client") == F.col("_client"), "left")
    return joined.select("kind", "client", "t", "id", "row", (k > 1).alias("split"), F.explode(cells).alias("bucket"), "batch")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def streamed(spark: SparkSession, staged: str, at: str, batches: int) -> str:
    """Feeds the staged batches (folders batch=0, 1, ...) in order to the stateful query, which starts anew for each on one checkpoint; gives the folder of its answers."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{at}/feed"))
    for b in range(batches):
        if not fs.rename(path(f"{staged}/batch={b}"), path(f"{at}/feed/batch={b}")):
            raise OSError(f"batch {b} can't be moved to the feed")
        feed = spark.readStream.schema(f"{EVENT}, batch int").parquet(f"{at}/feed")
        answers = feed.groupBy("bucket").transformWithStateInPandas(Attribution(), FOUND, "Append", "None")
        run = answers.writeStream.format("parquet").option("path", f"{at}/found").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    fs.delete(path(f"{at}/feed"), True)
    fs.delete(path(f"{at}/checkpoint"), True)
    return f"{at}/found"


def attribute(clicks: DataFrame, sales: DataFrame, batches: int = 12, buckets: int | None = None) -> DataFrame:
    """(sale_id, batch, late, click_id, n_clicks), one row for each sale row with a client and a time.

    Batches are cut by the hours of arrival (see events()); sales outside the clicks' hours are in the first or last batch.
    A batch without rows, and every bucket in it, still gets its watermark. Repeated sale rows each give a row; repeated
    click ids count once. Empty tables: no clicks, then sales are all closed at the end with none; no sales, no rows.
    Further columns are ignored, whatever their names. Only counts, extremes and a row a batch come to the driver.
    """
    spark = clicks.sparkSession
    rows = events(clicks, sales)
    total, low, high = rows.agg(F.count("*"), F.min(F.when(F.col("kind") == CLICK, F.col("arrived"))), F.max(F.when(F.col("kind") == CLICK, F.col("arrived")))).first()
    low, high = (0, 0) if low is None else (low, high)
    cut = F.floor(F.lit(batches) * (F.col("arrived") - low) / F.lit(high - low + 1))
    rows_in = rows.withColumn("batch", F.least(F.greatest(cut, F.lit(0)), F.lit(batches - 1)).cast("int"))
    buckets = buckets or max(BUCKETS, -(-total // (batches * BUCKET_ROWS)))
    w = F.array(*(F.lit(x) for x in watermarks(rows_in, batches)))
    batch = (F.col("id") % (batches + 1)).cast("int")
    zero = F.lit(0).cast("long")
    ticks = spark.range((batches + 1) * buckets).select(F.lit(TICK).alias("kind"), zero.alias("client"), F.get(w, batch).alias("t"), zero.alias("id"), zero.alias("row"), F.lit(False).alias("split"), F.floor(F.col("id") / (batches + 1)).cast("int").alias("bucket"), batch.alias("batch"))
    at = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/attribution-{uuid.uuid4().hex}"
    files = max(4, buckets // 16)
    spread = dealt(rows_in, buckets, total).unionByName(ticks).withColumn("_file", F.pmod("bucket", F.lit(files)))
    spread.repartition("batch", "_file").drop("_file").write.partitionBy("batch").parquet(f"{at}/staged")
    discard(rows)
    with settings(spark, SETTINGS):
        found = spark.read.schema(FOUND).parquet(streamed(spark, f"{at}/staged", at, batches + 1))
    held = spark._jvm.org.apache.hadoop.fs.Path(at)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(held)
    last = F.when(F.col("n") > 0, F.struct("last_t", F.bitwise_not("last_id").alias("order")))
    parts = found.where("split").groupBy("row", "sale_id", "batch", "late").agg(F.sum("n").alias("n_clicks"), F.max(last).alias("last"))
    parts = parts.select("sale_id", "batch", "late", F.bitwise_not("last.order").alias("click_id"), "n_clicks")
    whole = found.where(~F.col("split")).select("sale_id", "batch", "late", F.when(F.col("n") > 0, F.col("last_id")).alias("click_id"), F.col("n").alias("n_clicks"))
    return whole.unionByName(parts)


def oracle(batches: int = 12) -> str:
    """The same in DuckDB's SQL, without any stream: each sale's closing batch follows from the watermarks."""

    def crc(number: str) -> str:
        step = "list_reduce(list_concat([xor(crc, c)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))"
        codes = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
        return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda crc, c: {step}), 4294967295)"

    def hour(number: str) -> str:
        return f"epoch_us(arrived_at) // {DAY // 24} + CASE WHEN {crc(number)} % 4 = 0 THEN 240 ELSE 0 END"

    return f"""
WITH c AS (SELECT click_id, min(client_id) AS client_id, epoch_us(min(ts)) AS t, min(h) AS h
  FROM (SELECT *, {hour("click_id")} AS h FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL) GROUP BY click_id),
x AS (SELECT min(h) AS lo, max(h) AS hi FROM c),
cb AS (SELECT c.*, CAST({batches} * (h - lo) // (hi - lo + 1) AS INTEGER) AS batch FROM c, x),
s AS (SELECT sale_id, client_id, epoch_us(sold_at) AS t, {hour("sale_id")} AS h FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
sb AS (SELECT s.*, CAST(least(greatest(CAST(floor({batches}.0 * (h - lo) / (hi - lo + 1)) AS BIGINT), 0), {batches - 1}) AS INTEGER) AS batch FROM s, x),
w AS (SELECT CAST(b AS INTEGER) AS batch, (SELECT max(t) FROM cb WHERE cb.batch < b) AS mc, (SELECT max(t) FROM sb WHERE sb.batch < b) AS ms FROM range({batches}) r(b)),
m AS (SELECT batch, CASE WHEN mc IS NOT NULL AND ms IS NOT NULL THEN least(mc, ms) - {DELAY} END AS w FROM w),
k AS (SELECT cb.* FROM cb JOIN m ON cb.batch = m.batch WHERE m.w IS NULL OR cb.t >= m.w),
e AS (SELECT sb.*, coalesce(sb.t < m.w, false) AS late,
  CASE WHEN sb.t < m.w THEN sb.batch ELSE coalesce((SELECT min(m2.batch) FROM m m2 WHERE m2.batch >= sb.batch AND m2.w > sb.t), {batches}) END AS closes
  FROM sb JOIN m ON sb.batch = m.batch)
SELECT e.sale_id, CAST(e.closes AS INTEGER) AS batch, e.late, arg_max(k.click_id, (k.t, -k.click_id)) AS click_id, count(k.click_id) AS n_clicks
FROM e LEFT JOIN k ON NOT e.late AND k.client_id = e.client_id AND k.batch <= e.closes AND k.t BETWEEN e.t - {LOOK_BACK} AND e.t
GROUP BY e.sale_id, e.closes, e.late"""
