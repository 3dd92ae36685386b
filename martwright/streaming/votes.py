"""The vote over a log of candidates as it grows: a request is settled when all its candidates are in, or when it times out.

Each candidate comes as a record of its own, in any order, some twice, some never. State is kept per request: its candidates
by their number, and after the vote only that it is settled, so that what comes later changes nothing; a second timer then
drops even that. Timers go by the watermark of the candidates' own times, so a replay settles alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle

CANDIDATE = "request string, idx int, asked int, key string, reason_code string, at timestamp"
SETTLED = "request string, winner_idx int, agreement double, reason string, seen int, asked int, how string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # the one that keeps maps and timers


def plurality(held: dict[int, tuple[str | None, str | None]], asked: int) -> tuple[int | None, float, str | None]:
    """(winner, agreement, reason) as operators.voting.vote() has them; those that never came count as asked for."""
    keys = Counter(k for k, _ in held.values() if k is not None)
    if not keys:
        named = Counter(r for _, r in held.values() if r)
        first = {r: min(i for i, (_, x) in held.items() if x == r) for r in named}
        return None, 0.0, max(named, key=lambda r: (r != "EXEC_ERROR", named[r], -first[r]), default="EXEC_ERROR")
    first_of = {k: min(i for i, (x, _) in held.items() if x == k) for k in keys}
    best = max(keys, key=lambda k: (keys[k], -first_of[k]))
    return first_of[best], keys[best] / max(asked, len(held)), None


class Settling(StatefulProcessor):
    def __init__(self, timeout_ms: int, keep_ms: int) -> None:
        self.timeout_ms, self.keep_ms = timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.candidates = handle.getMapState("candidates", "idx int", "key string, reason string")
        self.request = handle.getValueState("request", "asked int, settled boolean")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked, settled = self.request.get() if self.request.exists() else (0, False)
        known, begun = asked, None
        for df in rows:
            if settled:
                continue
            for idx, n, k, r, at in df[["idx", "asked", "key", "reason_code", "at"]].itertuples(index=False):
                asked = max(asked, int(n))
                begun = at if begun is None or at < begun else begun
                if not self.candidates.containsKey((int(idx),)):  # the first of a number counts
                    self.candidates.updateValue((int(idx),), (k, r))
        if settled or begun is None:
            return
        if not known:
            self.handle.registerTimer(int(begun.timestamp() * 1000) + self.timeout_ms)
        self.request.update((asked, False))
        held = {i: (k, r) for (i,), (k, r) in self.candidates.iterator()}
        if len(held) >= asked:
            yield self.settle(key[0], held, asked, "complete", int(begun.timestamp() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        asked, settled = self.request.get() if self.request.exists() else (0, True)
        if settled:
            self.request.clear()
            return
        held = {i: (k, r) for (i,), (k, r) in self.candidates.iterator()}
        yield self.settle(key[0], held, asked, "timeout", expiredTimerInfo.getExpiryTimeInMs())

    def settle(self, request: str, held: dict, asked: int, how: str, now: int) -> pd.DataFrame:
        winner, agreement, reason = plurality(held, asked)
        self.candidates.clear()
        self.request.update((asked, True))
        self.handle.registerTimer(now + self.timeout_ms + self.keep_ms)
        row = {"request": request, "winner_idx": winner, "agreement": agreement, "reason": reason, "seen": len(held), "asked": asked, "how": how}
        return pd.DataFrame([row]).astype({"winner_idx": "Int32", "seen": "int32", "asked": "int32"})


def settled(candidates: DataFrame, late: str = "1 minute", timeout_s: int = 60, keep_s: int = 600) -> DataFrame:
    """A row for each request of a stream of candidates (see CANDIDATE), when it is settled. Rows without a request, number or time are left out."""
    live = candidates.where("request is not null and idx is not null and at is not null").withColumn("asked", F.coalesce("asked", F.lit(1)))
    return live.withWatermark("at", late).groupBy("request").transformWithStateInPandas(Settling(timeout_s * 1000, keep_s * 1000), SETTLED, "Append", "EventTime")


def keep_settling(candidates: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Writes what is settled from all that has come so far, then stops. A batch that is tried again replaces what it wrote."""
    spark = candidates.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return settled(candidates, **options).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
