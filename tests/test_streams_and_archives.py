"""Archives read in parts, counts while writing, the vote as a stream, and the expectation of a vote against all draws."""

import json
import random
import zipfile
from datetime import datetime, timedelta
from itertools import combinations

import pytest

from martwright.operators import metrics
from martwright.sources import archives, filings
from martwright.streaming import votes
from pyspark.sql import functions as F


@pytest.fixture
def folder(tmp_path):
    rng, rows = random.Random(1), {}
    for quarter, kind, n in (("2024q3", zipfile.ZIP_DEFLATED, 9000), ("2024q4", zipfile.ZIP_STORED, 5000), ("2025q1", zipfile.ZIP_DEFLATED, 0)):
        own = [(f"{quarter}-{k}", rng.choice(["é", 'a "quote', "", "日本語" * rng.randrange(9)]), str(k)) for k in range(n)]
        text = "adsh\ttag\tvalue\n" + "".join("\t".join(r) + ("\r\n" if k % 3 else "\n") for k, r in enumerate(own))
        with zipfile.ZipFile(tmp_path / f"{quarter}.zip", "w", kind) as z:
            z.writestr("num.txt", text)
            z.writestr("sub.txt", "adsh\n")
        rows[quarter] = own
    (tmp_path / "other.txt").write_text("no archive")
    return tmp_path, rows


@pytest.mark.parametrize("part", [20_000, 33_333, 10**9])
def test_members_are_read_in_parts(spark, folder, part):
    path, rows = folder
    df = filings.members(spark, str(path), "num.txt", ["value", "adsh", "missing", "tag"], part)
    assert (df.rdd.getNumPartitions() >= 8) == (part < 10**6)
    got = sorted((r.adsh, r.tag, r.value, r.quarter, r.missing) for r in df.collect())
    assert got == sorted((a, t, v, q, None) for q, own in rows.items() for a, t, v in own)
    if part < 10**6:
        one = path / "2024q3.zip"
        assert filings.members(spark, f"file://{one}", "num.txt", ["adsh"], part).select(F.spark_partition_id()).distinct().count() >= 4


def test_every_cut_reads_each_line_once(tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m", "a\tb\n1\t2\n\n33\n4\té\nlast\t5")
    for size in range(1, 30):
        reader = archives.ZipReader(str(tmp_path), "m", ["b", "a"], size)
        got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert got == [("2", "1"), (None, ""), (None, "33"), ("é", "4"), ("5", "last")]


def test_quarters_that_are_not_asked_for_stay_closed(spark, folder):
    path, rows = folder
    df = filings.members(spark, str(path), "num.txt", ["adsh"], 20_000)
    one = filings.members(spark, str(path), "num.txt", ["adsh"], 20_000, only=["2024q4", "2031q1"])
    assert one.rdd.getNumPartitions() <= df.rdd.getNumPartitions() // 2 and {r.quarter for r in one.collect()} == {"2024q4"}
    assert one.count() == len(rows["2024q4"]) == df.where("quarter = '2024q4'").count()
    with pytest.raises(Exception, match="strings"):
        spark.read.format("zip_member").schema("adsh int").option("member", "num.txt").load(str(path)).collect()


def test_ingest_counts_while_it_writes(spark, tmp_path):
    raw = spark.range(1000).selectExpr("CASE WHEN id % 10 = 0 THEN '' WHEN id % 10 = 1 THEN 'n/a' ELSE string(id) END AS value", "'4' AS qtrs", "id % 3 AS quarter").repartition(5)
    raw.write.parquet(str(tmp_path / "raw"))
    typed = filings.typed_num(spark.read.parquet(str(tmp_path / "raw")))
    for _ in range(2):
        got = filings.ingest(typed, str(tmp_path / "out"))
        assert got == filings.stats(typed).first().asDict()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 900


T0 = datetime(2024, 1, 1)


def feed(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps({"request": r, "idx": i, "asked": n, "key": k, "reason_code": c, "at": (T0 + timedelta(seconds=s)).isoformat()}) for r, i, n, k, c, s in rows))


def test_the_vote_settles_as_the_log_grows(spark, tmp_path):
    log, out, checkpoint = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run() -> dict:
        stream = spark.readStream.schema(votes.CANDIDATE).json(str(log))
        votes.keep_settling(stream, out, checkpoint, late="10 seconds", timeout_s=60, keep_s=300).awaitTermination()
        rows = [tuple(r)[:7] for r in spark.read.schema(votes.SETTLED).parquet(f"{out}/*").collect()]
        assert len({r[0] for r in rows}) == len(rows)  # settled once
        return {r[0]: r[1:] for r in rows}

    feed(log, "a", [("whole", 0, 3, "x", None, 0), ("whole", 2, 3, "x", None, 2), ("whole", 0, 3, "other", None, 3), ("late", 1, 3, "y", None, 1), ("never", 4, 5, None, "EXEC_ERROR", 1), ("never", 1, 5, None, "COST_LIMIT", 1), (None, 0, 1, "x", None, 0)])
    assert run() == {}
    feed(log, "b", [("whole", 1, 3, "y", None, 20), ("late", 0, 3, "z", None, 20)])
    first = run()
    assert first == {"whole": (0, pytest.approx(2 / 3), None, 3, 3, "complete")}
    feed(log, "c", [("clock", 0, 1, "x", None, 200)])
    second = run()
    assert second == first | {"clock": (0, 1.0, None, 1, 1, "complete"), "late": (0, pytest.approx(1 / 3), None, 2, 3, "timeout"), "never": (None, 0.0, "COST_LIMIT", 2, 5, "timeout")}
    feed(log, "d", [("late", 2, 3, "y", None, 195), ("whole", 1, 3, "y", None, 196)])  # settled already
    assert run() == second


def test_plurality_chance_by_all_draws():
    rng = random.Random(9)
    for _ in range(60):
        keys = [rng.choice(["a", "b", "c", None]) for _ in range(rng.randrange(1, 8))]
        right = {k: rng.random() < 0.5 for k in "abc"}
        for k in (1, 2, 3, 5):
            won = []
            for draw in combinations(keys, min(k, len(keys))):
                count = {x: draw.count(x) for x in draw if x is not None}
                best = [x for x in count if count[x] == max(count.values())]
                won.append(sum(right[x] for x in best) / len(best) if best else 0.0)
            named = sorted({x for x in keys if x})
            got = metrics.plurality_chance([keys.count(x) for x in named], [right[x] for x in named], keys.count(None), k)
            assert got == pytest.approx(sum(won) / len(won))
    assert metrics.plurality_chance([], [], 0, 3) == 0.0
