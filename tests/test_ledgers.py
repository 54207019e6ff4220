"""The ledger as a stream against the same of a whole table, and slots that are computed again only when they change."""

import datetime
import os
import random
import shutil


from pyspark.sql import functions as F

from strataframe.operators import metrics as M
from strataframe.operators.metrics import Metric
from strataframe.operators.slots import SlotStore
from strataframe.streaming import ledgers, windows

T0 = datetime.datetime(2024, 5, 1)
SCHEMA = "pile int, at timestamp, kind string, amount double"


def test_settling_by_hand():
    lots = []
    h = 3_600_000
    got = ledgers.settle(lots, [(0, 0, 5.0), (10, 0, 5.0), (20, 1, 3.0), (h, 1, 4.0), (h + 5, 0, 2.0), (2 * h - 1, 1, 7.0), (2 * h, 1, 1.5)], h)
    assert got == [(None, 20, 3.0), (0, h, 4.0), (0, 2 * h - 1, 6.0), (None, 2 * h - 1, 1.0), (h, 2 * h, 1.5)] and lots == [[h, 0.5]]


def test_a_stream_equals_the_table(spark, tmp_path):
    rng = random.Random(7)
    events = []
    for i in range(900):
        at = T0 + datetime.timedelta(minutes=i * 2, seconds=rng.randrange(60))
        events.append((rng.randrange(4), at, rng.choice(["receipt", "receipt", "draw"]), round(rng.uniform(0.5, 9), 2)))
    events += [events[5], (None, T0, "receipt", 1.0), (1, None, "draw", 1.0), (1, T0, "draw", -4.0), (1, T0, "other", 4.0)]
    order = sorted(range(len(events)), key=lambda i: ((events[i][1] or T0) + datetime.timedelta(minutes=rng.randrange(90))))
    for k in range(6):
        part = [events[i] for i in order[k * len(order) // 6 : (k + 1) * len(order) // 6]]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = [(p, T0 + datetime.timedelta(days=9), "receipt", 1.0) for p in range(4)]
    spark.createDataFrame(end, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
    got = windows.run_to_table(ledgers.released_ledger(stream, late="4 hours"))
    want = ledgers.settled(spark.createDataFrame(events, SCHEMA))
    key = lambda r: (r["pile"], str(r["lot"]), str(r["draw"]), round(r["amount"], 6))
    rows = sorted(map(key, want.collect()))
    assert sorted(map(key, got.collect())) == rows and len(rows) > 200
    assert {r[1] for r in rows} > {"None"} and want.where("lot IS NOT NULL AND draw < lot + INTERVAL 1 HOUR").count() == 0


def test_none(spark):
    assert ledgers.settled(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_unchanged_slot_is_not_read(spark, tmp_path):
    path, folder = str(tmp_path / "rows"), str(tmp_path / "kept")
    rows = spark.createDataFrame([(s, c, float(10 * s + i)) for s in range(4) for c in "ab" for i in range(5)], "slot int, cat string, v double")
    rows.coalesce(1).write.partitionBy("slot").parquet(path)
    metrics = [Metric("total", "sum", "v"), Metric("mean", "weighted", "v", "v")]
    store = SlotStore(spark, folder, metrics, ["cat"])
    want = lambda *keys: {tuple(r) for r in M.totals(spark.read.parquet(path).withColumn("slot", F.col("slot").cast("string")), metrics, list(keys)).collect()}
    got = lambda r, *keys: {tuple(x) for x in store.figures(r, list(keys)).collect()}
    first = store.refresh(path)
    assert first.changed == ["0", "1", "2", "3"] and got(first, "slot", "cat") == want("slot", "cat") and got(first, "cat") == want("cat")
    again = store.refresh(path)
    before = want("slot", "cat")
    assert again.changed == [] and got(again, "slot", "cat") == before
    # slot 1 gets rows, slot 3 goes, and slot 0's file is spoilt without a trace: it isn't opened
    spark.createDataFrame([("c", 7.0)], "cat string, v double").coalesce(1).write.mode("append").parquet(f"{path}/slot=1")
    shutil.rmtree(f"{path}/slot=3")
    file = next((tmp_path / "rows" / "slot=0").glob("*.parquet"))
    at, size = file.stat(), file.stat().st_size
    file.write_bytes(b"x" * size)
    os.utime(file, ns=(at.st_atime_ns, at.st_mtime_ns))
    last = store.refresh(path)
    assert last.changed == ["1"]
    rows = got(last, "slot", "cat")
    assert {r for r in rows if r[0] in "02"} == {r for r in before if r[0] in "02"} and {r[0] for r in rows} == {"0", "1", "2"}
    assert {r[:3] for r in rows if r[1] == "c"} == {("1", "c", 7.0)}
    assert {tuple(r) for r in last.partials.select("slot", "origin").distinct().collect()} == {("0", "kept"), ("1", "new"), ("2", "kept")}
