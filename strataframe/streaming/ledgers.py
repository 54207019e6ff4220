"""A stockpile ledger as a stream: receipts make lots that are released when their interval ends, and draws take the oldest first."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Less than this is dust and goes with the draw that leaves it.
DUST = 1e-9
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settle(lots: list[list], events: list[tuple], every: int) -> list[tuple]:
    """Work through events (at, kind, amount) in order on lots [start of interval, tonnes]; returns (lot, draw, tonnes).

    at is in milliseconds; kind 0 receives, 1 draws. A receipt joins the lot of its interval, which is released at the
    interval's end. A draw takes released lots, oldest first; what it doesn't find is a row without a lot.
    """
    out = []
    for at, kind, amount in sorted(events):
        if kind == 0:
            start = at - at % every
            held = next((x for x in lots if x[0] == start), None)
            if held:
                held[1] += amount
            else:
                lots.append([start, amount])
                lots.sort()
            continue
        while amount > DUST and lots and lots[0][0] + every <= at:
            start, left = lots[0]
            take = left if left - min(amount, left) <= DUST else amount
            out.append((start, at, take))
            if take == left:
                lots.pop(0)
            else:
                lots[0][1] = left - take
            amount -= take
        if amount > DUST:
            out.append((None, at, amount))
    return out


class Ledger(StatefulProcessor):
    """State of one pile: events that may still be joined by earlier ones, and lots. A timer at each interval's end settles what is final."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, kind int, amount double")
        self.lots = handle.getListState("lots", "start long, amount double")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        ends = set()
        for pdf in rows:
            self.waiting.appendList([(int(a), int(k), float(x)) for a, k, x in zip(pdf["ms"], pdf["kind"], pdf["amount"], strict=True)])
            ends |= {(int(a) // self.every + 1) * self.every for a in pdf["ms"]}
        for end in ends:
            self.handle.registerTimer(end)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        # all events before the watermark are there; they are settled up to the last whole interval, once
        final = timerValues.getCurrentWatermarkInMs() // self.every * self.every
        events = [tuple(r) for r in self.waiting.get()]
        now, later = [e for e in events if e[0] < final], [e for e in events if e[0] >= final]
        if now:
            lots = [list(r) for r in self.lots.get()]
            rows = settle(lots, now, self.every)
            for state, values in ((self.waiting, later), (self.lots, [tuple(x) for x in lots])):
                state.put(values) if values else state.clear()
            if rows:
                yield pd.DataFrame({"pile": [key[0]] * len(rows), "lot": pd.array([r[0] for r in rows], "Int64"), "draw": [r[1] for r in rows], "amount": [r[2] for r in rows]})

    def close(self) -> None:
        pass


def released_ledger(events: DataFrame, every_seconds: int = 3600, late: str = "2 hours") -> DataFrame:
    """(pile, lot, draw, amount) of a stream of events(pile, at timestamp, kind, amount): what each draw takes of each lot.

    kind is receipt or draw. A lot is what a pile receives in an interval, named by its start; it is released at the
    interval's end. Draws take released lots, the oldest first; a draw that finds too little has a row with a null lot
    for the rest. Events may come late by `late` and in any order: each pile's are kept in state, and settled in order
    of time (receipts before draws, then by amount) when a timer at an interval's end finds that the watermark has
    passed it. Amounts not over 0, and rows without a pile or a time, are left out. Equal events each count.

    State is the events of open intervals and the lots that are left. Needs the RocksDB state store, which is set here
    for the session.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = events.schema["pile"].dataType.simpleString()
    known = events.where("pile IS NOT NULL AND at IS NOT NULL AND kind IN ('receipt', 'draw') AND amount > 0").withWatermark("at", late)
    rows = known.select("pile", "at", F.unix_millis("at").alias("ms"), (F.col("kind") == "draw").cast("int").alias("kind"), F.col("amount").cast("double").alias("amount"))
    out = rows.groupBy("pile").transformWithStateInPandas(Ledger(every_seconds * 1000), f"pile {kind}, lot long, draw long, amount double", "Append", "EventTime")
    stamp = lambda c: F.timestamp_millis(c).alias(c)
    return out.select("pile", stamp("lot"), stamp("draw"), "amount")


def settled(events: DataFrame, every_seconds: int = 3600) -> DataFrame:
    """The same of a whole table: what the stream gives once all its intervals are over. A pile is one sequence; piles run in parallel."""
    every = every_seconds * 1000
    kind = events.schema["pile"].dataType.simpleString()
    known = events.where("pile IS NOT NULL AND at IS NOT NULL AND kind IN ('receipt', 'draw') AND amount > 0")
    rows = known.select("pile", F.unix_millis("at").alias("ms"), (F.col("kind") == "draw").cast("int").alias("kind"), F.col("amount").cast("double").alias("amount"))

    def run(key, pdf):
        import pandas as pd

        got = settle([], list(zip(pdf["ms"].tolist(), pdf["kind"].tolist(), pdf["amount"].tolist(), strict=True)), every)
        return pd.DataFrame({"pile": [key[0]] * len(got), "lot": pd.array([r[0] for r in got], "Int64"), "draw": [r[1] for r in got], "amount": [r[2] for r in got]})

    out = rows.groupBy("pile").applyInPandas(run, f"pile {kind}, lot long, draw long, amount double")
    stamp = lambda c: F.timestamp_millis(c).alias(c)
    return out.select("pile", stamp("lot"), stamp("draw"), "amount")
