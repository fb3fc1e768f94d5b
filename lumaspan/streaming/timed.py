"""Timed state: cooldowns with a deadline, probe results with a time to live, readmission of nodes.

Times are seconds of event time; the watermark is the clock. State is a register for each kind of change that keeps the latest by (time, id), so
late and repeated events change nothing that newer ones have set, and a stream ends where the batch forms end. Timers tell when a
deadline passes without an event. Events later than the watermark are dropped by Spark. Keys are spread by hash: a key's state is
one small row (for probe results a row for each target of a node).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: transformWithState needs this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["at", "id"])


class Cooling(StatefulProcessor):
    """An endpoint's last mark (bad for some seconds, or good) and its last lease or release."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pool", "mark_at double, mark_id long, deadline double, lease_at double, lease_id long, leased boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        mark_at, mark_id, deadline, lease_at, lease_id, leased = self.state.get() or (-1.0, -1, 0.0, -1.0, -1, False)
        for r in ordered(rows).itertuples():
            if r.kind in ("bad", "good") and (r.at, r.id) > (mark_at, mark_id):
                mark_at, mark_id, deadline = r.at, r.id, r.at + r.seconds if r.kind == "bad" and r.seconds > 0 else 0.0
            elif r.kind in ("lease", "release") and (r.at, r.id) > (lease_at, lease_id):
                lease_at, lease_id, leased = r.at, r.id, r.kind == "lease"
        self.state.update((mark_at, mark_id, deadline, lease_at, lease_id, leased))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        now = max(timerValues.getCurrentWatermarkInMs() / 1000, mark_at, lease_at)
        if deadline > now:
            self.handle.registerTimer(round(deadline * 1000))
        yield pd.DataFrame({"endpoint": [key[0]], "as_of": [now], "available": [not leased and deadline <= now]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        state = self.state.get()
        yield pd.DataFrame({"endpoint": [key[0]], "as_of": [state[2]], "available": [not state[5]]})

    def close(self) -> None:
        pass


def cooldowns(events: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """events: endpoint, kind (bad, good, lease, release), seconds double, ts timestamp, id long. Whenever it may change: endpoint, as_of, available."""
    rows = events.withWatermark("ts", lateness).select("endpoint", "kind", F.coalesce("seconds", F.lit(0.0)).alias("seconds"), "id", "ts", seconds_of(F.col("ts")).alias("at"))
    return rows.groupBy("endpoint").transformWithStateInPandas(Cooling(), "endpoint string, as_of double, available boolean", "update", "eventTime")


def seconds_of(ts: Column) -> Column:
    return F.unix_micros(ts) / 1_000_000


def last(df: DataFrame, key: str, kinds: list[str], *columns: str) -> DataFrame:
    """Of the events of some kinds, the latest of each key."""
    return df.where(F.col("kind").isin(kinds)).groupBy(key).agg(F.max_by(F.struct("kind", *columns), F.struct("at", "id")).alias("_x")).select(key, "_x.*")


def pool_at(events: DataFrame, now: float) -> DataFrame:
    """The batch form: endpoint, available at a time."""
    rows = events.withColumn("at", seconds_of(F.col("ts"))).where(F.col("at") <= now)
    marks = last(rows, "endpoint", ["bad", "good"], "at", "seconds").select("endpoint", F.when((F.col("kind") == "bad") & (F.col("seconds") > 0), F.col("at") + F.col("seconds")).otherwise(0.0).alias("deadline"))
    held = last(rows, "endpoint", ["lease", "release"]).select("endpoint", (F.col("kind") == "lease").alias("leased"))
    free = ~F.coalesce("leased", F.lit(False)) & (F.coalesce("deadline", F.lit(0.0)) <= now)
    return rows.select("endpoint").distinct().join(marks, "endpoint", "left").join(held, "endpoint", "left").select("endpoint", free.alias("available"))


class Probes(StatefulProcessor):
    """A node's results by target, and its last fault, which ends the results of all targets before it."""

    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.fault = handle.getValueState("fault", "at double")
        self.results = handle.getMapState("results", "target string", "at double, id long, healthy boolean, live boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        fault = self.fault.get()[0] if self.fault.exists() else -1.0
        before = {k[0]: tuple(v) for k, v in self.results.iterator()}
        now_of = dict(before)
        for r in ordered(rows).itertuples():
            if r.kind == "fault":
                fault = max(fault, r.at)
            elif (r.at, r.id) > now_of.get(r.target, (-1.0, -1))[:2]:
                now_of[r.target] = (r.at, r.id, bool(r.healthy), False)
        clock = timerValues.getCurrentWatermarkInMs() / 1000
        out = []
        for target, (at, number, healthy, _) in now_of.items():
            live = healthy and at > fault and at + self.ttl > clock
            new = (at, number, healthy, live)
            if new != before.get(target):
                self.results.updateValue((target,), new)
                if live:
                    self.handle.registerTimer(round((at + self.ttl) * 1000))
                out.append((key[0], target, at, live))
        self.fault.update((fault,))
        yield pd.DataFrame(out, columns=["node", "target", "at", "live"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        clock = expiredTimerInfo.getExpiryTimeInMs() / 1000
        out = []
        for k, v in list(self.results.iterator()):
            at, number, healthy, live = v
            if live and at + self.ttl <= clock:
                self.results.updateValue(k, (at, number, healthy, False))
                out.append((key[0], k[0], at, False))
        yield pd.DataFrame(out, columns=["node", "target", "at", "live"])

    def close(self) -> None:
        pass


def probe_cache(events: DataFrame, ttl: float, lateness: str = "0 seconds") -> DataFrame:
    """events: node, kind (result, fault), target, healthy, ts, id. Whenever a result begins or ends: node, target, at, live.

    State is keyed by node, so that one fault reaches the results of all its targets; a timer ends each result after ``ttl`` seconds."""
    rows = events.withWatermark("ts", lateness).select("node", "kind", "target", F.coalesce("healthy", F.lit(False)).alias("healthy"), "id", "ts", seconds_of(F.col("ts")).alias("at"))
    return rows.groupBy("node").transformWithStateInPandas(Probes(ttl), "node string, target string, at double, live boolean", "update", "eventTime")


def probes_at(events: DataFrame, ttl: float, now: float) -> DataFrame:
    """The batch form: the node and target of each live result at a time. Targets of one node at least are usable."""
    rows = events.withColumn("at", seconds_of(F.col("ts"))).where(F.col("at") <= now)
    newest = rows.where("kind = 'result'").groupBy("node", "target").agg(F.max_by(F.struct("at", "healthy"), F.struct("at", "id")).alias("_x")).select("node", "target", "_x.*")
    bad = rows.where("kind = 'fault'").groupBy("node").agg(F.max("at").alias("_fault"))
    return newest.join(bad, "node", "left").where(F.col("healthy") & (F.col("at") + ttl > now) & (F.col("_fault").isNull() | (F.col("_fault") < F.col("at")))).select("node", "target")


class Readmission(StatefulProcessor):
    """A node's last report: healthy or not, and until when it is kept out."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("node", "at double, id long, healthy boolean, until double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        at, number, healthy, until = self.state.get() or (-1.0, -1, False, 0.0)
        for r in ordered(rows).itertuples():
            if (r.at, r.id) > (at, number):
                at, number, healthy, until = r.at, r.id, bool(r.healthy), r.until
        clock = max(at, timerValues.getCurrentWatermarkInMs() / 1000)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not healthy and 0 < until <= clock:
            healthy, until = True, 0.0
        elif not healthy and until > 0:
            self.handle.registerTimer(round(until * 1000))
        self.state.update((at, number, healthy, until))
        yield pd.DataFrame({"node": [key[0]], "as_of": [clock], "healthy": [healthy]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        at, number, _, until = self.state.get()
        self.state.update((at, number, True, 0.0))
        yield pd.DataFrame({"node": [key[0]], "as_of": [until], "healthy": [True]})

    def close(self) -> None:
        pass


def readmissions(events: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """events: node, healthy, until double (seconds; null or 0: no timed cooldown), ts, id. Whenever it may change: node, as_of, healthy.

    A node whose timed cooldown has passed is healthy again; one that never had one stays out until it is reported healthy."""
    rows = events.withWatermark("ts", lateness).select("node", F.coalesce("healthy", F.lit(False)).alias("healthy"), F.coalesce("until", F.lit(0.0)).alias("until"), "id", "ts", seconds_of(F.col("ts")).alias("at"))
    return rows.groupBy("node").transformWithStateInPandas(Readmission(), "node string, as_of double, healthy boolean", "update", "eventTime")
