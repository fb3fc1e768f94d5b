"""Structured Streaming: bounded logs, task states folded from attempt events, leases that expire, idempotent upserts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bounded(batch: DataFrame, most: int, order: str = "id", line: str = "line") -> DataFrame:
    """The newest ``most`` rows of a batch and, if any were dropped, one marker row (dropped = true, order null) with their number.

    The cut is found by one small aggregate of the order column; rows are not sorted together. Equal orders are cut together
    by the place of the last one kept, so the order should be unique."""
    newest = batch.select(order).orderBy(F.desc(order)).limit(most + 1)
    cut = newest.agg(F.when(F.count("*") > most, F.min(order)).alias("_cut"))
    joined = batch.crossJoin(F.broadcast(cut))  # one row
    kept = joined.where(F.col("_cut").isNull() | (F.col(order) > F.col("_cut"))).drop("_cut").withColumn("dropped", F.lit(False))
    lost = joined.where(F.col(order) <= F.col("_cut")).agg(F.count("*").alias("_n")).where("_n > 0")
    marker = lost.select(F.concat(F.lit("dropped "), F.col("_n").cast("string"), F.lit(" rows")).alias(line), F.lit(True).alias("dropped"))
    return kept.unionByName(marker, allowMissingColumns=True)


def log_sink(stream: DataFrame, path: str, checkpoint: str, most: int = 20_000, seconds: float = 0.2):
    """Appends each micro-batch, bounded, as Parquet under its batch id: a batch that runs again replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        bounded(batch, most).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The next snapshot: of each key the row of the highest version, new rows winning ties. Both sides have the same columns."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*old.columns), F.struct(F.col(version), F.col("_new"))).alias("_x"))
    return best.select("_x.*")


#: Which event moves a task from which states to which one.
MOVES = {
    "claim": (("queued",), "starting"), "begin": (("starting",), "running"), "succeed": (("running",), "succeeded"),
    "fail": (("starting", "running"), "failed"), "requeue": (("starting", "running", "failed"), "queued"), "cancel": (("queued", "starting", "running"), "cancelled"),
}


def next_state(status: str, attempt: int, event: str, event_attempt: int) -> tuple[str, int, bool]:
    """Status, attempt and whether the event took effect. Events of an attempt that is not the current one are stale."""
    froms, to = MOVES.get(event, ((), ""))
    if event_attempt != attempt or status not in froms:
        return status, attempt, False
    return to, attempt + (event == "requeue"), True


def task_states(events: DataFrame) -> DataFrame:
    """events: task_id long, attempt int, event string, id long. Per task and batch: task_id, status, attempt, applied, stale.

    Events of a batch are applied by id. A task starts as queued, attempt 1. Null events and attempts are stale."""
    import pandas as pd

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        status, attempt = state.get if state.exists else ("queued", 1)
        rows = pd.concat(list(frames)).sort_values("id")
        applied = 0
        for event, number in zip(rows["event"], rows["attempt"], strict=True):
            status, attempt, done = next_state(status, attempt, event, number)
            applied += done
        state.update((status, attempt))
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "attempt": [attempt], "applied": [applied], "stale": [len(rows) - applied]})

    return events.groupBy("task_id").applyInPandasWithState(
        fold, "task_id long, status string, attempt int, applied long, stale long", "status string, attempt int", "update", GroupStateTimeout.NoTimeout)


def leases(requests: DataFrame) -> DataFrame:
    """requests: endpoint string, owner string, at timestamp, ttl_s double, id long. Per request: endpoint, owner, id, granted, expires.

    A lease is granted if none is live at the request's time or the owner holds it (then it is renewed). Requests of a batch are taken by
    (at, id); a time before the last one counts as the last one, so the clock never runs back."""
    import pandas as pd

    def grant(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        holder, until, clock = state.get if state.exists else ("", 0.0, 0.0)
        out = []
        for r in pd.concat(list(frames)).sort_values(["at", "id"]).itertuples():
            clock = max(clock, r.at.timestamp())
            given = clock >= until or holder == r.owner
            if given:
                holder, until = r.owner, clock + r.ttl_s
            out.append((key[0], r.owner, r.id, given, until))
        state.update((holder, until, clock))
        yield pd.DataFrame(out, columns=["endpoint", "owner", "id", "granted", "expires"])

    return requests.groupBy("endpoint").applyInPandasWithState(
        grant, "endpoint string, owner string, id long, granted boolean, expires double", "holder string, until double, clock double", "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, lateness: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """events: ts timestamp, event_type. Counts by window and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select("window.start", "window.end", "event_type", "n")


def latest_by_key(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, for bounded groups in a batch."""
    w = Window.partitionBy(key).orderBy(*map(F.desc, order))
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
