"""Sinks that publish whole results or nothing: manifests, statistics by batch, and moves of files.

A result is written under a temporary name beside its target and renamed; a batch counts as done when its entry is in the ledger. A
batch that fails anywhere is run again by Spark under the same id: it finds what it left (a temporary folder is replaced, a published one is
kept) and goes on, so each batch is published once. Renames go through Spark's file system, so any shared store that has them will do.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


class Store:
    """Renames, listings and marks on the file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.at(path))

    def remove(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.at(old), self.at(new)):
            raise OSError(f"{old} could not be renamed to {new}")

    def mark(self, path: str) -> None:
        self.fs.create(self.at(path), True).close()

    def names(self, path: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.at(path))) if self.exists(path) else []


def finite(df: DataFrame) -> DataFrame:
    """The frame; reading a NaN or an infinite number of it is an error."""
    check = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{c} is not finite")).cast("double")).otherwise(F.col(c))
    return df.withColumns({f.name: check(f.name) for f in df.schema.fields if isinstance(f.dataType, FloatType | DoubleType)})


def manifest(df: DataFrame, path: str) -> None:
    """Compact JSON lines in UTF-8 under ``path``, all or nothing; an older manifest stays until the new one is whole."""
    store, new = Store(df.sparkSession, path), f"{path}.tmp-{uuid.uuid4().hex}"
    try:
        finite(df).write.option("ignoreNullFields", "false").json(new)
        old = f"{path}.old-{uuid.uuid4().hex}"
        if store.exists(path):
            store.rename(path, old)
        try:
            store.rename(new, path)
        except Exception:
            if store.exists(old):
                store.rename(old, path)
            raise
        store.remove(old)
    finally:
        store.remove(new)


def commit(batch: DataFrame, batch_id: int, path: str, write: Callable[[DataFrame, str], None], step: Callable[[str], None] = lambda _: None) -> bool:
    """Publishes a batch under path/batch=<id>; false if that was done before. ``step`` hears of each step (tests fail there)."""
    store, done = Store(batch.sparkSession, path), f"{path}/_ledger/{batch_id}"
    if store.exists(done):
        return False
    new, final = f"{path}/_tmp/{batch_id}", f"{path}/batch={batch_id}"
    if not store.exists(final):
        store.remove(new)
        step("begin")
        write(batch, new)
        step("written")
        store.rename(new, final)
    step("published")
    store.mark(done)
    step("committed")
    return True


def committed(spark: SparkSession, path: str) -> list[str]:
    """The folders of the batches that count."""
    store = Store(spark, path)
    return [f"{path}/batch={n}" for n in sorted(store.names(f"{path}/_ledger"), key=int)]


def stats_sink(stream: DataFrame, path: str, checkpoint: str, step: Callable[[str], None] = lambda _: None):
    """Appends the events of each batch as JSON lines, once each."""

    def put(batch: DataFrame, batch_id: int) -> None:
        Store(batch.sparkSession, path).fs.mkdirs(Store(batch.sparkSession, path).at(f"{path}/_tmp"))
        commit(batch, batch_id, path, lambda df, where: df.write.json(where), step)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def stats(spark: SparkSession, path: str, schema: str, keys: list[str], version: str) -> DataFrame:
    """Of all committed events, the row of each key of the highest version: what an upsert by key would hold."""
    found = committed(spark, path)
    events = spark.read.schema(schema).json(found) if found else spark.createDataFrame([], schema)
    return events.groupBy(*keys).agg(F.max_by(F.struct(*events.columns), version).alias("_x")).select("_x.*")


def moved(plan: DataFrame, companion: str = ".txt") -> DataFrame:
    """plan: source, target, keep boolean. Moves each file and, if there is one, its companion (same stem). Per row: source, target, state, error.

    States: kept, moved, missing, taken (the target exists), failed. A file whose companion cannot be moved goes back. A task that runs again finds
    its files at their targets and says moved. Paths must be seen by all executors; each row's source and target must be its own."""

    def one(source: str, target: str, keep: bool) -> tuple[str, str | None]:
        if keep:
            return "kept", None
        if not os.path.lexists(source):
            return ("moved", None) if os.path.lexists(target) else ("missing", None)
        if os.path.lexists(target):
            return "taken", None
        beside, after = (os.path.splitext(p)[0] + companion for p in (source, target))
        try:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            if beside != source and os.path.lexists(beside):
                if os.path.lexists(after):
                    return "taken", None
                os.rename(beside, after)
            try:
                os.rename(source, target)
            except OSError:
                if beside != source and os.path.lexists(after) and not os.path.lexists(beside):
                    os.rename(after, beside)
                raise
        except OSError as e:
            return "failed", f"{type(e).__name__}: {e}"
        return "moved", None

    def run(batches):
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("source", "target", "keep")), strict=True))
            got = [one(s, t, bool(k)) for s, t, k in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], ["source", "target", "state", "error"])

    return plan.select("source", "target", "keep").mapInArrow(run, "source string, target string, state string, error string")
