"""Versioned changes of jobs: one fold of ordered events over a snapshot, the next jobs to start, and review decisions.

``fold`` spreads jobs by key, sorts each partition by (key, sequence) and reads it as a stream: one job's state is held at a time, so a job with very
many events needs no more memory than others. Each event sees the state that the ones before it left; of two claims at one version only the first finds it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The names of states.
ENDED = ("succeeded", "failed", "cancelled")
ACTIVE = ("starting", "running", "cancelling")
AT_WORK = ("running", "cancelling")
ENDS = {"succeed": "succeeded", "fail": "failed", "end_cancelled": "cancelled"}

State = tuple[str, int, int, bool, int]  # status, attempt, most attempts, cancel asked for, version


def changed(state: State, kind: str | None, attempt: int | None, version: int | None, extra: int | None) -> tuple[State, str]:
    """The state after an event and what came of it: applied, version (another one was expected), stale (another attempt) or refused."""
    status, tries, most, cancel, number = state
    if version is not None and version != number:
        return state, "version"
    current = attempt is None or (status in AT_WORK and attempt == tries)
    if kind == "claim" and status == "queued" and not cancel:
        new = ("starting", tries, most, cancel)
    elif kind == "begin" and status == "starting":
        new = ("running", tries + 1, most, cancel)
    elif kind in ENDS:
        if not current:
            return state, "stale"
        new = (ENDS[kind], tries, most, cancel or kind == "end_cancelled")
    elif kind == "requeue" and not cancel:
        if not current:
            return state, "stale"
        new = ("queued", tries, most, cancel)
    elif kind == "cancel" and status not in ENDED:
        new = ("cancelled" if status == "queued" else "cancelling", tries, most, True)
    elif kind == "retry" and status in ENDED:
        new = ("queued", tries, tries + max(1, extra or 0), False)
    elif kind == "recover" and status in ACTIVE:  # after a crash: no new version
        return ("cancelled" if cancel else "queued" if tries < most else "failed", tries, most, cancel, number), "applied"
    else:
        return state, "refused"
    return (*new, number + 1), "applied"


def fold(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """snapshot: id, status, attempt, most, cancel, version. events: id, seq long, kind, attempt, version, extra (null: any, any, none).

    A row for each event and, with seq null, for each job as it was: id, seq, kind, outcome and the state after it; ``last`` marks each job's last
    row. Events without a job are ``unknown``. Null keys are left out; events of equal seq are taken by kind, attempt and version."""
    key = snapshot.schema["id"].dataType.simpleString()
    null = lambda t: F.lit(None).cast(t)
    old = snapshot.select("id", null("long").alias("seq"), null("string").alias("kind"), null("int").alias("want_attempt"), null("int").alias("want_version"), null("int").alias("extra"),
                          "status", F.col("attempt").cast("int"), F.col("most").cast("int"), F.col("cancel").cast("boolean"), F.col("version").cast("int"))
    new = events.select("id", F.col("seq").cast("long"), "kind", F.col("attempt").cast("int").alias("want_attempt"), F.col("version").cast("int").alias("want_version"), F.col("extra").cast("int"),
                        null("string").alias("status"), null("int").alias("attempt"), null("int").alias("most"), null("boolean").alias("cancel"), null("int").alias("version"))
    rows = old.unionByName(new).where("id is not null").repartition("id").sortWithinPartitions("id", F.col("seq").asc_nulls_first(), "kind", "want_attempt", "want_version")
    names = ["id", "seq", "kind", "outcome", "status", "attempt", "most", "cancel", "version", "last"]

    def run(batches):
        held, own, state = None, None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if held is not None:
                    out.append((*held, held[0] != r["id"]))
                if own != r["id"]:
                    own, state = r["id"], None
                if r["seq"] is None and r["kind"] is None and r["status"] is not None:
                    state, outcome = (r["status"], r["attempt"] or 0, r["most"] or 0, bool(r["cancel"]), r["version"] or 0), None
                elif state is None:
                    outcome = "unknown"
                else:
                    state, outcome = changed(state, r["kind"], r["want_attempt"], r["want_version"], r["extra"])
                held = (own, r["seq"], r["kind"], outcome, *(state or (None,) * 5))
            yield batch(out, b)
        if held is not None:
            yield batch([(*held, True)], b)

    def batch(out, like):
        kinds = [like.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names)

    return rows.mapInArrow(run, f"id {key}, seq long, kind string, outcome string, status string, attempt int, most int, cancel boolean, version int, last boolean")


def states(folded: DataFrame) -> DataFrame:
    return folded.where("last and status is not null").select("id", "status", "attempt", "most", "cancel", "version")


def dispatched(queue: DataFrame, active: DataFrame, caps: DataFrame, capacity: int, order: list[Column], default_cap: int = 1) -> DataFrame:
    """queue: id, site and the columns of ``order``; active: site (a row per running job); caps: site, cap. The jobs that start now, and their place.

    A site has as many places as its cap leaves beside its running jobs; jobs of full sites are passed over and the next in order take their turn, until
    ``capacity`` jobs run. Filling up in rounds ends at the same jobs: the first of each site within its places, then the first of those. Only
    ``capacity`` rows of a site can be among them, and these are all that leave a task, however long the site's queue."""
    running = active.groupBy("site").agg(F.count("*").alias("_running"))
    total = running.agg(F.coalesce(F.sum("_running"), F.lit(0)).alias("_total"))
    within = queue.withColumn("_rank", F.row_number().over(Window.partitionBy("site").orderBy(*order))).where(F.col("_rank") <= capacity)
    free = F.greatest(F.lit(0), F.coalesce("cap", F.lit(default_cap)) - F.coalesce("_running", F.lit(0)))
    able = within.join(running, "site", "left").join(caps.select("site", "cap"), "site", "left").where(F.col("_rank") <= free).drop("_rank", "_running", "cap")
    first = able.orderBy(*order).limit(capacity).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # ``capacity`` rows at most
    return first.crossJoin(F.broadcast(total)).where(F.col("place") <= capacity - F.col("_total")).drop("_total")


def decided(images: DataFrame, groups: DataFrame, decisions: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies decisions to a batch's images, all of a batch or nothing.

    images: batch, grp, id, selected; groups: batch, grp, kind; decisions: batch, grp, picked (array of ids); reviews: batch, status.
    Returns the images with ``selected`` as decided, and per batch with decisions: batch, outcome (applied, or the first fault by this
    order: missing, not_ready, repeated, unknown_group, automatic, foreign_image)."""
    sizes = images.groupBy("batch", "grp").agg(F.count("*").alias("_n"))
    named = decisions.groupBy("batch", "grp").agg(F.count("*").alias("_times"), F.first("picked").alias("picked"))
    picks = named.select("batch", "grp", F.explode(F.array_distinct(F.coalesce("picked", F.array().cast("array<string>")))).alias("id"))
    found = picks.join(images.select("batch", "grp", "id"), ["batch", "grp", "id"], "left_semi").groupBy("batch", "grp").agg(F.count("*").alias("_found"))
    wanted = picks.groupBy("batch", "grp").agg(F.count("*").alias("_wanted"))
    joined = named.join(groups, ["batch", "grp"], "left").join(sizes, ["batch", "grp"], "left").join(found, ["batch", "grp"], "left").join(wanted, ["batch", "grp"], "left").join(reviews, "batch", "left")
    fault = (
        F.when(F.col("status").isNull(), 1).when(F.col("status") != "ready", 2).when(F.col("grp").isNull() | (F.col("_times") > 1), 3)
        .when(F.col("kind").isNull() | F.col("_n").isNull(), 4).when(F.col("kind").startswith("auto_"), 5)
        .when(F.coalesce("_wanted", F.lit(0)) > F.coalesce("_found", F.lit(0)), 6).otherwise(9))
    outcome = F.get(F.array(*map(F.lit, ("missing", "not_ready", "repeated", "unknown_group", "automatic", "foreign_image", "", "", "applied"))), F.col("_f") - 1)
    verdict = joined.groupBy("batch").agg(F.min(fault).alias("_f")).select("batch", outcome.alias("outcome"))
    good = named.join(verdict.where("outcome = 'applied'"), "batch").select("batch", "grp", F.lit(True).alias("_decided"))
    chosen = picks.select("batch", "grp", "id", F.lit(True).alias("_picked"))
    after = images.join(good, ["batch", "grp"], "left").join(chosen, ["batch", "grp", "id"], "left")
    return after.select("batch", "grp", "id", F.when(F.col("_decided"), F.coalesce("_picked", F.lit(False))).otherwise(F.col("selected")).alias("selected")), verdict
