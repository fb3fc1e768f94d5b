"""Folds of events against a plain loop; claims at one version; dispatch against a loop with rounds; decisions."""

import random

import pytest
from pyspark.sql import functions as F

from lumaspan.operators import changes as C

rng = random.Random(12)
JOB, EVENT = "id string, status string, attempt int, most int, cancel boolean, version int", "id string, seq long, kind string, attempt int, version int, extra int"


def test_only_one_of_two_claims_at_a_version_wins(spark):
    jobs = spark.createDataFrame([("a", "queued", 0, 2, False, 4)], JOB)
    events = spark.createDataFrame([("a", 1, "claim", None, 4, None), ("a", 2, "claim", None, 4, None), ("a", 3, "begin", None, 5, None), ("a", 4, "succeed", 7, None, None), ("a", 5, "succeed", 1, None, None), ("b", 1, "claim", None, None, None)], EVENT)
    folded = C.fold(jobs, events)
    assert [r.outcome for r in folded.where("id = 'a' and seq is not null").orderBy("seq").collect()] == ["applied", "version", "applied", "stale", "applied"]
    assert [r.outcome for r in folded.where("id = 'b'").collect()] == ["unknown"]
    assert [tuple(r) for r in C.states(folded).collect()] == [("a", "succeeded", 1, 2, False, 7)]


def test_crash_and_cancel_and_retry(spark):
    jobs = [("q", "queued", 0, 2, False, 1), ("r", "running", 1, 2, False, 1), ("full", "running", 2, 2, False, 1), ("c", "cancelling", 1, 2, True, 1), ("done", "failed", 2, 2, False, 1), ("none", "running", 1, 1, None, None)]
    events = [(k, 1, "recover", None, None, None) for k, *_ in jobs[:5]] + [("q", 2, "cancel", None, None, None), ("done", 2, "retry", None, None, 3), ("c", 2, "requeue", None, None, None), ("r", 2, "cancel", None, None, None)]
    got = {r.id: tuple(r)[1:] for r in C.states(C.fold(spark.createDataFrame(jobs, JOB), spark.createDataFrame(events, EVENT))).collect()}
    assert got == {"q": ("cancelled", 0, 2, True, 2), "r": ("cancelled", 1, 2, True, 2), "full": ("failed", 2, 2, False, 1), "c": ("cancelled", 1, 2, True, 1), "done": ("queued", 2, 5, False, 2), "none": ("running", 1, 1, False, 0)}
    assert C.fold(spark.createDataFrame([], JOB), spark.createDataFrame([], EVENT)).count() == 0


def test_a_job_with_many_events(spark):
    kinds = ["claim", "begin", "requeue"]
    events = spark.range(30_000).select(F.lit("hot").alias("id"), F.col("id").alias("seq"), F.get(F.array(*map(F.lit, kinds)), (F.col("id") % 3).cast("int")).alias("kind"), F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("int").alias("version"), F.lit(None).cast("int").alias("extra"))
    got = C.states(C.fold(spark.createDataFrame([("hot", "queued", 0, 1, False, 0)], JOB), events)).first()
    assert tuple(got) == ("hot", "queued", 10_000, 1, False, 30_000)


@pytest.mark.parametrize("capacity", [0, 7, 50])
def test_dispatch_equals_rounds(spark, capacity):
    queue = [(k, f"s{min(4, int(rng.expovariate(0.7)))}", rng.randint(0, 9)) for k in range(300)]
    active, caps = [("s0",)] * 2 + [("s3",)] * 3 + [("x",)], [("s0", 6), ("s1", 1), ("s2", 0), ("s3", 3)]
    free = {s: c for s, c in caps}
    running, left, want, full = {}, capacity - len(active), [], set()
    for (s,) in active:
        running[s] = running.get(s, 0) + 1
    order = sorted(queue, key=lambda r: (-r[2], r[0]))
    for _ in range(10):
        hit = False
        for k, s, _p in [r for r in order if r[1] not in full][:40]:
            if left <= 0 or k in want:
                continue
            if running.get(s, 0) >= free.get(s, 2):
                full.add(s)
                hit = True
                continue
            want.append(k)
            running[s] = running.get(s, 0) + 1
            left -= 1
        order = [r for r in order if r[0] not in want]
        if left <= 0 or not hit:
            break
    df = spark.createDataFrame(queue, "id long, site string, p int").repartition(3)
    got = C.dispatched(df, spark.createDataFrame(active, "site string"), spark.createDataFrame(caps, "site string, cap int"), capacity, [F.desc("p"), F.asc("id")], 2).collect()
    assert {r.id for r in got} == set(want) and sorted(r.place for r in got) == list(range(1, len(want) + 1))


def test_decisions_apply_to_a_batch_or_not_at_all(spark):
    images = spark.createDataFrame([(b, g, f"{b}{g}{i}", True) for b in "abcdefg" for g in ("g1", "g2") for i in range(3)], "batch string, grp string, id string, selected boolean")
    groups = spark.createDataFrame([(b, g, "auto_exact" if (b, g) == ("d", "g2") else "review") for b in "abcdefg" for g in ("g1", "g2")], "batch string, grp string, kind string")
    reviews = spark.createDataFrame([(b, "applied" if b == "b" else "ready") for b in "abcdef"], "batch string, status string")
    rows = [("a", "g1", ["ag12"]), ("a", "g2", []), ("b", "g1", ["bg10"]), ("c", "g1", ["cg10"]), ("c", "g1", ["cg11"]), ("d", "g1", ["dg10"]), ("d", "g2", ["dg20"]), ("e", "g1", ["eg20"]), ("f", "g9", []), ("g", "g1", [])]
    after, said = C.decided(images, groups, spark.createDataFrame(rows, "batch string, grp string, picked array<string>"), reviews)
    assert dict(said.collect()) == {"a": "applied", "b": "not_ready", "c": "repeated", "d": "automatic", "e": "foreign_image", "f": "unknown_group", "g": "missing"}
    got = {r.id for r in after.where("selected").collect()}
    assert {x for x in got if x[0] == "a"} == {"ag12"} and len(got) == 1 + 6 * 6 and after.count() == 42
