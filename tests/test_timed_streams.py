"""Timers, tails and sinks: time that advances, late and repeated events, restarts, failures between steps."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from lumaspan.sources import tail as T
from lumaspan.streaming import sinks, timed

rng = random.Random(6)
at = lambda s: datetime.datetime.fromtimestamp(1_700_000_000 + s, datetime.UTC).replace(tzinfo=None)
NOW = 1_700_000_000


@pytest.fixture(scope="module")
def store(spark):
    for k, v in timed.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in timed.STORE:
        spark.conf.unset(k)


def played(spark, where, schema, batches, stream):
    """The rows that a stream puts out, batch by batch, each from a restart of the same checkpoint."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{where}/in/{k}")
        source = spark.readStream.schema(schema).parquet(f"{where}/in/*")
        out = []
        q = stream(source).writeStream.foreachBatch(lambda b, _, out=out: out.extend(b.collect())).outputMode("update").option("checkpointLocation", f"{where}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
        yield out


def test_cooldowns_with_timers_equal_the_batch_form(spark, store, tmp_path):
    kind = "endpoint string, kind string, seconds double, ts timestamp, id long"
    first = [("a", "bad", 60.0, at(0), 1), ("b", "lease", None, at(1), 2), ("c", "bad", 10.0, at(2), 3), ("c", "good", None, at(3), 4), ("d", "bad", 500.0, at(4), 5), ("e", "lease", None, at(4), 7), ("e", "bad", 20.0, at(5), 8)]
    late = [("c", "bad", 900.0, at(1), 9), ("a", "bad", 60.0, at(0), 1), ("b", "release", None, at(30), 10), ("z", "good", None, at(100), 11)]
    last = [("z", "good", None, at(130), 12), ("e", "release", None, at(120), 13)]
    state, seen = {}, []
    for out in played(spark, tmp_path, kind, [first, late, last], lambda s: timed.cooldowns(s, "100 seconds")):
        state.update({r.endpoint: r.available for r in sorted(out, key=lambda r: r.as_of)})
        seen.append(dict(state))
        clear = {r.endpoint: r.as_of for r in out}
    assert seen[0] == {"a": False, "b": False, "c": True, "d": False, "e": False}
    assert seen[1]["b"] and seen[1]["c"] and not seen[1]["a"]
    assert not seen[2]["a"] and clear
    events = spark.createDataFrame(first + late + last, kind)
    want = dict(timed.pool_at(events, NOW + 30).collect())  # the watermark: what timers have told
    assert {k: seen[2][k] for k in "abcd"} == {k: want[k] for k in "abcd"}
    assert dict(timed.pool_at(events, NOW + 61).collect()) == {"a": True, "b": True, "c": True, "d": False, "e": False}


def test_timer_tells_when_a_deadline_passes(spark, store, tmp_path):
    kind = "endpoint string, kind string, seconds double, ts timestamp, id long"
    rows = [[("a", "bad", 60.0, at(0), 1), ("l", "lease", None, at(0), 2), ("l", "bad", 5.0, at(0), 3)], [("z", "good", None, at(200), 4)], [("z", "good", None, at(201), 5)]]
    outs = list(played(spark, tmp_path, kind, rows, timed.cooldowns))
    told = [(r.endpoint, r.as_of - NOW, r.available) for out in outs[1:] for r in out if r.endpoint != "z"]
    assert sorted(told) == [("a", 60.0, True), ("l", 5.0, False)]


def test_a_fault_ends_the_results_of_all_targets(spark, store, tmp_path):
    kind = "node string, kind string, target string, healthy boolean, ts timestamp, id long"
    first = [("n", "result", "x", True, at(0), 1), ("n", "result", "y", True, at(5), 2), ("m", "result", "x", True, at(1), 3), ("k", "result", "x", False, at(1), 4)]
    then = [("n", "fault", None, None, at(6), 5), ("n", "result", "x", True, at(0), 1), ("m", "fault", None, None, at(0), 6)]
    more = [("n", "result", "y", True, at(20), 7), ("q", "result", "x", True, at(400), 8)]
    live, seen = set(), []
    for out in played(spark, tmp_path, kind, [first, then, more, [("q", "fault", None, None, at(401), 9)]], lambda s: timed.probe_cache(s, 100, "50 seconds")):
        for r in out:
            (live.add if r.live else live.discard)((r.node, r.target))
        seen.append(set(live))
    assert seen[0] == {("n", "x"), ("n", "y"), ("m", "x")} and seen[1] == {("m", "x")}
    events = spark.createDataFrame(first + then + more, kind)
    assert {tuple(r) for r in timed.probes_at(events, 100, NOW + 21).collect()} == {("m", "x"), ("n", "y")}
    assert seen[3] == set() == {tuple(r) for r in timed.probes_at(events, 100, NOW + 350).collect()}


def test_nodes_return_when_their_time_is_over(spark, store, tmp_path):
    kind = "node string, healthy boolean, until double, ts timestamp, id long"
    rows = [[("a", False, NOW + 50.0, at(0), 1), ("never", False, None, at(0), 2), ("gone", False, NOW - 5.0, at(0), 3), ("ok", True, 0.0, at(0), 4)], [("ok", True, 0.0, at(90), 5)], [("ok", True, 0.0, at(91), 6)]]
    state = {}
    for out in played(spark, tmp_path, kind, rows, timed.readmissions):
        state.update({r.node: r.healthy for r in sorted(out, key=lambda r: r.as_of)})
        first = dict(state) if len(state) == 4 and "first" not in locals() else first
    assert first == {"a": False, "never": False, "gone": True, "ok": True} and state == {"a": True, "never": False, "gone": True, "ok": True}


def test_tail_reads_each_line_once_over_restarts_renames_and_cuts(spark, tmp_path):
    os.makedirs(tmp_path / "logs")
    log = tmp_path / "logs" / "a.log"
    got = []

    def read():
        q = T.tail(spark, f"{tmp_path}/logs/*", 7).writeStream.foreachBatch(lambda b, _: got.extend(r.line for r in b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)

    want = []

    def append(path, lines, open_end=""):
        want.extend(lines)
        with open(path, "a") as f:
            f.write("".join(x + "\n" for x in lines) + open_end)

    append(log, ["one", "zwei ä", "", "a long line over some ranges"], "half")
    read()
    assert sorted(got) == sorted(want)
    with open(log, "a") as f:
        f.write(" whole\n")
    want.append("half whole")
    append(log, ["next"])
    read()
    assert sorted(got) == sorted(want)
    os.rename(log, tmp_path / "logs" / "a.log.1")
    append(tmp_path / "logs" / "a.log.1", ["after the rename"])
    append(log, ["new file"])
    read()
    assert sorted(got) == sorted(want)
    with open(log, "w") as f:
        f.write("")
    append(log, ["cut"])
    read()
    read()
    assert sorted(got) == sorted(want)


def test_task_files(spark, tmp_path):
    os.makedirs(tmp_path / "r" / "sub")
    for n in ("b", "a", "sub/c"):
        (tmp_path / "r" / n).write_text(n)
    os.symlink(tmp_path / "r" / "a", tmp_path / "r" / "link")
    os.symlink(tmp_path / "r" / "sub", tmp_path / "r" / "linked")
    assert [r.path for r in T.task_files(spark, str(tmp_path / "r")).collect()] == ["a", "b", "sub/c"]
    assert T.task_files(spark, str(tmp_path / "r"), 2).count() == 2


@pytest.mark.parametrize("where", ["begin", "written", "published", "committed", None])
def test_each_batch_is_published_once_whatever_fails(spark, tmp_path, where):
    kind = "k string, v long"
    spark.createDataFrame([("a", 1), ("b", 2)], kind).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    broken = [where]

    def step(name):
        if broken and broken[0] == name:
            broken.pop()
            raise RuntimeError("lost")

    for _ in range(2):
        q = sinks.stats_sink(spark.readStream.schema(kind).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/c", step).trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception as e:
            assert "lost" in str(e) and where
    spark.createDataFrame([("a", 3)], kind).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    sinks.stats_sink(spark.readStream.schema(kind).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert len(sinks.committed(spark, f"{tmp_path}/out")) == 2
    assert spark.read.schema(kind).json(sinks.committed(spark, f"{tmp_path}/out")).count() == 3
    assert sorted(map(tuple, sinks.stats(spark, f"{tmp_path}/out", kind, ["k"], "v").collect())) == [("a", 3), ("b", 2)]


def test_manifest_is_whole_or_as_it_was(spark, tmp_path):
    path = f"{tmp_path}/m"
    good = spark.createDataFrame([("ä", 1.5, None)], "n string, x double, y string")
    sinks.manifest(good, path)
    with pytest.raises(Exception, match="not finite"):
        sinks.manifest(spark.createDataFrame([("b", float("nan"), "")], "n string, x double, y string"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ['{"n":"ä","x":1.5,"y":null}']
    sinks.manifest(good.withColumn("n", F.lit("new")), path)
    assert spark.read.json(path).first().n == "new" and sorted(os.listdir(tmp_path)) == ["m"]


def test_moves_with_companions_and_way_back(spark, tmp_path):
    make = lambda n, t="x": (os.makedirs(os.path.dirname(tmp_path / n), exist_ok=True), (tmp_path / n).write_text(t))
    for n in ("s/a.jpg", "s/a.txt", "s/b.jpg", "s/c.jpg", "t/c.jpg", "s/keep.jpg", "s/f.jpg", "s/f.txt"):
        make(n, n)
    (tmp_path / "file").write_text("no folder")
    p = lambda n: str(tmp_path / n)
    rows = [(p("s/a.jpg"), p("t/a.jpg"), False), (p("s/b.jpg"), p("t/b_2.jpg"), False), (p("s/c.jpg"), p("t/c.jpg"), False), (p("s/keep.jpg"), p("t/keep.jpg"), True), (p("s/no.jpg"), p("t/no.jpg"), False), (p("s/f.jpg"), p("file/f.jpg"), False)]
    plan = spark.createDataFrame(rows, "source string, target string, keep boolean")
    want = {"a": "moved", "b": "moved", "c": "taken", "keep": "kept", "no": "missing", "f": "failed"}
    for _ in range(2):
        got = {os.path.basename(r.source)[:-4]: r.state for r in sinks.moved(plan).collect()}
        assert got == want
    assert (tmp_path / "t/a.txt").read_text() == "s/a.txt" and not (tmp_path / "s/a.txt").exists()
    assert (tmp_path / "s/f.txt").exists() and (tmp_path / "s/f.jpg").exists() and (tmp_path / "t/c.jpg").read_text() == "t/c.jpg"
