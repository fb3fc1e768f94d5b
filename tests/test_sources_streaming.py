"""File sources, endpoint rules and streaming jobs on small inputs."""

import base64
import datetime as dt
import json
import os

import pytest

from lumaspan.functions import rules
from lumaspan.sources import files
from lumaspan.streaming import jobs


def test_images_inventory_unreadable(spark, tmp_path):
    for name in ("a.JPG", "x/b.png", "x/keep/c.png", "duplicates/d.gif", "e.txt", "page_12.webp"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(name.encode())
    found = files.images(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.JPG", "b.png", "page_12.webp"]
    assert [(r.page, r.size) for r in files.inventory(spark, str(tmp_path)).collect()] == [(12, 12)]
    assert files.unreadable(found, found.where("path like '%png'")).count() == 2


def test_endpoint_lines(spark):
    lines = ["h.example.net:80:u:p", "u:p@H.example.net:80", " 'h.example.net:80' ", "SOCKS5 //s.example.net:1080", "socks5h s.example.net:1", "https://q.example.net", "# c", "", None,
             "localhost:80", "12345:80", "h.example.net:99999", "h.example.net:80"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "pos int, line string")
    got = {r.pos: (r.url, r.host) for r in files.valid_endpoints(df).collect()}
    assert got == {
        0: ("http://u:p@h.example.net:80", "h.example.net"), 1: ("http://u:p@H.example.net:80", "h.example.net"), 2: ("http://h.example.net:80", "h.example.net"),
        3: ("socks5://s.example.net:1080", "s.example.net"), 4: ("socks5h://s.example.net:1", "s.example.net"), 5: ("https://q.example.net", "q.example.net")}
    assert df.select(rules.masked_endpoint("line").alias("m")).where("m like '%***%'").count() == 0
    assert spark.sql("select 'see http://u:p@h:1 now' t").select(rules.masked_endpoint("t")).first()[0] == "see http://***@h:1 now"


def test_subscriptions_and_messages(spark):
    plain = "http://a.example.net:1\nhttp://b.example.net:2"
    packed = base64.urlsafe_b64encode(plain.encode()).decode().rstrip("=")
    twice = base64.b64encode(packed.encode()).decode()
    df = spark.createDataFrame([("p", plain), ("b", packed), ("t", twice), ("n", None), ("e", "")], "source string, body string")
    got = {}
    for r in files.subscription_lines(df).collect():
        got.setdefault(r.source, {})[r.pos] = r.line
    lines = dict(enumerate(plain.split("\n")))
    assert got == {"p": lines, "b": lines, "t": lines, "e": {0: ""}}
    body = json.dumps([[2, {"id": 1}], [3, "u", {"x": "y"}], [-1, {"error": "e"}], [6, "v", {}], [9, {}]])
    rows = files.messages(spark.createDataFrame([("a", body), ("b", "no json"), ("c", None), ("d", "[]")], "source string, body string")).collect()
    assert sorted((r.source, r.pos, r.kind, r.url) for r in rows if r.source == "a") == [("a", 0, "directory", None), ("a", 1, "media", "u"), ("a", 2, "error", None), ("a", 3, "queue", "v"), ("a", 4, "unknown", None)]
    assert [r.kind for r in rows if r.source == "b"] == ["invalid"] and not [r for r in rows if r.source in "cd"]


def test_dispositions(spark):
    df = spark.createDataFrame([("/a/x.png",), ("/b/X.png",), ("/c/y",)], "path string")
    assert dict(files.dispositions(df, "/d").collect()) == {"/a/x.png": "/d/x.png", "/b/X.png": "/d/X_1.png", "/c/y": "/d/y"}


def test_bounded_and_upsert(spark):
    df = spark.range(10).selectExpr("id", "cast(id as string) line")
    rows = jobs.bounded(df, 4).collect()
    assert sorted(r.id for r in rows if not r.dropped) == [6, 7, 8, 9] and [r.line for r in rows if r.dropped] == ["dropped 6 rows"]
    assert jobs.bounded(df, 10).where("dropped").count() == 0 and jobs.bounded(df.limit(0), 3).count() == 0
    old, new = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string"), spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 0, None)], "k int, v int, x string")
    assert sorted(tuple(r) for r in jobs.upsert(old, new, ["k"], "v").collect()) == [(1, 1, "c"), (2, 5, "b"), (3, 0, None)]


def run(spark, tmp_path, batches, schema, job, mode):
    src = tmp_path / "in"
    src.mkdir()
    for i, rows in enumerate(batches):
        (src / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken by age
    out = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = job(stream).writeStream.outputMode(mode).foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return out


def test_task_states_fold_across_batches(spark, tmp_path):
    e = lambda i, t, a, x: {"id": i, "task_id": t, "attempt": a, "event": x}
    batches = [[e(1, 1, 1, "claim"), e(2, 1, 1, "begin"), e(3, 2, 1, "cancel")], [e(4, 1, 1, "fail"), e(5, 1, 1, "requeue"), e(6, 1, 1, "succeed"), e(7, 2, 1, "claim"), e(8, 2, None, None)]]
    out = run(spark, tmp_path, batches, "id long, task_id long, attempt int, event string", jobs.task_states, "update")
    total = {}
    for r in out:
        t = total.setdefault(r.task_id, [set(), 0, 0])
        t[0].add((r.status, r.attempt))
        t[1] += r.applied
        t[2] += r.stale
    assert ("queued", 2) in total[1][0] and total[1][1:] == [4, 1] and total[2] == [{("cancelled", 1)}, 1, 2]


def test_leases_expire(spark, tmp_path):
    at = lambda s: (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)).isoformat()
    r = lambda i, who, s: {"id": i, "endpoint": "e", "owner": who, "at": at(s), "ttl_s": 10.0}
    out = run(spark, tmp_path, [[r(1, "a", 0), r(2, "b", 5), r(3, "a", 8), r(4, "b", 17), r(5, "b", 18)]], "id long, endpoint string, owner string, at timestamp, ttl_s double", jobs.leases, "append")
    assert {x.id: x.granted for x in out} == {1: True, 2: False, 3: True, 4: False, 5: True}


@pytest.mark.parametrize("event,want", [("claim", ("starting", 1, True)), ("begin", ("queued", 1, False)), ("requeue", ("queued", 1, False)), ("other", ("queued", 1, False))])
def test_next_state(event, want):
    assert jobs.next_state("queued", 1, event, 1) == want
