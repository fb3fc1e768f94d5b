"""Registries, cached scoring, sources read together, and the shared folder's rule."""

import pytest
from pyspark.sql import functions as F

from lumaspan.operators import caches as C
from lumaspan.operators import storage


def test_contents_in_the_cache_are_not_scored_again(spark):
    C.register_model("lengths", lambda c: F.array(F.length(c).cast("double")), 1)
    cache = spark.createDataFrame([("lengths", "a", [9.0]), ("lengths", "b", [1.0, 2.0]), ("other", "c", [5.0])], "model_key string, content_hash string, vector array<double>")
    wanted = spark.createDataFrame([("a", "xx"), ("b", "xxx"), ("c", "x"), ("d", None)], "content_hash string, content string")
    got = {r.content_hash: r.vector for r in C.with_vectors(wanted, cache, "lengths").collect()}
    assert got == {"a": [9.0], "b": [3.0], "c": [1.0], "d": [None]}


def test_sources_read_together(spark):
    a, b = spark.createDataFrame([(1,)], "x long"), spark.createDataFrame([], "x long")
    rows, status = C.read_together({"a": a, "b": b}, {"c": "timeout"})
    assert [tuple(r) for r in rows.collect()] == [(1, "a")]
    assert {tuple(r) for r in status.collect()} == {("a", True, 1, None), ("b", True, 0, None), ("c", False, 0, "timeout")}
    with pytest.raises(RuntimeError):
        C.read_together({}, {"c": "timeout"})


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://h:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(ValueError):
        storage.scratch_dir(Session())
    Session.sparkContext.master = "local[4]"
    Session.sparkContext.applicationId = "x"
    assert storage.scratch_dir(Session()).startswith("file:")


def test_picked_node_by_all_parts_of_the_order(spark):
    from lumaspan.operators.caches import picked_node

    kind = "id string, healthy boolean, cooldown_until double, address string, load int, tls_fails int, successes int, fails int, latency double, g string"
    base = ("a", True, None, "", 0, 0, 5, 0, 9.0)
    at = lambda k, **more: tuple({**dict(zip(("id", "healthy", "cooldown_until", "address", "load", "tls_fails", "successes", "fails", "latency"), base, strict=True)), "id": k, **more}.values())
    pairs = [  # the better one first
        (at("z", address="p2", load=9), at("a")), (at("z"), at("a", load=1)), (at("z", address="p1"), at("a", address="p2")), (at("z"), at("a", tls_fails=1)), (at("z", successes=6), at("a")),
        (at("z"), at("a", fails=1)), (at("z", latency=100.0), at("a", latency=None)), (at("z", latency=1.0), at("a")), (at("a"), at("b")), (at("z"), at("a", healthy=None)), (at("z"), at("a", cooldown_until=99.0)),
    ]
    rows = [(*x, str(i)) for i, p in enumerate(pairs) for x in p] + [(*at("out"), "none")]
    got = {r.g: (r.id, r.load) for r in picked_node(spark.createDataFrame(rows, kind), ["g"], ["p1", "p2"], 50.0, ["out"]).collect()}
    assert got == {str(i): (p[0][0], p[0][4] + 1) for i, p in enumerate(pairs)}
