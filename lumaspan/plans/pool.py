"""Queries of value rules, caches and pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaspan.functions import values as V
from lumaspan.operators import caches as C
from lumaspan.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f
    return register


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey AS DOUBLE) END AS value FROM customer")
def finite_values(spark, sf):
    """Numbers that JSON can hold."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", V.finite(F.when(k % 6 == 0, F.lit(float("nan"))).when(k % 3 == 0, F.lit(float("-inf"))).otherwise(k.cast("double"))).alias("value"))


@query("""SELECT n_nationkey, count(s_suppkey) FILTER (s_acctbal > 5000) AS ok, count(s_suppkey) FILTER (s_acctbal <= 5000) AS failed, round(CASE WHEN count(s_suppkey) = 0 THEN 1.0::DOUBLE ELSE greatest(10.0::DOUBLE * count(s_suppkey) FILTER (s_acctbal > 5000) / count(s_suppkey), 0.1::DOUBLE) END, 6) AS weight
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def country_weights(spark, sf):
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_if(F.col("s_acctbal") > 5000).alias("o"), F.count_if(F.col("s_acctbal") <= 5000).alias("f"))
    ok, failed = F.coalesce("o", F.lit(0)), F.coalesce("f", F.lit(0))
    return table(spark, sf, "nation").join(s, "n_nationkey", "left").select("n_nationkey", ok.alias("ok"), failed.alias("failed"), F.round(V.country_weight(ok, failed), 6).alias("weight"))


@query("SELECT vec_id, vec_id % 3 = 0 OR vec_id % 5 = 0 AS known, CASE WHEN vec_id % 5 = 0 THEN 1.0::DOUBLE WHEN vec_id % 3 = 0 THEN 0.0::DOUBLE END AS head FROM embeddings")
def vector_cache(spark, sf):
    """Vectors of a cache after new ones were put in; entries of another model or size are misses."""
    e = table(spark, sf, "embeddings")
    entry = lambda test, head, model, size: e.where(test).select(F.lit(model).alias("model_key"), F.col("vec_id").cast("string").alias("content_hash"), F.array_repeat(F.lit(head), size).alias("vector"))
    old = entry("vec_id % 3 = 0", 0.0, "m", 4).unionByName(entry("vec_id % 7 = 1", 0.0, "other", 4)).unionByName(entry("vec_id % 3 = 1 AND vec_id % 5 > 0", 0.0, "m", 3))
    cache = C.cache_put(old, entry("vec_id % 5 = 0", 1.0, "m", 4))
    got = C.cached(e.select("vec_id", F.col("vec_id").cast("string").alias("content_hash")), cache, "m", 4)
    return got.select("vec_id", F.col("vector").isNotNull().alias("known"), F.get("vector", F.lit(0)).alias("head"))


@query("""WITH r AS (SELECT user_id AS target, user_id % 10 AS node, event_id, event_id % 1000 AS seen, value FROM events), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, node ORDER BY seen DESC, event_id DESC) AS n FROM r) WHERE n = 1 AND 1000 - seen < 600),
f AS (SELECT s_suppkey AS node, max(500 + s_suppkey * 40) AS fault FROM supplier WHERE s_suppkey % 10 = s_suppkey GROUP BY 1) SELECT target, l.seen FROM l LEFT JOIN f ON f.node = l.node WHERE fault IS NULL OR fault < l.seen""")
def probe_cache(spark, sf):
    """Probe results inside their time to live that no later fault of their node has ended."""
    r = table(spark, sf, "events").select(F.col("user_id").alias("target"), (F.col("user_id") % 10).alias("node"), (F.col("event_id") % 1000).alias("at"), "event_id")
    faults = table(spark, sf, "supplier").where("s_suppkey % 10 = s_suppkey").select(F.col("s_suppkey").alias("node"), (500 + F.col("s_suppkey") * 40).alias("at"))
    return C.live(r, ["target", "node"], "at", faults, "node", 1000, 600).select("target", F.col("at").alias("seen"))


@query("SELECT s_suppkey, s_suppkey % 3 = 0 OR (s_suppkey % 4 > 0 AND s_suppkey % 4 * 30 <= 60) AS healthy, CAST(CASE WHEN s_suppkey % 3 > 0 AND s_suppkey % 4 > 0 AND s_suppkey % 4 * 30 <= 60 THEN 0 ELSE s_suppkey % 4 * 30 END AS DOUBLE) AS cooldown_until FROM supplier")
def readmitted_nodes(spark, sf):
    n = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 3 == 0).alias("healthy"), (F.col("s_suppkey") % 4 * 30.0).alias("cooldown_until"))
    return C.readmitted(n, 60.0)


@query("SELECT s_suppkey FROM supplier WHERE NOT (s_suppkey % 4 = 1 AND s_suppkey % 9 * 10 > 40) AND s_suppkey % 5 > 0")
def available_pool(spark, sf):
    s, k = table(spark, sf, "supplier").select("s_suppkey"), F.col("s_suppkey")
    return C.available(s, s.where(k % 4 == 1).select(k, (k % 9 * 10).alias("deadline")), s.where(k % 5 == 0), "s_suppkey", 40)


@query("""SELECT s_nationkey, s_suppkey AS id, s_suppkey % 3 + 1 AS load FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY NOT right(s_name, 1) IN ('7', '3'), s_suppkey % 3, CASE right(s_name, 1) WHEN '7' THEN 1 WHEN '3' THEN 2 ELSE 3 END,
  CAST(floor(abs(s_acctbal)) AS BIGINT) % 4, -(CAST(floor(abs(s_acctbal)) AS BIGINT) % 10), CAST(floor(abs(s_acctbal)) AS BIGINT) % 7, s_acctbal > 9000, CASE WHEN s_acctbal > 9000 THEN 0 ELSE s_acctbal END, CAST(s_suppkey AS VARCHAR)) AS n
  FROM supplier WHERE s_acctbal > -500 AND s_suppkey % 11 > 0) WHERE n = 1""")
def node_pick(spark, sf):
    """Suppliers as nodes of their nations; names that end in 7, then 3, are preferred."""
    n = F.floor(F.abs("s_acctbal"))
    nodes = table(spark, sf, "supplier").select(
        "s_nationkey", F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > -500).alias("healthy"), F.when(F.col("s_suppkey") % 11 == 0, 100.0).alias("cooldown_until"), F.right("s_name", F.lit(1)).alias("address"),
        (F.col("s_suppkey") % 3).alias("load"), (n % 4).alias("tls_fails"), (n % 10).alias("successes"), (n % 7).alias("fails"), F.when(F.col("s_acctbal") <= 9000, F.col("s_acctbal").cast("double")).alias("latency"))
    return C.picked_node(nodes, ["s_nationkey"], ["7", "3"], 50.0).select("s_nationkey", "id", "load")


@query("""SELECT content, min(doc_id) AS winner, count(*) AS members, CASE WHEN count(*) > 1 THEN 'exact' ELSE 'single' END AS kind
FROM (SELECT doc_id, CASE WHEN lang <> 'es' THEN 'pixel:' || md5(text) ELSE 'file:' || sha256(source || '/' || text) END AS content FROM documents) GROUP BY content""")
def content_units(spark, sf):
    """Texts as decoded content, but for Spanish ones, which count as files that could not be decoded."""
    text = F.encode("text", "utf-8")
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") != "es", F.md5(text)).alias("pixel"), F.sha2(F.encode(F.concat("source", F.lit("/"), "text"), "utf-8"), 256).alias("file"))
    return C.exact_units(d, "doc_id", "pixel", "file")
