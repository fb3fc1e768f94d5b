"""Queries of versioned changes over the order tables: orders are jobs, their lines are the events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumaspan.operators import changes as C
from lumaspan.tables import table

KINDS = ("claim", "begin", "succeed", "requeue", "cancel", "retry", "recover", "fail")
STATES = {"O": "queued", "P": "running", "F": "failed"}


def _jobs(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("failed")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("attempt"),
                                             F.lit(3).alias("most"), F.lit(False).alias("cancel"), F.lit(1).alias("version"))


def _events(spark, sf):
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("l_partkey") % 8).cast("int"))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), at.cast("long").alias("seq"), kind.alias("kind"), F.when(F.col("l_suppkey") % 3 > 0, (F.col("l_suppkey") % 3).cast("int")).alias("attempt"),
        F.when(F.col("l_suppkey") % 5 == 0, at).alias("version"), (F.col("l_suppkey") % 2).cast("int").alias("extra"))


def folded_changes(spark, sf):
    """What came of each event, in order, and the state after it."""
    return C.fold(_jobs(spark, sf), _events(spark, sf)).where("seq is not null").select("id", "seq", "kind", "outcome", "status", "attempt", "most", "cancel", "version")


def folded_states(spark, sf):
    """Each job's state after all its events."""
    return C.states(C.fold(_jobs(spark, sf), _events(spark, sf)))


def dispatch_refill(spark, sf):
    """The next of 200 places: open orders by price, sites are customers' segments, pending orders run; a site has 12 places, machinery 40."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
    o = o.select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("site"), "o_totalprice", "o_orderstatus", F.pmod("o_orderkey", F.lit(100)).alias("m"))
    caps = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("site")).agg(F.lit(12).alias("cap")).withColumn("cap", F.when(F.col("site") == "MACHINERY", 40).otherwise(F.col("cap")))
    return C.dispatched(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus <> 'O' and m = 0").select("site"), caps, 200, [F.desc("o_totalprice"), F.asc("id")]).select("id", "site", F.col("place").cast("long").alias("place"))


FOLD = """WITH RECURSIVE e AS (
  SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq,
         ['claim', 'begin', 'succeed', 'requeue', 'cancel', 'retry', 'recover', 'fail'][CAST(l_partkey % 8 AS INT) + 1] AS kind,
         CASE WHEN l_suppkey % 3 > 0 THEN CAST(l_suppkey % 3 AS INT) END AS a, l_suppkey % 5 = 0 AS v, CAST(l_suppkey % 2 AS INT) AS extra FROM lineitem
), s AS (
  SELECT o_orderkey AS id, 0::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::VARCHAR AS outcome, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'failed' END AS status,
         CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS attempt, 3 AS most, false AS cancel, 1 AS version FROM orders
  UNION ALL
  SELECT id, seq, kind, outcome,
    CASE WHEN outcome <> 'applied' THEN status WHEN kind = 'claim' THEN 'starting' WHEN kind = 'begin' THEN 'running' WHEN kind = 'succeed' THEN 'succeeded' WHEN kind = 'fail' THEN 'failed'
         WHEN kind IN ('requeue', 'retry') THEN 'queued' WHEN kind = 'cancel' THEN CASE WHEN status = 'queued' THEN 'cancelled' ELSE 'cancelling' END
         ELSE CASE WHEN cancel THEN 'cancelled' WHEN attempt < most THEN 'queued' ELSE 'failed' END END,
    CASE WHEN outcome = 'applied' AND kind = 'begin' THEN attempt + 1 ELSE attempt END,
    CASE WHEN outcome = 'applied' AND kind = 'retry' THEN attempt + 1 ELSE most END,
    CASE WHEN outcome <> 'applied' THEN cancel WHEN kind = 'cancel' THEN true WHEN kind = 'retry' THEN false ELSE cancel END,
    CASE WHEN outcome = 'applied' AND kind <> 'recover' THEN version + 1 ELSE version END
  FROM (SELECT s.id, e.seq, e.kind, s.status, s.attempt, s.most, s.cancel, s.version,
          CASE WHEN e.v AND e.seq <> s.version THEN 'version'
               WHEN e.kind = 'claim' THEN CASE WHEN s.status = 'queued' AND NOT s.cancel THEN 'applied' ELSE 'refused' END
               WHEN e.kind = 'begin' THEN CASE WHEN s.status = 'starting' THEN 'applied' ELSE 'refused' END
               WHEN e.kind = 'requeue' AND s.cancel THEN 'refused'
               WHEN e.kind IN ('succeed', 'fail', 'requeue') THEN CASE WHEN e.a IS NULL OR (s.status IN ('running', 'cancelling') AND e.a = s.attempt) THEN 'applied' ELSE 'stale' END
               WHEN e.kind = 'cancel' THEN CASE WHEN s.status IN ('succeeded', 'failed', 'cancelled') THEN 'refused' ELSE 'applied' END
               WHEN e.kind = 'retry' THEN CASE WHEN s.status IN ('succeeded', 'failed', 'cancelled') THEN 'applied' ELSE 'refused' END
               ELSE CASE WHEN s.status IN ('starting', 'running', 'cancelling') THEN 'applied' ELSE 'refused' END END AS outcome
        FROM s JOIN e ON e.id = s.id AND e.seq = s.seq + 1)
)"""

QUERIES = {f.__name__: f for f in (folded_changes, folded_states, dispatch_refill)}
SQL = {
    "folded_changes": f"{FOLD} SELECT * FROM s WHERE seq > 0",
    "folded_states": f"{FOLD} SELECT id, status, attempt, most, cancel, version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM s) WHERE k = 1",
    "dispatch_refill": """WITH o AS (SELECT o_orderkey AS id, c_mktsegment AS site, o_totalprice, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey),
a AS (SELECT site, count(*) AS n FROM o WHERE o_orderstatus <> 'O' AND id % 100 = 0 GROUP BY site),
r AS (SELECT id, o.site, o_totalprice, row_number() OVER (PARTITION BY o.site ORDER BY o_totalprice DESC, id) AS k, coalesce(a.n, 0) AS n FROM o LEFT JOIN a ON a.site = o.site WHERE o_orderstatus = 'O')
SELECT id, site, place FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, id) AS place FROM r WHERE k <= CASE WHEN site = 'MACHINERY' THEN 40 ELSE 12 END - n) WHERE place <= 200 - (SELECT coalesce(sum(n), 0) FROM a)""",
}
