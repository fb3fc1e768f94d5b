"""Queries of the job-state model: queues, attempts, rollups, logs, upserts. orders are tasks, lineitem their attempts, events the log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumaspan.tables import table

QUERIES, SQL = {}, {}
#: A total order of the attempts of a task; (orderkey, linenumber) alone repeats.
ATTEMPT = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
ORDER = ", ".join(ATTEMPT)


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return register


def _t(name):
    return lambda spark, sf: table(spark, sf, name)


orders, lineitem, events, customer, nation, part, region, supplier = map(_t, "orders lineitem events customer nation part region supplier".split())


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (1, 2, 3) ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 1000")
def queue_order(spark, sf):
    """Open tasks of sites not excluded, by priority and age; the 1,000 of a poll."""
    return orders(spark, sf).where("o_orderstatus = 'O' AND o_custkey NOT IN (1, 2, 3)").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(1000).select("o_orderkey", "o_totalprice")


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, o_orderpriority, place FROM r WHERE place <= 5 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def site_capped_queue(spark, sf):
    """At most 5 tasks a site, 20 in all."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    r = orders(spark, sf).where("o_orderstatus = 'O'").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5")
    return r.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_orderpriority", "place")


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in ATTEMPT)}) AS n FROM lineitem) WHERE n = 1")
def latest_attempt(spark, sf):
    latest = lineitem(spark, sf).groupBy("l_orderkey").agg(F.max_by(F.struct("l_linenumber", "l_extendedprice"), F.struct(*ATTEMPT)).alias("x"))
    return latest.select("l_orderkey", "x.l_linenumber", "x.l_extendedprice")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 50")
def log_retention(spark, sf):
    """The newest 50 rows of each task's log."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return events(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 50").select("event_id", "user_id")


@query("SELECT event_id, event_type FROM (SELECT * FROM events WHERE user_id = 7 ORDER BY event_id DESC LIMIT 20) ORDER BY event_id")
def log_tail(spark, sf):
    return events(spark, sf).where("user_id = 7").orderBy(F.desc("event_id")).limit(20).orderBy("event_id").select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events WHERE user_id = 7 AND event_id > 500 ORDER BY event_id LIMIT 5000")
def log_after_cursor(spark, sf):
    return events(spark, sf).where("user_id = 7 AND event_id > 500").orderBy("event_id").limit(5000).select("event_id", "event_type")


@query("SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other FROM orders GROUP BY o_custkey")
def status_rollup(spark, sf):
    s = F.col("o_orderstatus")
    return orders(spark, sf).groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(s == "F").alias("finished"), F.count_if(s == "O").alias("open"), F.count_if(~s.isin("F", "O")).alias("other"))


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'O') THEN 'running' WHEN bool_or(o_orderstatus = 'P') THEN 'completed_with_errors' ELSE 'succeeded' END AS status FROM orders GROUP BY o_custkey""")
def batch_terminal_status(spark, sf):
    s = F.col("o_orderstatus")
    return orders(spark, sf).groupBy("o_custkey").agg(F.when(F.bool_or(s == "O"), "running").when(F.bool_or(s == "P"), "completed_with_errors").otherwise("succeeded").alias("status"))


@query(f"SELECT c_custkey, o_orderkey, l_linenumber, l_extendedprice FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey, o_orderkey, {ORDER} LIMIT 100 OFFSET 200")
def linked_tasks_page(spark, sf):
    c = customer(spark, sf).where("c_mktsegment = 'BUILDING'")
    j = c.join(orders(spark, sf), F.col("o_custkey") == F.col("c_custkey")).join(lineitem(spark, sf), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.orderBy("c_custkey", "o_orderkey", *ATTEMPT).offset(200).limit(100).select("c_custkey", "o_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def already_done_antijoin(spark, sf):
    done = lineitem(spark, sf).where("l_returnflag = 'R'")
    return orders(spark, sf).join(done, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT count(DISTINCT l_orderkey) AS keys FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_name ILIKE 'customer%' AND l_returnflag = 'R'")
def already_done_count(spark, sf):
    j = lineitem(spark, sf).where("l_returnflag = 'R'").join(orders(spark, sf), F.col("o_orderkey") == F.col("l_orderkey")).join(customer(spark, sf).where(F.col("c_name").ilike("customer%")), F.col("c_custkey") == F.col("o_custkey"))
    return j.agg(F.countDistinct("l_orderkey").alias("keys"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000")
def left_probe_join(spark, sf):
    return customer(spark, sf).join(orders(spark, sf).where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def exists_linked(spark, sf):
    return customer(spark, sf).join(orders(spark, sf).where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_exists_linked(spark, sf):
    return customer(spark, sf).join(orders(spark, sf), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ORDER}) AS copy, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS top FROM lineitem),
c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS k FROM r WHERE copy > 1)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS seq, l_extendedprice FROM r WHERE copy = 1 UNION ALL SELECT l_orderkey, top + k, l_extendedprice FROM c""")
def sequence_allocation(spark, sf):
    """Colliding sequence numbers move behind the largest; the others stay."""
    same, task = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*ATTEMPT), Window.partitionBy("l_orderkey")
    r = lineitem(spark, sf).withColumn("copy", F.row_number().over(same)).withColumn("top", F.max("l_linenumber").over(task))
    k = F.row_number().over(Window.partitionBy("l_orderkey", F.col("copy") > 1).orderBy(*ATTEMPT))
    return r.withColumn("k", k).select("l_orderkey", F.when(F.col("copy") == 1, F.col("l_linenumber")).otherwise(F.col("top") + F.col("k")).cast("long").alias("seq"), "l_extendedprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_totalprice * 2 FROM orders n WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey = n.o_orderkey AND b.o_orderkey % 3 <> 0)")
def idempotent_insert(spark, sf):
    """New rows are added only for keys that are not there."""
    base = orders(spark, sf).where("o_orderkey % 3 <> 0").select("o_orderkey", "o_totalprice")
    new = orders(spark, sf).select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return base.unionAll(new.join(base, "o_orderkey", "left_anti"))


@query("SELECT coalesce(r.o_orderkey, l.o_orderkey) AS o_orderkey, coalesce(r.p, l.p) AS price FROM (SELECT o_orderkey, o_totalprice AS p FROM orders WHERE o_orderkey % 2 = 0) l FULL JOIN (SELECT o_orderkey, o_totalprice + 1 AS p FROM orders WHERE o_orderkey % 3 = 0) r ON l.o_orderkey = r.o_orderkey")
def upsert_right_wins(spark, sf):
    o = orders(spark, sf)
    left = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_totalprice").alias("old"))
    right = o.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("new"))
    return left.join(right, "o_orderkey", "full_outer").select("o_orderkey", F.coalesce("new", "old").alias("price"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'starting' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END AS version FROM orders")
def compare_and_set_claim(spark, sf):
    open_ = F.col("o_orderstatus") == "O"
    return orders(spark, sf).select("o_orderkey", F.when(open_, "starting").otherwise(F.col("o_orderstatus")).alias("status"), F.when(open_, 2).otherwise(1).alias("version"))


@query(f"""WITH m AS (SELECT l_orderkey, max(l_linenumber) AS latest, count(*) AS attempts FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN attempts >= 5 THEN 'failed' WHEN latest IS NULL THEN 'queued' ELSE 'retry' END AS status FROM orders LEFT JOIN m ON l_orderkey = o_orderkey""")
def crash_recovery(spark, sf):
    m = lineitem(spark, sf).groupBy("l_orderkey").agg(F.max("l_linenumber").alias("latest"), F.count("*").alias("attempts"))
    s = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("attempts") >= 5, "failed").when(F.col("latest").isNull(), "queued").otherwise("retry")
    return orders(spark, sf).join(m, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", s.alias("status"))


@query("""WITH e AS (SELECT p_partkey, trim(regexp_replace(lower(trim(t)), '[\\s_-]+', '_', 'g'), '_') AS tag, t, pos FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS t, generate_subscripts(string_split(p_type, ' '), 1) AS pos FROM part)),
d AS (SELECT p_partkey, tag, min(struct_pack(k := p_partkey, pos := pos, t := t)) AS f FROM e GROUP BY 1, 2)
SELECT tag, count(*) AS rows, min(f).t AS spelling FROM d GROUP BY tag""")
def tag_facets(spark, sf):
    """Rows per normalised tag and its first spelling."""
    e = part(spark, sf).select("p_partkey", F.posexplode(F.split("p_type", " ")).alias("pos", "t"))
    e = e.withColumn("tag", F.btrim(F.regexp_replace(F.lower(F.trim("t")), r"[\s_-]+", "_"), F.lit("_")))
    d = e.groupBy("p_partkey", "tag").agg(F.min(F.struct("p_partkey", "pos", "t")).alias("f"))
    return d.groupBy("tag").agg(F.count("*").alias("rows"), F.min("f")["t"].alias("spelling"))


@query("WITH t AS (SELECT p_partkey, [p_type, CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END] AS tags FROM part) SELECT p_partkey FROM t WHERE NOT list_has_any(tags, ['ECONOMY']) AND list_has_any(tags, ['SMALL', 'LARGE']) AND list_has_any(tags, ['even'])")
def tag_filter(spark, sf):
    """Excluded tags win; any tag inside a namespace, all namespaces."""
    tags = F.array("p_type", F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd"))
    has = lambda *x: F.arrays_overlap(tags, F.array(*map(F.lit, x)))
    return part(spark, sf).where(~has("ECONOMY") & has("SMALL", "LARGE") & has("even")).select("p_partkey")


@query("""SELECT user_id, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type <> 'purchase') AS fail, round(greatest(10.0 * count(*) FILTER (event_type = 'purchase') / count(*), 0.1), 6) AS weight FROM events GROUP BY user_id""")
def country_stats(spark, sf):
    """Successes, failures and the weight of each key: ten times its success rate, 0.1 at least."""
    ok = F.count_if(F.col("event_type") == "purchase")
    return events(spark, sf).groupBy("user_id").agg(ok.alias("ok"), (F.count("*") - ok).alias("fail"), F.round(F.greatest(10.0 * ok / F.count("*"), F.lit(0.1)), 6).alias("weight"))


@query("SELECT n_nationkey, CAST(least(60 * pow(2, n_nationkey), 600) AS DOUBLE) AS seconds FROM nation")
def cooldown_seconds(spark, sf):
    return nation(spark, sf).select("n_nationkey", F.least(60 * F.pow(F.lit(2.0), "n_nationkey"), F.lit(600.0)).alias("seconds"))


@query("SELECT o_orderkey, CAST(least(30 * pow(2, greatest(0, o_orderkey % 9 - 1)), 900) AS DOUBLE) AS delay FROM orders")
def retry_delay(spark, sf):
    return orders(spark, sf).select("o_orderkey", F.least(30 * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.col("o_orderkey") % 9 - 1)), F.lit(900.0)).alias("delay"))


@query("SELECT doc_id, unnest(range(1, CAST(n_chars // 1000 + 2 AS BIGINT))) AS unit FROM documents")
def plan_units(spark, sf):
    """One unit for each 1,000 characters begun. Budgets do not cut the list: ``planned_units`` marks what exceeds one."""
    n = F.floor(F.col("n_chars") / 1000) + 1
    return table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("unit"))


@query("""WITH s AS (SELECT n_nationkey, count(c_custkey) AS samples FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
SELECT n_nationkey, samples, CASE WHEN samples > 0 AND n_nationkey % 2 = 0 THEN 'verified' ELSE 'weak' END AS confidence FROM s""")
def evidence_confidence(spark, sf):
    s = nation(spark, sf).join(customer(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("samples"))
    return s.select("n_nationkey", "samples", F.when((F.col("samples") > 0) & (F.col("n_nationkey") % 2 == 0), "verified").otherwise("weak").alias("confidence"))


@query("SELECT n_nationkey, n_name, o_priority, cnt FROM (SELECT n_nationkey, n_name, o_orderpriority AS o_priority, count(*) AS cnt FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL)")
def scheme_counts(spark, sf):
    j = orders(spark, sf).join(customer(spark, sf), F.col("o_custkey") == F.col("c_custkey")).join(nation(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_nationkey", "n_name", F.col("o_orderpriority").alias("o_priority")).agg(F.count("*").alias("cnt"))


@query("""SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey UNION SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_orderkey = c_custkey)""")
def or_join(spark, sf):
    """Same owner or same number: two equi joins and a union, never a nested loop."""
    c, o = customer(spark, sf).select("c_custkey"), orders(spark, sf).select("o_custkey", "o_orderkey")
    a, b = c.join(o, F.col("o_custkey") == F.col("c_custkey")), c.join(o, F.col("o_orderkey") == F.col("c_custkey"))
    return a.select("c_custkey", "o_orderkey").union(b.select("c_custkey", "o_orderkey")).distinct()


@query("""WITH m AS (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1), e AS (SELECT l_orderkey, unnest(range(1, n + 1)) AS page FROM m)
SELECT l_orderkey, page FROM e WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = e.l_orderkey AND x.l_linenumber = e.page)""")
def missing_pages(spark, sf):
    """Expected pages 1 to N that the inventory lacks."""
    li = lineitem(spark, sf)
    e = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n")).select("l_orderkey", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("page"))
    have = li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("page"))
    return e.join(have, ["l_orderkey", "page"], "left_anti")


@query("""SELECT user_id, CAST(max(run) AS BIGINT) AS longest_fail_run FROM (SELECT user_id, grp, count(*) FILTER (event_type <> 'purchase') AS run FROM (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events) GROUP BY 1, 2) GROUP BY 1""")
def consecutive_failures(spark, sf):
    """The longest run of failures between successes (gaps and islands)."""
    ok = (F.col("event_type") == "purchase").cast("int")
    e = events(spark, sf).withColumn("grp", F.sum(ok).over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.groupBy("user_id", "grp").agg(F.count_if(F.col("event_type") != "purchase").alias("run")).groupBy("user_id").agg(F.max("run").alias("longest_fail_run"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def event_fold(spark, sf):
    """The last event of each task, as the streaming fold leaves it."""
    last = events(spark, sf).groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x"))
    return last.select("user_id", "x.event_id", "x.event_type")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)")
def new_only_difference(spark, sf):
    """Set difference of keys."""
    return supplier(spark, sf).select("s_suppkey").join(lineitem(spark, sf).where("l_returnflag = 'R' AND l_quantity > 49"), F.col("s_suppkey") == F.col("l_suppkey"), "left_anti")


@query("SELECT o_custkey, CAST(least(100, floor(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*) + 0.5)) AS BIGINT) AS percent FROM orders GROUP BY o_custkey")
def batch_percent(spark, sf):
    p = F.least(F.lit(100), F.floor(100.0 * F.count_if(F.col("o_orderstatus") == "F") / F.count("*") + 0.5))
    return orders(spark, sf).groupBy("o_custkey").agg(p.cast("long").alias("percent"))


@query("SELECT s_suppkey, coalesce(n_name, 'default') AS policy FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey = 1")
def policy_merge(spark, sf):
    """The site's policy where there is one, else the default."""
    n = nation(spark, sf).where("n_regionkey = 1")
    return supplier(spark, sf).join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("default")).alias("policy"))


@query("SELECT s_suppkey, s_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_suppkey) AS n FROM supplier) WHERE n = 1")
def best_node_pick(spark, sf):
    w = Window.partitionBy("s_nationkey").orderBy(F.desc_nulls_last("s_acctbal"), "s_suppkey")
    return supplier(spark, sf).withColumn("n", F.row_number().over(w)).where("n = 1").select("s_suppkey", "s_nationkey")


@query("SELECT s_suppkey FROM supplier ORDER BY (s_suppkey - 17 + 1000000) % 1000000, s_suppkey LIMIT 1")
def round_robin_pick(spark, sf):
    return supplier(spark, sf).orderBy(F.pmod(F.col("s_suppkey") - 17, F.lit(1000000)), "s_suppkey").limit(1).select("s_suppkey")
