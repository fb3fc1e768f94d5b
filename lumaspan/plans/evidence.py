"""Queries of evidence, planning and selection rules: pairs' geometry, units and budgets, merges, aliases, nodes, manifests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumaspan.functions import rules as R
from lumaspan.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f
    return register


@query("""SELECT x.vec_id AS a, y.vec_id AS b, CASE WHEN y.vec_id IS NOT NULL THEN round(least(1.0, greatest(-1.0, list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])))), 6) END AS similarity FROM embeddings x LEFT JOIN embeddings y ON y.vec_id = x.vec_id + 1""")
def embedding_similarity(spark, sf):
    """The clipped dot product of a row and the next; null where there is none."""
    e = table(spark, sf, "embeddings")
    x, y = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("u")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    return x.join(y, F.col("b") == F.col("a") + 1, "left").select("a", "b", F.round(R.similarity(F.col("u"), F.col("v")), 6).alias("similarity"))


@query("""WITH p AS (SELECT p_partkey AS a, lead(p_partkey) OVER w AS b, p_size AS w1, p_retailprice AS h1, lead(p_size) OVER w AS w2, lead(p_retailprice) OVER w AS h2 FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey))
SELECT a, b, round(abs(ln((w1 / h1) / (w2 / h2))), 6) AS aspect_delta, round(greatest(w1 * h1, w2 * h2) / least(w1 * h1, w2 * h2), 6) AS resolution_ratio FROM p WHERE b IS NOT NULL""")
def pair_geometry(spark, sf):
    """Log ratio of the aspects and ratio of the areas of neighbours by key inside a group."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    nxt = lambda c: F.lead(c).over(w)
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("a"), nxt("p_partkey").alias("b"), F.col("p_size").alias("w1"), F.col("p_retailprice").alias("h1"), nxt("p_size").alias("w2"), nxt("p_retailprice").alias("h2")).where("b is not null")
    return p.select("a", "b", F.round(R.aspect_delta("w1", "h1", "w2", "h2"), 6).alias("aspect_delta"), F.round(R.resolution_ratio("w1", "h1", "w2", "h2"), 6).alias("resolution_ratio"))


@query("""SELECT doc_id, sha256(CAST(json_array(source, 'a"b' || lang, ['--range', CAST(doc_id AS VARCHAR)]) AS VARCHAR)) AS digest FROM documents""")
def work_unit_digest(spark, sf):
    url, args = F.concat(F.lit('a"b'), "lang"), F.array(F.lit("--range"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", R.unit_digest(F.col("source"), url, args).alias("digest"))


@query("""SELECT o_orderkey, (o_orderstatus <> 'F' AND o_orderkey % 7 > 0 AND o_orderkey % 11 > 0 AND 100 - o_orderkey % 11 * 9 < o_orderkey % 7 * 10) AS skipped FROM orders""")
def fetch_throttle(spark, sf):
    """A fetch is skipped inside its interval unless it is forced, has no interval or was never made."""
    o = table(spark, sf, "orders")
    force, interval, last = F.col("o_orderstatus") == "F", F.col("o_orderkey") % 7 * 10, F.col("o_orderkey") % 11 * 9
    return o.select("o_orderkey", R.should_skip(force, interval, last, F.lit(100)).alias("skipped"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type <> 'purchase') AS failed FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 2000) GROUP BY user_id""")
def tail_counts(spark, sf):
    """Outcomes by key over the last 2,000 rows of the log, the tail that is read."""
    e = table(spark, sf, "events").orderBy(F.desc("event_id")).limit(2000)
    return e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("ok"), F.count_if(F.col("event_type") != "purchase").alias("failed"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_returnflag = 'R' THEN least(600, 60 * pow(2, least(l_linenumber - 1, 4))) ELSE 30 * greatest(1, least(l_linenumber, 4)) END AS DOUBLE) AS seconds FROM lineitem""")
def node_cooldown(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", R.node_cooldown(F.col("l_returnflag") == "R", F.col("l_linenumber"), F.col("l_linenumber")).alias("seconds"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN chr(CAST(65 + s_nationkey AS INT)) || 'X' WHEN 1 THEN 'US' WHEN 2 THEN 'JP' ELSE '??' END AS country, CASE WHEN s_suppkey % 4 < 2 THEN s_nationkey * 60 END AS seconds FROM supplier""")
def endpoint_country(spark, sf):
    """Country and session time of endpoint lines of four forms."""
    k = F.col("s_suppkey") % 4
    letter = F.char(F.lit(97) + F.col("s_nationkey"))
    line = F.when(k == 0, F.concat(F.lit("http://u_zone_"), letter, F.lit("x_sessTime-"), "s_nationkey", F.lit(":p@h.example.net:80"))).when(
        k == 1, F.concat(F.lit("http://a-us-sid-7-sessTime-"), "s_nationkey", F.lit(":p@h.example.net:80"))).when(k == 2, F.lit("jp.example.net:8080")).otherwise(F.lit("socks5://host.example.net:1080"))
    return table(spark, sf, "supplier").select("s_suppkey", R.country_of(line).alias("country"), R.session_seconds(line).alias("seconds"))


@query("""WITH u AS (SELECT c_custkey, o_orderkey, least(5, 1 + o_orderkey % 6) AS n FROM customer JOIN orders ON o_custkey = c_custkey),
r AS (SELECT *, sum(n) OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS running FROM u)
SELECT c_custkey, o_orderkey, CAST(unnest(range(1, CAST(n + 1 AS BIGINT))) AS BIGINT) AS item, running > 40 AS over_budget FROM r""")
def planned_units(spark, sf):
    """A candidate becomes n units; those that pass the batch's budget are marked, as the planner's error is."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    n = F.least(F.lit(5), F.lit(1) + F.col("o_orderkey") % 6).cast("long")
    r = o.select("c_custkey", "o_orderkey", n.alias("n")).withColumn("running", F.sum("n").over(Window.partitionBy("c_custkey").orderBy("o_orderkey")))
    return r.select("c_custkey", "o_orderkey", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("item"), (F.col("running") > 40).alias("over_budget"))


@query("""WITH a AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT o_orderkey, 'crawl:' || o_custkey || ':' || k || ':' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 48) AS unit_key, printf('%02d-%s/%04d', o_custkey % 100, substr(o_orderpriority, 3), k) AS path FROM a""")
def unit_keys(spark, sf):
    """Idempotency key and output path of each unit by its place in the batch."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    a = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", k.alias("k"))
    digest = F.substring(F.sha2(F.encode(F.col("o_orderkey").cast("string"), "utf-8"), 256), 1, 48)
    key = F.concat_ws(":", F.lit("crawl"), "o_custkey", "k", digest)
    return a.select("o_orderkey", key.alias("unit_key"), F.format_string("%02d-%s/%04d", F.col("o_custkey") % 100, F.substring("o_orderpriority", 3, 99), "k").alias("path"))


@query("""SELECT coalesce(n.k, o.k) AS k, coalesce(nullif(n.name, ''), o.name) AS name, CASE WHEN o.k IS NULL THEN 'verified' WHEN n.k IS NULL THEN o.status ELSE 'verified' END AS status
FROM (SELECT s_nationkey AS k, min(CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END) AS name FROM supplier GROUP BY 1) n FULL JOIN (SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_regionkey = 1 THEN 'verified' ELSE 'weak' END AS status FROM nation) o ON n.k = o.k""")
def profile_merge(spark, sf):
    """New evidence by key: non-empty fields replace old ones, a match lifts weak rows to verified, the rest is added."""
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min(F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name"))).alias("new"), F.lit(True).alias("has_new"))
    o = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("old"), F.when(F.col("n_regionkey") == 1, "verified").otherwise("weak").alias("was"))
    return s.join(o, "k", "full_outer").select("k", F.coalesce(F.nullif("new", F.lit("")), "old").alias("name"), F.when(F.col("has_new"), "verified").otherwise(F.col("was")).alias("status"))


@query("""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def first_wins(spark, sf):
    """The first row of each (source, content): an aggregate, not a sort of the texts."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2(F.encode("text", "utf-8"), 256).alias("h"))
    return d.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@query("""WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS t, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part),
d AS (SELECT p_partkey, lower(t) AS k, min(pos) AS pos, arg_min(t, pos) AS term FROM t WHERE length(t) >= 2 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY regexp_full_match(k, '[\\x00-\\x7F]*'), pos) AS place FROM d)
SELECT p_partkey, string_agg(term, '|' ORDER BY place) AS terms FROM r WHERE place <= 4 GROUP BY 1""")
def alias_terms(spark, sf):
    """Terms of two letters or more, distinct by key, non-ASCII first, four at most. Sorted inside the row: no shuffle."""
    words = F.transform(F.split("p_name", " "), lambda t, i: F.struct(t.rlike(r"^[\x00-\x7F]*$").alias("ascii"), i.alias("pos"), t.alias("t")))
    kept = F.filter(words, lambda w: F.length(w.t) >= 2)
    first = F.filter(kept, lambda w: ~F.exists(kept, lambda v: (F.lower(v.t) == F.lower(w.t)) & (v.pos < w.pos)))
    out = F.transform(F.slice(F.array_sort(first), 1, 4), lambda w: w.t)
    return table(spark, sf, "part").select("p_partkey", F.array_join(out, "|").alias("terms")).where("terms <> ''")


@query("""WITH w AS (SELECT s_nationkey, s_suppkey, -ln(((('0x' || substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 8))::BIGINT) + 1) / 4294967297.0::DOUBLE) / greatest(abs(s_acctbal), 0.1) AS k FROM supplier)
SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY k, s_suppkey) AS n FROM w) WHERE n <= 3""")
def weighted_pick(spark, sf):
    """Three of each group drawn by weight without replacement: least exponential keys of a fixed hash, so reruns agree."""
    u = (F.conv(F.substring(F.md5(F.encode(F.col("s_suppkey").cast("string"), "utf-8")), 1, 8), 16, 10).cast("long") + 1) / F.lit(4294967297.0)
    k = -F.log(u) / F.greatest(F.abs("s_acctbal"), F.lit(0.1))
    r = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(k, "s_suppkey"))
    return table(spark, sf, "supplier").withColumn("n", r).where("n <= 3").select("s_nationkey", "s_suppkey")


@query("""SELECT least(ua, ub) AS a, greatest(ua, ub) AS b, max(similarity) AS similarity FROM (SELECT x.vec_id // 5 AS ua, y.vec_id // 5 AS ub, round(list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings x JOIN embeddings y ON y.vec_id IN (x.vec_id + 1, x.vec_id + 7)) WHERE ua <> ub GROUP BY 1, 2""")
def contracted_edges(spark, sf):
    """Edges between members become edges between units: the best score of each, no edge of a unit to itself."""
    e = table(spark, sf, "embeddings")
    x = e.select(F.col("vec_id").alias("x"), F.col("embedding").alias("u"), F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 7)).alias("y"))
    j = x.join(e.select(F.col("vec_id").alias("y"), F.col("embedding").alias("v")), "y")
    unit = lambda c: F.floor(F.col(c) / 5)
    j = j.select(unit("x").alias("p"), unit("y").alias("q"), F.round(R.dot(F.col("u"), F.col("v")), 6).alias("s")).where("p <> q")
    return j.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.max("s").alias("similarity"))


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderkey) AS ids, count(*) FILTER (o_orderstatus = 'F') AS winners FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN n <> ids THEN 'repeated id' WHEN winners = 0 THEN 'no winner' ELSE 'several winners' END AS violation FROM g WHERE n <> ids OR winners <> 1""")
def manifest_violations(spark, sf):
    """Groups with a repeated id, without a winner or with several."""
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("ids"), F.count_if(F.col("o_orderstatus") == "F").alias("winners"))
    v = F.when(F.col("n") != F.col("ids"), "repeated id").when(F.col("winners") == 0, "no winner").otherwise("several winners")
    return g.where("n <> ids or winners <> 1").select("o_custkey", v.alias("violation"))


@query("""SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS selected, greatest(0, count(*) - count(*) FILTER (o_orderstatus = 'F')) AS rejected FROM orders GROUP BY 1""")
def apply_counts(spark, sf):
    s = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), s.alias("selected"), F.greatest(F.lit(0).cast("long"), F.count("*") - s).alias("rejected"))


@query("""SELECT event_id, CAST(least(greatest(coalesce(TRY_CAST(regexp_extract(props, '"k":\\s*(-?\\d+)', 1) AS BIGINT), 0), 0), 1000000000) AS BIGINT) AS counter, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'other' END AS kind FROM events""")
def safe_counters(spark, sf):
    """Counters bounded to 0 .. 10^9; kinds outside the list become other."""
    n = F.expr(r"""try_cast(regexp_extract(props, '"k":\\s*(-?\\d+)', 1) AS BIGINT)""")
    kind = F.col("event_type")
    return table(spark, sf, "events").select("event_id", F.least(F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)), F.lit(10**9)).cast("long").alias("counter"), F.when(kind.isin("click", "view", "purchase"), kind).otherwise("other").alias("kind"))


@query("""SELECT CASE WHEN bool_or(s_acctbal > 0 AND n_name IS NOT NULL) THEN 'us' END AS preferred FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey = 1""")
def preferred_tag(spark, sf):
    """The home tag if any healthy node has it, else none."""
    n = table(spark, sf, "nation").where("n_regionkey = 1")
    j = table(spark, sf, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return j.agg(F.when(F.bool_or((F.col("s_acctbal") > 0) & F.col("n_name").isNotNull()), "us").alias("preferred"))


@query("""SELECT conv_id, string_agg(content, chr(10) ORDER BY turn) AS log, CAST(count(*) AS BIGINT) AS lines FROM (SELECT conv_id, turn, role || ': ' || text AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 5 GROUP BY 1""")
def ordered_log(spark, sf):
    """The last five lines of each task's log in order."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), F.col("text")).alias("c"), F.row_number().over(w).alias("n")).where("n <= 5")
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "c"))), lambda s: s.c), "\n").alias("log"), F.count("*").alias("lines"))


@query("""WITH a AS (SELECT c_custkey, c_nationkey, c_mktsegment, unnest([c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS term, unnest([0, 1]) AS pos FROM customer),
h AS (SELECT c_nationkey % 7 AS id, pos, min(c_custkey) AS first, term FROM a GROUP BY 1, 2, 4)
SELECT id, string_agg(term, '|' ORDER BY pos, first) AS terms, min(pos) AS best FROM h GROUP BY id""")
def merged_alias_hits(spark, sf):
    """Hits of several search terms become one row an id: its terms in order of search, the primary term first."""
    terms = F.posexplode(F.array("c_mktsegment", F.col("c_nationkey").cast("string")))
    a = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 7).alias("id"), terms.alias("pos", "term"))
    h = a.groupBy("id", "pos", "term").agg(F.min("c_custkey").alias("first"))
    in_order = F.array_sort(F.collect_list(F.struct("pos", "first", "term")))
    return h.groupBy("id").agg(F.array_join(F.transform(in_order, lambda x: x.term), "|").alias("terms"), F.min("pos").alias("best"))


@query("""SELECT p_partkey, l_orderkey IS NULL AS missing, coalesce(t, replace(p_name, '&amp;', '&')) AS title FROM part LEFT JOIN (SELECT l_partkey, min(l_orderkey) AS l_orderkey, min(l_returnflag || l_linestatus) AS t FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey""")
def metadata_enrichment(spark, sf):
    """Metadata by id; rows without any stay and are marked."""
    m = table(spark, sf, "lineitem").where("l_quantity > 45").groupBy("l_partkey").agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("t"))
    j = table(spark, sf, "part").join(m, F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.select("p_partkey", F.col("l_partkey").isNull().alias("missing"), F.coalesce("t", F.replace("p_name", F.lit("&amp;"), F.lit("&"))).alias("title"))


@query("""SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' AND o_orderstatus IN ('O', 'P') THEN 'cancelled' WHEN c_mktsegment = 'MACHINERY' AND o_orderstatus = 'F' THEN 'queued' ELSE o_orderstatus END AS status, c_mktsegment = 'BUILDING' AND o_orderstatus = 'P' AS cancel_requested FROM orders JOIN customer ON c_custkey = o_custkey""")
def cancel_and_retry(spark, sf):
    """Cancelled batches take their open tasks along, running ones by request; retried batches queue their finished ones again."""
    j = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
    batch, s = F.col("c_mktsegment"), F.col("o_orderstatus")
    status = F.when((batch == "BUILDING") & s.isin("O", "P"), "cancelled").when((batch == "MACHINERY") & (s == "F"), "queued").otherwise(s)
    return j.select("o_orderkey", status.alias("status"), ((batch == "BUILDING") & (s == "P")).alias("cancel_requested"))


@query("""WITH d AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS selected, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN d.n IS NULL THEN 'pending' WHEN o_orderstatus = 'F' AND selected THEN 'applied' WHEN selected THEN 'decided' ELSE 'kept' END AS state, coalesce(d.n, 0) AS images FROM orders LEFT JOIN d ON l_orderkey = o_orderkey""")
def review_states(spark, sf):
    """Decisions joined to their groups: pending without any, decided, applied when the batch is done, else kept."""
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("selected"), F.count("*").alias("n"))
    j = table(spark, sf, "orders").join(d, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    state = F.when(F.col("n").isNull(), "pending").when((F.col("o_orderstatus") == "F") & F.col("selected"), "applied").when(F.col("selected"), "decided").otherwise("kept")
    return j.select("o_orderkey", state.alias("state"), F.coalesce("n", F.lit(0).cast("long")).alias("images"))


@query("""SELECT event_id, list_sort(list_intersect([event_type, CAST(user_id % 3 AS VARCHAR)], ['view', '1', 'purchase']))::VARCHAR[] AS shared, len(list_filter([event_type, CAST(user_id % 3 AS VARCHAR)], lambda x: NOT list_contains(['view', '1', 'purchase'], x))) = 0 AS is_subset FROM events""")
def key_sets(spark, sf):
    """What two sets of keys share, and whether the first lies in the second."""
    own, other = F.array("event_type", (F.col("user_id") % 3).cast("string")), F.array(*map(F.lit, ("view", "1", "purchase")))
    return table(spark, sf, "events").select("event_id", F.array_sort(F.array_intersect(own, other)).alias("shared"), (F.size(F.array_except(own, other)) == 0).alias("is_subset"))


@query("""WITH s AS (SELECT n_regionkey, bool_or(n_nationkey % 9 = 0) AS failed, string_agg(n_name, '; ' ORDER BY n_name) FILTER (n_nationkey % 9 = 0) AS message FROM nation GROUP BY 1)
SELECT r_regionkey, CASE WHEN failed THEN 'partial' ELSE 'complete' END AS state, coalesce(message, '') AS message FROM region LEFT JOIN s ON n_regionkey = r_regionkey""")
def failure_propagation(spark, sf):
    """A failed source makes those that depend on it partial, with its messages."""
    bad = F.col("n_nationkey") % 9 == 0
    names = F.slice(F.array_sort(F.collect_list(F.when(bad, F.col("n_name")))), 1, 3)
    s = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.bool_or(bad).alias("failed"), F.array_join(names, "; ").alias("message"))
    j = table(spark, sf, "region").join(s, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("r_regionkey", F.when(F.col("failed"), "partial").otherwise("complete").alias("state"), F.coalesce("message", F.lit("")).alias("message"))
