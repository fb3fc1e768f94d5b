"""Queries of the state operators: orders stand for addresses or tasks, lineitem for their works, supplier for nodes, part for images."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaspan.operators import state as S
from lumaspan.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f
    return register


STATES = ("succeeded", "failed", "cancelled", "planning", "pending", "succeeded", "succeeded")
STATE_SQL = "CASE o_orderkey * 7 % 31 % 7 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATES)) + " END"
ADDRESS_SQL = f"(SELECT o_custkey AS batch, o_orderkey % 3 AS source, o_orderkey AS address, {STATE_SQL} AS status, o_orderkey % 4 AS skipped FROM orders)"


def _addresses(spark, sf):
    at = F.col("o_orderkey") * 7 % 31 % 7
    state = F.element_at(F.array(*map(F.lit, STATES)), (at + 1).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("batch"), (F.col("o_orderkey") % 3).alias("source"), F.col("o_orderkey").alias("address"), state.alias("status"), (F.col("o_orderkey") % 4).alias("skipped"))


@query(f"""SELECT batch, source, CASE WHEN bool_and(status = 'succeeded') THEN 'succeeded' WHEN bool_or(status IN ('planning', 'running')) THEN 'running'
WHEN bool_or(status = 'failed') AND bool_and(status IN ('succeeded', 'failed', 'cancelled')) THEN 'completed_with_errors' WHEN bool_and(status = 'cancelled') THEN 'cancelled' ELSE 'pending' END AS status,
count(*) AS addresses, CAST(sum(skipped) AS BIGINT) AS skipped FROM {ADDRESS_SQL} GROUP BY batch, source""")
def source_rollup(spark, sf):
    return S.source_rollup(_addresses(spark, sf), "batch", "source", "status", "skipped")


@query(f"""SELECT batch, source, address, status FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY source, address) AS n FROM {ADDRESS_SQL} WHERE status NOT IN ('succeeded', 'failed', 'cancelled')) WHERE n = 1""")
def next_address(spark, sf):
    return S.next_open(_addresses(spark, sf), "batch", "status", ["source", "address"], ["source", "address", "status"])


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def oldest_review(spark, sf):
    """The oldest pending review, the one that is claimed."""
    return table(spark, sf, "orders").where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_custkey")


IMAGE_SQL = "(SELECT l_orderkey AS grp, CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'failed' ELSE 'kept' END AS disposition FROM lineitem)"


def _images(spark, sf):
    d = F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "failed").otherwise("kept")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("grp"), d.alias("disposition"))


@query(f"""SELECT o_custkey, count(*) FILTER (disposition = 'rejected') AS rejected, count(*) FILTER (disposition = 'failed') AS failed FROM {IMAGE_SQL} JOIN orders ON o_orderkey = grp WHERE o_orderstatus = 'F' GROUP BY o_custkey""")
def automatic_counts(spark, sf):
    """Rejected and failed images of the automatic groups of each batch."""
    groups = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("grp"))
    d = F.col("disposition")
    return _images(spark, sf).join(groups, "grp").groupBy("o_custkey").agg(*S.count_where(rejected=d == "rejected", failed=d == "failed"))


@query(f"""SELECT grp, count(*) FILTER (disposition = 'kept') AS kept, count(*) FILTER (disposition = 'rejected') AS rejected, count(*) FILTER (disposition NOT IN ('kept', 'rejected')) AS failed,
CASE WHEN count(*) FILTER (disposition NOT IN ('kept', 'rejected')) > 0 THEN 'apply_failed' ELSE 'applied' END AS status FROM {IMAGE_SQL} GROUP BY grp""")
def applied_reviews(spark, sf):
    """Counts of an applied review and the status that follows from them."""
    d = F.col("disposition")
    out = _images(spark, sf).groupBy("grp").agg(*S.count_where(kept=d == "kept", rejected=d == "rejected", failed=~d.isin("kept", "rejected")))
    return out.withColumn("status", F.when(F.col("failed") > 0, "apply_failed").otherwise("applied"))


@query("""SELECT p_brand, count(*) FILTER (n > 1 AND exact) AS exact, count(*) FILTER (n > 1 AND NOT exact) AS compression, count(*) FILTER (n = 1) AS single
FROM (SELECT p_brand, p_size, count(*) AS n, min(p_partkey) % 2 = 0 AS exact FROM part GROUP BY 1, 2) GROUP BY 1""")
def group_kinds(spark, sf):
    """Exact, compression and single groups."""
    g = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"), (F.min("p_partkey") % 2 == 0).alias("e"))
    several = F.col("n") > 1
    return g.groupBy("p_brand").agg(*S.count_where(exact=several & F.col("e"), compression=several & ~F.col("e"), single=~several))


@query("SELECT o_orderpriority AS site, count(*) AS active, CAST(greatest(0, 2000 - count(*)) AS BIGINT) AS free FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1")
def active_by_site(spark, sf):
    """Active tasks of each site and what its cap leaves."""
    a = table(spark, sf, "orders").where("o_orderstatus IN ('O', 'P')").groupBy(F.col("o_orderpriority").alias("site")).agg(F.count("*").alias("active"))
    return a.withColumn("free", F.greatest(F.lit(0), 2000 - F.col("active")).cast("long"))


@query("SELECT s_nationkey, count(*) AS total, count(*) FILTER (s_acctbal > 0) AS healthy FROM supplier GROUP BY 1")
def probe_summary(spark, sf):
    return table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("total"), *S.count_where(healthy=F.col("s_acctbal") > 0))


@query("""SELECT c_nationkey, CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS addresses, CAST(sum(CASE WHEN c_acctbal <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS weak, count(DISTINCT c_mktsegment) AS sources FROM customer GROUP BY 1""")
def search_rollup(spark, sf):
    """Addresses, weak evidence and sources of a search, from the sources' own lists."""
    verified = F.col("c_acctbal") > 0
    lists = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count_if(verified).alias("a"), F.count_if(~verified).alias("w"))
    return lists.groupBy("c_nationkey").agg(F.sum("a").alias("addresses"), F.sum("w").alias("weak"), F.count("*").alias("sources"))


ERROR_SQL = "CASE o_orderkey % 5 WHEN 0 THEN 'authentication' WHEN 1 THEN 'proxy_failure' ELSE 'not_found' END"


@query(f"""SELECT o_custkey, list_sort(coalesce(list(DISTINCT site) FILTER (e = 'authentication' AND site <> 'unknown'), []))::VARCHAR[] AS sites, bool_or(contains(e, 'proxy')) AS proxy_issue
FROM (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE o_orderpriority END AS site, {ERROR_SQL} AS e FROM orders) GROUP BY 1""")
def recovery_targets(spark, sf):
    k = F.col("o_orderkey")
    t = table(spark, sf, "orders").select("o_custkey", F.when(k % 3 == 0, "unknown").otherwise(F.col("o_orderpriority")).alias("site"), F.when(k % 5 == 0, "authentication").when(k % 5 == 1, "proxy_failure").otherwise("not_found").alias("e"))
    return S.recovery_targets(t, "o_custkey", "site", "e")


@query("SELECT o_custkey, count(DISTINCT CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END) AS nodes FROM orders GROUP BY 1")
def distinct_nodes(spark, sf):
    """Distinct node ids that are neither null nor empty."""
    node = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 8 == 0, "")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct(F.when(node != "", node)).alias("nodes"))


@query("SELECT s_nationkey, bool_and(s_suppkey % 3 = 0 OR s_acctbal > -500) AS ready FROM supplier GROUP BY 1")
def readiness(spark, sf):
    c = table(spark, sf, "supplier").select("s_nationkey", F.when(F.col("s_suppkey") % 3 == 0, False).when(F.col("s_suppkey") % 3 == 1, True).alias("required"), F.when(F.col("s_acctbal") > 0, "ok").when(F.col("s_acctbal") > -500, "degraded").alias("state"))
    return S.ready(c, "s_nationkey", "required", "state", ("ok", "degraded"))


@query("""SELECT DISTINCT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20)""")
def done_source_keys(spark, sf):
    """Source keys of finished tasks of a site that are among the keys asked for."""
    asked = table(spark, sf, "part").where("p_size < 20").select(F.col("p_partkey").alias("l_partkey"))
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").join(table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'"), F.col("c_custkey") == F.col("o_custkey"))
    li = table(spark, sf, "lineitem").join(asked, "l_partkey", "left_semi")
    return li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select("l_partkey").distinct()


@query("""SELECT p_partkey, n FROM part JOIN (SELECT p_brand AS b, p_size AS s, count(*) AS n FROM part GROUP BY 1, 2) ON b = p_brand AND s = p_size""")
def images_with_groups(spark, sf):
    """Images joined to their groups by both keys."""
    p = table(spark, sf, "part")
    return p.join(p.groupBy("p_brand", "p_size").agg(F.count("*").alias("n")), ["p_brand", "p_size"]).select("p_partkey", "n")


@query("""SELECT coalesce(n.k, o.k) AS k, coalesce(CASE WHEN n.name <> '' THEN n.name END, o.name) AS name, coalesce(n.size, o.size) AS size
FROM (SELECT p_partkey AS k, p_name AS name, p_size AS size FROM part WHERE p_partkey % 2 = 0) o FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE upper(p_name) END AS name, CASE WHEN p_partkey % 7 > 0 THEN p_size + 1 END AS size FROM part WHERE p_partkey % 3 = 0) n ON n.k = o.k""")
def directory_merge(spark, sf):
    """New entries by key; their non-empty fields replace old ones."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    old = p.where(k % 2 == 0).select(k.alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    new = p.where(k % 3 == 0).select(k.alias("k"), F.when(k % 5 == 0, "").otherwise(F.upper("p_name")).alias("name"), F.when(k % 7 > 0, F.col("p_size") + 1).alias("size"))
    return S.upserted(old, new, "k", ["name", "size"])


NODE_SQL = "(SELECT s_suppkey AS node, s_acctbal > 0 AS healthy, [CASE WHEN s_nationkey % 2 = 0 THEN 'us' ELSE 'jp' END, 'n' || s_nationkey] AS tags FROM supplier)"


def _nodes(spark, sf):
    tags = F.array(F.when(F.col("s_nationkey") % 2 == 0, "us").otherwise("jp"), F.concat(F.lit("n"), "s_nationkey"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_acctbal") > 0).alias("healthy"), tags.alias("tags"))


@query(f"SELECT node FROM {NODE_SQL} WHERE healthy AND list_has_any(tags, ['us', 'n3']) AND node % 5 > 0 AND node % 2 = 0")
def eligible_nodes(spark, sf):
    n = _nodes(spark, sf)
    return S.eligible_nodes(n, "node", "tags", "healthy", n.where("node % 5 = 0"), n.where("node % 2 = 0"), ("us", "n3")).select("node")


@query(f"""SELECT node, healthy, healthy AND node % 4 <> 1 AND (node % 4 <> 2 OR node % 3 = 0) AS retry_eligible, CAST(node % 4 = 1 AS INT) AS ref_count, CAST(1000 + CASE WHEN node % 4 = 2 THEN node % 3 * 30 ELSE 0 END AS DOUBLE) AS cooldown_until FROM {NODE_SQL}""")
def node_rows(spark, sf):
    n = _nodes(spark, sf)
    k = F.col("node")
    status = n.where(k % 4 > 0).select("node", (k % 4 == 1).alias("leased"), F.when(k % 4 == 2, k % 3 * 30.0).alias("cooldown_left"))
    return S.node_rows(n.select("node", "healthy"), status, "node", True, 1000.0)


@query("""SELECT substr(sha256(e), 1, 20) AS id, e AS endpoint, s AS scheme, name FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY s_suppkey) AS n FROM (SELECT s_suppkey, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'unknown' WHEN s_suppkey % 4 = 1 THEN 'socks5' ELSE 'http' END AS s, CASE WHEN s_suppkey % 9 > 0 THEN 'http://h' || s_nationkey END AS e FROM supplier) WHERE e IS NOT NULL AND s <> 'socks5') WHERE n = 1""")
def registered_nodes(spark, sf):
    k = F.col("s_suppkey")
    made = table(spark, sf, "supplier").select(k, F.col("s_name").alias("name"), F.when(k % 4 == 1, "SOCKS5").when(k % 4 > 1, "HTTP").otherwise("").alias("scheme"), F.when(k % 9 > 0, F.concat(F.lit("http://h"), "s_nationkey")).otherwise("").alias("endpoint"))
    return S.registered_nodes(made, "endpoint", "scheme", "name", "s_suppkey", socks=False)


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN p_partkey % 3 = 0 ELSE p_partkey % 2 = 0 END AS selected, p_size % 4 = 3 AS decided FROM part""")
def selection_modes(spark, sf):
    """Groups set to all, none or recommended; others keep their images as they are."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    images = p.select("p_partkey", F.col("p_size").alias("grp"), (k % 3 == 0).alias("recommended"), (k % 2 == 0).alias("selected"), F.lit(True).alias("decided"))
    mode = F.when(F.col("grp") % 4 == 0, "all").when(F.col("grp") % 4 == 1, "none").when(F.col("grp") % 4 == 2, "recommended")
    modes = images.select("grp").distinct().select("grp", mode.alias("mode")).where("mode IS NOT NULL")
    return S.chosen_images(images, modes, "grp", "recommended").select("p_partkey", "selected", "decided")


@query("SELECT p_partkey, p_size < 10 OR p_size > 40 AS visible FROM part")
def visible_addresses(spark, sf):
    """Weak evidence is hidden unless it is asked for."""
    weak, shown = F.col("p_size").between(10, 40), F.lit(False)
    return table(spark, sf, "part").select("p_partkey", (~weak | shown).alias("visible"))


@query("""SELECT l_orderkey AS task, count(*) AS files, CAST(sum(l_partkey) AS BIGINT) AS bytes FROM lineitem WHERE l_linenumber % 5 NOT IN (1, 2) GROUP BY 1""")
def artifact_totals(spark, sf):
    n = F.col("l_linenumber") % 5
    path = F.when(n == 1, "a/b.PART").when(n == 2, "a/.activity-7").when(n == 3, "a.part/c.png").otherwise("d.png")
    return S.artifact_totals(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task"), path.alias("path"), F.col("l_partkey").alias("n")), "task", "path", "n")


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 9 END, lower(p_name || p_partkey), p_name || p_partkey) AS ordinal FROM part""")
def manifest_order(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("duplicate", "unreadable", "single", "other"))), F.col("p_size") % 4 + 1)
    g = table(spark, sf, "part").select("p_partkey", "p_brand", kind.alias("kind"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"))
    return S.in_manifest_order(g, "p_brand", "kind", "path", {"duplicate": 0, "unreadable": 1, "single": 2}).select("p_partkey", "ordinal")


@query("""SELECT gid, min(page * 100 + pos) AS first FROM (SELECT page_id AS page, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS gid, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS pos FROM pages) GROUP BY gid""")
def result_links(spark, sf):
    """Each link of the result pages once, where it comes first."""
    links = F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    l = table(spark, sf, "pages").select("page_id", links.alias("pos", "gid")).select("gid", (F.col("page_id") * 100 + F.col("pos") + 1).alias("first"))  # noqa: E741
    return S.first_of(l, ["gid"], ["first"], ["first"])


@query("""WITH f AS (SELECT trim(n) AS name, min(pos) AS pos FROM (SELECT unnest(string_split(p_name, ' ')) AS n, p_partkey * 100 + generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part) WHERE trim(n) <> '' GROUP BY 1)
SELECT name, pos % 3 = 0 AS failed FROM (SELECT * FROM f ORDER BY pos LIMIT 20)""")
def profile_names(spark, sf):
    """Distinct names by first place, the 20 that are looked up, marked where the lookup failed."""
    n = table(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "n")).select(F.trim("n").alias("name"), (F.col("p_partkey") * 100 + F.col("i") + 1).alias("pos")).where("name <> ''")
    return n.groupBy("name").agg(F.min("pos").alias("pos")).orderBy("pos").limit(20).select("name", (F.col("pos") % 3 == 0).alias("failed"))


@query("""SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS source_order, CAST(i AS INT) AS address_order, 'https://h/' || o_orderkey || '/' || i AS url, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, 'default') AS policy
FROM orders, (SELECT unnest([1, 2]) AS i)""".replace("row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)", "dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)"))
def flattened_batches(spark, sf):
    """Sources x addresses with both ordinals; a source's own setting before the batch's."""
    k = F.col("o_orderkey")
    urls = F.array(*(F.concat(F.lit("https://h/"), k.cast("string"), F.lit(f"/{i}")) for i in (1, 2)))
    source = F.struct(k, urls.alias("urls"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("policy"))
    bodies = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(source)).alias("sources"), F.lit("default").alias("policy"))
    s = bodies.select("o_custkey", F.col("policy").alias("body"), F.posexplode("sources").alias("i", "s"))
    return s.select("o_custkey", (F.col("i") + 1).cast("long").alias("source_order"), F.coalesce("s.policy", "body").alias("policy"), F.posexplode("s.urls").alias("j", "url")).select(
        "o_custkey", "source_order", (F.col("j") + 1).alias("address_order"), "url", "policy")


@query("""SELECT c_custkey, CASE WHEN k = 'building' THEN 'account_name_exact_match' WHEN k IN ('machinery', 'auto') THEN 'alias_name_match' ELSE 'keyword_search' END AS reason, CASE WHEN k IN ('building', 'machinery', 'auto') THEN 'verified' ELSE 'site_search' END AS confidence FROM (SELECT c_custkey, lower(c_mktsegment) AS k FROM customer)""")
def creator_addresses(spark, sf):
    """An exact name first, then one of the aliases, else a plain search hit."""
    name, aliases = F.lower(F.ltrim(F.trim("c_mktsegment"), F.lit("@"))), F.array(F.lit("machinery"), F.lit("auto"))
    exact, alias = name == "building", F.array_contains(aliases, name)
    return table(spark, sf, "customer").select("c_custkey", F.when(exact, "account_name_exact_match").when(alias, "alias_name_match").otherwise("keyword_search").alias("reason"), F.when(exact | alias, "verified").otherwise("site_search").alias("confidence"))


@query("""SELECT p_partkey, CASE WHEN len(list_intersect(t, ['small', 'large'])) > 0 THEN 'keyword_gallery_search|alias_search' ELSE 'keyword_gallery_search' END AS reasons FROM (SELECT p_partkey, string_split(lower(p_type), ' ') AS t FROM part)
WHERE list_contains(t, 'steel') OR len(list_intersect(t, ['small', 'large'])) = 0 UNION ALL SELECT p_partkey, 'alias_search' FROM (SELECT p_partkey, string_split(lower(p_type), ' ') AS t FROM part) WHERE NOT list_contains(t, 'steel') AND len(list_intersect(t, ['small', 'large'])) > 0""")
def gallery_reasons(spark, sf):
    """Keyword and alias reasons of a hit; one without either is a keyword hit."""
    terms = F.split(F.lower("p_type"), " ")
    alias = F.arrays_overlap(terms, F.array(F.lit("small"), F.lit("large")))
    keyword = F.array_contains(terms, "steel")
    found = F.array_compact(F.array(F.when(keyword, "keyword_gallery_search"), F.when(alias, "alias_search")))
    return table(spark, sf, "part").select("p_partkey", F.when(F.size(found) > 0, F.array_join(found, "|")).otherwise("keyword_gallery_search").alias("reasons"))


@query("""SELECT c_nationkey, count(*) FILTER (c_acctbal >= 0) AS verified, count(*) FILTER (c_acctbal < 0) AS weak_evidence FROM customer GROUP BY 1""")
def evidence_split(spark, sf):
    weak = F.col("c_acctbal") < 0
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(*S.count_where(verified=~weak, weak_evidence=weak))


@query("""SELECT p_partkey, p_name AS value, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE upper(p_name) END, ''), replace(p_name, '_', ' ')) AS label, CASE p_size % 7 WHEN 1 THEN 'artist' WHEN 3 THEN 'copyright' WHEN 4 THEN 'character' WHEN 5 THEN 'meta' ELSE 'general' END AS category FROM part""")
def autocompletion(spark, sf):
    """Suggestions with the names of their category codes; unknown codes are general, a missing label is the value with spaces."""
    codes = F.create_map(*(F.lit(x) for kv in {0: "general", 1: "artist", 3: "copyright", 4: "character", 5: "meta"}.items() for x in kv))
    label = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.upper("p_name"))
    return table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("value"), F.coalesce(F.nullif(label, F.lit("")), F.replace("p_name", F.lit("_"), F.lit(" "))).alias("label"), F.coalesce(F.element_at(codes, F.col("p_size") % 7), F.lit("general")).alias("category"))


@query("""SELECT l_orderkey AS parent, l_partkey AS child FROM lineitem WHERE l_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0""")
def replaced_children(spark, sf):
    """Parents with a new set of children lose the old one."""
    old = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("child"))
    new = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("parent"), F.col("o_custkey").alias("child"))
    return S.replaced_children(old, new, "parent")


@query(f"""SELECT address, CASE WHEN status = 'planning' AND batch % 5 > 0 AND skipped > 0 THEN 'succeeded' ELSE status END AS status, CASE WHEN status = 'planning' AND batch % 5 > 0 AND skipped > 0 THEN 0 END AS planned FROM {ADDRESS_SQL}""")
def short_circuit(spark, sf):
    """An address all of whose works are there already is done with no task, unless its batch is being cancelled."""
    done = (F.col("status") == "planning") & (F.col("batch") % 5 > 0) & (F.col("skipped") > 0)
    return _addresses(spark, sf).select("address", F.when(done, "succeeded").otherwise(F.col("status")).alias("status"), F.when(done, 0).alias("planned"))


@query(f"""SELECT c_custkey AS batch, CASE WHEN c_custkey % 11 = 0 THEN 'succeeded' WHEN n IS NULL OR NOT over THEN CASE WHEN c_custkey % 4 = 0 THEN 'cancelling' ELSE 'running' END WHEN c_custkey % 4 = 0 THEN 'cancelled' WHEN errors THEN 'completed_with_errors' ELSE 'succeeded' END AS status
FROM customer LEFT JOIN (SELECT batch, count(*) AS n, bool_and(status IN ('succeeded', 'failed', 'cancelled')) AS over, bool_or(status IN ('failed', 'cancelled')) AS errors FROM {ADDRESS_SQL} GROUP BY 1) ON batch = c_custkey""")
def batch_statuses(spark, sf):
    """Batches' statuses from their addresses', those that were asked to cancel and those that have ended included."""
    k = F.col("c_custkey")
    batches = table(spark, sf, "customer").select(k.alias("batch"), F.when(k % 11 == 0, "succeeded").otherwise("running").alias("status"), (k % 4 == 0).alias("cancel"))
    return S.batch_status(batches, _addresses(spark, sf), "batch", "status", "cancel")


TAG_SQL = """tg AS (SELECT p_partkey AS id, pos, CASE (p_partkey + pos) % 5 WHEN 0 THEN 'a:' || w WHEN 1 THEN 'Artist:' || upper(w) WHEN 2 THEN w WHEN 3 THEN 'zz:' || w ELSE 'f:' || w END AS tag FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w, generate_subscripts(string_split(p_type, ' '), 1) AS pos FROM part)),
sp AS (SELECT id, pos, CASE WHEN tag LIKE 'a:%' OR tag LIKE 'Artist:%' THEN 'artist' WHEN tag LIKE 'f:%' THEN 'female' WHEN tag LIKE 'zz:%' THEN 'unknown' ELSE 'temp' END AS namespace, regexp_replace(tag, '^[A-Za-z]+:', '') AS value FROM tg),
o1 AS (SELECT id, namespace, lower(value) AS key, arg_min(value, pos) AS value FROM sp GROUP BY 1, 2, 3), f1 AS (SELECT namespace, key, arg_min(value, id) AS value, count(*) AS n FROM o1 GROUP BY 1, 2)"""


def _facets(spark, sf):
    words = F.split("p_type", " ")
    k = lambda i: (F.col("p_partkey") + i + 1) % 5
    tags = F.transform(words, lambda w, i: F.when(k(i) == 0, F.concat(F.lit("a:"), w)).when(k(i) == 1, F.concat(F.lit("Artist:"), F.upper(w))).when(k(i) == 2, w).when(k(i) == 3, F.concat(F.lit("zz:"), w)).otherwise(F.concat(F.lit("f:"), w)))
    return S.tag_facets(table(spark, sf, "part").select("p_partkey", tags.alias("tags")), "p_partkey", "tags", ["artist", "female", "temp"])


@query(f"WITH {TAG_SQL} SELECT f1.namespace, CASE f1.namespace WHEN 'artist' THEN 1 WHEN 'female' THEN 2 WHEN 'temp' THEN 3 ELSE 4 END AS place, count(*) AS tag_count, any_value(g) AS gallery_count FROM f1 JOIN (SELECT namespace, count(DISTINCT id) AS g FROM o1 GROUP BY 1) x ON x.namespace = f1.namespace GROUP BY f1.namespace")
def namespace_facets(spark, sf):
    return _facets(spark, sf)[0]


@query(f"WITH {TAG_SQL} SELECT namespace, value, n AS count FROM f1")
def namespace_tags(spark, sf):
    return _facets(spark, sf)[1]


@query("""SELECT c, ok AS success, bad AS fail, CASE WHEN ok + bad > 0 THEN round_even(100.0::DOUBLE * ok / (ok + bad), 1) ELSE 0 END AS rate, coalesce(a, 0) AS active, coalesce(w, 0) AS cooling FROM (SELECT 'c' || user_id % 20 AS c, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type = 'view') AS bad FROM events GROUP BY 1)
LEFT JOIN (SELECT 'c' || s_nationkey AS k, count(*) FILTER (s_suppkey % 3 > 0 OR s_suppkey <= 50) AS a, count(*) FILTER (s_suppkey % 3 = 0 AND s_suppkey > 50) AS w FROM supplier GROUP BY 1) ON k = c""")
def country_table(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("c"), (F.col("user_id") % 20).cast("string")).alias("country"), F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "view", "fail").otherwise("other").alias("result"))
    n = table(spark, sf, "supplier").select(F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("country"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey").cast("double")).alias("until"))
    return S.country_table(e, n, 50.0).withColumnRenamed("country", "c")


@query("""SELECT CASE WHEN user_id % 7 = 0 THEN '??' ELSE 'c' || user_id % 7 END AS country, count(*) FILTER (event_type = 'purchase') AS success, count(*) FILTER (event_type = 'view') AS fail FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 2000) WHERE event_id % 10 > 0 GROUP BY 1""")
def tail_outcomes(spark, sf):
    """Outcomes by country over the last 2,000 lines of a JSON log; broken lines count nowhere."""
    k = F.col("user_id") % 7
    result = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "view", "fail").otherwise("other")
    line = F.to_json(F.struct(F.when(k > 0, F.concat(F.lit("c"), k.cast("string"))).alias("country"), result.alias("result")))
    return S.tail_outcomes(table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(line).alias("line")), "event_id", "line")
