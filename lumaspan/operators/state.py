"""Operators of the job-state model as functions of frames and column names.

Null keys match nothing in joins and are groups of their own in aggregates, as in SQL. Repeated rows count each unless said.
Empty frames give empty results, and counts over nothing are 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("succeeded", "failed", "cancelled")


def count_where(**tests: Column) -> list[Column]:
    """Named counts of rows that pass a test; a null test does not pass."""
    return [F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()]


def first_of(rows: DataFrame, by: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The first row of each key by a total order: an aggregate, no sort. Ties in the whole order give any of the equal rows."""
    return rows.groupBy(*by).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_x")).select(*by, *(F.col("_x")[k].alias(k) for k in keep if k not in by))


def upserted(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of either side by key; a new value replaces an old one unless it is null or empty. Keys are unique on each side."""
    o, n = old.select(F.col(key), *(F.col(f).alias(f"_o_{f}") for f in fields)), new.select(F.col(key), *(F.col(f).alias(f"_n_{f}") for f in fields))
    return o.join(n, key, "full_outer").select(key, *(F.coalesce(F.when(F.col(f"_n_{f}").cast("string") != "", F.col(f"_n_{f}")), F.col(f"_o_{f}")).alias(f) for f in fields))


def replaced_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """The children of every parent in ``new`` give way to its new ones; other parents keep theirs."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def source_rollup(addresses: DataFrame, batch: str, source: str, status: str, skipped: str) -> DataFrame:
    """Status, addresses and skipped works of each source of a batch, from its addresses' statuses."""
    s = F.col(status)
    every = lambda t: F.bool_and(F.coalesce(t, F.lit(False)))
    some = lambda t: F.bool_or(F.coalesce(t, F.lit(False)))
    state = (
        F.when(every(s == "succeeded"), "succeeded").when(some(s.isin("planning", "running")), "running")
        .when(some(s == "failed") & every(s.isin(*TERMINAL)), "completed_with_errors").when(every(s == "cancelled"), "cancelled").otherwise("pending"))
    return addresses.groupBy(batch, source).agg(state.alias("status"), F.count("*").alias("addresses"), F.coalesce(F.sum(skipped), F.lit(0)).alias("skipped"))


def next_open(addresses: DataFrame, batch: str, status: str, order: list[str], keep: list[str]) -> DataFrame:
    """The first address of each batch that has not ended, in strict order; a null status has not ended."""
    open_ = addresses.where(~F.coalesce(F.col(status).isin(*TERMINAL), F.lit(False)))
    return first_of(open_, [batch], order, keep)


def eligible_nodes(nodes: DataFrame, node: str, tags: str, healthy: str, excluded: DataFrame, allowed: DataFrame | None = None, wanted: tuple[str, ...] = (), probed: bool = False) -> DataFrame:
    """Nodes that are not excluded, allowed where a list says so, tagged as wanted and healthy unless they are probed before use."""
    out = nodes.join(excluded.select(node), node, "left_anti")
    if allowed is not None:
        out = out.join(allowed.select(node), node, "left_semi")
    if wanted:
        out = out.where(F.arrays_overlap(tags, F.array(*map(F.lit, wanted))))
    return out if probed else out.where(F.coalesce(F.col(healthy), F.lit(False)))


def registered_nodes(nodes: DataFrame, endpoint: str, scheme: str, name: str, order: str, socks: bool) -> DataFrame:
    """One node of each endpoint, the first by ``order``: id (20 hex digits of the endpoint's SHA-256), endpoint, scheme, name."""
    s = F.lower(F.coalesce(F.nullif(F.col(scheme), F.lit("")), F.lit("unknown")))
    usable = nodes.where(F.coalesce(F.col(endpoint) != "", F.lit(False)))
    usable = usable if socks else usable.where(~s.startswith("socks"))
    first = usable.groupBy(F.col(endpoint).alias("endpoint")).agg(F.min_by(F.struct(s.alias("scheme"), F.col(name).alias("name")), order).alias("_x"))
    return first.select(F.substring(F.sha2(F.encode("endpoint", "utf-8"), 256), 1, 20).alias("id"), "endpoint", "_x.scheme", "_x.name")


def node_rows(nodes: DataFrame, status: DataFrame, node: str, running: bool, now: float) -> DataFrame:
    """Nodes (node, healthy) with their state (node, leased, cooldown_left; nodes without one are free): eligibility, references, end of the cooldown."""
    j = nodes.join(status, node, "left")
    left, leased, up = F.coalesce("cooldown_left", F.lit(0.0)), F.coalesce("leased", F.lit(False)), F.lit(running) & F.coalesce("healthy", F.lit(False))
    return j.select(node, up.alias("healthy"), (up & (left <= 0) & ~leased).alias("retry_eligible"), leased.cast("int").alias("ref_count"), (F.lit(now) + left).alias("cooldown_until"))


def ready(components: DataFrame, by: str, required: str, status: str, fine: tuple[str, ...]) -> DataFrame:
    """Whether every required component of a system is in a fine state; one without a mark is required, an unknown state is not fine."""
    ok = ~F.coalesce(F.col(required), F.lit(True)) | F.coalesce(F.col(status).isin(*fine), F.lit(False))
    return components.groupBy(by).agg(F.bool_and(ok).alias("ready"))


def recovery_targets(tasks: DataFrame, by: str, site: str, error: str) -> DataFrame:
    """The distinct sites whose tasks failed to log in, sorted, and whether any error names a proxy."""
    login = F.when((F.col(error) == "authentication") & (F.col(site) != "unknown"), F.col(site))
    return tasks.groupBy(by).agg(F.array_sort(F.collect_set(login)).alias("sites"), F.coalesce(F.bool_or(F.col(error).contains("proxy")), F.lit(False)).alias("proxy_issue"))


def chosen_images(images: DataFrame, modes: DataFrame, group: str, recommended: str) -> DataFrame:
    """Selections of groups set to all, none or recommended (modes: group, mode); groups without a mode keep ``selected``. Set groups are undecided again."""
    j = images.join(modes, group, "left")
    by_mode = F.when(F.col("mode") == "all", True).when(F.col("mode") == "none", False).when(F.col("mode") == "recommended", F.col(recommended)).otherwise(F.col("selected"))
    return j.select(*(c for c in images.columns if c not in ("selected", "decided")), by_mode.alias("selected"), (F.col("decided") & F.col("mode").isNull()).alias("decided"))


def artifact_totals(files: DataFrame, by: str, path: str, length: str, marks: str = ".activity-") -> DataFrame:
    """Files and bytes of each task, without partial downloads and files whose name begins with ``marks``."""
    name = F.substring_index(F.col(path), "/", -1)
    own = files.where(~F.lower(name).endswith(".part") & ~name.startswith(marks))
    return own.groupBy(by).agg(F.count("*").alias("files"), F.sum(length).alias("bytes"))


def in_manifest_order(groups: DataFrame, root: str, kind: str, path: str, ranks: dict[str, int], span: int = 1 << 16) -> DataFrame:
    """Dense ordinals of groups in each manifest by rank of kind, then lower-cased path, then path. Sorted by range over the cluster;
    a manifest's offsets come from counts of its stretches, so no manifest is ordered in one task."""
    rank = reduce(lambda c, kv: c.when(F.col(kind) == kv[0], kv[1]), ranks.items(), F.when(F.lit(False), 0)).otherwise(9)
    rows = groups.withColumn("_rank", rank).orderBy(root, "_rank", F.lower(path), path)
    rows = rows.withColumn("_i", F.monotonically_increasing_id())
    from pyspark.sql import Window

    from lumaspan.operators.storage import stored

    rows = stored(rows.withColumn("_s", F.floor(F.col("_i") / span)))
    counts = rows.groupBy(root, "_s").agg(F.count("*").alias("_n"))
    before = counts.select(F.col(root).alias("_r"), F.col("_s").alias("_t"), (F.sum("_n").over(Window.partitionBy(root).orderBy("_s")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(root, "_s").orderBy("_i"))
    return rows.withColumn("_p", place).join(before, F.col(root).eqNullSafe(F.col("_r")) & (F.col("_s") == F.col("_t"))).select(
        *groups.columns, (F.col("_before") + F.col("_p")).alias("ordinal"))


def batch_status(batches: DataFrame, addresses: DataFrame, batch: str, status: str, cancel: str) -> DataFrame:
    """The status of each batch from its addresses': running (or cancelling) while any has not ended or there is none, then cancelled if that was
    asked for, with errors if any failed or was cancelled, else succeeded. A batch that has ended keeps its status."""
    s = F.col("_s")
    counts = addresses.select(F.col(batch), F.col(status).alias("_s")).groupBy(batch).agg(
        F.bool_and(F.coalesce(s.isin(*TERMINAL), F.lit(False))).alias("_over"), F.bool_or(F.coalesce(s.isin("failed", "cancelled"), F.lit(False))).alias("_errors"))
    j = batches.join(counts, batch, "left")
    asked = F.coalesce(F.col(cancel), F.lit(False))
    ended = F.col(status).isin("succeeded", "completed_with_errors", "cancelled")
    found = F.when(~F.coalesce("_over", F.lit(False)), F.when(asked, "cancelling").otherwise("running")).when(asked, "cancelled").when(F.col("_errors"), "completed_with_errors").otherwise("succeeded")
    return j.select(batch, F.when(ended, F.col(status)).otherwise(found).alias("status"))


def tag_facets(rows: DataFrame, row: str, tags: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Facets of tags (an array per row): namespace, place, tag_count, gallery_count; and their tags: namespace, value (the first spelling), count.

    A tag counts once in a row, whatever its case. Known namespaces come in ``order``, others behind them. Rows are told apart by ``row``, which
    also decides which spelling is first; tags that are blank count nowhere."""
    from lumaspan.functions.text import namespaced_tag

    t = rows.select(F.col(row).alias("_row"), F.posexplode(tags).alias("_pos", "_tag")).select("_row", "_pos", namespaced_tag(F.col("_tag")).alias("t")).where("t IS NOT NULL")
    once = t.groupBy("t.namespace", "t.key", "_row").agg(F.min_by("t.value", "_pos").alias("value"))
    found = once.groupBy("namespace", "key").agg(F.min_by("value", "_row").alias("value"), F.count("*").alias("count"))
    places = F.array(*map(F.lit, order))
    place = F.when(F.array_contains(places, F.col("namespace")), F.array_position(places, F.col("namespace"))).otherwise(len(order) + 1)
    galleries = once.groupBy("namespace").agg(F.count_distinct("_row").alias("gallery_count"))
    spaces = found.groupBy("namespace").agg(F.count("*").alias("tag_count")).join(galleries, "namespace").select("namespace", place.cast("int").alias("place"), "tag_count", "gallery_count")
    return spaces, found.select("namespace", "value", "count")


def country_table(outcomes: DataFrame, nodes: DataFrame, now: float) -> DataFrame:
    """outcomes: country, result; nodes: country, until (end of the cooldown, null: none). success, fail, rate (percent, one digit, half to even), active and cooling nodes.

    Countries are those of the outcomes; a null country is ??."""
    named = lambda df: df.withColumn("country", F.coalesce(F.nullif("country", F.lit("")), F.lit("??")))
    o = named(outcomes).groupBy("country").agg(*count_where(success=F.col("result") == "success", fail=F.col("result") == "fail"))
    waits = F.coalesce(F.col("until") > now, F.lit(False))
    n = named(nodes).groupBy("country").agg(F.count_if(~waits).alias("active"), F.count_if(waits).alias("cooling"))
    total = F.col("success") + F.col("fail")
    rate = F.when(total > 0, F.bround(100.0 * F.col("success") / total, 1)).otherwise(0.0)
    return o.join(n, "country", "left").select("country", "success", "fail", rate.alias("rate"), F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("cooling", F.lit(0)).alias("cooling"))


def tail_outcomes(lines: DataFrame, position: str, line: str, last: int = 2000) -> DataFrame:
    """Outcomes by country over the last lines of a JSON log: country, success, fail. Lines that are no objects count nowhere, but are lines of the tail."""
    tail = lines.orderBy(F.desc(position)).limit(last)
    rec = F.from_json(line, "country string, result string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    got = tail.select(rec.alias("r")).where("r IS NOT NULL AND r._bad IS NULL").select(F.coalesce(F.nullif("r.country", F.lit("")), F.lit("??")).alias("country"), "r.result")
    return got.groupBy("country").agg(*count_where(success=F.col("result") == "success", fail=F.col("result") == "fail"))
