"""Caches and pools as joins: vectors by model and content, results with a time to live, cooled nodes, sources read together; and the registries of plug-ins.

Times are columns or numbers of seconds given by the caller, so that batch and stream agree. Null keys match nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODELS: dict[str, tuple[Callable[[Column], Column], int]] = {}
PAIR_METRICS: dict[str, Callable[[Column, Column], Column]] = {}


def register_model(name: str, vector: Callable[[Column], Column], dim: int) -> None:
    """A model gives the vector column of a content column, by built-in functions or a pandas UDF."""
    MODELS[name] = (vector, dim)


def register_pair_metric(name: str, metric: Callable[[Column, Column], Column]) -> None:
    """A metric gives a column of two columns, one for each side of a pair."""
    PAIR_METRICS[name] = metric


def cached(wanted: DataFrame, cache: DataFrame, model: str, dim: int) -> DataFrame:
    """wanted: content_hash; cache: model_key, content_hash, vector. The wanted rows and their vector, null where the cache has none of that size."""
    own = cache.where((F.col("model_key") == model) & (F.size("vector") == dim)).select("content_hash", "vector")
    return wanted.join(own, "content_hash", "left")


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new vectors in place of old ones of the same model and content. Of repeated new rows the greatest vector stays."""
    fresh = new.groupBy("model_key", "content_hash").agg(F.max("vector").alias("vector"))
    return cache.join(fresh, ["model_key", "content_hash"], "left_anti").select(*fresh.columns).unionByName(fresh)


def with_vectors(wanted: DataFrame, cache: DataFrame, model: str, content: str = "content") -> DataFrame:
    """wanted: content_hash and content. Every row's vector by a registered model; contents in the cache are not scored again."""
    vector, dim = MODELS[model]
    found = cached(wanted, cache, model, dim)
    scored = found.where("vector IS NULL").withColumn("vector", vector(F.col(content)))
    return found.where("vector IS NOT NULL").unionByName(scored)


def live(results: DataFrame, key: list[str], at: str, faults: DataFrame, node: str, now: float, ttl: float) -> DataFrame:
    """The last result of each key that is younger than ``ttl`` and that no later fault of its node (faults: node, at) has ended."""
    last = results.groupBy(*key).agg(F.max_by(F.struct(*results.columns), at).alias("_x")).select("_x.*").where(F.lit(now) - F.col(at) < ttl)
    bad = faults.groupBy(node).agg(F.max(at).alias("_fault"))
    return last.join(bad, node, "left").where(F.col("_fault").isNull() | (F.col("_fault") < F.col(at))).drop("_fault")


def readmitted(nodes: DataFrame, now: float, healthy: str = "healthy", until: str = "cooldown_until") -> DataFrame:
    """Nodes whose timed cooldown has passed are healthy again; those that never had one stay out."""
    back = ~F.coalesce(F.col(healthy), F.lit(False)) & (F.coalesce(F.col(until), F.lit(0.0)) > 0) & (F.col(until) <= now)
    return nodes.withColumns({healthy: F.coalesce(F.col(healthy), F.lit(False)) | back, until: F.when(back, 0.0).otherwise(F.col(until))})


def available(pool: DataFrame, cooling: DataFrame, leased: DataFrame, key: str, now: float) -> DataFrame:
    """Members of a pool that are not leased and whose deadline (cooling: key, deadline), if they have one, has come."""
    waiting = cooling.where(F.col("deadline") > now).select(key)
    return pool.select(key).distinct().join(waiting, key, "left_anti").join(leased.select(key), key, "left_anti")


def read_together(sources: dict[str, DataFrame], errors: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The rows of all sources that could be read, with their source, and a row per source: source, ok, rows, error. Raises if none could be read."""
    if errors and not sources:
        raise RuntimeError("no source could be read: " + "; ".join(f"{k}: {v}" for k, v in sorted(errors.items())))
    out, spark = None, None
    for name, df in sources.items():
        part, spark = df.withColumn("source", F.lit(name)), df.sparkSession
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    named = spark.createDataFrame([(k, True, None) for k in sources] + [(k, False, v) for k, v in errors.items()], "source string, ok boolean, error string")
    counts = out.groupBy("source").agg(F.count("*").alias("rows"))
    return out, named.join(counts, "source", "left").select("source", "ok", F.coalesce("rows", F.lit(0)).alias("rows"), "error")


def picked_node(nodes: DataFrame, by: list[str], preferred: list[str], now: float, exclude: list[str] | None = None) -> DataFrame:
    """The node of each group that is to be leased next, its load one higher; none where no node is able.

    nodes: ``by``, id, healthy, cooldown_until, address, load, tls_fails, successes, fails, latency. Able nodes are healthy, not cooling and not
    excluded. The order: addresses of the preferred list first, then less load, the place in that list, fewer TLS failures in a row, more
    successes, fewer failures, lower latency (unknown last), id. One struct a group is kept, so nothing is sorted."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    address = F.trim(F.coalesce("address", F.lit("")))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, preferred)), address), F.lit(0)), F.lit(1 << 31)) if preferred else F.lit(1 << 31)
    able = F.coalesce("healthy", F.lit(False)) & (F.coalesce("cooldown_until", F.lit(0.0)) <= now) & ~F.coalesce(F.col("id").isin(exclude or []), F.lit(False))
    key = F.struct((place == 1 << 31).alias("a"), zero("load").alias("b"), place.alias("c"), zero("tls_fails").alias("d"), (-zero("successes")).alias("e"), zero("fails").alias("f"),
                   F.col("latency").isNull().alias("g"), F.coalesce("latency", F.lit(0.0)).alias("h"), F.col("id").cast("string").alias("i"))
    best = nodes.where(able).groupBy(*by).agg(F.min_by(F.struct(*[c for c in nodes.columns if c not in by]), key).alias("_x"))
    return best.select(*by, "_x.*").withColumn("load", zero("load") + 1)


def exact_units(items: DataFrame, key: str, pixel: str, file: str) -> DataFrame:
    """Items of equal decoded content, else (where none could be decoded) of equal files: content (pixel: or file: and the hash), winner (least key), members, kind."""
    content = F.coalesce(F.concat(F.lit("pixel:"), F.col(pixel)), F.concat(F.lit("file:"), F.col(file)))
    units = items.groupBy(content.alias("content")).agg(F.min(key).alias("winner"), F.count("*").alias("members"))
    return units.withColumn("kind", F.when(F.col("members") > 1, "exact").otherwise("single"))
