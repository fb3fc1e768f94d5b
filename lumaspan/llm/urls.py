"""Operator 3, URL rules decided by cascades of Bloom filters, in DataFrame functions only.

The keys of a rule list are ``host`` + ``path prefix`` strings. For each action a cascade is built over the complete
universe of keys that occur in the judged urls: level 1 encodes the listed keys, level 2 the keys of the universe that
level 1 wrongly accepts, level 3 the listed keys that level 2 wrongly accepts, and so on until nothing is left. For keys
of that universe membership is then exact, and each url is judged in place: its key candidates (each parent domain of
its host with each prefix of its path as long as some rule's path) are tested from the longest to the shortest, with no
join. The filters' bits are literals of the plan; their size is set by the number of listed keys and of false
positives. A list whose filter would be larger than ``max_bytes`` is split by the keys' hash into parts with a cascade each,
and the urls are judged in one pass for each part, so neither a plan nor a task ever holds more than a part. Rules are a
sequence or a table with the columns action, host and path; actions and the lengths of their paths are few.

Null urls and urls without ``://`` have an empty host and path and match no rule. Repeated rows are judged each; an
empty table gives an empty result. A url that no rule fits gets ``default``. Ties in length go to the longer host.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspan.llm.common import pages, stored, whole

#: (action, host, path prefix); a longer rule wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
RATE = 1 / 64
MAX_BYTES = 8 << 20


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://``, and path; both empty without it."""
    at = F.instr(whole(url), "://")
    rest = F.when(at > 0, F.substring(whole(url), at + 3, F.length(whole(url)))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def key_candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Key strings of a url, longest first: parent domains of the host with prefixes of the path of these lengths."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    prefixes = F.filter(
        F.array(*(F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths)), lambda p: p.isNotNull()
    )
    both = F.flatten(F.transform(parents, lambda h: F.transform(prefixes, lambda p: F.struct(
        (-(F.length(h) + F.length(p))).alias("o"), (-F.length(h)).alias("l"), F.concat(h, p).alias("key")))))
    return F.when(host != "", F.transform(F.array_sort(both), lambda x: x.key)).otherwise(F.array().cast("array<string>"))


PART_SEED = 77


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(PART_SEED)), F.lit(parts))


def _bits(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 1000 + j)), F.lit(bits)) for j in range(hashes)]


def filter_bits(count: int, rate: float) -> tuple[int, int]:
    """Hash functions and bits of a filter of so many keys."""
    hashes = max(1, round(-math.log2(rate)))
    return hashes, 64 * max(1, math.ceil(count * hashes / math.log(2) / 64))


class Filter:
    """A Bloom filter as an array of 64-bit words held in a literal."""

    def __init__(self, keys: DataFrame, count: int, level: int, rate: float):
        self.level, self.count = level, count
        self.hashes, self.bits = filter_bits(count, rate)
        at = keys.select(F.explode(F.array(*_bits(F.col("key"), level, self.hashes, self.bits))).alias("b"))
        word = at.groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(64)).cast("int"))).alias("v")
        )
        words = dict(word.collect())  # bits / 64 rows at most, bounded by the number of parts
        self.words = [words.get(i, 0) for i in range(self.bits // 64)]

    def has(self, key: Column) -> Column:
        words = F.lit(self.words).cast("array<bigint>") if len(self.words) <= 64 else _literal(self.words)
        out = F.lit(True)
        for b in _bits(key, self.level, self.hashes, self.bits):
            word = F.get(words, F.shiftright(b, 6).cast("int"))
            out = out & (F.call_function("getbit", word, F.pmod(b, F.lit(64)).cast("int")) == 1)
        return out


def _literal(words: list[int]) -> Column:
    """A long array as one foldable expression."""
    return F.from_json(F.lit(str(words)), "array<bigint>")


class Cascade:
    """Exact membership of ``listed`` among the keys of ``universe`` (frames with a column ``key``).

    Only the first level looks at the universe. Where several cascades share one, ``near`` gives what level 1 lets through."""

    def __init__(self, listed: DataFrame, universe: DataFrame, rate: float = RATE):
        self.rate, self.listed = rate, listed.select("key").distinct()
        self.count = self.listed.count()
        self.levels = [Filter(self.listed, self.count, 0, rate)] if self.count else []
        if universe is not None:
            self.finish(stored(universe.where(self.has_first(F.col("key"))).select("key").distinct()))

    def has_first(self, key: Column) -> Column:
        return self.levels[0].has(key) if self.levels else F.lit(False)

    def finish(self, near: DataFrame) -> None:
        """near: the keys of the universe, or more, that level 1 lets through."""
        if not self.levels:
            return
        inside, outside = stored(near.where(self.has_first(F.col("key"))).join(self.listed, "key", "left_anti")), self.listed
        while count := inside.count():
            level = Filter(inside, count, len(self.levels), self.rate)
            self.levels.append(level)
            inside, outside = stored(outside.where(level.has(F.col("key")))), inside

    def has(self, key: Column) -> Column:
        """Odd levels hold listed keys, even levels keys that are not: the first level to reject decides."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            out = F.when(~self.levels[k].has(key), F.lit(k % 2 == 1)).otherwise(out)
        return out


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """action, key, n (length of the path) of rules given as a sequence or a table."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "action string, host string, path string")
    return rules.select("action", F.concat("host", "path").alias("key"), F.length("path").alias("n"))


def judge(df: DataFrame, rules=RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow",
          rate: float = RATE, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per row: ``keep``, host, path, rule (the key of the longest fitting rule, or null), verdict."""
    rules = rule_table(df.sparkSession, rules)
    sizes = {r[0]: r[1] for r in rules.groupBy("action").agg(F.count_distinct("key")).collect()}
    lengths = sorted(r[0] for r in rules.select("n").distinct().collect())
    actions = sorted(sizes)
    host, path = host_path(F.col(url))
    urls = df.select(*(F.col(k) for k in keep), host.alias("_u_host"), path.alias("_u_path"))
    urls = urls.withColumn("_u_keys", key_candidates(F.col("_u_host"), F.col("_u_path"), lengths))
    universe = urls.select(F.explode("_u_keys").alias("key"))
    parts = max([1, *(math.ceil(filter_bits(n, rate)[1] / 8 / max_bytes) for n in sizes.values())])
    own = lambda frame, p: frame if parts == 1 else frame.where(part_of(F.col("key"), parts) == p)
    none = F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("action"))
    urls = urls.withColumn("_u_hit", none)
    for p in range(parts):
        cascades = {a: Cascade(own(rules.where(F.col("action") == a), p), None, rate) for a in actions}
        if any(c.levels for c in cascades.values()):
            first = functools.reduce(lambda x, c: x | c.has_first(F.col("key")), cascades.values(), F.lit(False))
            near = stored(own(universe, p).where(first).select("key").distinct())  # one pass over the universe for all actions
            for c in cascades.values():
                c.finish(near)

        def action(key: Column, p=p, cascades=cascades) -> Column:
            col = F.lit(None).cast("string")
            for a in actions:
                col = F.when(cascades[a].has(key), F.lit(a)).otherwise(col)
            return col if parts == 1 else F.when(part_of(key, parts) == p, col)

        found = F.transform("_u_keys", lambda k, i: F.struct(i.alias("at"), action(k).alias("action")))
        hit = F.get(F.filter(found, lambda x: x.action.isNotNull()), F.lit(0))
        urls = urls.withColumn("_u_hit", F.when(F.col("_u_hit.at").isNull() | (hit["at"] < F.col("_u_hit.at")), hit).otherwise(F.col("_u_hit")))
        urls = urls if p == parts - 1 else stored(urls)
    return urls.select(
        *keep, F.col("_u_host").alias("host"), F.col("_u_path").alias("path"), F.get("_u_keys", F.col("_u_hit.at")).alias("rule"),
        F.coalesce("_u_hit.action", F.lit(default)).alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(pages(spark, sf_dir))


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(action, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT page_id, host, path, r.h || r.p AS rule, action,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.h || r.p) DESC NULLS LAST, length(r.h) DESC) AS k
  FROM p LEFT JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
