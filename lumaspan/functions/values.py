"""Small value rules as column expressions: trimmed texts, numbers, lists, keys, safe JSON numbers, masking of maps, weights, resources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumaspan.functions.rules import redacted

# Words in a field's name that make its value a secret.
SECRET_FIELDS = "token|password|passwd|secret|cookie|api.?key|authorization"


def trimmed(value: Column, limit: int = 500) -> Column:
    """Trimmed and cut to ``limit`` characters; null if nothing is left."""
    return F.nullif(F.substring(F.trim(value.cast("string")), 1, limit), F.lit(""))


def whole_number(value: Column) -> Column:
    """A text as a long; null if it is none."""
    return F.when(F.trim(value).rlike(r"^[+-]?\d+$"), F.trim(value).try_cast("long"))


def text_list(values: Column, limit: int = 50, each: int = 200) -> Column:
    """An array's entries that are not blank, cut to ``each`` characters, the first ``limit``; empty for null."""
    kept = F.filter(values, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    return F.coalesce(F.slice(F.transform(kept, lambda x: F.substring(x, 1, each)), 1, limit), F.array().cast("array<string>"))


def split_list(text: Column, limit: int = 50, each: int = 200) -> Column:
    """The same of a text's words."""
    return text_list(F.split(F.trim(text), r"\s+"), limit, each)


def tag_key(value: Column) -> Column:
    """Lower case, runs of blanks, hyphens and underscores as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(value)), r"[\s_-]+", "_"), F.lit("_"))


def identity_key(value: Column) -> Column:
    """The key of an account's name: as ``tag_key``, without the leading at sign."""
    return tag_key(F.ltrim(F.trim(value), F.lit("@")))


def finite(value: Column) -> Column:
    """A double for JSON: null if it is not finite."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def masked_fields(fields: Column) -> Column:
    """A map of texts with the values of secret fields masked and the other values redacted."""
    return F.transform_values(fields, lambda k, v: F.when(k.rlike(f"(?i){SECRET_FIELDS}"), F.lit("***")).when(v.isNotNull(), redacted(v)))


def country_weight(ok: Column, failed: Column) -> Column:
    """Ten times the success rate, 0.1 at least; 1 where nothing was seen."""
    return F.when(ok + failed > 0, F.greatest(10.0 * ok / (ok + failed), F.lit(0.1))).otherwise(1.0)


def resources(device: Column, cpus: Column, workers: Column) -> Column:
    """Workers, batch, block and decoders of a device (cpu, or any other) with so many logical CPUs; 0 workers are chosen."""
    n = F.greatest(F.lit(1), F.coalesce(cpus, F.lit(1)))
    spare, cpu = F.greatest(F.lit(1), n - 1), F.lower(F.trim(F.coalesce(device, F.lit("auto")))) == "cpu"
    between = lambda low, x, high: F.least(F.lit(high), F.greatest(F.lit(low), F.floor(x).cast("int")))
    chosen = F.when(cpu, between(1, (spare + 3) / 4, 4)).otherwise(F.least(F.lit(8), n))
    work = F.when(workers > 0, workers).otherwise(chosen).cast("int")
    return F.struct(
        work.alias("workers"), F.when(cpu, work).otherwise(F.least(F.lit(4), n)).cast("int").alias("decoders"),
        F.when(cpu, between(1, n / 8, 4)).otherwise(8).alias("batch"), F.when(cpu, between(64, n * 8, 256)).otherwise(512).alias("block"))


def url_list(text: Column) -> Column:
    """The entries of a text that lists addresses, each once, in order: one a line, several in a line with schemes or separators; comments and blanks go."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))

    def entries(x: Column) -> Column:
        pieces = F.filter(F.transform(F.split(x, "[,;]+"), lambda p: F.trim(p)), lambda p: p != "")
        urls = F.transform(F.regexp_extract_all(x, F.lit(r"https?://\S+"), F.lit(0)), lambda u: F.regexp_replace(u, "[,;]+$", ""))
        bare = x.rlike("[,;]") & ~F.substring_index(x, ",", 1).contains("://")
        several = F.size(F.regexp_extract_all(x, F.lit("https?://"), F.lit(0))) > 1
        return F.when(bare, pieces).when(several, urls).otherwise(F.array(F.regexp_replace(x, "[,;]+$", "")))

    return F.array_distinct(F.filter(F.flatten(F.transform(lines, entries)), lambda x: F.trim(x) != ""))
