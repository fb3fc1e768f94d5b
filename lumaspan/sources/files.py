"""File sources: image listings, inventories, endpoint lines, subscription bodies, extractor messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaspan.functions.rules import endpoint_host, endpoint_url

#: Extensions taken for images and folders that hold results of earlier runs.
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "tiff", "tif", "gif")
OWN_FOLDERS = ("duplicates", "keep")
#: Hosts that stand for no endpoint.
INVALID_HOSTS = ("none", "null", "undefined", "nan", "localhost", "0.0.0.0")


def images(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """path, length (and content) of the images below a folder, in any case of extension, outside our own result folders.

    Without ``content`` the files' bytes are not read: the column is pruned from the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    own = F.col("path").rlike("(?i)/(" + "|".join(OWN_FOLDERS) + ")/")
    return files.where(extension.isin(*EXTENSIONS) & ~own).select("path", "length", *(["content"] if content else []))


def inventory(spark: SparkSession, folder: str, pattern: str = r"(\d+)\.[^./]+$") -> DataFrame:
    """page, path, size, sha256 of the files whose name has a page number. Names without one are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    page = F.regexp_extract("path", pattern, 1)
    return files.where(page != "").select(page.cast("long").alias("page"), "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def unreadable(scanned: DataFrame, decoded: DataFrame) -> DataFrame:
    """Scanned files that no decoder could read, kept as rows."""
    return scanned.join(decoded.select("path").distinct(), "path", "left_anti").withColumn("readable", F.lit(False))


def valid_endpoints(lines: DataFrame, line: str = "line", position: str = "pos") -> DataFrame:
    """pos, url, host of the first valid line of each url; blanks, comments, invalid hosts and ports go.

    Null lines are blank. Other columns are ignored."""
    text = F.trim(F.coalesce(F.col(line), F.lit("")))
    d = lines.select(F.col(position).alias("pos"), text.alias("_t")).where((F.col("_t") != "") & ~F.col("_t").startswith("#")).select("pos", endpoint_url(F.col("_t")).alias("url"))
    port = F.expr("try_cast(nullif(regexp_extract(url, ':([0-9]+)/?$', 1), '') AS BIGINT)")
    d = d.select("pos", "url", endpoint_host(F.col("url")).alias("host"), port.alias("_port"))
    good = (F.col("host") != "") & ~F.col("host").isin(*INVALID_HOSTS) & ~F.col("host").rlike(r"^\d+$") & F.coalesce(F.col("_port").between(1, 65535), F.lit(True))
    return d.where(good).groupBy("url").agg(F.min_by(F.struct("pos", "host"), "pos").alias("_x")).select("_x.pos", "url", "_x.host")


def unwrapped(body: Column, depth: int = 2) -> Column:
    """A subscription body with up to ``depth`` layers of base64 removed; a body that is not base64 stays."""
    for _ in range(depth):
        packed = F.translate(F.regexp_replace(body, r"\s", ""), "-_", "+/")
        looks = packed.rlike(r"^[A-Za-z0-9+/]{8,}={0,2}$") & ~body.contains("://")
        full = F.concat(F.regexp_replace(packed, "=+$", ""), F.element_at(F.array(F.lit(""), F.lit(""), F.lit("=="), F.lit("=")), (F.length(F.regexp_replace(packed, "=+$", "")) % 4 + 1).cast("int")))
        body = F.when(looks, F.coalesce(F.try_to_binary(full, F.lit("base64")).cast("string"), body)).otherwise(body)
    return body


def subscription_lines(bodies: DataFrame, key: str = "source", body: str = "body") -> DataFrame:
    """source, pos, line of each body after unwrapping; a null body gives no line."""
    return bodies.select(F.col(key).alias("source"), F.posexplode(F.split(unwrapped(F.col(body)), r"\r?\n")).alias("pos", "line"))


def messages(bodies: DataFrame, key: str = "source", body: str = "body") -> DataFrame:
    """source, pos, kind, url, payload of extractor output: a JSON array of [type, (url,) payload].

    kind: error, directory, media, queue or unknown; a body that is no JSON array gives one row of kind invalid.
    A null body gives none."""
    items = F.from_json(F.col(body), "array<array<string>>", {"mode": "PERMISSIVE"})
    d = bodies.where(F.col(body).isNotNull()).select(F.col(key).alias("source"), F.col(body).alias("_b"), items.alias("_i"))
    good = d.where("_i is not null").select("source", F.posexplode("_i").alias("pos", "m"))
    code = F.expr("try_cast(get(m, 0) AS INT)")
    kind = F.when(code == -1, "error").when(code == 2, "directory").when(code == 3, "media").when(code == 6, "queue").otherwise("unknown")
    long = F.size("m") > 2
    good = good.select("source", "pos", kind.alias("kind"), F.when(long, F.get("m", F.lit(1))).alias("url"), F.when(long, F.get("m", F.lit(2))).otherwise(F.get("m", F.lit(1))).alias("payload"))
    none = F.lit(None).cast("string")
    return good.unionByName(d.where("_i is null").select("source", F.lit(0).alias("pos"), F.lit("invalid").alias("kind"), none.alias("url"), F.col("_b").alias("payload")))


def dispositions(files: DataFrame, target: str, path: str = "path") -> DataFrame:
    """path and target of files to be moved into one folder: a repeated name gets the suffix _n by order of path.

    A plan only; nothing is moved. The suffix counts inside a name's group, so a name with very many files costs one sorted task."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    n = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(path)) - 1
    stem, extension = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)?$", 0)
    return files.select(F.col(path), F.concat(F.lit(target + "/"), stem, F.when(n > 0, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), extension).alias("target"))
