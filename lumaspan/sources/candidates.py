"""Candidates and authors from extractors' JSON messages, by one table of paths for each site, read as VARIANT.

An output is an array of messages [type, ..., object]: -1 errors, 2 entries, 3 media, 6 queued addresses. Outputs are parsed once and
exploded; each field is the first of its paths that holds something. Of entries that repeat an id the first one counts, up to a
limit for each output; an entry without a thumbnail takes the first media address behind it. An output that is no array is ``invalid``, one with errors and no
candidates ``failed``, one with both ``partial``. Outputs are keyed; a long one is dealt by its entries' ids, not held as one row after the explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaspan.functions.rules import redacted

# The fields of each site's entries (message type 2 or 6) and where they stand.
FIELDS = {
    ("twitter", 2): {"number": "tweet_id", "title": "content", "count": "count", "author_id": "author.id", "name": "author.name", "shown": "author.nick"},
    ("pixiv", 2): {"number": "id", "title": "title", "count": "count page_count", "author_id": "user.id", "name": "user.account", "shown": "user.name"},
    ("danbooru", 2): {"number": "id", "name": "tags_artist[0] tags_artist tag_string_artist", "title": "tags_copyright tag_string_copyright", "thumbnail": "preview_file_url large_file_url file_url source"},
    ("danbooru", 6): {"author_id": "id", "name": "name"},
    ("exhentai", 2): {"number": "gid gallery_id", "token": "token gallery_token", "title": "title", "name": "uploader", "thumbnail": "thumb", "count": "filecount"},
    ("exhentai", 6): {"number": "gallery_id", "token": "gallery_token"},
    ("pawchive", 2): {"text_id": "id", "service": "service", "author_id": "user", "name": "username", "title": "title", "count": "count"},
    ("pawchive", 6): {"author_id": "id", "service": "service", "name": "name", "imported": "ever_imported"},
}
# How ids of media messages are named.
MEDIA_ID = {"twitter": "tweet_id", "pixiv": "id", "danbooru": "id", "exhentai": "gid gallery_id", "pawchive": "id"}
KINDS = {("twitter", 2): "work", ("pixiv", 2): "work", ("danbooru", 2): "post", ("exhentai", 2): "gallery", ("exhentai", 6): "gallery", ("pawchive", 2): "post", ("pawchive", 6): "account"}
TITLES = {"work": {"twitter": "Post ", "pixiv": "Artwork "}, "post": {"danbooru": "Post ", "pawchive": "Post "}, "gallery": {"exhentai": "Gallery "}}
NAMES = ("number", "text_id", "title", "count", "author_id", "name", "shown", "thumbnail", "token", "service", "imported")


def text(value: Column, limit: int) -> Column:
    return F.nullif(F.substring(F.trim(value), 1, limit), F.lit(""))


def first_of(data: Column, paths: str, limit: int = 500) -> Column:
    """The first path that holds a text or number that is not blank."""
    return F.coalesce(*(text(F.try_variant_get(data, f"$.{p}", "string"), limit) for p in paths.split()))


def messages(outputs: DataFrame) -> DataFrame:
    """outputs: key, site, source_url, stdout. key, site, source_url, pos, type, address and data of each message."""
    parsed = outputs.select("key", "site", "source_url", F.try_parse_json("stdout").alias("v"))
    parsed.createOrReplaceTempView(view := "lumaspan_outputs")
    rows = parsed.sparkSession.sql(f"SELECT o.key, o.site, o.source_url, m.pos, m.value FROM {view} o, LATERAL variant_explode(o.v) m WHERE schema_of_variant(o.v) LIKE 'ARRAY%'")
    get = lambda path, kind: F.try_variant_get("value", path, kind)
    return rows.select("key", "site", "source_url", "pos", get("$[0]", "int").alias("type"), get("$[1]", "string").alias("address"), F.coalesce(get("$[2]", "variant"), get("$[1]", "variant")).alias("data"))


def projected(rows: DataFrame) -> DataFrame:
    """The entries of ``messages`` with the fields of their site; address, key and place stay."""
    def field(name: str) -> Column:
        out = F.lit(None).cast("string")
        for (site, kind), paths in FIELDS.items():
            if name in paths:
                out = F.when((F.col("site") == site) & (F.col("type") == kind), first_of(F.col("data"), paths[name], 8192 if name == "thumbnail" else 500)).otherwise(out)
        return out

    r = rows.where(F.col("type").isin(2, 6)).select("key", "site", "source_url", "pos", "type", "address", *(field(n).alias(n) for n in NAMES))
    on = lambda site, kind=2: (F.col("site") == site) & (F.col("type") == kind)
    number = F.coalesce(F.col("number").try_cast("long"), F.when(on("exhentai", 6), F.nullif(F.regexp_extract("address", r"/g/(\d+)/", 1), F.lit("")).try_cast("long"))).cast("string")
    ident = F.when(on("pawchive"), F.col("text_id")).when(on("pawchive", 6), F.when(F.coalesce("imported", F.lit("")) != "false", F.concat("service", F.lit(":"), "author_id"))).when(on("danbooru", 6), None).otherwise(number)
    name = F.when(on("danbooru"), F.substring_index("name", " ", 1)).otherwise(F.col("name"))
    r = r.withColumn("id", ident).withColumn("name", name)
    home = F.when(F.col("site") == "twitter", F.concat(F.lit("https://x.com/"), "name")).when(on("pixiv"), F.concat(F.lit("https://www.pixiv.net/users/"), F.col("author_id").try_cast("long").cast("string"))).when(
        F.col("site") == "pawchive", F.concat(F.lit("https://pawchive.pw/"), "service", F.lit("/user/"), "author_id"))
    works = F.when(on("twitter"), F.concat(home, F.lit("/media"))).when(on("pixiv"), F.concat(home, F.lit("/artworks"))).when(on("danbooru"), F.concat(F.lit("https://danbooru.donmai.us/posts?tags="), F.url_encode("name"))).when(
        on("danbooru", 6), F.col("address")).when(on("exhentai"), F.concat(F.lit("https://e-hentai.org/?f_search="), F.url_encode(F.concat(F.lit('uploader:"'), "name", F.lit('$"'))))).otherwise(home)
    gallery = F.concat(F.lit("https://"), F.when(F.col("source_url").contains("exhentai.org"), "exhentai.org").otherwise("e-hentai.org"), F.lit("/g/"), "id", F.lit("/"), "token", F.lit("/"))
    url = F.when(on("twitter"), F.concat(F.coalesce(home, F.lit("https://x.com/i/web")), F.lit("/status/"), "id")).when(on("pixiv"), F.concat(F.lit("https://www.pixiv.net/artworks/"), "id")).when(
        on("danbooru"), F.concat(F.lit("https://danbooru.donmai.us/posts/"), "id")).when(on("exhentai"), F.coalesce(gallery, F.col("source_url"))).when(
        on("exhentai", 6), F.concat(F.rtrim("address", F.lit("/")), F.lit("/"))).when(on("pawchive"), F.concat(home, F.lit("/post/"), "id")).when(on("pawchive", 6), F.coalesce(F.nullif(F.col("address"), F.lit("")), home))
    kind = label = F.lit(None).cast("string")
    for (site, t), k in KINDS.items():
        kind = F.when(on(site, t), k).otherwise(kind)
        label = F.when(on(site, t), F.lit(TITLES.get(k, {}).get(site))).otherwise(label)
    title = F.when(on("pawchive", 6), F.coalesce("name", F.concat("service", F.lit("/"), "author_id"))).otherwise(F.coalesce("title", F.concat(label, "id")))
    count = F.coalesce(F.col("count").try_cast("long"), F.when(on("twitter") | on("pixiv") | on("danbooru"), F.lit(1).cast("long")))
    shown = F.coalesce("shown", F.when(F.col("site") == "danbooru", F.replace("name", F.lit("_"), F.lit(" "))), F.col("name"))
    return r.select("key", "site", "pos", "id", kind.alias("kind"), title.alias("title"), url.alias("url"), "thumbnail", count.alias("media_count"), "author_id", F.col("name").alias("author_name"),
                    shown.alias("author_shown"), works.alias("works_url"))


def candidates(rows: DataFrame, limit: int) -> DataFrame:
    """rows: ``messages``. The first ``limit`` different candidates of each output, with thumbnails filled from media."""
    first = projected(rows).where("id is not null").groupBy("key", "site", "id").agg(F.min_by(F.struct("pos", "kind", "title", "url", "thumbnail", "media_count", "author_id", "author_name", "works_url"), "pos").alias("x")).select("key", "site", "id", "x.*")
    kept = first.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("pos"))).where(F.col("place") <= limit)
    media_id = F.lit(None).cast("string")
    for site, paths in MEDIA_ID.items():
        media_id = F.when(F.col("site") == site, first_of(F.col("data"), paths)).otherwise(media_id)
    media = rows.where((F.col("type") == 3) & (F.trim("address") != "")).select("key", media_id.alias("id"), F.col("pos").alias("at"), F.substring(F.trim("address"), 1, 8192).alias("media"))
    found = kept.join(media, ["key", "id"]).where("at > pos").groupBy("key", "id").agg(F.min_by("media", "at").alias("media"))
    return kept.join(found, ["key", "id"], "left").withColumn("thumbnail", F.coalesce("thumbnail", "media")).drop("media", "pos")


def authors(rows: DataFrame) -> DataFrame:
    """Each author of an output once: by id, else by the address of the works, else by name."""
    named = projected(rows).where("author_name is not null or author_id is not null")
    name = F.coalesce(F.concat("site", F.lit(":id:"), "author_id"), "works_url", F.lower("author_name"))
    return named.groupBy("key", name.alias("author_key")).agg(F.min_by(F.struct("site", "author_id", "author_name", "author_shown", "works_url"), "pos").alias("x")).select("key", "author_key", "x.*")


def states(outputs: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """Per output: key, state (ok, partial, failed, invalid), candidates, error (the first one, redacted, 1,000 characters)."""
    wrong = F.coalesce(F.try_variant_get("data", "$.message", "string"), F.try_variant_get("data", "$.error", "string"), F.lit("extractor error"))
    bad = rows.where("type = -1").groupBy("key").agg(F.min_by(F.substring(redacted(wrong), 1, 1000), "pos").alias("error"))
    n = candidates(rows, limit).groupBy("key").agg(F.count("*").alias("candidates"))
    v = F.try_parse_json("stdout")
    array = F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    out = outputs.select("key", array.alias("array")).join(bad, "key", "left").join(n, "key", "left")
    state = F.when(~F.col("array"), "invalid").when(F.col("error").isNull(), "ok").when(F.col("candidates") > 0, "partial").otherwise("failed")
    return out.select("key", state.alias("state"), F.coalesce("candidates", F.lit(0)).alias("candidates"), "error")
