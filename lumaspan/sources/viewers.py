"""Image viewer pages to rows: a page with one image, the JSON answer that replaces its parts, and a page with a list of images.

Each part is cut out at its mark, then read: a tag from ``<img`` up to ``>``, a call's argument behind its name, a variable behind ``var``.
What is missing is named in ``error`` and the row stays; null pages miss everything. Only ``F`` functions are used, a page at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaspan.functions.text import plain_references

# Marks of the viewer's pages.
BLOCK, IMAGE, FULL = '<div id="i3"', "img", "fullimg"
CALL, RELOAD, START, SHOW, LIST, LIST_KEY = "load_image(", "nl(", "startkey", "showkey", "imagelist", "mpvkey"


def behind(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; null without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def filled(text: Column) -> Column:
    return F.when(text != "", text)


def quoted(text: Column) -> Column:
    """The value of a text that starts, after spaces, with a quote: up to the next quote of any kind."""
    return filled(F.regexp_extract(text, r"""^\s*["']([^"']*)""", 1))


def variable(text: Column, name: str) -> Column:
    """The quoted value of the first ``var name = "..."``."""
    tails = F.transform(F.split(text, r"var\s+" + name + r"\s*="), lambda x, i: F.when(i > 0, quoted(x)))
    return F.get(F.filter(tails, lambda x: x.isNotNull()), 0)


def attribute(tag: Column, name: str) -> Column:
    return filled(F.regexp_extract(tag, r"""\s""" + name + r"""=["']([^"']+)""", 1))


def image_source(block: Column) -> Column:
    """The source of the first image tag whose id is the viewer's, with its references undone."""
    tags = F.transform(F.split(block, r"<img\b"), lambda x, i: F.when(i > 0, F.substring_index(x, ">", 1)))
    own = F.get(F.filter(tags, lambda t: attribute(t, "id") == IMAGE), 0)
    return plain_references(attribute(own, "src"))


def next_key(block: Column) -> Column:
    """The key the viewer loads next: the call's first argument, else the first text in single quotes."""
    return F.coalesce(quoted(behind(block, CALL)), filled(F.regexp_extract(block, "'([^']+)'", 1)), F.lit(""))


def reload_key(block: Column) -> Column:
    return F.coalesce(F.btrim(F.substring_index(behind(block, RELOAD), ")", 1), F.lit("\"'")), F.lit(""))


def original(block: Column, root: Column) -> Column:
    """The first link to the full image, absolute; null without one."""
    links = F.filter(F.transform(F.split(block, r"""href=["']"""), lambda x, i: F.when(i > 0, F.regexp_extract(x, "^[^\"']*", 0))), lambda x: x.contains(FULL))
    link = plain_references(F.get(links, 0))
    return F.when(link.rlike("^https?://"), link).otherwise(F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), F.ltrim(link, F.lit("/"))))


def missing(**parts: Column) -> Column:
    """The names of the parts that are null, joined; null if none is."""
    return filled(F.concat_ws(", ", *[F.when(c.isNull(), F.lit(name)) for name, c in parts.items()]))


def image_pages(pages: DataFrame, html: str = "html", root: str = "root") -> DataFrame:
    """The input's columns and next_key, start_key, show_key, resample_url, original_url, reload_key, error."""
    block = behind(F.col(html), BLOCK)
    start, show, source = variable(block, START), variable(block, SHOW), image_source(block)
    return pages.select(
        "*", next_key(block).alias("next_key"), start.alias("start_key"), show.alias("show_key"), source.alias("resample_url"),
        original(block, F.col(root)).alias("original_url"), reload_key(block).alias("reload_key"),
        missing(viewer=block, image=source, start_key=start, show_key=show).alias("error"))


def image_answers(answers: DataFrame, body: str = "body", root: str = "root") -> DataFrame:
    """The input's columns and next_key, resample_url, original_url, reload_key, error, from a JSON object's i3 (viewer) and i6 (links)."""
    block, links = filled(F.get_json_object(body, "$.i3")), F.get_json_object(body, "$.i6")
    source = image_source(block)
    return answers.select(
        "*", next_key(block).alias("next_key"), source.alias("resample_url"), original(links, F.col(root)).alias("original_url"),
        reload_key(block).alias("reload_key"), missing(viewer=block, image=source).alias("error"))


def listed_images(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row per image of a page's list: the input's columns but the page, list_key, position (from 1), image (VARIANT), error; a broken list is one row."""
    tail = F.get(F.split(F.col(html), r"var\s+" + LIST + r"\s*=\s*", 2), 1)
    raw = F.when(tail.startswith("["), F.concat(F.substring_index(tail, "];", 1), F.lit("]")))
    found = F.try_parse_json(raw)
    rows = pages.select(*[c for c in pages.columns if c != html], variable(F.col(html), LIST_KEY).alias("list_key"), found.alias("_list"))
    rows = rows.withColumn("error", missing(list=F.col("_list"), list_key=F.col("list_key")))
    usable = F.when(F.col("error").isNull(), F.col("_list").cast("array<variant>"))
    out = rows.select("*", F.posexplode_outer(usable).alias("_at", "image"))
    return out.select(*[c for c in rows.columns if c not in ("_list", "error")], (F.col("_at") + 1).alias("position"), "image", "error")
