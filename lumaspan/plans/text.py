"""Queries of the text rules: redaction, classification, URL keys, page scraping, endpoint lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaspan.functions.rules import endpoint_url, redacted
from lumaspan.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f
    return register


@query(r"""SELECT doc_id, CASE WHEN length(t) > 4000 THEN left(t, 3999) || '…' ELSE t END AS text FROM (SELECT doc_id,
  regexp_replace(regexp_replace(regexp_replace(text, '(://)[^/\s:@]+:[^/\s@]+@', '\1***@', 'g'), '(?i)\b(token|secret|password|api[_-]?key)(\s*[=:]\s*)[^\s&;,]+', '\1\2***', 'g'), '(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer ***', 'g') AS t FROM documents)""")
def redacted_text(spark, sf):
    """A log line's short form: user info of urls, then key = value secrets, then bearer tokens; 4,000 characters are kept.
    ``redacted_documents`` redacts whole texts by all rules."""
    t = F.regexp_replace("text", r"(://)[^/\s:@]+:[^/\s@]+@", "$1***@")
    t = F.regexp_replace(t, r"(?i)\b(token|secret|password|api[_-]?key)(\s*[=:]\s*)[^\s&;,]+", "$1$2***")
    t = F.regexp_replace(t, r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+", "Bearer ***")
    d = table(spark, sf, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", F.when(F.length("t") > 4000, F.concat(F.substring("t", 1, 3999), F.lit("…"))).otherwise(F.col("t")).alias("text"))


def redacted_documents(spark, sf):
    """Whole documents, redacted by all rules. Its SQL takes the character before a word along, as it cannot look back."""
    return table(spark, sf, "documents").select("doc_id", redacted(F.col("text")).alias("text"))


QUERIES["redacted_documents"] = redacted_documents


@query(r"""SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INT) AS links, list_aggregate(list_sort(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))), 'string_agg', ' ') AS targets FROM pages""")
def page_titles_links(spark, sf):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1).alias("title"), F.size(links).alias("links"), F.array_join(F.array_sort(F.array_distinct(links)), " ").alias("targets"))


@query(r"""SELECT s_suppkey, 'https://search.invalid/?q=' || replace(replace(s_name, '#', '%23'), ' ', '+') AS url FROM supplier""")
def search_urls(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("https://search.invalid/?q="), F.url_encode("s_name")).alias("url"))


@query(r"""WITH l AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN h || ':8080' WHEN 1 THEN 'http://' || h || ':8080' WHEN 2 THEN 'user:pw@' || h || ':8080' ELSE h || ':8080:user:pw' END AS line FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h FROM pages))
SELECT page_id, line, CASE WHEN page_id % 4 IN (2, 3) THEN 'http://user:pw@' ELSE 'http://' END || regexp_extract(line, '([a-z0-9.-]+\.example\.[a-z]+):\d+', 1) || ':8080' AS endpoint FROM l""")
def normalized_endpoints(spark, sf):
    """host:port, scheme://host:port, user:pw@host:port and host:port:user:pw become one form."""
    h = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    k = F.col("page_id") % 4
    made = F.when(k == 0, F.concat(h, F.lit(":8080"))).when(k == 1, F.concat(F.lit("http://"), h, F.lit(":8080"))).when(k == 2, F.concat(F.lit("user:pw@"), h, F.lit(":8080"))).otherwise(F.concat(h, F.lit(":8080:user:pw")))
    out = endpoint_url(F.col("line"))
    return table(spark, sf, "pages").select("page_id", made.alias("line")).select("page_id", "line", out.alias("endpoint"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '[\s_-]+', '_', 'g'), '_') AS tag_key, CASE WHEN length(trim(p_name)) > 12 THEN left(trim(p_name), 12) ELSE nullif(trim(p_name), '') END AS label FROM part""")
def tag_keys(spark, sf):
    key = F.btrim(F.regexp_replace(F.lower(F.trim("p_name")), r"[\s_-]+", "_"), F.lit("_"))
    return table(spark, sf, "part").select("p_partkey", key.alias("tag_key"), F.nullif(F.substring(F.trim("p_name"), 1, 12), F.lit("")).alias("label"))
