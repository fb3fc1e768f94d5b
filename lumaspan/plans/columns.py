"""Text and value rules over the tables' own columns: urls and markup of pages, texts, names, events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaspan.functions import rules as R
from lumaspan.functions import text as T
from lumaspan.functions import values as V
from lumaspan.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f
    return register


def _spelled(df, *forms: str):
    """A row for each form of each row: kind, id, the form's number, its text v. A form is an expression that Spark and DuckDB share."""
    return df.select("kind", "id", F.posexplode(F.array(*map(F.expr, forms))).alias("form", "v"))


def _spelled_sql(source: str, *forms: str) -> str:
    texts = f"[{', '.join(forms)}]"
    return f"(SELECT kind, id, CAST(generate_subscripts({texts}, 1) - 1 AS INT) AS form, unnest({texts}) AS v FROM ({source}))"


def _marks(words) -> str:
    return "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda m: contains(t, m))) > 0"


@query(f"""WITH d AS (SELECT doc_id, text, lower(coalesce(text, '')) AS t, CAST(n_chars % 256 AS INT) AS b, lang = 'es' AS late FROM documents),
c AS (SELECT doc_id, b, late, {_marks(T.PROXY_MARKS)} AS fault, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r\\n|\\r|\\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l, CASE WHEN late THEN 'task_timeout' WHEN b = 0 THEN 'success'
  WHEN b & 64 > 0 OR contains(t, 'unsupported url') THEN 'unsupported_url' WHEN b & 32 > 0 THEN 'input_error' WHEN {_marks(T.ACCESS_MARKS)} THEN 'proxy_access_failure'
  WHEN b & 16 > 0 OR {_marks(T.LOGIN_MARKS)} THEN 'authentication' WHEN b & 8 > 0 THEN 'cloudflare_challenge' WHEN {_marks(T.MISSING_MARKS)} THEN 'not_found'
  WHEN {_marks(T.RESUME_MARKS)} THEN 'download_error' WHEN {_marks(T.PROXY_MARKS)} THEN 'proxy_failure' WHEN {_marks(T.BUSY_MARKS)} THEN 'site_transient'
  WHEN {_marks(T.SLOW_MARKS)} THEN 'network_timeout' WHEN b & 128 > 0 THEN 'download_error' WHEN b & 4 > 0 THEN 'extraction_error' ELSE 'gallery_error' END AS outcome FROM d)
SELECT doc_id, outcome, outcome IN ('task_timeout', 'proxy_access_failure', 'cloudflare_challenge', 'download_error', 'proxy_failure', 'site_transient', 'network_timeout') AS retryable,
  outcome IN ('proxy_access_failure', 'cloudflare_challenge', 'proxy_failure') OR (outcome IN ('task_timeout', 'download_error') AND fault) AS proxy_fault, length(coalesce(l[-1], '')) > 0 AS has_message FROM c""")
def classified_results(spark, sf):
    """Texts as the tails of jobs, their sizes as exit codes; Spanish ones ran out of time."""
    end = T.outcome(F.col("n_chars") % 256, F.col("text"), F.lit(False), F.col("lang") == "es")
    return table(spark, sf, "documents").select("doc_id", end["class"].alias("outcome"), end["retryable"].alias("retryable"), end["proxy_fault"].alias("proxy_fault"), (T.outcome_message(F.col("text")) != "").alias("has_message"))


# the pages' own urls with the host of a site in place of theirs, by the language in their path
SITES = {"en": "https://mobile.twitter.com/someone/status/", "de": "http://www.pixiv.net/en/artworks/", "fr": "https://i.pximg.net/img-original/img/"}
_SITE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(url, '://[^/]+/{k}/') THEN regexp_replace(url, '^[a-z]+://[^/]+/{k}/', '{v}')" for k, v in SITES.items()) + " ELSE url END"


def _on_site():
    out = F.col("url")
    for k, v in SITES.items():
        out = F.when(F.col("url").rlike(f"://[^/]+/{k}/"), F.regexp_replace("url", f"^[a-z]+://[^/]+/{k}/", v)).otherwise(out)
    return out


@query(f"""SELECT page_id, CASE WHEN regexp_matches(u, '^https://mobile.twitter.com/someone/status/[0-9]+([/?#]|$)') THEN 'twitter:' || regexp_extract(u, 'status/([0-9]+)', 1)
  WHEN regexp_matches(u, '^http://www.pixiv.net/en/artworks/[0-9]+([/?#]|$)') THEN 'pixiv:' || regexp_extract(u, 'artworks/([0-9]+)', 1)
  WHEN regexp_matches(u, '^https://i.pximg.net/img-original/img/[0-9]+([_./?#]|$)') THEN 'pixiv:' || regexp_extract(u, 'img/([0-9]+)', 1) END AS source_key FROM (SELECT page_id, {_SITE_SQL} AS u FROM pages)""")
def source_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.source_key(_on_site()).alias("source_key"))


@query(f"""SELECT page_id, CASE WHEN regexp_matches(h, '^[0-9]+$') THEN 'pixiv:' || h ELSE k END AS source_key FROM (SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS h,
  CASE WHEN regexp_matches(url, '://[^/]+/en/[0-9]+([/?#]|$)') THEN 'twitter:' || regexp_extract(url, '/en/([0-9]+)', 1) WHEN regexp_matches(url, '://[^/]+/de/[0-9]+([/?#]|$)') THEN 'pixiv:' || regexp_extract(url, '/de/([0-9]+)', 1)
  WHEN regexp_matches(url, '://[^/]+/fr/[0-9]+([_./?#]|$)') THEN 'pixiv:' || regexp_extract(url, '/fr/([0-9]+)', 1) END AS k FROM pages)""")
def candidate_keys(spark, sf):
    """The page parameter as the site's own id, else the url's key."""
    return table(spark, sf, "pages").select("page_id", T.candidate_key(F.lit(" Pixiv "), F.regexp_extract("url", "[?&]page=([^&#]*)", 1), _on_site()).alias("source_key"))


_PART = r"regexp_extract(url, '^[a-z]+://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['h', 'p', 'q'])"


@query(f"""SELECT page_id, CASE WHEN x.h = '' THEN trim(url, ' ') ELSE 'https://' || lower(x.h) || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN x.q <> '' THEN '?' || x.q ELSE '' END END AS canonical
FROM (SELECT page_id, url, x, regexp_replace(regexp_replace(x.p, '/+', '/', 'g'), '/$', '') AS p FROM (SELECT page_id, url, {_PART} AS x FROM pages))""")
def canonical_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.canonical_address(F.lit("web"), F.col("url")).alias("canonical"))


@query(f"""SELECT page_id, CASE WHEN lang = 'en' THEN 'twitter' WHEN lang = 'de' THEN 'pixiv' ELSE CASE WHEN starts_with(h, 'www.') THEN h[5:] ELSE h END END AS platform,
  CASE WHEN lang = 'en' THEN 'twitter' WHEN lang = 'de' THEN 'pixiv' END AS crawl_site, CASE WHEN lang = 'en' THEN 'https://x.com/u' || n || '/media' WHEN lang = 'de' THEN 'https://www.pixiv.net/users/' || n || '/artworks' END AS crawl_url
FROM (SELECT page_id, lower({_PART}.h) AS h, regexp_extract(url, '://[^/]+/([a-z]+)/[0-9]+', 1) AS lang, regexp_extract(url, '://[^/]+/[a-z]+/([0-9]+)', 1) AS n FROM pages)""")
def external_profiles(spark, sf):
    """Accounts numbered as the pages are: English ones at one site, German ones at another, the others' hosts as they are."""
    lang, n = F.regexp_extract("url", "://[^/]+/([a-z]+)/[0-9]+", 1), F.regexp_extract("url", "://[^/]+/[a-z]+/([0-9]+)", 1)
    url = F.when(lang == "en", F.concat(F.lit("https://twitter.com/U"), n)).when(lang == "de", F.concat(F.lit("https://www.pixiv.net/users/"), n, F.lit("/illustrations"))).otherwise(F.col("url"))
    p = T.external_profile(url)
    return table(spark, sf, "pages").select("page_id", *(p[c].alias(c) for c in ("platform", "crawl_site", "crawl_url")))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 'https://img.example/' || url[9:] ELSE url END AS thumbnail FROM pages")
def thumbnail_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.rewritten(F.col("url"), "https://", "https://img.example/").alias("thumbnail"))


@query(f"SELECT page_id, split_part(url, '://', 1) AS scheme, lower({_PART}.h) AS host, CASE WHEN starts_with(url, 'https') THEN 443 ELSE 80 END AS port FROM pages")
def probe_keys(spark, sf):
    k = T.probe_key(F.col("url"))
    return table(spark, sf, "pages").select("page_id", *(k[c].alias(c) for c in ("scheme", "host", "port")))


@query(f"SELECT page_id, CASE WHEN n = '' THEN 'image' ELSE n END AS name FROM (SELECT page_id, list_last(list_filter(string_split({_PART}.p, '/'), lambda x: x <> '')) AS f, coalesce(f, '') AS n FROM pages)")
def file_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.file_name(F.col("url")).alias("name"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=') THEN regexp_replace(url, '([?&])page=[^&#]*', '\1page=' || page_id)
ELSE regexp_replace(url, '#.*$', '') || CASE WHEN contains(split_part(url, '#', 1), '?') THEN '&' ELSE '?' END || 'page=' || page_id || regexp_extract(url, '#.*$') END AS url FROM pages""")
def query_parameters(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.with_parameter(F.col("url"), "page", F.col("page_id").cast("string")).alias("url"))


_LETTERS = {short: n for n, words in T.NAMESPACES.items() for short in words.split() if len(short) == 1}


@query("WITH t AS (SELECT p_partkey, lower(p_type[1]) AS a, p_name, p_type FROM part) SELECT p_partkey, CASE " + " ".join(f"WHEN a = '{k}' THEN '{v}'" for k, v in _LETTERS.items()) + " ELSE 'unknown' END AS namespace, p_name AS value, namespace || ':' || lower(p_name) AS tag_key FROM t")
def namespaced_tags(spark, sf):
    """The first letter of a part's type as the namespace of its name."""
    t = T.namespaced_tag(F.concat(F.substring("p_type", 1, 1), F.lit(": "), F.col("p_name"), F.lit(" ")))
    return table(spark, sf, "part").select("p_partkey", t["namespace"].alias("namespace"), t["value"].alias("value"), t["key"].alias("tag_key"))


@query("SELECT p_partkey, p_name || '; ' || p_brand || '.zip' AS name FROM part")
def attachment_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.attachment_name(F.concat(F.lit('attachment; filename="'), "p_name", F.lit("; "), "p_brand", F.lit('.zip"'))).alias("name"))


@query("SELECT conv_id, turn, nullif(substr(trim(text, ' '), 1, 500), '') AS text FROM conversations")
def trimmed_values(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", V.trimmed(F.col("text")).alias("text"))


@query(r"SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS number FROM events")
def whole_numbers(spark, sf):
    return table(spark, sf, "events").select("event_id", V.whole_number(F.concat(F.lit(" "), F.get_json_object("props", "$.k"))).alias("number"))


@query(r"SELECT doc_id, array_to_string(list_filter(string_split_regex(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')[1:3], '|') AS words FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def word_lists(spark, sf):
    """The first three words of each text."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(V.split_list(F.col("text"), 3, 1 << 30), lambda x: x), "|").alias("words"))


# an account's name as people write it: marks around it, a blank in it, runs of marks, several at signs, blank, missing
ACCOUNTS = ("' @' || replace(name, '#', ' -at_ ') || '- '", "'@' || replace(name, '#', ' ')", "' ' || replace(replace(name, '#', '__'), ' ', '__') || ' - ' || id || '_'", "'@@' || name", "''", "CAST(NULL AS STRING)")
_NAMED = {"supplier": ("s_suppkey", "s_name"), "customer": ("c_custkey", "c_name"), "part": ("p_partkey", "p_name")}


@query(r"SELECT kind, id, form, trim(regexp_replace(lower(ltrim(trim(v, ' '), '@')), '[ \t\n\x0B\f\r_-]+', '_', 'g'), '_') AS key FROM "
       + _spelled_sql(" UNION ALL ".join(f"SELECT '{t}' AS kind, {k} AS id, {n} AS name FROM {t}" for t, (k, n) in _NAMED.items()), *ACCOUNTS))
def identity_keys(spark, sf):
    """Every supplier's, customer's and part's name as an account's, in every form."""
    named = reduce(DataFrame.unionAll, (table(spark, sf, t).select(F.lit(t).alias("kind"), F.col(k).alias("id"), F.col(n).alias("name")) for t, (k, n) in _NAMED.items()))
    return _spelled(named, *ACCOUNTS).select("kind", "id", "form", V.identity_key(F.col("v")).alias("key"))


@query("""WITH c AS (SELECT c_custkey, c_mktsegment = 'MACHINERY' AS cpu, CAST(c_nationkey AS INT) AS n FROM customer)
SELECT c_custkey, CASE WHEN cpu THEN least(4, greatest(1, (greatest(1, greatest(1, n) - 1) + 3) // 4)) ELSE least(8, greatest(1, n)) END AS workers, CASE WHEN cpu THEN least(4, greatest(1, (greatest(1, greatest(1, n) - 1) + 3) // 4)) ELSE least(4, greatest(1, n)) END AS decoders,
  CASE WHEN cpu THEN least(4, greatest(1, greatest(1, n) // 8)) ELSE 8 END AS batch, CASE WHEN cpu THEN least(256, greatest(64, 8 * greatest(1, n))) ELSE 512 END AS block FROM c""")
def resource_profiles(spark, sf):
    r = V.resources(F.when(F.col("c_mktsegment") == "MACHINERY", " CPU ").otherwise(F.col("c_mktsegment")), F.col("c_nationkey").cast("int"), F.lit(0))
    return table(spark, sf, "customer").select("c_custkey", *(r[c].cast("int").alias(c) for c in ("workers", "decoders", "batch", "block")))


# lists of addresses: lines with a comment, the url again and a comma; the same short; bare hosts; a line of several urls; a comma inside a url; blank, missing
_SECOND, _BARE = "'https://second.example/' || id", "split_part(url, '://', 2)"
ADDRESS_LISTS = (
    f"url || chr(10) || '# ' || url || chr(13) || chr(10) || url || ' ' || {_SECOND} || ',' || chr(10) || url", f"url || chr(10) || '# c' || chr(13) || chr(10) || {_SECOND} || ',' || chr(10) || chr(10) || url",
    f"{_BARE} || ', h' || id || ';' || {_BARE} || '.second'", f"url || ' ' || {_SECOND} || '; ' || url || '#top,'", "url || '&x=1,' || id", "''", "CAST(NULL AS STRING)")
_ADDRESSES = "SELECT 'page' AS kind, page_id AS id, url FROM pages UNION ALL SELECT 'part', p_partkey, 'https://' || replace(p_name, ' ', '-') || '.example/' || p_partkey FROM part"
_URLS = r"regexp_extract_all(x, 'https?://[^ \t\n\x0B\f\r]+')"


@query(rf"""WITH l AS (SELECT kind, id, form, list_filter(list_transform(string_split_regex(coalesce(v, ''), '\r\n|\r|\n'), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT starts_with(x, '#')) AS lines FROM {_spelled_sql(_ADDRESSES, *ADDRESS_LISTS)}),
e AS (SELECT kind, id, form, list_filter(flatten(list_transform(lines, lambda x: CASE WHEN regexp_matches(x, '[,;]') AND NOT contains(split_part(x, ',', 1), '://') THEN list_transform(string_split_regex(x, '[,;]+'), lambda p: trim(p, ' '))
  WHEN len(regexp_extract_all(x, 'https?://')) > 1 THEN list_transform({_URLS}, lambda u: regexp_replace(u, '[,;]+$', '')) ELSE [regexp_replace(x, '[,;]+$', '')] END)), lambda x: trim(x, ' ') <> '') AS all_urls FROM l)
SELECT kind, id, form, coalesce(array_to_string(list_filter(all_urls, lambda x, i: list_position(all_urls, x) = i), ' '), '') AS urls FROM e""")
def url_lists(spark, sf):
    """Each page's url, and an address made of each part's name, in every form of a list."""
    pages = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url")
    made = F.concat(F.lit("https://"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".example/"), F.col("p_partkey").cast("string"))
    parts = table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), made.alias("url"))
    return _spelled(pages.unionAll(parts), *ADDRESS_LISTS).select("kind", "id", "form", F.array_join(V.url_list(F.col("v")), " ").alias("urls"))


@query("SELECT event_id, '***' AS secret, event_type || ' ?token=*** #1' AS note FROM events")
def masked_fields(spark, sf):
    """An event's properties as a secret field, its type in a note with a secret parameter."""
    m = V.masked_fields(F.create_map(F.lit("Session_Token"), F.col("props"), F.lit("note"), F.concat("event_type", F.lit(" ?token="), F.col("user_id").cast("string"), F.lit(" #1"))))
    return table(spark, sf, "events").select("event_id", F.element_at(m, "Session_Token").alias("secret"), F.element_at(m, "note").alias("note"))


@query("SELECT s_suppkey, upper(n_name[1:2]) AS country, CAST(s_suppkey * 60 AS INT) AS seconds, 'http://***@' || replace(s_name, '#', '-') || '.example:80/' AS masked FROM (SELECT s_suppkey, s_name, lower(n_name) AS n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey)")
def endpoint_marks(spark, sf):
    """Endpoints of suppliers, marked with the first letters of their nations and minutes."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("s_nationkey"))
    line = F.concat(F.lit("http://u_zone_"), F.lower(F.substring("n_name", 1, 2)), F.lit("_sessTime-"), F.col("s_suppkey").cast("string"), F.lit(":p@"), F.replace("s_name", F.lit("#"), F.lit("-")), F.lit(".example:80/"))
    return s.select("s_suppkey", R.country_of(line).alias("country"), R.session_seconds(line).alias("seconds"), R.masked_endpoint(line).alias("masked"))


# a supplier's endpoint: a mark by its nation (every other one is none), the long mark, the short one with an underscore, bare, with two hyphens; none; the long one without minutes before the short one
MINUTES = ("name || CASE WHEN nation % 2 = 0 THEN '-TIME_' ELSE '-tide_' END || id || '-y'", "name || '-sessTime-' || id", "name || '-x-TIME_' || id || '-y'", "name || '-time' || id", "name || '-time--' || id", "name || '-none'", "name || '-sesstime-x time-' || id")


@query("SELECT id AS s_suppkey, form, CAST(coalesce(nullif(regexp_extract(lower(v), 'sesstime-([0-9]+)', 1), ''), nullif(regexp_extract(lower(v), 'time[-_]?([0-9]+)', 1), '')) AS INT) * 60 AS seconds FROM "
       + _spelled_sql("SELECT 'supplier' AS kind, s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM supplier", *MINUTES))
def endpoint_minutes(spark, sf):
    """Every supplier's endpoint in every form of its minutes."""
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return _spelled(s, *MINUTES).select(F.col("id").alias("s_suppkey"), "form", R.session_seconds(F.col("v")).alias("seconds"))


# texts with a url: with user info and without; user info beside an at sign in a path; no url; no scheme; a scheme without a letter; an at sign in the path; missing; an entry of the pool that has a slash in its user info
_HOST, _ODD = "split_part(url, '://', 2)", "socks5://odd/name:pw@h:9"
MESSAGES = (
    "'from ' || replace(url, '://', '://some:one@') || ' and ' || url", "replace(url, '://', '://u:p@') || ' and https://x@y/z@w'", f"'no url ' || {_HOST} || ' a@b'", f"'://u@' || {_HOST}", f"'1://u@' || {_HOST}",
    "'a ' || url || '/p@q b'", "CAST(NULL AS STRING)", f"'pool {_ODD} end ' || url")
_ENDPOINTS = "SELECT 'page' AS kind, page_id AS id, url FROM pages UNION ALL SELECT 'supplier', s_suppkey, 'https://' || replace(s_name, '#', '-') || '.example:80/' FROM supplier"


@query(rf"SELECT kind, id, form, regexp_replace(replace(v, '{_ODD}', 'socks5://***@h:9'), '([A-Za-z0-9+.-]*[A-Za-z][A-Za-z0-9+.-]*://)[^/@ \t\n\x0B\f\r]+@', '\1***@', 'g') AS text FROM {_spelled_sql(_ENDPOINTS, *MESSAGES)}")
def masked_endpoints(spark, sf):
    """Each page's url, and each supplier's endpoint, in every form of a message."""
    pages = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url")
    made = F.concat(F.lit("https://"), F.replace("s_name", F.lit("#"), F.lit("-")), F.lit(".example:80/"))
    suppliers = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), made.alias("url"))
    return _spelled(pages.unionAll(suppliers), *MESSAGES).select("kind", "id", "form", R.masked_endpoint(F.col("v"), (_ODD,)).alias("text"))


def _pass(text: str, pattern: str, kept: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{kept}', 'g')"


_B, _W = r"\s\x1c-\x1f\x85\p{Z}", r"(^|[^\p{L}\p{N}_])"
_names = lambda words: "(?:" + "|".join(words) + ")"
_REDACTED = _pass("coalesce(text, '')", f"(?i){_W}({_names(R.SCHEMES)}://)[^{_B}/@]+@", r"\1\2***:***@")
_REDACTED = _pass(_REDACTED, f"(?i)([?&;/]{_names(R.QUERY_NAMES)}=)[^&#{_B}]+", r"\1***")
_REDACTED = _pass(_REDACTED, f"(?i){_W}({_names(R.FIELD_NAMES)}[{_B}]*[:=][{_B}]*)[^{_B},;]+", r"\1\2***")
_REDACTED = _pass(_REDACTED, f"(?i){_W}({_names(R.CREDENTIALS)})[{_B}]+[A-Za-z0-9_.~+/=-]+", r"\1\2 ***")
SQL["redacted_documents"] = f"SELECT doc_id, {_REDACTED} AS text FROM documents"
