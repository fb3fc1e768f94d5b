"""Text, value and endpoint rules over made-up inputs with the values they must give."""

from __future__ import annotations

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumaspan.functions import rules as R
from lumaspan.functions import text as T
from lumaspan.functions import values as V

CASES = {}


def rule(name, _source, _key, inputs, results, made):
    CASES[name] = (inputs, results, made)


def filled(value):
    return value.replace("{}", "17") if isinstance(value, str) else value


def _c(name: str) -> Column:
    return F.col(name)


# exit code, tail, cancelled, timed out -> class, retryable, proxy fault
ENDS = [
    (0, "done", False, False, "success", False, False), (4, "[x][error] broken page", False, False, "extraction_error", False, False),
    (8, "challenge", False, False, "cloudflare_challenge", True, True), (12, "e", False, False, "cloudflare_challenge", True, True),
    (16, "", False, False, "authentication", False, False), (32, "bad input", False, False, "input_error", False, False),
    (64, "no extractor", False, False, "unsupported_url", False, False), (1, "Unsupported URL '{}'", False, False, "unsupported_url", False, False),
    (128, "disk", False, False, "download_error", True, False), (1, "ProxyError: {}", False, False, "proxy_failure", True, True),
    (4, "HTTP 429 Too Many Requests", False, False, "site_transient", True, False), (1, "read Timed Out", False, False, "network_timeout", True, False),
    (1, "Login Required", False, False, "authentication", False, False), (16, "Insufficient privileges to access this resource", False, False, "proxy_access_failure", True, True),
    (4, "404 Not Found", False, False, "not_found", False, False), (None, "", False, False, "gallery_error", False, False), (1, "hm {}", False, False, "gallery_error", False, False),
    (1, "connection reset by peer", True, True, "cancelled", False, False), (1, "connection reset by peer", False, True, "task_timeout", True, True),
    (0, "slow", False, True, "task_timeout", True, False), (4, "use 'x' as input URL to continue downloading from the current position; connection reset", False, False, "download_error", True, True),
    (96, "", False, False, "unsupported_url", False, False), (None, None, False, False, "gallery_error", False, False),
]
def _end() -> Column:
    return T.outcome(_c("code"), _c("tail"), _c("cancelled"), _c("timed_out"))


rule("classified_results", "events", "event_id", dict(zip(("code", "tail", "cancelled", "timed_out"), (list(x) for x in list(zip(*ENDS))[:4]), strict=True)),
     dict(zip(("outcome", "retryable", "proxy_fault"), (list(x) for x in list(zip(*ENDS))[4:]), strict=True)),
     lambda: {"outcome": _end()["class"], "retryable": _end()["retryable"], "proxy_fault": _end()["proxy_fault"]})

KEYS = [
    ("https://www.pixiv.net/artworks/{}", "pixiv:{}"), ("https://pixiv.net/en/artworks/{}/", "pixiv:{}"), ("http://www.pixiv.net/i/{}", "pixiv:{}"),
    ("https://www.pixiv.net/member_illust.php?mode=medium&illust_id={}", "pixiv:{}"), ("https://i.pximg.net/img-original/img/2020/01/02/03/04/05/{}_p0.png", "pixiv:{}"),
    ("//i.pximg.net/c/600x600/img-master/img/2020/01/02/03/04/05/{}_p1_master1200.jpg", "pixiv:{}"), ("i.pximg.net/img-zip-ugoira/img/2020/01/02/03/04/05/{}_ugoira600x600.zip", "pixiv:{}"),
    ("http://img12.pixiv.net/img/someone/{}.jpg", "pixiv:{}"), ("http://i3.pixiv.net/img05/img/someone/{}_m.png", "pixiv:{}"), ("https://twitter.com/a_b/status/{}", "twitter:{}"),
    ("https://x.com/a_b/status/{}/photo/1", "twitter:{}"), ("https://mobile.twitter.com/i/web/status/{}?s=20", "twitter:{}"), ("www.fxtwitter.com/u/statuses/{}#x", "twitter:{}"),
    ("https://X.com./u/STATUS/{}", "twitter:{}"), ("https://www.pixiv.net/users/{}", None), ("https://x.com/user{}", None), ("https://example.com/status/{}", None), ("", None), (None, None),
    ("https://www.pixiv.net/member_illust.php?illust_id=a{}", None), ("https://i.pximg.net/user-profile/{}.jpg", None),
]
rule("source_keys", "pages", "page_id", {"url": [a for a, _ in KEYS]}, {"source_key": [b for _, b in KEYS]}, lambda: {"source_key": T.source_key(_c("url"))})

IDENTITIES = [("pixiv", " {} ", None, "pixiv:{}"), ("X", "{}", "https://example.com", "twitter:{}"), ("danbooru", "{}", "https://x.com/a/status/7", "twitter:7"), ("twitter", "ab", "https://pixiv.net/i/{}", "pixiv:{}"), (None, None, None, None), ("pixiv", "", "", None)]
rule("candidate_keys", "pages", "page_id", dict(zip(("site", "id", "url"), (list(x) for x in list(zip(*IDENTITIES))[:3]), strict=True)),
     {"source_key": [x[3] for x in IDENTITIES]}, lambda: {"source_key": T.candidate_key(_c("site"), _c("id"), _c("url"))})

ADDRESSES = [
    ("twitter", "http://twitter.com//Some_One/", "https://x.com/some_one/media"), ("twitter", "https://www.x.com/Some_One/Media?lang=en#top", "https://x.com/some_one/media"),
    ("twitter", "https://x.com/home", "https://x.com/home"), ("twitter", "https://x.com/a/status/{}", "https://x.com/a/status/{}"), ("pixiv", "https://pixiv.net/users/{}", "https://www.pixiv.net/users/{}/artworks"),
    ("pixiv", "https://www.pixiv.net/users/{}/artworks/?p=2", "https://www.pixiv.net/users/{}/artworks"), ("danbooru", "https://www.danbooru.donmai.us/posts?page=3&tags=a%20b", "https://danbooru.donmai.us/posts?tags=a+b"),
    ("danbooru", "https://danbooru.donmai.us/wiki?x=1", "https://danbooru.donmai.us/wiki?x=1"), ("exhentai", "http://exhentai.org/g/{}/0123456789/", "https://exhentai.org/g/{}/0123456789/"),
    ("exhentai", "https://exhentai.org//tag/x/", "https://exhentai.org/tag/x"), ("pawchive", "https://www.pawchive.st/fanbox/user/{}?o=50", "https://pawchive.pw/fanbox/user/{}"),
    ("pawchive", "https://pawchive.pw/search?q={}", "https://pawchive.pw/search?q={}"), ("pixiv", "not a url", "not a url"), ("pixiv", "https://other.example/", "https://other.example/"), ("twitter", "https://x.com", "https://x.com/"),
]
rule("canonical_urls", "pages", "page_id", {"site": [x[0] for x in ADDRESSES], "url": [x[1] for x in ADDRESSES]}, {"canonical": [x[2] for x in ADDRESSES]}, lambda: {"canonical": T.canonical_address(_c("site"), _c("url"))})

PROFILES = [
    ("https://twitter.com/Name{}", "twitter", "twitter", "https://x.com/name{}/media"), ("https://x.com/intent/user?id={}", "twitter", None, None), ("https://x.com/search", "twitter", None, None),
    ("https://www.pixiv.net/users/{}/illustrations", "pixiv", "pixiv", "https://www.pixiv.net/users/{}/artworks"), ("http://www.pixiv.net/member.php?id={}", "pixiv", "pixiv", "https://www.pixiv.net/users/{}/artworks"),
    ("https://www.pixiv.net/stacc/x", "pixiv", None, None), ("https://abc.fanbox.cc/", "fanbox", None, None), ("https://skeb.jp/@u{}", "skeb", None, None), ("https://www.Example.org/u/{}", "example.org", None, None), ("hello", "external", None, None),
]
def _p() -> Column:
    return T.external_profile(_c("url"))


rule("external_profiles", "pages", "page_id", {"url": [x[0] for x in PROFILES]}, dict(zip(("platform", "crawl_site", "crawl_url"), (list(x) for x in list(zip(*PROFILES))[1:]), strict=True)),
     lambda: {"platform": _p()["platform"], "crawl_site": _p()["crawl_site"], "crawl_url": _p()["crawl_url"]})

rule("thumbnail_urls", "pages", "page_id", {"url": ["https://file.example/data/{}.png", "https://other.example/{}.png", None, ""]},
     {"thumbnail": ["https://img.example/thumbnail/data/{}.png", "https://other.example/{}.png", None, ""]}, lambda: {"thumbnail": T.rewritten(_c("url"), "https://file.example/data/", "https://img.example/thumbnail/data/")})

TARGETS = [("HTTPS://Host{}.example/a?b", "https", "host{}.example", 443), ("http://h:8080/", "http", "h", 8080), ("http://h", "http", "h", 80), ("socks5://u:p@h:1080", "socks5", "h", 1080), ("ftp://h/", None, None, None), ("nothing", None, None, None), ("http://h:99999", None, None, None), (None, None, None, None)]
def _k() -> Column:
    return T.probe_key(_c("url"))


rule("probe_keys", "pages", "page_id", {"url": [x[0] for x in TARGETS]}, dict(zip(("scheme", "host", "port"), (list(x) for x in list(zip(*TARGETS))[1:]), strict=True)), lambda: {c: _k()[c] for c in ("scheme", "host", "port")})

TAGS = [("a: Some One ", "artist", "Some One", "artist:some one"), ("Artist:X{}", "artist", "X{}", "artist:x{}"), ("char:b", "character", "b", "character:b"), ("zzz:Q", "unknown", "Q", "unknown:q"), (" plain Tag ", "temp", "plain Tag", "temp:plain tag"), ("f:", None, None, None), ("", None, None, None), (None, None, None, None), ("series:a:b", "parody", "a:b", "parody:a:b")]
def _t() -> Column:
    return T.namespaced_tag(_c("tag"))


rule("namespaced_tags", "part", "p_partkey", {"tag": [x[0] for x in TAGS]}, dict(zip(("namespace", "value", "tag_key"), (list(x) for x in list(zip(*TAGS))[1:]), strict=True)), lambda: {"namespace": _t()["namespace"], "value": _t()["value"], "tag_key": _t()["key"]})

NAMES = [("https://h.example/a/b%20{}.jpg?x=1#y", "b {}.jpg"), ("https://h.example/", "image"), ("https://h.example", "image"), ("https://h.example/d/", "d"), ("https://h.example/a+b", "a+b"), ("https://h.example/%zz", "%zz")]
rule("file_names", "pages", "page_id", {"url": [a for a, _ in NAMES]}, {"name": [b for _, b in NAMES]}, lambda: {"name": T.file_name(_c("url"))})

HEADERS = [("attachment; filename=\"a {}.zip\"", "a {}.zip"), ("attachment; filename*=UTF-8''b%C3%A9.zip; filename=x", "bé.zip"), ("attachment; filename = plain{}.txt ; size=3", "plain{}.txt"), ("inline", ""), ("", "")]
rule("attachment_names", "pages", "page_id", {"header": [a for a, _ in HEADERS]}, {"name": [b for _, b in HEADERS]}, lambda: {"name": T.attachment_name(_c("header"))})

ASKED = [("https://h/p?a=1&nl=x#f", "https://h/p?a=1&nl=k+{}#f"), ("https://h/p", "https://h/p?nl=k+{}"), ("https://h/p?nl=1&nl=2&b=", "https://h/p?nl=k+{}&b="), ("https://h/p?", "https://h/p?nl=k+{}")]
rule("query_parameters", "pages", "page_id", {"url": [a for a, _ in ASKED], "value": ["k {}"]}, {"url": [b for _, b in ASKED]}, lambda: {"url": T.with_parameter(_c("url"), "nl", _c("value"))})

SECRETS = [
    ("GET https://user:pw@h.example/x?token=abc&x=1 ok", "GET https://***:***@h.example/x?token=*** ok"), ("socks5://u@h:1", "socks5://***:***@h:1"), ("Authorization: Bearer abc.def", "Authorization: *** abc.def"),
    ("password = hunter{}, next", "password = ***, next"), ("used Basic dXNlcjpw==", "used Basic ***"), ("hidden-{}-value here", "hidden-{}-value here"), ("the known-secret is known-secret", "the *** is ***"),
    ("api_key=1;cookie: a=b; c", "api_key=***;cookie: ***; c"), ("tokens are fine", "tokens are fine"), (None, ""), ("", ""), ("x?access_token=q&sig=z#y", "x?access_token=***&sig=***#y"),
]
rule("redaction_cases", "documents", "doc_id", {"text": [a for a, _ in SECRETS]}, {"text": [b for _, b in SECRETS]}, lambda: {"text": R.redacted(_c("text"), ("known-secret",))})

ENDPOINTS = [
    ("http://u_zone_us_x:p@h.example:80", "US", None), ("http://a-jp-sid-7-sessTime-{}:p@h.example:80", "JP", "m"), ("de.example.net:8080", "DE", None), ("socks5://host.example:1080", "??", None),
    ("http://region-Fr-x:p@h:1", "FR", None), ("zone:us host", "??", None), ("http://country_gb:p@h:1?time_5", "GB", 300), ("x-zones-us", "??", None), ("u-ca-session-1", "CA", None), ("", "??", None),
]
rule("endpoint_marks", "supplier", "s_suppkey", {"line": [x[0] for x in ENDPOINTS]}, {"country": [x[1] for x in ENDPOINTS]}, lambda: {"country": R.country_of(_c("line"))})
rule("endpoint_minutes", "supplier", "s_suppkey", {"line": ["sessTime-17", "x-TIME_17-y", "time17", "time--17", "none", "sesstime-x time-17"]}, {"seconds": [1020, 1020, 1020, None, None, 1020]}, lambda: {"seconds": R.session_seconds(F.col("line"))})
MASKED = [("http://u:p@h:1 and https://x@y/z@w", "http://***@h:1 and https://***@y/z@w"), ("no url a@b", "no url a@b"), ("://u@h", "://u@h"), ("1://u@h", "1://u@h"), ("a http://h/p@q b", "a http://h/p@q b"), (None, None), ("pool socks5://odd/name:pw@h:9 end", "pool socks5://***@h:9 end")]
rule("masked_endpoints", "supplier", "s_suppkey", {"text": [a for a, _ in MASKED]}, {"text": [b for _, b in MASKED]}, lambda: {"text": R.masked_endpoint(_c("text"), ("socks5://odd/name:pw@h:9",))})

rule("trimmed_values", "part", "p_partkey", {"v": ["  a {} ", "", "  ", None, "12", "-7 ", "1.5", "+3", "x"]},
      {"text": ["a {}", None, None, None, "12", "-7", "1.5", "+3", "x"], "number": [None, None, None, None, 12, -7, None, 3, None]}, lambda: {"text": V.trimmed(F.col("v")), "number": V.whole_number(F.col("v"))})
rule("word_lists", "part", "p_partkey", {"v": ["a  b c d", "", None, " one{} "]}, {"words": ["a|b|c", "", "", "one{}"]}, lambda: {"words": F.array_join(V.split_list(F.col("v"), 3), "|")})
rule("identity_keys", "part", "p_partkey", {"v": ["@Some Name", " A__b - C_", "@@x{}", "", None]}, {"key": ["some_name", "a_b_c", "x{}", "", None]}, lambda: {"key": V.identity_key(F.col("v"))})
rule("resource_profiles", "supplier", "s_suppkey", {"d": ["cpu", "CPU", "cuda", None, "cpu"], "n": [16, 4, 16, 2, 64], "w": [0, 3, 0, 0, 0]},
      {"workers": [4, 3, 8, 2, 4], "decoders": [4, 3, 4, 2, 4], "batch": [2, 1, 8, 8, 4], "block": [128, 64, 512, 512, 256]},
      lambda: {c: V.resources(F.col("d"), F.col("n"), F.col("w"))[c] for c in ("workers", "decoders", "batch", "block")})

rule("url_lists", "part", "p_partkey", {"v": ["http://a/{}\n# c\r\nhttp://b,\n\nhttp://a/{}", "h1, h2;h3", "http://a http://b; https://c,", "http://a?x=1,2", "", None]},
      {"urls": ["http://a/{} http://b", "h1 h2 h3", "http://a http://b https://c", "http://a?x=1,2", "", ""]}, lambda: {"urls": F.array_join(V.url_list(F.col("v")), " ")})



rule("masked_fields", "supplier", "s_suppkey", {"k": ["Access_Token", "note", "api-key", "name"], "v": ["abc", "used Basic dXNlcg==", "k", "plain"]}, {"v": ["***", "used Basic ***", "***", "plain"]},
     lambda: {"v": F.element_at(V.masked_fields(F.create_map(F.col("k"), F.col("v"))), F.col("k"))})
rule("references", "pages", "page_id", {"url": ["https://www.pixiv.net/member_illust.php?mode=medium&amp;illust_id={}", "https://i.pximg.net/img-original/img/{}x.png", "https://pixiv.net/artworks/", "https://x.com/a/status/status/{}"]}, {"source_key": ["pixiv:{}", None, None, "twitter:{}"]},
     lambda: {"source_key": T.source_key(F.col("url"))})
rule("messages", "events", "event_id", {"tail": ["one\nlast token=abc \n \n", None, "x" * 1200]}, {"message": ["last token=***", "", "x" * 1000]}, lambda: {"message": T.outcome_message(F.col("tail"))})


@pytest.mark.parametrize("name", sorted(CASES))
def test_rule(spark, name):
    inputs, results, made = CASES[name]
    n = max(map(len, [*inputs.values(), *results.values()]))
    kinds = {c: next((type(x) for x in v if x is not None), str) for c, v in inputs.items()}
    schema = "_row int, " + ", ".join(f"{c} {({str: 'string', int: 'int', bool: 'boolean'})[k]}" for c, k in kinds.items())
    df = spark.createDataFrame([(i, *(filled(v[i % len(v)]) for v in inputs.values())) for i in range(n)], schema)
    got = [tuple(r)[1:] for r in df.select("_row", *(c.alias(k) for k, c in made().items())).orderBy("_row").collect()]
    assert got == [tuple(filled(v[i % len(v)]) for v in results.values()) for i in range(n)]
