"""Rules as column expressions: similarities, geometry, throttling, cooldowns, endpoint lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    """The dot product clipped to -1 .. 1; null if a vector is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b))))


def aspect_delta(w1: str, h1: str, w2: str, h2: str) -> Column:
    return F.abs(F.log((F.col(w1) / F.col(h1)) / (F.col(w2) / F.col(h2))))


def resolution_ratio(w1: str, h1: str, w2: str, h2: str) -> Column:
    a, b = F.col(w1) * F.col(h1), F.col(w2) * F.col(h2)
    return F.greatest(a, b) / F.least(a, b)


def unit_digest(site: Column, url: Column, args: Column) -> Column:
    """SHA-256 of a work unit's compact JSON [site, url, [arguments]], in hex; other characters than ASCII stay as they are."""
    head = F.to_json(F.array(site, url))
    return F.sha2(F.encode(F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(","), F.to_json(args), F.lit("]")), "utf-8"), 256)


def should_skip(force: Column, interval: Column, last: Column, now: Column) -> Column:
    return ~force & (interval > 0) & (last > 0) & (now - last < interval)


def node_cooldown(tls: Column, streak: Column, fails: Column, base: float = 30.0, tls_base: float = 60.0, cap: float = 600.0) -> Column:
    """Seconds: doubled by each failed handshake in a row up to the cap; other failures grow linearly to four times."""
    doubled = F.least(F.lit(cap), tls_base * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.least(streak - 1, F.lit(4)))))
    return F.when(tls, doubled).otherwise(base * F.greatest(F.lit(1), F.least(fails, F.lit(4))))


def endpoint_url(line: Column) -> Column:
    """url, socks5 prefix, host:port:user:pass, user:pass@host:port or host:port as one url; empty if blank."""
    t = F.trim(line)
    quoted = t.rlike(r"""^(".*"|'.*')$""") & (F.length(t) >= 2)
    t = F.when(quoted, F.trim(F.substr(t, F.lit(2), F.length(t) - 2))).otherwise(t)
    parts = F.split(t, ":", 4)
    four = ~t.contains("@") & (F.size(parts) == 4) & F.get(parts, F.lit(0)).rlike(".") & F.get(parts, F.lit(1)).rlike(r"^\d+$")
    socks = F.regexp_extract(F.lower(t), "^(socks5h?)", 1)
    rest = F.regexp_replace(F.ltrim(F.substr(t, F.length(socks) + 1)), r"^//\s*", "")
    return (
        F.when(t == "", F.lit("")).when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(socks != "", F.concat(socks, F.lit("://"), rest))
        .when(four, F.concat(F.lit("http://"), F.get(parts, F.lit(2)), F.lit(":"), F.get(parts, F.lit(3)), F.lit("@"), F.get(parts, F.lit(0)), F.lit(":"), F.get(parts, F.lit(1))))
        .otherwise(F.concat(F.lit("http://"), t))
    )


def endpoint_host(url: Column) -> Column:
    """The lower-cased host of an endpoint url, without user info, port and brackets."""
    place = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^.*@", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(place, r":\d*$", ""), r"^\[|\]$", "")))


def masked_endpoint(text: Column, pool: tuple[str, ...] = ()) -> Column:
    """User info of urls in a text becomes three stars; host and port stay. Entries of the pool are masked literally first."""
    for entry in filter(None, pool):
        place = entry.split("://", 1)[-1]
        kept = place.rpartition("@")[2]
        if kept != place:
            text = F.replace(text, F.lit(entry), F.lit(entry[: len(entry) - len(place)] + "***@" + kept))
    parts = F.split(text, "://")

    def cut(part: Column, i: Column) -> Column:
        before = F.get(parts, i - 1)
        named = before.rlike("[A-Za-z0-9+.-]$") & F.regexp_extract(before, "([A-Za-z0-9+.-]*)$", 1).rlike("[A-Za-z]")
        at = F.instr(F.regexp_extract(part, r"^[^/\s]*", 0), "@")
        return F.when((i > 0) & named & (at > 1), F.concat(F.lit("***"), F.substr(part, at))).otherwise(part)

    return F.array_join(F.transform(parts, cut), "://")


# Schemes whose user info is secret, names of secret query parameters and fields, kinds of credentials.
SCHEMES = ("http", "https", "socks4", "socks5", "socks5h", "ss", "ssr", "vmess", "vless", "trojan", "hysteria", "hysteria2", "hy2", "tuic", "anytls", "mieru")
QUERY_NAMES = (
    "token", "access_token", "apikey", "api_key", "api-key", "auth", "password", "passwd", "secret", "session", "cookie", "signature", "sig", "code", "email",
    "username", "keystamp", "fileindex",
)
FIELD_NAMES = ("authorization", "proxy-authorization", "cookie", "set-cookie", "token", "apikey", "api_key", "api-key", "password", "passwd", "secret")
CREDENTIALS = ("bearer", "basic")

_BLANK = r"\s\x1c-\x1f\x85\p{Z}"
_LETTER = r"\p{L}\p{N}_"


def _any(words: tuple[str, ...]) -> str:
    return "(?iu:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def _run(*without: str) -> str:
    """Characters but blanks and the given ones, one at least."""
    return f"[^{_BLANK}{''.join(without)}]+"


def without_user_info(text: Column) -> Column:
    """Between a known scheme's :// and an @ that no blank or slash comes before, stars."""
    parts = F.split(text, "://")

    def cut(part: Column, i: Column) -> Column:
        word = F.lower(F.regexp_extract(F.get(parts, i - 1), f"([{_LETTER}]*)$", 1))
        own = F.regexp_extract(part, f"^{_run('/', '@')}@", 0)
        return F.when((i > 0) & word.isin(*SCHEMES) & (own != ""), F.concat(F.lit("***:***@"), F.substr(part, F.length(own) + 1))).otherwise(part)

    return F.array_join(F.transform(parts, cut), "://")


def redacted(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Literal secrets, user info of urls, query secrets, fields with a separator and a value, credentials; the whole text, empty if null."""
    t = F.coalesce(text, F.lit(""))
    for secret in filter(None, secrets):
        t = F.replace(t, F.lit(secret), F.lit("***"))
    t = without_user_info(t)
    gap = f"[{_BLANK}]*"
    asked = f"([?&;/]{_any(QUERY_NAMES)}=){_run('&', '#')}"
    field = f"((?<![{_LETTER}]){_any(FIELD_NAMES)}(?![{_LETTER}]){gap}[=:]{gap}){_run(',', ';')}"
    shown = f"((?<![{_LETTER}]){_any(CREDENTIALS)})[{_BLANK}]+[\\w.~+/=-]+"
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, asked, "$1***"), field, "$1***"), shown, "$1 ***")


# The words that stand before a country or after it, and before minutes.
COUNTRY_MARKS = ("zone", "region", "country")
SESSION_MARKS = ("sid", "sess")
MINUTE_MARKS = ("sesstime-", "time")


def country_of(line: Column) -> Column:
    """The two-letter token after one that ends in a country mark, else one before a session mark, else a host label of two letters; else ??.

    Tokens are joined by single hyphens or underscores; anything else between them keeps them apart."""
    tokens = F.split(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}_-]+", "-|-"), "[-_]")
    two = lambda t: t.rlike("^[a-z]{2}$")
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    near = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), F.get(tokens, i - 1).alias("before"), F.get(tokens, i + 1).alias("after"), i.alias("i")))
    first = lambda test: F.upper(F.get(F.filter(near, test), F.lit(0))["t"])
    marked = first(lambda x: two(x.t) & any_of([x.before.endswith(m) for m in COUNTRY_MARKS]))
    session = first(lambda x: two(x.t) & (x.i > 0) & (x.before != "|") & any_of([x.after.startswith(m) for m in SESSION_MARKS]))
    label = F.split(endpoint_host(endpoint_url(line)), r"\.")[0]
    return F.coalesce(marked, session, F.when(two(label), F.upper(label)), F.lit("??"))


def session_seconds(line: Column) -> Column:
    """Minutes after a session mark as seconds; null without one. The plain mark may have a hyphen or underscore behind it."""
    def minutes(mark: str) -> Column:
        loose = "" if mark.endswith("-") else "[-_]?"
        digits = F.transform(F.slice(F.split(F.lower(line), mark), 2, 1 << 20), lambda x: F.regexp_extract(x, f"^{loose}([0-9]+)", 1))
        return F.get(F.filter(digits, lambda d: d != ""), F.lit(0))

    return F.coalesce(*map(minutes, MINUTE_MARKS)).cast("int") * 60
