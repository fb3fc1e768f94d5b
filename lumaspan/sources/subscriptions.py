"""Nodes of subscription bodies: share links, indented lists, flow maps and three JSON forms, as one table of nodes.

A body, after at most two layers of base64, is read by its form: JSON (``proxies``, ``outbounds``, ``servers`` or a bare list), an
indented document with a ``proxies`` key (or a list at the top), else a share link in each line. Every entry gives one row, a broken
one with ``error``:
address (no host, or no port of 1 to 65535), credentials (the scheme needs some), scheme (unknown), deep (nested too far), large (the body).
Blank lines and comments give none, and neither do null bodies.

Indented documents become a tree by columns: the parent of an entry is the last one before it that stands further left. A dash stands
half a column right of its own column, so that a list may stand under a key of the same column. Which entries are open at a line
follows from the last entry of each level before it, one window over the body's lines. A body has at most ``MAX_BYTES``, so that a
window's part is bounded however many bodies there are. Block texts (``|``, ``>``) and anchors are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaspan.operators.storage import stored

MAX_BYTES = 8 << 20
LEVELS = 12  # different columns at which a body's entries may stand
FLOW_DEPTH = 3  # flow maps inside each other

# Schemes, other names of schemes, and what a scheme needs.
DIRECT = ("http", "https", "socks4", "socks5", "socks5h")
TUNNELS = ("vless", "vmess", "ss", "ssr", "trojan", "hysteria", "hysteria2", "tuic", "anytls", "mieru")
OTHER_NAMES = {"hy2": "hysteria2", "shadowsocks": "ss", "socks": "socks5"}
NEEDS_USER = ("vless", "vmess", "tuic", "mieru")
NEEDS_SECRET = ("ss", "ssr", "trojan", "hysteria2", "tuic", "anytls", "mieru")
NEEDS_CIPHER = ("ss", "ssr")
# Names of fields in the forms of documents.
NAMES = ("name", "tag", "ps", "remarks")
HOSTS = ("server", "add")
PORTS = ("server_port", "port")
USERS = ("uuid", "id", "username", "user")
SECRETS = ("password", "passwd", "auth", "auth-str", "auth_str")
CIPHERS = ("cipher", "method")

NODE = "scheme string, host string, port int, username string, secret string, name string, options map<string,string>, usable boolean, error string"


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def decoded(packed: Column) -> Column:
    """Base64 of either alphabet, padded or not, as text; null if it is none or no UTF-8."""
    bare = F.rtrim(F.translate(F.regexp_replace(packed, r"\s", ""), "-_", "+/"), F.lit("="))
    full = F.rpad(bare, ((F.length(bare) + 3) / 4).cast("int") * 4, "=")
    return F.when(bare.rlike("^[A-Za-z0-9+/]+$"), F.try_validate_utf8(F.try_to_binary(full, F.lit("base64")).cast("string")))


def percent(text: Column) -> Column:
    """Percent escapes undone; a plus stays, and so does a text with a broken escape."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def kept(rows: DataFrame, column: str) -> DataFrame:
    """The same rows; what is asked of the column is not worked out anew in each filter that the optimizer moves down."""
    return rows.withColumn(column, F.explode(F.array(column)))


def opened(bodies: DataFrame, layers: int = 2) -> DataFrame:
    """The bodies without their layers of base64; what comes out must look like a list or document."""
    for _ in range(layers):
        inner = F.when(F.length(F.regexp_replace("body", r"\s", "")) >= 16, F.trim(decoded(F.col("body"))))
        bodies = kept(bodies.withColumn("_inner", inner), "_inner")
        looks = F.col("_inner").contains("://") | F.col("_inner").contains("\n") | F.col("_inner").rlike(r"^(proxies:|\{|\[)")
        bodies = kept(bodies.withColumn("body", F.when(looks, F.col("_inner")).otherwise(F.col("body"))).drop("_inner"), "body")
    return bodies


def first_map(entries: Column) -> Column:
    """A map of (key, value) structs; of a repeated key the first one counts."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1))


def query_map(query: Column) -> Column:
    parts = F.filter(F.split(empty(query), "&"), lambda p: p != "")
    pair = lambda p: F.struct(percent(F.substring_index(p, "=", 1)).alias("key"), percent(F.regexp_extract(p, "=(.*)$", 1)).alias("value"))
    return first_map(F.transform(parts, pair))


def place(text: Column) -> tuple[Column, Column]:
    """Host and port of host:port; brackets of addresses go."""
    port = F.regexp_extract(text, r":([0-9]{1,5})$", 1)
    host = F.regexp_replace(text, r":[0-9]{1,5}$", "")
    host = F.when(host.rlike(r"^\[[0-9A-Fa-f:.]+\]$"), F.substr(host, F.lit(2), F.length(host) - 2)).when(host.rlike(r"[\s:\[\]/@]"), F.lit("")).otherwise(host)
    return host, port.try_cast("int")


def parts(scheme: Column, host: Column, port: Column, user: Column, secret: Column, name: Column, options: Column) -> Column:
    return F.struct(
        scheme.alias("scheme"), host.alias("host"), port.cast("int").alias("port"), empty(user).alias("username"), empty(secret).alias("secret"), F.trim(empty(name)).alias("name"),
        options.alias("options"))


def judged(rows: DataFrame, column: str = "_n") -> DataFrame:
    """The rows with their ``parts`` in place of the column, a scheme's other names replaced, usability and error."""
    d = kept(rows, column).select(*(c for c in rows.columns if c != column), f"{column}.*")
    other = F.create_map(*(F.lit(x) for kv in OTHER_NAMES.items() for x in kv))
    d = d.withColumn("scheme", F.coalesce(F.try_element_at(other, "scheme"), "scheme"))
    s, user, secret = F.col("scheme"), F.col("username"), F.col("secret")
    lacks = (s.isin(*NEEDS_USER) & (user == "")) | (s.isin(*NEEDS_SECRET) & (secret == "")) | (s.isin(*NEEDS_CIPHER) & (empty(F.try_element_at("options", F.lit("cipher"))) == ""))
    error = (
        F.when(~empty(s).isin(*DIRECT, *TUNNELS), "scheme").when((empty(F.col("host")) == "") | ~F.coalesce(F.col("port").between(1, 65535), F.lit(False)), "address")
        .when(lacks, "credentials")
    )
    d = d.withColumn("error", error)
    socks = s.startswith("socks") & ((user != "") | (secret != ""))
    d = d.withColumn("usable", F.col("error").isNull() & s.isin(*DIRECT) & ~socks)
    return d.withColumn("name", F.when((F.col("name") == "") & s.isin(*TUNNELS), F.concat(s, F.lit("-"), empty(F.col("host")))).otherwise(F.col("name")))


def linked(rows: DataFrame, line: str = "line") -> DataFrame:
    """The rows and the columns of ``NODE``, read from a share link, host:port:user:password or host:port."""
    t = F.trim(F.col(line))
    d = rows.withColumn("_s", F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))
    d = d.withColumn("_rest", F.when(F.col("_s") == "", t).otherwise(F.substr(t, F.length("_s") + 4)))
    d = d.withColumn("_main", F.substring_index("_rest", "#", 1)).withColumn("_name", percent(F.regexp_extract("_rest", "#(.*)$", 1)))
    packed = F.col("_s").isin("vmess", "ssr") | ((F.col("_s") == "ss") & ~F.col("_main").contains("@"))
    d = d.withColumn("_open", F.when(packed, empty(decoded(F.substring_index("_main", "?", 1)))))
    d = d.withColumn("_main", F.when(F.col("_s").isin("ss", "ssr") & F.col("_open").isNotNull(), F.concat("_open", F.regexp_extract("_main", r"\?.*$", 0))).otherwise(F.col("_main")))
    d = d.withColumn("_asked", query_map(F.regexp_extract("_main", r"\?(.*)$", 1)))
    d = d.withColumn("_front", F.regexp_replace(F.substring_index("_main", "?", 1), "/+$", ""))
    d = d.withColumn("_place", F.regexp_extract("_front", "([^@]*)$", 1)).withColumn("_own", F.when(F.col("_front").contains("@"), F.regexp_extract("_front", "^(.*)@", 1)).otherwise(""))
    d = d.withColumn("_own", F.when(F.col("_s") == "ss", F.coalesce(F.when(~F.col("_own").contains(":"), decoded(percent(F.col("_own")))), F.col("_own"))).otherwise(F.col("_own")))
    bare = F.split("_front", ":", 4)
    four = (F.col("_s") == "") & (F.size(bare) == 4) & F.get(bare, F.lit(1)).rlike("^[0-9]{1,5}$") & F.get(bare, F.lit(0)).rlike(r"^[A-Za-z0-9._-]+$")
    two = (F.col("_s") == "") & F.col("_front").rlike(r"^[A-Za-z0-9._-]+:[0-9]{1,5}$")
    host, port = place(F.col("_place"))
    plain_port = F.coalesce(port, F.when(F.col("_s") == "https", 443).when(F.col("_s").isin(*DIRECT), 80))
    left, right = percent(F.substring_index("_own", ":", 1)), percent(F.regexp_extract("_own", ":(.*)$", 1))
    scheme = F.when(F.col("_s") == "hy2", "hysteria2").otherwise(F.col("_s"))
    whole_secret = F.col("_s").isin("trojan", "hysteria", "hysteria2", "hy2", "anytls")
    asked = lambda k: F.try_element_at("_asked", F.lit(k))
    with_cipher = F.when(F.col("_s") == "ss", first_map(F.concat(F.array(F.struct(F.lit("cipher").alias("key"), left.alias("value"))), F.map_entries("_asked")))).otherwise(F.col("_asked"))
    v = F.try_parse_json("_open")
    field = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    message = parts(scheme, F.coalesce(field("add"), field("host")), field("port").try_cast("int"), field("id"), F.lit(""), F.coalesce(F.nullif(field("ps"), F.lit("")), F.col("_name")),
                   F.map_filter(F.coalesce(F.try_variant_get(v, "$", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, x: ~k.isin("add", "port", "id", "ps") & (x != "")))
    six = F.split(F.substring_index("_main", "/?", 1), ":")
    nth = lambda i: F.element_at(six, F.when(F.size(six) >= 6, F.lit(i)).otherwise(F.lit(-1)))
    extra = query_map(F.regexp_extract("_main", r"/\?(.*)$", 1))
    old_host = F.regexp_replace(F.array_join(F.slice(six, 1, F.greatest(F.size(six) - 5, F.lit(0))), ":"), r"^\[|\]$", "")
    old = parts(scheme, old_host, nth(-5).try_cast("int"), F.lit(""), decoded(nth(-1)), F.coalesce(decoded(F.try_element_at(extra, F.lit("remarks"))), F.col("_name")),
               F.create_map(F.lit("protocol"), nth(-4), F.lit("cipher"), nth(-3), F.lit("obfs"), nth(-2)))
    get = lambda i: F.get(bare, F.lit(i))
    none = F.col("_asked")
    found = (
        F.when(four, parts(F.lit("http"), get(0), get(1).try_cast("int"), get(2), get(3), F.lit(""), none))
        .when(two, parts(F.lit("http"), get(0), get(1).try_cast("int"), F.lit(""), F.lit(""), F.lit(""), none))
        .when(F.col("_s") == "vmess", message).when(F.col("_s") == "ssr", old)
        .otherwise(parts(
            scheme, F.when(scheme.isin(*DIRECT), F.lower(host)).otherwise(host), plain_port, F.when(whole_secret | (F.col("_s") == "ss"), "").otherwise(left),
            F.when(whole_secret, F.coalesce(F.nullif(percent(F.col("_own")), F.lit("")), asked("auth"))).otherwise(right), F.col("_name"), with_cipher))
    )
    return judged(d.select(*rows.columns, found.alias("_n")))


# A quoted text, a flow map (two more inside at most), a list, or anything up to the next comma.
_QUOTED = r'"(?:[^"\\]++|\\.)*+"|' + r"'(?:[^']++|'')*+'"
_MAP = r"\{(?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+\}"
_PAIR = rf"(?:^|,)\s*+({_QUOTED}|[^,:{{}}\[\]\"'\s][^,:{{}}\[\]]*+)\s*+:\s*+({_QUOTED}|{_MAP}|\[[^\[\]]*+\]|[^,{{}}\[\]]*+)"
_KEYED = rf"^({_QUOTED}|[^\s:{{\[\"'#-][^:]*+|-[^\s:][^:]*+)\s*+:(?:\s++(.*))?$"


def scalar(text: Column) -> Column:
    """A value without quotes and comment; a list joined by commas; null for null and nothing."""
    t = F.trim(text)
    first = F.regexp_extract(t, rf"^(?:{_QUOTED})", 0)
    quoted = F.when(F.substr(first, F.lit(1), F.lit(1)) == '"', F.regexp_replace(F.substr(first, F.lit(2), F.length(first) - 2), r"\\(.)", "$1")).otherwise(F.replace(F.substr(first, F.lit(2), F.length(first) - 2), F.lit("''"), F.lit("'")))
    inside = F.regexp_extract(t, r"^\[([^\[\]]*)\]", 1)
    items = F.filter(F.transform(F.split(inside, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")
    plain = F.trim(F.regexp_replace(t, r"(^|\s)#.*$", ""))
    return F.when(first != "", quoted).when(t.startswith("["), F.array_join(items, ",")).when(plain.isin("", "~", "null"), F.lit(None).cast("string")).otherwise(plain)


def flattened(entries: DataFrame) -> DataFrame:
    """Entries (source, item, at, path, value) with flow maps as entries of their own below the path."""
    for _ in range(FLOW_DEPTH):
        flow = F.trim("value").rlike(r"^\{.*\}$")
        inside = F.regexp_extract(F.trim("value"), r"^\{(.*)\}$", 1)
        keys, values = F.regexp_extract_all(inside, F.lit(_PAIR), F.lit(1)), F.regexp_extract_all(inside, F.lit(_PAIR), F.lit(2))
        pairs = F.when(flow, F.zip_with(keys, values, lambda k, v: F.struct(F.concat_ws(".", F.nullif("path", F.lit("")), scalar(k)).alias("path"), v.alias("value"))))
        d = entries.withColumn("_p", F.coalesce(pairs, F.array(F.struct(F.col("path"), F.col("value")))))
        entries = d.select("source", "item", "at", F.explode("_p").alias("_e")).select("source", "item", "at", "_e.path", "_e.value")
    return entries


def tree(bodies: DataFrame) -> DataFrame:
    """bodies: source, body. source, at, level, key, value, dash and ``above``, the open entries (at, key, dash) from the root down; null if an entry is too deep."""
    lines = bodies.select("source", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line")).where(~F.col("line").rlike(r"^\s*(#|---|\.\.\.|$)"))
    indent = F.length(F.regexp_extract("line", "^ *", 0))
    dashes = F.regexp_extract_all(F.regexp_extract("line", r"^ *((?:- +)*(?:-$)?)", 1), F.lit("- *"), F.lit(0))
    width = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    none = F.lit(None).cast("string")
    marks = F.transform(dashes, lambda x, i: F.struct((2 * (indent + width(F.slice(dashes, 1, i))) + 1).alias("level"), none.alias("key"), none.alias("value"), F.lit(True).alias("dash")))
    content = F.trim(F.substr("line", indent + width(dashes) + 1))
    keyed = content.rlike(_KEYED)
    own = F.struct((2 * (indent + width(dashes))).alias("level"), F.when(keyed, scalar(F.regexp_extract(content, _KEYED, 1))).alias("key"), F.when(keyed, F.regexp_extract(content, _KEYED, 2)).otherwise(content).alias("value"), F.lit(False).alias("dash"))
    d = lines.select("source", "pos", F.posexplode(F.concat(marks, F.when(content != "", F.array(own)).otherwise(F.array().cast("array<struct<level:int,key:string,value:string,dash:boolean>>")))).alias("i", "e"))
    order = Window.partitionBy("source").orderBy("pos", "i")
    d = d.select("source", "e.*", F.row_number().over(order).alias("at"), "pos", "i").drop("pos", "i")
    d = d.withColumn("_d", F.dense_rank().over(Window.partitionBy("source").orderBy("level")) - 1)
    before = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = F.array(*(F.max(F.when(F.col("_d") == k, F.struct("at", "key", "dash"))).over(before) for k in range(LEVELS)))
    d = d.withColumn("_last", last)
    closer = lambda i: F.coalesce(F.array_max(F.transform(F.slice("_last", 1, i), lambda y: y["at"])), F.lit(0))
    above = F.filter("_last", lambda x, i: x.isNotNull() & (i < F.col("_d")) & (x["at"] > closer(i)))
    return d.select("source", "at", "level", "key", "value", "dash", F.when(F.col("_d") < LEVELS, above).alias("above"))


def tree_items(bodies: DataFrame, root: str = "proxies") -> tuple[DataFrame, DataFrame]:
    """Entries (source, item, at, path, value) of the items of the root list, and the scalar items (source, pos, line)."""
    d = tree(bodies)
    skip = F.when(F.get("above", F.lit(0))["dash"], 0).when((F.get("above", F.lit(0))["key"] == root) & F.get("above", F.lit(1))["dash"], 1)
    d = d.where(~F.col("dash")).withColumn("_k", F.when(F.col("above").isNull(), -1).otherwise(skip)).where("_k is not null")
    item = F.get("above", F.col("_k"))["at"]
    deep = d.where("_k < 0").select("source", F.col("at").alias("item"), "at", F.lit("_deep").alias("path"), F.lit("1").alias("value"))
    d = d.where("_k >= 0")
    names = F.filter(F.transform(F.slice("above", F.col("_k") + 2, F.size("above")), lambda x: x["key"]), lambda x: x.isNotNull())
    d = d.select("source", item.alias("item"), "at", F.array_join(F.concat(names, F.array_compact(F.array("key"))), ".").alias("path"), "value")
    alone = (F.col("path") == "") & ~F.trim("value").startswith("{")
    return d.where(~alone).unionByName(deep), d.where(alone).select("source", F.col("item").alias("pos"), scalar(F.col("value")).alias("line"))


def json_items(bodies: DataFrame) -> DataFrame:
    """Entries of the items of a JSON body; items that are no objects give an entry without fields."""
    v = F.try_parse_json("body")
    lists = F.coalesce(*(F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("proxies", "outbounds", "servers")), F.try_variant_get(v, "$", "array<variant>"))
    d = bodies.select("source", F.posexplode(lists).alias("item", "v"))
    fields = F.coalesce(F.try_variant_get("v", "$", "map<string,string>"), F.create_map(F.lit("_odd"), F.lit("1")))
    return d.select("source", "item", F.col("item").alias("at"), F.explode(F.map_entries(fields)).alias("_e")).select("source", "item", "at", F.col("_e.key").alias("path"), F.col("_e.value").alias("value"))


def field_nodes(entries: DataFrame) -> DataFrame:
    """source, pos and node of the items whose fields are given as entries; of a repeated key the last counts, items of a list are joined."""
    e = flattened(entries).withColumn("value", scalar(F.col("value")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), ",")
    inside = F.col("path").isin(*NAMES, *HOSTS, *PORTS, *USERS, *SECRETS, *CIPHERS, "type")
    one = e.groupBy("source", "item", "path").agg(F.when(inside, F.max_by("value", "at")).otherwise(joined).alias("value"))
    d = one.groupBy("source", "item").agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("m"))
    get = lambda names: F.coalesce(*(F.nullif(F.try_element_at("m", F.lit(n)), F.lit("")) for n in names))
    known = [*NAMES, *HOSTS, *PORTS, *USERS, *SECRETS, *CIPHERS, "type", "_odd", "_deep"]
    rest = F.map_filter("m", lambda k, v: ~k.isin(*known) & (v != ""))
    options = F.when(get(CIPHERS).isNotNull(), F.map_concat(rest, F.create_map(F.lit("cipher"), get(CIPHERS)))).otherwise(rest)
    scheme = F.coalesce(F.lower(F.trim(get(["type"]))), F.when(get(["server_port"]).isNotNull() & get(["method"]).isNotNull(), "ss"))
    host = F.regexp_replace(get(HOSTS), r"^\[|\]$", "")
    found = parts(scheme, host, get(PORTS).try_cast("int"), get(USERS), get(SECRETS), get(NAMES), options)
    deep = F.try_element_at("m", F.lit("_deep")).isNotNull()
    out = judged(d.select("source", F.col("item").cast("int").alias("pos"), deep.alias("_deep"), found.alias("_n")))
    return out.withColumn("error", F.when(F.col("_deep"), "deep").otherwise(F.col("error"))).withColumn("usable", F.col("usable") & ~F.col("_deep")).drop("_deep")


def nodes(bodies: DataFrame, key: str = "source", body: str = "body") -> DataFrame:
    """source, pos (of the line, item or entry) and the columns of ``NODE`` of each entry of each body. Keys are unique; other columns are ignored."""
    d = bodies.where(F.col(body).isNotNull()).select(F.col(key).alias("source"), F.regexp_replace(F.trim(body), "^\ufeff", "").alias("body"))
    large = d.where(F.octet_length("body") > MAX_BYTES)
    d = opened(d.where(F.octet_length("body") <= MAX_BYTES))
    json = F.col("body").rlike(r"^[\[{]") & F.try_parse_json("body").isNotNull()
    listed = F.col("body").rlike(r"(?m)^proxies:") | F.col("body").rlike(r"^- +(\{|[A-Za-z_-]+:( |$))")
    d = stored(d.withColumn("form", F.when(json, "json").when(listed, "tree").otherwise("lines")))  # read once for each form
    keyed, alone = tree_items(d.where("form = 'tree'"))
    lines = d.where("form = 'lines'").select("source", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line")).where(~F.col("line").rlike(r"^\s*(#|$)"))
    out = linked(lines.unionByName(alone)).drop("line").unionByName(field_nodes(keyed.unionByName(json_items(d.where("form = 'json'")))))
    failed = large.select("source", F.lit(0).alias("pos"), F.from_json(F.lit('{"usable": false, "error": "large"}'), NODE).alias("node")).select("source", "pos", "node.*")
    return out.unionByName(failed)
