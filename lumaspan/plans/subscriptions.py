"""Queries of subscription bodies: every customer is a node, written in one of five forms and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaspan.sources.subscriptions import nodes
from lumaspan.tables import table

QUERIES, SQL = {}, {}
PER_BODY = 20  # nodes of a body


def bodies(customers):
    """A body for each twenty customers: links, links in base64, an indented list, flow maps, JSON. Every seventh customer has no port."""
    k = F.col("c_custkey")
    d = customers.select(
        k, F.floor(k / PER_BODY).alias("source"), F.col("c_name").alias("name"), F.concat(F.lit("h"), k.cast("string"), F.lit(".example")).alias("host"),
        F.when(k % 7 == 0, "0").otherwise((k % 60000 + 1).cast("string")).alias("port"), F.concat(F.lit("p:"), F.col("c_mktsegment")).alias("secret"), (k % 2 == 0).alias("even"))
    scheme = F.when(F.col("even"), "trojan").otherwise("http")
    own = F.when(F.col("even"), F.url_encode("secret")).otherwise(F.concat(F.lit("u:"), F.url_encode("secret")))
    link = F.concat(scheme, F.lit("://"), own, F.lit("@"), "host", F.lit(":"), "port", F.lit("?sni=s"), "port", F.lit("#"), F.url_encode("name"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    fields = [("name", quoted(F.col("name"))), ("type", scheme), ("server", F.col("host")), ("port", F.col("port")), ("password", quoted(F.col("secret"))), ("username", F.when(F.col("even"), F.lit("null")).otherwise(F.lit("u"))), ("sni", F.concat(F.lit("s"), "port"))]
    indented = F.concat(F.lit("  - "), *(x for i, (n, v) in enumerate(fields) for x in (F.lit(("    " if i else "") + n + ": "), v, F.lit("\n"))))
    flow = F.concat(F.lit("- {"), *(x for i, (n, v) in enumerate(fields) for x in (F.lit((", " if i else "") + n + ": "), v)), F.lit("}\n"))
    json = F.to_json(F.struct(F.col("name").alias("tag"), scheme.alias("type"), F.col("host").alias("server"), F.col("port").cast("int").alias("server_port"), F.col("secret").alias("password"), F.when(~F.col("even"), "u").alias("username"), F.concat(F.lit("s"), "port").alias("sni")))
    form = F.col("source") % 5
    d = d.select("source", F.struct(k, F.when(form <= 1, link).when(form == 2, indented).when(form == 3, flow).otherwise(json).alias("t")).alias("e"))
    entries = d.groupBy("source").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["t"]).alias("e"))
    body = F.when(form == 0, F.array_join("e", "\n")).when(form == 1, F.base64(F.encode(F.array_join("e", "\n"), "utf-8"))).when(form == 4, F.concat(F.lit('{"outbounds": ['), F.array_join("e", ","), F.lit("]}"))).otherwise(F.concat(F.lit("proxies:\n"), F.array_join("e", "")))
    return entries.select("source", body.alias("body"))


def subscription_nodes(spark, sf):
    """The nodes of all bodies with their order in the body."""
    d = nodes(bodies(table(spark, sf, "customer")))
    return d.select(
        "source", F.regexp_extract("host", "[0-9]+", 0).cast("long").alias("c_custkey"), "scheme", "host", "port", "username", "secret", "name", F.try_element_at("options", F.lit("sni")).alias("sni"), "usable", "error")


QUERIES["subscription_nodes"] = subscription_nodes
SQL["subscription_nodes"] = f"""
SELECT CAST(floor(c_custkey / {PER_BODY}) AS BIGINT) AS source, CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'trojan' ELSE 'http' END AS scheme, 'h' || c_custkey || '.example' AS host,
       CAST(CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey % 60000 + 1 END AS INT) AS port, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'u' END AS username, 'p:' || c_mktsegment AS secret, c_name AS name,
       's' || CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey % 60000 + 1 END AS sni, c_custkey % 2 = 1 AND c_custkey % 7 <> 0 AS usable, CASE WHEN c_custkey % 7 = 0 THEN 'address' END AS error
FROM customer
"""
