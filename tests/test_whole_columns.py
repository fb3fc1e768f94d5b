"""Queries that judge every row of their tables in every form of their texts."""

import duckdb
import pytest

from lumaspan.plans import columns

SF = "/root/testdata/sf0.001"
ROWS = {
    "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(7, "A#1", 2, 1.0), (8, None, 3, 1.0), (9, " @B -_c@", None, 1.0), (10, "", 1, 1.0), (11, "Time_3#", 4, 1.0)]),
    "customer": ("c_custkey long, c_name string", [(7, "C\t#d"), (None, "_E_")]),
    "pages": ("page_id long, url string", [(7, "http://h.example/a?b=1"), (8, None), (9, "no address, here; or"), (10, " #c"), (11, "x\r\n,;\n https://a.b/;"), (12, "ftp://a@b@c x://y://z@d")]),
    "part": ("p_partkey long, p_name string", [(7, "hot  bolt"), (8, None), (9, "-")]),
}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Small tables with nulls and odd texts."""
    d = str(tmp_path_factory.mktemp("odd"))
    for t, (schema, rows) in ROWS.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{t}.parquet")
    return d


def result(spark, d, name):
    got = columns.QUERIES[name](spark, d)
    return sorted(map(tuple, got.collect()), key=repr)


def by_sql(d, name):
    con = duckdb.connect()
    for t in ROWS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet{'' if d == SF else '/*.parquet'}')")
    return sorted(con.execute(columns.SQL[name]).fetchall(), key=repr)


def test_identity_keys_of_all_names_in_all_forms(spark, odd):
    got = result(spark, SF, "identity_keys")
    assert len(got) == 6 * sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("supplier", "customer", "part"))
    assert got == by_sql(SF, "identity_keys")
    got = result(spark, odd, "identity_keys")
    assert got == by_sql(odd, "identity_keys")
    keys = {(kind, k, form): key for kind, k, form, key in got}
    assert [keys["supplier", 7, f] for f in range(6)] == ["a_at_1", "a_1", "a_1_7", "a#1", "", None]
    assert [keys["part", 7, f] for f in range(6)] == ["hot_bolt", "hot_bolt", "hot_bolt_7", "hot_bolt", "", None]
    assert [keys["supplier", 8, f] for f in range(6)] == [None, None, None, None, "", None]
    assert len(got) == 6 * 10


def test_url_lists_of_pages_and_parts_in_all_forms(spark, odd):
    got = result(spark, SF, "url_lists")
    assert len(got) == 7 * sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("pages", "part"))
    assert got == by_sql(SF, "url_lists")
    got = result(spark, odd, "url_lists")
    assert got == by_sql(odd, "url_lists") and len(got) == 7 * 9
    lists = {(kind, k, form): urls for kind, k, form, urls in got}
    u, second = "http://h.example/a?b=1", "https://second.example/7"
    assert [lists["page", 7, f] for f in range(7)] == [f"{u} {second}", f"{u} {second}", "h.example/a?b=1 h7 h.example/a?b=1.second", f"{u} {second} {u}#top", f"{u}&x=1,7", "", ""]
    assert lists["part", 7, 1] == "https://hot--bolt.example/7 https://second.example/7"
    assert [lists["page", 8, f] for f in range(7)] == [""] * 7


def test_endpoint_minutes_of_all_suppliers_in_all_forms(spark, odd):
    got = result(spark, SF, "endpoint_minutes")
    assert len(got) == 7 * spark.read.parquet(f"{SF}/supplier.parquet").count()
    assert got == by_sql(SF, "endpoint_minutes")
    got = result(spark, odd, "endpoint_minutes")
    assert got == by_sql(odd, "endpoint_minutes") and len(got) == 7 * 5
    seconds = {(k, form): x for k, form, x in got}
    assert [seconds[7, f] for f in range(7)] == [420, 420, 420, 420, None, None, 420]
    assert [seconds[8, f] for f in range(7)] == [None] * 7
    assert (seconds[9, 0], seconds[9, 1], seconds[10, 0]) == (None, 540, None)
    assert [seconds[11, f] for f in (0, 1, 5)] == [180, 660, 180]


def test_masked_endpoints_of_pages_and_suppliers_in_all_forms(spark, odd):
    got = result(spark, SF, "masked_endpoints")
    assert len(got) == 8 * sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("pages", "supplier"))
    assert got == by_sql(SF, "masked_endpoints")
    got = result(spark, odd, "masked_endpoints")
    assert got == by_sql(odd, "masked_endpoints") and len(got) == 8 * 11
    texts = {(kind, k, form): x for kind, k, form, x in got}
    assert [texts["page", 7, f] for f in range(8)] == [
        "from http://***@h.example/a?b=1 and http://h.example/a?b=1", "http://***@h.example/a?b=1 and https://***@y/z@w", "no url h.example/a?b=1 a@b", "://u@h.example/a?b=1", "1://u@h.example/a?b=1",
        "a http://h.example/a?b=1/p@q b", None, "pool socks5://***@h:9 end http://h.example/a?b=1"]
    assert texts["supplier", 7, 0] == "from https://***@A-1.example:80/ and https://A-1.example:80/"
    assert texts["page", 12, 5] == "a ftp://***@b@c x://y://***@d/p@q b"
    assert [texts["page", 8, f] for f in range(8)] == [None] * 8
