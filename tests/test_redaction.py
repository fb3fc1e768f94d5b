"""Redaction of whole texts: every kind of secret, and nothing cut."""

from pyspark.sql import functions as F

from lumaspan import registry
from lumaspan.functions.rules import redacted

CASES = [
    ("http://user@h/ SOCKS5://u:p@h:1 ftp://u:p@h", "http://***:***@h/ SOCKS5://***:***@h:1 ftp://u:p@h"),
    ("/a?access_token=x&sig=y;session=z#f", "/a?access_token=***&sig=***#f"),
    ("?email=a@b&auth=1&signature=2&page=3", "?email=***&auth=***&signature=***&page=3"),
    ("Proxy-Authorization: abc, cookie=c; passwd = p, my_token=kept", "Proxy-Authorization: ***, cookie=***; passwd = ***, my_token=kept"),
    ("Basic dTpw and bearer a.b", "Basic *** and bearer ***"),
    ("key s3cr3t.x here", "key *** here"),
    (None, ""),
]


def test_all_rules_and_literal_secrets(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = dict(df.select("i", redacted(F.col("t"), ("s3cr3t.x", ""))).collect())
    assert [got[i] for i in range(len(CASES))] == [w for _, w in CASES]


def test_long_documents_keep_their_tail(spark, tmp_path):
    text = "word " * 2000 + "token=abc tail"
    spark.createDataFrame([(0, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert registry.QUERIES["redacted_documents"](spark, str(tmp_path)).first().text == "word " * 2000 + "token=*** tail"
