"""Viewer pages, answers and lists: whole, broken and null."""

from pyspark.sql import functions as F

from lumaspan.sources import viewers

PAGE = """<a href="https://x.test/fullimg/0">before</a><div id="i3"><a onclick="return load_image('k2', 3)">
<img src="https://x.test/ad.jpg"><img id="img" class="c" src="https://x.test/a.jpg?x=1&amp;y=2" onerror="nl('77-1')"></a>
<a href="/fullimg/9?a=1&amp;b=2">original</a><script>var startkey = "s1"; var  showkey='w1';</script>"""


def test_image_pages(spark):
    rows = [(1, PAGE, "https://x.test/"), (2, PAGE.replace("showkey", "other"), "https://x.test"), (3, "<p>", "r"), (4, None, None), (5, PAGE.replace("load_image('k2', 3)", "go('k9')").replace("/fullimg/9", "/f/9"), "r")]
    got = {r.id: r for r in viewers.image_pages(spark.createDataFrame(rows, "id int, html string, root string")).drop("html", "root").collect()}
    assert tuple(got[1]) == (1, "k2", "s1", "w1", "https://x.test/a.jpg?x=1&y=2", "https://x.test/fullimg/9?a=1&b=2", "77-1", None)
    assert got[2].error == "show_key" and got[2].start_key == "s1"
    assert got[3].error == got[4].error == "viewer, image, start_key, show_key"
    assert (got[5].next_key, got[5].original_url, got[5].error) == ("k9", None, None)


def test_image_answers(spark):
    import json

    block = PAGE[PAGE.index("<div"):]
    bodies = [json.dumps({"i3": block, "i6": "<a href='https://y.test/fullimg/3'>"}), json.dumps({"i3": ""}), "no json", json.dumps({"i3": "<img id='img'>"})]
    df = spark.createDataFrame([(i, b, "https://x.test") for i, b in enumerate(bodies)], "id int, body string, root string")
    got = {r.id: r for r in viewers.image_answers(df).collect()}
    assert (got[0].next_key, got[0].resample_url, got[0].original_url, got[0].reload_key, got[0].error) == ("k2", "https://x.test/a.jpg?x=1&y=2", "https://y.test/fullimg/3", "77-1", None)
    assert [got[i].error for i in (1, 2, 3)] == ["viewer, image", "viewer, image", "image"]


def test_listed_images(spark):
    pages = ['var imagelist = [{"n":"a"},{"n":"b"}];\nvar mpvkey = "m";', 'var imagelist = [{"n":];var mpvkey="m";', 'var imagelist = [1];', None]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    got = viewers.listed_images(df).select("id", "list_key", "position", F.try_variant_get("image", "$.n", "string").alias("n"), "error").orderBy("id", "position").collect()
    assert [tuple(r) for r in got] == [(0, "m", 1, "a", None), (0, "m", 2, "b", None), (1, "m", None, None, "list"), (2, None, None, None, "list_key"), (3, None, None, None, "list, list_key")]
