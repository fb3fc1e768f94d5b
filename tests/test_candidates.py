"""Messages of each site's extractor to candidates, authors and states."""

import json

import pytest

from lumaspan.sources import candidates as C

OUTPUTS = {
    "tw": ("twitter", "", [[2, {"tweet_id": 11, "content": " hello ", "count": 3, "author": {"id": 5, "name": "Ann", "nick": "A."}}], [3, "https://m/1.jpg", {"tweet_id": 11}], [3, "https://m/2.jpg", {"tweet_id": 11}],
                           [2, {"tweet_id": 11, "content": "again"}], [2, {"tweet_id": "12", "content": "", "author": None}], [2, {"content": "no id"}], [2, {"tweet_id": 13}], "odd", [], [2]]),
    "px": ("pixiv", "", [[2, {"id": 7, "title": "t", "page_count": 4, "user": {"id": 9, "account": "acc", "name": "Name"}}], [-1, {"message": "slow; token=abc"}]]),
    "db": ("danbooru", "", [[2, {"id": 1, "tags_artist": ["a_b", "c"], "tag_string_copyright": "x y", "source": "https://s/1"}], [2, {"id": 2, "tag_string_artist": "d_e f", "file_url": "https://f/2"}], [6, "https://danbooru.donmai.us/posts?tags=z", {"id": 3, "name": "z_z"}]]),
    "eh": ("exhentai", "https://exhentai.org/?x", [[2, {"gid": 21, "token": "ab", "title": "G", "uploader": "up", "filecount": "30", "thumb": "https://t"}], [6, "https://e-hentai.org/g/22/cd", {}], [6, "https://none", {}]]),
    "pw": ("pawchive", "", [[2, {"id": "p1", "service": "fanbox", "user": "u1", "username": "U", "title": "T"}], [6, "", {"id": "c1", "service": "patreon", "name": "N", "ever_imported": True}], [6, "", {"id": "c2", "service": "patreon", "ever_imported": False}]]),
    "bad": ("twitter", "", [[-1, {"error": "https://u:p@h failed"}]]), "none": ("twitter", "", []),
}


@pytest.fixture(scope="module")
def outputs(spark):
    rows = [(k, s, u, json.dumps(m)) for k, (s, u, m) in OUTPUTS.items()] + [("no", "twitter", "", "{broken"), ("map", "pixiv", "", "{}"), ("null", "pixiv", "", None)]
    return spark.createDataFrame(rows, "key string, site string, source_url string, stdout string")


def test_candidates_of_all_sites(outputs):
    got = {(r.key, r.id): r for r in C.candidates(C.messages(outputs), 10).collect()}
    assert set(got) == {("tw", "11"), ("tw", "12"), ("tw", "13"), ("px", "7"), ("db", "1"), ("db", "2"), ("eh", "21"), ("eh", "22"), ("pw", "p1"), ("pw", "patreon:c1")}
    want = {
        ("tw", "11"): ("work", "hello", "https://x.com/Ann/status/11", "https://m/1.jpg", 3, "https://x.com/Ann/media"),
        ("tw", "12"): ("work", "Post 12", "https://x.com/i/web/status/12", None, 1, None),
        ("px", "7"): ("work", "t", "https://www.pixiv.net/artworks/7", None, 4, "https://www.pixiv.net/users/9/artworks"),
        ("db", "2"): ("post", "Post 2", "https://danbooru.donmai.us/posts/2", "https://f/2", 1, "https://danbooru.donmai.us/posts?tags=d_e"),
        ("eh", "21"): ("gallery", "G", "https://exhentai.org/g/21/ab/", "https://t", 30, "https://e-hentai.org/?f_search=uploader%3A%22up%24%22"),
        ("eh", "22"): ("gallery", "Gallery 22", "https://e-hentai.org/g/22/cd/", None, None, None),
        ("pw", "p1"): ("post", "T", "https://pawchive.pw/fanbox/user/u1/post/p1", None, None, "https://pawchive.pw/fanbox/user/u1"),
        ("pw", "patreon:c1"): ("account", "N", "https://pawchive.pw/patreon/user/c1", None, None, "https://pawchive.pw/patreon/user/c1"),
    }
    for k, v in want.items():
        r = got[k]
        assert (r.kind, r.title, r.url, r.thumbnail, r.media_count, r.works_url) == v, k


def test_limit_counts_different_candidates(outputs):
    assert {(r.key, r.id) for r in C.candidates(C.messages(outputs), 1).collect()} == {("tw", "11"), ("px", "7"), ("db", "1"), ("eh", "21"), ("pw", "p1")}


def test_authors_and_states(outputs):
    rows = C.messages(outputs)
    got = {(r.key, r.author_key): r.author_shown for r in C.authors(rows).collect()}
    assert got[("tw", "twitter:id:5")] == "A." and got[("db", "danbooru:id:3")] == "z z" and got[("db", "https://danbooru.donmai.us/posts?tags=a_b")] == "a b"
    states = {r.key: tuple(r)[1:] for r in C.states(outputs, rows, 10).collect()}
    assert states == {"tw": ("ok", 3, None), "px": ("partial", 1, "slow; token=***"), "db": ("ok", 2, None), "eh": ("ok", 2, None), "pw": ("ok", 2, None), "bad": ("failed", 0, "https://***:***@h failed"),
                      "none": ("ok", 0, None), "no": ("invalid", 0, None), "map": ("invalid", 0, None), "null": ("invalid", 0, None)}
