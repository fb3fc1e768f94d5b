"""Subscription bodies in every form to nodes."""

import base64
import json

import pytest

from lumaspan.sources import subscriptions as S

pack = lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("=")

LINES = "\n".join([
    "# comment", "", "h1.example:8080:us:pa:ss", "h2.example:3128", "http://u%40:p@H3.example:81#one%20two", "socks5://u:p@h4.example:1080", "socks5://h5.example",
    "vless://id-6@[2001:db8::6]:443?type=ws&path=%2Fa&path=%2Fb#six", "trojan://pw%237@h7.example:443?sni=x", "hy2://s8@h8.example:8443/?insecure=1#e", "tuic://id9:pw9@h9.example:90",
    "ss://" + pack("aes-128-gcm:k10") + "@h10.example:1010#ten", "ss://" + pack("aes-256-gcm:k@11@h11.example:1111"), "vmess://" + pack(json.dumps({"add": "h12", "port": "12", "id": "i12", "ps": "twelve", "net": "ws"})),
    "ssr://" + pack("h13:13:origin:rc4:plain:" + pack("k13") + "/?remarks=" + pack("thirteen")), "vless://@h:1", "trojan://x@[bad:1", "gopher://h:1", "words only", "vmess://%%%", "anytls://k@h14:99999",
])
WANT = [
    (2, "http", "h1.example", 8080, "us", "pa:ss", "", True, None), (3, "http", "h2.example", 3128, "", "", "", True, None), (4, "http", "h3.example", 81, "u@", "p", "one two", True, None),
    (5, "socks5", "h4.example", 1080, "u", "p", "", False, None), (6, "socks5", "h5.example", 80, "", "", "", True, None), (7, "vless", "2001:db8::6", 443, "id-6", "", "six", False, None),
    (8, "trojan", "h7.example", 443, "", "pw#7", "trojan-h7.example", False, None), (9, "hysteria2", "h8.example", 8443, "", "s8", "e", False, None), (10, "tuic", "h9.example", 90, "id9", "pw9", "tuic-h9.example", False, None),
    (11, "ss", "h10.example", 1010, "", "k10", "ten", False, None), (12, "ss", "h11.example", 1111, "", "k@11", "ss-h11.example", False, None), (13, "vmess", "h12", 12, "i12", "", "twelve", False, None),
    (14, "ssr", "h13", 13, "", "k13", "thirteen", False, None),
]
ERRORS = {15: "credentials", 16: "address", 17: "scheme", 18: "scheme", 19: "address", 20: "address"}

TREE = """mixed-port: 7890
proxies:
- name: "a: b # c"   # comment
  type: vless
  server: 2001:db8::1
  port: 443
  uuid: id1
  alpn:
  - h2
  - http/1.1
  ws-opts:
    path: '/it''s'
    headers:
      Host: h.example
-   {name: flow, type: hy2, server: f.example, port: "8443", password: 'p,w', obfs: {kind: x, deep: {er: y}}, alpn: [h3, "h2"]}
- type: ss
  server: s.example
  port: 1
  cipher: aes
  password: k
  port: 2
- - nested
- trojan://pw@t.example:443#t
- type: trojan
  server: none.example
  port: 443
proxy-groups:
  - name: not a node
    type: select
    proxies:
      - flow
"""


def read(spark, **bodies):
    rows = S.nodes(spark.createDataFrame([(k, v, 1) for k, v in bodies.items()], "source string, body string, node int")).collect()
    return sorted(rows, key=lambda r: (r.source, r.pos))


def test_share_links(spark):
    got = read(spark, a=LINES)
    assert [(r.pos, r.scheme, r.host, r.port, r.username, r.secret, r.name, r.usable, r.error) for r in got if r.error is None] == WANT
    assert {r.pos: r.error for r in got if r.error} == ERRORS
    options = {r.pos: r.options for r in got}
    assert options[7] == {"type": "ws", "path": "/a"} and options[11] == {"cipher": "aes-128-gcm"} and options[13] == {"net": "ws"} and options[14]["cipher"] == "rc4"


@pytest.mark.parametrize("wrap", [lambda t: t, pack, lambda t: pack(pack(t)[:60] + "\n" + pack(t)[60:]), lambda t: t.replace("\n", "\r\n")])
def test_indented_documents(spark, wrap):
    got = [r for r in read(spark, a=wrap(TREE))]
    good = [(r.scheme, r.host, r.port, r.username or r.secret, r.name) for r in got if r.error is None]
    assert good == [("vless", "2001:db8::1", 443, "id1", "a: b # c"), ("hysteria2", "f.example", 8443, "p,w", "flow"), ("ss", "s.example", 2, "k", "ss-s.example"), ("trojan", "t.example", 443, "pw", "t")]
    assert got[0].options == {"alpn": "h2,http/1.1", "ws-opts.path": "/it's", "ws-opts.headers.Host": "h.example"}
    assert got[1].options == {"obfs.kind": "x", "obfs.deep.er": "y", "alpn": "h3,h2"}
    assert [r.error for r in got if r.error] == ["scheme", "credentials"]


def test_indented_documents_equal_a_yaml_reader(spark):
    yaml = pytest.importorskip("yaml")
    import random

    rng = random.Random(5)

    def value(depth, pad):
        kind = rng.random()
        if depth < 3 and kind < 0.3:
            gap = rng.choice([1, 2, 3, 5])
            return "\n" + "\n".join(f"{' ' * (pad + gap)}k{i}:{value(depth + 1, pad + gap)}" for i in range(rng.randint(1, 3)))
        return " " + rng.choice(["x", "1", "'q''s'", '"d: e"', "{f: g, h: {i: j}}", "[a, b]", "word word # note"])

    def flat(v, path=""):
        if isinstance(v, dict):
            return {k: x for name, inner in v.items() for k, x in flat(inner, f"{path}.{name}" if path else name).items()}
        return {path: ",".join(map(str, v)) if isinstance(v, list) else str(v)}

    bodies, want = {}, {}
    for n in range(8):
        pad = rng.choice([0, 2, 4])
        items = [f"{' ' * pad}- type: http\n" + "\n".join(f"{' ' * (pad + 2)}o{i}:{value(0, pad + 2)}" for i in range(rng.randint(1, 4))) for _ in range(4)]
        bodies[f"b{n}"] = "proxies:\n" + "\n".join(items) + "\n"
        want[f"b{n}"] = [{k: x for k, x in flat(item).items() if k != "type"} for item in yaml.safe_load(bodies[f"b{n}"])["proxies"]]
    got = read(spark, **bodies)
    assert {k: [r.options for r in got if r.source == k] for k in bodies} == want


def test_json_forms(spark):
    got = read(
        spark, a=json.dumps({"proxies": [{"type": "trojan", "server": "a", "port": 1, "password": "p", "alpn": ["h2", "h3"], "ws": {"headers": {"Host": "x"}}}, 5]}),
        b=json.dumps({"outbounds": [{"type": "shadowsocks", "tag": "t", "server": "b", "server_port": 2, "method": "m", "password": "k"}, {"type": "direct"}]}),
        c=json.dumps({"servers": [{"remarks": "r", "server": "c", "server_port": 3, "method": "m", "password": "k"}]}), d=json.dumps([{"type": "socks", "server": "d", "server_port": 4}]), e="{broken", f="[]")
    assert (got[-1].source, got[-1].error) == ("e", "scheme")
    assert [(r.source, r.pos, r.scheme, r.host, r.port, r.name, r.error) for r in got[:-1]] == [
        ("a", 0, "trojan", "a", 1, "trojan-a", None), ("a", 1, None, None, None, "", "scheme"), ("b", 0, "ss", "b", 2, "t", None), ("b", 1, "direct", None, None, "", "scheme"),
        ("c", 0, "ss", "c", 3, "r", None), ("d", 0, "socks5", "d", 4, "", None)]
    assert got[0].options == {"alpn": "h2,h3", "ws.headers.Host": "x"} and got[5].usable


def test_null_blank_large_and_deep(spark):
    deep = "proxies:\n- type: http\n  server: h\n  port: 1\n" + "\n".join(f"{' ' * (2 + i)}k{i}:" for i in range(14)) + " v\n"
    got = read(spark, a=None, b="", c=" \n# x\n", d="x" * (S.MAX_BYTES + 1), e=deep)
    assert {(r.source, r.error) for r in got} == {("d", "large"), ("e", None), ("e", "deep")}
    assert S.nodes(spark.createDataFrame([], "source string, body string")).count() == 0
