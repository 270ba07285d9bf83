"""Column expressions on small tables of cases."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import listing
from tidemark.operators.match import match_hosts
from tidemark.sources import feeds, schemas

LABELS = ("shop", "x9", "a-b", "api", "")
STEMS = ("harbour.test", "tide.gov.xx", "b.harbour.test")


def below(fqdn: str, pattern: str) -> bool:
    """The rule, said another way: the pattern is `*.stem` and the name is something followed by `.stem`."""
    star, dot, stem = pattern.partition(".")
    return star == "*" and bool(dot) and len(fqdn) > len(stem) + 1 and fqdn[-len(stem) - 1 :] == f".{stem}"


MATCHES = [
    (pattern, fqdn, below(fqdn, pattern))
    for pattern in [f"*.{stem}" for stem in STEMS] + [STEMS[0], "", "*", f"?.{STEMS[0]}"]
    for fqdn in [f"{label}{dot}{stem}" for stem in STEMS for label in LABELS for dot in (".", "")] + ["shop.api.harbour.test", "SHOP.HARBOUR.TEST", ""]
]


def one(spark, expression, **values):
    kinds = ", ".join(f"{k} {'string' if not isinstance(v, int) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(expression.alias("x")).first()["x"]


def test_pattern_matches(spark):
    rows = spark.createDataFrame(MATCHES, "pattern string, fqdn string, want boolean")
    assert rows.filter(S.matches_pattern("fqdn", "pattern") != F.col("want")).count() == 0
    assert one(spark, S.matches_pattern("f", "p", casefold=True), f="Shop.HARBOUR.test", p="*.harbour.TEST")


def test_join_equals_predicate_and_first_pattern_wins(spark):
    names = sorted({f for _, f, _ in MATCHES})
    rows = [("c", "*.harbour.test", True, 1), ("a", "*.b.harbour.test", True, 0), ("e", "*.tide.gov.xx", True, 2), ("b", "*.tide.gov.xx", True, 2), ("d", "*.test", False, 0)]
    want = {}
    for fqdn in names:
        fits = sorted((made, i) for i, value, active, made in rows if active and below(fqdn, value))
        if fits:
            want[fqdn] = fits[0][1]
    hosts, patterns = spark.createDataFrame([(f,) for f in names], "fqdn string"), spark.createDataFrame(rows, "id string, value string, active boolean, created_at int")
    assert {r["fqdn"]: r["pattern_id"] for r in match_hosts(hosts, patterns).collect()} == want and {"a", "b", "c"} == set(want.values())


@pytest.mark.parametrize(
    "url,host",
    [("https://a.b:8443/x", "a.b"), ("http://u@h.example.com?q", "h.example.com"), ("ftp://under_score.x/", "under_score.x"), ("no url", ""), ("https:///path", ""), ("HTTPS://A.B#c", "A.B")],
)
def test_url_host(spark, url, host):
    assert one(spark, S.url_host("u"), u=url) == host


@pytest.mark.parametrize("value,valid", [("*.example.com", True), ("*.ex4mple.co.uk", True), ("example.com", False), ("*.example.c0m", False), ("*.com", False), ("*.example.com\n", False), ("", False)])
def test_valid_pattern(spark, value, valid):
    assert one(spark, S.valid_pattern("v"), v=value) is valid


@pytest.mark.parametrize("ip,valid", [("10.0.0.1", True), ("256.1.1.1", False), ("01.1.1.1", False), ("::1", True), ("2001:db8::1", True), ("1:2:3:4:5:6:7:8", True), ("1:2:3", False), ("x", False), ("", False)])
def test_valid_ip(spark, ip, valid):
    assert (one(spark, S.valid_ip("v"), v=ip) is not None) is valid


def document(**protocols):
    return json.dumps({protocol: {str(port): entry for port, entry in entries.items()} for protocol, entries in protocols.items()})


@pytest.mark.parametrize(
    "ports,urls,open_,kind",
    [
        (document(tcp={8080: {"web": "http://m"}, 3306: {"web": None}, 9443: {"web": "https://m"}}), ["http://m", "https://m"], ["3306", "8080", "9443"], "web"),
        (document(udp={443: {"web": "quic://m"}, 123: {"web": None}}, tcp={25: {}}), ["quic://m"], ["25"], "web"),
        (document(tcp={25: {"web": None}, 110: {}}), [], ["110", "25"], "other"), (document(udp={161: {"web": None}}), [], [], "other"),
        (None, [], [], "unknown"), ("<ports>", [], [], "unknown"), (document(), [], [], "unknown"), (document(tcp={}, udp={}), [], [], "unknown"),
        (document(tcp={25: True}), [], ["25"], "other"), (document(tcp={8080: {"web": "http://m"}, 25: {"web": ["x"]}}), [], ["25", "8080"], "other"),
        (json.dumps({"tcp": {"8080": {"web": "http://m"}}, "udp": "none"}), [], ["8080"], "other"), (document(Tcp={8080: {"web": "http://m"}}), [], [], "unknown"),
    ],
)
def test_ports(spark, ports, urls, open_, kind):
    row = spark.createDataFrame([(ports,)], "p string").select(S.web_urls("p").alias("u"), S.open_ports("p").alias("o"), S.host_type("p").alias("k"), S.open_ports("p", "udp").alias("d")).first()
    assert (row["u"], row["o"], row["k"]) == (urls, open_, kind)
    assert row["d"] == (sorted(json.loads(ports)["udp"]) if ports and ports.startswith('{"udp"') else [])


def test_scan_payloads(spark):
    hop = lambda code, title, size: {"url": "http://m", "status_code": code, "title": title, "response_size": size}
    chain = json.dumps([hop(308, "Moved on", 90), hop(206, "Part", 5 << 19)])
    assert one(spark, S.chain_info("c"), c=chain).asDict() == {"status_code": 308, "title": "Moved on"}
    for empty in ("", "{}", json.dumps([hop("teapot", None, 1)])):
        assert one(spark, S.chain_info("c"), c=empty).asDict() == {"status_code": 0, "title": ""}
    assert one(spark, S.status_class("c"), c=chain) == 3
    assert one(spark, S.chain_text("c"), c=chain) == "308→206" and one(spark, S.size_text("c"), c=chain) == "90B→2.5MB"
    used = json.dumps([{"name": "Gleam", "version": "1"}, {"name": "Tide_Pool", "version": ""}, {"name": "Oak"}])
    assert one(spark, S.technology_names("t"), t=used) == ["Gleam 1", "Tide_Pool", "Oak"]
    for broken in ("[1]", '"Gleam"', "["):
        assert one(spark, S.technology_names("t"), t=broken) == []
    assert one(spark, S.has_technology("t", "LEA"), t=used) and not one(spark, S.has_technology("t", "d%p"), t=used)
    assert one(spark, S.has_technology("t", "d%p", like=True), t=used) and not one(spark, S.has_technology("t", "\\", like=True), t=used)
    assert [one(spark, S.favicon("m"), m=m) for m in ('{"favicon":"/i.ico"}', '{"icon":1}', "no", None)] == ["/i.ico", "", "", ""]


def test_labels(spark):
    for seconds in (1, 59, 60, 3599, 3600, 86_401, 360_000):
        m, rest = divmod(seconds, 60)
        assert one(spark, S.duration_mmss("s"), s=seconds) == f"{m}m{rest:02d}s"
        assert one(spark, S.duration_text("s"), s=seconds) == (f"{seconds}s" if seconds < 60 else f"{m}m {rest}s" if m < 60 else f"{m // 60}h {m % 60}m")
    assert [one(spark, S.byte_size("s"), s=s) for s in (1023, 2560, 7 << 19)] == ["1023B", "2.5KB", "3.5MB"]
    assert [one(spark, S.status_bucket("s"), s=s) for s in (204, 301, 404, 599, 101)] == ["2xx", "3xx", "4xx", "5xx", "other"]
    assert one(spark, S.id_label("v", "i"), v=None, i="0123456789") == "01234567"
    assert one(spark, S.stable_id("v"), v="a") == one(spark, S.stable_id("v"), v="a") and len(one(spark, S.stable_id("v"), v="a")) == 36


@pytest.mark.parametrize("page", [None, "1", "7", "-3", "0", "seven", "", "10000", "10001", "4.5"])
@pytest.mark.parametrize("size", [None, "1", "200", "201", "0", "many", "-200"])
def test_clamp(page, size):
    """Whole numbers of at least one count, up to the cap; anything else is the default."""
    want = tuple(min(int(v), most) if v and v.isdigit() and int(v) else default for v, most, default in ((page, 10_000, 1), (size, 200, 50)))
    assert listing.clamp(page, size) == want


def test_clamp_of_columns(spark):
    rows = spark.createDataFrame([(p, n) for p in (None, "7", "-3", "seven", "10001") for n in (None, "1", "201", "0", "many")], "p string, n string")
    for r in rows.select("p", "n", S.page_number("p").alias("page"), S.page_size("n").alias("size")).collect():
        assert (r["page"], r["size"]) == listing.clamp(r["p"], r["n"])


def test_bad_filters(spark):
    with pytest.raises(ValueError):
        schemas.one_of("gone", schemas.HOST_STATUS, "status")
    assert listing.port_number("70000") is None and listing.port_number("443") == 443


@pytest.mark.parametrize("http,body,want", [(200, '{"url":"u","scanned_at":"2024-01-01T00:00:00Z"}', "ok"), (200, '{"error":"x"}', "fail"), (500, "{}", "fail"), (200, "x", "fail"), (None, "{}", "fail"), (200, None, "fail")])
def test_scan_outcome(spark, http, body, want):
    assert feeds.classify_scans(spark.createDataFrame([(http, body)], "http_status int, body string")).first()["outcome"] == want


def test_missing_values_and_dns(spark):
    assert one(spark, S.json_with_nulls("a", "b"), a="x", b=None) == '{"a":"x","b":null}'
    assert one(spark, S.has_dns_records("d"), d='{"A":["1.1.1.1"]}') is True
    assert [one(spark, S.has_dns_records("d"), d=d) for d in ('{"A":[]}', "{}", "x", None)] == [False] * 4
