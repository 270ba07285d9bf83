"""Stored forms: what filters read, joins without an exchange of the stored side, and the index of names."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import fold, listing
from tidemark.sources import fixtures as X
from tidemark.sources import stored


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_filters_on_payloads_reach_the_scan(spark, data, folder):
    stored.write_services(X.services(spark, data), f"{folder}/s")
    rows = stored.services_of_class(spark, f"{folder}/s", 4).select("id", "title")
    text = plan(rows)
    assert "PushedFilters: [IsNotNull(status_class), EqualTo(status_class,4)]" in text
    assert re.search(r"ReadSchema: struct<id:string,status_class:int,title:string>", text)
    want = listing.filtered_services(X.services(spark, data), X.hosts(spark, data), status_class=4)
    assert {tuple(r) for r in rows.collect()} == {tuple(r) for r in want.select("id", "title").collect()}


def test_typed_columns_keep_the_payloads(spark, data, folder):
    services = X.services(spark, data)
    stored.write_services(services, f"{folder}/s")
    back = spark.read.parquet(f"{folder}/s")
    told = lambda df, chain: {(r[0], r[1]) for r in df.select("id", F.try_variant_get(chain, "$[0].response_size", "long")).collect()}
    assert told(back, F.col("chain")) == told(services, S.json_value("chain"))
    assert {r["id"]: r["tech_names"] for r in back.collect()} == {r["id"]: r["n"] or [] for r in services.select("id", F.transform(S.technologies("technologies"), lambda t: t["name"]).alias("n")).collect()}


def test_ports(spark, folder):
    ports = ['{"tcp":{"22":{"web":null},"443":{"web":"https://a"}},"udp":{"53":{"web":null}}}', '{"tcp":{"53":{}}}', None, "broken", '{"tcp":{"http":{}}}']
    hosts = spark.createDataFrame([(str(i), p, None) for i, p in enumerate(ports)], "id string, ports string, dns string")
    stored.write_hosts(hosts, folder)
    found = lambda port, protocol="tcp": sorted(r["id"] for r in stored.hosts_with_port(spark, folder, port, protocol).collect())
    assert (found(22), found(53), found(53, "udp"), found(80)) == (["0"], ["1"], ["0"], [])
    assert "EqualTo(port,22)" in plan(stored.hosts_with_port(spark, folder, 22))


NAMES = ["Kestrel", "Elixir", "Svelte", "ab", "a", "ABBA", "x_y%z", "日本語", "aaa", ""]


def test_names_by_any_part(spark, folder):
    """Each part of each name and some others, against a look through all names."""
    rows = [(f"s{i}-{j}", f'[{{"name":"{a}","version":"1"}},{{"name":"{b}","version":""}}]') for i, a in enumerate(NAMES) for j, b in enumerate(NAMES) if (i + j) % 3 == 0] + [("none", None), ("broken", "[")]
    services = spark.createDataFrame(rows, "id string, technologies string")
    stored.write_name_index(services, folder)
    names = {r["id"]: [n for n in r["n"] or [] if n is not None] for r in services.select("id", F.transform(S.technologies("technologies"), lambda t: F.lower(t["name"])).alias("n")).collect()}
    for text in ["", "a", "AB", "b", "bb", "abb", "aa", "aaa", "aaaa", "elix", "estr", "lixir", "本", "日本語", "_", "%z", "kestrels", "q"]:
        got = sorted(r["id"] for r in stored.services_with_technology(spark, folder, text).collect())
        assert got == sorted(i for i, held in names.items() if any(text.lower() in n for n in held)), text
    text = plan(stored.services_with_technology(spark, folder, "lixi"))
    assert "technologies" not in text and "In(gram, [ixi,lix])" in text


def test_stored_sides_of_joins_stay_where_they_are(spark, data, folder, no_broadcast):
    hosts = spark.table(stored.save_bucketed(X.hosts(spark, data), "id", f"{folder}/h"))
    services = spark.table(stored.save_bucketed(X.services(spark, data), "host_id", f"{folder}/s"))
    joined = services.join(hosts.select(F.col("id").alias("host_id"), "fqdn"), "host_id")
    assert "Exchange" not in plan(joined) and joined.count() == services.count()
    assert "Exchange" not in plan(hosts.groupBy("id").agg(F.max("fqdn")))


def test_upsert_deals_out_new_rows_alone(spark, data, folder, no_broadcast):
    seen = X.matched_observations(spark, data)
    early = fold.upsert_hosts(None, seen.filter("seq < 25")).drop("seq")
    table = spark.table(stored.save_bucketed(early, "fqdn", f"{folder}/h"))
    later = spark.createDataFrame(fold.observed_hosts(seen.filter("seq >= 20")).collect(), fold.observed_hosts(seen).schema)
    rows = stored.upsert_stored(table, later, "fqdn", fold.HOST_FIRST, fold.HOST_LAST)
    want = fold.upsert(table, later, "fqdn", fold.HOST_FIRST, fold.HOST_LAST).drop("seq")
    assert sorted(map(str, rows.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    text = plan(rows)
    scan = text[text.index("FileScan") - 400 : text.index("FileScan")]
    assert "Exchange" not in scan and "Bucketed: true" in text


def test_places_by_block(spark):
    rows = [(i, g, (i * 7) % 40) for i in range(120) for g in ("a", None)] + [(500, "b", 1)]
    df = spark.createDataFrame(rows, "id long, g string, at long")
    got = {(r["g"], r["id"]): r["place"] for r in listing.placed(df, "g", F.floor(F.col("at") / 10), [F.col("at"), F.col("id")]).collect()}
    want = {(g, i): n + 1 for g in ("a", "b", None) for n, (at, i) in enumerate(sorted((at, i) for i, h, at in rows if h == g))}
    assert got == want
