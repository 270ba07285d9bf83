"""Every inventory query against its SQL; the entry; plans that must hold."""

import pytest
from compare import same

from tidemark.operators import listing, match
from tidemark.plans import registry
from tidemark.sources import fixtures as X


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, data, name):
    same(registry.queries()[name](spark, data), duck, registry.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_suffix_match_is_an_equi_join(spark, data):
    text = plan(match.match_hosts(X.observations(spark, data), X.patterns(spark)))
    assert "NestedLoop" not in text and "CartesianProduct" not in text and ("BroadcastHashJoin" in text or "SortMergeJoin" in text)


def test_listing_keeps_only_a_page(spark, data):
    text = plan(listing.page(X.hosts(spark, data), listing.newest(), 2, 10))
    assert "TakeOrderedAndProject" in text


def test_filters_and_columns_reach_the_scan(spark, data):
    text = plan(X.load(spark, data, "orders").filter("o_orderstatus = 'F'").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in text and "o_totalprice" not in text


def test_rollup_sums_to_totals(spark, data):
    rows = registry.pattern_rollup(spark, data).collect()
    total = registry.dashboard_totals(spark, data).first()
    assert total["total"] == sum(r["total"] for r in rows) and total["patterns"] == len(rows)


def test_pages_make_up_the_list(spark, data):
    rows = X.services(spark, data)
    n = rows.count()
    size = 20
    ids = [r["id"] for p in range(1, -(-n // size) + 1) for r in listing.page(rows, listing.newest("scanned_at"), p, size).collect()]
    assert ids == [r["id"] for r in rows.orderBy(*listing.newest("scanned_at")).collect()]
