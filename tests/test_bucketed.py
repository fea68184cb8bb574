"""Tables that lie by device."""

import pytest
from conftest import rows

from geotrail.operators.sizing import SplitPolicy
from geotrail.sources.bucketed import BucketedTables

HOT = SplitPolicy(max_ranges=1 << 20).forced(target_rows=100)


@pytest.fixture
def tables(spark, tmp_path):
    return BucketedTables(spark, str(tmp_path / "set"), "set_" + tmp_path.name, buckets=4)


@pytest.fixture
def visits(spark):
    """Device 0 has a third of the rows, others 13 or 14; every 50th has no device."""
    return spark.range(1500).selectExpr(
        "case when id % 50 = 49 then null when id % 3 = 0 then 0 else id % 97 + 1 end as device",
        "id as visit",
    )


@pytest.fixture
def owners(spark):
    return spark.range(60).selectExpr("id as device", "id * 10 as id_user")


@pytest.fixture
def latest(spark):
    return spark.range(10, 90).selectExpr("id as device", "id / 2 as x")


def exchanges(df):
    """Of the plan as it ran, without the two small ones of hot keys."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("policy", [SplitPolicy().off(), HOT])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_equals_the_plain_one(tables, visits, owners, latest, policy, how):
    tables.write("visits", visits, ["visit"], policy)
    tables.write("owners", owners, [])
    tables.write("latest", latest, [])
    got = tables.joined("visits", "owners", "latest", how=how)
    want = visits.join(owners, "device", how).join(latest, "device", how)
    assert rows(got, *want.columns) == rows(want, *want.columns)
    assert rows(tables.read("visits"), "device", "visit") == rows(visits, "device", "visit")


def test_three_tables_join_without_an_exchange(tables, visits, owners, latest):
    tables.write("visits", visits, ["visit"], SplitPolicy().off())
    tables.write("owners", owners, [])
    tables.write("latest", latest, [])
    joined = tables.joined("visits", "owners", "latest")
    assert exchanges(joined) == 0
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "BroadcastHashJoin" not in plan
    # An aggregate by the key follows without one as well.
    assert exchanges(joined.groupBy("device").count()) == 0


def test_hot_devices_are_not_in_buckets(spark, tables, visits):
    # Ranges as small as these are put together otherwise.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write("visits", visits, ["visit"], HOT)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot = spark.table(tables._hot("visits"))
    assert [r[0] for r in hot.select("device").distinct().collect()] == [0]
    assert len(hot.inputFiles()) > 1
    tables.write("visits", visits.where("device <> 0"), ["visit"], HOT)
    assert not spark.catalog.tableExists(tables._hot("visits"))
    assert tables.read("visits").where("device = 0").isEmpty()


def test_many_rows_without_a_device(tables, visits, owners):
    lost = visits.selectExpr("if(visit % 2 = 0, null, device) as device", "visit")
    tables.write("visits", lost, ["visit"], HOT)
    tables.write("owners", owners, [])
    assert rows(tables.read("visits"), "visit") == rows(lost, "visit")
    got, want = tables.joined("visits", "owners"), lost.join(owners, "device")
    assert rows(got, *want.columns) == rows(want, *want.columns)


def test_empty_tables(tables, visits, owners):
    tables.write("visits", visits.where("false"), ["visit"], HOT)
    tables.write("owners", owners.where("false"), [])
    assert tables.joined("visits", "owners", how="left").isEmpty()


def test_what_is_joined_with_has_one_row_for_a_key(tables, visits, owners):
    tables.write("visits", visits, ["visit"], HOT)
    tables.write("owners", owners, [])
    tables.check_unique("owners")
    with pytest.raises(ValueError, match="many rows"):
        tables.joined("owners", "visits")
    tables.write("visits", visits, ["visit"])
    with pytest.raises(ValueError, match="more than one row"):
        tables.check_unique("visits")
    with pytest.raises(ValueError, match="inner or left"):
        tables.joined("visits", "owners", how="full")
