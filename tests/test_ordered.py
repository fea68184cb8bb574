"""Numbering and paging with and without a prefix scan."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from geotrail.operators import ordered
from geotrail.operators.sizing import SplitPolicy, hot_keys

POLICY = SplitPolicy().forced(target_rows=50)


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds a third of the rows, most of them within a sliver of its time range."""
    rows_ = spark.range(3000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97 + 1).alias("key"),
        F.when(F.col("id") < 300, F.col("id") * 1_000_000)
        .otherwise(300_000_000 + F.col("id"))
        .alias("at"),
    )
    return rows_.cache()


def test_numbering_equals_row_number(skewed):
    whole = ordered.numbered(skewed, ["key"], ["at", "seq"], POLICY.off())
    cut = ordered.numbered(skewed, ["key"], ["at", "seq"], POLICY)
    assert rows(cut, "seq", "ordinal") == rows(whole, "seq", "ordinal")


@pytest.mark.parametrize("policy", [POLICY, POLICY.off()])
def test_pages_are_bounded_complete_and_in_order(skewed, policy):
    pages = ordered.paged(
        skewed, ["key"], ["at", "seq"], F.col("seq"), policy, "seqs", page_rows=40
    ).cache()
    assert pages.agg(F.max(F.size("seqs"))).first()[0] <= 40
    flat = pages.selectExpr("key", "first_ordinal", "posexplode(seqs) as (i, seq)").selectExpr(
        "seq", "first_ordinal + i as ordinal"
    )
    want = ordered.numbered(skewed, ["key"], ["at", "seq"], POLICY.off())
    assert rows(flat, "seq", "ordinal") == rows(want, "seq", "ordinal")


def test_number_of_hot_keys_is_bounded(skewed):
    few = SplitPolicy(target_rows=1, max_ranges=2, mode="on")
    assert [r.key for r in hot_keys(skewed, ["key"], few).collect()] == []
    some = SplitPolicy(target_rows=1, max_ranges=4, mode="on")
    assert [r.key for r in hot_keys(skewed, ["key"], some).collect()] == [0]


def test_auto_mode_looks_at_the_input_size_and_then_for_hot_keys(spark, folder):
    table = spark.read.parquet(f"{folder}/events.parquet")
    assert not SplitPolicy(target_rows=10).applies_to(table, ["user_id"])
    assert not SplitPolicy(small_input_bytes=10).applies_to(table, ["user_id"])
    assert SplitPolicy(target_rows=10, small_input_bytes=10).applies_to(table, ["user_id"])


@pytest.mark.parametrize("policy", [POLICY, SplitPolicy()])
def test_places_in_a_total_order(skewed, policy):
    """Also where nulls and one value hold much of the table."""
    df = skewed.withColumn("key", F.expr("nullif(key, 5)"))
    got = ordered.ranked(df, ["key", "at", "seq"], policy).cache()
    want = df.collect()
    want.sort(key=lambda r: (r["key"] is not None, r["key"] or 0, r["at"], r["seq"]))
    ranked = {r["position"]: r["seq"] for r in got.collect()}
    assert ranked == {i + 1: r["seq"] for i, r in enumerate(want)}
    assert got.columns == [*df.columns, "position"]


def test_places_of_no_rows_and_of_equal_rows(skewed):
    assert ordered.ranked(skewed.where("false"), ["key"], POLICY).count() == 0
    tied = ordered.ranked(skewed.select(F.lit(1).alias("same")), ["same"], POLICY)
    assert sorted(r["position"] for r in tied.collect()) == list(range(1, 3001))


def test_ranking_has_no_window_over_the_whole_table(skewed):
    plan = ordered.ranked(skewed, ["at", "seq"], POLICY)._jdf.queryExecution().executedPlan()
    windows = [n for n in plan.toString().splitlines() if "Exchange SinglePartition" in n]
    assert not windows
