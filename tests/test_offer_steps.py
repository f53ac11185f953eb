"""What the queries on all offers shuffle, keep in a task, and say."""

import re

import duckdb
import pytest

from shelfwise.plans import board as B
from shelfwise.sources import views as V

SF = "/root/testdata/sf0.001"


def plan_of(df):
    """The plan as it was run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_union_merge_shares_its_shuffle(spark):
    """one shuffle of the bare rows for all that read offers, and one of those whose address is compared."""
    own = [line for line in plan_of(B.union_merge(spark, SF)).splitlines() if "Exchange hashpartitioning(l_partkey" in line and "Reused" not in line]
    assert 1 <= len(own) <= 2


def test_restale_batch_makes_only_pages_that_are_asked_for(spark):
    """pages are made after the queue has chosen their addresses, and the answers are sent to the offers."""
    plan = plan_of(B.restale_batch(spark, SF))
    assert "LeftSemi" in plan and not re.search("SortMergeJoin.*LeftOuter.*\n.*checked_at", plan) and "BroadcastHashJoin [url" in plan


def test_product_images_orders_no_offers(spark, tmp_path):
    """F32: no order of all offers; a colour that is a shop's number is one picture."""
    assert "Window" not in plan_of(B.product_images(spark, SF))
    con = duckdb.connect()
    con.sql(f"copy (select * replace (case when p_partkey % 2 = 0 then (select min(l_suppkey)::varchar from '{SF}/lineitem.parquet' where l_partkey = p_partkey) || ' x' else p_name end as p_name) from '{SF}/part.parquet') to '{tmp_path}/part.parquet'")
    con.sql(f"copy (select * from '{SF}/lineitem.parquet' where l_partkey % 7 <> 0) to '{tmp_path}/lineitem.parquet'")
    for name in ("part", "lineitem"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    want = con.sql(B.ORACLES["product_images"]).fetchall()
    assert sorted(map(tuple, B.product_images(spark, str(tmp_path)).collect())) == sorted(want)


def test_large_tables_come_in_more_parts(spark):
    rows = spark.range(1000).repartition(3)
    assert V.parted(rows, "id", 50).rdd.getNumPartitions() == 20 and V.parted(rows, "id").rdd.getNumPartitions() == 3
    assert pytest.approx(V.parted(rows, "id", 50).count()) == 1000
