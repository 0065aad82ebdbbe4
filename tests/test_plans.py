"""Physical-plan properties that matter at scale."""

import re

from tabfold.operators import profile, sampling, wrangle
from tabfold.plans import catalog as C
from conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hash_split_is_narrow_and_pruned(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    p = _plan(sampling.hash_split(li.select(*C.LI_KEYS, "l_tax"), C.LI_KEYS, 23))
    assert "Exchange" not in p and "Sort" not in p
    scan = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert "l_shipdate" not in scan and "l_returnflag" not in scan


def test_filter_pushed_to_scan(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    p = _plan(wrangle.keep_classes(o, "o_orderstatus", ["F", "O"]))
    assert "PushedFilters: [In(o_orderstatus" in p or "PushedFilters: [IsNotNull(o_orderstatus), In(" in p


def test_folds_window_keyed_by_prefix_and_offsets_broadcast(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    p = _plan(sampling.stratified_folds(o, ["o_orderkey"], "o_orderstatus", 10, 3))
    # the row_number window is partitioned by (class, repeat, prefix), never by class alone
    windows = re.findall(r"Window \[row_number\(\).*?\], \[([^\]]*)\]", p)
    assert windows and all("_b" in w for w in windows)
    assert "BroadcastHashJoin" in p


def test_profile_aggregates_partially(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    long = profile.long_format(li, ["l_quantity", "l_tax"])
    p = _plan(profile.feature_profile(long, approx=True))
    assert "partial_count" in p and re.search("partial_(percentile_approx|approx_percentile)", p)


def test_label_join_broadcasts_small_side_only(spark):
    p = _plan(C._docs_labels(spark, SF001, "left"))
    assert "BroadcastHashJoin" in p and "BuildRight" in p
    big = spark.range(0, 10).withColumnRenamed("id", "doc_id")
    # a side over the byte bound is not hinted
    assert wrangle.broadcast_if_small(big, max_bytes=16) is big


def test_confusion_reads_scored_rows_through_one_cached_aggregate(spark):
    p = _plan(C.q_confusion_matrix(spark, SF001))
    # both the zero-fill grid and the counts come from the persisted aggregate
    assert len(re.findall(r"InMemoryTableScan", p)) >= 2
