"""Ranks, counters and folds keep rows whose class, capture, time or kind is null."""

from pyspark.sql import functions as F

from nxtide.operators import learning, messages, windows

WINDOWS = "pcap_id long, wnum long, cls long, llr double"
ROWS = [(1, 0, 0, 1.0), (None, 1, 0, 2.0), (1, 2, None, 3.0), (None, 3, None, 4.0), (2, None, 0, 5.0), (2, 5, 1, 6.0)]


def test_folds_keep_all_rows(spark):
    df = spark.createDataFrame(ROWS, WINDOWS)
    out = windows.split_portion(df, 0, 2).collect()
    assert sorted(r["llr"] for r in out) == [1, 2, 3, 4, 5, 6]
    # in class 0 the window without a capture comes first
    assert {r["llr"]: r["fold"] for r in out if r["cls"] == 0} == {2.0: 0, 1.0: 1, 5.0: 1}
    assert {r["llr"]: r["fold"] for r in out if r["cls"] is None} == {4.0: 0, 3.0: 1}
    turned = windows.kfold(df, 2, 1)
    assert turned.count() == 12 and turned.filter("train").count() == 6


def test_stratified_folds_keep_all_rows(spark):
    df = spark.createDataFrame([(i, i % 2 if i % 5 else None) for i in range(20)], "id long, label int")
    assert learning.stratified_folds(df, "label", 4, "id").count() == 20


def test_ranks_of_null_groups(spark):
    df = spark.createDataFrame([(None, None, 1), (None, 3, 2), (1, 2, 3), (1, None, 4), (None, None, 5)], "g long, b long, id long")
    out = {r["id"]: r["place"] for r in messages.running_rank(df, ("g",), F.col("b"), ("b", "id"), "place").collect()}
    assert out == {1: 0, 5: 1, 2: 2, 4: 0, 3: 1}


def test_counters_keep_messages_without_capture_or_time(spark):
    rows = [(1, 1, 0.0, False), (2, 1, None, False), (3, None, 5.0, True), (4, None, 4000.0, False), (5, 1, 9000.0, None), (6, 1, 9001.0, False)]
    df = spark.createDataFrame(rows, "id long, pcap_id long, time_s double, is_r boolean")
    out = {r["id"]: (r["fn"], r["fn_req"], r["time_s_translated"]) for r in messages.with_translated_time(messages.with_counters(df)).collect()}
    assert out == {2: (0, 0, None), 1: (1, 1, 0.0), 5: (2, 1, 9000.0), 6: (3, 2, 9001.0), 3: (0, 0, 0.0), 4: (1, 0, 3995.0)}
