"""Helpers: memos, slices, stored tables."""

import os

import pyarrow as pa
import pytest

from veldt.llm import common


def test_memo_numbers_words_as_they_come():
    memo = common.Memo()
    got, new = memo.numbers(pa.array(["b", "a", ""]))
    assert got.tolist() == [0, 1, 2] and new == ["b", "a", ""] and len(memo) == 3
    got, new = memo.numbers(pa.array(["a", "c", "b", "d"]))
    assert got.tolist() == [1, 3, 0, 4] and new == ["c", "d"]
    assert memo.numbers(pa.array(["d", ""]))[0].tolist() == [4, 2]
    assert memo.numbers(pa.array([], pa.string()))[1] == []


def test_slices_hold_all_rows_and_few_bytes():
    b = pa.record_batch({"i": list(range(100)), "text": ["x" * 1000] * 100})
    parts = list(common.slices([b, b.slice(0, 0)], 10_000))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(100)) and max(p.num_rows for p in parts) <= 10
    assert [p.num_rows for p in common.slices([b], 1)] == [1] * 100
    common.give_back()


def test_scratch_tables_go_and_others_stay(spark):
    kept = common.stored(spark.range(5))
    with common.scratch(spark):
        gone = common.stored(spark.range(7))
        assert gone.count() == 7
    path = gone.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert not os.path.exists(path) and kept.count() == 5


def test_lists_are_broadcast_up_to_a_bound(spark):
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(common.bounded(spark.range(5), 5)) and not hinted(common.bounded(spark.range(6), 5))


def test_option_is_only_lowered(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "500")
        common.small_batches(spark)
        assert spark.conf.get(key) == "500"
        spark.conf.set(key, "10000")
        common.small_batches(spark)
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, old)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_folder(Session())
