"""Review state: reloads, snapshots, compaction and crashes in between."""

import os

import pytest
from pyspark.sql import functions as F

from catalogflow.operators import review as R
from catalogflow.streaming.review_store import ReviewStore, run_reviews

SCHEMA = "item_key string, status string, ts long, seq long, kind string"


def events(spark, rows):
    return spark.createDataFrame([(*r, "review")[:5] if len(r) == 4 else r for r in rows], SCHEMA)


ROWS = [("a", "pending", 1, 1), ("b", "approved", 1, 2), ("c", "disapproved", 2, 3), ("a", "approved", 3, 4),
        # the draft is read again: items a, b and d, all pending
        ("a", "pending", 5, 0, "reload"), ("b", "pending", 5, 0, "reload"), ("d", "pending", 5, 0, "reload"),
        ("b", "disapproved", 4, 9), ("d", "approved", 6, 1), ("b", "approved", 5, 0), ("e", "approved", 7, 1), ("c", "approved", 4, 8)]
WANT = {"a": "pending", "b": "approved", "d": "approved", "e": "approved"}


def test_a_reload_in_the_middle(spark):
    got = R.latest_after_reloads(events(spark, ROWS)).collect()
    assert {r.item_key: r.status for r in got} == WANT
    again = ROWS + [(k, "pending", 9, 0, "reload") for k in "ce"]
    assert {r.item_key: r.status for r in R.latest_after_reloads(events(spark, again)).collect()} == {"c": "pending", "e": "pending"}
    plain = events(spark, ROWS[:4]).drop("kind")
    assert {r.item_key: r.status for r in R.latest_after_reloads(plain).collect()} == {"a": "approved", "b": "approved", "c": "disapproved"}
    assert R.latest_after_reloads(events(spark, [])).collect() == []
    plan = R.fold(events(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def files_of(folder):
    return sum(len([f for f in files if f.endswith(".parquet")]) for _, _, files in os.walk(folder))


def feed(spark, src, rows):
    events(spark, rows).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(SCHEMA).parquet(src)


def test_many_small_runs_leave_few_files(spark, tmpdir_path):
    src, ckpt = f"{tmpdir_path}/src", f"{tmpdir_path}/ckpt"
    store = ReviewStore(spark, f"{tmpdir_path}/store")
    with pytest.raises(FileNotFoundError):
        store.states()
    most, want = 0, {}
    for n in range(24):
        key, status = f"k{n % 5}", ("approved", "disapproved")[n % 2]
        want[key] = status
        run_reviews(feed(spark, src, [(key, status, n, n)]), store, ckpt, compact_every=4)
        most = max(most, files_of(f"{tmpdir_path}/store"))
        if n in (2, 9, 23):
            assert {r.item_key: r.status for r in store.latest().collect()} == want
    # the log never holds more than the batches since the last snapshot (each of at most one file per shuffle partition)
    assert most <= 4 * 8 + 2 * 8 and sum(map(len, store.pending().values())) < 4
    assert len(os.listdir(f"{tmpdir_path}/store/snapshots")) <= 2 and store.manifest()["number"] == 6


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_crash_in_a_compaction_loses_and_doubles_nothing(spark, tmpdir_path, when):
    src, ckpt = f"{tmpdir_path}/src", f"{tmpdir_path}/ckpt"
    store = ReviewStore(spark, f"{tmpdir_path}/store")
    run_reviews(feed(spark, src, ROWS[:6]), store, ckpt, compact_every=100)
    with pytest.raises(RuntimeError, match="crash"):
        store.compact(_crash=when)
    run_reviews(feed(spark, src, ROWS[6:]), store, ckpt, compact_every=100)
    assert {r.item_key: r.status for r in store.latest().collect()} == WANT
    assert store.compact() and not store.compact()
    assert {r.item_key: r.status for r in store.latest().collect()} == WANT and store.pending() == {}
    assert store.latest().where(F.col("item_key") == "b").count() == 1
    # a compaction that comes second gives way
    late = store.manifest()
    run_reviews(feed(spark, src, [("z", "approved", 99, 1)]), store, ckpt, compact_every=100)
    assert store.compact()
    assert not store._name({**late, "number": late["number"] + 1})
    assert {r.item_key: r.status for r in store.latest().collect()} == WANT | {"z": "approved"}
