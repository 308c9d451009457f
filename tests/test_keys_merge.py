import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from catalogflow.functions.text import normalize_key
from catalogflow.operators.keys import normalize_keys, require_columns, trim_headers
from catalogflow.operators.merge import merge_first_match, merge_updates, rejected_rows


def test_key_normalisation_golden(spark):
    rows = [(" 007 ",), ("7891.0",), (" 123 ",), (None,), ("  ",), ("12.50",), ("abc.0",)]
    df = spark.createDataFrame(rows, "k string")
    got = [r[0] for r in df.select(normalize_key("k")).collect()]
    assert got == ["007", "7891", "123", None, None, "12.50", "abc.0"]
    kept = normalize_keys(df, "k").collect()
    assert len(kept) == 5


def test_trim_headers_and_required(spark):
    df = spark.createDataFrame([(1, 2)], "`﻿ a ` int, ` b` int")
    assert trim_headers(df).columns == ["a", "b"]
    with pytest.raises(ValueError, match="x, y"):
        require_columns(trim_headers(df), ["a", "x", "y"])


def _orig(spark):
    return spark.createDataFrame([("1", 0, "x", "a"), ("1", 1, "y", "b"), ("2", 2, None, "c"), ("3", 3, "z", None)],
                                 "key string, seq int, t string, u string")


def test_merge_updates_golden(spark):
    upd = spark.createDataFrame([("1", "N", None), ("2", "", "cc"), ("9", "zz", "q")], "key string, t string, u string") \
        .withColumn("extra", F.lit(1))
    out = {(r.key, r.seq): (r.t, r.u) for r in merge_updates(_orig(spark), upd, "key").collect()}
    assert out[("1", 0)] == ("N", "a") and out[("1", 1)] == ("N", "b")  # duplicates all updated, null keeps
    assert out[("2", 2)] == ("", "cc")  # '' replaces
    assert out[("3", 3)] == ("z", None)  # untouched
    assert merge_updates(_orig(spark), upd, "key").columns == ["key", "seq", "t", "u"]


def test_merge_updates_duplicate_keys(spark):
    upd = spark.createDataFrame([("2", "p", 1), ("2", "q", 2)], "key string, t string, pos int")
    with pytest.raises(Exception, match="duplicate update keys"):
        merge_updates(_orig(spark), upd, "key").collect()
    out = merge_updates(_orig(spark), upd, "key", duplicates="last", order="pos").where("key = '2'").collect()
    assert out[0].t == "q"


def test_merge_first_match(spark):
    upd = spark.createDataFrame([("1", None, 1), ("1", "late", 2), ("7", "no", 3)], "key string, t string, pos int")
    out = {r.seq: r.t for r in merge_first_match(_orig(spark), upd, "key", "seq", "pos", ["t"]).collect()}
    assert out == {0: "late", 1: "y", 2: None, 3: "z"}
    upd2 = spark.createDataFrame([("3", None, 1)], "key string, t string, pos int")
    out2 = {r.seq: r.t for r in merge_first_match(_orig(spark), upd2, "key", "seq", "pos", ["t"]).collect()}
    assert out2[3] is None  # null overwrites


def test_rejected_rows(spark):
    rej = spark.createDataFrame([(1,), (3,)], "key int")
    assert sorted(r.seq for r in rejected_rows(_orig(spark), rej, "key").collect()) == [0, 1, 3]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.text(max_size=3))), max_size=8),
       st.dictionaries(st.integers(0, 7), st.one_of(st.none(), st.text(max_size=3)), max_size=5))
def test_merge_properties(spark, orig, upd):
    o = spark.createDataFrame([(str(k), i, v) for i, (k, v) in enumerate(orig)], "key string, seq int, t string")
    u = spark.createDataFrame([(str(k), v) for k, v in upd.items()], "key string, t string")
    out = merge_updates(o, u, "key").collect()
    assert len(out) == len(orig)
    empty = merge_updates(o, u.limit(0), "key").collect()
    assert sorted(map(tuple, empty)) == sorted(map(tuple, o.select("key", "seq", "t").collect()))
    for r in out:
        want = upd.get(int(r.key)) if int(r.key) in upd and upd[int(r.key)] is not None else orig[r.seq][1]
        assert r.t == want


def test_finalize_guards_and_fold(spark):
    import datetime as dt
    from catalogflow.operators.review import finalize_approved, finalize_rejected, latest_reviews, review_gates
    orig = spark.createDataFrame([("1", "t1"), ("2", "t2")], "item_key string, seo_title string")
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([("1", "approved", 1, t, "new1"), ("1", "pending", 2, t, "x"), ("2", "disapproved", 3, t, "y")],
                               "item_key string, status string, seq long, ts timestamp, seo_title string")
    latest = {r.item_key: r.status for r in latest_reviews(ev).collect()}
    assert latest == {"1": "pending", "2": "disapproved"}  # re-rendering replaces the entry
    g = review_gates(latest_reviews(ev, columns=("status",))).first()
    assert g.has_pending and not g.can_finalize and g.show_disapproved_panel
    with pytest.raises(ValueError, match="approved"):
        finalize_approved(orig, ev, columns=("seo_title",), require=True)
    assert [r.item_key for r in finalize_rejected(orig, ev, require=True).collect()] == ["2"]


def test_draft_reload_and_sheet_sink(spark, tmpdir_path):
    from catalogflow.operators.review import reset_pending
    from catalogflow.sinks.files import write_sheet
    draft = spark.createDataFrame([("1", "a", 0), ("2", "b", 1)], "item_key string, seo_title string, input_seq long")
    assert {r.status for r in reset_pending(draft).collect()} == {"pending"}
    assert write_sheet(draft.limit(0), tmpdir_path, "draft", "r0") is None  # nothing to write
    out = write_sheet(draft, tmpdir_path, "draft", "r1", fmt="csv")
    assert out.endswith("kind=draft/run_id=r1")
    back = spark.read.option("header", True).csv(out)
    assert sorted(r.item_key for r in back.collect()) == ["1", "2"]
    with pytest.raises(Exception):
        write_sheet(draft, tmpdir_path, "draft", "r1")  # never overwrites a run
    with pytest.raises(ValueError):
        write_sheet(draft, tmpdir_path, "other", "r2")


def test_null_keys_spread_and_never_match(spark):
    from catalogflow.operators.enrich import left_join_spread_nulls
    left = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    right = spark.createDataFrame([("a", "A"), ("\u0000null:0", "X"), (None, "N")], "rk string, w string")
    out = sorted((r.v, r.w) for r in left_join_spread_nulls(left, right, "k", "rk").collect())
    assert out == [(1, None), (2, None), (3, "A")]
