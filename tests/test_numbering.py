"""Row numbers that no single task counts."""

import random

from pyspark.sql import functions as F

from catalogflow.operators.numbering import number_rows


def test_numbers_follow_the_order_within_groups(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, "a", "b", "hot", "hot", "hot"]), rnd.choice([None, *range(40)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, id int").repartition(7)
    got = number_rows(df, [F.col("x"), F.col("id")], ("g",), "n", "size").collect()
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want.update({r[2]: (k, len(mine)) for k, r in enumerate(mine)})
    assert {r.id: (r.n, r["size"]) for r in got} == want
    whole = number_rows(df, [F.col("id").desc()], out="n", total="size").collect()
    assert sorted((r.n, r.id, r["size"]) for r in whole) == [(k, 2999 - k, 3000) for k in range(3000)]
    assert number_rows(df.limit(0), [F.col("id")]).collect() == []


def test_no_window_holds_a_whole_table(spark):
    df = spark.range(1000).withColumn("g", F.lit("one"))
    plan = number_rows(df, [F.col("id")], ("g",))._jdf.queryExecution().sparkPlan().toString()
    rows, ranges = [ln for ln in plan.splitlines() if "Window [" in ln and "row_number" in ln], [ln for ln in plan.splitlines() if "sum(_cf_rows" in ln]
    assert rows and all("_cf_range" in ln for ln in rows) and ranges


def test_labels_and_chunks_of_gappy_and_repeated_sequences(spark):
    from catalogflow.operators import enrich as E
    rows = [(None if i % 11 == 0 else f"k{i % 70}", (i * 3 // 4) * 5) for i in range(1300)]
    items = spark.createDataFrame(rows, "item_key string, input_seq long").repartition(5)
    mine = sorted(((s, k) for k, s in rows if k is not None))
    got = E.number_items(items).collect()
    assert sorted((r.item_no, r.input_seq, r.item_key, r.item_total) for r in got) == [(n, s, k, len(mine)) for n, (s, k) in enumerate(mine)]
    labels = sorted((r.input_seq, r.item_key, r.progress) for r in E.progress_label(items, key="item_key").collect())
    assert labels == sorted((s, k, f"({n + 1}/{len(mine)})") for n, (s, k) in enumerate(mine))
    # an item that meets two catalog rows is one item; the last chunk ends at the total
    routed = E.number_items(items).withColumn("route", F.when(F.col("item_no") % 2 == 0, "ready").otherwise("not_found"))
    routed = routed.unionByName(routed.where("item_no % 10 = 0"))
    out = {r.chunk_no: (r.n_items, r.n_ready, r.processed_count) for r in E.chunk_summary(routed).collect()}
    assert out == {0: (500, 300, 500), 1: (500, 300, 1000), 2: (len(mine) - 1000, out[2][1], len(mine))}


def test_sums_before_each_row(spark):
    df = spark.createDataFrame([(g, i, i % 5) for g in "ab" for i in range(200)], "g string, i int, v int").repartition(6)
    for r in number_rows(df, [F.col("i")], ("g",), sums={"before": "v"}).collect():
        assert r.before == sum(k % 5 for k in range(r.i)) and r.before_total == 400
