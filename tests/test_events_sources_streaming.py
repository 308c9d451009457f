import json
import os

import pytest

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from catalogflow.operators import events as EV
from catalogflow.sources.documents import concat_pages, extract_pages
from catalogflow.sources.ledger import read_ledger
from catalogflow.sources.sheets import cells_to_columns, read_sheet, read_workbooks
from catalogflow.sources.templates import load_templates, template_map
from catalogflow.streaming import frames as S

SF = "/root/testdata/sf0.001"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["log", "done", "error"]),
                          st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\n\r"),
                                  max_size=20)), min_size=1, max_size=6))
def test_decode_encode_roundtrip(spark, items):
    rows = [(i, e, json.dumps({"message": m, "type": "info"})) for i, (e, m) in enumerate(items)]
    df = spark.createDataFrame(rows, "seq int, event string, data string")
    frames = df.select(F.lit(1).alias("k"), "seq", EV.encode_frame("event", "data").alias("frame"))
    dec = EV.decode_frames(EV.frame_chunks(frames, "k", "seq"), id_cols=["k"]).orderBy("pos").collect()
    assert [(r.event, r.payload.message) for r in dec] == [(e, m) for e, m in items]


def test_csv_sheet_multiline_bom(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "items.CSV")
    with open(p, "w", encoding="utf-8") as f:
        f.write('﻿ _EANSKU ,html\n 7891.0 ,"<p>a\nb, ""c""</p>"\n,\n')
    df = read_sheet(spark, p)
    assert df.columns == ["_EANSKU", "html"]
    rows = df.collect()
    assert rows[0].html == '<p>a\nb, "c"</p>' and rows[0]._EANSKU == " 7891.0 "


def test_workbooks(spark, tmpdir_path):
    rows = [["\ufeff key ", "name", None], ["7891", "Aldazida", "x"], [None, "x"], []]
    for n, content in (("a", rows), ("b", rows), ("empty", [])):
        with open(os.path.join(tmpdir_path, f"{n}.xlsx"), "w") as f:
            json.dump(content, f)
    glob = os.path.join(tmpdir_path, "*.xlsx")
    df = cells_to_columns(read_workbooks(spark, glob, json.loads), ["key", "name"])
    got = sorted(((r.row_no, r.key, r.name) for r in df.collect()), key=repr)
    assert got == sorted([(1, "7891", "Aldazida"), (2, None, "x"), (3, None, None)] * 2, key=repr)
    assert read_sheet(spark, glob, parse=json.loads).columns == ["path", "row_no", "key", "name"]
    with pytest.raises(ValueError, match="parse"):
        read_sheet(spark, glob)


def test_templates_and_ledger_sources(spark, tmpdir_path):
    from catalogflow.operators.completions import TEMPLATE_DIR
    t = template_map(load_templates(spark, TEMPLATE_DIR))
    assert {"page_generator", "quality_refiner", "essentials_fallback"} <= set(t)
    assert t["page_generator"].count("\n") > 2 and "{{" in t["page_generator"]   # files are read whole
    bad = os.path.join(tmpdir_path, "tpl")
    os.makedirs(bad)
    open(os.path.join(bad, "ok.yaml"), "w").write("template: hi {{ x }}\n")
    open(os.path.join(bad, "broken.yml"), "w").write("template: [unclosed\n")
    rows = {r.template_name: r for r in load_templates(spark, bad).collect()}
    assert rows["ok"].template == "hi {{ x }}" and rows["broken"].error is not None
    assert load_templates(spark, os.path.join(tmpdir_path, "absent")).count() == 0
    assert read_ledger(spark, os.path.join(tmpdir_path, "no-ledger")).count() == 0


def test_pages_extraction(spark, tmpdir_path):
    for k, text in (("d1", "page one\fpage two"), ("d2", "\f\fonly")):
        open(os.path.join(tmpdir_path, f"{k}.txt"), "w").write(text)
    pages = extract_pages(spark, os.path.join(tmpdir_path, "*.txt"))
    joined = {r.doc_key: r.text for r in concat_pages(pages).collect()}
    assert joined == {"d1": "page onepage two", "d2": "only"}
    nl = {r.doc_key: r.text for r in concat_pages(pages, sep="\n", skip_blank=False, terminate=True).collect()}
    assert nl["d2"] == "\n\nonly\n"


def test_streaming_equals_batch(spark, tmpdir_path):
    from catalogflow.plans.standins import std_frames
    chunks = EV.frame_chunks(std_frames(spark, SF), "user_id", "event_id")
    src = os.path.join(tmpdir_path, "chunks")
    chunks.write.json(src)
    out = os.path.join(tmpdir_path, "counts")
    S.run_available_now(S.log_counts_stream(S.decode_stream(spark, src)), out, os.path.join(tmpdir_path, "ck"), "complete")
    streamed = sorted(map(tuple, S.read_complete(spark, out).collect()))
    batch = sorted(map(tuple, EV.log_counts(EV.decode_frames(chunks, id_cols=["user_id", "chunk"])).collect()))
    assert streamed == batch


def test_a_second_run_keeps_the_first(spark, tmpdir_path):
    src, out, ck = (os.path.join(tmpdir_path, n) for n in ("src", "out", "ck"))
    for i in (1, 2):
        spark.createDataFrame([(i, "<h2>x</h2>")], "id long, html string").write.mode("append").json(src)
        S.run_available_now(S.scores_stream(spark.readStream.schema("id long, html string").json(src)), out, ck)
    rows = spark.read.parquet(out).collect()
    assert sorted((r.id, r.batch_id) for r in rows) == [(1, 0), (2, 1)]
    other = os.path.join(tmpdir_path, "ck2")  # another job on the same output takes nothing away
    S.run_available_now(S.scores_stream(spark.readStream.schema("id long, html string").json(src)), out, other)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 1, 2, 2]


def test_review_fold_over_two_runs(spark, tmpdir_path):
    src, out, ck = (os.path.join(tmpdir_path, n) for n in ("src", "out", "ck"))
    schema = "item_key string, status string, ts long, seq long"
    for rows in ([("a", "pending", 1, 1), ("b", "approved", 1, 2)], [("a", "approved", 2, 3), ("b", "pending", 0, 9)]):
        spark.createDataFrame(rows, schema).write.mode("append").json(src)
        S.run_available_now(S.review_latest_stream(spark.readStream.schema(schema).json(src)), out, ck, "update")
    assert {r.item_key: r.status for r in S.read_latest(spark, out).collect()} == {"a": "approved", "b": "approved"}


def test_ledger_keeps_objects_only(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "l.json")
    open(path, "w").write('{"seq": 1, "strategy": "s"}\n123\n"x"\nnull\n[1]\n{bad\n')
    assert [r.seq for r in read_ledger(spark, path).collect()] == [1]
    assert read_ledger(spark, path, keep_corrupt=True).where("_corrupt_record is not null").count() == 5


def test_ledger_reads_do_not_share_state(spark, tmpdir_path):
    from catalogflow.sinks.files import append_ledger
    from catalogflow.sources.ledger import LEDGER_SCHEMA
    from catalogflow.plans.standins import std_ledger
    led = std_ledger(spark, SF)
    jp, pp = os.path.join(tmpdir_path, "j"), os.path.join(tmpdir_path, "p")
    append_ledger(led, jp)
    append_ledger(led, pp, fmt="parquet")
    n_fields = len(LEDGER_SCHEMA.fields)
    assert read_ledger(spark, jp).count() == led.count()
    assert len(LEDGER_SCHEMA.fields) == n_fields
    assert "_corrupt_record" not in read_ledger(spark, pp, fmt="parquet").columns


def test_original_ledger_file(spark, tmpdir_path):
    """The original format: one indented JSON array with the original field names."""
    rows = [("fix a", 60, 75), ("fix b", 60, 85), ("fix c", 75, 100), ("fix d", 60, 75)]
    recs = [{"estrategia_aplicada": s, "tipo_de_produto": "medicine", "texto_original_score": b,
             "novo_texto_score": a, "melhora_score": a - b, "timestamp": "2025-01-01T00:00:00+00:00"}
            for s, b, a in rows]
    p = os.path.join(tmpdir_path, "ledger.json")
    with open(p, "w", encoding="utf-8") as f:
        json.dump(recs, f, indent=2, ensure_ascii=False)
    led = read_ledger(spark, p, fmt="json_array").orderBy("seq").collect()
    assert [(r.strategy, r.delta) for r in led] == [("fix a", 15), ("fix b", 25), ("fix c", 25), ("fix d", 15)]
    assert led[0].rows_read is None and led[0].ts is not None


def test_frames_cut_anywhere_decode_as_if_whole(spark, tmpdir_path):
    import random

    from catalogflow.operators import events as EV
    from catalogflow.streaming import frames as S
    rnd = random.Random(4)
    blocks = [f"event: {rnd.choice(['log', 'done'])}\ndata: " + json.dumps({"message": "m" * rnd.randint(0, 30) + str(i)}) for i in range(40)]
    rows, want = [], {}
    for key in (0, 1, 2, 3):
        mine = blocks[key * 10:key * 10 + 10]
        text = "".join(b + "\n\n" + "\n" * rnd.choice([0, 0, 1, 2, 3]) for b in mine) + ("" if key else "event: log\ndata: never ended")
        want |= {(key, i): b for i, b in enumerate(mine)}
        n = at = 0
        while at < len(text):
            size = 1 if key == 1 else rnd.choice([1, 2, 3, 17, 60])
            rows.append((key, n, text[at:at + size]))
            n, at = n + 1, at + size
    rows += [(9, 0, None), (9, 1, "\n\n"), (9, 2, "")]
    chunks = spark.createDataFrame(rows, "user_id long, chunk long, text string").repartition(5)
    got = EV.reassemble(chunks, "user_id").collect()
    assert {(r.user_id, r.text) for r in got} == {(k, b) for (k, _), b in want.items()} and len(got) == 40
    order = sorted((r.user_id, r.frame_no, r.text) for r in got)
    assert [t for _, _, t in order] == [want[k] for k in sorted(want)]
    decoded = EV.decode_frames(EV.reassemble(chunks, "user_id"), "text", ["user_id"])
    assert decoded.where("payload.message is null").count() == 0 and decoded.count() == 40
    # the same as a stream: three portions, out of order, one delivered twice
    src, out, ckpt = (f"{tmpdir_path}/{n}" for n in ("src", "out", "ckpt"))
    for portion in (2, 0, 0, 1):
        chunks.where(f"pmod(hash(user_id, chunk), 3) = {portion}").write.mode("append").json(src)
        S.run_available_now(S.reassembled_stream(S.chunk_stream(spark, src)), out, ckpt)
    got = spark.read.parquet(out).collect()
    assert {(r.user_id, r.frame_no): r.text for r in got} == want and len(got) == 40
    # pieces cut by size put together again
    frames = spark.createDataFrame([(k, i, b + "\n\n") for (k, i), b in want.items()], "user_id long, event_id long, frame string")
    again = EV.reassemble(EV.cut_chunks(frames, "user_id", "event_id", F.lit(5)), "user_id").collect()
    assert {(r.user_id, r.frame_no): r.text for r in again} == want


def test_workers_get_the_package_wherever_the_driver_starts(tmpdir_path):
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from catalogflow.session import build_session
spark = build_session("local[1]", 1)
def run(frames):
    from catalogflow.operators.completions import call_with_retries
    for f in frames:
        yield f.assign(id=[len(call_with_retries(lambda p: p, ["a"]))] * len(f))
print("rows", spark.range(3).mapInPandas(run, "id long").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmpdir_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 3" in done.stdout, done.stderr[-2000:]


def test_too_many_headers_are_an_error(spark):
    cells = spark.createDataFrame([("p", 1, {f"h{i}": "x"}) for i in range(12)], "path string, row_no int, cells map<string,string>")
    assert len(cells_to_columns(cells).columns) == 14
    with pytest.raises(ValueError, match="more than 10"):
        cells_to_columns(cells, most=10)
    assert cells_to_columns(cells, ["h3"], most=1).columns == ["path", "row_no", "h3"]


def test_files_are_packed_into_tasks_by_size(spark, tmpdir_path):
    """Spark's file source deals whole files by bytes: many small ones share a task
    (and a call of the extractor), one that fills a task has it to itself."""
    from catalogflow.session import scratch_path
    folder = scratch_path(spark, "files")
    os.makedirs(folder)
    for i in range(400):
        with open(f"{folder}/small{i}.txt", "w") as f:
            f.write(f"leaflet {i}")
    with open(f"{folder}/large.txt", "w") as f:
        f.write("x" * (160 << 20))
    conf = {"spark.sql.files.openCostInBytes": "256k"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        tasks = spark.read.format("binaryFile").load(folder).select("path", "length", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    by = {}
    for r in tasks:
        by.setdefault(r.p, []).append(r.length)
    assert len(by) < 20 and [len(v) for v in by.values() if max(v) > 1 << 20] == [1]
