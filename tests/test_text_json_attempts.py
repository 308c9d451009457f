from pyspark.sql import functions as F

from catalogflow.functions import jsonx as J
from catalogflow.functions.html import base_name, suffix_headings
from catalogflow.functions.prompts import render
from catalogflow.functions.text import elapsed_hms, pretty_label
from catalogflow.operators.attempts import select_attempt

CASES = [
    ('pre ```json\n{"a": {"b": 1}}\n``` post', '{"a": {"b": 1}}', True, '{"a": {"b": 1}}', True),
    ('x {"a":1} y', '{"a":1}', True, '{"a":1}', True),
    ('{"a": {"b": 1}, "c": 2}', '{"a": {"b": 1}', False, '{"a": {"b": 1}, "c": 2}', True),
    ("no object", None, False, None, False),
    ('{x} then ```json {"a": 1} ```', "{x}", False, '{"a": 1}', True),
]


def test_json_extraction_modes(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "t string")
    got = df.select(J.extract_json_text("t", "shortest").alias("s"), J.extract_json_text("t", "outermost").alias("o")) \
        .select("s", J.is_json("s").alias("sp"), "o", J.is_json("o").alias("op")).collect()
    for (text, s, sp, o, op), r in zip(CASES, got):
        assert (r.s, r.sp) == (s, sp), text
        assert r.op == op, text
    errs = spark.createDataFrame([('{"error": "boom"}',)], "t string").select(J.json_error("t")).collect()
    assert errs[0][0] == "boom"


def test_attempt_selection(spark):
    rows = [("a", 1, 80.0), ("a", 2, 70.0), ("b", 1, 96.0), ("b", 2, 99.0), ("c", 1, 10.0), ("c", 2, 95.0)]
    df = spark.createDataFrame(rows, "item string, attempt int, score double")
    last = {r.item: (r.score, r.attempts_run) for r in select_attempt(df, "item").collect()}
    best = {r.item: r.score for r in select_attempt(df, "item", select="best").collect()}
    assert last == {"a": (70.0, 2), "b": (96.0, 1), "c": (95.0, 2)}
    assert best == {"a": 80.0, "b": 96.0, "c": 95.0}


def test_small_scalars(spark):
    df = spark.createDataFrame([("no_h1_tag", 3725000 * 100, "Aldazida 50mg + 50mg", "<h2>A</h2><H2>B</H2>", "Pre$o\\x")],
                               "k string, ms long, name string, html string, odd string")
    r = df.select(pretty_label("k").alias("l"), elapsed_hms("ms").alias("e"), base_name("name").alias("b"),
                  suffix_headings("html", F.lit("Ald")).alias("h"), suffix_headings("html", "odd").alias("h2")).first()
    assert r.l == "No H1 Tag" and r.e == "103:28:20" and r.b == "Aldazida"
    assert r.h == "<h2>A - Ald</h2><H2>B - Ald</h2>"
    assert r.h2 == "<h2>A - Pre$o\\x</h2><H2>B - Pre$o\\x</h2>"


def test_render_prompt(spark):
    df = spark.createDataFrame([("A&B", None)], "n string, t string")
    r = df.select(render("P: {{ n }} / {{t}} / {{ missing }}.", {"n": "n", "t": "t"}, escape=True).alias("p")).first()
    assert r.p == "P: A&amp;B /  / ."


def test_gates_and_fallbacks(spark):
    df = spark.createDataFrame([("x" * 51, 96.0), ("short", 71.0), (None, 10.0)], "h string, s double")
    r = df.select(J.generated_ok("h").alias("g"), J.fallback_html("h").alias("f"), J.score_band("s").alias("b")).collect()
    assert [x.g for x in r] == [True, False, False]
    assert r[1].f == J.FALLBACK_HTML_ERROR and r[2].f == J.FALLBACK_HTML_ERROR
    assert [x.b for x in r] == ["approved_quality", "ok", "below_target"]
