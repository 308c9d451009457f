import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalogflow.operators import analyzer as A
from catalogflow.operators import audit as AU
from catalogflow.operators import ledger as L

# the four sample ledger rows: before -> after
SAMPLE = [("fix a", "medicine", 60, 75), ("fix b", "medicine", 60, 85), ("fix c", "medicine", 75, 100),
          ("fix d", "medicine", 60, 75)]


def _ledger(spark, rows=SAMPLE):
    data = [(i, s, t, b, a, a - b, dt.datetime(2024, 1, 1)) for i, (s, t, b, a) in enumerate(rows)]
    return spark.createDataFrame(data, "seq long, strategy string, product_type string, score_before int, "
                                       "score_after int, delta int, ts timestamp")


def test_strategy_advice_sample(spark):
    req = spark.createDataFrame([("medicine",), ("cosmetic",)], "product_type string")
    adv = {r.product_type: r for r in L.strategy_advice(_ledger(spark), req, 3).collect()}
    t = L.AdviceText()
    want = "\n".join([t.improved % ("fix b", 25), t.improved % ("fix c", 25), t.improved % ("fix a", 15)])
    assert adv["medicine"].successful == want and adv["medicine"].scope == "type"
    assert adv["cosmetic"].successful == want and adv["cosmetic"].scope == "global"
    assert adv["medicine"].failed == t.no_failure


def test_strategy_failed_least_bad_first(spark):
    rows = SAMPLE + [("w1", "medicine", 80, 70), ("w2", "medicine", 80, 40), ("w3", "medicine", 80, 79),
                     ("w4", "medicine", 50, 50)]
    got = [(r.strategy, r.delta) for r in L.strategy_failed(_ledger(spark, rows), 3).orderBy("rank").collect()]
    assert got == [("w4", 0), ("w3", -1), ("w1", -10)]


def test_empty_ledger_defaults(spark):
    req = spark.createDataFrame([("medicine",)], "product_type string")
    r = L.strategy_advice(_ledger(spark, []), req).first()
    assert r.successful == L.AdviceText().no_success and r.failed == L.AdviceText().no_failure


def _html_df(spark, rows):
    return spark.createDataFrame([(i, h) for i, h in enumerate(rows)], "id int, html string")


def test_scorer_a_branches(spark):
    rows = ["<h1>x</h1><h2>y</h2>", "<h2>only</h2><ul><li>a</li></ul>", "<p>none</p>", "<!-- <h1>c</h1> --><h2>a</h2>",
            '<script>var s="<h1>";</script><h2>a</h2>', None, "",
            '<div class="x faq-section"><details><summary>q</summary></details></div>',
            '<div class="faq-section"></div><details><summary>late</summary></details>',
            '<A HREF="https://www.gov.br/x">g</A>', '<a href="https://WWW.GOV.BR/x">g</a>',
            "<p>Nota de Transparência ANVISA; Registro Anvisa 1; Fabricante X</p>"]
    out = {r.id: r for r in A.analysis_scores(A.analyze_html(_html_df(spark, rows), "html")).collect()}
    assert out[0].s_headings == 0 and out[1].s_headings == 10 and out[2].s_headings == 0
    assert out[3].s_headings == 10 and out[4].s_headings == 10
    assert out[1].s_readability == 10
    assert out[5].total_score == 0 and out[5].s_headings is None and out[6].total_score == 0
    assert out[7].s_faq_structure == 10 and out[8].s_faq_structure == 0  # nesting counts
    assert out[9].s_external_links == 10 and out[10].s_external_links == 0
    assert out[11].s_geo_signals == 10 and out[11].s_verifiable_data == 10


def test_tags_in_attribute_values_do_not_count(spark):
    rows = ["<p title='<h1>'>x</p><h2>b</h2>", '<div class="faq-section"></div><details><summary>late</summary></details>',
            '<div title="a > b" class="faq-section x"><div></div><details><summary>q</summary></details></div>',
            "<DIV CLASS=faq-section><Details open><SUMMARY>q</SUMMARY></Details></DIV><div><h1", None]
    out = {r.id: r for r in A.analysis_scores(A.analyze_html(_html_df(spark, rows), "html")).collect()}
    assert out[0].s_headings == 10
    assert [out[i].s_faq_structure for i in range(5)] == [0, 0, 10, 10, None]


def test_scorer_a_feedback_shape(spark):
    a = A.analyze_html(_html_df(spark, ["<h2>a</h2>"]), "html").first().analysis
    assert set(a.breakdown) == set(A.CHECKS) and a.breakdown["geo_signals"].feedback == []
    assert len(a.feedback_all) == 6


@pytest.mark.parametrize("length,ok", [(49, False), (50, True), (65, True), (66, False)])
def test_title_length(spark, length, ok, ):
    base = "Aldazida 50mg Pfizer 30 Comprimidos"
    title = base[:9] + "x" * (length - len(base)) + base[9:] if length >= len(base) else base[:length]
    df = spark.createDataFrame([(title, None, None)], "seo_title string, meta_description string, html_content string")
    s = AU.audit_content(df).first().audit.score_breakdown["seo_title_format"].score
    assert (s in (7.5, 15.0)) == ok


@pytest.mark.parametrize("length,bula,cta,expected", [
    (119, False, True, 10.0), (120, False, True, 15.0), (165, False, True, 15.0), (166, False, True, 10.0),
    (140, True, True, 10.0), (140, False, False, 10.0)])
def test_description_rules(spark, length, bula, cta, expected):
    tail = " Produto de qualidade na nossa loja." if cta else " Produto de qualidade na loja online."
    head = "Aldazida 50mg da Pfizer" + (" leia a bula " if bula else " ")
    desc = head + "x" * (length - len(head) - len(tail)) + tail
    df = spark.createDataFrame([(None, desc, None)], "seo_title string, meta_description string, html_content string")
    assert df.select(F.length(F.lit(desc))).first()[0] == length
    assert AU.audit_content(df).first().audit.score_breakdown["meta_description_format"].score == expected


def test_audit_no_content(spark):
    df = spark.createDataFrame([(None, None, None)], "seo_title string, meta_description string, html_content string")
    a = AU.audit_content(df).first().audit
    assert a.seo_score == 0.0 and list(a.score_breakdown) == ["error"]


def test_ledger_entries_zero_delta_not_logged(spark):
    df = spark.createDataFrame([(1, "t", "<h2>a</h2>"), (2, "t", "<p>x</p>")], "id int, product_type string, html string")
    before = A.analyze_html(df, "html")
    after = A.analyze_html(df.withColumn("html", F.concat("html", F.lit("<ul><li>x</li></ul>"))), "html")
    e = L.ledger_entries(before, after, "id", "product_type").collect()
    assert len(e) == 2 and all(r.delta == 10 for r in e)
    assert all(r.strategy.startswith("cleared: ") for r in e)
    same = L.ledger_entries(before, before, "id", "product_type").collect()
    assert same == []


def test_ledger_entries_from_persisted_pairs(spark, tmpdir_path):
    import os
    df = spark.createDataFrame([(1, "t", "<h2>a</h2>"), (2, "t", "<p>x</p>")], "id int, product_type string, html string")
    before = A.analyze_html(df, "html", out="before").drop("html")
    path = os.path.join(tmpdir_path, "before")
    before.write.parquet(path)
    after = A.analyze_html(df.withColumn("html", F.concat("html", F.lit("<ul><li>x</li></ul>"))), "html", out="after")
    pairs = spark.read.parquet(path).join(after.select("id", "after"), "id")
    e = {r.id: r for r in L.ledger_entries_paired(pairs, "id", "product_type").collect()}
    assert {k: v.delta for k, v in e.items()} == {1: 10, 2: 10}
    joined = {r.id: r.delta for r in L.ledger_entries(A.analyze_html(df, "html"), after.withColumnRenamed(
        "after", "analysis"), "id", "product_type").collect()}
    assert joined == {1: 10, 2: 10}


def test_long_form_scores_each_page_once(spark):
    """The exploded breakdown must not draw the scorer into a filter below it."""
    rows = [(1, "t", "m", "<h1>x</h1><h2>y</h2>"), (2, None, None, None)]
    df = spark.createDataFrame(rows, "id int, seo_title string, meta_description string, html_content string")
    long = AU.audit_long(AU.audit_content(df), "id")
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    got = long.groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {1: len(AU.RULES), 2: 1}
    none = df.select("id", F.expr("cast(null as struct<score_breakdown: map<string, struct<score double, max_score double, feedback string>>>)").alias("audit"))
    assert AU.audit_long(none, "id").count() == 0
