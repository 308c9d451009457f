"""One stream of page events: tags, references, headings, tables, links."""

import html
import random

import pytest
from pyspark.sql import functions as F

from catalogflow.functions import html as H
from catalogflow.operators import analyzer as A
from catalogflow.operators import audit as AU


def of(spark, pages):
    return spark.createDataFrame(list(enumerate(pages)), "id int, html string")


def test_references_resolve_as_a_browser_does(spark):
    texts = ["a&amp;b", "&ecirc;&#234;&#xEA;&#XEa;", "&copy 2024 &copyx", "&notit; &notin; &am &amp", "&#0;&#x110000;&#xD800;&#150;&#129;&#x;&#;",
             "& &&& &&&a &b;", "&NotEqualTilde;&CounterClockwiseContourIntegral;", "", "x&", "&#65", "&amp;lt;", "&#38;lt;", "&#99999999999999999999;"]
    rnd, names = random.Random(1), sorted(html.entities.html5)
    texts += ["".join(rnd.choice([f"&{rnd.choice(names)}", f"&#{rnd.randint(1, 70000)};", f"&#x{rnd.randint(160, 70000):x}", "txt ", "&", ";"])
                      for _ in range(6)) for _ in range(300)]
    for r in of(spark, texts).select("html", H.decode_entities("html").alias("d")).collect():
        assert r.d == html.unescape(r.html), r.html


@pytest.mark.parametrize("page,score", [
    ("<p>Nota de transpar&ecirc;ncia</p><p>ANVISA</p>", 10), ("<p>nota de transpar&#234;ncia anvisa</p>", 10),
    ("<p>nota de transpar&#xEA;ncia anv<b title='>'>isa</b></p>", 10), ("<p>nota de transpar&amp;ecirc;ncia anvisa</p>", 0),
    ("<p>nota de transparência</p><!-- anvisa -->", 0), ("<p>nota de transparência</p><script>'</p>anvisa'</script>", 0),
    ("<template><p>nota de transparência anvisa</p></template>", 0)])
def test_visible_text_decides_geo_signals(spark, page, score):
    assert A.analysis_scores(A.analyze_html(of(spark, [page]))).first().s_geo_signals == score


def test_quoted_markup_is_no_markup(spark):
    table = "<table data-x='a>b'><tr id=\"<tr>\"><td title='a > b'>Fabricante</td><td>x</td></tr><tr><th data-y='<td>'>Princ&iacute;pio Ativo<tr><td>Registro&#32;MS</td></table><table><tr><td>2</td></tr></table>"
    rows = [table, "<h2 title='</h2>'>One &amp; <i>two</i></h2><details class=\"a>b\"><h2>in</h2></details><H3 x='>'>three</h3>\n <p>y<h3>no</h3>text<p>",
            "<h2>open", "", None, "<tr><td>no table</td></tr>", "<h2>a<h3>b</h3></h2>"]
    out = [r.o for r in of(spark, rows).withColumn("ev", H.events("html")).select("id", H.outline("ev").alias("o")).orderBy("id").collect()]
    assert out[0].labels == ["fabricante", "princípio ativo", "registro ms"]
    assert (out[1].h2, out[1].h2_main, out[1].h3, out[1].pairs) == (["One & two", "in"], ["One & two"], ["three", "no"], 1)
    assert out[2].h2 == [] and out[3].h2 == [] and out[4] is None and out[5].labels == [] and out[6].h2 == ["ab"]
    df = spark.createDataFrame([("n", "t", "m", table)], "name string, seo_title string, meta_description string, html_content string")
    assert AU.audit_content(df).first().audit.score_breakdown["specifications_table"].score == 10.0


@pytest.mark.parametrize("tag,ok", [
    ('<a title="x > y" href="https://www.gov.br">', True), ("<A class=x HREF='http://a.gov.br/b'>", True), ("<a href=//x.gov.br/y>", True),
    ("<a title=\"href='https://gov.br'\" href=/v>", False), ("<a href='https://GOV.BR'>", False), ('<a data-href="gov.br">', False),
    ("<abbr href='gov.br'>", False), ("<!-- <a href='gov.br'> -->", False), ("<a\nhref = 'x' title='gov.br'>", False), ("<a/href='gov.br'>", True)])
def test_links_step_over_other_attributes(spark, tag, ok):
    assert A.analysis_scores(A.analyze_html(of(spark, [tag + "t</a>"]))).first().s_external_links == (10 if ok else 0)


def test_faq_block_and_open_details(spark):
    inside = '<div title="a > b" class="x faq-section"><div>q</div><details data-o=\'open\'><summary>s</summary></details></div>'
    pages = [inside, inside.replace("faq-section", "faq-section-x"), inside.replace('class="x faq', 'class="faq-section"><p></div><div class="x'),
             "<div class=faq-section><details open='' ><summary>"]
    scores = [r.s_faq_structure for r in A.analysis_scores(A.analyze_html(of(spark, pages))).orderBy("id").collect()]
    assert scores == [10, 0, 0, 10]
    g = of(spark, pages).withColumn("t", H.tags_of(H.events("html"))).select(
        "id", F.exists("t", lambda x: (x["name"] == "details") & H.has_attribute(x["raw"], "open")).alias("o")).orderBy("id").collect()
    assert [r.o for r in g] == [False, False, False, True]


def test_hostile_pages_end(spark):
    pages = ["<a " + "x=" * 50000 + ">", "<" * 100000, "<p title='" + "a" * 300000, "<!--" + "-" * 200000, "<script>" + "<" * 100000,
             "<p " + "a='b' " * 20000 + ">end", "&" * 100000, "<table>" + "<tr><td>x" * 5000]
    n = of(spark, pages).withColumn("ev", H.events("html")).select(F.size("ev").alias("n"), F.size(H.outline("ev")["labels"]).alias("l")).collect()
    assert len(n) == len(pages) and n[-1].l == 4999
    from html.parser import HTMLParser

    class Names(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = []

        def handle_starttag(self, tag, attrs):
            self.found.append(tag)

        def handle_endtag(self, tag):
            self.found.append("/" + tag)

    rnd = random.Random(3)
    pages = ["".join(rnd.choice(["<p>", "</p>", "text ", "a < b", "<b x='>'>", '<i y=">" z>', "<!-- <p> -->", "<br/>", "<H2 a=b>", "</H2 >"]) for _ in range(30))
             for _ in range(100)]
    for r in of(spark, pages).select("html", H.tag_names(H.tags_of(H.events("html"))).alias("n")).collect():
        reader = Names()
        reader.feed(r.html)
        want = [t for t in reader.found if t != "/br"]
        assert r.n == want, r.html
