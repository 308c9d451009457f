"""HTML extraction: parsing, tree matching, wrappers, whole pages."""

import html
import random
import re
import time

from pyspark.sql import functions as F

from catalogflow.llm import registered, wrappers
from catalogflow.llm.common import scratch_path, table

SF = "/root/testdata/sf0.001"


def texts(page):
    shape, blocks = wrappers.page_blocks(page)
    at = wrappers.places(shape)
    return [t for node, t, _ in blocks if at[node] == max((at[n] for n, *_ in blocks), default=0)]


def test_articles_of_the_given_pages(spark):
    got = {r.page_id: r.text for r in registered.op11_wrapper_induction(spark, SF).collect()}
    pages = table(spark, SF, "pages").collect()
    assert len(got) == len(pages)
    for r in pages:
        body = re.search(r"<article>(.*)</article>", re.sub(r"<!--.*?-->", "", r.html, flags=re.S), re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_what_parsing_takes_as_blocks_and_text():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="no-ads sidebar-left">
      <!-- <p>gone</p> --><nav><a href=x>Home</a></nav><header>Site</header><form id=aspnet>
      <article><header><h1>A &amp; B&nbsp;C</h1></header><p>one <b>two<i></b> thr<span>ee</span><br>four
      <p data-x='a > b' title="</article>">five &lt;p&gt; &eacute;&#233;&#xe9;<ul><li>x<li>y<ul><li>z</ul></ul>tail
      <table><tr><td>1<td>2<tr><td>3</table><div class="share-buttons">Share</div><aside>Side</aside><p hidden>no</p>
      <script>var s = "</p><p>not text";</script><p>1 < 2 and a<b</p><section id="comments"><article>I disagree</article></section>
      <footer>By me</footer></article><div class="comments"><article><p>First!</p></article></div></form>
      <div class=cookie-notice>We use cookies</div><footer>&copy; site</footer></body></html>"""
    assert texts(page) == ["A & B C", "one two three four", "five <p> ééé", "x", "y", "z", "tail", "1", "2", "3", "1 < 2 and a"]
    assert texts("plain &amp; simple") == ["plain & simple"]
    assert texts("") == [] and texts("<p></p><div> \n</div>") == []
    assert texts("<p>open <!-- never closed <p>x") == ["open"]
    assert texts("<p>a</p><p title='never closed>b</p>") == ["a"]
    assert texts("<p>a<script>never closed </p><p>b") == ["a"]
    assert texts("<p>x</p></div></p></li><p>y") == ["x", "y"]


def test_deep_long_and_repetitive_pages_take_linear_time():
    t = time.time()
    deep = "<div>" * 30000 + "<p>core</p>" + "</div>" * 30000
    assert texts(deep) == ["core"]
    many = "".join(f"<div><p>paragraph {i}</p><{'ul><li>a</ul' if i % 3 else 'b>x</b'}></div>" for i in range(20000))
    shape, blocks = wrappers.page_blocks(many)
    assert len(wrappers.preorder(shape)) < 20 and sum(t.startswith("paragraph") for _, t, _ in blocks) == 20000
    odd = "".join("<div>" + "<p>" * (i % 7) + f"t{i}" + "<ul><li>x</ul>" * (i % 11) + "<h2>h</h2><table><tr><td>c</table>" * (i % 5) + "</div>" for i in range(5000))
    shape, blocks = wrappers.page_blocks(odd)
    assert [t for _, t, _ in blocks if t[0] == "t"] == [f"t{i}" for i in range(5000)]
    assert len(texts("<a '" * 50000 + "<p>" + "<" * 100000 + "=\"" * 20000)) <= 1
    assert len(texts("<p>" + "word &amp; " * 1000000)[0]) == 7 * 1000000 - 1
    assert time.time() - t < 60


def plain_matching(a, b):
    if a[:2] != b[:2]:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), plain_matching(x[0], y[0]) + best(x[1:], y[1:]))

    return 1 + best(a[2], b[2])


def random_shape(rnd, depth=0):
    kids = tuple(random_shape(rnd, depth + 1) for _ in range(rnd.randint(0, 3 if depth < 3 else 0)))
    return rnd.choice(["div", "p"]) if depth else "#", rnd.choice(["", "c"]) if depth else "", tuple(dict.fromkeys(kids))


def test_tree_matching_merging_and_texts_of_shapes():
    rnd = random.Random(6)
    for _ in range(300):
        a, b, c = (random_shape(rnd) for _ in range(3))
        score, pairs = wrappers.matching(a, b, {})
        assert score == plain_matching(a, b) == 1 + sum(plain_matching(a[2][i], b[2][j]) for i, j in pairs)
        whole = wrappers.merged(wrappers.merged(a, b, {}), c, {})
        for s in (a, b, c):
            at = wrappers.aligned(whole, s)
            assert -1 not in at and len(set(at)) == len(at) == wrappers.matching(whole, s, {})[0]
            flat = wrappers.preorder(whole)
            assert [flat[i][0][:2] for i in at] == [x[:2] for x, _ in wrappers.preorder(s)]
        assert wrappers.loads(wrappers.dumps(whole)) == whole
    odd = ("#", 'q " \\ )(', (("p", "é ()", ()),))
    assert wrappers.loads(wrappers.dumps(odd)) == odd


def test_one_wrapper_for_a_host_of_many_shapes(spark):
    rnd = random.Random(1)
    made = [("a", wrappers.dumps(random_shape(rnd))) for _ in range(500)] + [("b", wrappers.dumps(("#", "", ())))]
    shapes = spark.createDataFrame(sorted(set(made)), "host string, shape string")
    wraps = {r.host: wrappers.loads(r.wrapper) for r in wrappers.wrappers(shapes).collect()}
    assert set(wraps) == {"a", "b"} and wraps["b"] == ("#", "", ())
    assert max(wrappers.matching(wraps["a"], wrappers.loads(s), {})[0] / len(wrappers.preorder(wrappers.loads(s))) for h, s in made if h == "a") == 1


SCHEMA = "page_id long, url string, html string, text string, host string, blocks int"


def extracted(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "h", 1) for r in rows], SCHEMA)
    return wrappers.main_text(df).collect()


def test_constant_blocks_are_template_and_varying_ones_content(spark):
    rnd = random.Random(9)

    def words(n):
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    def page(i, body):
        links = "".join(f"<a href=/{w}>{w}</a> " for w in words(4).split())
        return (f"<html><body><div>Our daily paper</div><div>{links}</div><div><h2>{body[0]}</h2>"
                + "".join(f"<p>{b}</p>" for b in body[1:]) + "<p>Read our terms of use before copying</p></div><div>All rights kept</div></body></html>")

    bodies = [[words(4)] + [words(30) for _ in range(rnd.randint(1, 4))] for _ in range(12)]
    rows = [(i, f"http://paper.example/{i}", page(i, b)) for i, b in enumerate(bodies)]
    copies = [(100 + i, "http://PAPER.example:80/copy", rows[3][2]) for i in range(50)]
    small = [(900 + i, f"https://u@small.example/{i}", page(i, b)) for i, b in enumerate(bodies[:3])]
    got = {r.key: r.text for r in extracted(spark, rows + copies + small)}
    for (i, *_), body in zip(rows, bodies):
        assert got[i] == "\n\n".join(body)
    assert all(got[i] == got[3] for i, *_ in copies)
    # too few pages to tell template from text: places and links alone decide
    assert all(got[900 + i].split("\n\n")[0] == "Our daily paper" and bodies[i][1] in got[900 + i] for i in range(3))


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, None, None), (1, None, "<p>a</p>"), (None, "x", "<p>b</p>"), (2, "http://h/", ""), (2, "http://h/", ""), (3, "http://h/", "<p>c</p>" * 200000)]
    got = sorted((r.key or 0, r.url or "", r.text) for r in extracted(spark, rows))
    assert got == [(0, "x", "b"), (1, "", ""), (1, "", "a"), (2, "http://h/", ""), (2, "http://h/", ""), (3, "http://h/", "\n\n".join("c" * 200000))]
    assert extracted(spark, []) == []
    path = scratch_path(spark, "pages")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/pages.parquet")
    assert registered.op11_wrapper_induction(spark, path).where(F.col("n_chars") >= 0).collect() == []
