"""Registered checks: completion stages and application compositions (G1-G6,
E1, E2, E5) as table jobs.

Answers come from a table (prompt hash -> response) that Spark derives from the
documents; what a document's answers say follows from its number, so the
oracles state the outcome directly, without prompts, hashes or JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import jsonx as J
from ..functions.text import has_text, normalize_key
from ..operators import completions as C
from ..operators.answers import AnswerStore, prompt_hash
from ..operators import enrich as E
from ..operators.keys import normalize_keys
from ..session import materialize, scratch_path
from . import app
from . import sqlfrag as Q
from .checks_html import _AUD_CTES, _DOC_TAGS, _SUM
from .checks_misc import std_requests
from .standin_html import _base_cols, page_html
from .standins import std_catalog, std_documents, std_items, std_reviews, table, with_ctes

GOOD_TITLE = " 50mg Casa Verde Norte do Vale caixa com 30 unidades"
GOOD_META = " 50mg - Casa Verde Norte: caixa de 30 unidades para a farmácia da família, com folheto claro e atendimento todo dia. Encontre na nossa loja."
PLAIN_PAGE = ("<h2>{b}: para que serve</h2><p>a</p><h2>Guia de como usar {b}</h2><p>b</p><h2>Casos de contraindicação</h2><p>c</p>"
              "<h2>Composição por unidade</h2><table><tr><td>Fabricante</td></tr><tr><td>Princípio Ativo</td></tr></table>")


def _fill(s: str):
    return F.concat(*[x for i, part in enumerate(s.split("{b}")) for x in ([F.col("b")] if i else []) + [F.lit(part)]])


def _products(spark, d):
    """One product per document with text, and what the model will answer for
    it.  Products of equal name and leaflet have equal prompts, so their answers
    are those of the least such document (number ``n``)."""
    docs = _base_cols(table(spark, d, "documents").where(has_text(F.col("text")) & F.col("doc_id").isNotNull()))
    ids = docs.select("doc_id", F.sha2(F.concat_ws("|", "product_name", "text"), 256).alias("same"))
    least = ids.groupBy("same").agg(F.min("doc_id").alias("n"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    # numbers are stored, texts and answers made anew where they are read
    later = materialize(ids.join(least, "same").where("doc_id <> n").select(F.col("doc_id").alias("later_id"), "n"), "later")
    h = docs.join(later, F.col("doc_id") == F.col("later_id"), "left").withColumn("n", F.coalesce("n", "doc_id"))
    h = h.withColumn("html", page_html(F.col("n")))
    N = F.col("n")  # noqa: N806
    title = F.concat(F.col("b"), F.lit(GOOD_TITLE))
    meta = F.concat(F.col("b"), F.lit(GOOD_META))
    first = F.to_json(F.struct(F.when(N % 2 == 0, title).otherwise(F.col("b")).alias("seo_title"),
                               F.when(N % 3 != 0, meta).otherwise(F.lit("x")).alias("meta_description"),
                               F.when(N % 10 == 7, F.lit("<p>short</p>")).otherwise(F.col("html")).alias("html_content")))
    better = F.to_json(F.struct(title.alias("seo_title"), meta.alias("meta_description"), _fill(PLAIN_PAGE).alias("html_content")))
    return h.select(
        "doc_id", F.col("doc_id").cast("string").alias("doc_key"), "product_name", F.col("text").alias("leaflet_text"), "n",
        F.when(N % 10 == 9, F.lit(None)).when(N % 10 == 8, F.lit('{"error": "client failed"}'))
         .when(N % 10 == 6, F.concat(F.lit("Here it is: "), first))
         .otherwise(F.concat(F.lit("```json\n"), first, F.lit("\n```"))).alias("a1"),
        F.when(N % 4 != 0, F.concat(F.lit("```json\n"), better, F.lit("\n```"))).alias("a2"),
        F.when(N % 4 != 0, _fill(PLAIN_PAGE)).otherwise(F.lit("<p>x</p>")).alias("a3"))


def _answers(rows, prompt, col, repeats=True, hashed=False):
    """(prompt_hash, response, run, wave) for the prompts of those rows: the
    answer of the first run, and a later one that must not count for every prompt
    whose hash begins with 0 to 3.  A null answer has no row.  Without ``repeats``
    no two rows have the same prompt."""
    given = rows.select((F.col(prompt) if hashed else prompt_hash(prompt)).alias("prompt_hash"), F.col(col).alias("response")).where("response is not null")
    if repeats:
        given = given.groupBy("prompt_hash").agg(F.min("response").alias("response"))
    again = F.when(F.col("prompt_hash") < "4", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = given.select("prompt_hash", "response", F.explode(again).alias("run")).withColumn("run", F.col("run").cast("long"))
    return rows.select("prompt_hash", F.when(F.col("run") == 1, F.col("response")).otherwise(F.lit("a later answer")).alias("response"),
                       "run", F.lit(0).cast("long").alias("wave"))


IDS = ("doc_key", "product_name", "leaflet_text")


def _first_answers(p, t):
    """Answers to the first attempt.  Products of equal prompts have the same
    number ``n``, so the one that bears it stands for them."""
    return _answers(p.where("doc_id = n"), C.generate_prompt("product_name", "leaflet_text", t["page_generator"]), "a1", repeats=False)


def _generated(spark, d):
    """(templates, products, answers of the first attempt stored, generated and audited products)."""
    t, p = C.default_templates(), _products(spark, d)
    r1 = materialize(_first_answers(p, t), "answers1", "zstd")
    rows = p.select(*IDS, "a2", "a3")
    return t, p, r1, C.audit(C.generate(rows, *IDS, r1, t["page_generator"]), name="product_name")


def _stored(g):
    # scored once: a filter on the score would run the scorer again beside it
    return materialize(g, "generated", "zstd")


def _failing(g):
    return g.where(F.col("content").isNotNull() & (F.col("audit.seo_score") < 95))


def completions_q(spark, d):
    t, p = C.default_templates(), _products(spark, d)
    prompts = C.generate_prompts(p, *IDS, t["page_generator"])
    out = C.complete(prompts, "doc_key", "prompt", _first_answers(p, t))
    err = J.json_error(J.extract_json_text("response")).isNotNull()
    return out.select("doc_key", F.col("response").isNotNull().alias("answered"), F.coalesce(err, F.lit(False)).alias("failed"))


def answer_store_q(spark, d):
    """Every document's prompt answered over three runs of one store: the first
    was cut off (it saw one document in three) and got no answer to some, the
    second asks what is left, the third finds nothing to ask."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"))
    store = AnswerStore(spark, scratch_path(spark, "answer-store"))
    ask = lambda rows, fn: store.ask(rows, "prompt", lambda: fn, parallelism=4, wave_size=20_000)
    n1 = ask(docs.where(F.col("doc_id") % 3 == 0), lambda prompts: [f"1:{len(p)}" if len(p) % 5 else None for p in prompts])
    n2 = ask(docs, lambda prompts: [f"2:{len(p)}" for p in prompts])
    n3 = ask(docs, lambda prompts: [f"3:{len(p)}" for p in prompts])
    out = C.answered(docs, "doc_id", "prompt", store.rows())
    return out.select("doc_id", "response", *[F.lit(n).cast("long").alias(f"asked_{i}") for i, n in enumerate((n1, n2, n3), 1)])


def generate_stage_q(spark, d):
    g = _generated(spark, d)[3]
    return g.select("doc_key", F.col("content.seo_title").alias("seo_title"), F.col("audit.seo_score").alias("score"))


def _refined_answers(failing, t):
    return _answers(failing, C.refine_prompt("product_name", "leaflet_text", t["quality_refiner"]), "a2")


def refine_stage_q(spark, d):
    t, p, _, g = _generated(spark, d)
    failing = _failing(_stored(g.drop("a3"))).select(*IDS, "a2", "content", "audit")
    r = C.audit(C.refine(failing.drop("a2"), *IDS, _refined_answers(failing, t), t["quality_refiner"]), name="product_name")
    return r.select("doc_key", F.col("content.seo_title").alias("seo_title"), F.col("audit.seo_score").alias("score"))


def _unwritten(g):
    """Every generated product with its audit, stored; a text and the answer to the
    plain prompt stay only with the products that got no content, which alone are
    asked again, and pages are not kept."""
    none = F.col("content").isNull()
    return _stored(g.select("doc_key", "product_name", *[F.when(none, F.col(c)).alias(c) for c in ("leaflet_text", "a3")],
                            none.alias("empty"), "audit"))


def fallback_stage_q(spark, d):
    t, p, _, g = _generated(spark, d)
    empty = _unwritten(g).where("empty").select(*IDS, "a3")
    r3 = _answers(empty, C.fallback_prompt("product_name", "leaflet_text", t["essentials_fallback"]), "a3")
    fb = C.audit(C.fallback(empty.drop("a3"), *IDS, r3, t["essentials_fallback"]), name="product_name")
    return fb.select("doc_key", F.col("content.html_content").alias("html_content"),
                     F.col("content.seo_title").alias("seo_title"), F.col("audit.seo_score").alias("score"))


def produce_content_q(spark, d):
    t, p, r1, g = _generated(spark, d)
    r2 = _refined_answers(_failing(_stored(g.drop("a3"))), t)
    r3 = _answers(p, C.fallback_prompt("product_name", "leaflet_text", t["essentials_fallback"]), "a3")
    more = materialize(r2.unionByName(r3), "answers2", "zstd")
    out = C.produce_content(p, *IDS, r1.unionByName(more))
    return out.select("doc_key", "final_score", "seo_title", F.md5("final_content").alias("content_md5"), "attempts_run", "path")


def _ready_answers(ready, key, name, text="leaflet_text", keywords=None):
    """First answers for products of a sheet: a plain page for two in three,
    none for the rest, whose fallback answer is the same page.  Equal prompts
    get equal answers, so name and text decide."""
    t = C.default_templates()
    named = ready.withColumn("b", H.base_name(name)).withColumn("_n", F.conv(F.substring(F.md5(
        F.concat(F.col(name), F.md5(F.col(text)))), 1, 4), 16, 10).cast("int") % 3)
    page = F.to_json(F.struct(F.concat(F.col("b"), F.lit(GOOD_TITLE)).alias("seo_title"),
                              F.concat(F.col("b"), F.lit(GOOD_META)).alias("meta_description"), _fill(PLAIN_PAGE).alias("html_content")))
    # texts are read once: hashes and pages are stored, prompts are not
    made = materialize(named.select(
        F.when(F.col("_n") > 0, page).alias("a1"), _fill(PLAIN_PAGE).alias("a3"),
        prompt_hash(C.generate_prompt(name, text, t["page_generator"], keywords)).alias("h1"),
        prompt_hash(C.fallback_prompt(name, text, t["essentials_fallback"])).alias("h3")), "made-answers", "zstd")
    return materialize(_answers(made, "h1", "a1", hashed=True).unionByName(_answers(made, "h3", "a3", hashed=True)), "answers", "zstd")


def batch_draft_q(spark, d):
    """Which items get a page, and which of the two kinds; written as a draft and reread (K1)."""
    items, cat, docs = std_items(spark, d), std_catalog(spark, d), std_documents(spark, d)
    # the answers are those to the draft's own products: routed once, for both
    products = ready, texts = app.draft_products(items, cat, docs)
    answers = _ready_answers(ready.join(texts, "cat_leaflet_link"), "item_key", "product_name")
    draft = app.build_draft(items, cat, docs, answers, products=products)
    from ..sinks.files import write_sheet
    path = write_sheet(draft, scratch_path(spark, "draft"), "draft", "run1", require_rows=F.col("html_content").isNotNull())
    back = spark.read.parquet(path)
    return back.select("input_seq", "item_key", F.col("html_content").isNotNull().alias("has_page"),
                       F.col("seo_title").like("%Para que serve%").alias("is_fallback"))


def _sheet(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("sku"), F.col("o_orderkey").alias("input_seq"),
                                            F.col("o_orderpriority").alias("product_name")).where(F.col("sku") % 11 != 0)


def review_set_pairs_q(spark, d):
    p = app.review_pairs(_sheet(spark, d), std_requests(spark, d), std_documents(spark, d), "g")
    return p.select("g", "pos", "sku", "doc", "input_seq", "product_name", "keywords", "route", F.md5("leaflet_text").alias("text_md5"))


def review_set_q(spark, d):
    sheet, req, docs = _sheet(spark, d), std_requests(spark, d), std_documents(spark, d)
    p = app.review_products(app.routed_pairs(sheet, req, docs, "g")).join(app.document_texts(docs, "doc"), "doc")
    answers = _ready_answers(p, "product", "product_name", keywords="keywords")
    out = app.review_set(sheet, req, docs, answers, "g")
    return out.select("g", "pos", "sku", "doc", "route", F.col("html_content").isNotNull().alias("has_page"),
                      F.col("seo_title").like("%Para que serve%").alias("is_fallback"))


def reprocess_queue_q(spark, d):
    q = app.reprocess_queue(std_reviews(spark, d), std_catalog(spark, d), std_documents(spark, d))
    return q.select("item_key", "leaflet_link", "catalog_seq", F.length("doc_text").cast("bigint").alias("text_chars"))


def reprocess_q(spark, d):
    names = normalize_keys(std_items(spark, d).select("item_key", "product_name"), "item_key")
    names = names.groupBy("item_key").agg(F.min("product_name").alias("product_name"))
    ev, cat, docs = std_reviews(spark, d), std_catalog(spark, d), std_documents(spark, d)
    q = app.reprocess_queue(ev, cat, docs).where(has_text(F.col("doc_text")))
    q = q.join(names.withColumnRenamed("item_key", "_nk"), F.col("item_key") == F.col("_nk"), "left")
    q = q.select("item_key", F.coalesce("product_name", "item_key").alias("product_name"), F.col("doc_text").alias("leaflet_text"))
    out = app.reprocess(ev, cat, docs, names, _ready_answers(q, "item_key", "product_name"))
    return out.select("item_key", "product_name", "status", F.col("frame").startswith("event: done").alias("is_done"))


QUERIES = {
    "completions": completions_q,
    "answer_store": answer_store_q,
    "generate_stage": generate_stage_q,
    "refine_stage": refine_stage_q,
    "fallback_stage": fallback_stage_q,
    "produce_content": produce_content_q,
    "batch_draft": batch_draft_q,
    "review_set_pairs": review_set_pairs_q,
    "review_set": review_set_q,
    "reprocess_queue": reprocess_queue_q,
    "reprocess": reprocess_q,
}

_P = f"""p AS (SELECT h.doc_id, CAST(h.doc_id AS VARCHAR) AS doc_key, h.product_name, h.b, min(h.doc_id) OVER w AS n,
    first_value(h.html) OVER (PARTITION BY h.product_name, o.text ORDER BY h.doc_id) AS html,
    first_value(h.plain) OVER (PARTITION BY h.product_name, o.text ORDER BY h.doc_id) AS plain
  FROM made_html h JOIN documents o ON h.doc_id = o.doc_id WHERE {Q.blank_to_null('o.text')} IS NOT NULL
  WINDOW w AS (PARTITION BY h.product_name, o.text)),
g1 AS (SELECT *, CASE WHEN n % 10 = 7 THEN '<p>short</p>' ELSE html END AS h1,
    CASE WHEN n % 10 = 7 THEN '<p>short</p>' ELSE plain END AS plain1 FROM p),
g2 AS (SELECT *, n % 10 NOT IN (8, 9) AND coalesce(length(h1) > 50, false) AS ok FROM g1)"""
_PAGE_SQL = " || ".join(x for i, part in enumerate(PLAIN_PAGE.split("{b}")) for x in (["b"] if i else []) + [Q.lit(part)])
_GEN = f"""made_content AS (SELECT doc_id, n, doc_key, product_name, b, ok,
    CASE WHEN ok THEN CASE WHEN n % 2 = 0 THEN b || {Q.lit(GOOD_TITLE)} ELSE b END END AS seo_title,
    CASE WHEN ok THEN CASE WHEN n % 3 <> 0 THEN b || {Q.lit(GOOD_META)} ELSE 'x' END END AS meta_description,
    CASE WHEN ok THEN h1 END AS html_content, CASE WHEN ok THEN plain1 END AS plain FROM g2)"""


def _again(n: int, source: str) -> str:
    """The audit's CTEs over another table."""
    out = _AUD_CTES
    for old, new in (("cm AS (", f"cm{n} AS ("), ("FROM made_content", f"FROM {source}"), ("cmt AS (", f"cmt{n} AS ("),
                     ("FROM cm)", f"FROM cm{n})"), ("aud AS (", f"aud{n} AS ("), ("FROM cmt)", f"FROM cmt{n})")):
        out = out.replace(old, new)
    return out


def _score(a: str) -> str:
    return f"CAST(CASE WHEN {a}.none THEN 0 ELSE {_SUM} END AS DOUBLE)"


_S1 = f"{_P}, {_GEN}, {_AUD_CTES}, s1 AS (SELECT doc_id, {_score('aud')} AS score FROM aud)"
_S2 = _S1 + f""", second AS (SELECT m.doc_id, m.doc_key, m.product_name, m.b,
    CASE WHEN m.n % 4 <> 0 THEN b || {Q.lit(GOOD_TITLE)} ELSE seo_title END AS seo_title,
    CASE WHEN m.n % 4 <> 0 THEN b || {Q.lit(GOOD_META)} ELSE meta_description END AS meta_description,
    CASE WHEN m.n % 4 <> 0 THEN {_PAGE_SQL} ELSE html_content END AS html_content,
    CASE WHEN m.n % 4 <> 0 THEN {_PAGE_SQL} ELSE plain END AS plain
  FROM made_content m JOIN s1 USING (doc_id) WHERE ok AND score < 95), {_again(2, 'second')},
s2 AS (SELECT doc_id, {_score('aud2')} AS score FROM aud2)"""
_S3 = f"""third AS (SELECT doc_id, doc_key, product_name, {Q.lit(J.FALLBACK_TITLE.split('%s')[0])} || product_name
      || {Q.lit(J.FALLBACK_TITLE.split('%s')[1])} AS seo_title,
    {Q.lit(J.FALLBACK_DESCRIPTION.split('%s')[0])} || product_name || {Q.lit(J.FALLBACK_DESCRIPTION.split('%s')[1])} AS meta_description,
    CASE WHEN n % 4 <> 0 THEN {_PAGE_SQL} ELSE {Q.lit(J.FALLBACK_HTML_ERROR)} END AS html_content,
    CASE WHEN n % 4 <> 0 THEN {_PAGE_SQL} ELSE {Q.lit(J.FALLBACK_HTML_ERROR)} END AS plain
  FROM made_content WHERE NOT ok), {_again(3, 'third')}, s3 AS (SELECT doc_id, {_score('aud3')} AS score FROM aud3)"""
_CLEAN = Q.ustrip(Q.rx_replace(Q.clean_fences("html_content"), _DOC_TAGS))
_WRAP = f"md5(chr(10) || '<div class=\"product-description\">' || chr(10) || {_CLEAN} || chr(10) || '</div>')"

_READY = f"""ni AS (SELECT input_seq, {Q.norm_key('item_key')} AS item_key, product_name FROM std_items),
fc AS (SELECT {Q.norm_key('barcode')} AS barcode, leaflet_link, link_valid FROM std_catalog
       WHERE {Q.norm_key('barcode')} IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY {Q.norm_key('barcode')} ORDER BY catalog_seq) = 1),
nd AS (SELECT doc_key, first(text ORDER BY doc_seq) AS doc_text FROM std_documents GROUP BY doc_key),
ready AS (SELECT ni.item_key, first(ni.product_name ORDER BY ni.input_seq) AS product_name, any_value(nd.doc_text) AS doc_text FROM ni JOIN fc ON ni.item_key = fc.barcode JOIN nd ON fc.leaflet_link = nd.doc_key
          WHERE {Q.flag_is('fc.link_valid')} AND {Q.blank_to_null('nd.doc_text')} IS NOT NULL GROUP BY 1)"""
_PAIRS = f"""x AS (SELECT CAST(o_orderkey // 100 AS BIGINT) AS g,
    CAST(row_number() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) - 1 AS INTEGER) AS pos,
    o_custkey AS sku, CAST(o_orderkey % (SELECT count(*) FROM documents) AS VARCHAR) AS doc FROM orders),
f AS (SELECT o_custkey AS sku, o_orderkey AS input_seq, o_orderpriority AS product_name FROM orders WHERE o_custkey % 11 <> 0
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
nd AS (SELECT doc_key, first(text ORDER BY doc_seq) AS doc_text FROM std_documents GROUP BY doc_key),
pr AS (SELECT x.g, x.pos, x.sku, x.doc, f.input_seq, f.product_name, {Q.lit(J.DEFAULT_KEYWORDS)} AS keywords,
         CASE WHEN f.sku IS NULL THEN 'unknown_sku' WHEN {Q.blank_to_null('nd.doc_text')} IS NULL THEN 'empty_text' ELSE 'ready' END AS route,
         md5(nd.doc_text) AS text_md5
       FROM x LEFT JOIN f ON x.sku = f.sku LEFT JOIN nd ON x.doc = nd.doc_key)"""



def _kind(name: str, text_md5: str) -> str:
    """The remainder that decides which answer a product gets."""
    return f"(CAST('0x' || substr(md5({name} || {text_md5}), 1, 4) AS INTEGER) % 3)"


ORACLE = {
    "batch_draft": with_ctes(f"""
SELECT ni.input_seq, ni.item_key, ready.item_key IS NOT NULL AS has_page,
  CASE WHEN ready.item_key IS NOT NULL THEN {_kind('ready.product_name', 'md5(ready.doc_text)')} = 0 WHEN i.seo_title IS NOT NULL THEN false END AS is_fallback
FROM ni JOIN std_items i ON ni.input_seq = i.input_seq LEFT JOIN ready ON ni.item_key = ready.item_key
WHERE ni.item_key IS NOT NULL""", "std_items", "std_catalog", "std_documents", ctes=_READY),
    "review_set": with_ctes(f"""
SELECT g, pos, sku, doc, route, route = 'ready' AS has_page,
  CASE WHEN route = 'ready' THEN {_kind('product_name', 'text_md5')} = 0 END AS is_fallback FROM pr""",
                            "std_documents", ctes=_PAIRS),
    "reprocess": with_ctes(f"""
SELECT {Q.norm_key('l.item_key')} AS item_key, coalesce(n.product_name, {Q.norm_key('l.item_key')}) AS product_name,
  'pending' AS status, true AS is_done
FROM (SELECT * FROM std_reviews QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY ts DESC, seq DESC) = 1) l
JOIN fc ON {Q.norm_key('l.item_key')} = fc.barcode JOIN nd ON fc.leaflet_link = nd.doc_key
LEFT JOIN (SELECT item_key, min(product_name) AS product_name FROM ni GROUP BY 1) n ON n.item_key = {Q.norm_key('l.item_key')}
WHERE l.status = 'disapproved' AND {Q.blank_to_null('nd.doc_text')} IS NOT NULL""",
                           "std_items", "std_catalog", "std_documents", "std_reviews", ctes=_READY),
    "completions": with_ctes("SELECT doc_key, n % 10 <> 9 AS answered, n % 10 = 8 AS failed FROM p", "made_html", ctes=_P),
    "answer_store": """
WITH t AS (SELECT text, length(text) AS n, bool_or(doc_id % 3 = 0) AS early FROM documents WHERE text IS NOT NULL GROUP BY text),
c AS (SELECT count(*) FILTER (WHERE early) AS asked_1, count(*) FILTER (WHERE NOT early OR n % 5 = 0) AS asked_2 FROM t)
SELECT doc_id, CASE WHEN early AND n % 5 <> 0 THEN '1:' || n WHEN n IS NOT NULL THEN '2:' || n END AS response,
       asked_1, asked_2, CAST(0 AS BIGINT) AS asked_3
FROM documents LEFT JOIN t USING (text), c""",
    "generate_stage": with_ctes("SELECT doc_key, seo_title, score FROM made_content JOIN s1 USING (doc_id)", "made_html", ctes=_S1),
    "refine_stage": with_ctes("SELECT doc_key, seo_title, score FROM second JOIN s2 USING (doc_id)", "made_html", ctes=_S2),
    "fallback_stage": with_ctes("SELECT doc_key, html_content, seo_title, score FROM third JOIN s3 USING (doc_id)",
                                "made_html", ctes=f"{_P}, {_GEN}, {_S3}"),
    "produce_content": with_ctes(f"""
SELECT doc_key, score AS final_score, seo_title, {_WRAP} AS content_md5, 1 AS attempts_run, 'generated' AS path
FROM made_content JOIN s1 USING (doc_id) WHERE ok AND score >= 95
UNION ALL SELECT doc_key, score, seo_title, {_WRAP}, 2, 'refined' FROM second JOIN s2 USING (doc_id)
UNION ALL SELECT doc_key, score, seo_title, {_WRAP}, 1, 'fallback' FROM third JOIN s3 USING (doc_id)""",
                                 "made_html", ctes=f"{_S2}, {_S3}"),
    "review_set_pairs": with_ctes("SELECT * FROM pr", "std_documents", ctes=_PAIRS),
    "reprocess_queue": with_ctes(f"""
SELECT l.item_key, f.leaflet_link, f.catalog_seq, length(nd.doc_text) AS text_chars
FROM (SELECT * FROM std_reviews QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY ts DESC, seq DESC) = 1) l
JOIN (SELECT * FROM (SELECT {Q.norm_key('barcode')} AS barcode, leaflet_link, catalog_seq FROM std_catalog)
      WHERE barcode IS NOT NULL QUALIFY row_number() OVER (PARTITION BY barcode ORDER BY catalog_seq) = 1) f
  ON {Q.norm_key('l.item_key')} = f.barcode
LEFT JOIN (SELECT doc_key, first(text ORDER BY doc_seq) AS doc_text FROM std_documents GROUP BY doc_key) nd ON f.leaflet_link = nd.doc_key
WHERE l.status = 'disapproved'""", "std_reviews", "std_catalog", "std_documents"),
}
