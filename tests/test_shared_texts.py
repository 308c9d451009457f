"""Documents that many products share: texts meet the rows that ask for them and
are neither stored nor shuffled per product (F1, F3, F5-F8)."""

from pyspark.sql import functions as F

from catalogflow.operators import completions as C
from catalogflow.operators.answers import one_answer, prompt_hash
from catalogflow.plans import app

PAGE = '{"seo_title": "T", "meta_description": "M", "html_content": "<h2>%s</h2><p>a page that is longer than fifty characters</p>"}'


def _products(spark):
    docs = spark.createDataFrame([("d1", "leaflet one"), ("d2", "leaflet two")], "doc string, leaflet_text string")
    rows = spark.createDataFrame([(f"k{i}", f"Name {i % 3}", f"d{i % 2 + 1}") for i in range(6)], "k string, name string, doc string")
    return rows, docs


def _answers(spark, rows, docs):
    t = C.default_templates()
    full = rows.join(docs, "doc")
    first = full.where("k <> 'k1'").select(prompt_hash(C.generate_prompt("name", "leaflet_text", t["page_generator"])).alias("prompt_hash"),
                                           F.lit(PAGE % "x").alias("response"))
    plain = full.select(prompt_hash(C.fallback_prompt("name", "leaflet_text", t["essentials_fallback"])).alias("prompt_hash"),
                        F.lit("<p>a plain page of some length</p>").alias("response"))
    return first.unionByName(plain)


def test_linked_texts_give_the_same_content(spark):
    rows, docs = _products(spark)
    answers = _answers(spark, rows, docs)
    a = C.produce_content(rows.join(docs, "doc"), "k", "name", "leaflet_text", answers)
    b = C.produce_content(rows, "k", "name", "leaflet_text", answers, texts=docs, link="doc")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert {r.k: r.path for r in b.collect()}["k1"] == "fallback" and b.count() == 6


def test_generate_joins_answers_once_and_shuffles_no_unused_text(spark):
    rows, docs = _products(spark)
    t = C.default_templates()
    full = rows.join(docs, "doc").select("k", "name", "leaflet_text").localCheckpoint()
    g = C.generate(full, "k", "name", "leaflet_text", _answers(spark, rows, docs).localCheckpoint(), t["page_generator"]).select("k", "content")
    plan = g._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    join = g._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert join.size() == 2
    got = {r.k: r.content for r in g.collect()}
    assert got["k1"] is None and got["k0"].seo_title == "T"


def test_review_products_are_made_once_per_name_and_document(spark):
    sheet = spark.createDataFrame([(s, s, f"Name {s % 2}") for s in range(6)], "sku long, input_seq long, product_name string")
    docs = spark.createDataFrame([("d", "leaflet", 1), ("d", "a later one", 2), ("e", " ", 3)], "doc_key string, text string, doc_seq long")
    req = spark.createDataFrame([(1, [0, 1, 2, 3, 9, 4], ["d", "d", "d", "d", "d", "e"])], "g long, skus array<long>, docs array<string>")
    pairs = app.routed_pairs(sheet, req, docs, "g")
    assert "leaflet_text" not in pairs.columns
    assert [r.route for r in pairs.orderBy("pos").collect()] == ["ready"] * 4 + ["unknown_sku", "empty_text"]
    made = app.review_products(pairs).orderBy("product_name").collect()
    assert [(r.product_name, r.doc) for r in made] == [("Name 0", "d"), ("Name 1", "d")]
    asked = []

    def model(prompts):
        asked.extend(prompts)
        return [PAGE % "x" if p.startswith("TASK") else None for p in prompts]

    out = app.review_set(sheet, req, docs, model, "g", parallelism=1, target=0).orderBy("pos").collect()
    assert [r.html_content is not None for r in out] == [True] * 4 + [False] * 2
    texts = {r.leaflet_text for r in app.review_pairs(sheet, req, docs, "g").where("route = 'ready'").collect()}
    assert texts == {"leaflet"}


def test_one_answer_keeps_its_order(spark):
    df = spark.createDataFrame([("h", None, 1, 0), ("h", "b", 2, 0), ("h", "a", 2, 1), ("n", None, 1, 0), (None, "x", 1, 0)],
                               "prompt_hash string, response string, run long, wave long")
    assert {r.prompt_hash: r.response for r in one_answer(df).collect()} == {"h": "b", "n": None}


def test_fallback_stage_stores_texts_of_unwritten_products_only(spark):
    from catalogflow.plans import checks_generation as G
    page = "struct<seo_title:string,meta_description:string,html_content:string>"
    g = spark.createDataFrame([("k1", "Name", "leaflet one", "a2", "a3", None, {"seo_score": 0.0}),
                               ("k2", "Name", "leaflet two", "a2", "a3", ("T", "M", "<p>page</p>"), {"seo_score": 40.0})],
                              f"doc_key string, product_name string, leaflet_text string, a2 string, a3 string, content {page}, audit struct<seo_score:double>")
    stored = G._unwritten(g)
    got = {r.doc_key: r for r in stored.collect()}
    assert "content" not in stored.columns and got["k2"].leaflet_text is None and got["k2"].a3 is None
    assert (got["k1"].leaflet_text, got["k1"].a3, got["k1"].empty, got["k2"].empty) == ("leaflet one", "a3", True, False)
    assert got["k2"].audit.seo_score == 40.0        # every product is audited, whether it is asked again or not


def _sheet(spark):
    items = spark.createDataFrame([(1, " 7 ", "Name a"), (2, "7.0", "Name b"), (3, "8", "Name c"), (4, "9", "Name d"), (5, "7", "Name e"),
                                   (6, " \t", "Name f"), (7, None, "Name g")], "input_seq long, item_key string, product_name string")
    items = items.selectExpr("*", "CAST(NULL AS STRING) AS seo_title", "CAST(NULL AS STRING) AS meta_description",
                             "CAST(NULL AS STRING) AS html_content")
    cat = spark.createDataFrame([("7", "d1", "sim", 1), (" 7", "d2", "sim", 2), ("8", "d2", "sim", 3), ("9", "d3", "sim", 4)],
                                "barcode string, leaflet_link string, link_valid string, catalog_seq long")
    docs = spark.createDataFrame([("d1", "leaflet one", 1), ("d1", "a later one", 2), ("d2", "leaflet two", 3), ("d3", " ", 4), ("d4", "of no item", 5)],
                                 "doc_key string, text string, doc_seq long")
    return items, cat, docs


def test_draft_routes_a_key_once_and_keeps_linked_texts_only(spark, monkeypatch):
    items, cat, docs = _sheet(spark)
    routed, route = [], app.E.route_items
    monkeypatch.setattr(app.E, "route_items", lambda rows, *a, **kw: routed.append(rows) or route(rows, *a, **kw))
    ready = app.ready_items(items, cat, docs).orderBy("item_key").collect()
    assert [(r.input_seq, r.item_key, r.product_name, r.cat_leaflet_link) for r in ready] == [(1, "7", "Name a", "d1"), (3, "8", "Name c", "d2")]
    assert sorted(r.item_key for r in routed[0].collect()) == ["7", "8", "9"]
    twice = app.ready_items(items, cat, docs, dedupe_catalog=False).collect()
    assert sorted((r.input_seq, r.item_key) for r in twice) == [(1, "7"), (3, "8")]
    products, texts = app.draft_products(items, cat, docs)
    assert products.count() == 2 and {(r.cat_leaflet_link, r.leaflet_text) for r in texts.collect()} == {("d1", "leaflet one"), ("d2", "leaflet two")}


def test_draft_from_products_at_hand_is_the_same(spark):
    items, cat, docs = _sheet(spark)
    model = lambda prompts: [PAGE % "x" if p.startswith("TASK") else None for p in prompts]
    products = app.draft_products(items, cat, docs)
    a, b = (app.build_draft(items, cat, docs, model, products=p, parallelism=1, target=0).orderBy("input_seq").collect() for p in (None, products))
    assert a == b and [(r.input_seq, r.html_content is not None) for r in a] == [(1, True), (2, True), (3, True), (4, False), (5, True)]


def test_normalising_evaluates_the_rule_once_per_row(spark):
    from catalogflow.operators.keys import normalize_keys
    df = spark.createDataFrame([(" 7.0 ",), ("　\u001c",), ("",), (None,), (".0",), ("0.0",)], "k string")
    out = normalize_keys(df, "k")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    assert [r.k for r in out.collect()] == ["7", ".0", "0"]
    assert [r.k for r in normalize_keys(df, "k", drop_null=False).collect()] == ["7", None, None, None, ".0", "0"]
