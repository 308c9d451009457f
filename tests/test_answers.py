"""The keyed answer store: one answer per prompt, resumed runs, repeats."""

import pytest
from pyspark.sql import functions as F

from catalogflow.operators import completions as C
from catalogflow.operators.answers import AnswerStore, one_answer, prompt_hash
from catalogflow.session import scratch_path


def counting(folder):
    """A model that notes every prompt it is asked, and one that refuses some."""
    import os
    import uuid

    def model(prompts):
        for p in prompts:
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(p)
        return [None if p.startswith("hard") else p.upper() for p in prompts]
    return model


def asked(folder):
    import os
    out = []
    for name in os.listdir(folder):
        with open(os.path.join(folder, name)) as f:
            out.append(f.read())
    return sorted(out)


def test_two_answers_per_prompt_give_one_row(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", None), ("e", "z")], "k string, prompt string")
    h = lambda p: F.sha2(F.lit(p), 256)
    given = [("x", "late", 2, 0), ("x", None, 1, 0), ("x", "early", 1, 1), ("x", "early too", 1, 1), ("y", None, 1, 0), ("y", None, 3, 0), ("q", "no one", 1, 1)]
    answers = spark.createDataFrame(given, "p string, response string, run long, wave long").withColumn("prompt_hash", F.sha2("p", 256)).drop("p")
    got = sorted((r.k, r.response) for r in C.answered(rows, "k", "prompt", answers).collect())
    assert got == [("a", "early"), ("b", "early"), ("c", None), ("d", None), ("e", None)]
    # without an order, the least text; the table's order decides where it is named
    plain = answers.select("prompt_hash", "response")
    assert one_answer(plain).where(F.col("prompt_hash") == h("x")).first().response == "early"
    assert one_answer(answers.withColumn("rank", -F.col("run")), ("rank",)).where(F.col("prompt_hash") == h("x")).first().response == "late"
    plan = one_answer(answers)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan


def test_a_second_run_calls_nothing(spark, tmpdir_path):
    docs = spark.createDataFrame([(i, f"prompt {i % 40}" if i % 7 else None) for i in range(200)], "k long, prompt string")
    store = AnswerStore(spark, scratch_path(spark, "store-test"))
    kw = dict(store=store, parallelism=3, batch_size=4, first_wait=0.0)
    first = C.complete(docs, "k", "prompt", counting(tmpdir_path), **kw).collect()
    assert len(first) == 200 and {r.k: r.response for r in first} == {i: f"PROMPT {i % 40}" if i % 7 else None for i in range(200)}
    assert len(asked(tmpdir_path)) == len(set(asked(tmpdir_path))) == 40   # equal prompts once
    again = C.complete(docs, "k", "prompt", counting(tmpdir_path), **kw).collect()
    assert sorted(again) == sorted(first) and len(asked(tmpdir_path)) == 40
    more = docs.unionByName(spark.createDataFrame([(999, "prompt new")], "k long, prompt string"))
    C.complete(more, "k", "prompt", counting(tmpdir_path), **kw)
    assert len(asked(tmpdir_path)) == 41


def test_a_run_that_was_cut_off_goes_on(spark, tmpdir_path):
    docs = spark.createDataFrame([(f"p{i}",) for i in range(60)] + [("hard 1",), ("hard 2",)], "prompt string")
    store = AnswerStore(spark, scratch_path(spark, "store-test"))

    def dies(prompts):
        if any(p in ("p17", "p44") for p in prompts):
            raise MemoryError("the driver's machine is gone")
        return [None if p.startswith("hard") else p.upper() for p in prompts]

    with pytest.raises(Exception, match="gone"):
        store.ask(docs, "prompt", lambda: dies, parallelism=2, batch_size=2, wave_size=5)
    kept = store.rows().where("response is not null").count()      # the waves that were over are there, whole
    model = counting(tmpdir_path)
    n = store.ask(docs, "prompt", lambda: model, parallelism=2, batch_size=2, wave_size=50)
    assert n == 62 - kept and len(asked(tmpdir_path)) == n
    assert store.answers().where("response is null").count() == 2
    # what failed is asked again; a null answer never hides a real one
    assert store.ask(docs, "prompt", lambda: lambda ps: [p + "!" for p in ps], parallelism=2) == 2
    final = {r.prompt_hash: r.response for r in store.answers().collect()}
    want = {r.h: ("hard" in r.prompt and r.prompt + "!") or r.prompt.upper() for r in docs.select("prompt", prompt_hash("prompt").alias("h")).collect()}
    assert final == want and store.unanswered(docs).count() == 0


def test_products_of_equal_prompts_and_two_answers(spark):
    """Two products with one prompt, an answer table with two answers to it."""
    docs = spark.createDataFrame([("1", "Remedio 5mg", "same leaflet"), ("2", "Remedio 5mg", "same leaflet"), ("3", "Outro", "t")],
                                 "k string, name string, text string")
    t = C.default_templates()
    prompts = C.generate_prompts(docs, "k", "name", "text", t["page_generator"])
    page = '{"seo_title": "%s", "meta_description": "m", "html_content": "<h2>' + "x" * 60 + '</h2>"}'
    a = prompts.select(prompt_hash("prompt").alias("prompt_hash"), F.explode(F.array(F.lit(page % "one"), F.lit(page % "two"))).alias("response"))
    out = C.produce_content(docs, "k", "name", "text", a, target=0).collect()
    assert sorted((r.k, r.seo_title) for r in out) == [("1", "one"), ("2", "one"), ("3", "one")]
