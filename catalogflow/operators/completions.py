"""Batch completion stages: prompts -> model text as a Spark job.

The model is a plug-in ``completion_fn(list[str]) -> list[str | None]``
(or a zero-argument ``client_factory`` returning one, built once per Python
worker partition).  Spark owns batching, parallelism (``parallelism``
partitions = concurrent callers) and retries:

* transient errors (``TransientError`` or the types given) are retried up to
  ``max_tries`` with a doubling wait capped at ``max_wait``;
* any other error gives null for the prompt.

Model output is non-deterministic and costly, so answers go to a keyed store
(``answers.AnswerStore``) and are read from there; neither a lost executor nor a
lost driver makes Spark pay for an answer again.  Only prompts cross into
Python, each once; answers join back on the prompt's hash.
"""

from __future__ import annotations

import os
import time
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions.html import base_name, wrap_fragment
from ..functions.prompts import render
from ..session import materialize, scratch_path
from .answers import AnswerStore, one_answer, prompt_hash
from .attempts import select_attempt
from .audit import audit_content


class TransientError(Exception):
    """Raised by a model client for rate limits / overload (retryable)."""


TEMPLATE_DIR = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "templates")
CONTENT_SCHEMA = "seo_title string, meta_description string, html_content string"


def default_templates() -> dict[str, str]:
    """The packaged template set (driver-side, a handful of small files)."""
    import yaml
    out = {}
    for fn in sorted(os.listdir(TEMPLATE_DIR)):
        if fn.endswith((".yaml", ".yml")):
            with open(os.path.join(TEMPLATE_DIR, fn), encoding="utf-8") as f:
                data = yaml.safe_load(f)
            out[os.path.splitext(fn)[0]] = data["template"]
    return out


def call_with_retries(fn: Callable, prompts: list, max_tries: int = 5, first_wait: float = 2.0,
                      max_wait: float = 60.0, transient=(TransientError,), sleep=time.sleep) -> list:
    """One batch call with the retry policy.  A batch that fails for good, or
    stays transient for ``max_tries`` calls, is asked prompt by prompt (each
    with tries of its own), so a prompt's answer does not depend on its company."""
    wait = first_wait
    for attempt in range(max_tries):
        try:
            out = list(fn(prompts))
            if len(out) != len(prompts):
                raise ValueError("completion_fn returned a different number of answers")
            return out
        except transient:
            if attempt < max_tries - 1:
                sleep(wait)
                wait = min(wait * 2, max_wait)
        except Exception:  # noqa: BLE001
            break
    if len(prompts) == 1:
        return [None]
    return [call_with_retries(fn, [p], max_tries, first_wait, max_wait, transient, sleep)[0] for p in prompts]


def answered(df: DataFrame, key: str, prompt_col: str, responses: DataFrame, out_col: str = "response",
             carry: tuple = ()) -> DataFrame:
    """G1 from a table of given answers: (prompt_hash, response), joined on the
    prompt's SHA-256.  Prompts stay where they are rendered; only key, hash and
    the columns of ``carry`` that are used later are shuffled.  One row per row of
    ``df``: of repeated answers to a prompt the first counts (``one_answer``), a
    prompt without an answer has a null response."""
    asked = df.select(F.col(key), *carry, prompt_hash(prompt_col).alias("_hash"))
    given = one_answer(responses).select(F.col("prompt_hash").alias("_h"), F.col("response").alias(out_col))
    return asked.join(given, F.col("_hash") == F.col("_h"), "left").select(key, *carry, out_col)


def complete(df: DataFrame, key: str, prompt_col: str, completion_fn: Callable | DataFrame | None = None,
             client_factory: Callable | None = None, out_col: str = "response", batch_size: int = 16,
             parallelism: int | None = None, max_tries: int = 5, first_wait: float = 2.0,
             max_wait: float = 60.0, transient=(TransientError,), store: AnswerStore | None = None,
             name: str = "completions", carry: tuple = ()) -> DataFrame:
    """G1: (key, prompt) -> (key, response), with the columns ``carry``.  Null
    prompts are not sent, equal prompts are sent once.

    ``completion_fn`` may be a table of answers instead (see ``answered``).
    ``store`` keeps the answers: a run that finds them there calls nothing, and
    one that was cut off goes on where it stopped.  Without one, answers go to a
    store of this call's own.  ``parallelism`` is the number of concurrent
    callers and has no default: left to the optimizer, short prompts would meet
    in one task."""
    if isinstance(completion_fn, DataFrame):
        return answered(df, key, prompt_col, completion_fn, out_col, carry)
    if (completion_fn is None) == (client_factory is None):
        raise ValueError("give exactly one of completion_fn / client_factory")
    if not parallelism:
        raise ValueError("say how many tasks may call the model: parallelism=...")
    if store is None:
        store = AnswerStore(df.sparkSession, scratch_path(df.sparkSession, name))

    def client():
        fn = completion_fn if completion_fn is not None else client_factory()
        return lambda prompts: call_with_retries(fn, prompts, max_tries, first_wait, max_wait, transient)

    store.ask(df, prompt_col, client, parallelism, batch_size)
    return answered(df, key, prompt_col, store.rows(), out_col, carry)


def _parsed_content(resp) -> F.Column:
    return J.parse_json(J.extract_json_text(resp, "outermost"), CONTENT_SCHEMA)


def generate_prompt(name: str, text: str, template: str, keywords: str | None = None) -> F.Column:
    """The prompt of the first attempt."""
    vars_ = {"product_name": name, "base_name": base_name(name), "leaflet_text": text}
    if keywords:
        vars_["keywords"] = keywords
    return render(template, vars_)


def refine_prompt(name: str, text: str, template: str, content: str = "content", audit_col: str = "audit") -> F.Column:
    """The prompt of a further attempt: what was written and what the audit found."""
    return render(template, {"product_name": name, "leaflet_text": text,
                             "previous_json": F.to_json(F.col(content)), "audit_json": F.to_json(F.col(audit_col))})


def fallback_prompt(name: str, text: str, template: str) -> F.Column:
    """The prompt of the plain page."""
    return render(template, {"product_name": name, "leaflet_text": text})


def generate_prompts(df: DataFrame, key: str, name: str, text: str, template: str, keywords: str | None = None) -> DataFrame:
    """(key, prompt) of the first attempt."""
    return df.select(key, generate_prompt(name, text, template, keywords).alias("prompt"))


def refine_prompts(df: DataFrame, key: str, name: str, text: str, template: str,
                   content: str = "content", audit_col: str = "audit") -> DataFrame:
    """(key, prompt) of a further attempt."""
    return df.select(key, refine_prompt(name, text, template, content, audit_col).alias("prompt"))


def fallback_prompts(df: DataFrame, key: str, name: str, text: str, template: str) -> DataFrame:
    """(key, prompt) of the plain page."""
    return df.select(key, fallback_prompt(name, text, template).alias("prompt"))


def _asked(df: DataFrame, key: str, prompt: F.Column, completion_fn, stage: str, kw: dict) -> DataFrame:
    """``df`` with the answers to its prompts (``_response``).  Its columns go with
    the prompt's hash to the answer, so no second join by key brings them back."""
    return complete(df.withColumn("_prompt", prompt), key, "_prompt", completion_fn, out_col="_response", name=stage,
                    carry=tuple(c for c in df.columns if c != key), **kw)


def generate(df: DataFrame, key: str, name: str, text: str, completion_fn, template: str,
             keywords: str | None = None, **kw) -> DataFrame:
    """Render -> complete -> extract JSON -> accept when html > 50 chars
    (F6); model error objects are never accepted as content (H11)."""
    out = _asked(df, key, generate_prompt(name, text, template, keywords), completion_fn, "generate", kw)
    c = _parsed_content(F.col("_response"))
    ok = J.generated_ok(c["html_content"]) & J.json_error(J.extract_json_text("_response")).isNull()
    return out.withColumn("content", F.when(ok, c)).drop("_response")


def audit(df: DataFrame, content: str = "content", name: str | None = None, out: str = "audit") -> DataFrame:
    """Deterministic rule audit (scorer B) of the content struct."""
    flat = (df.withColumn("_c_title", F.col(content)["seo_title"])
              .withColumn("_c_meta", F.col(content)["meta_description"])
              .withColumn("_c_html", F.col(content)["html_content"]))
    return (audit_content(flat, "_c_title", "_c_meta", "_c_html", name=name, out=out)
            .drop("_c_title", "_c_meta", "_c_html"))


def refine(df: DataFrame, key: str, name: str, text: str, completion_fn, template: str,
           content: str = "content", audit_col: str = "audit", **kw) -> DataFrame:
    """A new record from previous record + audit; failure keeps the previous."""
    out = _asked(df, key, refine_prompt(name, text, template, content, audit_col), completion_fn, "refine", kw)
    new = _parsed_content(F.col("_response"))
    bad = J.json_error(J.extract_json_text("_response")).isNotNull()
    return out.withColumn(content, F.coalesce(F.when(~bad, new), F.col(content))).drop("_response")


def fallback(df: DataFrame, key: str, name: str, text: str, completion_fn, template: str, **kw) -> DataFrame:
    """Simple page (F7 error paragraph when short) + fixed title/description."""
    out = _asked(df, key, fallback_prompt(name, text, template), completion_fn, "fallback", kw)
    err = J.json_error(J.extract_json_text("_response")).isNotNull()
    html = J.fallback_html(F.when(~err, F.col("_response")))
    return out.withColumn("content", F.struct(J.fallback_title(name).alias("seo_title"),
                                              J.fallback_description(name).alias("meta_description"),
                                              html.alias("html_content"))).drop("_response")


def produce_content(df: DataFrame, key: str, name: str, text: str, completion_fn,
                     target: float = 95, max_attempts: int = 2, select: str = "last",
                     templates: dict | None = None, style: str = "", css_class: str = "product-description",
                     keywords: str | None = None, texts: DataFrame | None = None, link: str | None = None, **kw) -> DataFrame:
    """Generate, audit, refine the failing (up to ``max_attempts``),
    select (W5), fallback for rows without content, finalise HTML (H1-H3)
    and defaults (P5).  ``df`` must have one row per ``key``; rows with blank
    text should be routed away before (F4).

    Where many products share a document, give ``texts`` (``link``, ``text``; one
    row per link) and the column ``link`` of ``df``: a text then meets the rows
    whose prompt it is part of, and is neither stored nor shuffled per product.

    A table of answers is read by every stage: store it first if it is costly."""
    t = templates or default_templates()
    source = text if texts is None else link
    if texts is not None:
        texts = texts.select(F.col(link).cast("string").alias("_tk"), F.col(text))
    base = df.select(key, name, source, *([keywords] if keywords else []))
    if not isinstance(completion_fn, DataFrame):    # asked and answered: read twice
        base = materialize(base, "base", "zstd")

    def with_text(rows: DataFrame) -> DataFrame:
        if texts is None:
            return rows
        return rows.join(texts, F.col(link).cast("string") == F.col("_tk")).drop("_tk")

    a1 = audit(generate(with_text(base), key, name, text, completion_fn, t["page_generator"], keywords=keywords, **kw).select(
        key, name, source, "content"), name=name)
    a1 = materialize(a1.withColumn("attempt", F.lit(1)), "attempt1", "zstd")
    first = a1.where(F.col("content").isNotNull())
    passed = F.coalesce(F.col("audit.seo_score") >= target, F.lit(False))
    rounds = [first.where(~passed)]
    current = rounds[0]
    for n in range(2, max_attempts + 1):
        failing = with_text(current.where(F.col("audit.seo_score") < target).drop("attempt"))
        r = audit(refine(failing, key, name, text, completion_fn, t["quality_refiner"], **kw).select(
            key, name, *([source] if n < max_attempts else []), "content"), name=name)
        current = materialize(r.withColumn("attempt", F.lit(n)), f"attempt{n}", "zstd")
        rounds.append(current)
    scored = lambda rows: rows.select(key, name, "attempt", "content", F.col("audit.seo_score").alias("score"))
    attempts = scored(rounds[0])
    for r in rounds[1:]:
        attempts = attempts.unionByName(scored(r))
    # what passed at once has one attempt: nothing to select
    chosen = select_attempt(attempts, key, target=target, max_attempts=max_attempts, select=select).unionByName(
        scored(first.where(passed)).withColumn("attempts_run", F.lit(1)))
    chosen = chosen.withColumn("path", F.when(F.col("attempts_run") > 1, F.lit("refined")).otherwise(F.lit("generated")))
    empty = with_text(a1.where(F.col("content").isNull()).select(key, name, source))
    fb = audit(fallback(empty, key, name, text, completion_fn, t["essentials_fallback"], **kw), name=name)
    fb = fb.select(key, name, "content", F.col("audit.seo_score").alias("score"), F.lit(1).alias("attempts_run"),
                   F.lit("fallback").alias("path"))
    out = chosen.select(key, name, "content", "score", "attempts_run", "path").unionByName(fb)
    c = F.col("content")
    return out.select(
        key, F.col("score").alias("final_score"),
        wrap_fragment(F.coalesce(c["html_content"], F.lit("<p>Conteúdo não gerado.</p>")), style, css_class).alias("final_content"),
        F.coalesce(c["seo_title"], F.col(name)).alias("seo_title"),
        F.coalesce(c["meta_description"], F.lit(J.DEFAULT_META)).alias("meta_description"),
        "attempts_run", "path")
