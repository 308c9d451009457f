"""Rule scorer B: the content-record audit checklist (max 100) as column
expressions (R1-R12), and the layout lint flags (L1-L7).

Input: a content record -- title, meta description, HTML (and optionally the
product name).  Output ``audit`` struct:
  seo_score double,
  score_breakdown map<string, struct<score double, max_score double, feedback string>>
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import (attribute_is, base_name, count_tag, events, has_attribute, has_tag, outline,
                              tag_names, tags_of, text_of)
from ..functions.text import pretty_label

RULES = ("json_structure", "no_h1_tag", "section_order", "specifications_table", "faq_structure",
         "legal_notice", "transparency_note", "seo_title_format", "meta_description_format")
MAX_POINTS = {"json_structure": 5.0, "no_h1_tag": 5.0, "section_order": 15.0, "specifications_table": 10.0,
              "faq_structure": 15.0, "legal_notice": 10.0, "transparency_note": 10.0,
              "seo_title_format": 15.0, "meta_description_format": 15.0}


@dataclass(frozen=True)
class AuditRules:
    # Section order of the page layout, as (keyword, position);
    # checked in this order so "contraindica" wins over "indica".
    section_keywords: tuple = (("contraindica", 3), ("funciona", 2), ("como usar", 4),
                               ("composição", 5), ("especificações", 6), ("para que serve", 1))
    # The only rows of the specifications table
    spec_rows: tuple = ("fabricante", "princípio ativo", "registro ms")
    # Length ranges and banned word (the closing phrase is the store's own)
    title_len: tuple = (50, 65)
    desc_len: tuple = (120, 165)
    banned_word: str = "bula"
    call_to_action: str = "na nossa loja"  # the store's own closing phrase (a parameter)
    legal_phrase: str = "seu uso pode trazer riscos"
    transparency_phrase: str = "aprovada pela anvisa"
    # [product] [dose+unit] [manufacturer] [quantity + unit word]
    title_pattern: str = r"(?i)^\D+\s[0-9]+([.,][0-9]+)?\s?(mg|mcg|g|ml|ui|%)\s.+\s[0-9]+\s+\p{L}+\.?$"
    # fallback page: mandatory h2 keywords and table rows
    fallback_sections: tuple = ("para que serve", "como usar", "contraindica", "composição")
    fallback_rows: tuple = ("fabricante", "princípio ativo")


def _b(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def section_positions(heads: Column, rules: AuditRules) -> Column:
    """Positions of headings in the page layout; headings of no section are left out."""
    def pos(h):
        lh = F.lower(h)
        e = None
        for kw, p in rules.section_keywords:
            e = F.when(F.contains(lh, F.lit(kw)), F.lit(p)) if e is None else e.when(F.contains(lh, F.lit(kw)), F.lit(p))
        return e
    return F.filter(F.transform(heads, pos), lambda x: x.isNotNull())


def _parts(df: DataFrame, html: str, text: bool) -> DataFrame:
    """The columns both scorers read: ``_o`` (outline), ``_g`` (tags), ``_n``
    (their names) and, if asked for, ``_t`` (visible text)."""
    inner = df.withColumn("_ev", events(html))
    inner = inner.withColumn("_o", outline("_ev")).withColumn("_g", tags_of("_ev"))
    if text:
        inner = inner.withColumn("_t", text_of("_ev"))
    return inner.withColumn("_n", tag_names("_g"))


def _len_between(c: Column, lo_hi) -> Column:
    return _b(F.length(c).between(lo_hi[0], lo_hi[1]))


def title_checks(title: Column, rules: AuditRules):
    return _b(title.rlike(rules.title_pattern)), _len_between(title, rules.title_len)


def description_checks(meta: Column, rules: AuditRules):
    cta = rules.call_to_action.replace(".", r"\.")
    return (_len_between(meta, rules.desc_len),
            ~_b(meta.rlike(rf"(?i)\b{rules.banned_word}\b")) & meta.isNotNull(),
            _b(meta.rlike(rf"{cta}\.?$")))


def audit_content(df: DataFrame, title: str = "seo_title", meta: str = "meta_description",
                  html: str = "html_content", name: str | None = None,
                  rules: AuditRules = AuditRules(), out: str = "audit") -> DataFrame:
    for c in (title, meta, html):
        if c in ("_ev", "_o", "_g", "_n", "_t"):
            raise ValueError("column names _ev, _o, _g, _n and _t are reserved by audit_content")
    inner = _parts(df, html, text=True).drop("_ev")
    o, tags, t, h = F.col("_o"), F.col("_g"), F.col("_t"), F.col(html)
    ti, me = F.col(title), F.col(meta)
    base = F.lower(base_name(name)) if name else None

    t_pat, t_len = title_checks(ti, rules)
    d_len, d_clean, d_cta = description_checks(me, rules)
    legal = _b(F.exists(tags, lambda g: attribute_is(g["raw"], "class", "legal-notice-box"))) & _b(F.contains(t, F.lit(rules.legal_phrase)))
    if base is not None:
        legal = legal & _b(F.contains(t, base))
    want = F.array(*[F.lit(i) for i in range(1, len(rules.section_keywords) + 1)])
    score = {
        "json_structure": F.when(ti.isNotNull() & me.isNotNull() & h.isNotNull(), 5.0),
        "no_h1_tag": F.when(h.isNotNull() & ~_b(has_tag("_n", "h1")), 5.0),
        "section_order": F.when(_b(section_positions(o["h2_main"], rules) == want), 15.0),
        "specifications_table": F.when(_b(F.array_sort(o["labels"]) ==
                                          F.array_sort(F.array(*[F.lit(x) for x in rules.spec_rows]))), 10.0),
        "faq_structure": F.when(_b(F.exists(tags, lambda g: (g["name"] == "details") & has_attribute(g["raw"], "open")))
                                & _b(has_tag("_n", "summary")), 15.0),
        "legal_notice": F.when(legal, 10.0),
        "transparency_note": F.when(_b(F.exists(tags, lambda g: F.contains(g["raw"], F.lit("transparency-note-final")))) &
                                    _b(F.contains(t, F.lit(rules.transparency_phrase))), 10.0),
        "seo_title_format": F.when(t_pat, 7.5).otherwise(0.0) + F.when(t_len, 7.5).otherwise(0.0),
        "meta_description_format": (F.when(d_len, 5.0).otherwise(0.0) + F.when(d_clean, 5.0).otherwise(0.0)
                                    + F.when(d_cta, 5.0).otherwise(0.0)),
    }
    # scores are materialised as columns first: each is referenced several
    # times below (struct, pass test, feedback, total) and must run once
    inner = inner.select("*", *[F.coalesce(v, F.lit(0.0)).cast("double").alias(f"_r_{k}") for k, v in score.items()])
    score = {k: F.col(f"_r_{k}") for k in RULES}
    entries = [F.struct(score[k].alias("score"), F.lit(MAX_POINTS[k]).alias("max_score"),
                        F.when(score[k] == MAX_POINTS[k], F.lit(f"{k}: passed"))
                         .otherwise(F.format_string(f"{k}: %s of {MAX_POINTS[k]:g} points", score[k])).alias("feedback"))
               for k in RULES]
    ok = F.struct(sum((score[k] for k in RULES), F.lit(0.0)).alias("seo_score"),
                  F.map_from_arrays(F.array(*[F.lit(k) for k in RULES]), F.array(*entries)).alias("score_breakdown"))
    # Nothing to audit -> score 0 with an error entry
    failed = F.struct(F.lit(0.0).alias("seo_score"),
                      F.create_map(F.lit("error"), F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("max_score"),
                                                            F.lit("no content to audit").alias("feedback"))
                                   ).alias("score_breakdown"))
    none = ti.isNull() & me.isNull() & h.isNull()
    return (inner.withColumn(out, F.when(none, failed).otherwise(ok))
            .drop("_o", "_g", "_n", "_t", *[f"_r_{k}" for k in RULES]))


def audit_long(df: DataFrame, id_cols, col: str = "audit") -> DataFrame:
    """One row per (record, rule): pass iff score = max_score, display label and severity."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    # an inner explode lets the optimizer infer a filter on the breakdown's size
    # and push it down to the scan, which scores every page again and again there
    e = df.select(*ids, F.explode_outer(F.col(col)["score_breakdown"]).alias("rule", "entry")).where("rule is not null")
    passed = F.coalesce(e["entry"]["score"] == e["entry"]["max_score"], F.lit(False))
    return e.select(*ids, "rule", pretty_label(F.col("rule")).alias("label"),
                    F.col("entry.score").alias("score"), F.col("entry.max_score").alias("max_score"),
                    F.col("entry.feedback").alias("feedback"), passed.alias("passed"),
                    F.when(passed, F.lit("success")).otherwise(F.lit("warning")).alias("type"))


def lint_flags(df: DataFrame, html: str = "html_content", title: str = "seo_title",
               meta: str = "meta_description", name: str | None = None,
               rules: AuditRules = AuditRules()) -> DataFrame:
    """L1-L7 layout lint (not scored): one boolean per rule plus repair candidates."""
    out = _parts(df, html, text=False)
    o = F.col("_o")
    heads = F.concat(o["h2"], o["h3"])
    if name:
        b = F.lower(base_name(name))
        out = out.withColumn("l1_no_heading_starts_with_name",
                             ~_b(F.exists(heads, lambda x: F.startswith(F.lower(x), b))))
    n_details = count_tag("_n", "details")
    h2s = F.transform(o["h2"], lambda x: F.lower(x))
    labels = o["labels"]
    doctype = F.exists("_ev", lambda e: F.lower(F.substring(e["raw"], 1, 9)) == "<!doctype")
    t_pat, t_len = title_checks(F.col(title), rules)
    d_len, d_clean, d_cta = description_checks(F.col(meta), rules)
    out = (out
           .withColumn("l2_no_section_label", ~_b(F.col(html).rlike(r"SEÇÃO [0-9]+")))
           .withColumn("l3_faq_count_ok", _b(n_details.between(3, 5)))
           .withColumn("l4_no_document_tags", ~_b(doctype | has_tag("_n", "html", "head", "body")))
           .withColumn("l5_alt_faq_form", _b(o["pairs"] > 0) & ~_b(has_tag("_n", "details", "summary")))
           .withColumn("l6_fallback_page_ok",
                       _b(F.forall(F.array(*[F.lit(k) for k in rules.fallback_sections]),
                                   lambda k: F.exists(h2s, lambda hh: F.contains(hh, k))))
                       & _b(F.forall(F.array(*[F.lit(k) for k in rules.fallback_rows]),
                                     lambda k: F.array_contains(labels, k))))
           .withColumn("l7_repairs", F.array_compact(F.array(
               F.when(~t_pat, F.lit("title_pattern")), F.when(~t_len, F.lit("title_length")),
               F.when(~d_len, F.lit("description_length")), F.when(~d_clean, F.lit("banned_word")),
               F.when(~d_cta, F.lit("call_to_action")))))
           .drop("_ev", "_o", "_g", "_n"))
    return out
