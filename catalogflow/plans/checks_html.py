"""Registered checks: HTML helpers (H1-H8), scorer A (Q1-Q7), scorer B
(R1-R12) and lint flags (L1-L7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import analyzer as A
from ..operators import audit as AU
from ..operators import events as EV
from . import sqlfrag as Q
from .standin_html import made_content, made_html
from .standins import table, with_ctes


def _pages_and_made(spark, d):
    pages = table(spark, d, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"), "html")
    made = made_html(spark, d).select(F.lit("made").alias("src"), F.col("doc_id").alias("id"), "html")
    return pages.unionByName(made)


_PM = """pm AS (SELECT 'page' AS src, page_id AS id, html, html AS plain FROM pages
             UNION ALL SELECT 'made', doc_id, html, plain FROM made_html)"""


def clean_fences_q(spark, d):
    h = made_html(spark, d)
    c = H.clean_fences("html")
    return h.select("doc_id", F.md5(c).alias("clean_md5"), F.length(c).cast("bigint").alias("clean_len"))


def unwrap_tags_q(spark, d):
    h = _pages_and_made(spark, d)
    u = H.unwrap_tags("html")
    return h.select("src", "id", F.md5(u).alias("unwrapped_md5"), F.length(u).cast("bigint").alias("unwrapped_len"))


def wrap_fragment_q(spark, d):
    h = made_html(spark, d)
    w = H.wrap_fragment("html", style="<style>.pd{margin:0}</style>", css_class="pd")
    return h.select("doc_id", F.md5(w).alias("wrapped_md5"), F.length(w).cast("bigint").alias("wrapped_len"))


def html_text_q(spark, d):
    h = _pages_and_made(spark, d)
    t = H.visible_text("html")
    return h.select("src", "id", F.md5(t).alias("text_md5"), F.length(t).cast("bigint").alias("text_len"))


def html_features_q(spark, d):
    f = A.html_features(_pages_and_made(spark, d), "html")
    return f.drop("html")


def heading_list_q(spark, d):
    h = made_html(spark, d).withColumn("ev", H.events("html"))
    heads = H.outline("ev")["h2"]
    return h.select("doc_id", F.size(heads).alias("n_h2"), F.array_join(heads, " | ").alias("h2_texts"))


def base_name_q(spark, d):
    return made_html(spark, d).select("doc_id", "product_name", H.base_name("product_name").alias("base_name"))


def suffix_headings_q(spark, d):
    h = made_html(spark, d)
    s = H.suffix_headings("html", H.base_name("product_name"))
    return h.select("doc_id", F.md5(s).alias("suffixed_md5"), F.length(s).cast("bigint").alias("suffixed_len"))


def analyze_html_q(spark, d):
    a = A.analyze_html(_pages_and_made(spark, d), "html")
    return A.analysis_scores(a).drop("html")


def analyze_html_feedback_q(spark, d):
    a = A.analyze_html(_pages_and_made(spark, d), "html")
    return a.select("src", "id", F.array_join("analysis.feedback_all", " | ").alias("feedback"),
                    F.array_join(F.array_sort(F.map_keys("analysis.breakdown")), ",").alias("categories"))


def score_distribution_q(spark, d):
    a = A.analyze_html(_pages_and_made(spark, d), "html")
    return a.groupBy(F.col("src"), F.col("analysis.total_score").alias("total_score")) \
        .agg(F.count(F.lit(1)).alias("n_docs"))


def _audited(spark, d):
    return AU.audit_content(made_content(spark, d), name="product_name")


def audit_scores_q(spark, d):
    a = _audited(spark, d)
    return a.select("doc_id", *[F.col("audit.score_breakdown")[k]["score"].alias("r_" + k) for k in AU.RULES],
                    F.col("audit.seo_score").alias("seo_score"))


def audit_breakdown_q(spark, d):
    return AU.audit_long(_audited(spark, d), "doc_id").select(
        "doc_id", "rule", "label", "score", "max_score", "passed", "type")


def audit_rule_failure_rates_q(spark, d):
    long = AU.audit_long(_audited(spark, d), "doc_id")
    return long.groupBy("rule").agg(F.count(F.lit(1)).alias("n_total"),
                                    F.count_if(~F.col("passed")).alias("n_failed"))


def lint_flags_q(spark, d):
    f = AU.lint_flags(made_content(spark, d), name="product_name")
    return f.select("doc_id", "l1_no_heading_starts_with_name", "l2_no_section_label", "l3_faq_count_ok",
                    "l4_no_document_tags", "l5_alt_faq_form", "l6_fallback_page_ok",
                    F.array_join("l7_repairs", ",").alias("l7_repairs"))


QUERIES = {
    "clean_fences": clean_fences_q,
    "unwrap_tags": unwrap_tags_q,
    "wrap_fragment": wrap_fragment_q,
    "html_text": html_text_q,
    "html_features": html_features_q,
    "heading_list": heading_list_q,
    "base_name": base_name_q,
    "suffix_headings": suffix_headings_q,
    "analyze_html": analyze_html_q,
    "analyze_html_feedback": analyze_html_feedback_q,
    "score_distribution": score_distribution_q,
    "audit_scores": audit_scores_q,
    "audit_breakdown": audit_breakdown_q,
    "audit_rule_failure_rates": audit_rule_failure_rates_q,
    "lint_flags": lint_flags_q,
}

# ---------------------------------------------------------------- oracle SQL
_M = Q.markup("plain")
# what the pages were made of, not the scorer's rule: the block with nested
# questions is in the pages whose number leaves 0 of 5; given pages have none
FAQ_TRUTH = "(src = 'made' AND id % 5 = 0 AND id % 19 > 1)"
_AUTHORITY = "<[aA] [^>]*[hH][rR][eE][fF]=[\"']?[^\"'> ]*gov[.]br"
_FEAT = f"""feat AS (
  SELECT src, id,
    coalesce(plain <> '', false) AS valid,
    {Q.has_tag('m', 'h1')} AS has_h1, {Q.has_tag('m', 'h2')} AS has_h2, {Q.has_tag('m', 'ul', 'ol')} AS has_list,
    {FAQ_TRUTH} AS faq_ok,
    coalesce(contains(t, {Q.lit(A.GEO_PHRASES[0])}) AND contains(t, {Q.lit(A.GEO_PHRASES[1])}), false) AS geo_ok,
    coalesce(contains(t, {Q.lit(A.VERIFIABLE_PHRASES[0])}) AND contains(t, {Q.lit(A.VERIFIABLE_PHRASES[1])}), false) AS verifiable_ok,
    coalesce(regexp_matches(m, {Q.lit(_AUTHORITY)}), false) AS links_ok
  FROM (SELECT *, {Q.text_of_markup('m')} AS t FROM (SELECT *, {_M} AS m FROM pm)))"""

_SCORES = """scores AS (
  SELECT src, id, valid,
    CASE WHEN valid THEN CASE WHEN NOT has_h1 AND has_h2 THEN 10 ELSE 0 END END AS s_headings,
    CASE WHEN valid THEN CASE WHEN has_list THEN 10 ELSE 0 END END AS s_readability,
    CASE WHEN valid THEN CASE WHEN faq_ok THEN 10 ELSE 0 END END AS s_faq_structure,
    CASE WHEN valid THEN CASE WHEN geo_ok THEN 10 ELSE 0 END END AS s_geo_signals,
    CASE WHEN valid THEN CASE WHEN verifiable_ok THEN 10 ELSE 0 END END AS s_verifiable_data,
    CASE WHEN valid THEN CASE WHEN links_ok THEN 10 ELSE 0 END END AS s_external_links,
    feat.*
  FROM feat)"""
_TOTAL = ("CAST(coalesce(s_headings + s_readability + s_faq_structure + s_geo_signals + s_verifiable_data"
          " + s_external_links, 0) AS INTEGER)")

_MSG = A.Messages()
_FB = f"""CASE WHEN NOT valid THEN '' ELSE array_to_string(list_concat(
  [CASE WHEN has_h1 THEN {Q.lit(_MSG.h1_forbidden)} WHEN NOT has_h2 THEN {Q.lit(_MSG.no_h2)} ELSE {Q.lit(_MSG.headings_ok)} END,
   CASE WHEN has_list THEN {Q.lit(_MSG.list_ok)} ELSE {Q.lit(_MSG.no_list)} END,
   CASE WHEN faq_ok THEN {Q.lit(_MSG.faq_ok)} ELSE {Q.lit(_MSG.faq_missing)} END],
  list_filter([CASE WHEN NOT geo_ok THEN {Q.lit(_MSG.no_geo)} END,
               CASE WHEN NOT verifiable_ok THEN {Q.lit(_MSG.no_verifiable)} END,
               CASE WHEN NOT links_ok THEN {Q.lit(_MSG.no_links)} END], lambda x: x IS NOT NULL)), ' | ') END"""

_CM = "cm AS (SELECT *, " + Q.markup("plain") + " AS m FROM made_content)"
_CMT = "cmt AS (SELECT *, " + Q.text_of_markup("m") + " AS t FROM cm)"
_R = AU.AuditRules()


def _section_case(h: str) -> str:
    whens = " ".join(f"WHEN contains(lower({h}), {Q.lit(kw)}) THEN {p}" for kw, p in _R.section_keywords)
    return f"CASE {whens} END"


_SECTIONS = (f"list_filter(list_transform({Q.headings(Q.rx_replace('m', '(?is)<details.*?</details>'))}, "
             f"lambda h: {_section_case('h')}), lambda x: x IS NOT NULL)")
_LABELS = (f"list_transform(regexp_extract_all(regexp_extract(m, '(?is)<table>(.*?)</table>', 1), '(?is)<tr>(.*?)</tr>', 1), "
           f"lambda r: lower({Q.rx_replace(Q.rx_replace("regexp_extract(r, '(?is)<t[hd]>(.*?)</t[hd]>', 1)", Q.PLAIN_TAG), Q._STRIP)}))")
_SPEC = "[" + ", ".join(Q.lit(x) for x in _R.spec_rows) + "]"
_TPAT = f"coalesce(regexp_matches(seo_title, {Q.lit(_R.title_pattern)}), false)"
_TLEN = f"coalesce(length(seo_title) BETWEEN {_R.title_len[0]} AND {_R.title_len[1]}, false)"
_DLEN = f"coalesce(length(meta_description) BETWEEN {_R.desc_len[0]} AND {_R.desc_len[1]}, false)"
_DCLEAN = (f"(meta_description IS NOT NULL AND NOT coalesce(regexp_matches(meta_description, "
           f"{Q.lit(r'(?i)\b' + _R.banned_word + r'\b')}), false))")
_DCTA = f"coalesce(regexp_matches(meta_description, {Q.lit(_R.call_to_action + r'\.?$')}), false)"
_AUD = f"""aud AS (
  SELECT doc_id, (seo_title IS NULL AND meta_description IS NULL AND html_content IS NULL) AS none,
    CASE WHEN seo_title IS NOT NULL AND meta_description IS NOT NULL AND html_content IS NOT NULL THEN 5.0 ELSE 0.0 END AS r_json_structure,
    CASE WHEN html_content IS NOT NULL AND NOT {Q.has_tag('m', 'h1')} THEN 5.0 ELSE 0.0 END AS r_no_h1_tag,
    CASE WHEN coalesce({_SECTIONS} = [1, 2, 3, 4, 5, 6], false) THEN 15.0 ELSE 0.0 END AS r_section_order,
    CASE WHEN coalesce(list_sort({_LABELS}) = list_sort({_SPEC}), false) THEN 10.0 ELSE 0.0 END AS r_specifications_table,
    CASE WHEN coalesce(contains(m, '<details open'), false) AND {Q.has_tag('m', 'summary')} THEN 15.0 ELSE 0.0 END AS r_faq_structure,
    CASE WHEN coalesce(contains(m, 'class="legal-notice-box"'), false)
          AND coalesce(contains(t, {Q.lit(_R.legal_phrase)}), false)
          AND coalesce(contains(t, lower({Q.base_name('product_name')})), false) THEN 10.0 ELSE 0.0 END AS r_legal_notice,
    CASE WHEN coalesce(regexp_matches(m, 'transparency-note-final'), false)
          AND coalesce(contains(t, {Q.lit(_R.transparency_phrase)}), false) THEN 10.0 ELSE 0.0 END AS r_transparency_note,
    (CASE WHEN {_TPAT} THEN 7.5 ELSE 0.0 END) + (CASE WHEN {_TLEN} THEN 7.5 ELSE 0.0 END) AS r_seo_title_format,
    (CASE WHEN {_DLEN} THEN 5.0 ELSE 0.0 END) + (CASE WHEN {_DCLEAN} THEN 5.0 ELSE 0.0 END)
      + (CASE WHEN {_DCTA} THEN 5.0 ELSE 0.0 END) AS r_meta_description_format
  FROM cmt)"""
_AUD_CTES = _CM + ", " + _CMT + ", " + _AUD
_RULE_COLS = ", ".join(f"CASE WHEN none THEN NULL ELSE CAST(r_{k} AS DOUBLE) END AS r_{k}" for k in AU.RULES)
_SUM = " + ".join(f"r_{k}" for k in AU.RULES)
_LONG = ("long AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {Q.lit(k)} AS rule, {Q.lit(k.replace('_', ' ').title())} AS label, CAST(r_{k} AS DOUBLE) AS score, "
    f"CAST({AU.MAX_POINTS[k]} AS DOUBLE) AS max_score FROM aud WHERE NOT none" for k in AU.RULES)
    + " UNION ALL SELECT doc_id, 'error', 'Error', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM aud WHERE none)")

_DOC_TAGS = "</?(html|body|head|header|footer)( [^<>]*)?>"
_UNWRAPPED = Q.rx_replace("html", _DOC_TAGS)

ORACLE = {
    "clean_fences": with_ctes(f"""
SELECT doc_id, md5({Q.clean_fences('html')}) AS clean_md5, length({Q.clean_fences('html')}) AS clean_len
FROM made_html""", "made_html"),
    "unwrap_tags": with_ctes(f"""
SELECT src, id, md5({_UNWRAPPED}) AS unwrapped_md5, length({_UNWRAPPED}) AS unwrapped_len FROM pm""", "made_html", ctes=_PM),
    "wrap_fragment": with_ctes(f"""
SELECT doc_id, md5(w) AS wrapped_md5, length(w) AS wrapped_len FROM (
  SELECT doc_id, CASE WHEN html IS NULL THEN '' ELSE
    '<style>.pd{{margin:0}}</style>' || chr(10) || '<div class="pd">' || chr(10)
    || {Q.ustrip(Q.rx_replace(Q.clean_fences('html'), _DOC_TAGS))} || chr(10) || '</div>' END AS w
  FROM made_html)""", "made_html"),
    "html_text": with_ctes(f"""
SELECT src, id, md5(t) AS text_md5, length(t) AS text_len
FROM (SELECT src, id, {Q.text_of_markup(_M)} AS t FROM pm)""", "made_html", ctes=_PM),
    "html_features": with_ctes("""
SELECT src, id, valid, has_h1, has_h2, has_list, faq_ok, geo_ok, verifiable_ok, links_ok FROM feat""",
                               "made_html", ctes=_PM + ", " + _FEAT),
    "heading_list": with_ctes(f"""
SELECT doc_id, CAST(len(hs) AS INTEGER) AS n_h2, array_to_string(hs, ' | ') AS h2_texts
FROM (SELECT doc_id, {Q.headings(_M)} AS hs FROM made_html)""", "made_html"),
    "base_name": with_ctes(f"SELECT doc_id, product_name, {Q.base_name('product_name')} AS base_name FROM made_html",
                           "made_html"),
    "suffix_headings": with_ctes(f"""
SELECT doc_id, md5(s) AS suffixed_md5, length(s) AS suffixed_len FROM (
  SELECT doc_id, replace(regexp_replace(html, '(?i)</h2>', chr(1), 'g'), chr(1),
                         ' - ' || {Q.base_name('product_name')} || '</h2>') AS s FROM made_html)""", "made_html"),
    "analyze_html": with_ctes(f"""
SELECT src, id, s_headings, s_readability, s_faq_structure, s_geo_signals, s_verifiable_data,
       s_external_links, {_TOTAL} AS total_score FROM scores""", "made_html", ctes=_PM + ", " + _FEAT + ", " + _SCORES),
    "analyze_html_feedback": with_ctes(f"""
SELECT src, id, {_FB} AS feedback,
  CASE WHEN valid THEN 'external_links,faq_structure,geo_signals,headings,readability,verifiable_data'
       ELSE 'error' END AS categories FROM feat""", "made_html", ctes=_PM + ", " + _FEAT),
    "score_distribution": with_ctes(f"""
SELECT src, {_TOTAL} AS total_score, count(*) AS n_docs FROM scores GROUP BY ALL""",
                                    "made_html", ctes=_PM + ", " + _FEAT + ", " + _SCORES),
    "audit_scores": with_ctes(f"""
SELECT doc_id, {_RULE_COLS}, CAST(CASE WHEN none THEN 0 ELSE {_SUM} END AS DOUBLE) AS seo_score FROM aud""",
                              "made_html", "made_content", ctes=_AUD_CTES),
    "audit_breakdown": with_ctes("""
SELECT doc_id, rule, label, score, max_score, score = max_score AS passed,
       CASE WHEN score = max_score THEN 'success' ELSE 'warning' END AS type FROM long""",
                                 "made_html", "made_content", ctes=_AUD_CTES + ", " + _LONG),
    "audit_rule_failure_rates": with_ctes("""
SELECT rule, count(*) AS n_total, count(*) FILTER (WHERE score <> max_score) AS n_failed FROM long GROUP BY rule""",
                                          "made_html", "made_content", ctes=_AUD_CTES + ", " + _LONG),
}

_HEADS23 = f"list_concat({Q.headings('m', 2)}, {Q.headings('m', 3)})"
_H2L = f"list_transform({Q.headings('m', 2)}, lambda x: lower(x))"
_FB_SECTIONS = "[" + ", ".join(Q.lit(k) for k in _R.fallback_sections) + "]"
_FB_ROWS = "[" + ", ".join(Q.lit(k) for k in _R.fallback_rows) + "]"
ORACLE["lint_flags"] = with_ctes(f"""
SELECT doc_id,
  NOT coalesce(list_bool_or(list_transform({_HEADS23},
      lambda x: starts_with(lower(x), lower({Q.base_name('product_name')})))), false) AS l1_no_heading_starts_with_name,
  NOT coalesce(regexp_matches(plain, 'SEÇÃO [0-9]+'), false) AS l2_no_section_label,
  coalesce({Q.count_tag('m', 'details')} BETWEEN 3 AND 5, false) AS l3_faq_count_ok,
  NOT coalesce(regexp_matches(m, {Q.lit('(?i)<(!doctype|html|head|body)[ />]')}), false) AS l4_no_document_tags,
  coalesce(len(regexp_extract_all(m, {Q.lit('(?s)</h3>[ \n]*<p>')})) > 0, false)
    AND NOT {Q.has_tag('m', 'details', 'summary')} AS l5_alt_faq_form,
  coalesce(list_bool_and(list_transform({_FB_SECTIONS}, lambda k: list_bool_or(list_transform({_H2L}, lambda hh: contains(hh, k))))), false)
    AND coalesce(list_bool_and(list_transform({_FB_ROWS}, lambda k: list_contains({_LABELS}, k))), false) AS l6_fallback_page_ok,
  array_to_string(list_filter([
    CASE WHEN NOT {_TPAT} THEN 'title_pattern' END, CASE WHEN NOT {_TLEN} THEN 'title_length' END,
    CASE WHEN NOT {_DLEN} THEN 'description_length' END, CASE WHEN NOT {_DCLEAN} THEN 'banned_word' END,
    CASE WHEN NOT {_DCTA} THEN 'call_to_action' END], lambda x: x IS NOT NULL), ',') AS l7_repairs
FROM cm""", "made_html", "made_content", ctes=_CM)


def feat_cte(name: str, src: str) -> str:
    """Scorer-A feature CTE over table ``src`` (columns src, id, plain)."""
    return _FEAT.replace("feat AS (", f"{name} AS (", 1).replace("FROM pm)))", f"FROM {src})))")


def scores_cte(name: str, feat: str) -> str:
    return (_SCORES.replace("scores AS (", f"{name} AS (", 1).replace("FROM feat)", f"FROM {feat})")
            .replace("feat.*", f"{feat}.*"))


TOTAL_SQL = _TOTAL


def content_events_q(spark, d):
    """Every event of every item, with what its frame decodes to (ST1, ST2, P8)."""
    ev = EV.content_events(_audited(spark, d), "doc_id").withColumnRenamed("pos", "n")
    back = EV.decode_frames(ev, "frame", id_cols=["doc_id", "n", "type", "message"])
    return back.select("doc_id", F.col("n").alias("pos"), "event", "type", "message", F.col("payload.final_score").alias("final_score"))


QUERIES["content_events"] = content_events_q
_N = len(AU.RULES)
_RULE_EVENTS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS pos, 'log' AS event, CASE WHEN r_{k} = {AU.MAX_POINTS[k]} THEN 'success' ELSE 'warning' END AS type, "
    f"'{k}: ' || CAST(CAST(r_{k} AS DOUBLE) AS VARCHAR) || ' of {AU.MAX_POINTS[k]}' AS message, NULL AS final_score FROM aud WHERE NOT none"
    for i, k in enumerate(AU.RULES, 1))
ORACLE["content_events"] = with_ctes(f"""
SELECT doc_id, 0 AS pos, 'log' AS event, 'info' AS type, 'start: ' || coalesce(product_name, '') AS message, CAST(NULL AS DOUBLE) AS final_score FROM made_content
UNION ALL {_RULE_EVENTS}
UNION ALL SELECT doc_id, {_N + 1}, 'log', 'info', 'score: ' || CAST(CAST({_SUM} AS DOUBLE) AS VARCHAR), NULL FROM aud WHERE NOT none
UNION ALL SELECT doc_id, {_N + 2}, 'log', CASE WHEN {_SUM} >= 95 THEN 'success' ELSE 'warning' END,
  CASE WHEN {_SUM} >= 95 THEN 'approved' ELSE 'below target' END, NULL FROM aud WHERE NOT none
UNION ALL SELECT doc_id, {_N + 3}, 'done', NULL, NULL, CAST({_SUM} AS DOUBLE) FROM aud WHERE NOT none
UNION ALL SELECT doc_id, {_N + 4}, 'review_item', NULL, NULL, NULL FROM aud WHERE NOT none
UNION ALL SELECT doc_id, 1, 'error', 'error', 'no content to review', NULL FROM aud WHERE none
UNION ALL SELECT NULL, 0, 'finished', 'info', CAST((SELECT count(*) FROM made_content) AS VARCHAR) || ' items', NULL""",
                                     "made_html", "made_content", ctes=_AUD_CTES)
