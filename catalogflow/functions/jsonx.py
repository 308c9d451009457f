"""JSON answers inside model text (H10), error objects (H11), reject
samples (P11), fallback title/description (H12) and content gates (F6-F8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import col_of

# Fixed value: a fenced ```json block or a bare object, first match wins,
# shortest object (parity with the original extraction).
SHORTEST = r"(?s)```json\s*(\{.*?\})\s*```|(\{.*?\})"
# recommended: first "{" to last "}" (nested objects survive)
OUTERMOST_FENCED = r"(?s)```json\s*(\{.*\})\s*```"
OUTERMOST = r"(?s)(\{.*\})"

# Fallback texts (H12 title / description, F7 error paragraph,
# P4/P5 defaults)
FALLBACK_TITLE = "%s - Para que serve e como usar"
FALLBACK_DESCRIPTION = ("Encontre aqui informações essenciais sobre %s: para que serve, como funciona, "
                        "como usar e mais. Consulte a bula e um profissional de saúde.")
FALLBACK_HTML_ERROR = "<p>Falha crítica na geração de conteúdo.</p>"
DEFAULT_KEYWORDS = "bula, para que serve, como usar"
DEFAULT_HTML = "<p>Erro ao gerar conteúdo.</p>"
DEFAULT_META = "Descrição não gerada."
DRAFT_ERROR = "Erro"


def extract_json_text(c, mode: str = "outermost") -> Column:
    """The JSON object text inside a model answer, or null."""
    s = col_of(c)
    if mode == "shortest":
        g = F.coalesce(F.nullif(F.regexp_extract(s, SHORTEST, 1), F.lit("")),
                       F.nullif(F.regexp_extract(s, SHORTEST, 2), F.lit("")))
    elif mode == "outermost":
        g = F.coalesce(F.nullif(F.regexp_extract(s, OUTERMOST_FENCED, 1), F.lit("")),
                       F.nullif(F.regexp_extract(s, OUTERMOST, 1), F.lit("")))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return g


def is_json(c) -> Column:
    """True when the text parses as JSON (strict), null input -> null."""
    return F.try_parse_json(col_of(c)).isNotNull()


def parse_json(c, schema: str) -> Column:
    """Parse to ``schema``; invalid JSON -> null (not a row of nulls)."""
    s = col_of(c)
    return F.when(is_json(s), F.from_json(s, schema))


def json_error(c) -> Column:
    """The ``error`` member of an answer that is an error object."""
    return F.get_json_object(col_of(c), "$.error")


def reject_sample(c, n: int = 500) -> Column:
    """First ``n`` characters kept for diagnosis."""
    return F.substring(col_of(c), 1, n)


def fallback_title(name) -> Column:
    return F.format_string(FALLBACK_TITLE, col_of(name))


def fallback_description(name) -> Column:
    return F.format_string(FALLBACK_DESCRIPTION, col_of(name))


def generated_ok(html, min_len: int = 50) -> Column:
    """generated content accepted only when present and longer than 50."""
    return F.coalesce(F.length(col_of(html)) > min_len, F.lit(False))


def fallback_html(html, min_len: int = 20) -> Column:
    """null or shorter than 20 -> fixed error paragraph."""
    h = col_of(html)
    return F.when(h.isNull() | (F.length(h) < min_len), F.lit(FALLBACK_HTML_ERROR)).otherwise(h)


def score_band(score, target: float = 95, review: float = 70) -> Column:
    """F8: quality gate labels; thresholds are parameters."""
    s = col_of(score)
    return (F.when(s >= target, F.lit("approved_quality"))
             .when(s >= review, F.lit("ok")).otherwise(F.lit("below_target")))
