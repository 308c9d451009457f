"""H9 prompt rendering: ``{{ var }}`` substitution as a column concat.

The template is a short driver-side string (a row of the template set); it
is split once on the driver into literal pieces and variable names, and
each row's prompt is one ``concat`` -- no regex, no Python per row.
Undefined variables render as '' (or raise with ``strict=True``);
``escape=True`` HTML-escapes values the way an autoescaping engine does."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = re.compile(r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}")
# Autoescape replacements (& first)
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")]


def template_variables(template: str) -> list[str]:
    return list(dict.fromkeys(PLACEHOLDER.findall(template)))


def html_escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def render(template: str, variables: dict, escape: bool = False, strict: bool = False) -> Column:
    """``variables`` maps template names to Columns (or column names)."""
    parts: list[Column] = []
    pos = 0
    for m in PLACEHOLDER.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        name = m.group(1)
        if name in variables:
            v = variables[name]
            v = v if isinstance(v, Column) else F.col(v)
            v = F.coalesce(v.cast("string"), F.lit(""))
            parts.append(html_escape(v) if escape else v)
        elif strict:
            raise ValueError(f"template variable {name!r} has no column")
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    if not parts:
        return F.lit("")
    return F.concat(*parts) if len(parts) > 1 else parts[0]
