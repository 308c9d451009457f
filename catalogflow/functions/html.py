"""HTML column helpers (H1-H8) over one stream of page events.

A page is split once into its events in order: comments, raw elements (script,
style and template with their bodies), tags and texts.  Quoted attribute values
are stepped over, so a ">" or a tag inside one is not markup.  Tag names,
visible text, headings and table labels are all read from that array: filters
and one fold, inside Spark's own expressions.
"""

from __future__ import annotations

import html.entities
import json
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import col_of
from .text import WS_CHARS, WS_CLASS, ustrip

# --- patterns -------------------------------------------------------------
# the rest of a tag: a quote opens a value only after "="; the repeats are
# bounded because Java's matcher recurses on them, a longer tag ends at its next ">"
REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|)){0,300}+[^>]*+"""
# fixed values: elements whose body is no markup
RAW = ("script", "style", "template")
EVENT = ("(?is)<!--.*?(?:-->|\\z)|" + "|".join(rf"<{t}(?:[\s/]{REST})?>.*?(?:</{t}\s*>|\z)" for t in RAW)
         + rf"|</?[a-z][^\s/>]*+{REST}>|<[!?][^>]*+>|[^<]++|<")
TAG = r"\A<(/?[a-zA-Z][^\s/>]*+)"
DOC_TAGS = rf"(?i)</?(?:html|body|head|header|footer)(?:[\s/]{REST})?>"
FENCE_OPEN = r"(?i)\A```html" + WS_CLASS + "*"
FENCE_CLOSE = WS_CLASS + r"*```\z"


@lru_cache(1)
def _entities() -> tuple[dict, dict, dict]:
    """(names ending in ";", names that need none, what the C1 numbers mean), as HTML defines them."""
    full = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
    bare = {k: v for k, v in html.entities.html5.items() if not k.endswith(";")}
    common = [k for k in bare if k in full]     # old names first: a look-up walks the list
    full = {k: full[k] for k in common} | full
    c1 = {}
    for n in range(0x80, 0xA0):
        try:
            c1[n] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            pass
    return full, bare, c1


def _lookup(table: dict, key: Column) -> Column:
    """``table[key]`` (null where it has none).  The table is one text literal,
    which the optimizer turns into one constant map."""
    return F.element_at(F.from_json(F.lit(json.dumps(table)), "map<string,string>"), key)


def _by_number(n: Column) -> Column:
    """The character of a reference's number (null: not a number)."""
    bad = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(bad, F.lit("\ufffd")).when(n.between(0x80, 0x9F), F.coalesce(_lookup(_entities()[2], n.cast("string")), char)).otherwise(char)


def _reference(piece: Column) -> Column:
    """What follows an "&", with the reference at its start (if any) resolved."""
    full, bare, _ = _entities()
    number = F.regexp_extract(piece, r"\A#(?:[xX][0-9a-fA-F]+|[0-9]+)", 0)
    hexa = F.lower(F.substring(number, 2, 1)) == "x"
    digits = F.when(hexa, F.conv(F.substring(number, 3, 1 << 20), 16, 10)).otherwise(F.substring(number, 2, 1 << 20))
    # more digits than any code point has: no character
    digits = F.coalesce(digits.try_cast("bigint"), F.lit(1 << 30))
    after = F.substring(piece, F.length(number) + 1, F.length(piece))
    after = F.when(F.startswith(after, F.lit(";")), F.substring(after, 2, 1 << 30)).otherwise(after)
    name = F.regexp_extract(piece, r"\A([a-zA-Z][a-zA-Z0-9]*);", 1)
    by_name = F.when(name != "", _lookup(full, name))
    out = F.when(by_name.isNotNull(), F.concat(by_name, F.substring(piece, F.length(name) + 2, 1 << 30)))
    for size in range(max(map(len, bare)), min(map(len, bare)) - 1, -1):
        short = {k: v for k, v in bare.items() if len(k) == size}
        hit = _lookup(short, F.substring(piece, 1, size))
        out = out.when(hit.isNotNull(), F.concat(hit, F.substring(piece, size + 1, 1 << 30)))
    out = out.otherwise(F.concat(F.lit("&"), piece))
    return F.when(F.startswith(piece, F.lit("#")), F.when(number != "", F.concat(_by_number(digits), after)).otherwise(
        F.concat(F.lit("&"), piece))).when(piece.rlike(r"\A[a-zA-Z]"), out).otherwise(F.concat(F.lit("&"), piece))


def clean_fences(c) -> Column:
    """H1: strip, drop a leading ```html fence (any case) and a trailing fence; null -> ''."""
    s = ustrip(F.coalesce(col_of(c), F.lit("")))
    s = F.regexp_replace(s, FENCE_OPEN, "")
    return F.regexp_replace(s, FENCE_CLOSE, "")


def unwrap_tags(c) -> Column:
    """H2: remove html/body/head/header/footer tags, keep their children."""
    return F.regexp_replace(col_of(c), DOC_TAGS, "")


def wrap_fragment(c, style: str = "", css_class: str = "product-description") -> Column:
    """H3: style block + one scoped div around the cleaned, unwrapped content;
    null input -> ''."""
    body = ustrip(unwrap_tags(clean_fences(c)))
    wrapped = F.concat(F.lit(style), F.lit(f'\n<div class="{css_class}">\n'), body, F.lit("\n</div>"))
    return F.when(col_of(c).isNull(), F.lit("")).otherwise(wrapped)


def _is_text(e: Column) -> Column:
    return ~F.startswith(e, F.lit("<")) | (e == "<")


def events(c) -> Column:
    """A page's events in order, as (``name``, ``raw``): texts have the name ''
    and their references resolved, tags their lower-case name (an end tag's with
    its slash, a raw element's as its start tag's), comments and declarations
    "!".  Compute once and derive the rest from it."""
    found = F.regexp_extract_all(col_of(c), F.lit(EVENT), F.lit(0))
    return F.transform(found, lambda e: F.when(_is_text(e), F.struct(F.lit("").alias("name"), decode_entities(e).alias("raw"))).otherwise(
        F.struct(F.coalesce(F.nullif(F.lower(F.regexp_extract(e, TAG, 1)), F.lit("")), F.lit("!")).alias("name"), e.alias("raw"))))


def tags_of(ev) -> Column:
    """The start and end tags among events."""
    return F.filter(col_of(ev), lambda e: ~e["name"].isin("", "!"))


def tag_names(ev) -> Column:
    """The names of events or tags in order."""
    return F.transform(col_of(ev), lambda e: e["name"])


def has_tag(names, *wanted: str) -> Column:
    """H5: any of ``wanted`` among a page's ``tag_names``."""
    return F.arrays_overlap(col_of(names), F.array(*[F.lit(n) for n in wanted]))


def count_tag(names, name: str) -> Column:
    return F.size(F.filter(col_of(names), lambda t: t == F.lit(name)))


def attribute_is(tag: Column, name: str, value: str) -> Column:
    """Does a tag carry attribute ``name`` with a value that holds a match of the
    pattern ``value``?  Other attributes are stepped over, values and all."""
    step = r"""(?:[\s/]++[^\s=>"'/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?)"""
    key = "".join(f"[{c.lower()}{c.upper()}]" for c in name)
    return tag.rlike(rf"""(?s)\A<[a-zA-Z][^\s/>]*+{step}{{0,200}}?[\s/]++{key}\s*+=\s*+(?:"[^"]*?(?:{value})|'[^']*?(?:{value})|[^\s"'>]*?(?:{value}))""")


def has_attribute(tag: Column, name: str) -> Column:
    """Does a tag carry attribute ``name``, with or without a value?"""
    step = r"""(?:[\s/]++[^\s=>"'/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?)"""
    return tag.rlike(rf"(?is)\A<[a-z][^\s/>]*+{step}{{0,200}}?[\s/]++{name}(?=[\s=/>])")


def decode_entities(c) -> Column:
    """Character references resolved: named ones (also the old names without
    ";"), decimal and hexadecimal ones.  Texts without "&" are passed through."""
    src = col_of(c)
    parts = F.split(src, "&")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), _reference)
    return F.when(F.contains(src, F.lit("&")), F.concat(parts[0], F.array_join(rest, ""))).otherwise(src)


def text_of(ev, lower: bool = True) -> Column:
    """H4: the texts among events, concatenated with no separator, optionally lower-cased."""
    t = F.array_join(F.transform(F.filter(col_of(ev), lambda e: e["name"] == ""), lambda e: e["raw"]), "")
    return F.lower(t) if lower else t


def visible_text(c, lower: bool = True) -> Column:
    """H4 from a page: comments and script, style and template bodies are left out."""
    return text_of(events(c), lower)


# One fold over a page's events: what is open, and what was found.
_OUTLINE = """
aggregate(
  filter(%s, x -> x.name IN ('', 'h2', '/h2', 'h3', '/h3', 'table', '/table', 'tr', '/tr', 'td', '/td', 'th', '/th', 'details', '/details', 'p')),
  named_struct('h2', cast(array() AS array<string>), 'h2_main', cast(array() AS array<string>), 'h3', cast(array() AS array<string>),
               'labels', cast(array() AS array<string>), 'pairs', 0, 'level', '', 'said', '', 'details', 0, 'table', 0, 'row', false,
               'cell', 0, 'label', '', 'after_h3', false),
  (a, x) -> named_struct(
    'h2', if(a.level = 'h2' AND x.name = '/h2', concat(a.h2, array(a.said)), a.h2),
    'h2_main', if(a.level = 'h2' AND x.name = '/h2' AND a.details = 0, concat(a.h2_main, array(a.said)), a.h2_main),
    'h3', if(a.level = 'h3' AND x.name = '/h3', concat(a.h3, array(a.said)), a.h3),
    'labels', if(a.table = 1 AND a.row AND x.name IN ('tr', '/tr', '/table'), concat(a.labels, array(a.label)), a.labels),
    'pairs', a.pairs + if(a.after_h3 AND x.name = 'p', 1, 0),
    'level', CASE WHEN a.level = '' AND x.name IN ('h2', 'h3') THEN x.name WHEN x.name = concat('/', a.level) THEN '' ELSE a.level END,
    'said', CASE WHEN a.level = '' THEN '' WHEN x.name = '' THEN concat(a.said, x.raw) ELSE a.said END,
    'details', CASE WHEN x.name = 'details' THEN a.details + 1 WHEN x.name = '/details' THEN greatest(a.details - 1, 0) ELSE a.details END,
    'table', CASE WHEN a.table = 0 AND x.name = 'table' THEN 1 WHEN a.table = 1 AND x.name = '/table' THEN 2 ELSE a.table END,
    'row', CASE WHEN a.table = 1 AND x.name = 'tr' THEN true WHEN x.name IN ('/tr', '/table') THEN false ELSE a.row END,
    'cell', CASE WHEN x.name = 'tr' THEN 0 WHEN a.table = 1 AND x.name IN ('td', 'th') THEN if(a.cell = 0, 1, 2)
                 WHEN a.cell = 1 AND x.name IN ('/td', '/th', '/tr', '/table') THEN 2 ELSE a.cell END,
    'label', CASE WHEN x.name = 'tr' THEN '' WHEN a.table = 1 AND a.cell = 1 AND x.name = '' THEN concat(a.label, x.raw) ELSE a.label END,
    'after_h3', CASE WHEN a.level = 'h3' AND x.name = '/h3' THEN true WHEN x.name = '' THEN a.after_h3 AND trim(BOTH '%s' FROM x.raw) = '' ELSE false END),
  a -> named_struct('h2', transform(a.h2, t -> trim(BOTH '%s' FROM t)), 'h2_main', transform(a.h2_main, t -> trim(BOTH '%s' FROM t)),
                    'h3', transform(a.h3, t -> trim(BOTH '%s' FROM t)), 'labels', transform(a.labels, t -> lower(trim(BOTH '%s' FROM t))),
                    'pairs', a.pairs))"""


def outline(ev: str) -> Column:
    """H6 and the layout's other parts, in one fold over the column of events
    named ``ev``: a struct of ``h2`` and ``h3`` (texts in order), ``h2_main`` (h2
    outside details), ``labels`` (first-cell texts of the first table's rows,
    lower-cased) and ``pairs`` (number of h3 elements that a p follows at once)."""
    blank = "".join(f"\\u{ord(c):04x}" for c in WS_CHARS)
    return F.expr(_OUTLINE % (ev, *[blank] * 5))


def base_name(c) -> Column:
    """H7: product name without dose/volume/form: cut at the first blank
    followed by a digit ("Aldazida 50mg + 50mg" -> "Aldazida")."""
    return ustrip(F.regexp_replace(col_of(c), r"(?s)" + WS_CLASS + r"+[0-9].*\z", ""))


def suffix_headings(html, base) -> Column:
    """H8: append " - {base}" to every h2 text; nothing else changes.
    ``$`` and ``\\`` in the name are escaped for the replacement string."""
    safe = F.regexp_replace(col_of(base), r"([\\$])", r"\\$1")
    return F.regexp_replace(col_of(html), F.lit(r"(?i)</h2>"), F.concat(F.lit(" - "), safe, F.lit("</h2>")))
