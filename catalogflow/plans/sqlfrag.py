"""SQL fragments (DuckDB dialect) mirroring the column helpers, used by the
oracle queries.  Regex classes are shared with the Spark helpers so the two
sides agree character for character."""

from ..functions.text import STRIP_PATTERN


def ustrip(e: str) -> str:
    return f"regexp_replace({e}, '{STRIP_PATTERN}', '', 'g')"


def norm_key(e: str) -> str:
    s = ustrip(f"CAST({e} AS VARCHAR)")
    return (f"nullif(CASE WHEN regexp_matches({s}, '^[0-9]+\\.0$') "
            f"THEN substring({s}, 1, length({s}) - 2) ELSE {s} END, '')")


def blank_to_null(e: str) -> str:
    return f"nullif({ustrip(e)}, '')"


def flag_is(e: str, expected: str = "sim") -> str:
    return f"coalesce(lower({ustrip(e)}) = '{expected}', false)"


# --- HTML ----------------------------------------------------------------
# Patterns of the oracles' own.  They read plain markup (no ">" inside a tag,
# letters instead of references), which is how the twin of every made page is
# written and how the given pages are; the library reads the pages themselves.
from ..functions import html as H  # noqa: E402
from ..functions.text import STRIP_PATTERN as _STRIP, WS_CLASS as _WS  # noqa: E402

PLAIN_TAG = "<[^>]*>"
PLAIN_HIDDEN = "(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
# the references that the given pages use; a cut-off one at a title's end has no ";"
PLAIN_REFERENCES = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&amp", "&")]


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx_replace(e: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({e}, {lit(pattern)}, {lit(repl)}, 'g')"


def markup(e: str) -> str:
    return rx_replace(e, PLAIN_HIDDEN)


def decode(e: str) -> str:
    # one pass: each reference becomes a sign that no page holds, then its letter
    for i, (ref, _) in enumerate(PLAIN_REFERENCES):
        e = f"replace({e}, {lit(ref)}, chr({57344 + i}))"
    for i, (_, ch) in enumerate(PLAIN_REFERENCES):
        e = f"replace({e}, chr({57344 + i}), {lit(ch)})"
    return e


def text_of_markup(m: str) -> str:
    return f"lower({decode(rx_replace(m, PLAIN_TAG))})"


def has_tag(m: str, *names: str) -> str:
    return f"coalesce(regexp_matches({m}, {lit('(?i)<(' + '|'.join(names) + ')[ />]')}), false)"


def count_tag(m: str, name: str) -> str:
    return f"len(regexp_extract_all({m}, {lit('(?i)<' + name + '[ />]')}))"


def headings(m: str, level: int = 2) -> str:
    pat = rf"(?is)<h{level}( [^>]*)?>(.*?)</h{level}>"
    return (f"list_transform(regexp_extract_all({m}, {lit(pat)}, 2), "
            f"lambda h: {rx_replace(rx_replace('h', PLAIN_TAG), _STRIP)})")


def base_name(e: str) -> str:
    return ustrip(rx_replace(e, r"(?s)" + _WS + r"+[0-9].*\z"))


def clean_fences(e: str) -> str:
    s = ustrip(f"coalesce({e}, '')")
    return rx_replace(rx_replace(s, H.FENCE_OPEN), H.FENCE_CLOSE)
