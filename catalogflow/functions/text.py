"""Scalar text helpers: Unicode strip, key normalisation, defaults, labels,
elapsed time and run stamps.  Every helper returns a Column built from
built-in functions so it stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import col_of

# Characters Python's str.strip() removes (str.isspace), written as a class
# that both Java regex and RE2 accept, so Spark code and SQL oracles agree.
WS_CLASS = (r"[\t\n\x{000B}\f\r\x{001C}-\x{001F} \x{0085}\x{00A0}\x{1680}"
            r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
STRIP_PATTERN = r"\A" + WS_CLASS + r"+|" + WS_CLASS + r"+\z"
# the same characters as a plain set, for trim(col, chars) (no regex)
WS_CHARS = "".join(chr(c) for c in [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680,
                                    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
# a whole key that is digits + ".0" (float-inferred), surrounded by blanks
FLOAT_KEY_PATTERN = r"\A" + WS_CLASS + r"*([0-9]+)\.0" + WS_CLASS + r"*\z"


def ustrip(c) -> Column:
    """Strip leading/trailing Unicode whitespace (plain ``trim`` strips spaces
    only); a character-set trim, linear and regex-free."""
    return F.trim(col_of(c), F.lit(WS_CHARS))


def has_text(c) -> Column:
    """True when the text holds any non-whitespace character (null -> False).
    Stops at the first visible character instead of stripping the whole text."""
    return F.coalesce(col_of(c).rlike("[^" + WS_CLASS[1:]), F.lit(False))


def blank_to_null(c) -> Column:
    """'' (after strip) -> null."""
    return F.nullif(ustrip(c), F.lit(""))


def normalize_key(c) -> Column:
    """Key as text: strip, drop a float-inferred trailing ``.0`` after digits,
    blank -> null.  Never goes through double (that would give 7.89E12)."""
    # one reference to the input keeps the generated code small when the
    # expression is inlined into filters and join keys
    s = F.regexp_replace(col_of(c).cast("string"), FLOAT_KEY_PATTERN, "$1")
    return F.nullif(ustrip(s), F.lit(""))


def strict_int_key(c) -> Column:
    """Integer key variant (legacy sheets): try_cast of the stripped text."""
    return ustrip(col_of(c).cast("string")).try_cast("bigint")


def default_if_empty(c, default) -> Column:
    """`x or default`: null *or* '' -> default."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(col_of(c), F.lit("")), d)


def default_if_missing(c, default) -> Column:
    """`.get(k, default)`: only null -> default ('' is kept)."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(col_of(c), d)


def flag_is(c, expected: str = "sim") -> Column:
    """Validation flag test: lower(strip(flag)) == expected; null fails."""
    return F.coalesce(F.lower(ustrip(col_of(c))) == F.lit(expected), F.lit(False))


def pretty_label(c) -> Column:
    """`no_h1_tag` -> `No H1 Tag` (Python str.title after '_' -> ' ')."""
    return F.initcap(F.replace(col_of(c), F.lit("_"), F.lit(" ")))


def elapsed_hms(ms) -> Column:
    """Milliseconds -> HH:MM:SS, hours not capped at 24."""
    m = col_of(ms).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(m / 3600000),
                           F.floor(m / 60000) % 60, F.floor(m / 1000) % 60)


def run_stamp(ts) -> Column:
    """Run-stamped name suffix `yyyyMMdd_HHmmss` from a passed-in timestamp."""
    return F.date_format(col_of(ts), "yyyyMMdd_HHmmss")
