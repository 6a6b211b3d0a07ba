"""Text helpers with Python ``str`` semantics as JVM-side column expressions.

Spark's ``trim`` strips spaces only and ``split('')`` has size 1, while the
reference uses Python's ``str.strip()`` / ``str.split()``.  These helpers
reproduce Python's behaviour with one explicit whitespace class that both
Java regex and RE2 (the SQL oracle) read identically.  No Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from issuelens import config as C

# Characters for which Python's str.isspace() is true (fixed set).
PY_WS_CHARS = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
PY_NON_WS = f"[^{PY_WS_CHARS}]"
# The same set as literal characters, for trim / translate.
PY_WS_STRING = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                         *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

# Case-insensitive feature patterns; (?d) makes '.' stop only at '\n' as in Python.
HAS_CODE_RE = "(?i)" + C.CODE_PATTERN
HAS_IMAGE_RE = "(?id)" + C.IMAGE_PATTERN
HAS_URL_RE = "(?i)" + C.URL_PATTERN


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()`` (codegen'd trim over the whitespace set; O(ends), not O(length))."""
    return F.trim(col_(c), F.lit(PY_WS_STRING))


def py_word_count(c) -> Column:
    """``len(str(x).split())``; null -> 0.

    Every Python whitespace character is mapped to a space (``translate``),
    then split on the single space (a non-regex fast path) and the empty
    pieces dropped.  About 5x faster than a regex count over the text.
    """
    spaced = F.translate(col_(c), PY_WS_STRING, " " * len(PY_WS_STRING))
    return F.coalesce(F.size(F.array_remove(F.split(spaced, " ", -1), "")), F.lit(0)).cast("bigint")


def has_pattern(c, regex: str) -> Column:
    return F.coalesce(col_(c).rlike(regex), F.lit(False)).cast("int")


# A pattern is tried only on texts that hold characters which each of its matches has: finding these is much cheaper.
def _holds(c, *parts: str) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(col_(c), F.lit(p))
    return found


def has_code(c) -> Column:
    return F.coalesce(_holds(c, "`") & col_(c).rlike(HAS_CODE_RE), F.lit(False)).cast("int")


def has_image(c) -> Column:
    return F.coalesce(_holds(c, "![", "<") & col_(c).rlike(HAS_IMAGE_RE), F.lit(False)).cast("int")


def has_url(c) -> Column:
    return F.coalesce(_holds(c, "://") & col_(c).rlike(HAS_URL_RE), F.lit(False)).cast("int")


LABEL_SEP = "\u0001"


def whole_number(c: Column) -> Column:
    """A number written as integer, decimal or float text (``3``, ``3.0``) as bigint; ``nan`` and other text: null.

    Integers and decimals are read as such, so none above 2^53 changes; only other notations go through a double.
    """
    text = c.cast("string")
    d = text.try_cast("double")
    return F.coalesce(text.try_cast("bigint"), text.try_cast("decimal(38,10)").try_cast("bigint"), F.when(~F.isnan(d), d).try_cast("bigint"))


def label_array(c, dtype) -> Column:
    """Labels as an array of names, by type: names, objects with a ``name`` (missing: ``unknown``), comma text."""
    if isinstance(dtype, ArrayType):
        if isinstance(dtype.elementType, StructType):
            named = "name" in dtype.elementType.fieldNames()
            return F.transform(col_(c), lambda x: F.coalesce(x["name"].cast("string"), F.lit("unknown"))
                               if named else F.lit("unknown"))
        return col_(c).cast("array<string>")
    return F.when(col_(c).isNotNull(), split_trim_list(c))


def lowered_label_array(c) -> Column:
    """Lower-cased label list without lambdas (keeps the projection in codegen)."""
    return F.split(F.lower(F.array_join(F.coalesce(col_(c), F.array().cast("array<string>")), LABEL_SEP)), LABEL_SEP)


def any_label_in(labels: Column, names: list[str]) -> Column:
    """Exact membership of any label in a fixed set (``labels`` from ``lowered_label_array``)."""
    return F.coalesce(F.arrays_overlap(labels, F.array(*[F.lit(n) for n in names])), F.lit(False))


def split_trim_list(c, sep: str = ",") -> Column:
    """``[x.strip() for x in s.split(sep) if x.strip()]``; null -> empty list."""
    parts = F.transform(F.split(F.coalesce(col_(c), F.lit("")), sep, -1), lambda x: py_strip(x))
    return F.filter(parts, lambda x: x != "")


def percent0(c) -> Column:
    """Python ``f"{x:.0%}"`` (round half to even) for x in [0, 1]."""
    return F.concat(F.bround(col_(c) * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def percent(c, digits: int = 0) -> Column:
    """Python ``f"{x:.{digits}%}"`` (round half to even) for 0, 1 or 2 digits."""
    if not digits:
        return percent0(c)
    return F.concat(F.format_string(f"%.{digits}f", F.bround(col_(c) * 100, digits)), F.lit("%"))


def number0(c) -> Column:
    """Python ``f"{x:.0f}"`` (round half to even)."""
    return F.bround(col_(c), 0).cast("bigint").cast("string")


def title_case(c) -> Column:
    """Python ``str.title`` for words of letters: a letter after a non-letter is upper case, all others lower."""
    lowered = F.lower(col_(c))
    marked = F.regexp_replace(lowered, r"(?<![\p{L}])(\p{L})", "\u0001$1")
    parts = F.split(marked, "\u0001")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
                       lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x))))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))
