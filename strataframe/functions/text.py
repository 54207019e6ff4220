"""Text keys and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The letters that compare without case.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def natural_key(x: Column) -> Column:
    """A key that sorts digit runs by value and ASCII letters without case; use the raw text as a tiebreak.

    A run of digits of any length becomes 0, the number of its digits (without leading zeros) and the digits.
    """
    parts = F.regexp_extract_all(F.translate(x, _UPPER, _LOWER), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def sized(p: Column) -> Column:
        digits = F.regexp_replace(p, r"^0+([0-9])", "$1")
        return F.when(p.rlike(r"^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(p)

    return F.array_join(F.transform(parts, sized), "")


def quantity(x: Column, decimals: int = 0) -> Column:
    """Thousands separated, with fixed decimals."""
    return F.format_number(x, decimals)


def money(x: Column) -> Column:
    """Three significant figures with K, M or B; a minus sign goes first."""
    a = F.abs(x)
    unit = F.when(a >= 1e9, F.lit("B")).when(a >= 1e6, F.lit("M")).when(a >= 1e3, F.lit("K")).otherwise(F.lit(""))
    v = F.when(a >= 1e9, a / 1e9).when(a >= 1e6, a / 1e6).when(a >= 1e3, a / 1e3).otherwise(a)
    shown = F.when(v >= 100, F.format_string("%.0f", F.round(v, 0))).when(v >= 10, F.format_string("%.1f", F.round(v, 1))).otherwise(F.format_string("%.2f", F.round(v, 2)))
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), shown, unit)


def factor(x: Column) -> Column:
    """Rounded to three decimals; the third is printed only if it isn't 0."""
    return F.regexp_replace(F.format_string("%.3f", F.round(x, 3)), r"(\.\d\d)0$", "$1")


def factor_list(text: Column) -> Column:
    """The positive numbers of a list parted by commas, semicolons or blanks, to three decimals, ascending, each once; what is no number is passed over."""
    numbers = F.transform(F.split(text, r"[,;\s]+"), lambda x: F.round(x.try_cast("double"), 3))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & (x > 0))))


def plain(x: Column, decimals: int) -> Column:
    """Fixed decimals without trailing zeros; zero has no sign."""
    s = F.format_string(f"%.{decimals}f", F.round(x, decimals))
    s = F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(s == "-0", F.lit("0")).otherwise(s)


def header_key(x: Column) -> Column:
    """Lower case; anything but letters and digits left out."""
    return F.regexp_replace(F.lower(F.trim(x)), r"[^a-z0-9]+", "")


def hours(x: Column) -> Column:
    """Hours as h:mm, rounded to the minute."""
    minutes = F.round(x * 60).cast("long")
    return F.format_string("%d:%02d", F.floor(minutes / 60).cast("long"), F.pmod(minutes, F.lit(60)).cast("long"))


def csv_cell(x: Column, separator: str = ",") -> Column:
    """Quoted when it holds the separator, a quote or a line break; quotes are doubled."""
    return F.when(x.rlike(f'["\\r\\n{separator}]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def namespaced(space: str, x: Column) -> Column:
    return F.concat(F.lit(space), F.lit(":"), F.lower(F.trim(x)))


def level_label(x: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", x + F.lit(0.0))


def matches_terms(text: Column, query: str) -> Column:
    """Every whitespace-separated term of query occurs, in either case."""
    ok = F.lit(True)
    for term in query.lower().split():
        ok = ok & F.contains(F.lower(text), F.lit(term))
    return ok


def repaired(raw: Column) -> Column:
    """struct<text, repairs>: bytes as UTF-8, each ill-formed stretch as one replacement sign, and how many there are."""
    mark = "\ufffd"
    text = F.make_valid_utf8(raw.cast("string"))
    count = lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))
    own = F.length(F.hex(raw)) - F.length(F.regexp_replace(F.hex(raw), r"\G((?:..)*?)EFBFBD", "$1"))
    return F.struct(text.alias("text"), (count(text) - (own / 6).cast("int")).alias("repairs"))


def system_code(stored: Column) -> Column:
    """The registry code of a stored coordinate system, `EPSG:` and a number that fits two bytes; null otherwise."""
    code = F.regexp_extract(F.trim(stored), r"^(?:EPSG|epsg):\s*\+?([0-9]{1,9})\s*$", 1)
    number = F.when(code != "", code).cast("int")
    return F.when(number <= 65535, number)


def system_kind(stored: Column) -> Column:
    """unset, registry, definition (a parameter list, which begins with +), or unrecognised."""
    t = F.trim(F.coalesce(stored, F.lit("")))
    return F.when(t == "", "unset").when(system_code(t).isNotNull(), "registry").when(t.startswith("+"), "definition").otherwise("unrecognised")
