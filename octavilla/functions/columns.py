"""Small column helpers shared by every plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters folded when comparing text.
ACCENTED = "áàäâãéèëêíìïîóòöôõúùüûñç"
PLAIN = "aaaaaeeeeiiiiooooouuuunc"


def half_up(c: Column, digits: int) -> Column:
    """Half-up rounding of the decimal reading of a double."""
    return F.round(c.cast("decimal(38,10)"), digits).cast("double")


def percentage(part: Column, whole: Column, digits: int = 1) -> Column:
    """``100 * part / whole``; NULL where the whole is zero or NULL."""
    ratio = F.lit(100).cast("double") * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return half_up(ratio, digits)


def is_blank(c: Column) -> Column:
    """NULL, empty or only spaces."""
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def replace_all(c: Column, rules) -> Column:
    """Applies ordered (pattern, replacement) pairs."""
    return reduce(lambda acc, r: F.regexp_replace(acc, r[0], r[1]), rules, c)


def is_any(c: Column, patterns) -> Column:
    """True where one of the patterns is found; one regular expression per call."""
    return F.coalesce(c.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def safe_url(c: Column) -> Column:
    """Trimmed http(s) address without inner spaces, otherwise NULL."""
    t = F.trim(c)
    return F.when(t.rlike(r"(?i)^https?://\S+$"), t)


def truncate_text(c: Column, n: int = 200) -> Column:
    return F.substring(c, 1, n)


def parse_date(c: Column) -> Column:
    """Strict ``yyyy-MM-dd``; anything else is NULL."""
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(c, "yyyy-M-d"))


def parse_timestamp(c: Column) -> Column:
    """ISO timestamp or date; anything else is NULL."""
    iso = c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$")
    return F.when(iso, c.try_cast("timestamp_ntz"))


def page_number(c: Column) -> Column:
    """First run of digits in a file name, 0 without one."""
    return F.coalesce(F.regexp_extract(c, r"(\d+)", 1).try_cast("int"), F.lit(0))


def display_name(slug: Column) -> Column:
    """``soriana_hiper`` becomes ``Soriana Hiper``."""
    return F.initcap(F.translate(slug, "_", " "))


def compact_slug(c: Column) -> Column:
    """Only the letters and digits of the folded text."""
    return F.regexp_replace(fold(c), r"[^a-z0-9]", "")


def folder_slug(c: Column) -> Column:
    """Folded text with one underscore per run of spaces."""
    return F.regexp_replace(F.trim(fold(c)), r"\s+", "_")


def hash_order(*parts: Column) -> Column:
    """Reproducible pseudo-random ordering key."""
    return F.md5(F.concat_ws("|", *parts))


def sha_order(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def same_cents(a: Column, b: Column) -> Column:
    """Prices equal to the cent."""
    return F.coalesce(F.abs(a - b) < 0.01, F.lit(False))


def same_cents_or_both_null(a: Column, b: Column) -> Column:
    return (a.isNull() & b.isNull()) | same_cents(a, b)
