"""Row-local repairs of notation as Column expressions; they change how a value is written, not what it says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import CANONICAL_PERIOD, MONTHS, full_match, strip, text

# Currency marks, those before a number and those after it.
MARKS, CURRENCIES = "€$£", "euro|eur|usd"
DIGITS = "0123456789"


def _bare(c: Column) -> Column:
    """The text without outer white space, a currency mark before it and a currency after it; a text of nothing else stays."""
    return F.regexp_replace(text(c), rf"(?is)\A(?!\s*[{MARKS}]?\s*(?:{CURRENCIES})?\s*\z)\s*[{MARKS}]?\s*(\S.*?)\s*(?:{CURRENCIES})?\s*\z", "$1")


def _without_unit(t: Column) -> Column:
    """'2 unità' as '2': what stands before the first white space, if that is made like a number and the rest is one word."""
    return F.regexp_replace(t, r"\A(?=-?[\d.,]+\s+\p{L}+[.]?\z)(\S+).*\z", "$1")


def _ungrouped(t: Column, sign: str, point: str) -> Column:
    """A number without the signs that group its thousands, whole or up to a decimal point of the other kind; other text stays.

    The first match needs the groups up to the end, the later ones go on where the last one ended.
    """
    return F.regexp_replace(t, rf"(?:\A(-?\d{{1,3}})(?=(?:[{sign}]\d{{3}})+(?:[{point}]\d+)?\z)|\G(?!\A))[{sign}](\d{{3}})(?=[{sign}{point}]|\z)", "$1$2")


def normalize_number(c: Column) -> Column:
    """'€ 1.234,5', '6,0' or '2 unità' as a plain number's text; other text without outer white space and currency.

    The digits between separators decide what a separator means. One sign alone groups thousands if all groups behind it
    have three digits. Of two signs the one that stands last and once is the decimal one, if the other groups thousands. A
    single comma that groups no thousands is a decimal one. Every step takes the last one's result once, so that the
    expression stays as long as its steps.
    """
    t = _ungrouped(_ungrouped(_without_unit(_bare(c)), ".", ","), ",", ".")
    return F.regexp_replace(t, r"\A(-?\d+),(\d+)\z", "$1.$2")


def month_number(name: Column) -> Column:
    """'06' for a month's Italian or English name or its first three letters."""
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.substring(name, 1, 3)))


def normalize_date(c: Column) -> Column:
    """A date in any of the known layouts, or null. The text's shape, what is left without its digits, chooses the layout; it is read once.

    Of three numbers the one with four digits, or the last, is the year; two-digit years from 69 on are of the 20th century.
    The day stands before the month, but between blanks the month before the day, and either the other way round where one of
    them is over 12 and the year has four digits. A month's name, Italian or English, is the month wherever it stands. Eight
    digits are a date, six a year and month on its first day. A time may follow, with fractions, of which six digits count, and
    a Z for UTC.
    """
    t = text(c)
    d = F.regexp_extract_all(t, F.lit(r"\d+"), 0)
    at = lambda i: F.get(d, F.lit(i))
    size, number = (lambda i: F.length(at(i))), (lambda i: at(i).try_cast("int"))
    name = F.regexp_extract(t, r"(\p{L}{3,})", 1)
    shape = F.translate(F.regexp_replace(t, r"\p{L}{3,}", "M"), DIGITS, "")
    date = F.regexp_extract(shape, r"\A(M , |M  |[-/. ]{2}|[- ]M[- ]|[- ]M, )(?:[T ]:{1,2}\.?Z?)?\z", 1)
    named, compact = date.contains("M"), shape == ""
    first = F.when(named, 2).otherwise(3)  # the number that a time begins with
    clock = lambda i: F.coalesce(F.get(d, first + i).try_cast("int"), F.lit(0))
    seconds = F.concat(F.coalesce(F.get(d, first + 2), F.lit("0")), F.lit("."), F.coalesce(F.left(F.get(d, first + 3), F.lit(6)), F.lit("0"))).try_cast("decimal(16,6)")
    year_first = size(0) == 4
    full = F.when(named, F.greatest(size(0), size(1)) == 4).otherwise(F.when(year_first, size(2) <= 2).otherwise(size(2).isin(2, 4)) & (size(1) <= 2) & (year_first | (size(0) <= 2)))
    same = F.left(date, F.lit(1)) == F.right(date, F.lit(1))
    written = F.when(year_first, number(0)).when(size(2) == 2, number(2) + F.when(number(2) >= 69, 1900).otherwise(2000)).otherwise(number(2))
    swapped = (size(2) == 4) & F.when(F.left(date, F.lit(1)) == " ", number(0) <= 12).when(F.left(date, F.lit(1)) == ".", F.lit(False)).otherwise(number(1) > 12)
    month = F.when(year_first | ~swapped, number(1)).otherwise(number(0))
    day = F.when(year_first, number(2)).when(swapped, number(1)).otherwise(number(0))
    year = F.when(named, F.when(size(0) == 4, number(0)).otherwise(number(1))).otherwise(written)
    month = F.when(named, month_number(name).cast("int")).otherwise(month)
    day = F.when(named, F.when(size(0) == 4, number(1)).otherwise(number(0))).otherwise(day)
    digits = compact & t.rlike(r"\A(?:\d{8}|\d{6})\z")
    year, month = (F.when(digits, F.substring(t, a, n).try_cast("int")).otherwise(x) for x, a, n in ((year, 1, 4), (month, 5, 2)))
    day = F.when(digits, F.when(F.length(t) == 8, F.substring(t, 7, 2).try_cast("int")).otherwise(1)).otherwise(day)
    known = digits | ((date != "") & full & (named | (same & ~((size(2) == 2) & (F.left(date, F.lit(1)) == " ")))))
    zoned = F.try_make_timestamp(year, month, day, clock(0), clock(1), seconds, F.lit("UTC"))
    return F.when(known & shape.endswith("Z"), zoned).when(known, F.try_make_timestamp(year, month, day, clock(0), clock(1), seconds))


def normalize_period(c: Column) -> Column:
    """A year and month in any layout as yyyyMM; what has no month stays as it is.

    Of the two parts the one with four digits is the year; the other is the month, by number or by name.
    """
    t = strip(c)
    u = F.translate(t, "-/. ", "----")
    a, b = F.substring_index(u, "-", 1), F.substring_index(u, "-", -1)
    digits = lambda x: (x != "") & (F.translate(x, DIGITS, "") == "")
    two = (F.length(u) == F.length(a) + F.length(b) + 1) & digits(b)
    year_first = (F.length(a) == 4) & digits(a) & (F.length(b) <= 2)
    year, month = F.when(year_first, a).otherwise(b), F.when(year_first, b).otherwise(a)
    number = F.when(month.rlike("^[A-Za-z]{3,}$"), month_number(month)).when(digits(month) & (F.length(month) <= 2) & month.try_cast("int").between(1, 12), F.lpad(month, 2, "0"))
    return F.coalesce(F.when(full_match(t, CANONICAL_PERIOD), t), F.when(two & (F.length(year) == 4), F.concat(year, number)), text(c))


def is_period(c: Column) -> Column:
    return F.coalesce(full_match(strip(c), CANONICAL_PERIOD), F.lit(False))


def replace_values(c: Column, mapping: dict[str, str | None]) -> Column:
    """A small mapping of values; null deletes. A large one belongs into a table, see operators.repair.replace_from_table."""
    out = text(c)
    for old, new in reversed(mapping.items()):
        out = F.when(text(c) == old, F.lit(new)).otherwise(out)
    return out


def round_number(c: Column, digits: int, number: Column) -> Column:
    """Numbers rounded half to even, other values as they are."""
    return F.when(number.isNotNull(), F.bround(number, digits).cast("string")).otherwise(text(c))
