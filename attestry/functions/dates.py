"""Date rules. Each document family reads dates differently; they must not be merged.

A rule first rewrites the accepted layouts to year-month-day text with one pattern each, then
checks that text once, which keeps the generated code small.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry import dims
from attestry.functions.text import ascii_width, case_when, lookup, stripped

REFERENCE_DATE = "2024-02-01"


def _calendar(ymd: Column) -> Column:
    """ISO text of a real calendar day given as year-month-day, else NULL."""
    return F.try_to_date(ymd, "yyyy-M-d").cast("string")


def _rewritten(value: Column, *layouts: tuple[str, str]) -> Column:
    """Applies each layout in turn; text that fits none stays as it is and fails the later check."""
    for pattern, target in layouts:
        value = F.regexp_replace(value, pattern, target)
    return value


def _named_month(value: Column, pattern: str) -> Column:
    month = lookup(
        {m: str(i + 1) for i, m in enumerate(dims.MONTHS)},
        F.lower(F.substring(F.regexp_extract(value, pattern, 2), 1, 3)),
    )
    # no listed month name gives NULL
    return F.concat(F.regexp_extract(value, pattern, 3), F.lit("-"), month, F.lit("-"), F.regexp_extract(value, pattern, 1))


def lenient_date(value: Column) -> Column:
    """ISO, day-first or YYMMDD (pivot 30) with range checks only: 31 February passes."""
    in_range = r"^(?:19\d\d|20\d\d|2100)-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])$"
    iso = _rewritten(
        value,
        (r"^\s+|\s+$| ", ""),
        (r"^(\d{4})[/\-.]?(\d{2})[/\-.]?(\d{2})$", "$1-$2-$3"),
        (r"^(\d{2})[/\-.](\d{2})[/\-.](\d{4})$", "$3-$2-$1"),
        (r"^([3-9]\d)(\d{2})(\d{2})$", "19$1-$2-$3"),
        (r"^([0-2]\d)(\d{2})(\d{2})$", "20$1-$2-$3"),
    )

    def part(start: int, length: int) -> Column:
        return F.substring(value, start, length)

    # usual layouts are read by position; the patterns are for all other text and give the same for these
    century = F.when(value < "3", "20").otherwise("19")
    usual = case_when(
        [
            (value.rlike(r"^\d{2}[/\-.]\d{2}[/\-.]\d{4}\z"), F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2))),
            (value.rlike(r"^\d{6}\z"), F.concat_ws("-", F.concat(century, part(1, 2)), part(3, 2), part(5, 2))),
        ],
        iso,
    )
    # the only match or NULL; nullif would be written out with the text twice inside a condition
    checked = F.get(F.regexp_extract_all(usual, F.lit(in_range), F.lit(0)), F.lit(0))
    return F.when(value.rlike(in_range[:-1] + r"\z"), value).otherwise(checked)


def licence_date(value: Column) -> Column:
    """ISO, day-first or day-month-name with a four digit year; real calendar days only."""
    s = stripped(ascii_width(value))
    numeric = _rewritten(
        s,
        (r"^(\d{4})[-/. ](\d{1,2})[-/. ](\d{1,2})$", "$1-$2-$3"),
        (r"^(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4})$", "$3-$2-$1"),
    )
    named = _named_month(s, r"^(\d{1,2})[-/. ]([A-Za-z]{3,9})[-/. ](\d{4})$")
    return _calendar(F.coalesce(named, numeric))


def visa_date(value: Column) -> Column:
    """Comma and slash tolerant; a day and month name may sit anywhere in the text."""
    iso = _rewritten(
        value, ("[,/]", " "), (r"^\s+|\s+$", ""), (r"\s+", " "), (r"^(\d{4})[-\s](\d{1,2})[-\s](\d{1,2})$", "$1-$2-$3")
    )
    dmy = r"(\d{1,2})[.\-\s/](\d{1,2})[.\-\s/](\d{4})"
    months = "|".join(dims.MONTHS)
    named = _named_month(value, rf"(?i)(\d{{1,2}})[-\s]?((?:{months})[a-z]{{0,6}})[-\s]?(\d{{4}})")
    return F.when(iso.rlike(r"^\d{4}-"), _calendar(iso)).otherwise(
        _calendar(F.coalesce(named, F.regexp_replace(F.regexp_extract(value, dmy, 0), dmy, "$3-$2-$1")))
    )


def permit_date(value: Column) -> Column:
    s = stripped(value)
    full = "january february march april june july august september october november december".split()
    numeric = _rewritten(
        s,
        (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", "$1-$2-$3"),
        (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$", "$3-$2-$1"),
    )
    named = _named_month(s, rf"(?i)^(\d{{1,2}})[-/ ]+({'|'.join(full + dims.MONTHS)})[-/ ]+(\d{{4}})$")
    return _calendar(F.coalesce(named, numeric))


def full_birth_date(value: Column) -> Column:
    """A full day-first or ISO date found in the text."""
    dmy, ymd = r"(\d{2})[/.-](\d{2})[/.-](\d{4})", r"(\d{4})[/.-](\d{2})[/.-](\d{2})"
    first, second = F.regexp_extract(value, dmy, 0), F.regexp_extract(value, ymd, 0)
    return F.coalesce(
        _calendar(F.regexp_replace(F.nullif(first, F.lit("")), dmy, "$3-$2-$1")),
        _calendar(F.regexp_replace(F.nullif(second, F.lit("")), ymd, "$1-$2-$3")),
    )


def birth_year(value: Column) -> Column:
    """Year of the full date, else a bare year 1900-2029; day and month are never invented."""
    bare = F.nullif(F.regexp_extract(value, r"\b(19\d\d|20[0-2]\d)\b", 1), F.lit(""))
    return F.coalesce(F.substring(full_birth_date(value), 1, 4), bare).cast("int")


def mrz_date(value: Column, expiry: bool, reference: str = REFERENCE_DATE) -> Column:
    """YYMMDD of a machine readable zone as a DATE, NULL when it is no calendar day.

    Expiry years are 20YY. Birth years are 20YY unless that lies after the reference date.
    """
    s = stripped(value)

    def date_in(century: str) -> Column:
        return F.try_to_date(F.concat(F.lit(century), s), "yyyyMMdd")

    recent = date_in("20")
    if expiry:
        date = recent
    else:
        # a 20YY that is no calendar day is not retried in the last century
        this_century = F.concat(F.lit("20"), F.substring(s, 1, 2)) <= reference[:4]
        date = case_when(
            [
                (this_century & (recent <= F.lit(reference).cast("date")), recent),
                (this_century & recent.isNull(), F.lit(None).cast("date")),
            ],
            date_in("19"),
        )
    return F.when(s.rlike(r"^\d{6}$"), date)


def visual_date(value: Column) -> Column:
    """y-m-d of a printed date without leading zeros or calendar check; two digit years pivot at 50."""
    text = _rewritten(
        stripped(value),
        (r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$", "$1-$2-$3"),
        (r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$", "$3-$2-$1"),
        (r"^(\d{1,2})[/\-.](\d{1,2})[/\-.]([0-4]\d)$", "20$3-$2-$1"),
        (r"^(\d{1,2})[/\-.](\d{1,2})[/\-.]([5-9]\d)$", "19$3-$2-$1"),
    )
    return F.nullif(F.regexp_extract(F.regexp_replace(text, "-0", "-"), r"^\d{4}-\d{1,2}-\d{1,2}$", 0), F.lit(""))
