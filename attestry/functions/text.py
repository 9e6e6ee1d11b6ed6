"""Column expressions for names, numbers and other identity text."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry import dims

# Full-width forms that Unicode compatibility folding maps to ASCII.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def case_when(pairs, otherwise=None) -> Column:
    """CASE over (condition, value) pairs, first true condition wins."""
    column = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        column = F.when(condition, value) if column is None else column.when(condition, value)
    if otherwise is None:
        return column
    return column.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def lookup(values: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a constant mapping, NULL when absent."""
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in values.items()) + ")")[key]


SPACES = " \t\n\r\f\v"


def stripped(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACES))


def without(value: Column, characters: str) -> Column:
    return F.translate(value, characters, "")


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def ascii_width(value: Column) -> Column:
    return F.translate(value, _WIDE, _PLAIN)


@lru_cache
def _folds() -> dict[str, str]:
    """Characters beyond ASCII that Unicode compatibility folding (NFKC) turns into ASCII text alone."""
    folded = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x80, sys.maxunicode + 1))
    return {c: t for c, t in folded if t.isascii()}


def compatibility_folded(value: Column) -> Column:
    """NFKC as far as its result is ASCII: ligatures, superscripts, roman and circled numerals, full width and the like.

    Folding is per character, and what it turns into ASCII never joins with a neighbour; any other character beyond
    ASCII stays, so a rule that accepts ASCII only decides as after the whole folding.
    """
    one = {c: t for c, t in _folds().items() if len(t) == 1}
    more = "\x02".join(f"{c}\x01{t}" for c, t in _folds().items() if len(t) > 1)
    short = F.translate(value, "".join(one), "".join(one.values()))
    longer = F.str_to_map(F.lit(more), F.lit("\x02"), F.lit("\x01"))
    spelt = F.array_join(F.transform(F.split(short, ""), lambda c: F.coalesce(longer[c], c)), "")
    return F.when(short.rlike("[^\\x00-\\x7F]"), spelt).otherwise(short)


def collapsed(value: Column) -> Column:
    return F.regexp_replace(stripped(value), r"\s+", " ")


def is_blank(value: Column) -> Column:
    return value.isNull() | (stripped(value) == "")


def document_type(value: Column) -> Column:
    key = F.lower(stripped(value))
    return F.coalesce(lookup(dims.TYPE_ALIASES, key), key)


def spaced_name(value: Column) -> Column:
    return collapsed(F.replace(F.upper(value), F.lit("<"), F.lit(" ")))


def person_name(value: Column) -> Column:
    return blank_to_null(spaced_name(value))


def name_tokens(value: Column) -> Column:
    """Sorted distinct tokens of a name, NULL when there are none."""
    return F.array_sort(F.array_distinct(F.split(person_name(value), " ")))


def sorted_letters(value: Column) -> Column:
    return F.array_join(F.array_sort(F.split(value, "")), "")


def name_letters(name: Column) -> Column:
    """Sorted letters of the distinct tokens of a ``person_name``: equal for all names that ``names_equal`` takes as equal."""
    letters = F.split(F.array_join(F.array_distinct(F.split(name, " ")), ""), "")
    return F.array_join(F.sort_array(letters), "")


def names_equal(a: Column, b: Column, strict: bool = False) -> Column:
    """Equal token sets, or equal once spaces are ignored.

    By default the second test compares the sorted letters of the distinct tokens, so any
    rearrangement of letters passes; ``strict`` keeps the letter order instead.
    """
    left, right = name_tokens(a), name_tokens(b)
    if strict:
        compact = F.replace(person_name(a), F.lit(" ")) == F.replace(person_name(b), F.lit(" "))
    else:
        compact = sorted_letters(F.array_join(left, "")) == sorted_letters(F.array_join(right, ""))
    return F.coalesce((left == right) | compact, F.lit(False))


def document_number(value: Column) -> Column:
    return blank_to_null(F.upper(without(value, SPACES)))


def index_number(value: Column) -> Column:
    """Form used for lookups: upper case without whitespace or separators."""
    return without(F.upper(value), SPACES + "-_/.")


def letters_and_digits(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def nationality(value: Column) -> Column:
    return blank_to_null(F.replace(F.upper(stripped(value)), F.lit("<"), F.lit("")))


def authority(value: Column) -> Column:
    return blank_to_null(F.upper(collapsed(value)))


def licence_number(value: Column) -> Column:
    """Licence number without separators; NULL for competing values or illegal characters."""
    return clean_licence_number(stripped(compatibility_folded(value)))


def clean_licence_number(clean: Column) -> Column:
    """``licence_number`` of text that is folded and stripped."""
    bad = clean.rlike(r"(?i)[A-Za-z0-9]{9,}\s+(?:OR|AND|VS)\s+[A-Za-z0-9]{9,}") | clean.rlike(r"[^A-Za-z0-9\s\-_/.]")
    return F.when(~bad, blank_to_null(F.upper(without(clean, SPACES + "-_/."))))


def state_name(code: Column) -> Column:
    return lookup(dims.STATE_NAMES, F.upper(stripped(code)))


def state_status(code: Column) -> Column:
    clean = F.upper(stripped(code))
    return case_when(
        [(clean.isin(*dims.LEGACY_STATES), "LEGACY"), (clean.isin(*dims.STATE_NAMES), "CURRENT")], "UNKNOWN"
    )


def states_equal(a: Column, b: Column) -> Column:
    """Same code, paired codes, or codes of the same state name."""
    return state_codes_equal(F.upper(stripped(a)), F.upper(stripped(b)))


def state_codes_equal(left: Column, right: Column) -> Column:
    """``states_equal`` for codes that are stripped and in upper case."""
    pair = F.concat(F.least(left, right), F.lit("="), F.greatest(left, right))
    pairs = ["=".join(sorted(p.split("="))) for p in dims.STATE_PAIRS]
    names = {k: v.upper() for k, v in dims.STATE_NAMES.items()}
    same_name = F.coalesce(lookup(names, left), left) == F.coalesce(lookup(names, right), right)
    known = (left != "") & (right != "")
    return F.coalesce(known & ((left == right) | pair.isin(*pairs) | same_name), F.lit(False))


def _trim_chars(value: Column, chars: str) -> Column:
    return F.regexp_replace(value, f"^[{chars}]+|[{chars}]+$", "")


def vehicle_class_items(value: Column) -> Column:
    """array<struct<code, known>>: a whole phrase if listed, else its tokens one by one."""
    item = "struct<code:string,known:boolean>"

    def token_items(part: Column) -> Column:
        tokens = F.transform(
            F.split(part, r"\s+"), lambda t: _trim_chars(F.upper(t), r" :.,;()\[\]")
        )
        tokens = F.filter(
            tokens,
            lambda t: (t != "")
            & ~t.isin(*dims.VEHICLE_STOPWORDS)
            & (t.isin(*dims.VEHICLE_CLASSES) | t.rlike(r"^[A-Z0-9\-/]{2,10}$")),
        )
        return F.transform(
            tokens,
            lambda t: F.struct(
                F.coalesce(lookup(dims.VEHICLE_CLASSES, t), t).alias("code"),
                t.isin(*dims.VEHICLE_CLASSES).alias("known"),
            ),
        )

    def part_items(part: Column) -> Column:
        phrase = _trim_chars(F.upper(F.regexp_replace(stripped(part), r"\s+", " ")), r" :.\-")
        whole = F.array(F.struct(lookup(dims.VEHICLE_CLASSES, phrase).alias("code"), F.lit(True).alias("known")))
        return F.when(phrase.isin(*dims.VEHICLE_CLASSES), whole).otherwise(token_items(stripped(part)))

    parts = F.split(stripped(ascii_width(value)), r"[,;\n\r]+")
    return F.coalesce(F.flatten(F.transform(parts, part_items)), F.array().cast(f"array<{item}>"))


def vehicle_classes(items: Column) -> Column:
    """Sorted distinct recognised classes of ``vehicle_class_items``."""
    known = F.filter(items, lambda i: i["known"])
    return F.array_sort(F.array_distinct(F.transform(known, lambda i: i["code"])))


def unknown_vehicle_classes(items: Column) -> Column:
    return F.transform(F.filter(items, lambda i: ~i["known"]), lambda i: i["code"])


def vehicle_class_set(value: Column) -> Column:
    """Canonical class set used when two records are compared; unknown tokens are kept."""
    compact = {k.translate(str.maketrans("", "", " .-_")): v for k, v in reversed(dims.VEHICLE_CLASSES.items())}
    tokens = F.transform(
        F.split(value, r"[,;/\n]+"), lambda t: F.regexp_replace(F.upper(t), r"[\s.\-_]+", "")
    )
    tokens = F.transform(F.filter(tokens, lambda t: t != ""), lambda t: F.coalesce(lookup(compact, t), t))
    return F.array_sort(F.array_distinct(tokens))


def class_set_relation(a: Column, b: Column) -> Column:
    """Relation of two class sets; NULL input counts as empty."""
    left = F.coalesce(F.size(a) > 0, F.lit(False))
    right = F.coalesce(F.size(b) > 0, F.lit(False))
    return case_when(
        [
            (~left & ~right, "NOT_COMPARED"),
            (~left, "MISSING_IN_DOCUMENT"),
            (~right, "MISSING_IN_REGISTRY"),
            (a == b, "MATCH"),
            (F.size(F.array_intersect(a, b)) == 0, "MISMATCH"),
        ],
        "PARTIAL_MATCH",
    )


def blood_group(value: Column) -> Column:
    clean = F.upper(stripped(ascii_width(value)))
    several = clean.rlike(r"\b(?:OR|AND|/)\b") & clean.rlike(r"\+|-|POS|NEG")
    for pattern, sign in (
        (r"\bPOSITIVE\b", "+"), (r"\bNEGATIVE\b", "-"), (r"\bPOS\.?\b", "+"), (r"\bNEG\.?\b", "-"),
        (r"\+\s*VE\b", "+"), (r"-\s*VE\b", "-"),
    ):
        clean = F.regexp_replace(clean, pattern, sign)
    compact = F.regexp_replace(clean, r"\s+", "")
    return F.when(~several & compact.isin(*dims.BLOOD_GROUPS), compact)


def permit_number(value: Column) -> Column:
    return blank_to_null(without(F.upper(value), SPACES + "-_/"))


def permit_number_ambiguous(value: Column) -> Column:
    """A letter stands where the sequence number should have digits."""
    clean, compact = F.upper(stripped(value)), permit_number(value)
    tail = F.right(clean, F.lit(6))
    doubtful = (
        clean.rlike(r"(?i)BP[- ]?(?:20\d{2}|19\d{2})[- ]?[0-9OIL]{6}") & tail.rlike("[OIBD]") & ~tail.rlike(r"^\d+$")
    )
    rest = case_when(
        [
            (compact.rlike(r"^BP\d{6,12}$"), F.lit(False)),
            (compact.startswith("BP") & (F.length(compact) >= 8), ~compact.rlike(r"^BP\d+$")),
        ],
        ~compact.rlike(r"^[A-Z0-9]+$"),
    )
    return F.coalesce(doubtful | rest, F.lit(False))


def permit_type(value: Column) -> Column:
    return F.coalesce(lookup(dims.PERMIT_TYPES, F.lower(stripped(value))), blank_to_null(F.upper(stripped(value))))


def holder_name(value: Column) -> Column:
    label = r"(?i)^(?:HOLDER\s*NAME|NAME|HOLDER)\s*[:.-]?\s*"
    return blank_to_null(F.upper(stripped(F.regexp_replace(collapsed(value), label, ""))))


def entries(value: Column) -> Column:
    c = F.upper(stripped(value))
    return case_when(
        [
            (c == "", F.lit(None).cast("string")),
            (c.contains("MULT") | (c == "M"), "MULTIPLE"),
            (c.contains("SING") | c.isin("S", "1"), "SINGLE"),
            (c.contains("DOUB") | (c == "2"), "DOUBLE"),
        ],
        c,
    )


def visa_number(value: Column) -> Column:
    return blank_to_null(letters_and_digits(value))


def visa_text(value: Column) -> Column:
    return blank_to_null(F.upper(collapsed(F.regexp_replace(value, r"[^\w\s\-.,/]", " "))))


def gender(value: Column) -> Column:
    """Document consistency only; never an input of risk."""
    c = F.upper(stripped(value))
    return case_when(
        [
            (c.isin("M", "MALE", "PURUSH", "MAN"), "MALE"),
            (c.isin("F", "FEMALE", "MAHILA", "WOMAN"), "FEMALE"),
            (c.isin("T", "TG", "TRANSGENDER", "OTHER"), "TRANSGENDER"),
            (c.rlike(r"\b(FEMALE|MAHILA)\b"), "FEMALE"),
            (c.rlike(r"\b(MALE|PURUSH)\b"), "MALE"),
            (c.rlike(r"\bTRANSGENDER\b"), "TRANSGENDER"),
        ]
    )


def address(value: Column) -> Column:
    label = r"(?i)^(ADDRESS|ADDR|PATTA|C/O|S/O|D/O|W/O)\s*[:\-,\s]*"
    clean = F.regexp_replace(F.regexp_replace(stripped(value), label, ""), r"\s+", " ")
    return blank_to_null(_trim_chars(clean, r" ,.\-"))


def national_id_error(value: Column) -> Column:
    """NULL for a well-formed 12 digit number, else the reason."""
    clean = without(value, SPACES + "-")
    return case_when(
        [
            (is_blank(value), "EMPTY_IDENTIFIER"),
            (value.rlike("[A-Za-z]"), "AMBIGUOUS_IDENTIFIER"),
            (~clean.rlike(r"^\d+$"), "NON_NUMERIC_IDENTIFIER"),
            (F.length(clean) != 12, "INVALID_LENGTH"),
            (clean.rlike("^[01]"), "INVALID_FIRST_DIGIT"),
        ]
    )


def national_id(value: Column) -> Column:
    unusable = national_id_error(value).isin("EMPTY_IDENTIFIER", "AMBIGUOUS_IDENTIFIER", "NON_NUMERIC_IDENTIFIER")
    return F.when(~F.coalesce(unusable, F.lit(False)), without(value, SPACES + "-"))


def pan_number(value: Column) -> Column:
    clean = without(F.upper(value), SPACES + "-")
    return blank_to_null(F.regexp_extract(clean, r"\b([A-Z]{5}[0-9]{4}[A-Z])\b", 1))


def pan_category(number: Column) -> Column:
    return F.when(number.isNotNull(), F.coalesce(lookup(dims.PAN_CATEGORIES, F.substring(number, 4, 1)), F.lit("Unknown")))


def voter_number(value: Column) -> Column:
    clean = without(F.upper(value), SPACES + "-")
    return blank_to_null(F.regexp_extract(clean, r"\b([A-Z]{3}[0-9]{7})\b", 1))


def keyed_hash(value: Column, secret: str) -> Column:
    """What leaves the engine instead of an identity value: equal values stay equal, the value stays unknown."""
    return F.sha2(F.concat(F.lit(secret + "|"), value), 256)


def masked(value: Column) -> Column:
    """Only the last four characters survive."""
    clean = without(value, SPACES + "-")
    return case_when(
        [
            (F.coalesce(value, F.lit("")) == "", ""),
            (F.length(clean) >= 4, F.concat(F.lit("XXXX XXXX "), F.right(clean, F.lit(4)))),
        ],
        "XXXX XXXX XXXX",
    )
