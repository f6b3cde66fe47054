"""Recognition and coercion of text values, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that stand for no value, date shapes, currency signs, words for true and false.
NULL_TOKENS = ["", "null", "none", "n/a", "na", "-", "--", "---", ".", "..", "nan"]
SPREADSHEET_ERRORS = ["#n/a", "#na", "#ref!", "#value!", "#null!"]
DATE_SHAPES = [r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}\.\d{2}\.\d{4}", r"\d{2}-\w{3}-\d{4}", r"\w+\s+\d{1,2},?\s+\d{4}", r"\d{1,2}\.\d{2}\.\d{4}"]
CURRENCY = "[$€£¥₹]"
TRUE_WORDS, FALSE_WORDS = ["true", "yes", "1", "y"], ["false", "no", "0", "n"]
BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0"]
SUMMARY_WORDS = ["total", "sum", "average", "count", "grand total", "subtotal"]

_DIGITS = r"[0-9]+(_[0-9]+)*"
_INTEGER = rf"^[+-]?{_DIGITS}$"
_FLOAT = rf"(?i)^[+-]?(({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})(e[+-]?{_DIGITS})?|inf|infinity|nan)$"


def stripped(value: Column) -> Column:
    """Without white space at both ends (line ends and tabs too)."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def is_null_token(value: Column, strict: bool = False) -> Column:
    """Stands for no value. Upper-case spreadsheet errors count only if ``strict``: the usual comparison lower-cases the value alone."""
    return F.lower(stripped(value)).isin(NULL_TOKENS + (SPREADSHEET_ERRORS if strict else []))


def _plain(value: Column, currency: bool) -> Column:
    v = stripped(value)
    if currency:
        v = F.regexp_replace(v, CURRENCY, "")
    v = F.regexp_replace(v, "[, ]", "")
    return F.regexp_replace(v, "%+$", "") if currency else v


def is_integer(value: Column) -> Column:
    return _plain(value, False).rlike(_INTEGER)


def is_numeric(value: Column) -> Column:
    return stripped(_plain(value, True)).rlike(_FLOAT)


def is_date(value: Column) -> Column:
    return value.rlike("(?U)" + "|".join(DATE_SHAPES))


def is_boolean(value: Column) -> Column:
    return F.lower(stripped(value)).isin(BOOLEAN_WORDS)


def to_number(value: Column) -> Column:
    """The number that a text with currency signs, thousands separators or a percent sign stands for; null if none."""
    v = stripped(value)
    percent = v.endswith("%")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, CURRENCY, ""), "[, ]", ""), "%$", "")
    number = F.when(plain.rlike(_FLOAT), F.regexp_replace(plain, "_", "").try_cast("double"))
    return F.when(percent, number / 100).otherwise(number)


def to_integer(value: Column) -> Column:
    """As to_number, cut to whole."""
    number = to_number(value)
    return F.when(~F.isnan(number) & (F.abs(number) < 9.2e18), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))).cast("long")


def to_boolean(value: Column) -> Column:
    v = F.lower(stripped(value))
    return F.when(v.isin(TRUE_WORDS), True).when(v.isin(FALSE_WORDS), False)


def to_array(value: Column) -> Column:
    """A JSON array's items, or the value alone."""
    return F.coalesce(F.from_json(value, "array<string>", {"mode": "PERMISSIVE"}), F.array(value))


def to_date(value: Column) -> Column:
    """A date in one of the usual formats."""
    out = None
    for fmt in ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy", "d.MM.yyyy", "dd-MMM-yyyy", "MMMM d, yyyy", "MMMM d yyyy"):
        one = F.try_to_timestamp(stripped(value), F.lit(fmt)).cast("date")
        out = one if out is None else F.coalesce(out, one)
    return out


def type_of_shares(n: Column, booleans: Column, integers: Column, numbers: Column, dates: Column) -> Column:
    """The inferred type of a column from how many of its n values look like each."""
    return F.when(n == 0, "null").when(booleans / n >= 0.8, "boolean").when(integers / n >= 0.8, "integer").when(numbers / n >= 0.8, "float").when(dates / n >= 0.5, "date").otherwise("string")
