"""Scalar predicates and conversions: Columns to Columns, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\x0b\x0c"
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
#: spellings of dates, each with the shape of all texts that it may fit
DATE_FORMATS = {
    "yyyy-M-d": "^[+-]?[0-9]+-[+-]?[0-9]+-[+-]?[0-9]+$",
    "d.M.yyyy": "^[+-]?[0-9]+[.][+-]?[0-9]+[.][+-]?[0-9]+$",
    "d/M/yyyy": "^[+-]?[0-9]+/[+-]?[0-9]+/[+-]?[0-9]+$",
    "yyyyMMdd": "^[+-]?[0-9]+$",
}

# fixed values: texts that count as missing, and code lists
MISSING = ("", "none", "nan", "nat", "n/a", "na", "not available", "not applicable")
BLANKS = ("", "None", "nan")
BOOLEAN_TEXTS = ("True", "False", "true", "false", "TRUE", "FALSE", "1", "0")
CURRENCIES = (
    "EUR USD GBP CHF JPY SEK NOK DKK PLN CZK HUF RON BGN HRK ISK TRY AUD CAD CNY HKD "
    "SGD KRW INR BRL MXN ZAR RUB SAR AED THB IDR MYR NZD TWD ILS EGP NGN PKR BDT VND "
    "CLP COP ARS PEN UAH KZT QAR KWD BHD OMR MAD TND DZD XOF XAF GHS KES TZS UGX ETB "
    "XDR XAU XAG"
).split()
COUNTRIES = (
    "AT BE BG CY CZ DE DK EE ES FI FR GR HR HU IE IT LT LU LV MT NL PL PT RO SE SI SK "
    "AL BA BY CH GB IS LI MD ME MK NO RS RU TR UA XK US JP CN IN BR CA AU SG HK KR "
    "SA AE ZA NG EG KE MA MX AR CL CO"
).split()
ISO_DATE_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ \t\n\r\f\x0b][0-9]{2}:[0-9]{2}:[0-9]{2})?$"
ISIN_STRICT = "^[A-Z]{2}[A-Z0-9]{9}[0-9]$"
ISIN_LOOSE = "^[A-Z]{2}[A-Z0-9]{10}$"
LEI = "^[0-9A-Z]{20}$"
SUBDIVISION = "^[A-Z]{2}-[A-Z0-9]{1,3}$"
ALPHA2 = "^[A-Z]{2}$"
BIC = "^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?$"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def is_missing(c: Column) -> Column:
    """Null, or one of the eight texts for missing, whatever their case and outer white space."""
    return c.isNull() | F.lower(stripped(c)).isin(*MISSING)


def blank_to_null(c: Column) -> Column:
    """Exactly '', 'None' and 'nan' become null."""
    return F.when(~c.isin(*BLANKS), c)


def number(c: Column) -> Column:
    """A double, or null where the text is not a plain decimal number (no suffixes, infinities or underscores)."""
    return F.when(stripped(c).rlike(NUMBER), stripped(c).try_cast("double"))


def decimal_comma_double(c: Column) -> Column:
    """The comma is a decimal point; missing and unparsable texts are null."""
    return F.when(~is_missing(c), number(F.replace(c, F.lit(","), F.lit("."))))


def grouped_double(c: Column) -> Column:
    """Commas group digits."""
    return number(F.replace(c, F.lit(","), F.lit("")))


def is_numeric(c: Column) -> Column:
    return grouped_double(F.replace(c, F.lit(" "), F.lit(""))).isNotNull()


def parse_date(c: Column) -> Column:
    """The first of four spellings that fits; missing, impossible and other texts are null.

    Only texts of a spelling's shape are parsed: a text that does not parse costs
    an exception inside Spark.
    """
    parsed = [F.when(stripped(c).rlike(shape), F.try_to_timestamp(stripped(c), F.lit(f))) for f, shape in DATE_FORMATS.items()]
    return F.when(~is_missing(c), F.coalesce(*parsed).cast("date"))


def is_iso_date_text(c: Column) -> Column:
    """Shape only: 2024-02-30 passes."""
    return c.rlike(ISO_DATE_TEXT)


def is_isin(c: Column, strict: bool = True) -> Column:
    return c.rlike(ISIN_STRICT if strict else ISIN_LOOSE)


def is_lei(c: Column, fold_case: bool = True) -> Column:
    return (F.upper(c) if fold_case else c).rlike(LEI)


def is_country(c: Column, listed: bool = True) -> Column:
    """A listed code or a subdivision, in either case; unlisted: two capitals."""
    return F.upper(c).isin(*COUNTRIES) | F.upper(c).rlike(SUBDIVISION) if listed else c.rlike(ALPHA2)


def is_currency(c: Column) -> Column:
    return F.upper(c).isin(*CURRENCIES)


def is_bic(c: Column) -> Column:
    return c.rlike(BIC)


def is_bool_text(c: Column) -> Column:
    return c.isin(*BOOLEAN_TEXTS)


def is_finite(n: Column) -> Column:
    """Neither null nor beyond the largest double, as ``1e999`` is."""
    return F.coalesce(F.abs(n) < F.lit(float("inf")), F.lit(False))


def is_integer_text(c: Column) -> Column:
    """Can be cut to an integer, so '1.7' passes and '1e999' does not."""
    return is_finite(grouped_double(c))


def issue_value(c: Column) -> Column:
    return F.substring(F.coalesce(c.cast("string"), F.lit("")), 1, 200)
