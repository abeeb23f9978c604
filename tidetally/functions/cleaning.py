"""Lenient casts, area clean-up and the hash that detects a changed record."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidetally.schema import NO_AREA, VALUES

# Every character that counts as blank at the ends of a text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_AROUND = rf"[{BLANKS}]*"
_DIGITS = r"\d+(?:_\d+)*"
INT_TEXT = rf"^{_AROUND}[+-]?{_DIGITS}{_AROUND}$"
FLOAT_TEXT = (
    rf"^{_AROUND}(?:"
    rf"[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    rf"|[+-]?(?i:inf|infinity)|(?i:nan)){_AROUND}$"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _bare(text: Column) -> Column:
    """Number text without blanks and digit separators (none are left inside it)."""
    return F.translate(text, "_" + BLANKS, "")


def safe_float(text: Column) -> Column:
    """A double, or NULL where the text is blank or no number.

    The pattern keeps out what Spark's cast would take but the survey rules
    do not (``1.5f``, hexadecimal floats).
    """
    return F.when(text.rlike(FLOAT_TEXT), _bare(text).try_cast("double"))


def safe_int(text: Column) -> Column:
    """A bigint, or NULL where the text is blank or no whole number (``3.0`` is none)."""
    return F.when(text.rlike(INT_TEXT), _bare(text).try_cast("bigint"))


def normalize_area(text: Column) -> Column:
    """The area without blanks around it; every spelling of "none" becomes ``''``."""
    bare = F.coalesce(strip(text), F.lit(""))
    return F.when(bare.isin(NO_AREA), F.lit("")).otherwise(bare)


def float_text(number: Column) -> Column:
    """The text of a double as hashed: ``2.0``, ``0.25``, ``nan``, ``inf``, ``None``.

    From 10 million up and below 0.001 Spark writes an exponent (``1.0E7``).
    """
    return (
        F.when(number.isNull(), "None")
        .when(F.isnan(number), "nan")
        .when(number == float("inf"), "inf")
        .when(number == float("-inf"), "-inf")
        .otherwise(number.cast("string"))
    )


def data_hash(values: list[Column] | None = None) -> Column:
    """First 16 hex digits of the SHA-256 over the eight catch values."""
    columns = [F.col(name) for name in VALUES] if values is None else values
    return F.substring(F.sha2(F.concat_ws("|", *map(float_text, columns)), 256), 1, 16)


def stored_float(number: Column) -> Column:
    """NaN is kept as NULL in the table (the hash still sees it)."""
    return F.when(~F.isnan(number), number)
