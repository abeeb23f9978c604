"""Keys taken from the sample-date text (``Apr 1, 2013``).

They are string functions on purpose: a date parser would lose texts such as
``Feb 30, 2020`` that have a day key and a week key all the same.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidetally.schema import MONTHS, OTHER_YEAR

TIME_UNITS = ["daily", "weekly", "monthly", "yearly"]
_DAY_OF_A_MONTH = r"^\d{4}-\d{2}-(0[1-9]|[12]\d|3[01])$"
_WEEK_TEXT = r"^(\d{4})-?W?(\d{1,2})$"


def year_of(sample_date: Column) -> Column:
    """Last four characters, compared as text everywhere."""
    return F.right(sample_date, F.lit(4))


def survey_year(sample_date: Column) -> Column:
    """Partition value: the year, or one marker for all dates without a plain year."""
    year = year_of(sample_date)
    return F.when(year.rlike(r"^\d{4}$"), year).otherwise(OTHER_YEAR)


def _of_month(sample_date: Column, values: list[int] | list[str]) -> Column:
    pairs = [F.lit(item) for pair in zip(MONTHS, values, strict=True) for item in pair]
    return F.try_element_at(F.create_map(*pairs), F.substring(sample_date, 1, 3))


def month_no(sample_date: Column) -> Column:
    """1 to 12 by the case-sensitive three-letter prefix, else NULL."""
    return _of_month(sample_date, list(range(1, 13)))


def month_text(sample_date: Column) -> Column:
    return _of_month(sample_date, [f"{number:02d}" for number in range(1, 13)])


def day_text(sample_date: Column) -> Column:
    """Two characters: what stands between position 5 and the comma, zero-padded.

    With the comma missing or before position 5 it is the text from the comma
    up to position 4, the backward reading of a negative substring length.
    """
    comma = F.instr(sample_date, ",")
    start = F.greatest(comma, F.lit(1))
    between = F.when(
        comma >= 5, F.substring(sample_date, F.lit(5), comma - F.lit(5))
    ).otherwise(F.substring(sample_date, start, F.lit(5) - start))
    return F.right(F.concat(F.lit("0"), between), F.lit(2))


def date_text(sample_date: Column) -> Column:
    """``YYYY-MM-DD``; NULL where the month is unknown."""
    dash = F.lit("-")
    return F.concat(
        year_of(sample_date), dash, month_text(sample_date), dash, day_text(sample_date)
    )


def calendar_date(day: Column) -> Column:
    """The date of a ``YYYY-MM-DD`` text; a day past the end of its month runs on."""
    first = F.make_date(
        F.substring(day, 1, 4).try_cast("int"), F.substring(day, 6, 2).try_cast("int"), F.lit(1)
    )
    return F.when(
        day.rlike(_DAY_OF_A_MONTH), F.date_add(first, F.substring(day, 9, 2).try_cast("int") - 1)
    )


def week_of(date: Column) -> Column:
    """``YYYY-Wnn`` with Monday weeks, week 00 before the first Monday."""
    week = F.floor((F.dayofyear(date) + 6 - F.weekday(date)) / 7)
    return F.concat(
        F.lpad(F.year(date).cast("string"), 4, "0"),
        F.lit("-W"),
        F.lpad(week.cast("string"), 2, "0"),
    )


def week_key(day: Column) -> Column:
    """The week of a ``YYYY-MM-DD`` text, NULL where it names no day."""
    return week_of(calendar_date(day))


def period_key(sample_date: Column, time_unit: str | None = "yearly") -> Column:
    """Group key of a trend; anything but daily, weekly or monthly means yearly."""
    match time_unit:
        case "daily":
            return date_text(sample_date)
        case "weekly":
            return week_key(date_text(sample_date))
        case "monthly":
            return F.concat(year_of(sample_date), F.lit("-"), month_text(sample_date))
        case _:
            return year_of(sample_date)


def with_period(df: DataFrame, time_unit: str | None) -> DataFrame:
    """Adds ``period`` from ``sample_date``.

    The weekly key uses its intermediate values several times, so they get
    columns of their own instead of being worked out at every use.
    """
    sample_date = F.col("sample_date")
    if time_unit != "weekly":
        return df.withColumn("period", period_key(sample_date, time_unit))
    return (
        df.withColumn("day", date_text(sample_date))
        .withColumn("date", calendar_date(F.col("day")))
        .withColumn("period", week_of(F.col("date")))
        .drop("day", "date")
    )


def _month_week(year: Column, date: Column) -> Column:
    return F.concat(
        year,
        F.lit("-"),
        F.month(date).cast("string"),
        F.lit("-w"),
        F.ceil(F.dayofmonth(date) / 7).cast("string"),
    )


def week_label(period: Column) -> Column:
    """Axis label of a weekly key: ``year-month-w(week of the month)``.

    The key is read as an ISO week and its Monday names the month, so labels
    move against the keys in some years. Never join on labels.
    """
    year = F.regexp_extract(period, _WEEK_TEXT, 1)
    week = F.regexp_extract(period, _WEEK_TEXT, 2).try_cast("int")
    jan4 = F.make_date(year.try_cast("int"), F.lit(1), F.lit(4))
    monday = F.date_add(F.trunc(jan4, "week"), (week - 1) * 7)
    day = F.try_to_date(period, "yyyy-MM-dd")
    return (
        F.when(period.rlike(_WEEK_TEXT), _month_week(year, monday))
        .when(
            period.rlike(r"^\d{4}-\d{2}-\d{2}$") & day.isNotNull(),
            _month_week(F.year(day).cast("string"), day),
        )
        .otherwise(period)
    )
