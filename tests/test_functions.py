import random
import sqlite3
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidetally.functions import cleaning, dates, labels, measures
from tidetally.schema import MONTHS, VALUES


def mapped(spark, texts, function, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    rows = df.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()
    return [row.v for row in rows]


def as_float(text):
    try:
        return float(text) if text and text.strip() else None
    except ValueError:
        return None


def as_int(text):
    try:
        return int(text) if text and text.strip() else None
    except ValueError:
        return None


NUMBERS = (
    ["3", " 3 ", "3.0", "1,234", "", "+4", "2.50", " ", "abc", "1.0d", "1.5f", "1e3", "-7", "--7"]
    + ["inf", "-Infinity", "1_000", "1__0", "0x1p3", None, ".5", "5.", "5e", ".", "\t8\n", "1e-2"]
    + [" 9 ", "9" * 18]
)


def test_lenient_casts(spark):
    assert mapped(spark, NUMBERS, cleaning.safe_float) == [as_float(t) for t in NUMBERS]
    assert mapped(spark, NUMBERS, cleaning.safe_int) == [as_int(t) for t in NUMBERS]
    assert all(str(v) == "nan" for v in mapped(spark, ["nan", " NaN "], cleaning.safe_float))


def test_int_beyond_bigint_is_null(spark):
    assert mapped(spark, ["9" * 30], cleaning.safe_int) == [None]


def test_normalize_area(spark):
    texts = [None, "", "N/A", " NA ", "null", "n/a", "\t", " Area 4, East "]
    assert mapped(spark, texts, cleaning.normalize_area) == [""] * 7 + ["Area 4, East"]


def test_data_hash(spark):
    schema = ", ".join(f"{name} double" for name in VALUES)
    df = spark.createDataFrame([(1.0, 0.25, None, 0.0, None, 2.0, None, None)], schema)
    assert df.select(cleaning.data_hash().alias("h")).first().h == "2aeffda25b4d0bf8"


def test_float_text_is_the_shortest(spark):
    rng = random.Random(3)
    numbers = [0.0, -0.5, 9999999.0, 0.001] + [
        round(rng.random() * 10 ** rng.randint(0, 6), rng.randint(0, 4)) for _ in range(3000)
    ]
    numbers = [n for n in numbers if n == 0 or abs(n) >= 0.001]
    assert mapped(spark, numbers, cleaning.float_text, "double") == [str(n) for n in numbers]


def test_nan_is_hashed_but_not_stored(spark):
    number = spark.createDataFrame([("nan",)], "t string").select(
        cleaning.safe_float(F.col("t")).alias("n")
    )
    row = number.select(
        cleaning.float_text(F.col("n")).alias("text"), cleaning.stored_float(F.col("n")).alias("n")
    ).first()
    assert (row.text, row.n) == ("nan", None)


ODD_DATES = (
    ["Apr 1, 2013", "April 1, 2013", "apr 1, 2013", "", "ab", "Apr 2013", "Apr,2013", "A,", "Ap,x"]
    + [",", "Feb 30, 2020", "Feb 29, 2019", "Jan 5, 2025", "Jan 6, 2025", "Dec 31, 2024", None]
    + ["Apr 00, 2013", "Apr 32, 2013", "Apr 7, 13", "Apr  7, 2013", "Apr 123, 2013", "May 1, 20x3"]
)


def test_date_keys_against_a_database(spark):
    """The same keys written in the database's own string functions."""
    months = " ".join(f"when '{m}' then '{i:02d}'" for i, m in enumerate(MONTHS, 1))
    parts = (
        "with a(s) as (select ?), b as (select substr(s, -4) y,"
        f" case substr(s, 1, 3) {months} end m,"
        " substr('0' || substr(s, 5, instr(s, ',') - 5), -2, 2) d from a)"
        " select y, m, d, y||'-'||m||'-'||d, strftime('%Y-W%W', y||'-'||m||'-'||d), y||'-'||m"
        " from b"
    )
    database = sqlite3.connect(":memory:")
    expected = [database.execute(parts, (text,)).fetchone() for text in ODD_DATES]
    keys = [
        dates.year_of,
        dates.month_text,
        dates.day_text,
        lambda d: dates.period_key(d, "daily"),
        lambda d: dates.period_key(d, "weekly"),
        lambda d: dates.period_key(d, "monthly"),
    ]
    ours = zip(*[mapped(spark, ODD_DATES, key) for key in keys], strict=True)
    assert list(ours) == expected


def test_week_keys_of_every_day(spark):
    days = [date(1999, 12, 25) + timedelta(days=i) for i in range(4200)]
    texts = [f"{MONTHS[d.month - 1]} {d.day}, {d.year}" for d in days]
    keys = mapped(spark, texts, lambda t: dates.period_key(t, "weekly"))
    assert keys == [d.strftime("%Y-W%W") for d in days]


def test_period_key_edges(spark):
    texts = ["Apr 1, 2013", "April 1, 2013", "apr 1, 2013"]
    daily = mapped(spark, texts, lambda t: dates.period_key(t, "daily"))
    assert daily == ["2013-04-01", "2013-04- 1", None]
    assert mapped(spark, texts, lambda t: dates.period_key(t, "hourly")) == ["2013"] * 3


def test_week_label(spark):
    texts = ["2024-W01", "2025-W01", "2013-04-08", "other", None]
    labelled = mapped(spark, texts, dates.week_label)
    assert labelled == ["2024-1-w1", "2025-12-w5", "2013-4-w2", "other", None]


def test_survey_year_marks_odd_dates(spark):
    texts = ["Apr 1, 2013", "", "ab", "Apr 1, 20x3"]
    marked = mapped(spark, texts, dates.survey_year)
    assert marked == ["2013", "_other", "_other", "_other"]


def test_rounding(spark):
    halves = [0.5, 1.5, 2.5, -0.5, -1.5]
    assert mapped(spark, halves, measures.round_half_even, "double") == [0, 2, 2, 0, -2]
    assert mapped(spark, halves, measures.round_half_up, "double") == [1, 2, 3, 0, -1]


def test_area_texts(spark):
    areas = ["Area 4, East", "Area 8-1, Bay", "Bellingham Bay", "Area  12, x"]
    assert mapped(spark, areas, labels.area_number) == ["4", "", "", "12"]
    assert mapped(spark, ["a" * 30, "a" * 31], labels.area_label) == ["a" * 30, "a" * 30 + "..."]


def test_format_count(spark):
    assert mapped(spark, [1234567.5, 0.4], labels.format_count, "double") == ["1,234,568", "0"]


@pytest.mark.parametrize(
    ("totals", "shares"),
    [([0.0, 5.0, 10.0], [0.0, 0.5, 1.0]), ([0.0, 0.0, 0.0], [0.0, 0.0, 0.0])],
)
def test_intensity(spark, totals, shares):
    largest = F.lit(max(totals))
    share = mapped(spark, totals, lambda t: measures.intensity(t, largest), "double")
    assert share == shares
