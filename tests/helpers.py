"""Small frames and a row-by-row load to compare with."""

import random

from pyspark.sql import functions as F

from tidetally.schema import KEY, RECORD, VALUES

INCOMING = (
    "batch_no int, part string, seq bigint, sample_date string, ramp_site string,"
    " catch_area string, interviews bigint, anglers bigint, "
    + ", ".join(f"{name} double" for name in VALUES)
    + ", data_hash string"
)


def records(spark, rows):
    """Table rows from dicts; what is missing is blank or NULL."""
    blank = {"sample_date": "", "ramp_site": "", "catch_area": ""}
    names = RECORD.fieldNames()
    return spark.createDataFrame(
        [tuple({**blank, **row}.get(name) for name in names) for row in rows], RECORD
    )


def incoming(spark, rows):
    """Rows (batch_no, seq, key tuple, hash); the hash also is the chinook catch."""
    data = []
    for batch_no, seq, key, value in rows:
        values = [float(value)] + [None] * (len(VALUES) - 1)
        data.append((batch_no, f"p{seq // 10:03d}", seq, *key, *values, str(value)))
    return spark.createDataFrame(data, INCOMING)


def random_rows(seed, n=400, keys=12, hot=True):
    """Rows over few keys; with ``hot`` a third of them share one key."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        pick = 0 if hot and rng.random() < 1 / 3 else rng.randrange(keys)
        anglers = None if pick % 5 == 4 else pick
        key = (f"Apr {pick % 3 + 1}, 2013", f"Ramp {pick}", "", 1, anglers)
        rows.append((seq * 4 // n + 1, seq, key, rng.randrange(3)))
    return rows


def load_row_by_row(rows, table=None, null_safe=False):
    """Statuses and the state after loading the rows one at a time."""
    table = dict(table or {})
    loose, statuses = [], {}
    for batch_no, seq, key, value in rows:
        if not null_safe and None in key:
            loose.append((key, value))
            statuses[batch_no, seq] = "inserted"
        elif key not in table:
            table[key] = value
            statuses[batch_no, seq] = "inserted"
        else:
            statuses[batch_no, seq] = "updated" if table[key] != value else "duplicate"
            table[key] = value
    return statuses, table, loose


def statuses_of(classified):
    return {(r.batch_no, r.seq): r.status for r in classified.collect()}


def state_of(df):
    rows = df.select(*KEY, F.col("chinook").cast("int").alias("v")).collect()
    return sorted(((tuple(r)[:5], r.v) for r in rows), key=repr)


def one(df, column):
    return df.select(column.alias("value")).first().value
