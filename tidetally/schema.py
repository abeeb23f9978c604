"""Fixed values of the survey data model: names, headers and Spark schemas."""

from pyspark.sql import types as T

# The species that can be asked for, in display order.
SPECIES = ["chinook", "coho", "chum", "pink", "sockeye", "lingcod", "halibut"]

# The species summed when none is asked for.
SALMON = ["chinook", "coho", "chum", "pink", "sockeye"]

# The columns that identify a survey record.
KEY = ["sample_date", "ramp_site", "catch_area", "interviews", "anglers"]

# The columns the change hash covers, in hash order.
VALUES = [
    "chinook",
    "chinook_per_angler",
    "coho",
    "chum",
    "pink",
    "sockeye",
    "lingcod",
    "halibut",
]

# Header in a CSV export -> column of the record.
HEADERS = {
    "Sample date": "sample_date",
    "Ramp/site": "ramp_site",
    "Catch area": "catch_area",
    "# Interviews (Boat or Shore)": "interviews",
    "Anglers": "anglers",
    "Chinook": "chinook",
    "Chinook (per angler)": "chinook_per_angler",
    "Coho": "coho",
    "Chum": "chum",
    "Pink": "pink",
    "Sockeye": "sockeye",
    "Lingcod": "lingcod",
    "Halibut": "halibut",
}

# Spellings of "no area" in the exports.
NO_AREA = ["", "N/A", "n/a", "NA", "null"]

# Month names as they start a sample date.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Areas drawn from a polygon file of their own instead of the marine-area layer.
CUSTOM_AREAS = [
    "Bellingham Bay",
    "Commencement Bay",
    "Dungeness Bay",
    "Hoodsport Hatchery",
    "Inner Elliot Bay Fishery Area",
    "Quilcene, Dabob Bay",
    "Sinclair Inlet",
    "Tulalip Terminal Area",
]

# Texts of a refresh summary and of an export's default name.
CURRENT_MESSAGE = "Data is current (updated %.1f hours ago)"
UPDATED_MESSAGE = "Data updated successfully. Total records: {:,}"
FAILED_MESSAGE = "Error updating data: {}"
EXPORT_NAME = "survey_export_{:%Y%m%d_%H%M%S}.json"

# The first year landed, the hours between refreshes, the log key of a refresh.
FIRST_SURVEY_YEAR = 2013
REFRESH_INTERVAL_HOURS = 24
LAST_UPDATE = "last_update"

# Partition value for records whose date does not end in a four-digit year.
OTHER_YEAR = "_other"

# Where a row stands in the landed data: batch, piece of a file, row within the piece.
POSITION = ["batch_no", "part", "seq"]

_KEY_FIELDS = [
    T.StructField("sample_date", T.StringType()),
    T.StructField("ramp_site", T.StringType()),
    T.StructField("catch_area", T.StringType()),
    T.StructField("interviews", T.LongType()),
    T.StructField("anglers", T.LongType()),
]
_VALUE_FIELDS = [T.StructField(name, T.DoubleType()) for name in VALUES]

RECORD = T.StructType(
    [
        *_KEY_FIELDS,
        *_VALUE_FIELDS,
        T.StructField("data_hash", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

STORE = T.StructType([*RECORD.fields, T.StructField("survey_year", T.StringType())])

# Totals of the table by date text, area and which species are NULL (a bit each).
ROLLUP = T.StructType(
    [
        T.StructField("sample_date", T.StringType()),
        T.StructField("catch_area", T.StringType()),
        T.StructField("nulls", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("anglers", T.LongType()),
        *[T.StructField(name, T.DoubleType()) for name in SPECIES],
        T.StructField("survey_year", T.StringType()),
    ]
)

RUN_LOG = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("updated_at", T.StringType()),
    ]
)

FEATURES = T.StructType(
    [
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
                        T.StructField("geometry", T.StringType()),
                    ]
                )
            ),
        )
    ]
)

POLYGON = "struct<type:string,coordinates:array<array<array<double>>>>"
MULTI_POLYGON = "struct<type:string,coordinates:array<array<array<array<double>>>>>"
