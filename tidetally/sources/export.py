"""JSON export of the table."""

from datetime import datetime

from pyspark.sql import DataFrame

from tidetally.schema import EXPORT_NAME

_INTERNAL = ["data_hash", "created_at", "updated_at", "survey_year"]


def exported(store: DataFrame) -> DataFrame:
    """The records without the columns the table keeps for itself."""
    return store.drop(*_INTERNAL)


def export_json(store: DataFrame, folder: str, name: str | None = None) -> str:
    """Writes all records as JSON lines, NULLs kept; returns the path."""
    name = name or EXPORT_NAME.format(datetime.now())
    path = f"{folder}/{name}"
    exported(store).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
    return path
