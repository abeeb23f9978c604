"""Versions of a stored table: which folder holds each survey year.

Data folders are written once, by one run each, and never changed. A version is
a small file, ``versions/<number>.json``, that names the folder of every year; it
is written when the data is complete, under a number that no one else has
written. So a reader sees one version as a whole, and of two writers that start
from one version the second is refused.

A version's file is put in place by a rename that fails where the file exists;
the file system has to offer that (HDFS and local disks do).
"""

import json
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class StaleVersion(RuntimeError):
    """Someone else has published since the version a run began with."""


@dataclass(frozen=True)
class Version:
    """Number 0 stands for no table."""

    number: int = 0
    #: Survey year -> run whose folder holds it.
    years: dict[str, str] = field(default_factory=dict)
    run: str = ""
    #: Time it was written, and, for a copy, the runs that its years were copied from.
    at: str = ""
    source: dict[str, str] = field(default_factory=dict)


def new_run() -> str:
    return uuid.uuid4().hex


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions there are, ascending; lists one folder."""
    folder = f"{path}/versions"
    files = _file_system(spark, folder)
    if not files.exists(_path(spark, folder)):
        return []
    names = (status.getPath().getName() for status in files.listStatus(_path(spark, folder)))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _file(path: str, number: int) -> str:
    return f"{path}/versions/{number:012d}.json"


def read_version(spark: SparkSession, path: str, number: int) -> Version:
    text = spark.read.option("wholetext", "true").text(_file(path, number)).first().value
    return Version(**json.loads(text))


def latest(spark: SparkSession, path: str) -> Version:
    numbers = _numbers(spark, path)
    return read_version(spark, path, numbers[-1]) if numbers else Version()


def since(spark: SparkSession, path: str, number: int) -> list[Version]:
    """Versions after a number, oldest first."""
    return [read_version(spark, path, n) for n in _numbers(spark, path) if n > number]


def commit(spark: SparkSession, path: str, version: Version) -> Version:
    """Puts a version in place; raises ``StaleVersion`` if its number is taken."""
    jvm = spark._jvm
    target, part = _file(path, version.number), f"{path}/versions/.{uuid.uuid4().hex}.part"
    out = _file_system(spark, part).create(_path(spark, part))
    out.write(bytearray(json.dumps(asdict(version)).encode()))
    out.close()
    place = _path(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _file_system(spark, target).getUri(), spark._jsc.hadoopConfiguration()
    )
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        context.rename(_path(spark, part), place, spark.sparkContext._gateway.new_array(rename, 0))
    except Py4JJavaError as error:
        _file_system(spark, part).delete(_path(spark, part), False)
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        raise StaleVersion(f"version {version.number} of {path} was written by another run") from None
    return version


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the folders that a path pattern matches."""
    found = _file_system(spark, pattern).globStatus(_path(spark, pattern)) or []
    return sorted(status.getPath().getName() for status in found if status.isDirectory())
