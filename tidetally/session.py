"""Where intermediate tables go."""

import gc
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="tidetally-")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on a single machine."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    return _local_scratch()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes a result as a table under the scratch folder and reads it back.

    For results that several others are built from: they are worked out once
    (the planner would prune each use by itself and scan again), and a lost
    executor does not bring their whole history back.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.kept_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes kept tables that nothing will read again, and lets finished shuffles go.

    For the middle of a long job: what was built from them is kept itself. Spark
    removes the shuffle files of a finished plan once the plan is garbage.
    """
    for table in tables:
        jvm = table.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(table.kept_at)
        conf = table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        folder.getFileSystem(conf).delete(folder, True)
    gc.collect()
    if tables:
        tables[0].sparkSession._jvm.System.gc()
