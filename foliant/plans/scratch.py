"""Tables and folders below the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Rows up to which a table is broadcast.
SMALL = 100_000


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Only a local session that sets none gets a temporary folder; on a cluster that would lose rows."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own.get(context.applicationId) or _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="foliant-"))
    return f"{root.rstrip('/')}/foliant/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder that the cluster shares, for results that several steps read."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df marked for a broadcast if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def clean(spark: SparkSession) -> None:
    """Remove all tables below the shared folder; results that were not written elsewhere end with it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(fresh(spark, "x").rsplit("/", 1)[0])
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
