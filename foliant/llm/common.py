"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only a local session that names none, as in tests on one machine, gets a new temporary folder; on a
    cluster a folder of one machine would lose rows, so that is an error. The session's settings are left alone.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _own.setdefault(context.applicationId, "")
        if not path:
            path = _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="foliant-")
    return path.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/foliant/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: its lineage ends there."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path that this library made."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Remove all that was written below the shared folder; results that were not written elsewhere end with it."""
    delete(spark, f"{shared_dir(spark)}/foliant")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it, of a URI or a plain path."""
    if "://" not in uri:
        if uri.startswith("file:"):
            uri = uri[5:]
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class Memo(dict):
    """A dictionary that computes missing values, within a bound of bytes.

    Beyond half of `limit` the entries are set aside; those asked for again come back, and the rest go the next time. Keys of over
    `longest` characters are computed each time and not kept, so whole texts in a script without spaces are never held.
    """

    def __init__(self, compute: Callable, limit: int, each: int = 220, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.each, self.longest = compute, limit // 2, each, longest
        self.old, self.held = {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        size = len(key)
        if size <= self.longest:
            if self.held > self.limit:
                self.old, self.held = dict(self), 0
                self.clear()
            self[key] = value
            self.held += self.each + size
        return value


#: What the tasks of this worker process share: one thing at a time, dropped by the first task that does not ask for it.
_KEPT: dict[str, object] = {}
_ASKED: set[str] = set()


def kept(key: str, make: Callable):
    """make(), once a worker process for tasks in a row that ask for the same key."""
    _ASKED.add(key)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def map_batches(df: DataFrame, schema: str, setup: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """mapInArrow with a state made once a task: setup() gives a function from a batch to the columns of its result."""
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        _ASKED.clear()
        arrow, step = to_arrow_schema(target), setup()
        if not _ASKED:
            _KEPT.clear()
        out = part = batch = None
        try:
            for batch in batches:
                for part in slices(batch):
                    out = step(part)
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, out[f.name]) for f in arrow)], schema=arrow)
        finally:
            del step, out, part, batch
            release()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, target)


def release() -> None:
    """Give freed memory back to the system: a worker process idles between stages, next to its executor's JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Whole texts in Spark's default 10,000 rows a batch take tens of MB, in the JVM and again in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def with_text(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, str]:
    """Columns `keep` and the text, and the name that the text has there: it is carried once."""
    if "text" in keep and dict(docs.dtypes)["text"] == "string":
        return docs.select(*keep), "text"
    return docs.select(*keep, F.col("text").cast("string").alias("__text")), "__text"


def slices(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part takes about `limit` bytes, a single longer row apart."""
    if batch.nbytes <= limit or batch.num_rows <= 1:
        yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), limit)
    yield from slices(batch.slice(half), limit)


def rows_of(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def empty_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
