"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python. A text may be over 100 KB, so this, and not Spark's 10,000, bounds a worker's memory.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small in this session: whole texts travel in them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, or one of this process in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = getattr(spark.sparkContext, "_llm_shared_dir", None)
    if made is None:
        made = "file://" + tempfile.mkdtemp(prefix="llm_shared_")
        spark.sparkContext._llm_shared_dir = made
        _remove_at_exit(spark, made)
    return made


def qualified(spark: SparkSession, path: str) -> str:
    """path as a URI that Python's file systems read, of the file system that Spark's default settings name if it has none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    scheme, _, rest = uri.partition(":")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    if scheme not in ("file", "hdfs", "s3", "gs", "abfs", "abfss"):
        raise ValueError(f"{uri}: no file system for tasks that write archives; name another spark.checkpoint.dir")
    return f"{scheme}:{rest}" if rest.startswith("//") else f"{scheme}://{rest}"


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        jvm = spark.sparkContext._jvm
        if jvm is None or spark.sparkContext._jsc is None:
            return
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(remove)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one; removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _remove_at_exit(spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, or the first of name_, name__, ... that is no column of df, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Spark's setting to remove the shuffle files of a query when it ends; otherwise they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. Its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that stored() has returned, and that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.stored_at)


def map_texts(df: DataFrame, keys: dict[str, str], schema: str, rows: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """Apply rows() to the named columns, batch by batch, in one narrow stage.

    keys: name inside rows() -> column of df; other columns of df stay out, whatever their names.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = rows(batch.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.select(*[F.col(c).alias(k) for k, c in keys.items()]).mapInArrow(run, schema)
