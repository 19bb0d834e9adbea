"""Folders that all executors share, tables written there to cut lineage, and single-file output."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; in local mode without one, a folder of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = getattr(spark.sparkContext, "_genoloom_folder", None)
    if made is None:
        made = spark.sparkContext._genoloom_folder = "file://" + tempfile.mkdtemp(prefix="genoloom_")
    return made


def file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """path as a URI with its scheme, the one of Spark's default file system if it has none; local files as file:///."""
    fs, p = file_system(spark, path)
    uri = fs.makeQualified(p).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, removed when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        if spark.sparkContext._jsc is not None:
            fs, p = file_system(spark, path)
            fs.delete(p, True)

    atexit.register(remove)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace(spark: SparkSession, source, target) -> None:
    """Rename source to target in one step that overwrites it: readers see the old file or the new one."""
    jvm = spark.sparkContext._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(source), context.makeQualified(target), how)


def spool(spark: SparkSession, stream) -> str:
    """The path of a file in the shared folder with the bytes of a stream such as standard input."""
    path = scratch_folder(spark, "input")
    fs, p = file_system(spark, f"{path}/lines.txt")
    out = fs.create(p, True)
    while block := stream.read(1 << 20):
        out.write(bytearray(block))
    out.close()
    return f"{path}/lines.txt"


def publish_lines(lines: DataFrame, path: str, header: list[str], order: str) -> None:
    """Write the column ``value`` in order to one file that appears whole or not at all; the path ``-`` means standard output.

    Spark sorts by range and writes its parts in parallel; the parts are then joined under a temporary name beside the target by streaming
    one after another, and renamed over it. A path that ends in / gets the ordered parts themselves, with a header part in front, and nothing streams through
    the driver.
    """
    if path == "-":
        _print_lines(lines, header, order)
        return
    if path.endswith("/"):
        _publish_parts(lines, path, header, order)
        return
    spark = lines.sparkSession
    parts = scratch_folder(spark, "lines")
    lines.orderBy(order).select("value").write.option("lineSep", "\n").text(parts)
    fs, folder = file_system(spark, parts)
    out_fs, target = file_system(spark, path)
    temp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    try:
        out = out_fs.create(temp, True)
        for h in header:
            out.write(bytearray((h + "\n").encode()))
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
        for n in names:
            src = fs.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{parts}/{n}"))
            spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(src, out, 1 << 16, False)
            src.close()
        out.close()
        replace(spark, temp, target)
    finally:
        if out_fs.exists(temp):
            out_fs.delete(temp, False)
        fs.delete(folder, True)


def _print_lines(lines: DataFrame, header: list[str], order: str) -> None:
    spark = lines.sparkSession
    parts = scratch_folder(spark, "lines")
    lines.orderBy(order).select("value").write.option("lineSep", "\n").text(parts)
    sys.stdout.write("".join(h + "\n" for h in header))
    fs, folder = file_system(spark, parts)
    for n in sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")):
        for row in spark.read.option("lineSep", "\n").text(f"{parts}/{n}").coalesce(1).toLocalIterator():
            sys.stdout.write(row.value + "\n")
    sys.stdout.flush()
    fs.delete(folder, True)


def _publish_parts(lines: DataFrame, path: str, header: list[str], order: str) -> None:
    spark = lines.sparkSession
    fs, target = file_system(spark, path.rstrip("/"))
    if fs.exists(target):
        raise FileExistsError(path)
    temp = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    _, source = file_system(spark, temp)
    try:
        lines.orderBy(order).select("value").write.option("lineSep", "\n").text(temp)
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{temp}/header.txt"), True)
        out.write(bytearray("".join(h + "\n" for h in header).encode()))
        out.close()
        if not fs.rename(source, target):
            raise OSError(f"cannot publish {path}")
    finally:
        if fs.exists(source):
            fs.delete(source, True)
