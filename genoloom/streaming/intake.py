"""Continuous annotation of variant files that arrive in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from genoloom.plans.annotate import Annotated, Protocol, annotate
from genoloom.sources.readers import parse_avinput, parse_vcf


def incoming(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of (file, value) lines of the files in a folder."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def annotate_stream(spark: SparkSession, folder: str, protocols: list[Protocol], sink: Callable[[Annotated, int], None], checkpoint: str, vcf: bool = False, missing: str = ".") -> StreamingQuery:
    """Annotate every micro-batch by stream-static joins and hand the result to sink with the batch's number.

    A batch that runs again after a failure has the same number and the same rows, so a sink that writes under that number writes once. Files are
    the unit of intake: there is no event time, and batches don't depend on each other.
    """

    def one(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("line_no", F.monotonically_increasing_id() + 1).select("line_no", "value")
        rows = parse_vcf(numbered).drop("extra") if vcf else parse_avinput(numbered)
        sink(annotate(rows, protocols, missing), number)

    return incoming(spark, folder).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
