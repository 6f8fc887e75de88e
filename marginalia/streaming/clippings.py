"""New clippings logs and side-cars as they arrive, by file-source streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.similarity import decode_with_fallback
from ..sources import clippings, sidecar

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, glob: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(FILES).format("binaryFile").option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(path)


def stream_clippings(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Clippings of log files that are new under ``path``."""
    files = stream_files(spark, path, glob)
    logs = files.select(F.col("path").alias("source_file"), F.col("modificationTime").alias("seen"), F.regexp_replace(decode_with_fallback("content"), "\r\n?", "\n").alias("text"))
    return clippings.parse(logs)


def stream_annotations(spark: SparkSession, path: str, glob: str = "*.pds") -> DataFrame:
    return sidecar.decode_annotations(stream_files(spark, path, glob))


def first_copies(rows: DataFrame, delay: str = "30 days") -> DataFrame:
    """Logs are sent whole again and again: only the first copy of a clipping passes, remembered for ``delay`` of event time."""
    return rows.withWatermark("seen", delay).dropDuplicatesWithinWatermark(["title", "type", "location", "page", "date_added", "content"])


def write_stream(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Give each micro-batch to ``sink``; ``once`` works off what is there and ends."""
    writer = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
