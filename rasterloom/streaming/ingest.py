"""Image files as a stream: the batch functions run on each arriving file, and rows of images leave in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import containers

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def image_stream(spark: SparkSession, path: str, glob: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length", "content")


def inspected_stream(spark: SparkSession, path: str, **how) -> DataFrame:
    """Header facts of arriving files; malformed ones are error rows."""
    return containers.inspect(image_stream(spark, path, **how))


def stripe_rows(row_bytes: int, height: int, max_rows: int, max_bytes: int) -> int:
    """Rows of a stripe: as many as asked for, but no more than the image has or the bytes allow. An error if not even one fits."""
    if row_bytes > max_bytes:
        raise ValueError("a row is larger than a stripe may be")
    return min(max_rows, max(height, 1), max(max_bytes // row_bytes, 1) if row_bytes else max_rows)


def image_rows(planes: DataFrame, max_rows: int, max_bytes: int, bytes_per_sample: int = 1) -> DataFrame:
    """(image, stripe, y, row) of planes (image, m array<array>): the order is in the columns."""
    height, row_bytes = F.size("m"), F.size(F.get("m", F.lit(0))) * bytes_per_sample
    rows = F.when(row_bytes <= max_bytes, F.least(F.lit(max_rows), F.greatest(height, F.lit(1)), F.greatest(F.call_function("div", F.lit(max_bytes), F.greatest(row_bytes, F.lit(1))), F.lit(1))))
    out = planes.withColumn("_rows", rows).select("image", "_rows", F.posexplode("m").alias("y", "row"))
    return out.select("image", F.call_function("div", "y", F.col("_rows")).alias("stripe"), "y", "row")


def write_rows(rows: DataFrame, write_row: Callable[[int, int, list], None], checkpoint: str):
    """Starts a query that hands each batch's rows to ``write_row`` in the order of (image, y); a batch must fit the driver."""

    def sink(batch: DataFrame, _: int) -> None:
        for r in batch.orderBy("image", "y").toLocalIterator():
            write_row(r["image"], r["y"], r["row"])

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
