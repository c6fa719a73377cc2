"""Streams: a mesh summed file by file, and an index kept up to date by batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulark.operators.mesh import by_cell, exploded


def mesh_stream(particles: DataFrame, n: int, scheme: str = "tsc", value: str | None = None) -> DataFrame:
    """Running sum by cell of a particle stream; state is one number a cell, whatever has arrived."""
    rows = exploded(particles, n, scheme, keep=(value,) if value else ())
    return by_cell(rows, n, F.sum(F.col("w") * F.col(value) if value else F.col("w")).alias("val"))


def windowed_density(events: DataFrame, n: int, width: str = "1 day", late: str = "2 days", scheme: str = "ngp") -> DataFrame:
    """Mass by cell and tumbling event-time window; windows older than the watermark are dropped."""
    rows = exploded(events.withWatermark("ts", late), n, scheme, keep=("ts", "mass"))
    return by_cell(rows, n, F.sum(F.col("w") * F.col("mass")).alias("val"), keys=(F.window("ts", width),))


def start_into_memory(stream: DataFrame, name: str, mode: str = "complete"):
    return stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()


def append_batches(vectors: DataFrame, table: str, checkpoint: str):
    """Add each batch of a vector stream to a Parquet table; deletions go to a table of their own (see catalog.without_ids).

    A batch is a folder ``batch=N`` that is written whole, so one that is replayed after a failure takes its own place.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return vectors.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
