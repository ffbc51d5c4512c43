"""Preparing rows as files arrive.

Formatting, rendering, tokenising and the threshold split look at one row at a time, so the batch operators run
unchanged on a stream: no state, no watermark, and the same answer as the batch job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def prepare_arrivals(
    spark: SparkSession,
    source: str,
    schema: StructType,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
) -> None:
    """Runs ``transform`` over the parquet files not seen before and appends to ``target``; returns when caught up.

    ``checkpoint`` and ``target`` belong in shared storage: the file sink's log makes a restarted run exactly-once.
    """
    arrivals = spark.readStream.schema(schema).parquet(source)
    (
        transform(arrivals)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
