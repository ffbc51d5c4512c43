"""Caller-supplied batch functions, for steps that have no native expression."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

Columns = dict[str, list]


def map_batches(df: DataFrame, function: Callable[[Columns], Columns], schema: StructType | str) -> DataFrame:
    """Applies a function from column lists to column lists to each Arrow batch.

    The result has the columns of ``schema`` only; its rows may be more or fewer than the batch's. Prefer
    ``df.transform`` with native columns where they exist.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    wanted = to_arrow_schema(fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict(function(batch.to_pydict()), schema=wanted)

    return df.mapInArrow(apply, fields)
