"""Token ids as parquet list columns, in document order, for selective reads of tokens or of metadata alone.

File format: parquet of version 2, rows in ascending doc_id over ascending part files. Columns `doc_id` and `n_tokens`
are delta encoded, `tokens` is a list of 32-bit ids, dictionary encoded while the dictionary is small enough and delta
encoded otherwise. Row groups and pages are bounded, and page indexes let a range of documents be read alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.arrow_text import text_slices
from turnwise.llm.token_chunks import library_encoder, token_ids, worker_table


@dataclass(frozen=True)
class FileLayout:
    row_group_bytes: int = 32 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 1000
    dictionary_bytes: int = 1 << 20

    def options(self) -> dict[str, str]:
        return {
            "compression": "zstd",
            "parquet.writer.version": "v2",
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.dictionary.page.size": str(self.dictionary_bytes),
            "parquet.enable.dictionary": "true",
            "parquet.enable.dictionary#doc_id": "false",  # delta encoded from the start
            "parquet.enable.dictionary#n_tokens": "false",
        }


def encode_documents(documents: DataFrame, tokenizer_path: str, end_id: int | None) -> DataFrame:
    """(doc_id, n_tokens, tokens) per document, narrow. A null text is empty; `end_id` is appended unless None."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_table(tokenizer_path, lambda: library_encoder(tokenizer_path))
        for batch in text_slices(batches):
            ids, counts = token_ids(batch.column("text"), pieces)
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
            ends = np.concatenate([[0], np.cumsum(counts)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), lists], names=["doc_id", "n_tokens", "tokens"]
            )

    return documents.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, tokens array<int>")


def write_token_files(
    documents: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 2, layout: FileLayout | None = None
) -> None:
    """Encodes documents into `folder`, ascending by doc_id (repeated doc_ids: by text; a null doc_id first).

    One shuffle, of the texts by ranges of doc_id; ids are made where they are written. An empty table writes no rows.
    """
    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = encode_documents(ordered, tokenizer_path, end_id).withColumn("part", F.spark_partition_id())
    encoded = encoded.withColumn("place", F.monotonically_increasing_id())
    encoded.write.mode("overwrite").options(**(layout or FileLayout()).options()).parquet(folder)


def read_tokens(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Documents of the id range with their tokens; the range is pushed to row groups and pages."""
    rows = spark.read.schema("doc_id long, n_tokens long, tokens array<int>, part int, place long").parquet(folder)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    return rows.filter(F.col("doc_id") <= last) if last is not None else rows


def read_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, n_tokens, start) from the metadata columns alone: how many ids stand before each document.

    Parts are summed first, so no window sees more rows than one part or the list of parts. Documents that share a
    doc_id are placed by length among themselves.
    """
    rows = read_tokens(spark, folder).select("part", "doc_id", "n_tokens")
    return _with_starts(rows, rows, "doc_id", "n_tokens").select("doc_id", "n_tokens", "start")


def _with_starts(rows: DataFrame, sizes: DataFrame, *order: str) -> DataFrame:
    """The rows, which have part and n_tokens, and start. `sizes` has part and n_tokens of the same documents."""
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(F.broadcast(parts.select("part", before.alias("before"))), "part")
        .withColumn("start", F.col("before") + F.col("inside"))
    )


def digests_with_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of the files, in the order of the files: null and repeated doc_ids
    too, as nothing is joined by doc_id. The ids are read once, the sizes of the parts from the metadata columns."""
    rows = read_tokens(spark, folder)
    found = _with_starts(digests(rows, "part int, place long"), rows.select("part", "n_tokens"), "place")
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def digests(tokens: DataFrame, others: str = "") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32): unsigned crc32 of the ids as little-endian unsigned 32-bit integers. `others` names
    columns to keep, with their types."""
    kept = [c.split()[0] for c in others.split(",") if c]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            counts = np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(counts)
            crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), *map(batch.column, kept)],
                names=["doc_id", "n_tokens", "ids_crc32", *kept],
            )

    schema = "doc_id long, n_tokens long, ids_crc32 long" + (f", {others}" if others else "")
    return tokens.select("doc_id", "tokens", *kept).mapInArrow(digest, schema)
