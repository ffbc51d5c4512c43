"""Datasets saved as Arrow shards: one folder per split, each with a ``state.json`` that names its shards.

The scan is a Python data source with one partition per slice of a shard. A shard is a stream of record batches, whose
places are found from the heads of the messages; a slice is a run of batches of about ``SLICE`` bytes, read by itself from
a mapped file or by ranges from a remote one.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_schema

from turnwise.sources import files

SLICE = 256 << 20
ROW_ID = "row_id"
SHARD_ROWS = 1 << 36  # rows a shard may hold before two row ids could meet


def _text(spark: SparkSession, path: str) -> str:
    return files.read_head(spark, path, (1 << 31) - 1).decode("utf-8")  # the whole file


def saved_splits(spark: SparkSession, path: str) -> dict[str, str]:
    """``split -> folder`` in stored order; a folder without splits is one split with an empty name."""
    names = {f.name for f in files.children(spark, path)}
    if "dataset_dict.json" in names:
        splits = json.loads(_text(spark, f"{path}/dataset_dict.json"))["splits"]
        return {s: f"{path}/{s}" for s in splits}
    if "state.json" in names:
        return {"": path}
    found = {
        f.name: f"{path}/{f.name}"
        for f in files.children(spark, path)
        if f.is_dir and files.exists(spark, f"{path}/{f.name}/state.json")
    }
    if not found:
        raise ValueError(f"{path} holds no saved dataset; found only {sorted(names)}")
    return found


def choose_split(splits: Sequence[str], preferred: Sequence[str]) -> str:
    """The first preferred split that exists, else the first one."""
    for name in preferred:
        if name in splits:
            return name
    return next(iter(splits))


def _messages():
    """Built in a function, so that it is sent to workers by value."""

    def messages(stream, size: int):
        """``(place, length, rows)`` of each record batch of an Arrow stream, from the heads of its messages alone.

        A message is a marker, the length of its metadata, the metadata and the body. The metadata is a flatbuffer table
        with fields version, header type, header and body length; the header of a record batch begins with its rows.
        """
        import struct

        place = 0
        while place + 8 <= size:
            stream.seek(place)
            marker, length = struct.unpack("<Ii", stream.read(8))
            lead = 8
            if marker != 0xFFFFFFFF:  # streams of early versions have no marker
                lead, length = 4, marker
            if not length:
                return
            stream.seek(place + lead)
            meta = stream.read(length)

            def field(table: int, number: int, meta: bytes = meta) -> int:
                """Place of a field of a table, or 0."""
                fields = table - struct.unpack_from("<i", meta, table)[0]
                if 4 + 2 * number >= struct.unpack_from("<H", meta, fields)[0]:
                    return 0
                offset = struct.unpack_from("<H", meta, fields + 4 + 2 * number)[0]
                return table + offset if offset else 0

            root = struct.unpack_from("<I", meta, 0)[0]
            body = field(root, 3)
            total = lead + length + (struct.unpack_from("<q", meta, body)[0] if body else 0)
            kind = field(root, 1)
            if kind and meta[kind] == 3:  # a record batch
                header = field(root, 2)
                header += struct.unpack_from("<I", meta, header)[0]
                rows = field(header, 0)
                yield place, total, struct.unpack_from("<q", meta, rows)[0] if rows else 0
            elif kind and meta[kind] == 2:
                raise ValueError("dictionary batches are not supported; write the shard without dictionary types")
            place += total

    return messages


def _source_class(open_file):
    """Built in a function, so that it is sent to workers by value."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Slice(InputPartition):
        def __init__(self, value):
            super().__init__(value)

    class Reader(DataSourceReader):
        def __init__(self, schema, options):
            self.schema, self.options = schema, options

        def partitions(self):
            import json

            return [Slice(tuple(s)) for s in json.loads(self.options["slices"])]

        def read(self, partition):
            import numpy as np
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            path, place, end, number = partition.value
            wanted = to_arrow_schema(self.schema)
            with open_file(path) as stream:
                schema = pa.ipc.read_schema(pa.ipc.read_message(stream))
                while place < end:
                    stream.seek(place)
                    batch = pa.ipc.read_record_batch(pa.ipc.read_message(stream), schema)
                    place = stream.tell()
                    ids = pa.array(np.arange(number, number + batch.num_rows))
                    columns = [
                        ids if f.name == self.options["row_id"] else batch.column(f.name).cast(f.type) for f in wanted
                    ]  # the other columns of a mapped file are not touched
                    yield pa.RecordBatch.from_arrays(columns, schema=wanted)
                    number += batch.num_rows

    class SavedSplit(DataSource):
        @classmethod
        def name(cls):
            return "arrow_shards"

        def reader(self, schema):
            return Reader(schema, dict(self.options))

    return SavedSplit


def _opener():
    def open_file(uri: str):
        import pyarrow as pa
        from pyarrow import fs

        if uri.startswith("file:"):  # taken as it is: a path is not percent-encoded
            return pa.memory_map("/" + uri.removeprefix("file:").lstrip("/"))
        system, path = fs.FileSystem.from_uri(uri)
        return system.open_input_file(path)

    return open_file


def _slices(spark: SparkSession, folder: str, slice_bytes: int) -> list[tuple[str, int, int, int]]:
    """``(uri, first byte, last byte, first row id)`` of parts of the shards of about ``slice_bytes``, at record batches.

    Each shard's messages are walked in a task, which reads their heads alone; only the parts come to the driver.
    """
    import pyarrow as pa

    names = [d["filename"] for d in json.loads(_text(spark, f"{folder}/state.json"))["_data_files"]]
    found = {f.name: f for f in files.children(spark, folder)}
    shards = [(i, _uri(found[name].path), found[name].length) for i, name in enumerate(names)]
    open_file, messages, shard_rows = _opener(), _messages(), SHARD_ROWS

    def walk(batches):
        import pyarrow as pa

        for batch in batches:
            for shard, uri, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts, row = [], shard * shard_rows
                with open_file(uri) as stream:
                    for place, length, rows in messages(stream, size):
                        if not parts or place + length - parts[-1][0] > slice_bytes:
                            parts.append([place, place, row])
                        parts[-1][1] = place + length
                        row += rows
                first, last, rows = zip(*parts, strict=True) if parts else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(parts), pa.string()), *(pa.array(c, pa.int64()) for c in (first, last, rows))],
                    names=["uri", "place", "end", "row"],
                )

    table = spark.createDataFrame(pa.Table.from_pylist([{"shard": i, "uri": u, "size": n} for i, u, n in shards]))
    spread = table.repartition(min(len(shards), 4096), "shard")
    return [tuple(r) for r in spread.mapInArrow(walk, "uri string, place long, end long, row long").orderBy("row").collect()]


def _uri(path: str) -> str:
    """Hadoop's scheme for S3 is not known to Arrow's file systems."""
    return path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path


def _arrow_schema(uri: str):
    import pyarrow as pa

    with _opener()(uri) as stream:
        return pa.ipc.open_stream(stream).schema


def read_saved_split(
    spark: SparkSession, folder: str, slice_bytes: int = SLICE, columns: Sequence[str] | None = None
) -> DataFrame:
    """One split, with a ``row_id`` made of shard number and place in the shard, unless the shards have one.

    With ``columns`` only those are read (and the ``row_id``); a name that the shards lack is left out.
    """
    names = [d["filename"] for d in json.loads(_text(spark, f"{folder}/state.json"))["_data_files"]]
    found = {f.name: f.path for f in files.children(spark, folder)}
    schema = from_arrow_schema(_arrow_schema(_uri(found[names[0]])))
    if columns is not None:
        schema = T.StructType([f for f in schema.fields if f.name in (*columns, ROW_ID)])
    generated = "" if ROW_ID in schema.fieldNames() else ROW_ID
    if generated:
        schema = T.StructType([T.StructField(ROW_ID, T.LongType()), *schema.fields])
    spark.dataSource.register(_source_class(_opener()))
    slices = _slices(spark, folder, slice_bytes) or [(_uri(found[names[0]]), 0, 0, 0)]  # no batch: a slice without any
    return spark.read.format("arrow_shards").schema(schema).options(slices=json.dumps(slices), row_id=generated).load()


def write_saved_split(df: DataFrame, folder: str, batch_rows: int = 1000) -> int:
    """Writes a split in this layout, a shard for each partition, and returns its rows.

    A shard is named when its task has written it; what a task left that was run again is in no list.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    root, schema = _uri(files.uri(spark, folder)), to_arrow_schema(df.schema)
    files.write_text(spark, f"{folder}/dataset_info.json", "{}")

    def shard(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        name, rows = f"data-{uuid.uuid4().hex}.arrow", 0
        if root.startswith("file:"):
            sink = pa.OSFile("/" + root.removeprefix("file:").lstrip("/") + f"/{name}", "wb")
        else:
            system, path = fs.FileSystem.from_uri(root)
            sink = system.open_output_stream(f"{path}/{name}")
        with sink, pa.ipc.new_stream(sink, schema) as writer:
            for batch in batches:
                columns = [batch.column(f.name).cast(f.type) for f in schema]
                writer.write_table(pa.Table.from_arrays(columns, schema=schema), max_chunksize=batch_rows)
                rows += batch.num_rows
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([rows], pa.int64())], names=["part", "name", "n"])

    shards = sorted(df.mapInArrow(shard, "part int, name string, n long").collect())
    names = [s.name for s in shards if s.n]
    if not names:  # a split without rows still has its schema
        empty, names = pa.BufferOutputStream(), ["data-0.arrow"]
        pa.ipc.new_stream(empty, schema).close()
        files.write_bytes(spark, f"{folder}/{names[0]}", empty.getvalue().to_pybytes())
    files.write_text(spark, f"{folder}/state.json", json.dumps({"_data_files": [{"filename": n} for n in names]}))
    return sum(s.n for s in shards)


def write_saved(splits: dict[str, DataFrame], folder: str) -> None:
    """Writes several splits, named in ``dataset_dict.json``, which comes last."""
    for name, df in splits.items():
        write_saved_split(df, f"{folder}/{name}")
    spark = next(iter(splits.values())).sparkSession
    files.write_text(spark, f"{folder}/dataset_dict.json", json.dumps({"splits": list(splits)}))


def load_saved(
    spark: SparkSession, path: str, preferred: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """The preferred split of a saved dataset; other splits are not read."""
    splits = saved_splits(spark, path)
    return read_saved_split(spark, splits[choose_split(list(splits), preferred)], columns=columns)


def load_all_splits(spark: SparkSession, path: str) -> DataFrame:
    """All splits with a ``split`` column."""
    whole = None
    for name, folder in saved_splits(spark, path).items():
        part = read_saved_split(spark, folder).withColumn("split", F.lit(name))
        whole = part if whole is None else whole.unionByName(part)
    return whole
