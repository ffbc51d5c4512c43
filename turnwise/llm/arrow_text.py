"""What the operators share: words and slices of Arrow text columns, row selection by hash, the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.sources.files import remove
from turnwise.sources.kept import work_folder

SLICE_BYTES = 4 << 20  # text handled at once inside a task; a single longer text is handled alone


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key's text, modulo the divisor."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder in the cluster's shared place: below spark.checkpoint.dir, or the warehouse, which is shared as well."""
    return work_folder(spark, purpose)


def written(df: DataFrame, folder: str) -> DataFrame:
    """The rows as a table in a shared folder: cuts lineage, and a lost executor costs no recomputation."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stored(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """The rows as a table in a new shared folder, and the folder, for a step whose table is superseded later."""
    folder = shared_folder(df.sparkSession, purpose)
    return written(df, folder), folder


def superseded(spark: SparkSession, *folders: str) -> None:
    """Removes tables that no row is read from any more."""
    for folder in folders:
        remove(spark, folder)


def release_shuffles(spark: SparkSession, seconds: float = 0.0) -> None:
    """Has the driver's collector let go of the shuffles of tables that are gone; it takes a moment, so not in each round.
    Executors delete the files afterwards: `seconds` is the time they are given before more is written. The driver's free
    native memory goes back to the system as well."""
    gc.collect()  # Python's references to plans keep theirs
    spark.range(1).count()  # the plan of the last write is held until another query has run
    spark.sparkContext._jvm.System.gc()
    give_back()
    trim_driver(spark)
    time.sleep(seconds)


def trim_driver(spark: SparkSession) -> bool:
    """Returns free native memory of the driver's JVM to the system, as `give_back` does that of Python; false if this JVM
    has no such command. Its many threads and compilations leave some hundred MB to the C library, which keeps them."""
    sc = spark.sparkContext
    jvm = sc._jvm
    names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    kinds = sc._gateway.new_array(jvm.Class, len(names))
    try:
        for k, name in enumerate(names):
            kinds[k] = jvm.Class.forName(name)
        values = sc._gateway.new_array(jvm.Object, len(names))
        values[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        values[1] = "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, values)
    except Py4JError:
        return False
    return True


def give_back() -> None:
    """Returns free memory to the system: a Python worker outlives its task, and the next stage needs the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library offers it
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of bounded text; null texts become empty."""
    for batch in batches:
        k = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(k).cast(pa.large_string()), "")
        arrays = batch.columns
        arrays[k] = text
        batch = pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def sliced(text: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """A text array in pieces of bounded text; null texts become empty."""
    for batch in text_slices(iter([pa.RecordBatch.from_arrays([text], names=["text"])]), size=size):
        yield batch.column("text")


def unused_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one if the table has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_codes(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: a code per word in text order, where each text's words begin, distinct words."""
    if lower:
        text = pc.ascii_lower(text)
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(text))
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    blank = pc.index(words, pa.scalar("", words.type)).as_py()
    if blank >= 0:
        owner = np.repeat(np.arange(len(lengths)), lengths)
        keep = codes != blank
        lengths = np.bincount(owner[keep], minlength=len(lengths))
        codes = codes[keep]
    starts = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    return codes, starts, words


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w.encode(), seed) for w in words.to_pylist()), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers, so that every bit depends on every other."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of every window of `size` words; a shorter non-empty text is one window. In text order."""
    n = np.diff(starts)
    owner = np.repeat(np.arange(len(n)), n)
    position = np.arange(len(hashes)) - starts[:-1][owner]
    windows = np.maximum(n - size + 1, np.minimum(n, 1))
    out = np.zeros(len(hashes), np.uint64)
    left = n[owner] - position
    with np.errstate(over="ignore"):
        for k in range(size):
            have = left > k
            step = np.zeros(len(hashes), np.uint64)
            at = np.flatnonzero(have)
            step[at] = hashes[at + k]
            out = np.where(have, mixed(out * np.uint64(0x9E3779B97F4A7C15) + step + np.uint64(k + 1)), out)
    begins = position < windows[owner]
    return out[begins], owner[begins]


def distinct_per_owner(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by owner and value, repeats removed."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[first], owner[first]
