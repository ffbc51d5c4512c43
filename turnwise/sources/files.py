"""Driver-side listing through the Hadoop file system API, so any supported URI works."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession


REPLACED = "_replaced"  # ending of a folder that is being replaced


@dataclass(frozen=True)
class FileEntry:
    path: str
    name: str
    length: int
    is_dir: bool


def _open(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def literal(path: str) -> str:
    """The path with pattern characters escaped, for Spark readers, which would expand them."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _open(spark, path)
    return fs.exists(target)


def children(spark: SparkSession, path: str) -> list[FileEntry]:
    """Direct children by name."""
    fs, target = _open(spark, path)
    found = [
        FileEntry(s.getPath().toString(), s.getPath().getName(), s.getLen(), s.isDirectory())
        for s in fs.listStatus(target)
    ]
    return sorted(found, key=lambda e: e.name)


def walk(spark: SparkSession, path: str) -> list[FileEntry]:
    """All files below ``path``, including those under directories that begin with ``_`` or ``.``."""
    fs, target = _open(spark, path)
    found, remaining = [], fs.listFiles(target, True)
    while remaining.hasNext():
        s = remaining.next()
        found.append(FileEntry(s.getPath().toString(), s.getPath().getName(), s.getLen(), False))
    return sorted(found, key=lambda e: e.path)


def read_head(spark: SparkSession, path: str, size: int) -> bytes:
    """At most the first ``size`` bytes."""
    fs, target = _open(spark, path)
    size = min(size, fs.getFileStatus(target).getLen())
    stream = fs.open(target)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def matches(spark: SparkSession, pattern: str) -> int:
    """How many paths a pattern has."""
    fs, target = _open(spark, pattern)
    return len(fs.globStatus(target) or [])


def uri(spark: SparkSession, path: str) -> str:
    """The path as Spark's file metadata writes it, encoded; of local files with one slash."""
    fs, target = _open(spark, path)
    return re.sub("^file:/+", "file:/", fs.makeQualified(target).toUri().toString()).rstrip("/")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, target = _open(spark, path)
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode("utf-8"))


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder; the target must not be there."""
    fs, path = _open(spark, source)
    to = _open(spark, target)[1]
    if fs.exists(to) or not fs.rename(path, to):
        raise OSError(f"{source} could not be renamed to {target}")


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _open(spark, path)
    fs.delete(target, True)


def replace_folder(spark: SparkSession, new: str, path: str) -> None:
    """Puts a complete folder in the place of another one, which is kept aside until the new one stands there."""
    if not exists(spark, path):
        move(spark, new, path)
        return
    aside = f"{path}{REPLACED}"
    if exists(spark, aside):
        remove(spark, aside)
    move(spark, path, aside)
    try:
        move(spark, new, path)
    except Exception:
        move(spark, aside, path)
        raise
    remove(spark, aside)


def restore_folder(spark: SparkSession, path: str) -> None:
    """Puts back what a replacement that was interrupted between its two renames has left aside."""
    aside = f"{path}{REPLACED}"
    if not exists(spark, path) and exists(spark, aside):
        move(spark, aside, path)
