"""A file that is one JSON array of flat objects, of any size and in any writing.

Spark's text reader cuts the file at every closing brace, in splits. Whether such a brace ends an object depends on all the
text before it: on whether that leaves a string open, and on how deep it is nested. Both are sums, so one pass over the
splits gives each split's own sums for either state of the quotes, sums over the splits give the state at which each one
begins, and a second pass cuts objects in every split by itself. An object over the border of two splits is put together
by its number, which is known in both. Nothing has to be repeated in the file: not the order of keys, not the spacing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from turnwise.sources import files


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The texts between closing braces in file order, each with the start of its split."""
    return spark.read.option("lineSep", "}").text(files.literal(path)).select(
        F.col("_metadata.file_block_start").alias("start"), "value"
    )


def _scanner():
    """Built in a function, so that workers need no copy of this package."""

    def outside(piece: str, quoted: bool) -> tuple[str, bool]:
        """What of a piece is in no string, and whether it leaves one open."""
        parts = piece.replace("\\\\", "").replace('\\"', "").split('"')
        return "".join(parts[1 if quoted else 0 :: 2]), quoted ^ (len(parts) % 2 == 0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per split and state of the quotes at its start: the state at its end, the change of depth, and how many
        closing braces come to each depth, relative to the start."""
        import pyarrow as pa

        found: dict[int, list] = {}
        for batch in batches:
            for start, piece in zip(batch.column("start").to_pylist(), batch.column("value").to_pylist(), strict=True):
                states = found.setdefault(start, [[False, 0, {}], [True, 0, {}]])
                for state in states:
                    text, state[0] = outside(piece, state[0])
                    state[1] += text.count("{")
                    if state[0]:
                        continue  # the brace behind the piece is part of a string
                    state[1] -= 1
                    state[2][state[1]] = state[2].get(state[1], 0) + 1
        rows = [(s, q, *state) for s, states in found.items() for q, state in enumerate(states)]
        for start, quoted, ends_quoted, depth, closings in rows:
            yield pa.RecordBatch.from_pydict(
                {
                    "start": pa.array([start]),
                    "quoted": pa.array([bool(quoted)]),
                    "ends_quoted": pa.array([ends_quoted]),
                    "depth": pa.array([depth], pa.int64()),
                    "depths": pa.array([list(closings)], pa.list_(pa.int64())),
                    "closings": pa.array([list(closings.values())], pa.list_(pa.int64())),
                }
            )

    def cutter(begins: dict[int, tuple[bool, int, int]]):
        def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """``number, start, whole, text`` of each object, or part of one at a border, of the splits."""
            import pyarrow as pa

            start, rows, held, size = None, [], [], 0
            quoted, depth, number, whole = False, 0, 0, True

            def flushed() -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                rows.clear()
                kinds = {"number": pa.int64(), "start": pa.int64(), "whole": pa.bool_(), "text": pa.string()}
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds)
                )

            for batch in batches:
                for at, piece in zip(batch.column("start").to_pylist(), batch.column("value").to_pylist(), strict=True):
                    if at != start:
                        if held and depth:
                            rows.append((number, start, False, "}".join([*held, ""])))
                        start, held = at, []
                        quoted, depth, number = begins[at]
                        whole = depth == 0
                    text, quoted = outside(piece, quoted)
                    opened = depth + text.count("{")
                    if not opened:
                        continue  # the end of the array
                    held.append(piece)
                    depth = opened
                    if quoted:
                        continue
                    depth -= 1
                    if depth == 0:
                        rows.append((number, start, whole, "}".join([*held, ""])))
                        size += len(rows[-1][3])
                        held, whole, number = [], True, number + 1
                        if size > 4 << 20:
                            yield flushed()
                            size = 0
            if held and depth:
                rows.append((number, start, False, "}".join([*held, ""])))
            yield flushed()

        return objects

    return sums, cutter


def _beginnings(sums: list) -> dict[int, tuple[bool, int, int]]:
    """State of the quotes, depth and number of objects before each split, from the splits' sums in file order."""
    by_start: dict[int, dict[bool, object]] = {}
    for r in sums:
        by_start.setdefault(r.start, {})[r.quoted] = r
    begins, quoted, depth, number = {}, False, 0, 0
    for start in sorted(by_start):
        begins[start] = (quoted, depth, number)
        r = by_start[start][quoted]
        number += sum(n for d, n in zip(r.depths, r.closings, strict=True) if depth + d == 0)
        quoted, depth = r.ends_quoted, depth + r.depth
    if quoted or depth != -1:  # no brace stands behind the last piece
        raise ValueError("the file ends inside an object or without the end of the array")
    return begins


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, row_id: str = "row_id") -> DataFrame:
    """Rows of the array, numbered from 0 in file order. Text that is no array of objects is an error."""
    if any(not isinstance(f.dataType, T.StringType) for f in schema):
        raise ValueError("a JSON array file holds flat objects of strings")
    sums, cutter = _scanner()
    found = _pieces(spark, path).mapInArrow(
        sums, "start long, quoted boolean, ends_quoted boolean, depth long, depths array<long>, closings array<long>"
    )
    begins = _beginnings(found.collect())  # two rows for each split of the file
    cut = _pieces(spark, path).mapInArrow(cutter(begins), "number long, start long, whole boolean, text string")
    parts = F.sort_array(F.collect_list(F.struct("start", "text")))
    borders = cut.filter("not whole").groupBy("number").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    objects = cut.filter("whole").select("number", "text").unionByName(borders)
    parsed = F.from_json(F.regexp_replace("text", r"^[\s\[,]*", ""), schema, {"mode": "FAILFAST"})
    return objects.select(F.col("number").alias(row_id), parsed.alias("row")).select(row_id, *[F.col(f"row.`{c}`") for c in schema.fieldNames()])
