"""Documents that repeat benchmark items.

A document is contaminated if it has a run of ``n`` words in common with an item: words are runs of letters and digits in
lower case, whatever stands between them. Items of fewer words count as one run of all their words.

Runs are rolling 64-bit hashes of their words' hashes. A bit map of fixed largest size holds the items' runs; a document's
runs that are not in it are dropped where they are made, and only the others become text, which is compared exactly. A
full bit map lets more runs through and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from turnwise.operators.hot import hot_join

WORD = r"[\p{L}\p{M}\p{N}]+"
MAX_SHIPPED_BYTES = 32 << 20  # of the items' runs
MAX_BITS = 27  # power of two of the bit map's largest size
BITS_PER_RUN = 16
WORDS_AT_ONCE = 1 << 18  # beginnings of runs that are hashed together


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _runs(sizes: list[int], bits: np.ndarray | None, power: int, at_once: int = WORDS_AT_ONCE):
    """``(at, size, hash)`` of each run of these numbers of words, from lists of word hashes; only those in the bit map.

    Runs are hashed for ``at_once`` beginnings at a time, wherever a document ends: what is held besides the batch and
    the runs found does not depend on the batch.
    """

    @arrow_udf("array<struct<at:int,size:int,hash:bigint>>")
    def runs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def found_in(values: np.ndarray, ends: np.ndarray, start: int):
            """Document, place, size and hash of the runs that begin in one slice of the words of all documents."""
            stop = min(start + at_once, len(values))
            begin = np.arange(start, stop)
            owner = np.searchsorted(ends, begin, side="right")
            left = ends[owner] - begin
            found = []
            for size in sizes:
                at = np.flatnonzero(left >= size)
                rolled = np.full(len(at), size, np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(size):
                        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + values[at + (start + k)]
                    rolled = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                if bits is not None:
                    bit = rolled >> np.uint64(64 - power)
                    inside = (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                    at, rolled = at[inside], rolled[inside]
                found.append((at, np.full(len(at), size, np.int32), rolled))
            at, size, rolled = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(at, kind="stable")
            at, size, rolled = at[order], size[order], rolled[order]
            before = np.concatenate([[0], ends])[owner[at]]
            return owner[at].astype(np.int32), (at + start - before).astype(np.int32), size, rolled

        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = batch.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(counts)
            slices = [found_in(values, ends, start) for start in range(0, max(len(values), 1), at_once)]
            owner, place, size, rolled = (np.concatenate(x) for x in zip(*slices, strict=True))
            del slices
            starts = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(np.bincount(owner, minlength=len(counts)), out=starts[1:])
            rows = pa.StructArray.from_arrays(
                [pa.array(place), pa.array(size), pa.array(rolled.view(np.int64))], names=["at", "size", "hash"]
            )
            yield pa.ListArray.from_arrays(pa.array(starts), rows)

    return runs


def _hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _run_texts(rows: DataFrame, key: str) -> DataFrame:
    """``(key, run)``: the text of each run of a row."""
    each = rows.select(key, "words", F.explode("runs").alias("run"))
    text = F.array_join(F.slice("words", F.col("run.at") + 1, F.col("run.size")), " ")
    return each.select(key, text.alias("run"))


def _bit_map(runs: DataFrame, power: int) -> np.ndarray:
    """A bit for each hash, by its leading bits; only the 64-bit words that are not 0 come to the driver."""
    bit = F.shiftrightunsigned("hash", 64 - power)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    rows = runs.groupBy(F.shiftright(bit, 6).alias("place")).agg(F.bit_or(one).alias("bit")).toArrow()
    bits = np.zeros(1 << max(power - 6, 0), np.uint64)
    bits[rows.column("place").to_numpy()] = rows.column("bit").to_numpy().view(np.uint64)
    return bits


def contaminated_documents(
    documents: DataFrame,
    items: DataFrame,
    n: int = 8,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    max_shipped: int = MAX_SHIPPED_BYTES,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``(doc_id, n_items, contaminated)``: one row per document, with how many items share a run with it.

    The runs of the items are counted by their number of words first: ``n``, and less for items that are shorter; the
    documents' runs of these numbers are looked up. Items' runs of up to ``max_shipped`` bytes are broadcast, more are
    joined, a run that is frequent in the documents dealt over several tasks. A NULL text has none.
    """
    cut = items.select(F.col(item_id).alias("item"), words(F.col(text)).alias("words")).filter(F.size("words") > 0)
    lengths = [r[0] for r in cut.select(F.least(F.size("words"), F.lit(n)).alias("size")).distinct().collect()]  # at most n
    sizes = sorted(lengths) or [n]
    hashed = cut.withColumn("hashes", _hashes("words")).withColumn("runs", _runs(sizes, None, 0)("hashes"))
    # of an item the runs of its own size: n words, or all it has
    own = F.filter("runs", lambda r: r["size"] == F.least(F.size("words"), F.lit(n)))
    hashed = hashed.withColumn("runs", own)
    wanted = _run_texts(hashed, "item").distinct()
    n_runs, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("run")), F.lit(0))).first()
    power = min(max((n_runs * BITS_PER_RUN).bit_length(), 10), max_bits)
    bits = _bit_map(hashed.select(F.explode("runs.hash").alias("hash")), power)
    rows = documents.select(F.col(doc_id).alias("doc"), words(F.col(text)).alias("words"))
    rows = rows.withColumn("runs", _runs(sizes, bits, power)(_hashes("words"))).filter(F.size("runs") > 0)
    runs = _run_texts(rows, "doc")
    met = runs.join(F.broadcast(wanted), "run") if size <= max_shipped else hot_join(runs, wanted, ["run"])
    hits = met.groupBy("doc").agg(F.countDistinct("item").alias("n_items"))
    found = documents.select(F.col(doc_id).alias("id")).join(hits, F.col("id").eqNullSafe(F.col("doc")), "left")
    count = F.coalesce("n_items", F.lit(0))
    return found.select(F.col("id").alias(doc_id), count.alias("n_items"), (count > 0).alias("contaminated"))
