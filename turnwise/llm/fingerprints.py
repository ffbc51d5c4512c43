"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k least distinct 64-bit hashes of a document's shingles, ascending. A sketch of fewer than k hashes is
the whole set. Sketches merge by taking the k least of both; from two sketches resemblance, containment and distinct
counts are estimated. As text, a sketch is its hashes in lowercase hex, 16 digits each; a document without words has the
empty sketch. Words are runs of other than ASCII white space; a document of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.arrow_text import distinct_per_owner, shingle_hashes, text_slices, word_codes, word_hashes

SIZE, SHINGLE = 64, 5
LEAST = -(1 << 63)  # stands for a null doc_id in the order: before all others


def sketches(texts: Sequence[str], size: int = SIZE, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text, ascending unsigned 64-bit hashes."""
    codes, starts, words = word_codes(pa.array(texts, pa.large_string()))
    hashes, owner = shingle_hashes(word_hashes(words)[codes], starts, shingle)
    hashes, owner = distinct_per_owner(hashes, owner)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [hashes[a : min(a + size, b)] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Sketch of the union of both sets."""
    return np.union1d(a, b)[:size]


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated size of the intersection over that of the union; 1 for two empty sets, 0 for one."""
    x, y = set(a.tolist()), set(b.tolist())
    if not x or not y:
        return float(not x and not y)
    least = sorted(x | y)[:size]
    return sum(h in x and h in y for h in least) / len(least)


def distinct_count(a: np.ndarray, size: int = SIZE) -> float:
    """Estimated number of distinct shingles; exact below `size`."""
    return float(len(a)) if len(a) < size else (size - 1) / (float(a[size - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, size)
    both = j * distinct_count(merge(a, b, size), size)
    return min(1.0, both / distinct_count(a, size))


def _parts(documents: DataFrame) -> tuple[list[int], list[int]]:
    """Bounds of ranges of doc_id, about as many as shuffle partitions, and the least id in each that has any."""
    key = F.coalesce("doc_id", F.lit(LEAST)).alias("key")
    keys = documents.select(key)
    n = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = keys.approxQuantile("key", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else []
    bounds = sorted({int(c) for c in cuts})
    least = keys.groupBy(_part_of(F.col("key"), bounds).alias("part")).agg(F.min("key").alias("key"))
    return bounds, sorted(r.key for r in least.collect())  # one id per range


def _part_of(key: Column, bounds: list[int]) -> Column:
    array = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def part(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(array, keys.to_numpy(np.int64), side="right").astype(np.int32))

    return part(key)


def with_next_text(documents: DataFrame) -> DataFrame:
    """(part, tail, key, doc_id, text), sorted in partitions so that the row after a document's is the next document's.

    The order is doc_id (null first), then text; the first document follows the last. The first document of each range
    is sent to the range before it as well, marked `tail`. Only a list of one id per range comes to the driver.
    """
    bounds, least = _parts(documents)
    firsts, n = np.array(least, np.int64), max(1, len(least))

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        values = keys.to_numpy(np.int64)
        part = np.searchsorted(firsts, values, side="right") - 1
        return pd.Series([[p, (p - 1) % n] if firsts[p] == v else [p] for p, v in zip(part.tolist(), values, strict=True)])

    rows = documents.select("doc_id", "text").withColumn("key", F.coalesce("doc_id", F.lit(LEAST)))
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "key", F.posexplode(places("key")).alias("tail", "part"))
    rows = rows.select("part", F.col("tail").cast("int").alias("tail"), "key", "doc_id", "text")
    return rows.repartition("part").sortWithinPartitions("part", "tail", "key", "text")


def fingerprint_documents(documents: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_distinct per document.

    The edited text has the last half of the code points (rounded down) replaced by the first as many of the next
    document. A null text is empty. Repeated doc_ids follow each other by text. One shuffle of the texts.
    """

    def flush(ids: list, texts: list[str]) -> pa.RecordBatch:
        """One row for each text but the last, which is only the next one."""
        edited = []
        for here, following in zip(texts[:-1], texts[1:], strict=True):
            half = len(here) // 2
            edited.append(here[: len(here) - half] + following[:half])
        own, new = sketches(texts, size, shingle), sketches(edited, size, shingle)
        columns = {
            "doc_id": pa.array(ids, pa.int64()),
            "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": [to_text(s) for s in own[:-1]],
            "edited_fingerprint": [to_text(s) for s in new],
            "near_edited": [resemblance(a, b, size) for a, b in zip(own, new, strict=False)],
            "near_next": [resemblance(a, b, size) for a, b in zip(own, own[1:], strict=False)],
            "n_distinct": [distinct_count(s, size) for s in own[:-1]],
        }
        return pa.RecordBatch.from_pydict(columns)

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        part = None
        done = True  # whether the part's last document has met its next one
        for batch in text_slices(batches):
            for p, tail, doc_id, text in zip(
                batch.column("part").to_pylist(), batch.column("tail").to_pylist(), batch.column("doc_id").to_pylist(),
                batch.column("text").to_pylist(), strict=True,
            ):
                if p != part:
                    part, done, ids, texts = p, False, [], []
                if done:
                    continue  # further documents with the id of the next one
                texts.append(text)
                if tail:
                    done = True
                    yield flush(ids, texts)
                    ids, texts = [], []
                else:
                    ids.append(doc_id)
            if len(texts) > 1:
                yield flush(ids[:-1], texts)
                ids, texts = ids[-1:], texts[-1:]

    return with_next_text(documents).mapInArrow(
        fingerprint,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, n_distinct double",
    )
