"""Order-preserving packing of tokenised documents into windows by dynamic programming.

The ids of consecutive documents form one line. Windows may be cut at the ends of documents (free), at the ends of
sentences and, inside sentences longer than a stride, at every stride (both at a penalty for the truncation). The cost
of a window is its padding: what is missing to the window size, nothing if its length is the power of two below it. Cuts of least
total cost are found in one pass: the cost of ending at a cut is the least cost of an earlier cut within reach, kept in
a monotone queue, plus the padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnwise.llm.arrow_text import text_slices
from turnwise.llm.token_chunks import library_encoder, token_ids, worker_table

SENTENCE, INSIDE = 1.0, 4.0  # cost of cutting a document at the end of a sentence, or inside one, in padding tokens


@dataclass(frozen=True)
class PackOptions:
    window: int = 1024
    end_id: int = 0
    sentence_penalty: float = SENTENCE
    inside_penalty: float = INSIDE
    stride: int = 48  # a sentence longer than this may be cut at every stride
    line_tokens: int = 1 << 19  # documents are solved together until they hold so many ids


def best_cuts(positions: np.ndarray, penalties: np.ndarray, window: int) -> np.ndarray:
    """Indices of the chosen cuts. `positions` ascend from 0 to the end of the line with gaps of at most `window`."""
    n = len(positions)
    at, price = positions.tolist(), penalties.tolist()
    half = window // 2 if window & (window - 1) == 0 else 1 << (window.bit_length() - 1)
    cost, back = [0.0] * n, [0] * n
    keys, owners = [0.0] * n, [0] * n  # the queue: cost there + position there, ascending
    head = tail = other = 0
    for k in range(1, n):
        here = at[k]
        while at[owners[head]] + window < here:
            head += 1
        source = owners[head]
        best = keys[head] + window - here
        if best > 0.0:
            while at[other] + half < here:
                other += 1
            if at[other] + half == here and cost[other] < best:
                best, source = cost[other], other
        total = best + price[k]
        cost[k], back[k] = total, source
        key = total + here
        while tail >= head and keys[tail] >= key:
            tail -= 1
        tail += 1
        keys[tail], owners[tail] = key, k
    chosen, k = [n - 1], n - 1
    while k:
        k = back[k]
        chosen.append(k)
    return np.array(chosen[::-1], np.int64)


def cut_places(ids: np.ndarray, ends: np.ndarray, ends_sentence: np.ndarray, options: PackOptions) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a line may be cut, ascending from 0, and the price of each."""
    soft = np.flatnonzero(ends_sentence[np.minimum(ids, len(ends_sentence) - 1)]) + 1
    may, prices = np.zeros(len(ids) + 1, bool), np.full(len(ids) + 1, options.inside_penalty)
    may[soft], prices[soft] = True, options.sentence_penalty
    may[ends], prices[ends] = True, 0.0
    may[0], prices[0] = True, 0.0
    marks = np.flatnonzero(may)
    strides = (np.diff(marks) - 1) // options.stride  # cuts before the next mark
    which = np.arange(1, int(strides.sum()) + 1) - np.repeat(np.cumsum(strides) - strides, strides)
    may[np.repeat(marks[:-1], strides) + which * options.stride] = True
    places = np.flatnonzero(may)
    return places, prices[places]


@lru_cache(4)
def sentence_ends(tokenizer_path: str) -> np.ndarray:
    """Per id: whether its text closes a sentence or a line. Kept by the worker for its next tasks."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    texts = [tokenizer.decode([k]) for k in range(tokenizer.get_vocab_size())]
    return np.array([t.rstrip("\"')]")[-1:] in tuple(".!?\n。！？") and t != "" for t in texts])


def pack_documents(documents: DataFrame, tokenizer_path: str, options: PackOptions | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are taken in ascending doc_id (repeated ids: by text). A null or empty text is its end id alone. Every id
    is in exactly one piece. Only the texts are shuffled, once, by ranges of doc_id; a range is packed as a stream of
    lines of bounded length, the last window of a line being carried into the next one, so only the last sequence of a
    range may be short for want of documents. Sequence ids are unique, not dense. An empty table gives no rows.
    """
    o = options or PackOptions()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces = worker_table(tokenizer_path, lambda: library_encoder(tokenizer_path))
        closes = sentence_ends(tokenizer_path)
        state = {"sequence": TaskContext.get().partitionId() << 40}
        # the documents of a line: id, ids before the line, ids in the line, ids in all
        names: list = []
        before: list[int] = []
        inside: list[int] = []
        total: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def solve(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal names, before, inside, total, held, size
            ids = np.concatenate(held)
            ends = np.cumsum(inside)
            places, prices = cut_places(ids, ends, closes, o)
            cuts = places[best_cuts(places, prices, o.window)]
            if not last and len(cuts) > 2:
                cuts = cuts[:-1]  # the last window is solved again with what follows
            stop = int(cuts[-1])
            marks = np.union1d(cuts, np.concatenate([[0], ends[ends < stop]]))
            a, b = marks[:-1], marks[1:]
            doc = np.searchsorted(ends, a, side="right")
            window = np.searchsorted(cuts, a, side="right") - 1
            first = ends[doc] - np.array(inside)[doc]
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[x:y].tobytes()) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(marks, pa.int32()), pa.array(ids[:stop].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[d] for d in doc], pa.int64()),
                    pa.array(a - first + np.array(before)[doc], pa.int64()),
                    pa.array(b - a, pa.int64()),
                    lists,
                    pa.array(crc, pa.int64()),
                    pa.array(np.array(total)[doc], pa.int64()),
                    pa.array(window + state["sequence"], pa.int64()),
                    pa.array(a - cuts[window], pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            state["sequence"] += len(cuts) - 1
            keep = int(np.searchsorted(ends, stop, side="right"))
            names, total, before, inside = names[keep:], total[keep:], before[keep:], inside[keep:]
            if names:
                taken = inside[0] - int(ends[keep] - stop)
                before[0] += taken
                inside[0] -= taken
            held = [ids[stop:]] if stop < len(ids) else []
            size = len(ids) - stop

        for batch in text_slices(batches):
            ids, counts = token_ids(batch.column("text"), pieces)
            ids = np.insert(ids, np.cumsum(counts), o.end_id)
            counts = counts + 1
            ends = np.cumsum(counts)
            for name, n, end in zip(batch.column("doc_id").to_pylist(), counts.tolist(), ends.tolist(), strict=True):
                names.append(name)
                before.append(0)
                inside.append(n)
                total.append(n)
                held.append(ids[end - n : end])
                size += n
                if size >= o.line_tokens:
                    yield from solve(False)
        if names:
            yield from solve(True)

    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(
        pack,
        "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
