"""Byte-level BPE by a file of ranks: encoding with segment trees over byte positions, and decoding.

Each match of the pattern is encoded by itself. A segment tree stands over the byte positions of a match; its leaf at a
position holds the rank of the pair of live tokens that begins there, and each node the least rank below it, leftmost
first. A merge takes the root's pair, joins it, and updates the three leaves of the live neighbours up to the root, so a
match of n bytes costs O(n log n) whatever the text looks like. Trees of one size are worked on together, one merge of
each at a time.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnwise.llm.arrow_text import text_slices
from turnwise.llm.token_chunks import PieceTable, token_ids, worker_table

NONE = np.int64(1) << 62  # no pair
PLACE = 31  # bits of a key below the rank, for the position
TOGETHER = 1 << 20  # bytes of matches worked on at once


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeTable:
    """For pairs of tokens whose bytes together are a token, its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], NONE)
        self.values = np.append(np.array(values, np.int64)[order], 0)

    def key(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank and place of the pairs in one number; NONE where a pair has no rank or b is missing (negative)."""
        wanted = a << 32 | b
        at = np.searchsorted(self.keys, wanted)
        found = (self.keys[at] == wanted) & (b >= 0)
        return np.where(found, self.values[at] << PLACE | place, NONE)


def merge_equal_trees(matches: list[bytes], width: int, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of matches of 2 to width + 1 bytes, one after another, and how many each has."""
    rows = len(matches)
    n = np.fromiter(map(len, matches), np.int64, rows)
    token = np.full((rows, width + 2), -1, np.int64)  # after a match's last byte there is none
    inside = np.arange(width + 2)[None, :] < n[:, None]
    token[inside] = table.bytes[np.frombuffer(b"".join(matches), np.uint8)]
    after = np.tile(np.arange(1, width + 3, dtype=np.int32), (rows, 1))
    before = np.tile(np.arange(-1, width + 1, dtype=np.int32), (rows, 1))
    tree = np.full((rows, 2 * width), NONE, np.int64)
    pair = inside[:, 1:-1]  # whether a pair begins at a place
    r, k = np.nonzero(pair)
    tree[r, width + k] = table.key(token[r, k], token[r, k + 1], k)
    level = width
    while level > 1:
        np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
        level //= 2
    r = np.flatnonzero(tree[:, 1] < NONE)
    while len(r):
        root = tree[r, 1]
        k = root & ((1 << PLACE) - 1)
        gone = after[r, k].astype(np.int64)
        then = after[r, gone].astype(np.int64)
        joined = root >> PLACE
        token[r, k], token[r, gone] = joined, -2
        after[r, k], before[r, then] = then, k
        left = before[r, k].astype(np.int64)
        middle = width + k
        high = np.where(gone < width, width + gone, middle)  # the last byte begins no pair
        low = np.where(left >= 0, width + left, middle)
        tree[r, high] = NONE
        tree[r, middle] = table.key(joined, token[r, then], k)
        some = left >= 0
        s, at = r[some], left[some]
        tree[s, width + at] = table.key(token[s, at], joined[some], at)
        size = width
        while size > 1:
            size //= 2
            for leaf in (low, middle, high):
                leaf >>= 1
                tree[r, leaf] = np.minimum(tree[r, 2 * leaf], tree[r, 2 * leaf + 1])
        r = r[tree[r, 1] < NONE]
    live = token >= 0
    return token[live], live.sum(axis=1)


def merge_matches(matches: list[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all the matches one after another, and how many each has. A match that is a token is that token."""
    whole = [table.ranks.get(m, -1) for m in matches]
    counts = np.ones(len(matches), np.int64)
    widths: dict[int, list[int]] = {}
    for k, w in enumerate(whole):
        if w < 0:
            widths.setdefault(1 << (len(matches[k]) - 2).bit_length(), []).append(k)
    at = [k for k, w in enumerate(whole) if w >= 0]
    places, found = [np.array(at, np.int64)], [np.array([whole[k] for k in at], np.int64)]
    for width, members in widths.items():
        step = max(1, TOGETHER // (width * 8))
        for a in range(0, len(members), step):
            some = members[a : a + step]
            ids, n = merge_equal_trees([matches[k] for k in some], width, table)
            counts[some] = n
            places.append(np.repeat(np.array(some, np.int64), n))
            found.append(ids)
    owner, ids = np.concatenate(places), np.concatenate(found)
    return ids[np.argsort(owner, kind="stable")], counts


def rank_encoder(path: str, pattern: str) -> Callable[[Iterable[str]], tuple[np.ndarray, np.ndarray]]:
    import regex

    table, find = MergeTable(read_ranks(path)), regex.compile(pattern).findall

    def encode(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        place: dict[str, int] = {}
        matches: list[int] = []
        of: list[int] = []
        for text in texts:
            found = find(text)
            of.append(len(found))
            matches += [place.setdefault(m, len(place)) for m in found]
        ids, counts = merge_matches([m.encode() for m in place], table)
        starts = np.cumsum(counts) - counts
        match = np.array(matches, np.int64)
        n = counts[match]
        at = np.repeat(starts[match] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        text_of = np.repeat(np.arange(len(of)), of)
        return ids[at].astype(np.uint32), np.bincount(text_of, weights=n, minlength=len(of)).astype(np.int64)

    return encode


def decoded_bytes(ids: np.ndarray, counts: np.ndarray, tokens: list[bytes]) -> pa.Array:
    """What the ids of each list stand for. An id without a token is an error."""
    lengths = np.fromiter(map(len, tokens), np.int32, len(tokens))
    size = lengths[np.minimum(ids, len(tokens) - 1)]
    if len(ids) and (not size.all() or ids.min() < 0 or ids.max() >= len(tokens)):
        raise ValueError("an id has no token in the file of ranks")
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.concatenate([[0], np.cumsum(counts)])]
    data = b"".join(map(tokens.__getitem__, ids.tolist()))
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())


def _tokens(ranks_path: str) -> list[bytes]:
    ranks = read_ranks(ranks_path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def encode_documents(documents: DataFrame, ranks_path: str, pattern: str, decode: bool = False) -> DataFrame:
    """(doc_id, ids), and with `decode` the bytes got back from the ids; narrow. A null text is empty and has no ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: PieceTable = worker_table(f"{ranks_path} {pattern}", lambda: rank_encoder(ranks_path, pattern))
        tokens = _tokens(ranks_path) if decode else []
        for batch in text_slices(batches, size=4 << 20):
            ids, counts = token_ids(batch.column("text"), table)
            ends = np.concatenate([[0], np.cumsum(counts)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
            columns = {"doc_id": batch.column("doc_id"), "ids": lists}
            if decode:
                columns["decoded"] = decoded_bytes(ids, counts, tokens)
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, ids array<int>" + (", decoded binary" if decode else "")
    return documents.select("doc_id", "text").mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, decoded) per row of (doc_id, ids); null ids are none."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(ranks_path)
        for batch in batches:
            lists = batch.column("ids")
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            decoded = decoded_bytes(lists.flatten().to_numpy(zero_copy_only=False), counts, tokens)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), decoded], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, decoded binary")
