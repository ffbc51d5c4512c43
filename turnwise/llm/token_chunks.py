"""Token ids of whole texts through the tokenizers library, each distinct piece encoded once per worker.

Words are joined to the space before them by the byte-level pre-tokeniser, so a text may be cut before any single space
that stands between two characters other than white space: the ids of the parts are the ids of the whole. Pieces that
touch other white space are put together again before they are encoded. The strings of special tokens inside a text are
ordinary text.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from itertools import compress, repeat
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 400_000  # distinct pieces remembered by a worker; beyond it those stay that more than one slice has used
CACHE_CHARS = 16 << 20  # and characters of them
MATCHES = 1 << 18  # the pattern's matches remembered, of which pieces consist; beyond it those used most stay, half as many at most
TOGETHER = 1 << 12  # matches that one call of the library encodes
CLOSERS = frozenset(".,;:!?")  # a match by itself behind letters, at the end of a text

Encode = Callable[[Iterable[str]], tuple[np.ndarray, np.ndarray]]  # ids one after another, and how many each text has


def flattened(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for x in ids for i in x], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))


def strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


class IdLists:
    """Lists of ids that grow in number."""

    def __init__(self):
        self.flat = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(1 << 17, np.int64)
        self.used = self.size = 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        total, n = len(ids), len(counts)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.size + n > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.used : self.used + total] = ids
        self.ends[self.size : self.size + n] = self.used + np.cumsum(counts)
        self.used += total
        self.size += n

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows one after another, and how many each has."""
        stop = self.ends[rows]
        start = np.where(rows > 0, self.ends[rows - 1], 0)
        counts = stop - start
        ends = np.cumsum(counts)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - counts), counts)
        return self.flat[at], counts


def rows_or_new(texts: list[str], known: dict[str, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of each of the distinct texts, and which were new: those are given the rows from `size` up."""
    rows = np.fromiter(map(known.get, texts, repeat(-1)), np.int64, len(texts))
    new = np.flatnonzero(rows < 0)
    if len(new):
        rows[new] = size + np.arange(len(new))
        known.update(zip([texts[k] for k in new.tolist()], range(size, size + len(new)), strict=True))
    return rows, new


class MatchEncoder:
    """Ids of matches of the pattern by a byte-level model, many in one call of the library; each distinct one once while
    it is remembered. A call's ids are dealt to the matches by the bytes that they stand for."""

    def __init__(self, model: Any):
        from tokenizers import Tokenizer, pre_tokenizers

        # the library's pre-tokeniser stands for bytes by printable characters: 33-126, 161-172 and 174-255 by themselves,
        # the others by 256 and up; a line feed is none of them
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.stands = np.array([b if b in own else next(rest) for b in range(256)], "<u2")
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        vocabulary = self.tokenizer.get_vocab()
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.widths[list(vocabulary.values())] = list(map(len, vocabulary))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}  # in the order of their rows
        self.lists = IdLists()
        self.uses = np.zeros(0, np.int32)  # calls that asked for the row

    def make_room(self) -> None:
        """Numbers the rows anew. Most matches are met in one call alone; those that later calls asked for again stay."""
        if self.lists.size <= MATCHES:
            return
        least = 2
        while np.count_nonzero(self.uses >= least) > MATCHES // 2:
            least *= 2
        stays = self.uses >= least
        ids, counts = self.lists.gather(np.flatnonzero(stays))
        known = dict(zip(compress(self.known, stays.tolist()), range(len(counts)), strict=True))
        self.clear()
        self.known, self.uses = known, np.zeros(len(counts), np.int32)
        self.lists.add(ids, counts)

    def rows(self, matches: list[str]) -> np.ndarray:
        """Place in the lists of each match, none of which is empty; valid until the next call."""
        self.make_room()
        rows = np.fromiter(map(self.known.get, matches, repeat(-1)), np.int64, len(matches))
        at = np.flatnonzero(rows < 0)
        found = [matches[k] for k in at.tolist()]
        new = list(dict.fromkeys(found))
        if new:
            self.known.update(zip(new, range(self.lists.size, self.lists.size + len(new)), strict=True))
            rows[at] = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
            unknown = pa.array(new, pa.large_string())
            for k in range(0, len(unknown), TOGETHER):
                self.lists.add(*self._encoded(unknown.slice(k, TOGETHER)))
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
        self.uses[rows] += 1
        return rows

    def _encoded(self, matches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ends = np.frombuffer(matches.buffers()[1], np.int64, len(matches) + 1, matches.offset * 8)
        data = np.frombuffer(matches.buffers()[2], np.uint8, int(ends[-1] - ends[0]), int(ends[0]))
        ends = ends - ends[0]
        text = np.insert(self.stands[data], ends[1:-1], 10).tobytes().decode("utf-16-le")
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        reach = np.cumsum(self.widths[ids])
        cuts = np.searchsorted(reach, ends[1:])
        if not np.array_equal(reach[cuts], ends[1:]):
            raise ValueError("the model's tokens do not cover every byte")
        return ids, np.diff(cuts, prepend=-1)


def library_encoder(path: str) -> Encode:
    """Ids by a byte-level BPE file of the tokenizers library: its pattern's matches, each by the library's model."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    if not isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) or tokenizer.normalizer is not None:
        tokenizer.encode_special_tokens = True
        return lambda texts: flattened([e.ids for e in tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)])
    matches, encoder = regex.compile(PATTERN).findall, MatchEncoder(tokenizer.model)

    def encode(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = list(texts)
        bodies = [text.removeprefix(" ") for text in texts]
        single = np.fromiter(map(str.isalpha, bodies), bool, len(texts))  # letters with or without a space are one match
        counts = np.ones(len(texts), np.int64)
        found: list[str] = []
        sizes: list[int] = []
        others = (~single).tolist()
        for text, body in zip(compress(texts, others), compress(bodies, others), strict=True):
            if body[:-1].isalpha() and body[-1] in CLOSERS:
                found += (text[:-1], body[-1])
                sizes.append(2)
            else:
                several = matches(text)
                found += several
                sizes.append(len(several))
        counts[~single] = sizes
        known = encoder.rows([*compress(texts, single.tolist()), *found])
        rows = np.empty(len(known), np.int64)
        alone = np.repeat(single, counts)
        rows[alone], rows[~alone] = np.split(known, [int(single.sum())])
        ids, sizes = encoder.lists.gather(rows)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends[np.cumsum(counts)], prepend=0)

    return encode


class PieceTable:
    """Ids of pieces: a growing table of the distinct ones, looked up for whole Arrow slices at a time."""

    def __init__(self, encode: Encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.known: tuple[dict[str, int], dict[str, int]] = ({}, {})  # rows of pieces as they are, and after a space
        self.lists = IdLists()
        self.loose = np.zeros(0, bool)
        self.uses = np.zeros(0, np.int32)  # slices that asked for the row
        self.chars = 0

    def make_room(self) -> None:
        """Called between slices only, as it numbers the rows anew. A full table keeps what more than one slice has used
        since the last time, or nothing if that alone half fills it."""
        if self.lists.size <= CACHE and self.chars <= CACHE_CHARS:
            return
        kept = np.flatnonzero(self.uses > 1)
        place = np.full(self.lists.size, -1, np.int64)
        place[kept] = np.arange(len(kept))
        ids, counts = self.lists.gather(kept)
        loose = self.loose[kept]
        stay = place.tolist()
        known = tuple({p: stay[r] for p, r in rows.items() if stay[r] >= 0} for rows in self.known)
        chars = sum(len(p) for rows in known for p in rows)
        self.clear()
        if len(kept) <= CACHE // 2 and chars <= CACHE_CHARS // 2:
            self.known = known
            self.store(ids, counts, loose, chars)

    def store(self, ids: np.ndarray, counts: np.ndarray, loose: np.ndarray, chars: int) -> None:
        """Adds rows."""
        self.lists.add(ids, counts)
        self.loose = np.concatenate([self.loose, loose])
        self.uses = np.concatenate([self.uses, np.zeros(len(loose), np.int32)])
        self.chars += chars

    def rows(self, pieces: pa.Array, after_space: bool) -> np.ndarray:
        """Row of each distinct piece, encoded with a space before it or as it is."""
        texts = strings(pieces)
        rows, new = rows_or_new(texts, self.known[after_space], self.lists.size)
        if len(new):
            texts = [texts[k] for k in new.tolist()]
            ids, counts = self.encode([" " + p for p in texts] if after_space else texts)
            # a piece at whose edge there is white space, or an empty one, does not stand by itself
            loose = ~np.fromiter(map(str.isalpha, texts), bool, len(texts))
            loose[loose] = [not p or p[0].isspace() or p[-1].isspace() for p in compress(texts, loose.tolist())]
            self.store(ids, counts, loose, sum(map(len, texts)))
        self.uses[rows] += 1
        return rows

    def rows_of_texts(self, pieces: list[str], after_space: bool) -> np.ndarray:
        """Row of each piece; they may repeat."""
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        return self.rows(coded.dictionary, after_space)[coded.indices.to_numpy(zero_copy_only=False)]

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows one after another, and how many each has."""
        return self.lists.gather(rows)


_tables: dict[str, PieceTable] = {}


def worker_table(name: str, encoder: Callable[[], Encode]) -> PieceTable:
    """One table per Python worker, kept between its tasks."""
    if name not in _tables:
        _tables[name] = PieceTable(encoder())
    return _tables[name]


def piece_rows(text: pa.Array, table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the pieces in text order, and how many each text has."""
    table.make_room()
    split = pc.split_pattern(text, " ")
    n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    rows = table.rows(words, True)[codes]
    first = np.zeros(len(codes), bool)
    first[np.cumsum(n) - n] = True
    loose = table.loose[rows]
    glue = np.zeros(len(codes), bool)
    glue[1:] = loose[1:] | loose[:-1]
    glue &= ~first
    at = np.flatnonzero(first)
    rows[at] = table.rows_of_texts(strings(words.take(pa.array(codes[at]))), False)
    if glue.any():
        kept = np.flatnonzero(~glue)
        sizes = np.diff(np.append(kept, len(codes)))
        heads, sizes = kept[sizes > 1], sizes[sizes > 1]
        ends = np.cumsum(sizes)
        parts = strings(words.take(pa.array(codes[np.arange(int(ends[-1])) + np.repeat(heads - (ends - sizes), sizes)])))
        wholes = [" ".join(parts[e - k : e]) for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
        for begins in (False, True):
            some = np.flatnonzero(first[heads] == begins)
            rows[heads[some]] = table.rows_of_texts([wholes[k] for k in some.tolist()], not begins)
        n = np.bincount(np.repeat(np.arange(len(n)), n)[kept], minlength=len(n))
        rows = rows[kept]
    return rows, n


def token_ids(text: pa.Array, table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all the texts one after another, and how many each has. Empty text: none."""
    rows, n = piece_rows(text, table)
    ids, counts = table.gather(rows)
    owner = np.repeat(np.arange(len(n)), n)
    return ids, np.bincount(owner, weights=counts, minlength=len(n)).astype(np.int64)
