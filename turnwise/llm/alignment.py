"""Alignment of the tokens of two tokenizers over the bytes of the same text.

Both tokenizers cut a space and the text into tokens; the places where a token of each ends cut them into groups. The end
lists are sorted, and what they share is found by galloping: the shorter list drives, each of its ends is looked for in
the longer one from where an earlier end was found, in steps that double until they pass it, then by halves. The places
of common ends in both lists slice the groups; the tokens between two of them, by difference of ranks, overlap.

Neither tokenizer joins anything across a single space between two other characters, so distinct pieces are tokenised and
aligned once per worker and looked up after that; pieces next to other white space are put together first. How often a
pair of ids is linked is counted over the corpus. To look counts up again, the frequent pairs (at most ``LARGE``) are sent
to all tasks and the others are joined by pair.

Edge cases. Texts that are null, empty, or not reproduced byte for byte by both tokenizers have no tokens: all numbers are
0 and the digest is ''. Strings of special tokens inside a text are ordinary text. Rows are kept apart by their own
number, so null and repeated ids and equal rows are results of their own, and equal texts count each time. Other columns
come along where ``carry`` names them; results replace columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.arrow_text import give_back, shared_folder, text_slices, written
from turnwise.llm.token_chunks import Encode, library_encoder

STRIDE = 64  # every so many ends is found first, the ends between them gallop from there
CACHE = 160_000  # distinct pieces a worker remembers
CACHE_CHARS = 8 << 20
LARGE = 1 << 20  # pairs with at least this part of all links are sent to the tasks
SLICE = 1 << 20  # bytes of text handled at once


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of a sorted list the first place of another sorted list with no smaller value, all in step."""
    n, m = len(short), len(long)
    if n <= STRIDE:
        low = np.zeros(n, np.int64)
    else:
        low = np.repeat(gallop(short[::STRIDE], long), STRIDE)[:n]
    if not n or not m:
        return low
    high, step = low.copy(), 1
    moving = np.arange(n)
    while len(moving):
        at = high[moving]
        moving = moving[(at < m) & (long[np.minimum(at, m - 1)] < short[moving])]
        low[moving] = high[moving] + 1
        high[moving] += step
        step *= 2
    high = np.minimum(high, m)
    open_ones = np.flatnonzero(low < high)
    while len(open_ones):
        middle = (low[open_ones] + high[open_ones]) >> 1
        below = long[middle] < short[open_ones]
        low[open_ones] = np.where(below, middle + 1, low[open_ones])
        high[open_ones] = np.where(below, high[open_ones], middle)
        open_ones = open_ones[low[open_ones] < high[open_ones]]
    return low


def common_places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, in two strictly rising lists, of the values they share."""
    if len(b) < len(a):
        at_b, at_a = common_places(b, a)
        return at_a, at_b
    place = gallop(a, b)
    at = np.flatnonzero(place < len(b))
    at = at[b[place[at]] == a[at]]
    return at, place[at]


class Ragged:
    """Rows of different lengths, one after another, that rows can be added to."""

    def __init__(self, kind: type):
        self.flat, self.ends = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int64)
        self.used = self.size = 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        total, n = len(values), len(counts)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(self.used, total), self.flat.dtype)])
        if self.size + n > len(self.ends):
            self.ends = np.concatenate([self.ends[: self.size], np.zeros(max(self.size, n), np.int64)])
        self.flat[self.used : self.used + total] = values
        self.ends[self.size : self.size + n] = self.used + np.cumsum(counts)
        self.used += total
        self.size += n

    def rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the rows and how many each has."""
        stop = self.ends[rows]
        counts = stop - np.where(rows > 0, self.ends[rows - 1], 0)
        ends = np.cumsum(counts)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(stop - ends, counts)
        return self.flat[at], counts

    def kept(self, rows: np.ndarray) -> Ragged:
        new = Ragged(self.flat.dtype.type)
        new.add(*self.rows(rows))
        return new


class Vocabulary:
    """An encoder with the bytes of each of its ids."""

    def __init__(self, encode: Encode, tokens: list[bytes]):
        self.encode, self.size = encode, len(tokens)
        self.tokens = Ragged(np.uint8)
        self.tokens.add(np.frombuffer(b"".join(tokens), np.uint8), np.fromiter(map(len, tokens), np.int64, len(tokens)))
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        numbers = list(map(str, range(len(tokens))))
        self.within = np.array([x + "," for x in numbers], object)
        self.last = np.array(numbers, object)

    def matches(self, ids: np.ndarray, counts: np.ndarray, body: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which rows of ids give exactly the bytes of the same row of the body."""
        owner = np.repeat(np.arange(len(counts)), counts)
        same = np.bincount(owner, weights=self.lengths[ids], minlength=len(counts)).astype(np.int64) == sizes
        made, _ = self.tokens.rows(ids[same[owner]].astype(np.int64))
        byte_owner = np.repeat(np.arange(len(sizes)), sizes)
        inside = same[byte_owner]
        same[byte_owner[inside][made != body[inside]]] = False
        return same


def byte_level_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE file of the tokenizers library."""
    from tokenizers import Tokenizer

    # the library shows bytes as characters: 33-126, 161-172 and 174-255 as themselves, the others by 256 and up
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}
    entries = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    tokens = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        tokens[i] = bytes(byte_of[c] for c in entry) if set(entry) <= byte_of.keys() else entry.encode()
    return Vocabulary(library_encoder(path), tokens)


def piece_vocabulary(path: str) -> Vocabulary:
    """A model of the sentencepiece library, which puts a space before a text by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(texts) -> tuple[np.ndarray, np.ndarray]:
        ids = model.encode(list(texts), num_threads=1)
        return np.array([i for x in ids for i in x], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def token(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return Vocabulary(encode, [token(i) for i in range(model.vocab_size())])


class PieceAlignments:
    """Aligned pieces: a growing table of distinct ones, looked up for whole slices of text at a time."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.a, self.b = a, b
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.links, self.ids_a, self.ids_b = Ragged(np.int64), Ragged(np.int32), Ragged(np.int32)
        self.sizes_a, self.sizes_b = Ragged(np.int32), Ragged(np.int32)
        self.valid, self.loose, self.uses = np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.int32)
        self.chars = 0

    def make_room(self) -> None:
        """Between slices: of a full table the pieces stay that more than one slice used since the last time."""
        if len(self.known) <= CACHE and self.chars <= CACHE_CHARS:
            return
        kept = np.flatnonzero(self.uses > 1)
        pieces = np.array(list(self.known), object)[kept].tolist()
        if len(kept) > CACHE // 2 or sum(map(len, pieces)) > CACHE_CHARS // 2:
            kept, pieces = kept[:0], []
        self.known = dict(zip(pieces, range(len(pieces)), strict=True))
        self.texts = [self.texts[i] for i in kept.tolist()]
        for name in ("links", "ids_a", "ids_b", "sizes_a", "sizes_b"):
            setattr(self, name, getattr(self, name).kept(kept))
        self.valid, self.loose, self.uses = self.valid[kept], self.loose[kept], np.zeros(len(kept), np.int32)
        self.chars = sum(map(len, pieces))

    def rows(self, pieces: list[str]) -> np.ndarray:
        """Row of each of some distinct pieces."""
        new = [p for p in pieces if p not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.add(new)
        rows = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        self.uses[rows] += 1
        return rows

    def add(self, new: list[str]) -> None:
        n = len(new)
        whole = [(" " + p).encode() for p in new]
        sizes = np.fromiter(map(len, whole), np.int64, n)
        body = np.frombuffer(b"".join(whole), np.uint8)
        ids_a, n_a = self.a.encode(" " + p for p in new)
        ids_b, n_b = self.b.encode(new)
        valid = self.a.matches(ids_a, n_a, body, sizes) & self.b.matches(ids_b, n_b, body, sizes)
        ids_a, ids_b = ids_a[np.repeat(valid, n_a)].astype(np.int64), ids_b[np.repeat(valid, n_b)].astype(np.int64)
        n_a, n_b = np.where(valid, n_a, 0), np.where(valid, n_b, 0)
        # ends over all pieces, one after another: each piece ends where a token of each ends
        end_a, end_b = np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b])
        at_a, at_b = common_places(end_a, end_b)
        owner = np.searchsorted(np.cumsum(np.where(valid, sizes, 0)), end_a[at_a], side="left")
        groups = np.bincount(owner, minlength=n)
        size_a, size_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        self.links.add(ids_a[at_a] * self.b.size + ids_b[at_b], groups)
        self.ids_a.add(ids_a, n_a)
        self.ids_b.add(ids_b, n_b)
        self.sizes_a.add(size_a, groups)
        self.sizes_b.add(size_b, groups)
        self.texts += self.written_groups(ids_a, ids_b, at_a, at_b, size_a, size_b, n_a + n_b)
        self.valid = np.append(self.valid, valid)
        self.loose = np.append(self.loose, [not p or p[0].isspace() or p[-1].isspace() for p in new])
        self.uses = np.append(self.uses, np.zeros(n, np.int32))
        self.chars += sum(map(len, new))

    def written_groups(self, ids_a, ids_b, at_a, at_b, size_a, size_b, counts) -> list[str]:
        """``a1,a2|b1;`` of each group, joined for each piece."""
        tokens = np.empty(len(ids_a) + len(ids_b), object)
        strings = self.a.within[ids_a]
        strings[at_a] = self.a.last[ids_a[at_a]] + "|"
        tokens[np.arange(len(ids_a)) + np.repeat(at_b + 1 - size_b, size_a)] = strings  # after the groups before
        strings = self.b.within[ids_b]
        strings[at_b] = self.b.last[ids_b[at_b]] + ";"
        tokens[np.arange(len(ids_b)) + np.repeat(at_a + 1, size_b)] = strings  # and after its own group's first half
        ends = np.cumsum(counts).tolist()
        listed = tokens.tolist()
        return ["".join(listed[s:e]) for s, e in zip([0, *ends], ends, strict=False)]


def piece_rows(text: pa.Array, table: PieceAlignments) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the pieces in text order, and how many each text has; an empty text has none."""
    table.make_room()
    split = pc.split_pattern(text, " ")
    n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    n[pc.equal(text, "").to_numpy(zero_copy_only=False)] = 0
    kept = pc.list_flatten(split) if n.all() else pc.list_flatten(split.filter(pa.array(n > 0)))
    coded = kept.dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    rows = table.rows(words)[codes] if len(codes) else np.zeros(0, np.int64)
    first = np.zeros(len(codes) + 1, bool)
    first[np.cumsum(n) - n] = True
    loose = table.loose[rows]
    glue = np.zeros(len(codes), bool)
    glue[1:] = loose[1:] | loose[:-1]
    glue &= ~first[:-1]
    if glue.any():
        stay = np.flatnonzero(~glue)
        sizes = np.diff(np.append(stay, len(codes)))
        wholes = [" ".join([words[c] for c in codes[a : a + k]]) for a, k in zip(stay[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True)]
        place = {w: i for i, w in enumerate(dict.fromkeys(wholes))}
        rows[stay[sizes > 1]] = table.rows(list(place))[[place[w] for w in wholes]]
        owner = np.repeat(np.arange(len(n)), n)
        n = np.bincount(owner[stay], minlength=len(n))
        rows = rows[stay]
    return rows, n


_tables: dict[tuple[str, str], PieceAlignments] = {}


def worker_table(path_a: str, path_b: str) -> PieceAlignments:
    """One table per Python worker, kept between its tasks."""
    if (path_a, path_b) not in _tables:
        _tables[path_a, path_b] = PieceAlignments(byte_level_vocabulary(path_a), piece_vocabulary(path_b))
    return _tables[path_a, path_b]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def aligned_slice(text: pa.Array, table: PieceAlignments, spans: bool = False) -> dict[str, pa.Array]:
    """The columns of the result that one text alone decides, and its distinct links with how often each occurs."""
    rows, n = piece_rows(text, table)
    owner = np.repeat(np.arange(len(n)), n)
    bad = np.zeros(len(n), bool)
    bad[owner[~table.valid[rows]]] = True
    rows, owner = rows[~bad[owner]], owner[~bad[owner]]
    ends = np.cumsum(np.bincount(owner, minlength=len(n))).tolist()
    texts = table.texts
    order = rows.tolist()
    digests = [
        hashlib.sha256("".join([texts[i] for i in order[s:e]])[:-1].encode()).hexdigest() if e > s else ""
        for s, e in zip([0, *ends], ends, strict=False)
    ]

    def per_text(store: Ragged) -> tuple[np.ndarray, np.ndarray]:
        values, counts = store.rows(rows)
        return values, np.bincount(owner, weights=counts, minlength=len(n)).astype(np.int64)

    links, n_links = per_text(table.links)
    width = table.a.size * table.b.size
    keys, times = np.unique(np.repeat(np.arange(len(n)), n_links) * width + links, return_counts=True)
    out = {
        "n_a": pa.array(per_text(table.ids_a)[1]),
        "n_b": pa.array(per_text(table.ids_b)[1]),
        "n_groups": pa.array(n_links),
        "groups_sha256": pa.array(digests),
    }
    distinct = np.bincount(keys // width, minlength=len(n))
    out["pairs"], out["times"] = _lists(keys % width, distinct, pa.int64()), _lists(times, distinct, pa.int32())
    if spans:  # the ids of both sides and how many of each a group has
        for name in ("ids_a", "ids_b", "sizes_a", "sizes_b"):
            out[name] = _lists(*per_text(getattr(table, name)), pa.int32())
    return out


SPANS = "ids_a array<int>, ids_b array<int>, sizes_a array<int>, sizes_b array<int>"


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, carry: tuple[str, ...] = ("doc_id",), spans: bool = False) -> DataFrame:
    """``row``, the carried columns as ``carried``, the results of each text by itself, its ``pairs`` and their ``times``.

    With ``spans`` the ids of both sides, and per group how many of each side it has, so that group k of a text is the next
    ``sizes_a[k]`` ids of A over the next ``sizes_b[k]`` ids of B.
    """
    rows = docs.select(F.struct(*carry).alias("carried"), "text")
    kind = rows.schema["carried"].dataType.simpleString()
    schema = f"carried {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(path_a, path_b)
        for batch in text_slices(batches, size=SLICE):
            columns = {"carried": batch.column("carried")} | aligned_slice(batch.column("text"), table, spans)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    found = rows.mapInArrow(align, schema + (f", {SPANS}" if spans else ""))
    return found.withColumn("row", F.monotonically_increasing_id())


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """``pair, n, best``: links of each pair of ids in the corpus, and whether it is its B id's most frequent one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            values = batch.column("pairs").flatten().to_numpy(zero_copy_only=False)
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False)
            pairs, inverse = np.unique(np.concatenate([pairs, values]), return_inverse=True)
            sums = np.bincount(inverse, weights=np.concatenate([sums, times]), minlength=len(pairs)).astype(np.int64)
        for at in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + (1 << 16)]), pa.array(sums[at : at + (1 << 16)])], names=["pair", "n"])
        give_back()

    counts = aligned.select("pairs", "times").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts, shared_folder(aligned.sparkSession, "pair-counts"))
    b = F.col("pair") % size_b
    highest = counts.groupBy(b.alias("b")).agg(F.max("n").alias("highest"))
    return counts.withColumn("b", b).join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _known_pairs(pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> Callable:
    """Sums over the pairs given; the others stay as a list."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            values = lists.flatten().to_numpy(zero_copy_only=False)
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.minimum(np.searchsorted(pairs, values), max(len(pairs) - 1, 0))
            known = pairs[place] == values if len(pairs) else np.zeros(len(values), bool)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], owner[known], times[known] * counts[place[known]])
            np.add.at(sums[1], owner[known], times[known] * best[place[known]])
            left = np.bincount(owner[~known], minlength=batch.num_rows)
            columns = {k: batch.column(k) for k in batch.schema.names if k not in ("pairs", "times")}
            columns |= {"near_sum": pa.array(sums[0]), "near_best": pa.array(sums[1])}
            columns |= {"pairs": _lists(values[~known], left, pa.int64()), "times": _lists(times[~known], left, pa.int32())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return look_up


def align_documents(
    docs: DataFrame, path_a: str, path_b: str, carry: tuple[str, ...] = ("doc_id",), spans: bool = False, large: int = LARGE
) -> DataFrame:
    """The carried columns with ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` (and the spans)."""
    spark = docs.sparkSession
    aligned = written(aligned_texts(docs, path_a, path_b, carry, spans), shared_folder(spark, "aligned"))
    counts = written(pair_counts(aligned, piece_vocabulary(path_b).size), shared_folder(spark, "pairs"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = -(-total // large)  # at most `large` pairs are linked as often
    near = counts.filter(F.col("n") >= share).orderBy("pair").toArrow()
    look_up = _known_pairs(*(near.column(c).to_numpy().astype(np.int64) for c in ("pair", "n", "best")))
    kept = [f for f in aligned.schema.fields if f.name not in ("pairs", "times")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    looked = aligned.mapInArrow(look_up, f"{schema}, near_sum long, near_best long, pairs array<long>, times array<int>")
    looked = written(looked, shared_folder(spark, "looked-up"))
    rest = looked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", "link.pairs", "link.times")
    far = counts.filter(F.col("n") < share)
    rest = rest.join(far, F.col("pairs") == F.col("pair")).groupBy("row")
    rest = rest.agg(
        F.sum(F.col("times") * F.col("n")).alias("far_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("far_best")
    )
    new = {
        "n_a": F.col("n_a"),
        "n_b": F.col("n_b"),
        "n_groups": F.col("n_groups"),
        "n_links": F.col("n_groups"),  # a token of each side ends a group, and no other two end together
        "n_best": F.col("near_best") + F.coalesce("far_best", F.lit(0)),
        "count_sum": F.col("near_sum") + F.coalesce("far_sum", F.lit(0)),
        "groups_sha256": F.col("groups_sha256"),
    } | ({c.split()[0]: F.col(c.split()[0]) for c in SPANS.split(", ")} if spans else {})
    carried = [F.col(f"carried.`{c}`").alias(c) for c in carry if c.lower() not in new]
    return looked.drop("pairs", "times").join(rest, "row", "left").select(*carried, *[v.alias(k) for k, v in new.items()])
