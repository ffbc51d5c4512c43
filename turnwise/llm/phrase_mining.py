"""Phrases whose words occur together more often than apart, counted by a prefix-free parse of the texts.

A text's words are a sequence; a trigger is a place where the hash of the next words is 0 modulo ``spacing``. Chunks run
from one trigger to the words of the next one, so that neighbours overlap by one word less than the longest phrase, and
the last chunk of a text ends with a mark. Chunks depend on content alone: what texts share is parsed alike, and counts
once in the dictionary of distinct chunks, with its frequency. Phrases are counted inside distinct chunks, each weighted
by the chunk's frequency; a phrase belongs to the chunk in which it begins before the overlap, that is to exactly one.

Longer phrases are counted only where both shorter parts occur often enough. Which parts do is a bit map of fixed size:
it lets through all that do and, when it gets full, some that do not, which cost rows and change no result.

Edge cases. Null and empty texts, and texts without words, have no phrases. A null group is the group ``other``. Equal
rows count as often as they occur; ids and further columns are not read. An empty table gives an empty result. A text
longer than a slice is handled by itself. Counts are 64-bit, scores are made of decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.arrow_text import mixed, shared_folder, text_slices, word_hashes, written

SEPARATORS = ".,;:!?\n\x0b\x0c\r"  # between pieces
BLANKS = " \t"  # between the words of a piece
SLICE = 4 << 20  # bytes of text handled at once
LARGE = 4096  # a part with more than this share of all words is looked up in a broadcast
SHORT = 256  # bytes of such a part at most


@dataclass(frozen=True)
class PhraseOptions:
    """``spacing``: words between triggers on average; ``filter_bits``: power of two of the bit map's size."""

    max_words: int = 3
    least: int = 10
    contained_percent: int = 50
    keep: int = 2000
    other: str = "und"
    spacing: int = 32
    filter_bits: int = 27
    slices: int = 64

    def __post_init__(self):
        if self.max_words < 2 or self.least < 1 or self.spacing < 1 or not 10 <= self.filter_bits <= 32:
            raise ValueError("phrases have two words at least and occur once at least; the bit map has 10 to 32 bits")


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[list(BLANKS.encode())] = 1
    kinds[list(SEPARATORS.encode())] = 2
    return kinds


KINDS = _byte_kinds()


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all the ranges, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def _strings(body: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The ranges of the bytes as strings."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    data = body[_ranges(starts, lengths)]
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))


@dataclass
class Words:
    """Words of some texts, one after another, as ranges of the bytes, with their text and where pieces begin."""

    body: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    owner: np.ndarray
    begins: np.ndarray  # the word is the first of a piece

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """A code per word and the distinct words."""
        coded = _strings(self.body, self.starts, self.lengths).dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def words_of(text: pa.Array) -> Words:
    """The words of lower-cased texts (A to Z) without nulls."""
    text = text.cast(pa.large_string())
    marks = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    body = np.frombuffer(data, np.uint8)[marks[0] : marks[-1]] if data is not None else np.zeros(0, np.uint8)
    marks = marks - marks[0]
    body = np.where((body >= 65) & (body <= 90), body + 32, body).astype(np.uint8)
    kind = KINDS[body]
    word = kind == 0
    first = np.ones(len(body) + 1, bool)
    first[1:] = np.append(~word[:-1], True) if len(body) else True
    first[marks] = True  # a text's first byte follows nothing
    starts = np.flatnonzero(word & first[:-1])
    last = np.append(first[1:-1] | ~word[1:], True) if len(body) else np.zeros(0, bool)
    ends = np.flatnonzero(word & last) + 1
    owner = np.searchsorted(marks, starts, side="right") - 1
    cuts = np.zeros(len(body) + 1, np.int64)
    np.cumsum(kind == 2, out=cuts[1:])
    begins = np.ones(len(starts), bool)
    begins[1:] = (cuts[starts[1:]] != cuts[ends[:-1]]) | (owner[1:] != owner[:-1])
    return Words(body, starts, ends - starts, owner, begins)


def chunks_of(text: pa.Array, overlap: int, spacing: int) -> tuple[pa.Array, np.ndarray]:
    """The chunks of each text and their owners. Words are joined by a space, across the border of pieces by a newline.

    The last chunk of a text ends with a newline; every other ends with the ``overlap`` words that begin the next one.
    """
    words = words_of(text)
    n = len(words.starts)
    if not n:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    codes, distinct = words.coded()
    hashes = word_hashes(distinct)[codes]
    left = np.bincount(words.owner, minlength=len(text))  # words from a place to the end of its text
    left = np.cumsum(left)[words.owner] - np.arange(n)
    rolled = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(overlap):
            ahead = np.zeros(n, np.uint64)
            ahead[: n - k] = hashes[k:]
            rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + ahead + np.uint64(k + 1))
    opens = np.ones(n, bool)
    opens[1:] = words.owner[1:] != words.owner[:-1]
    opens |= (rolled % np.uint64(spacing) == 0) & (left >= overlap)
    first = np.flatnonzero(opens)
    closes = np.append(words.owner[first[1:]] != words.owner[first[:-1]], True)
    last = np.append(first[1:], n) + np.where(closes, 0, overlap)  # behind the last word
    # the words with one byte behind each: what joins it to the next
    ends = np.cumsum(words.lengths + 1)
    begin = ends - words.lengths - 1
    body = np.full(int(ends[-1]), ord(" "), np.uint8)
    body[_ranges(begin, words.lengths)] = words.body[_ranges(words.starts, words.lengths)]
    body[ends[:-1][words.begins[1:]] - 1] = ord("\n")
    body[-1] = ord("\n")
    stop = ends[last - 1] - np.where(closes, 0, 1)
    return _strings(body, begin[first], stop - begin[first]), words.owner[first]


def _grouped(keys: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key and the sum of its weights."""
    key = keys[0]
    for k in keys[1:]:
        key = np.unique(key, return_inverse=True)[1].astype(np.int64) * (int(k.max(initial=0)) + 1) + k
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(head)
    return order[at], np.add.reduceat(weights[order], at) if len(at) else np.zeros(0, np.int64)


COUNTS = "lang string, words int, phrase string, n long"


def _phrase_hashes(hashes: np.ndarray, at: np.ndarray, size: int, group: np.ndarray) -> np.ndarray:
    """A hash of the phrase of ``size`` words at each place, and of its group."""
    rolled = group[at]
    with np.errstate(over="ignore"):
        for k in range(size):
            rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k] + np.uint64(k + 1))
    return rolled


def _counter(sizes: tuple[int, ...], overlap: int, bits: np.ndarray | None, filter_bits: int):
    """Weighted phrase counts of slices of the dictionary; with a bit map, only of phrases whose parts are in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "chunk", SLICE):
            words = words_of(batch.column("chunk"))
            n = len(words.starts)
            if not n:
                continue
            codes, distinct = words.coded()
            coded = batch.column("lang").dictionary_encode()
            lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.owner]
            weight = batch.column("times").to_numpy(zero_copy_only=False)[words.owner]
            per_chunk = np.bincount(words.owner, minlength=batch.num_rows)
            closed = pc.ends_with(batch.column("chunk"), "\n").to_numpy(zero_copy_only=False)
            left = np.cumsum(per_chunk)[words.owner] - np.arange(n)
            own = closed[words.owner] | (left > overlap)  # the others begin the next chunk
            piece = np.cumsum(words.begins)
            hashes = word_hashes(distinct)[codes] if bits is not None else None
            groups = word_hashes(coded.dictionary.cast(pa.large_string()), 1)[lang] if bits is not None else None
            for size in sizes:
                at = np.flatnonzero(own[: n - size + 1] & (piece[: n - size + 1] == piece[size - 1 :])) if n >= size else []
                if not len(at):
                    continue
                if bits is not None:
                    for shift in (0, 1):
                        h = _phrase_hashes(hashes, at + shift, size - 1, groups[shift:] if shift else groups)
                        h &= np.uint64((1 << filter_bits) - 1)
                        at = at[(bits[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                    if not len(at):
                        continue
                place, total = _grouped([lang[at], *[codes[at + k] for k in range(size)]], weight[at])
                at = at[place]
                end = words.starts[at + size - 1] + words.lengths[at + size - 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        coded.dictionary.take(pa.array(lang[at])).cast(pa.string()),
                        pa.array(np.full(len(at), size, np.int32)),
                        _strings(words.body, words.starts[at], end - words.starts[at]).cast(pa.string()),
                        pa.array(total),
                    ],
                    names=["lang", "words", "phrase", "n"],
                )
            if 1 in sizes:
                own_at = np.flatnonzero(own)
                place, total = _grouped([lang[own_at]], weight[own_at])
                yield pa.RecordBatch.from_arrays(
                    [
                        coded.dictionary.take(pa.array(lang[own_at][place])).cast(pa.string()),
                        pa.array(np.zeros(len(place), np.int32)),
                        pa.array([""] * len(place), pa.string()),
                        pa.array(total),
                    ],
                    names=["lang", "words", "phrase", "n"],
                )

    return count


def parsed(docs: DataFrame, options: PhraseOptions) -> DataFrame:
    """``lang, chunk, times``: the dictionary of distinct chunks of each group with their frequency in the parse."""
    overlap, spacing = options.max_words - 1, options.spacing

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, size=SLICE):
            chunks, owner = chunks_of(batch.column("text"), overlap, spacing)
            if not len(chunks):
                continue
            coded = chunks.dictionary_encode()
            names = batch.column("lang").dictionary_encode()
            lang = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner]
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            place, total = _grouped([lang, codes], np.ones(len(codes), np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    names.dictionary.take(pa.array(lang[place])).cast(pa.string()),
                    coded.dictionary.take(pa.array(codes[place])).cast(pa.string()),
                    pa.array(total),
                ],
                names=["lang", "chunk", "times"],
            )

    group = F.coalesce(F.col("lang").cast("string"), F.lit(options.other))
    rows = docs.select(group.alias("lang"), "text").mapInArrow(parse, "lang string, chunk string, times long")
    return rows.groupBy("lang", "chunk").agg(F.sum("times").alias("times"))


def _frequent(dictionary: DataFrame, sizes: tuple[int, ...], bits: np.ndarray | None, options: PhraseOptions) -> DataFrame:
    """``lang, words, phrase, n`` of the phrases that occur often enough, and the sum of all words as ``words`` 0."""
    count = _counter(sizes, options.max_words - 1, bits, options.filter_bits)
    counts = dictionary.mapInArrow(count, COUNTS).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return written(
        counts.filter((F.col("n") >= options.least) | (F.col("words") == 0)),
        shared_folder(dictionary.sparkSession, "phrases"),
    )


def _bit_map(frequent: DataFrame, size: int, filter_bits: int) -> np.ndarray:
    """Bits of the hashes of all frequent phrases of a size; only its 64-bit words that are not 0 come to the driver."""
    low = filter_bits - 6

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = words_of(batch.column("phrase"))
            codes, distinct = words.coded()
            coded = batch.column("lang").dictionary_encode()
            lang = word_hashes(coded.dictionary.cast(pa.large_string()), 1)[coded.indices.to_numpy(zero_copy_only=False)]
            at = np.arange(batch.num_rows) * size
            h = _phrase_hashes(word_hashes(distinct)[codes], at, size, lang[words.owner])
            h &= np.uint64((1 << filter_bits) - 1)
            bit = np.uint64(1) << (h & np.uint64(63))
            yield pa.RecordBatch.from_arrays(
                [pa.array((h >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))], names=["place", "bit"]
            )

    rows = frequent.filter(F.col("words") == size).select("lang", "phrase").mapInArrow(hashed, "place long, bit long")
    found = rows.groupBy("place").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits = np.zeros(1 << low, np.uint64)
    bits[found.column("place").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return bits.view(np.uint8)


def phrase_counts(docs: DataFrame, options: PhraseOptions) -> DataFrame:
    """``lang, words, phrase, n``: frequent phrases of one word and more, and each group's words as ``words`` 0."""
    dictionary = written(parsed(docs, options), shared_folder(docs.sparkSession, "phrase-chunks"))
    found = _frequent(dictionary, (1, 2), None, options)
    for size in range(3, options.max_words + 1):
        bits = _bit_map(found, size - 1, options.filter_bits)
        found = found.unionByName(_frequent(dictionary, (size,), bits, options))
    return found


def _part_counts(cuts: DataFrame, counts: DataFrame, large: DataFrame, column: str, out: str) -> DataFrame:
    """The count of one part of each cut. Parts that many phrases share come by broadcast, the others by a join."""
    rows = cuts.join(
        F.broadcast(large.select("lang", F.col("phrase").alias(column), F.col("n").alias("near"))), ["lang", column], "left"
    )
    # found already: a key of the row's own that is no phrase, so that these rows do not meet in one task
    key = F.when(F.col("near").isNull(), F.col(column)).otherwise(F.concat(F.lit("\n"), "phrase"))
    rest = counts.select("lang", F.col("phrase").alias("key"), F.col("n").alias("far"))
    rows = rows.withColumn("key", key).join(rest, ["lang", "key"], "left")
    return rows.withColumn(out, F.coalesce("near", "far")).drop("near", "far", "key")


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def scored(counts: DataFrame, options: PhraseOptions) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of all candidates, by their worst cut."""
    total = counts.filter(F.col("words") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = counts.filter((F.col("words") > 0) & (F.col("words") < options.max_words))
    share = -(-total // LARGE)  # at most LARGE phrases of each size occur as often
    large = parts.filter((F.col("n") >= share) & (F.octet_length("phrase") <= SHORT))
    split = F.split("phrase", " ")
    cuts = counts.filter(F.col("words") > 1).select("lang", "phrase", "words", F.col("n").alias("a"), split.alias("word"))
    cuts = cuts.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.array_join(F.slice("word", 1, F.col("cut")), " "))
    cuts = cuts.withColumn("right", F.array_join(F.slice("word", F.col("cut") + 1, F.col("words") - F.col("cut")), " ")).drop("word")
    cuts = _part_counts(cuts, parts, large, "left", "l")
    cuts = _part_counts(cuts, parts, large, "right", "r")
    product = _exact("a") * _exact("a")  # 38 digits; 10^6 a^2 stays within them up to a = 10^16
    score = F.call_function("div", (product * F.lit(1_000_000)).cast("decimal(38,0)"), _exact("l") * _exact("r"))
    worst = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("worst")
    cuts = cuts.groupBy("lang", "phrase", "words", "a").agg(worst)
    return cuts.select("lang", "phrase", "words", "a", "worst.l", "worst.r", "worst.score")


def not_contained(candidates: DataFrame, options: PhraseOptions) -> DataFrame:
    """Without the candidates whose words lie in a longer candidate that is nearly as frequent."""
    spans = F.transform(  # every shorter run of at least two words
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda size: F.transform(
            F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.array_join(F.slice(F.split("phrase", " "), at, size), " ")
        ),
    )
    longer = candidates.filter(F.col("words") > 2).select("lang", F.col("a").alias("around"), F.explode(F.flatten(spans)).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    rows = candidates.join(longer, ["lang", "phrase"], "left")
    inside = F.col("around") * 100 >= F.col("a") * options.contained_percent
    return rows.filter(~F.coalesce(inside, F.lit(False))).drop("around")


def mine_phrases(docs: DataFrame, options: PhraseOptions = PhraseOptions()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each group's first phrases by score, count and code point."""
    spark = docs.sparkSession
    counts = phrase_counts(docs, options)
    candidates = written(scored(counts, options), shared_folder(spark, "phrase-candidates"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slices = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(options.slices))).orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    rows = not_contained(candidates, options)
    rows = rows.withColumn("rank", F.row_number().over(slices)).filter(F.col("rank") <= options.keep)
    rows = rows.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= options.keep)
    totals = counts.filter(F.col("words") == 0).select("lang", "n")
    rows = rows.join(totals, "lang")
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
