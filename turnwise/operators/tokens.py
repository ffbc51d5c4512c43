"""Text to token ids.

Counting never leaves the JVM for the regex and byte encoders. Ids are looked up in Arrow batches: the JVM cuts the
tokens, the worker maps a whole batch with one vectorised dictionary lookup.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from turnwise.operators.hot import PARTS, hot_join
from turnwise.operators.ordering import dense_positions
from turnwise.sources.kept import kept_table

# Letter/digit runs, whole chat markers, or single other characters; blanks separate. The common case is tried first.
TOKEN_PATTERN = (
    r"[\p{L}\p{M}\p{N}_]+"
    r"|<\|im_start\|>|<\|im_end\|>"
    r"|[^\p{L}\p{M}\p{N}_ \t\n\r\f\x0B]"
)
MAX_SHIPPED_TOKENS = 1 << 20
MAX_SHIPPED_BYTES = 64 << 20
BLOCK_TOKENS = 1 << 20  # tokens whose distinct ones are looked up together
BLOCK_GROUP_BYTES = 16 << 20  # of a row group of blocks


@dataclass(frozen=True)
class SpecialIds:
    """Marker ids of a tokenizer. A missing pad id falls back to the end id."""

    bos: int | None = None
    eos: int | None = None
    pad: int | None = None

    @property
    def pad_id(self) -> int:
        got = self.eos if self.pad is None else self.pad
        if got is None:
            raise ValueError("padding needs a pad id or an end id")
        return got


class Encoder:
    """``count`` and ``ids`` of a text column, without marker ids."""

    def ids(self, text: Column) -> Column:
        raise NotImplementedError

    def count(self, text: Column) -> Column:
        return F.size(self.ids(text))

    def identity(self) -> str:
        """A short text that differs between encoders that give different ids."""
        return type(self).__name__


def _digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


@dataclass(frozen=True)
class RegexEncoder(Encoder):
    """Pattern tokens numbered by their place in ``vocabulary``; unknown tokens get ``unknown_id``."""

    vocabulary: Sequence[str] = field(repr=False)
    unknown_id: int = -1
    pattern: str = TOKEN_PATTERN

    def __post_init__(self):
        size = sum(len(t.encode()) for t in self.vocabulary)
        if len(self.vocabulary) > MAX_SHIPPED_TOKENS or size > MAX_SHIPPED_BYTES:
            raise ValueError("vocabulary too large to ship to every worker; use encode_by_join")

    def identity(self) -> str:
        return f"regex {self.pattern} {self.unknown_id} {_digest(self.vocabulary)}"

    def tokens(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def ids(self, text: Column) -> Column:
        return _lookup(pa.array(self.vocabulary, pa.string()), self.unknown_id)(self.tokens(text))

    def count(self, text: Column) -> Column:
        return F.regexp_count(text, F.lit(self.pattern))


class ByteEncoder(Encoder):
    """One id per UTF-8 byte."""

    def ids(self, text: Column) -> Column:
        return _byte_values()(text)

    def count(self, text: Column) -> Column:
        return F.octet_length(text)


@dataclass(frozen=True)
class TokenizerFileEncoder(Encoder):
    """A ``tokenizer.json`` document, parsed once per task."""

    document: str = field(repr=False)

    @classmethod
    def from_file(cls, path: str) -> TokenizerFileEncoder:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def identity(self) -> str:
        return f"tokenizer file {_digest([self.document])}"

    def ids(self, text: Column) -> Column:
        return _tokenizer_ids(self.document)(text)


# The functions below are closures with their own imports, so workers need no copy of this package.


def _lookup(vocabulary: pa.Array, unknown_id: int):
    """The vocabulary stays one Arrow array, in the driver and in the workers: no object per token."""

    @arrow_udf("array<int>")
    def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for tokens in batches:
            sizes = pc.fill_null(pc.list_value_length(tokens), 0)
            ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int32)
            coded = tokens.flatten().cast(pa.string()).dictionary_encode()
            found = pc.index_in(coded.dictionary, value_set=vocabulary)  # the first place of a repeated token
            distinct = pc.fill_null(found, unknown_id).to_numpy(zero_copy_only=False).astype(np.int32)
            ids = distinct[coded.indices.to_numpy(zero_copy_only=False)]
            starts = pa.array(np.concatenate([np.zeros(1, np.int32), ends]), pa.int32())
            yield pa.ListArray.from_arrays(starts, pa.array(ids, pa.int32()), mask=tokens.is_null())

    return lookup


def _byte_values():
    @arrow_udf("array<int>")
    def byte_values(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            text = batch.cast(pa.binary())
            _, ends, data = text.buffers()
            marks = np.frombuffer(ends, np.int32)[text.offset : text.offset + len(text) + 1]
            body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            values = pa.array(body[marks[0] : marks[-1]].astype(np.int32))
            starts = pa.array(marks - marks[0], pa.int32())
            yield pa.ListArray.from_arrays(starts, values, mask=text.is_null())

    return byte_values


def _tokenizer_ids(document: str):
    @arrow_udf("array<int>")
    def tokenizer_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import itertools
        import os

        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer

        # a task has one core; the library would otherwise start a thread per core of the machine in each task
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_str(document)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for text in batches:
            missing = text.is_null()
            encoded = tokenizer.encode_batch_fast(text.fill_null("").to_pylist(), add_special_tokens=False)
            ids = [e.ids for e in encoded]
            starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            values = np.fromiter(itertools.chain.from_iterable(ids), np.int32, count=int(starts[-1]))
            yield pa.ListArray.from_arrays(pa.array(starts), pa.array(values), mask=missing)

    return tokenizer_ids


def encode(
    text: Column,
    encoder: Encoder,
    max_length: int | None = None,
    add_special_tokens: bool = True,
    special: SpecialIds = SpecialIds(),
) -> Column:
    """Ids of a text, cut to ``max_length``. Marker ids, when asked for, are part of the length and survive the cut."""
    front = [special.bos] if add_special_tokens and special.bos is not None else []
    back = [special.eos] if add_special_tokens and special.eos is not None else []
    ids = encoder.ids(text)
    if max_length is not None:
        ids = F.slice(ids, 1, max(max_length - len(front) - len(back), 0))
    if not front and not back:
        return ids
    parts = [F.array(*[F.lit(i) for i in front])] if front else []
    parts.append(ids)
    if back:
        parts.append(F.array(*[F.lit(i) for i in back]))
    return F.concat(*parts)


def token_counts(df: DataFrame, text: str = "text", pattern: str = TOKEN_PATTERN) -> DataFrame:
    """``(token, n)``. Map tasks send one row per distinct token they saw, however frequent it is."""
    tokens = F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    return df.select(tokens.alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def build_vocabulary(
    df: DataFrame, size: int | None, text: str = "text", pattern: str = TOKEN_PATTERN, reserved: Sequence[str] = ()
) -> DataFrame:
    """``(token, n, id)`` of the ``size`` most frequent tokens, or of all; ids by falling count, then token.

    Reserved tokens are not counted as candidates: their ids come first and are the caller's. Before the top-k a
    histogram over powers of two of the count finds the smallest count that can still matter, so that about ``size``
    rows are sorted instead of every distinct token. The sorted tokens are a table in the shared folder: the texts are
    read once here, and not again where the vocabulary is used.
    """
    counts = token_counts(df, text, pattern)
    if reserved:
        counts = counts.filter(~F.col("token").isin(*reserved))
    if size is not None:
        counts = kept_table(counts, "token-counts")
        octave = F.floor(F.log2("n")).cast("int")
        falling = Window.orderBy(F.col("octave").desc())
        # at most 63 octaves, so this window is a constant-size task
        enough = (
            counts.groupBy(octave.alias("octave"))
            .agg(F.count(F.lit(1)).alias("distinct_tokens"))
            .withColumn("reached", F.sum("distinct_tokens").over(falling))
            .filter(F.col("reached") >= size)
            .agg(F.coalesce(F.max("octave"), F.lit(0)).alias("octave"))
        )
        counts = counts.filter(octave >= enough.scalar())
    ranked = dense_positions(counts, [F.desc("n"), F.asc("token")], "place", "vocabulary")
    if size is not None:
        ranked = ranked.filter(F.col("place") < size)
    return ranked.select("token", "n", (F.col("place") + len(reserved)).cast("int").alias("id"))


def vocabulary_size(vocabulary: DataFrame) -> tuple[int, int]:
    """Tokens and bytes of a vocabulary."""
    n, size = vocabulary.agg(F.count(F.lit(1)), F.sum(F.octet_length("token"))).first()
    return n, size or 0


def collect_vocabulary(vocabulary: DataFrame, reserved: Sequence[str] = ()) -> list[str]:
    """The token list in id order, for :class:`RegexEncoder`. Its size is checked before anything is fetched."""
    n, size = vocabulary_size(vocabulary)
    if n > MAX_SHIPPED_TOKENS or size > MAX_SHIPPED_BYTES:
        raise ValueError("vocabulary too large to ship to every worker; use encode_by_join")
    found = vocabulary.select("token", "id").toArrow().sort_by("id")
    return list(reserved) + found.column("token").to_pylist()


def _token_blocks(df: DataFrame, row_id: str, tokens: Column, size: int = BLOCK_TOKENS) -> DataFrame:
    """Rows in blocks of at most ``size`` tokens (a larger row is a block by itself).

    ``block, ids, sizes, n_words, codes, words``: the rows' ids and numbers of tokens (-1 of a NULL), their tokens as places
    in the list of the block's distinct ones. The places are packed (byte by byte, zstd). The blocks are a table in the
    shared folder, in row groups of bounded size: the texts are read once, and a reader holds one row group.
    """
    kind = df.schema[row_id].dataType.simpleString()

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        def packed(codes: np.ndarray) -> bytes:
            planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
            return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)

        for batch in batches:
            lists = batch.column("tokens")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = pc.fill_null(pc.list_value_length(lists), -1).cast(pa.int32())
            ends = np.cumsum(lengths)
            start = 0
            while start < len(ends):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
                coded = lists.slice(start, stop - start).flatten().cast(pa.string()).dictionary_encode()
                yield pa.RecordBatch.from_arrays(
                    [
                        one(batch.column("id").slice(start, stop - start)),
                        one(sizes.slice(start, stop - start)),
                        pa.array([len(coded.dictionary)], pa.int32()),
                        pa.array([packed(coded.indices.to_numpy(zero_copy_only=False))], pa.binary()),
                        one(coded.dictionary),
                    ],
                    names=["ids", "sizes", "n_words", "codes", "words"],
                )
                start = stop

    cut = df.select(F.col(row_id).alias("id"), tokens.alias("tokens"))
    schema = f"ids array<{kind}>, sizes array<int>, n_words int, codes binary, words array<string>"
    blocks = cut.mapInArrow(block, schema).withColumn("block", F.monotonically_increasing_id())
    return kept_table(blocks, "token-blocks", {"parquet.block.size": BLOCK_GROUP_BYTES, "parquet.page.size.row.check.min": 1})


def encode_by_join(
    df: DataFrame,
    vocabulary: DataFrame,
    row_id: str = "row_id",
    text: str | Column = "text",
    pattern: str = TOKEN_PATTERN,
    unknown_id: int = -1,
    head: int = 4096,
    max_length: int | None = None,
    block: int = BLOCK_TOKENS,
) -> DataFrame:
    """``(row_id, input_ids)`` for a vocabulary of any size; a NULL text has NULL ids.

    The texts are read once and become blocks of codes; only the distinct tokens of a block are looked up. The ``head``
    lowest ids - the most frequent tokens, with a length limit, so at most a few MB - are found in a broadcast, only the
    others are shuffled by token. Of those a token that many blocks hold (one that is in no vocabulary, say) is dealt over
    several tasks. Ids go back to their block by its number, and a block's rows are cut out of them by offsets.
    With ``max_length`` tokens beyond it are never looked up.
    """
    tokens = F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(pattern), F.lit(0))
    if max_length is not None:
        tokens = F.slice(tokens, 1, max(max_length, 0))
    blocks = _token_blocks(df, row_id, tokens, block)
    kind = df.schema[row_id].dataType.simpleString()
    is_head = (F.col("id") < head) & (F.octet_length("token") <= 256)
    wanted = blocks.select("block", F.posexplode("words").alias("place", "token"))
    near = wanted.join(F.broadcast(vocabulary.filter(is_head).select("token", "id")), "token", "left")
    found = near.filter(F.col("id").isNotNull()).select("block", "place", "id")
    missing = near.filter(F.col("id").isNull()).select("block", "place", "token")
    tail = vocabulary.filter(~is_head).select("token", "id")
    n_blocks, n_wanted = blocks.agg(F.count(F.lit(1)), F.sum("n_words")).first()
    # a block names a token once, so with few blocks none can be hot
    hot = None if n_blocks * PARTS > (n_wanted or 0) else missing.select("token").limit(0)
    ids = found.unionByName(hot_join(missing, tail, ["token"], hot=hot).select("block", "place", "id"))
    ids = ids.withColumnRenamed("block", "of")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out = [pa.table({row_id: pa.array([], left.schema.field("ids").type.value_type), "input_ids": pa.array([], pa.list_(pa.int32()))})]
        for row in left.to_batches():
            for k in range(row.num_rows):
                table = np.full(max(row.column("n_words")[k].as_py(), 1), unknown_id, np.int32)
                table[right.column("place").to_numpy()] = right.column("id").to_numpy()
                sizes = row.column("sizes")[k].values.to_numpy(zero_copy_only=False)
                starts = np.zeros(len(sizes) + 1, np.int32)
                np.cumsum(np.maximum(sizes, 0), out=starts[1:])
                raw = pa.decompress(row.column("codes")[k].as_py(), int(starts[-1]) * 4, codec="zstd", asbytes=True) if starts[-1] else b""
                codes = np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(table[codes]), mask=pa.array(sizes < 0))
                out.append(pa.table({row_id: row.column("ids")[k].values, "input_ids": lists}))
        return pa.concat_tables(out)

    pairs = blocks.drop("words").groupBy("block").cogroup(ids.groupBy("of"))  # the words stay where they are
    return pairs.applyInArrow(cut, f"`{row_id}` {kind}, input_ids array<int>")


def encode_rows(
    df: DataFrame, vocabulary: DataFrame, row_id: str = "row_id", text: str = "text", unknown_id: int = -1,
    max_shipped: int = MAX_SHIPPED_TOKENS,
) -> DataFrame:
    """``(row_id, input_ids)``: the vocabulary is shipped if it is small enough, otherwise joined. Same ids either way."""
    n, size = vocabulary_size(vocabulary)
    if n > max_shipped or size > MAX_SHIPPED_BYTES:
        return encode_by_join(df, vocabulary, row_id, text, unknown_id=unknown_id)
    encoder = RegexEncoder(collect_vocabulary(vocabulary), unknown_id)
    return df.select(row_id, encoder.ids(F.col(text)).alias("input_ids"))


@dataclass(frozen=True)
class TableEncoder(Encoder):
    """Pattern tokens with the ids of a vocabulary table of any size, looked up by a join: see :func:`with_ids`.

    ``row_id`` names the column that tells rows apart. Counting stays a column expression.
    """

    vocabulary: DataFrame = field(repr=False)
    row_id: str = "row_id"
    unknown_id: int = -1
    pattern: str = TOKEN_PATTERN
    head: int = 4096

    def identity(self) -> str:
        n, checksum = self.vocabulary.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("token", F.col("id").cast("long")).cast("decimal(20,0)"))
        ).first()
        return f"regex {self.pattern} {self.unknown_id} table {n} {checksum}"

    def ids(self, text: Column) -> Column:
        raise TypeError("ids of a vocabulary table are a join, not a column; use with_ids")

    def count(self, text: Column) -> Column:
        return F.regexp_count(text, F.lit(self.pattern))


def with_ids(
    df: DataFrame,
    text: Column,
    encoder: Encoder,
    max_length: int | None = None,
    add_special_tokens: bool = True,
    special: SpecialIds = SpecialIds(),
    out: str = "input_ids",
) -> DataFrame:
    """The rows with their ids: a column of :func:`encode`, or a join by the row's id for a vocabulary table."""
    if not isinstance(encoder, TableEncoder):
        return df.withColumn(out, encode(text, encoder, max_length, add_special_tokens, special))
    marks = sum(m is not None for m in (special.bos, special.eos)) if add_special_tokens else 0
    keep = None if max_length is None else max(max_length - marks, 0)
    found = encode_by_join(
        df.select(encoder.row_id, text.alias("text")), encoder.vocabulary, encoder.row_id, "text", encoder.pattern,
        encoder.unknown_id, encoder.head, keep,
    )
    front = [special.bos] if add_special_tokens and special.bos is not None else []
    back = [special.eos] if add_special_tokens and special.eos is not None else []
    ids = F.concat(F.array(*map(F.lit, front)).cast("array<int>"), "input_ids", F.array(*map(F.lit, back)).cast("array<int>"))
    return df.join(found.select(encoder.row_id, ids.alias(out)), encoder.row_id)
