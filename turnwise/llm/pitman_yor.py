"""Language-model scores by a hierarchical Pitman-Yor model learned from the corpus itself.

The token before a token chooses its restaurant: each distinct token has one of its own, however rare. Behind it stands a
restaurant shared by the tokens with the same ending; behind those stands one for the whole corpus, and behind that the
uniform distribution over the vocabulary and one unknown token. Tables of a restaurant are customers of the one behind it.

Dishes (tokens) are dealt to buckets by hash, and a bucket holds all restaurants' customers for its dishes, so tables
and customers of all levels meet in one task; a restaurant's total over all buckets is estimated from the bucket's hashed
share, a dish's own tables counted once, while seating, and exact when predicting: a token's own restaurant has as many customers
as the token has learned occurrences, and its tables are summed in the bucket of that token as a dish. Seating is sampled by Gibbs sweeps: the customers of a dish leave a
restaurant together and the number of their tables is drawn anew given all else - up to 64 customers from the exact
conditional, with generalised Stirling numbers, more of them in the order of the Chinese restaurant, in groups of a
sixteenth. The discount of a level is found in each bucket from dishes served once and twice; as discounts belong to
dishes, the probabilities still sum to one. Customers and tables of a token's own restaurant, and the probabilities behind it,
are averaged over the last sweeps.

Documents are cut into blocks of bounded text. A block sends each bucket its distinct (dish, restaurant) pairs with counts,
and gets back what its tokens need. All pairs of all documents are counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.arrow_text import (
    mixed, release_shuffles, shared_folder, stored, superseded, text_slices, word_codes, word_hashes, written,
)

RELEASE_SECONDS = 2.0  # in which executors delete the files of a seating's shuffle, which are as large as the input
EXACT = 64  # customers of a dish up to which the number of tables is drawn from its exact conditional


@dataclass(frozen=True)
class ModelOptions:
    frequent: int = 512  # without effect, for older callers: every token has a restaurant of its own
    endings: int = 64  # restaurants by ending
    strength: float = 1.0
    burn_in: int = 2
    samples: int = 3
    block_bytes: int = 8 << 20
    bucket_tokens: int = 2 << 20
    seed: int = 11


PLAIN, DIFFERENCES, DISTINCT = 0, 1, 2  # of the last, the places of all values follow as an array


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one compressed piece: ascending hashes as differences, floats that recur as the distinct ones and their
    places, all values byte by byte in planes. Nothing is rounded."""
    import zstandard

    head, planes = [0], []

    def add(a: np.ndarray, form: int) -> None:
        head[0] += 1
        head.extend([len(a), ord(a.dtype.char), form])
        a = np.ascontiguousarray(np.diff(a, prepend=a.dtype.type(0)) if form == DIFFERENCES else a)
        planes.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())

    for a in arrays:
        if a.dtype == np.float32:
            values, at = np.unique(a, return_inverse=True)
            if 2 * len(values) <= len(a):
                add(values, DISTINCT)
                a = _narrow(at)
        add(a, DIFFERENCES if a.dtype == np.uint64 and bool((a[1:] >= a[:-1]).all()) else PLAIN)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array(head, np.int64).tobytes(), *planes]))


def _unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at, values = [], 8 + 24 * n, None
    for size, kind, form in np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3).tolist():
        width = np.dtype(chr(kind)).itemsize
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        a = np.ascontiguousarray(planes.T).view(chr(kind)).ravel()
        at += size * width
        if form == DISTINCT:
            values = a
            continue
        a = np.cumsum(a, dtype=np.uint64) if form == DIFFERENCES else a
        out.append(a if values is None else values[a])
        values = None
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def _endings(words: pa.Array, n: int) -> np.ndarray:
    tails = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
    hashes = word_hashes(tails.dictionary, 1)
    return (hashes % np.uint64(n)).astype(np.uint8)[tails.indices.to_numpy(zero_copy_only=False)]


END = np.uint64(word_hashes(pa.array([""]))[0])  # no word is empty


def _block_rows(documents: DataFrame, held_out: Column, o: ModelOptions) -> DataFrame:
    """Blocks of documents: ids, token counts, and packed tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal number, held, size
            rows = pa.Table.from_batches(held).combine_chunks()
            text = rows["text"].chunk(0) if rows.num_rows else pa.array([], pa.large_string())
            codes, starts, words = word_codes(text, lower=True)
            n = np.diff(starts)
            codes = np.insert(codes, starts[1:], len(words)).astype(np.int32)  # the end of each document
            n = n + 1
            hashes = np.append(word_hashes(words), END)
            endings = np.append(_endings(words, o.endings), np.uint8(0))
            unknown = rows["held_out"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
            order = np.argsort(hashes)
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            codes, hashes, endings = place[codes], hashes[order], endings[order]
            learned = int(n[~unknown].sum())
            out = pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number], pa.int64()),
                    "doc_ids": pa.array([rows["doc_id"].to_pylist()], pa.list_(pa.int64())),
                    "held_out": pa.array([unknown.tolist()], pa.list_(pa.bool_())),
                    "counts": pa.array([n.tolist()], pa.list_(pa.int64())),
                    "n_tokens": pa.array([len(codes)], pa.int64()),
                    "n_learned": pa.array([learned], pa.int64()),
                    "tokens": pa.array([_pack([hashes, endings, codes])], pa.binary()),
                }
            )
            number, held, size = number + 1, [], 0
            return out

        for batch in text_slices(batches):
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= o.block_bytes:
                yield block()
        if size:
            yield block()

    rows = documents.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(
        cut,
        "block long, doc_ids array<long>, held_out array<boolean>, counts array<long>, n_tokens long, n_learned long, tokens binary",
    )


@dataclass(frozen=True)
class Layout:
    """Restaurants in a bucket: one per ending, then one per token before its dishes, with the ending behind it."""

    frequent: np.ndarray  # hashes of the tokens before, ascending
    behind: np.ndarray
    endings: int
    buckets: int


class Block:
    """A block's tokens as pairs of dish and token before, in an order both its senders and its receivers know."""

    def __init__(self, tokens: bytes, counts: np.ndarray, buckets: int):
        self.ascending, self.endings, codes = _unpack(tokens)
        bucket = (mixed(self.ascending) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((self.ascending, bucket))
        self.place = np.empty(len(order), np.int64)  # of a hash, by bucket
        self.place[order] = np.arange(len(order))
        self.hashes, self.bucket = self.ascending[order], bucket[order]
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        before[first] = np.searchsorted(self.ascending, END)  # a document begins after an end
        pairs, self.pair_of = np.unique(self.place[codes] * max(len(order), 1) + before, return_inverse=True)
        self.dish, self.before = np.divmod(pairs, max(len(order), 1))
        self.word_of = self.dish[self.pair_of]


def _requests(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, pairs): what each block sends to each bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                counts = batch.column("counts")[k].values.to_numpy()
                block = Block(batch.column("tokens")[k].as_py(), counts, buckets)
                learned = ~batch.column("held_out")[k].values.to_numpy(zero_copy_only=False)
                seen = np.bincount(block.pair_of[np.repeat(learned, counts)], minlength=len(block.dish))
                per_dish = np.bincount(block.dish, minlength=len(block.hashes))
                words = np.searchsorted(block.bucket, np.arange(buckets + 1))
                ends = np.concatenate([[0], np.cumsum(per_dish)])[words]
                rows = []
                for b in range(buckets):
                    w, p = slice(words[b], words[b + 1]), slice(ends[b], ends[b + 1])
                    if words[b] < words[b + 1]:
                        before, at = np.unique(block.before[p], return_inverse=True)
                        parts = [block.hashes[w], _narrow(per_dish[w]), block.ascending[before], block.endings[before], _narrow(at), _narrow(seen[p])]
                        rows.append((b, _pack(parts)))
                number = batch.column("block")[k].as_py()
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([b for b, _ in rows], pa.int32()),
                        "block": pa.array([number] * len(rows), pa.int64()),
                        "pairs": pa.array([p for _, p in rows], pa.binary()),
                    }
                )

    return blocks.select("block", "counts", "held_out", "tokens").mapInArrow(send, "bucket int, block long, pairs binary")


def log_stirling(discount: float, size: int) -> np.ndarray:
    """Logarithms of generalised Stirling numbers [customers, tables]."""
    out = np.full((size + 1, size + 2), -np.inf)
    out[1, 1] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(1, size):
            t = np.arange(1, size + 1)
            stay = np.where(c > discount * t, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf) + out[c, 1 : size + 1]
            out[c + 1, 1 : size + 1] = np.logaddexp(stay, out[c, :size])
    return out


def draw_tables(customers: np.ndarray, opening: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """Tables of each (dish, restaurant) given its customers and the weight of opening a table for the dish."""
    tables = np.minimum(customers, 1)
    opening = np.maximum(opening, 1e-300)
    stirling = log_stirling(discount, EXACT)
    order = np.argsort(customers, kind="stable")
    ranks = customers[order]
    low, high = int(np.searchsorted(ranks, 2)), int(np.searchsorted(ranks, EXACT, side="right"))
    for c in np.unique(ranks[low:high]).tolist():
        at = order[np.searchsorted(ranks, c) : np.searchsorted(ranks, c, side="right")]
        t = np.arange(1, c + 1)
        weights = np.log(opening[at])[:, None] * t + stirling[c, 1 : c + 1]
        weights = np.exp(weights - weights.max(axis=1, keepdims=True))
        ends = np.cumsum(weights, axis=1)
        tables[at] = 1 + (ends < random.random(len(at))[:, None] * ends[:, -1:]).sum(axis=1)
    at = order[high:]
    if len(at):
        target, a = customers[at], opening[at]
        seated, t = np.ones(len(at), np.int64), np.ones(len(at), np.int64)
        while True:
            some = np.flatnonzero(seated < target)
            if not len(some):
                break
            group = np.minimum(target[some] - seated[some], np.maximum(1, seated[some] // 16))
            chance = a[some] / (a[some] + np.maximum(seated[some] - discount * t[some], 1e-9))
            t[some] += random.binomial(group, np.clip(chance, 0, 1))
            seated[some] += group
        tables[at] = t
    return tables


def _discount(customers: np.ndarray) -> float:
    once, twice = int((customers == 1).sum()), int((customers == 2).sum())
    return float(np.clip((once + 0.5) / (once + 2 * twice + 1), 0.05, 0.95))


def seat_bucket(dish: np.ndarray, restaurant: np.ndarray, seen: np.ndarray, dishes: int, layout: Layout, o: ModelOptions, seed: int) -> dict:
    """Gibbs sweeps over the restaurants of one bucket's dishes; pairs (dish, restaurant) are distinct.

    Gives, per sample, customers and tables of pairs, of (dish, ending) and of dishes, and where each pair finds its
    (dish, ending); and the totals of customers and discounted tables per restaurant.
    """
    random = np.random.default_rng((o.seed, seed))
    share, e = layout.buckets, layout.endings
    own = restaurant >= e
    behind = np.where(own, layout.behind[np.maximum(restaurant - e, 0)] if len(layout.behind) else 0, restaurant)
    shared, to_shared = np.unique(dish * e + behind, return_inverse=True)
    shared_dish, ending = np.divmod(shared, e)
    direct = np.bincount(to_shared[~own], weights=seen[~own], minlength=len(shared)).astype(np.int64)
    fine, fine_to = np.flatnonzero(own), to_shared[own]
    fine_seen = seen[own]
    fine_restaurant = restaurant[own] - e
    count = np.bincount(dish, weights=seen, minlength=dishes)
    total = max(1.0, share * float(count.sum()))
    vocabulary = share * float((count > 0).sum())
    root = (count + 0.5) / (total + 0.5 * vocabulary + 1)  # only to begin with
    near = root[shared_dish]
    d3 = _discount(fine_seen)
    tables3 = np.minimum(fine_seen, 1)
    d2 = d1 = 0.5
    tables2: np.ndarray | None = None
    kept: list[dict] = []
    for sweep in range(o.burn_in + o.samples):
        open3 = share * np.bincount(fine_restaurant, weights=tables3, minlength=len(layout.frequent))
        others = open3[fine_restaurant] - (share - 1) * tables3  # a dish's own tables are no sample of other buckets
        tables3 = draw_tables(fine_seen, (o.strength + d3 * others) * near[fine_to], d3, random)
        customers2 = direct + np.bincount(fine_to, weights=tables3, minlength=len(shared)).astype(np.int64)
        d2 = _discount(customers2)
        if tables2 is None:
            tables2 = np.minimum(customers2, 1)
        open2 = share * np.bincount(ending, weights=tables2, minlength=e)
        tables2 = draw_tables(customers2, (o.strength + d2 * open2[ending]) * root[shared_dish], d2, random)
        customers1 = np.bincount(shared_dish, weights=tables2, minlength=dishes).astype(np.int64)
        d1 = _discount(customers1)
        base = 1 / (vocabulary + 1)
        opening = o.strength + d1 * share * float((customers1 > 0).sum())
        tables1 = draw_tables(customers1, np.full(dishes, opening * base), d1, random)
        sat = share * float(customers1.sum())
        root = (customers1 - d1 * tables1 + (o.strength + d1 * share * float(tables1.sum())) * base) / (o.strength + sat)
        root = np.maximum(root, 1e-300)
        open2 = share * np.bincount(ending, weights=tables2, minlength=e)
        sat2 = share * np.bincount(ending, weights=customers2, minlength=e)
        near = customers2 - d2 * tables2 + (o.strength + d2 * open2[ending]) * root[shared_dish]
        near = np.maximum(near / (o.strength + sat2[ending]), 1e-300)
        if sweep >= o.burn_in:
            kept.append(
                {
                    "fine": fine_seen - d3 * tables3, "shared": customers2 - d2 * tables2, "root": customers1 - d1 * tables1,
                    "totals": np.concatenate([
                        [customers1.sum(), d1 * tables1.sum()],
                        np.bincount(ending, weights=customers2, minlength=e), np.bincount(ending, weights=d2 * tables2, minlength=e),
                        np.bincount(fine_restaurant, weights=fine_seen, minlength=len(layout.frequent)),
                        np.bincount(fine_restaurant, weights=d3 * tables3, minlength=len(layout.frequent)),
                    ]),
                }
            )
    return {"samples": kept, "fine": fine, "to_shared": to_shared, "count": count}


@dataclass(frozen=True)
class Totals:
    """Of all buckets: distinct learned tokens, and per sample customers and discounted tables of the shared restaurants."""

    vocabulary: int
    samples: np.ndarray

    def parts(self, seated: dict, dish: np.ndarray, restaurant: np.ndarray, layout: Layout, o: ModelOptions) -> list[np.ndarray]:
        """Of each pair of a bucket, averaged over the samples: discounted customers, and the probability behind."""
        e = layout.endings
        behind = layout.behind[restaurant - e]
        seats, chance = np.zeros(len(dish)), np.zeros(len(dish))
        for sample, total in zip(seated["samples"], self.samples, strict=True):
            root = (sample["root"] + (o.strength + total[1]) / (self.vocabulary + 1)) / (o.strength + total[0])
            sat2, open2 = total[2 : 2 + e], total[2 + e : 2 + 2 * e]
            p = sample["shared"][seated["to_shared"]] + (o.strength + open2[behind]) * root[dish]
            chance += p / (o.strength + sat2[behind]) / o.samples
            seats += sample["fine"] / o.samples
        return [seats.astype(np.float32), chance.astype(np.float32)]


def _bucket(table: pa.Table, buckets: int, o: ModelOptions) -> dict:
    """A bucket's pairs from what the blocks sent, and its seating, which is the same each time: it depends on the counts
    and a seed alone."""
    bucket = table["bucket"][0].as_py()
    sent = [_unpack(p.as_py()) for p in table["pairs"]]
    hashes, to_dish = np.unique(np.concatenate([s[0] for s in sent]), return_inverse=True)
    before, first, to_before = np.unique(np.concatenate([s[2] for s in sent]), return_index=True, return_inverse=True)
    layout = Layout(before, np.concatenate([s[3] for s in sent])[first].astype(np.int64), o.endings, buckets)
    words, lists = np.cumsum([0] + [len(s[0]) for s in sent]), np.cumsum([0] + [len(s[2]) for s in sent])
    dish = np.concatenate([np.repeat(to_dish[a:b], s[1]) for s, a, b in zip(sent, words[:-1], words[1:], strict=True)])
    where = np.concatenate([to_before[a:b][s[4]] for s, a, b in zip(sent, lists[:-1], lists[1:], strict=True)])
    seen = np.concatenate([s[5].astype(np.int64) for s in sent])
    bounds = np.cumsum([0] + [len(s[4]) for s in sent])
    del sent, to_before, first
    dish *= len(before)
    dish += where
    del where
    pairs, to_pair = np.unique(dish, return_inverse=True)
    to_pair, to_dish = to_pair.astype(np.int32), to_dish.astype(np.int32)
    dish, restaurant = np.divmod(pairs, len(before))
    restaurant += o.endings
    seen = np.bincount(to_pair, weights=seen, minlength=len(pairs)).astype(np.int64)
    return {
        "bucket": bucket, "hashes": hashes, "layout": layout, "dish": dish, "restaurant": restaurant,
        "words": [to_dish[a:b] for a, b in zip(words[:-1], words[1:], strict=True)],
        "pairs": [to_pair[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
        "seated": seat_bucket(dish, restaurant, seen, len(hashes), layout, o, bucket),
    }


def _totals(requests: DataFrame, buckets: int, o: ModelOptions) -> DataFrame:
    """(bucket, origin, opened, totals) from seating every bucket. The discounted tables of a token's own restaurant go to the
    bucket of that token; the shared restaurants' totals stand in a row of bucket -1."""

    def seat(table: pa.Table) -> pa.Table:
        b = _bucket(table.sort_by("block"), buckets, o)
        shared, f = 2 + 2 * o.endings, len(b["layout"].frequent)
        totals = [x["totals"] for x in b["seated"]["samples"]]
        opened = np.sum([x[shared + f :] for x in totals], axis=0) / o.samples
        some = np.flatnonzero(opened > 0)
        hashes, opened = b["layout"].frequent[some], opened[some].astype(np.float32)
        target = (mixed(hashes) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(target, kind="stable")  # hashes still ascend within a target
        hashes, opened, target = hashes[order], opened[order], target[order]
        ends = np.searchsorted(target, np.arange(buckets + 1))
        sent = [k for k in range(buckets) if ends[k] < ends[k + 1]]
        learned = float((b["seated"]["count"] > 0).sum())
        sums = np.concatenate([[learned], *(x[:shared] for x in totals)]).tolist()
        return pa.table(
            {
                "bucket": pa.array([-1, *sent], pa.int32()),
                "origin": pa.array([b["bucket"]] * (len(sent) + 1), pa.int32()),
                "opened": pa.array([None, *(_pack([hashes[ends[k] : ends[k + 1]], opened[ends[k] : ends[k + 1]]]) for k in sent)], pa.binary()),
                "totals": pa.array([sums, *([[]] * len(sent))], pa.list_(pa.float64())),
            }
        )

    return requests.groupBy("bucket").applyInArrow(seat, "bucket int, origin int, opened binary, totals array<double>")


def _answers(requests: DataFrame, opened: DataFrame, buckets: int, o: ModelOptions, totals: Totals) -> DataFrame:
    """(block, bucket, answer): learned occurrences and own tables of a block's dishes, and the parts of its pairs."""

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # a token before stands in a block, so its bucket is always asked
            return pa.table({"block": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "answer": pa.array([], pa.binary())})
        left = left.sort_by("block")
        b = _bucket(left, buckets, o)
        tables = np.zeros(len(b["hashes"]))
        for row in right.sort_by("origin")["opened"]:
            hashes, n = _unpack(row.as_py())
            tables[np.searchsorted(b["hashes"], hashes)] += n
        count, tables = b["seated"]["count"].astype(np.uint64), tables.astype(np.float32)
        seats, chance = totals.parts(b["seated"], b["dish"], b["restaurant"], b["layout"], o)
        found = [_pack([_narrow(count[w]), tables[w], seats[p], chance[p]]) for w, p in zip(b["words"], b["pairs"], strict=True)]
        return pa.table(
            {"block": left["block"], "bucket": pa.array([b["bucket"]] * len(found), pa.int32()), "answer": pa.array(found, pa.binary())}
        )

    pairs = requests.groupBy("bucket").cogroup(opened.groupBy("bucket"))
    return pairs.applyInArrow(answer, "block long, bucket int, answer binary")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of a task's lists, which are of equal length; nothing without any."""
    total: np.ndarray | float = 0.0
    for batch in batches:
        for k in range(len(batch)):
            total = total + batch.column("totals")[k].values.to_numpy()
    if not isinstance(total, float):
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["totals"])


def score_documents(documents: DataFrame, held_out: Column, options: ModelOptions | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity per document.

    Learns from documents that are not held out (a null `held_out` is learned from), scores all whole texts. A null or
    empty text is one token, its end. `score` and `base_score` are logarithms to the base 10. Equal texts of one fold have
    equal scores. An empty table gives no rows; with nothing to learn from every token is unknown. Blocks and answers are
    written to the shared folder; the driver sees the shared restaurants' totals, which are of bounded number. Buckets are
    seated twice, alike, for the totals and then for the answers, so that no seating has to be stored.
    """
    o = options or ModelOptions()
    spark = documents.sparkSession
    blocks = written(_block_rows(documents, held_out, o), shared_folder(spark, "lm-blocks"))
    sums = blocks.agg(F.sum("n_tokens"), F.sum("n_learned")).first()
    tokens, learned = int(sums[0] or 0), int(sums[1] or 0)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // o.bucket_tokens))
    found, folder = stored(_totals(_requests(blocks, buckets), buckets, o), "lm-totals")
    # summed in a few tasks and then here: one list from each
    parts = found.filter("bucket < 0").select("totals").repartition(16).mapInArrow(_summed, "totals array<double>").collect()
    summed = np.sum([r["totals"] for r in parts], axis=0).tolist() if parts else []
    vocabulary = int(summed[0]) if summed else 0
    totals = Totals(vocabulary, np.array(summed[1:]).reshape(o.samples, -1) if summed else np.zeros((o.samples, 0)))
    release_shuffles(spark, RELEASE_SECONDS)  # the shuffle of the first seating goes before the second one is written
    opened = found.filter("bucket >= 0").select("bucket", "origin", "opened")
    answers = written(_answers(_requests(blocks, buckets), opened, buckets, o, totals), shared_folder(spark, "lm-answers"))
    superseded(spark, folder)
    release_shuffles(spark, RELEASE_SECONDS)  # that of the second seating, before blocks meet their answers

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        ids, held, scores = [], [], []
        for k in range(left.num_rows):
            counts = left["counts"][k].values.to_numpy()
            block = Block(left["tokens"][k].as_py(), counts, buckets)
            parts = [_unpack(a.as_py()) for a in right["answer"]]
            count = np.concatenate([p[0] for p in parts]).astype(np.float64)
            tables, seats, chance = (np.concatenate([p[i] for p in parts]).astype(np.float64) for i in (1, 2, 3))
            own = block.place[block.before]  # the token before, as a dish: its occurrences are its restaurant's customers
            chance = (seats + (o.strength + tables[own]) * chance) / (o.strength + count[own])
            owner = np.repeat(np.arange(len(counts)), counts)
            base = np.log10((count + 1) / (learned + 1 * (vocabulary + 1)))[block.word_of]
            model = np.log10(chance)[block.pair_of]
            known = (count > 0)[block.word_of]
            ids += left["doc_ids"][k].as_py()
            held += left["held_out"][k].as_py()
            sums = [np.bincount(owner, weights=x, minlength=len(counts)) for x in (known, base, model)]
            scores.append(np.stack([counts.astype(np.float64), *sums]))
        n, known, base, model = np.concatenate(scores, axis=1) if scores else np.zeros((4, 0))
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "held_out": pa.array(held, pa.bool_()),
                "n_tokens": pa.array(n.astype(np.int64)),
                "n_known": pa.array(known.astype(np.int64)),
                "train_tokens": pa.array(np.full(len(n), learned, np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(model),
                "perplexity": pa.array(np.power(10.0, np.minimum(-model / np.maximum(n, 1), 300))),
            }
        )

    mine = blocks.select("block", "doc_ids", "held_out", "counts", "tokens").groupBy("block")
    theirs = answers.groupBy("block")
    return mine.cogroup(theirs).applyInArrow(
        score,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
        "perplexity double",
    )
