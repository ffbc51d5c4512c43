"""Near-duplicate groups by one-permutation MinHash with optimal densification, banded buckets and star-shaped edges.

A document's set is its distinct word shingles. Documents with equal sets are one node from the start. One hash of every
shingle fills all places of a node's signature: the hash's upper bits name the place, the least remainder is its value; an
empty place takes the value of a non-empty one found by a probe sequence that is the same for all. Places are banded, and
nodes that agree on a band share a bucket. In a bucket every node is compared with a hub, the node that meets most others
in all its buckets, instead of with every other; candidate pairs are confirmed on the full sets, and links are joined to
components.

What the stars leave open is done exactly. Nodes of buckets that still hold several components are ordered by their rarest
shingles; two sets as similar as asked must share one of the first few of them, and the rarest they share must stand early
enough in both for the sizes of both. Only nodes that meet so, and are in different components, are compared further,
again by hubs, a few of a group in each round until no group holds an uncompared pair of different components. Looked at
are the nodes that share open buckets in at least `least_shared_bands` bands: a pair as similar as asked shares fewer less
than once in ten million. Between nodes that share as many, no link is lost to the star shape.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.arrow_text import (
    distinct_per_owner,
    mixed,
    release_shuffles,
    shared_folder,
    shingle_hashes,
    stored,
    superseded,
    text_slices,
    word_codes,
    word_hashes,
    written,
)


def least_shared_bands(percent: int, bands: int, rows: int, missed: float = 1e-7) -> int:
    """As many bands as two sets that are similar enough share, but for a chance of `missed`; at least one."""
    hit = (percent / 100) ** rows
    chance, least = (1 - hit) ** bands, 1
    while least < bands:
        chance += math.comb(bands, least) * hit**least * (1 - hit) ** (bands - least)
        if chance > missed:
            break
        least += 1
    return least


@dataclass(frozen=True)
class DedupOptions:
    shingle: int = 5
    percent: int = 80  # links: 100 * intersection >= percent * union
    bands: int = 32
    rows: int = 4  # places of a band; two sets of resemblance 0.8 miss all 32 bands once in ten million times
    hubs: int = 256  # further hubs of a group in a round
    slice_bytes: int = 2 << 20  # text signed at once in a task


def probe_sequence(places: int, attempts: int) -> np.ndarray:
    """For each attempt and empty place, the place it looks at."""
    a = np.arange(attempts, dtype=np.uint64)[:, None] << np.uint64(32)
    return (mixed(mixed(a + np.uint64(1)) ^ np.arange(places, dtype=np.uint64)[None, :]) % np.uint64(places)).astype(np.int64)


def signatures(hashes: np.ndarray, owner: np.ndarray, texts: int, places: int) -> np.ndarray:
    """Signature per text from its distinct hashes, ascending by owner and hash; zero for a text without any."""
    bits = np.uint64(64 - (places - 1).bit_length())
    place = (hashes >> bits).astype(np.int64)  # `places` is a power of two
    first = np.ones(len(hashes), bool)
    first[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    own = np.zeros((texts, places), np.uint64)
    full = np.zeros((texts, places), bool)
    own[owner[first], place[first]] = hashes[first]
    full[owner[first], place[first]] = True
    some = full.any(axis=1)
    text, empty = np.nonzero(~full & some[:, None])
    out = own.copy()
    attempt, probes = 0, probe_sequence(places, 64)
    while len(text):
        if attempt == len(probes):
            probes = np.concatenate([probes, probe_sequence(places, 2 * len(probes))[len(probes) :]])
        at = probes[attempt, empty]
        hit = full[text, at]
        out[text[hit], empty[hit]] = own[text[hit], at[hit]]
        text, empty = text[~hit], empty[~hit]
        attempt += 1
    return out


def _sets(batch: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    codes, starts, words = word_codes(batch.column("text"), lower=True)
    return distinct_per_owner(*shingle_hashes(word_hashes(words)[codes], starts, shingle))


def _node(hashes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """A number for the set, from a sum over its members; 64 bits."""
    total = np.zeros(texts, np.uint64)
    ends = np.searchsorted(owner, np.arange(texts + 1))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)))])
    with np.errstate(over="ignore"):
        total = sums[ends[1:]] - sums[ends[:-1]]
    return mixed(total + np.diff(ends).astype(np.uint64)).view(np.int64)


def document_nodes(documents: DataFrame, o: DedupOptions) -> DataFrame:
    """(doc_id, n_shingles, node, bands) per document, narrow. Equal sets have equal nodes; without words bands are null."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, size=o.slice_bytes):
            hashes, owner = _sets(batch, o.shingle)
            n = np.bincount(owner, minlength=len(batch))
            signature = signatures(hashes, owner, len(batch), o.bands * o.rows)
            keys = np.zeros((len(batch), o.bands), np.uint64)
            with np.errstate(over="ignore"):
                for r in range(o.rows):
                    keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, r :: o.rows])
                keys = mixed(keys + np.arange(o.bands, dtype=np.uint64))
            some = n > 0
            ends = np.concatenate([[0], np.cumsum(np.where(some, o.bands, 0))])
            bands = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(keys[some].ravel().view(np.int64)), mask=pa.array(~some)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(_node(hashes, owner, len(batch))), bands],
                names=["doc_id", "n_shingles", "node", "bands"],
            )

    return documents.select("doc_id", "text").mapInArrow(
        sign, "doc_id long, n_shingles long, node long, bands array<long>"
    )


def shingle_sets(documents: DataFrame, o: DedupOptions) -> DataFrame:
    """(node, shingles) per document: the full set as ascending 64-bit hashes, packed."""

    def collect_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, size=o.slice_bytes):
            hashes, owner = _sets(batch, o.shingle)
            ends = np.searchsorted(owner, np.arange(len(batch) + 1)).astype(np.int32) * 8
            packed = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends), pa.py_buffer(hashes.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(_node(hashes, owner, len(batch))), packed], names=["node", "shingles"]
            )

    return documents.select("text").mapInArrow(collect_sets, "node long, shingles binary")


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    """Whether sets of the sizes in the two columns can be linked at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = np.zeros(len(batch), bool)
            for k in range(len(batch)):
                x = np.frombuffer(left[k].as_buffer(), np.uint64)
                y = np.frombuffer(right[k].as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    return joined.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long")


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(node, component): the least node reachable over links (a, b), for every node in a link; and its table's folder.

    Stars are turned in alternation: large stars hang greater neighbours on the least one, small stars the smaller ones,
    until only stars are left; the rounds grow with the logarithm of the longest path.
    """

    def turned(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.filter("b < a")
        least = near.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        hung = near.filter("b > a") if large else near
        moved = hung.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        if not large:
            moved = moved.union(least.select("a", F.col("low").alias("b")))
        return moved.filter("a <> b")

    def settled(edges: DataFrame) -> bool:
        """Whether all edges are stars: a node with an edge to a smaller one has no other edge."""
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
        loose = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).filter("up > 0 AND n > 1")
        return loose.agg(F.count("*")).first()[0] == 0

    either = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, folder = stored(either, "dedup-stars")
    while not settled(edges):
        edges, next_folder = stored(turned(turned(edges, True), False).distinct(), "dedup-stars")
        superseded(links.sparkSession, folder)
        folder = next_folder
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select("b", "b").distinct()), folder


def _in_components(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component, with their `component`."""
    rows = buckets.join(found, "node", "left")
    rows = rows.withColumn("component", F.coalesce("component", "node"))
    several = rows.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    return rows.join(several, "bucket", "left_semi")


def _rare_groups(sets: DataFrame, nodes: DataFrame, found: DataFrame, o: DedupOptions) -> tuple[DataFrame, str]:
    """(bucket, node, size, most), and the folder of a table it reads: the nodes by each of their rarest shingles, as many as a similar set cannot all be without.

    Shingles are ordered by how many of the nodes have them, then by hash. If the first shingle that two sets share stands
    at place i of n, they share at most n - i + 1; with `percent` of their union in common that bounds the other's size by
    `most`. Groups of one component, and rows whose group has no node as small as that, are left out. The table holds the
    rows with their `most`: the groups look at them four times, and places are found once.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("shingles")
            sizes = pc.binary_length(packed).to_numpy(zero_copy_only=False) // 8
            hashes = np.frombuffer(b"".join(packed.to_pylist()), np.int64)
            node = np.repeat(batch.column("node").to_numpy(), sizes)
            size = np.repeat(sizes, sizes).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(size), pa.array(hashes)], names=["node", "size", "shingle"])

    rows = sets.join(nodes, "node", "left_semi").select("node", "shingles").mapInArrow(listed, "node long, size long, shingle long")
    rows, folder = stored(rows, "dedup-shingles")
    held = rows.groupBy("shingle").agg(F.count("*").alias("held"))
    ranked = rows.join(held, "shingle").withColumn(
        "place", F.row_number().over(Window.partitionBy("node").orderBy("held", "shingle"))
    )
    most = F.floor((F.col("size") - F.col("place") + 1) * (100 + o.percent) / o.percent) - F.col("size")
    ranked = ranked.withColumn("most", most).filter((F.col("held") > 1) & (F.col("most") * 100 >= F.col("size") * o.percent - 100))
    groups, ranked_folder = stored(ranked.select(F.col("shingle").alias("bucket"), "node", "size", "most"), "dedup-ranked")
    superseded(sets.sparkSession, folder)
    release_shuffles(sets.sparkSession)
    return _with_partners(_in_components(groups, found).drop("component")), ranked_folder


def _with_partners(groups: DataFrame) -> DataFrame:
    """Rows in whose group there are two at least, and one small enough for this one."""
    least = groups.groupBy("bucket").agg(F.min("size").alias("least"), F.count("*").alias("rows")).filter("rows > 1")
    return groups.join(least, "bucket").filter("most >= least").drop("least", "rows")


def _further_pairs(buckets: DataFrame, found: DataFrame, last: DataFrame, o: DedupOptions) -> tuple[DataFrame, DataFrame, str]:
    """Next hubs of groups that hold more than one component beyond their last hub, the pairs to compare, and the folder
    of a table both read."""
    beyond = buckets.join(last, "bucket", "left").filter("last IS NULL OR node > last").drop("last")
    rows, folder = stored(_in_components(_with_partners(beyond), found), "dedup-open")
    slot = Window.partitionBy("bucket", "slot").orderBy("node")
    least = rows.withColumn("slot", F.pmod("node", F.lit(64))).withColumn("place", F.row_number().over(slot))
    least = least.filter(F.col("place") <= o.hubs)
    hubs = least.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("node"))).filter(F.col("place") <= o.hubs)
    hubs = hubs.select(
        "bucket", F.col("node").alias("a"), F.col("component").alias("of"), F.col("size").alias("size_a"), F.col("most").alias("most_a")
    )
    pairs = (
        rows.join(hubs, "bucket")
        .filter((F.col("node") > F.col("a")) & (F.col("component") != F.col("of")))
        .filter(F.expr("size <= most_a AND size_a <= most") & _sizes_allow("size", "size_a", o.percent))
        .select("a", F.col("node").alias("b"))
        .distinct()
    )
    return hubs.groupBy("bucket").agg(F.max("a").alias("last")), pairs, folder


def near_duplicates(documents: DataFrame, options: DedupOptions | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document: the least doc_id of its group, and whether it is that.

    A null or empty text has no shingles and is a group of its own; so is a row without doc_id, which is kept. Rows are
    told apart by their sets: rows with equal doc_ids and unlike texts can be in different groups, and equal rows share
    one (each is kept if its id is the least).
    Intermediate tables are written to the shared folder. An empty table gives no rows.
    """
    o = options or DedupOptions()
    spark = documents.sparkSession
    signed = written(document_nodes(documents, o), shared_folder(spark, "dedup-nodes"))
    worded = signed.filter("bands IS NOT NULL AND doc_id IS NOT NULL")
    least = worded.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"))
    nodes = written(
        worded.join(least, ["node", "doc_id"]).dropDuplicates(["node"]).select("node", "doc_id", "size", "bands"),
        shared_folder(spark, "dedup-sets-of-documents"),
    )
    spread = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = written(spread.join(shared, "bucket"), shared_folder(spark, "dedup-buckets"))
    degrees = buckets.groupBy("node").agg(F.sum(F.col("n") - 1).alias("degree"))
    ranked = buckets.join(degrees, "node")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "node", "size")).alias("hub"))
    hubs = hubs.select("bucket", F.col("hub.node").alias("a"), F.col("hub.size").alias("size_a"))
    pairs = buckets.join(hubs, "bucket").filter((F.col("node") != F.col("a")) & _sizes_allow("size", "size_a", o.percent))
    pairs = pairs.select("a", F.col("node").alias("b")).distinct()
    # full sets of nodes that share a bucket, from one document each
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("doc_id").distinct()
    texts = documents.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    sets = shingle_sets(texts, o).dropDuplicates(["node"])
    sets = written(sets, shared_folder(spark, "dedup-sets"))
    release_shuffles(spark)  # here and below: the driver holds what was broadcast, and plans, until its collector has run
    links = written(confirmed(pairs, sets, o.percent), shared_folder(spark, "dedup-links"))
    release_shuffles(spark)
    found, stars_folder = components(links)
    release_shuffles(spark)
    # a node that has a link open meets the other end in several buckets
    several = least_shared_bands(o.percent, o.bands, o.rows)
    left = _in_components(buckets, found).groupBy("node").count().filter(F.col("count") >= several).select("node")
    groups, shingles_folder = _rare_groups(sets, left, found, o)
    groups = written(groups, shared_folder(spark, "dedup-groups"))
    superseded(spark, shingles_folder)
    last, last_folder = stored(groups.select("bucket", F.lit(None).cast("long").alias("last")).limit(0), "dedup-last")
    while True:
        release_shuffles(spark)
        last_now, more, open_folder = _further_pairs(groups, found, last, o)
        more, more_folder = stored(more, "dedup-pairs")
        if more.isEmpty() and last_now.isEmpty():
            superseded(spark, open_folder, more_folder)
            break
        new, new_folder = stored(confirmed(more, sets, o.percent), "dedup-new")
        if not new.isEmpty():
            stars = found.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            found, next_folder = components(stars.union(new))
            superseded(spark, stars_folder)
            stars_folder = next_folder
        last, next_folder = stored(last.union(last_now).groupBy("bucket").agg(F.max("last").alias("last")), "dedup-last")
        superseded(spark, open_folder, more_folder, new_folder, last_folder)
        last_folder = next_folder
    grouped = nodes.select("node", "doc_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = grouped.join(ids, "component").select("node", "component_id")
    rows = signed.select("doc_id", "n_shingles", F.when(F.expr("bands IS NOT NULL AND doc_id IS NOT NULL"), F.col("node")).alias("node"))
    rows = rows.join(named, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return rows.select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def keep_one_of_each(documents: DataFrame, options: DedupOptions | None = None) -> DataFrame:
    """One document of each group of near duplicates, the one of least doc_id, with all columns. Equal rows are one.

    Documents without words, and those with a null doc_id, stay.
    """
    names = documents.columns
    marked = near_duplicates(documents, options).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = documents.join(marked, documents["doc_id"].eqNullSafe(marked["kept_id"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "text"]).select(*(rows[n] for n in names))
