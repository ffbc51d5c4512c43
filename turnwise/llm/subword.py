"""Supervised subword embeddings: learned vectors of hashed words and character n-grams, averaged, and a linear softmax.

A document's features are its words, the character n-grams of each word with its borders, and a feature for a word that
repeats the one before it. Every feature is hashed to a row of an embedding table; the document is the mean of its rows,
a softmax over labels follows. Training is stochastic gradient descent in numpy on a bounded sample. For scoring, table
and softmax are folded into one row of logits per feature, so that a word costs a sum over its features once per slice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.arrow_text import mixed, shared_folder, sliced, word_codes, written

TOGETHER = 1 << 13  # words whose features are hashed at once


@dataclass(frozen=True)
class SubwordOptions:
    buckets: int = 1 << 16
    dimensions: int = 16
    shortest: int = 2  # character n-grams
    longest: int = 4
    lower: bool = False
    sample: int = 2000  # labelled documents to learn from, at most
    sample_chars: int = 6 << 20  # and characters of them
    visits: int = 9000  # documents seen in training, repeats included; every document at least twice
    batch: int = 16
    rate: float = 2.0
    calibration: float = 0.2  # share of the sample kept from training
    seed: int = 7


@dataclass(frozen=True)
class SubwordModel:
    """Logits per feature row, the labels, the bias, and the temperature and least confidence found by calibration."""

    logits: np.ndarray
    bias: np.ndarray
    labels: tuple[str, ...]
    options: SubwordOptions
    temperature: float = 1.0
    reject_below: float = 0.0


def word_features(words: list[str], o: SubwordOptions) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the distinct words one after another, and how many each has (the word itself included)."""
    parts = [_word_features(words[k : k + TOGETHER], o) for k in range(0, len(words), TOGETHER)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate([rows for rows, _ in parts]), np.concatenate([counts for _, counts in parts])


def _word_features(words: list[str], o: SubwordOptions) -> tuple[np.ndarray, np.ndarray]:
    joined = "".join(f"\x02{w}\x03" for w in words)  # marks a word's borders
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(points)) - starts[owner]
    left = lengths[owner] - place
    multiplier = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), multiplier))
        whole = np.add.reduceat(mixed(points) * powers[place], starts)
        found, owners = [mixed(whole)], [np.arange(len(words))]
        rolling = np.zeros(len(points), np.uint64)
        for n in range(1, min(o.longest, len(points)) + 1):  # a slice may have no word at all
            rolling[: len(points) - n + 1] = rolling[: len(points) - n + 1] * multiplier + points[n - 1 :]
            if n >= o.shortest:
                fits = left >= n
                found.append(mixed(rolling[fits] + np.uint64(n)))
                owners.append(owner[fits])
    rows, of = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    return (rows[order] % np.uint64(o.buckets)).astype(np.int32), np.bincount(of, minlength=len(words))


def text_terms(text: pa.Array, o: SubwordOptions) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Term codes in text order, where each text's terms begin, distinct terms. A repeated word adds an empty term."""
    codes, starts, words = word_codes(pc.utf8_lower(text) if o.lower else text)
    n = np.diff(starts)
    owner = np.repeat(np.arange(len(n)), n)
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    at = np.flatnonzero(again)
    codes = np.insert(codes, at, len(words))
    counts = n + np.bincount(owner[at], minlength=len(n))
    return codes, np.concatenate([[0], np.cumsum(counts)]), pa.concat_arrays([words, pa.array([""], words.type)])


def document_logits(model: SubwordModel, text: pa.Array) -> np.ndarray:
    """Logits of each text; a text without words has the bias alone."""
    codes, starts, words = text_terms(text, model.options)
    rows, counts = word_features(words.to_pylist(), model.options)
    k = len(model.labels)
    firsts = np.cumsum(counts) - counts
    out = np.tile(model.bias, (len(text), 1))
    n = np.diff(starts)
    owner = np.repeat(np.arange(len(n)), n)
    features = np.bincount(owner, weights=counts[codes], minlength=len(n))
    for label in range(k):
        per_word = np.add.reduceat(model.logits[rows, label].astype(np.float64), firsts)
        total = np.bincount(owner, weights=per_word[codes], minlength=len(n))
        out[:, label] += total / np.maximum(features, 1)
    return out


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], options: SubwordOptions | None = None) -> SubwordModel:
    """Learns from the texts; the model has one label and certain scores if the sample has one, none if it is empty."""
    o = options or SubwordOptions()
    names = tuple(sorted(set(labels)))
    random = np.random.default_rng(o.seed)
    if len(names) < 2:
        return SubwordModel(np.zeros((o.buckets, len(names)), np.float32), np.zeros(len(names)), names, o)
    target = np.array([names.index(x) for x in labels])
    codes, starts, words = text_terms(pa.array(texts, pa.large_string()), o)
    rows, counts = word_features(words.to_pylist(), o)
    firsts = np.cumsum(counts) - counts
    table = random.uniform(-1 / o.dimensions, 1 / o.dimensions, (o.buckets, o.dimensions)).astype(np.float32)
    weights = np.zeros((len(names), o.dimensions), np.float32)
    bias = np.zeros(len(names), np.float32)
    order = random.permutation(len(texts))
    kept = max(1, int(len(texts) * o.calibration))
    held, order = order[:kept], order[kept:] if len(order) > kept else order
    epochs = max(2, o.visits // len(order))
    steps, step = epochs * -(-len(order) // o.batch), 0
    for _ in range(epochs):
        random.shuffle(order)
        for b in range(0, len(order), o.batch):
            docs = order[b : b + o.batch]
            rate = o.rate * (1 - step / steps)
            step += 1
            n = (starts[docs + 1] - starts[docs]).astype(np.int64)
            at = np.repeat(starts[docs] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            terms, of = np.unique(codes[at], return_inverse=True)
            if not len(terms):
                continue
            doc = np.repeat(np.arange(len(docs)), n)
            share = np.zeros((len(docs), len(terms)), np.float32)
            np.add.at(share, (doc, of), 1.0)
            size = counts[terms]
            share /= np.maximum(share @ size.astype(np.float32), 1)[:, None]
            spans = np.repeat(firsts[terms] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            features = rows[spans]
            vectors = np.add.reduceat(table[features], np.cumsum(size) - size, axis=0)
            mean = share @ vectors
            error = softmax(mean @ weights.T + bias)
            error[np.arange(len(docs)), target[docs]] -= 1
            error /= len(docs)
            back = share.T @ (error @ weights)
            weights -= rate * (error.T @ mean)
            bias -= 0.1 * rate * error.sum(axis=0)
            change = np.repeat(back, size, axis=0) * (rate * len(docs))
            by = np.argsort(features, kind="stable")
            groups = features[by]
            heads = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
            table[groups[heads]] -= np.add.reduceat(change[by], heads, axis=0)
    model = SubwordModel(table @ weights.T, bias.astype(np.float64), names, o)
    return _calibrated(model, [texts[k] for k in held], target[held])


def _calibrated(model: SubwordModel, texts: list[str], target: np.ndarray) -> SubwordModel:
    """Temperature of least log loss on texts kept from training, and 0.8 times the confidence that 998 in 1000 of the
    rightly labelled ones reach: below it a prediction is rejected."""
    logits = document_logits(model, pa.array(texts, pa.large_string()))
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.05, 20, 61):
        p = softmax(logits / t)[np.arange(len(target)), target]
        loss = -np.log(np.maximum(p, 1e-12)).mean() + 1e-4 * np.log(t) ** 2
        if loss < best:
            best, temperature = loss, float(t)
    chosen = softmax(logits / temperature)
    right = chosen.argmax(axis=1) == target
    confidence = np.sort(chosen.max(axis=1)[right])
    floor = 1 / len(model.labels)
    threshold = float(confidence[int(len(confidence) * 0.002)]) * 0.8 if len(confidence) else floor
    return SubwordModel(model.logits, model.bias, model.labels, model.options, temperature, max(threshold, floor))


def bounded_sample(documents: DataFrame, labels: DataFrame, o: SubwordOptions) -> tuple[list[str], list[str]]:
    """Texts and labels of at most `sample` labelled documents and `sample_chars` characters, by hashes of doc_id.

    `labels` has doc_id and label. Null labels and texts do not count, and equal texts with equal labels count once, before
    the sample is drawn. Half of the places are dealt to the labels in equal parts (at least one, at most 1,000 each), so
    that a rare label is learned at every size; the others go by hash alone, so that frequent labels keep their shares. Texts
    of more than a 256th of the characters come after all others, the shorter ones first; a text that no longer fits is
    passed over. Ids, sizes and hashes meet by doc_id and are written to the shared folder; of the texts only the chosen
    ones move.
    """
    spark = documents.sparkSession
    wanted = labels.select("doc_id", F.col("label").cast("string").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    rows = documents.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = rows.select(F.xxhash64("doc_id").alias("place"), F.xxhash64("text").alias("hash"), "doc_id", "text")
    size = F.length("text").cast("long")
    sizes = rows.select("doc_id", "place", "hash", F.when(size > o.sample_chars // 256, size).otherwise(0).alias("late"), size.alias("size"))
    met = sizes.distinct().join(wanted.distinct(), "doc_id").groupBy("hash", "label")
    keys = written(
        met.agg(F.min("late").alias("late"), F.min("place").alias("place"), F.min("size").alias("size")),
        shared_folder(spark, "sample-keys"),
    )
    order = ["late", "place", "hash", "label"]
    names = keys.select("label").distinct().limit(o.sample).count()
    each = max(1, min(o.sample // max(2 * names, 1), 1000))  # Spark cuts ranks up to 1,000 before the shuffle
    ranked = keys.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(*order))).filter(F.col("rank") <= each)
    first = ranked.orderBy("rank", *order).limit(o.sample).drop("rank").collect()
    left, taken = o.sample_chars, {}
    for r in [*first, *keys.orderBy(*order).limit(o.sample).collect()]:
        key = (r["place"], r["hash"], r["label"])
        if key not in taken and len(taken) < o.sample and r["size"] <= left:
            left -= r["size"]
            taken[key] = True
    if not taken:
        return [], []
    chosen = spark.createDataFrame(list(taken), "place long, hash long, label string")
    found = rows.join(F.broadcast(chosen), ["place", "hash"]).groupBy("place", "hash", "label").agg(F.min("text").alias("text"))
    fetched = found.orderBy("place", "text", "label").collect()
    return [r["text"] for r in fetched], [r["label"] for r in fetched]


def scored(text: Column, model: SubwordModel, spark: SparkSession) -> Column:
    """Struct of label, score, scores and wordless from a whole text: likeliest label, its probability, all of them.

    A null text is empty; a text without words is scored by the bias alone. Ties go to the first label. Without any
    label learned, label is null and score 0.
    """
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<label: string, score: double, scores: array<double>, wordless: boolean>")
    def score(texts: pa.Array) -> pa.Array:
        m = shipped.value
        found = [softmax(document_logits(m, piece) / m.temperature) for piece in sliced(texts, 1 << 20)] if m.labels else []
        p = np.concatenate(found) if found else np.zeros((len(texts), len(m.labels)))
        n, k = p.shape
        best = p.argmax(axis=1) if k else np.zeros(n, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(p.ravel(), pa.float64()))
        columns = [
            pa.array([m.labels[b] for b in best] if k else [None] * n, pa.string()),
            pa.array(p[np.arange(n), best] if k else np.zeros(n), pa.float64()),
            lists,
            pc.equal(pc.ascii_trim_whitespace(pc.fill_null(texts, "")), ""),
        ]
        return pa.StructArray.from_arrays(columns, names=["label", "score", "scores", "wordless"])

    return score(text)
