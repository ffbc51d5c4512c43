"""Mixing sources to target weights by hash thresholds: no sort of the rows, DataFrame operations only.

Every row has a place in its source, the leading 60 bits of an md5 of its id and text. A source that may take more words
than it has takes all its rows once or more and then, like any other, the rows whose place is below its threshold.
Thresholds come from histograms: words are summed by source and bucket of places, running sums find the bucket in which
the budget ends, and only the rows of that bucket are cut into finer buckets, until a bucket holds one place. The
thresholds are nested: what a smaller budget takes is part of what a larger one takes.

Edge cases. A null text has no words, as an empty one; rows without words take part and take nothing. A null source is a
source of its own and the last one; a null id counts as an empty one. Rows of the same source, id and text share a place
and are taken alike, so a source comes as near to its target as the words of one place allow (to half of them). An empty
table gives an empty result. Other columns come along where ``carry`` names them, whatever they are called: the operator
keeps its own under new names until the end, and its results replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.arrow_text import shared_folder, written

WORDS = r"[^\x20\x09-\x0D]+"
DIGITS = 15  # hexadecimal digits of a place
BITS = 4 * DIGITS
SALTS = 32  # parts of a source in a join, as one source may hold a third of all rows


@dataclass(frozen=True)
class MixOptions:
    """Weights by rank of the source, repeating; words taken of all words; times a row may be taken; bits of a histogram."""

    weights: tuple[int, ...] = (5, 2, 1)
    percent: int = 150
    most: int = 2
    level_bits: int = 10

    def __post_init__(self):
        if not self.weights or min(self.weights) < 1 or self.most < 1 or not 0 <= self.percent <= 100 * self.most:
            raise ValueError("weights must be positive, and the words asked for no more than the rows can give")
        if not 1 <= self.level_bits <= 16:
            raise ValueError("a histogram has 1 to 16 bits")


def place_of(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the md5 of id and text."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("long")


def measured(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``mix_source, mix_size, mix_place`` of each row and the columns to carry: the texts are read once, here."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select(
        F.struct(*carry).alias("mix_row"),
        F.col("source").alias("mix_source"),
        size.alias("mix_size"),
        place_of(F.col("doc_id"), F.col("text")).alias("mix_place"),
    )


def source_weights(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """The sources with the weight of their rank by code point, null last; their number is not bounded.

    The sources are sorted by ranges and written with their place in their part; a rank is that place and the number of
    sources in the parts before. Only the parts meet in one task.
    """
    ordered = sizes.orderBy(F.col("mix_source").asc_nulls_last()).withColumn("mix_at", F.monotonically_increasing_id())
    ordered = written(ordered, shared_folder(sizes.sparkSession, "mix-sources"))
    part = F.shiftrightunsigned("mix_at", 33)
    earlier = Window.orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ordered.groupBy(part.alias("mix_part")).agg(F.count(F.lit(1)).alias("held"))
    before = before.select("mix_part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("mix_before"))
    rank = F.col("mix_before") + F.col("mix_at").bitwiseAND(F.lit((1 << 33) - 1))
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = ordered.withColumn("mix_part", part).join(before, "mix_part")
    return ranked.select("mix_source", "mix_words", F.get(cycle, F.pmod(rank, F.lit(len(weights))).cast("int")).alias("mix_weight"))


def source_targets(sizes: DataFrame, options: MixOptions) -> DataFrame:
    """``mix_source, mix_words, mix_weight, mix_target``: shares by weight, at most ``most`` times the source's words.

    Sources above their limit get the limit and the others share what is left, again until none is above. Each round is
    one sum over the sources, and a round without a new source above its limit is the last.
    """
    weighted = written(source_weights(sizes, options.weights), shared_folder(sizes.sparkSession, "mix-weights"))
    limit = F.col("mix_words") * options.most
    total = weighted.agg(F.sum("mix_words")).first()[0] or 0
    budget = total * options.percent / 100
    share, full = 0.0, -1
    while True:
        above = F.col("mix_weight") * F.lit(share) > limit
        held, weight, n = weighted.agg(
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("mix_weight"))), F.lit(0)),
            F.count_if(above),
        ).first()
        if n == full or not weight:
            break
        share, full = (budget - held) / weight, n
    return weighted.withColumn("mix_target", F.least(F.col("mix_weight") * F.lit(share), limit.cast("double")))


def _within(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows with their source's columns, in salted parts of the source; the sources' side is joined as its size asks."""
    salt = F.pmod(F.col("mix_place"), F.lit(SALTS)).cast("int")
    salted = cuts.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = salted.withColumnRenamed("mix_source", "mix_of")
    same = F.col("mix_source").eqNullSafe(F.col("mix_of")) & (F.col("mix_here") == F.col("mix_salt"))
    return rows.withColumn("mix_here", salt).join(salted, same).drop("mix_here", "mix_salt", "mix_of")


def thresholds(rows: DataFrame, targets: DataFrame, options: MixOptions) -> DataFrame:
    """``mix_times, mix_below`` for each source: whole turns, and the place below which rows are taken once more."""
    spark = rows.sparkSession
    whole = F.when(F.col("mix_words") > 0, F.floor(F.col("mix_target") / F.col("mix_words"))).otherwise(0).cast("long")
    open_cuts = targets.withColumn("mix_times", whole).withColumn(
        "mix_rest", F.col("mix_target") - F.col("mix_times") * F.col("mix_words")
    )
    # what lies below mix_low is taken; the budget ends inside [mix_low, mix_low + 2^shift)
    start = {"mix_low": F.lit(0).cast("long"), "mix_taken": F.lit(0).cast("long"), "mix_one": F.col("mix_rest") <= 0}
    cuts = open_cuts.withColumns(start)
    shift = BITS
    while shift:
        inside = _within(rows, cuts.filter(~F.col("mix_one")).select("mix_source", "mix_low"))
        if shift < BITS:
            inside = inside.filter(F.shiftright("mix_place", shift) == F.shiftright("mix_low", shift))
        shift = max(shift - options.level_bits, 0)
        bucket = F.shiftright("mix_place", shift)
        histogram = inside.groupBy("mix_source", bucket.alias("mix_bucket")).agg(
            F.sum("mix_size").alias("held"),
            F.min("mix_place").alias("least"),
            F.max("mix_place").alias("largest"),
        )
        running = Window.partitionBy("mix_source").orderBy("mix_bucket")
        steps = histogram.withColumn("upto", F.sum("held").over(running))
        steps = steps.withColumnRenamed("mix_source", "mix_of").join(
            cuts.select("mix_source", "mix_rest", "mix_taken"), F.col("mix_of").eqNullSafe(F.col("mix_source"))
        )
        over = F.col("mix_taken") + F.col("upto") > F.col("mix_rest")
        first = F.min_by(
            F.struct(
                F.shiftleft("mix_bucket", shift).alias("low"),
                (F.col("upto") - F.col("held")).alias("before"),
                (F.col("least") == F.col("largest")).alias("one"),
                "held",
                "least",
            ),
            F.when(over, F.col("mix_bucket")),
        )
        found = steps.filter(over).groupBy("mix_of").agg(first.alias("cut"))
        joined = cuts.join(found, F.col("mix_of").eqNullSafe(F.col("mix_source")), "left")
        taken = F.col("mix_taken") + F.col("cut.before")
        # one place is left: it is taken if that comes nearer to the budget
        nearer = (taken + F.col("cut.held") - F.col("mix_rest")) < (F.col("mix_rest") - taken)
        low = F.when(F.col("cut.one"), F.col("cut.least") + F.when(nearer, 1).otherwise(0)).otherwise(F.col("cut.low"))
        none = F.col("cut").isNull()  # the cut stands already, or the budget is not reached: all rows are below
        everything = F.lit(1 << BITS)
        cuts = written(
            joined.select(
                *[c for c in cuts.columns if c not in ("mix_low", "mix_taken", "mix_one")],
                F.when(none, F.when(F.col("mix_one"), F.col("mix_low")).otherwise(everything)).otherwise(low).alias("mix_low"),
                F.when(none, F.col("mix_taken")).otherwise(taken).alias("mix_taken"),
                (none | F.col("cut.one")).alias("mix_one"),
            ),
            shared_folder(spark, "mix-cuts"),
        )
        if cuts.filter(~F.col("mix_one")).isEmpty():
            break
    return cuts.select("mix_source", "mix_words", "mix_target", "mix_times", F.col("mix_low").alias("mix_below"))


def mix_documents(docs: DataFrame, options: MixOptions = MixOptions(), carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns of each row with ``size, source_size, target, taken`` and ``times`` (how often it is taken)."""
    rows = written(measured(docs, carry), shared_folder(docs.sparkSession, "mix-rows"))
    sizes = rows.groupBy("mix_source").agg(F.sum("mix_size").alias("mix_words"))
    cuts = thresholds(rows, source_targets(sizes, options), options)
    times = F.col("mix_times") + F.when(F.col("mix_place") < F.col("mix_below"), 1).otherwise(0)
    new = {
        "size": F.col("mix_size"),
        "source_size": F.col("mix_words"),
        "target": F.col("mix_target"),
        "taken": F.col("mix_size") * times,
        "times": times,
    }
    kept = [c for c in carry if c.lower() not in new]
    return _within(rows, cuts).select(*[F.col(f"mix_row.`{c}`").alias(c) for c in kept], *[v.alias(k) for k, v in new.items()])
