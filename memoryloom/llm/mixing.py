"""Mixing sources to target weights along a low-discrepancy schedule.

The mix is a row of slots of equally many words. Slot k has the golden-ratio point frac(k * 0.618...); cumulative target
shares map points to sources, so that every stretch of the schedule holds the sources in about their shares. The slots of
a source are ranked, its documents shuffled and laid end to end, twice, and cut into blocks of a slot's words; the slot of
rank j takes block j. Running sums are taken in two steps, within buckets and over the buckets' totals, so that no window
holds a source.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import drop, stage

#: The weights that sources have in turn, the mix's words over all words, and how often a document is taken at most.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Slots of a mix, whatever its size: more make it follow the targets more closely.
SLOTS = 1 << 18
ROWS_PER_BUCKET = 20_000
#: The golden ratio's fraction, in units of 10**-18.
GOLDEN, UNIT = Decimal(618033988749894848), Decimal(10) ** 18
_COPIES = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def before(df: DataFrame, keys: list[str], bucket: str, order: list[str], amount: Column, name: str) -> DataFrame:
    """df with the sum of amount over the rows of equal keys that come before by (bucket, *order). Windows hold the rows of
    a bucket, or the totals of a key's buckets."""
    totals = df.groupBy(*keys, bucket).agg(F.sum(amount).alias("_total"))
    over = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, bucket, F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(offsets, [*keys, bucket]).withColumn(name, F.col("_offset") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("_offset")


def targets(sources: DataFrame, words: int, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """sources (source, source_size) with number (by code point, null last, from 0), target and the share of the mix that
    lies before it (low) and up to its end (high).

    Targets share words by weight, but stop at passes times the source's size; what is over is shared by weight among the
    others until none is above: targets are the least of that bound and level * weight, where the level is the one at
    which they add up to words. One row a source is all that the windows here hold.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    placed = sources.withColumn("number", F.row_number().over(every) - 1).withColumns({"_weight": weight, "_most": F.col("source_size") * passes})
    full = Window.orderBy(F.col("_most") / F.col("_weight"), "number")  # the order in which sources reach their bounds
    rising = placed.withColumn("_level", (F.lit(float(words)) - F.coalesce(F.sum("_most").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("_weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
    open_ = F.when(F.col("_level") * F.col("_weight") <= F.col("_most"), F.struct(F.col("_most") / F.col("_weight"), F.col("number"), F.col("_level").alias("level")))
    whole = Window.partitionBy()
    level = F.min(open_).over(whole)["level"]
    target = F.when(level.isNotNull(), F.least(F.col("_most").cast("double"), level * F.col("_weight"))).otherwise(F.col("_most").cast("double"))
    aimed = rising.withColumn("target", target)
    high = F.coalesce(F.try_divide(F.sum("target").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)), F.sum("target").over(whole)), F.lit(0.0))
    last = F.lead("number").over(Window.orderBy("number")).isNull()
    shares = aimed.withColumn("high", F.when(last, 1.0).otherwise(high))
    return shares.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("number")), F.lit(0.0))).select("source", "source_size", "number", "target", "low", "high")


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(slot, number, rank): the source of every slot, by its point, and the slot's rank among the source's.

    Points and sources meet in equal cells of [0, 1), as many as there are sources.
    """
    spark = sources.sparkSession
    cells = max(1, sources.count())
    ends = F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))
    spread = sources.filter("low < high").select("number", "low", "high", F.explode(ends).alias("_cell"))
    point = F.pmod(F.col("id").cast("decimal(19,0)") * F.lit(GOLDEN), F.lit(UNIT)).cast("double") / F.lit(float(UNIT))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("_point")).withColumn("_cell", F.floor(F.col("_point") * cells))
    met = points.join(spread, "_cell").filter("low <= _point and _point < high").select("slot", "number", F.floor(F.col("slot") / ROWS_PER_BUCKET).alias("_bucket"))
    return before(met, ["number"], "_bucket", ["slot"], F.lit(1), "rank").select("slot", "number", "rank")


class Mix:
    """A mix of documents: its sources with their targets, its runs of documents, and the pieces that its slots take.

    runs: (number, doc_id, size, copies, start), copies being rows that repeat all three, laid end to end; start is their
    place in the source's shuffled words. pieces: (slot, number, doc_id, size, copy, first_word, words), what a slot takes
    of a document. words_a_slot and slots are the schedule's measures.
    """

    def __init__(self, documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, slots: int = SLOTS, seed: int = 42) -> None:
        thin = stage(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
        found = stage(thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")), "mix-totals")
        total = found.agg(F.sum("source_size").alias("words"), F.sum("_rows").alias("rows")).first()
        words = total["words"] or 0
        self.sources = stage(targets(found.drop("_rows"), share * words, weights, passes), "mix-targets")
        self.words_a_slot = max(1, -(-int(share * words) // slots))
        self.slots = -(-int(share * words) // self.words_a_slot)
        drop(found)
        # rows with equal hashes repeat doc_id and size: they are laid down as one run
        joined = thin.join(self.sources.select("source", "number"), thin["source"].eqNullSafe(self.sources["source"])).select("number", "doc_id", "size")
        runs = joined.groupBy("number", "doc_id", "size").agg(F.count("*").alias("copies"))
        buckets = max(1, -(-(total["rows"] or 0) // ROWS_PER_BUCKET))
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"))
        mixed = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
        runs = stage(runs.withColumn("_place", mixed).withColumn("_bucket", F.floor(F.col("_place") * buckets).cast("int")), "mix-runs")
        placed = before(runs, ["number"], "_bucket", ["_place", "doc_id", "size"], F.col("copies") * F.col("size"), "start")
        self.runs = stage(placed.drop("_place", "_bucket"), "mix-places")
        drop(runs, thin)
        self.passes = passes
        self.pieces = self._pieces()

    def _pieces(self) -> DataFrame:
        """Blocks of the sources' words joined with the slots of the same rank."""
        step, sizes = self.words_a_slot, self.sources.select("number", "source_size")
        laid = self.runs.filter("size > 0").join(sizes, "number").withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(self.passes - 1))))
        laid = laid.withColumn("_from", F.col("start") + F.col("_pass") * F.col("source_size")).withColumn("_to", F.col("_from") + F.col("copies") * F.col("size"))
        cut = laid.withColumn("rank", F.explode(F.sequence(F.floor(F.col("_from") / step), F.floor((F.col("_to") - 1) / step))))
        taken = cut.join(schedule(self.sources, self.slots), ["number", "rank"])
        a, b = F.greatest("_from", F.col("rank") * step) - F.col("_from"), F.least("_to", (F.col("rank") + 1) * step) - F.col("_from")
        taken = taken.select("slot", "number", "doc_id", "size", a.alias("_a"), b.alias("_b"))
        taken = taken.withColumn("copy", F.explode(F.sequence(F.floor(F.col("_a") / F.col("size")), F.floor((F.col("_b") - 1) / F.col("size")))))
        first = F.greatest(F.col("_a") - F.col("copy") * F.col("size"), F.lit(0))
        return taken.select("slot", "number", "doc_id", "size", "copy", first.alias("first_word"), (F.least(F.col("_b") - F.col("copy") * F.col("size"), "size") - first).alias("words"))

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) of every document: the words that the mix takes of it in all."""
        many = self.runs.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / _COPIES))))
        copies = many.withColumn("copy", F.explode(F.sequence(F.col("_part") * _COPIES, F.least(F.col("copies"), (F.col("_part") + 1) * _COPIES) - 1)))
        rows = copies.select("number", "doc_id", "size", "copy", F.lit(0).cast("long").alias("words")).union(self.pieces.select("number", "doc_id", "size", "copy", "words"))
        found = rows.groupBy("number", "doc_id", "size", "copy").agg(F.sum("words").alias("taken"))
        return found.join(self.sources, "number").select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, slots: int = SLOTS, seed: int = 42) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document of a mix (see Mix) of share times all words, in which
    sources weigh weights in turn.

    size counts words (runs without space and control-character breaks); a null text has none. Rows without source are one
    source, the last; rows without doc_id and repeated rows take part like any others; rows that repeat doc_id, source and
    size are copies, told apart by number alone. A document is taken at most passes times: a source's blocks end there,
    whatever slots it has. Sources and documents without words have target and taken 0; an empty table gives an empty
    result; other columns aren't read. The order within a source is by hash of seed, so that reruns agree.

    Taken words differ from a target by a few slots' words, a slot having 1/slots of the mix. To the driver go two totals.
    """
    return Mix(documents, weights, share, passes, slots, seed).taken()
