"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Each source's documents, in a fixed shuffled order, form a stream of words that repeats; it is cut
into blocks of equally many words. Slot n of the mix takes the golden-ratio point frac(n * g), finds
its source through the cumulative targets and receives that source's next block. A source leaves
the schedule when its target is used up, so that each source contributes its target to the word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforo.llm.common import ROWS_PER_BUCKET, bits_for, running_sum, word_count
from aforo.sources.scratch import stored

# Weights of the sources in order, repeating, and how often a source may be used up.
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
#: Words in a block.
BLOCK_WORDS = 512

GOLDEN = 0.6180339887498949
#: Slots beyond those needed, for sources that the points have not reached often enough yet.
SLACK_SLOTS = 16
SLOTS_PER_BUCKET_BITS = 16


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per source: ``source``, ``_rank``, ``source_size``, ``weight``, ``target``, ``_quota``.

    Sources rank by code point, NULL last, and weigh ``weights`` in turn. Targets share all words
    by weight; those above ``most`` times their source stop there and the rest is shared anew. That
    fixed point is found in one go: sources stop in the order of size over weight, so it takes running
    sums over the sources, whose rows are few beside the documents.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_rank", rank.cast("long")).withColumn("weight", weight)
    # Left to share when all sources that stop earlier have stopped.
    order = (F.col("source_size") / F.col("weight"), F.col("_rank"))
    here_on = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy())
    left = ranked.withColumns(
        {
            "_words": total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "_weights": F.sum("weight").over(here_on),
        }
    )
    full = F.col("source_size") * most < F.col("_words") * F.col("weight") / F.col("_weights")
    # The first source that need not stop fixes the share of all from there on.
    first = F.min(F.when(~F.col("_full"), F.struct(*order, "_words", "_weights"))).over(Window.partitionBy())
    settled = left.withColumn("_full", full).withColumn("_first", first)
    share = F.col("_first._words") * F.col("weight") / F.col("_first._weights")
    ceiling = (F.col("source_size") * most).cast("double")
    target = F.when(F.col("_full") | F.col("_first").isNull(), ceiling).otherwise(share)
    quota = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * most)
    return settled.withColumn("target", target).select(
        "source", "_rank", "source_size", "weight", "target", quota.cast("long").alias("_quota")
    )


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix's slots: ``slot``, ``_rank``, ``_block`` (rank of the slot within its source).

    ``sources`` is a small stored table. Points are matched with their source through a grid over
    [0, 1): an equality on the cell, then a range test among the one or two sources of the cell.
    """
    spark = sources.sparkSession
    need = F.ceil(F.col("_quota") / block_words)
    used = sources.filter("_quota > 0").withColumn("_need", need.cast("long"))
    total = used.agg(F.sum("_need"), F.sum("target"), F.count(F.lit(1))).first()
    slots, words, n_sources = (total[0] or 0), (total[1] or 1.0), total[2]
    cells = 4 * max(16, n_sources)
    upto = F.sum("target").over(Window.orderBy("_rank")) / words
    ends = used.withColumn("_high", upto).withColumn("_low", F.col("_high") - F.col("target") / words)
    first, last = (F.least(F.lit(cells - 1), F.floor(F.col(c) * cells)).cast("long") for c in ("_low", "_high"))
    # Neighbours' ends are the same number, so that rounding leaves no gap.
    ends = ends.withColumn("_low", F.coalesce(F.lag("_high").over(Window.orderBy("_rank")), F.lit(0.0)))
    grid = ends.select("_rank", "_need", "_low", "_high", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), last)).alias("_cell"))

    point = F.col("slot") * F.lit(GOLDEN) - F.floor(F.col("slot") * F.lit(GOLDEN))
    points = spark.range(slots + SLACK_SLOTS * min(slots, 4)).select(F.col("id").alias("slot")).withColumn("_x", point)
    points = points.withColumn("_cell", F.least(F.lit(cells - 1), F.floor(F.col("_x") * cells)).cast("long"))
    hit = (F.col("_x") >= F.col("_low")) & (F.col("_x") < F.col("_high"))
    drawn = points.join(grid, "_cell").filter(hit).select("slot", "_rank", "_need")
    drawn = drawn.withColumn("_bucket", F.shiftright("slot", SLOTS_PER_BUCKET_BITS))
    one = F.lit(1).cast("long")
    ranked = running_sum(drawn, ["_rank"], ["_bucket"], [F.col("slot")], one, "_block").filter("_block < _need")
    # Sources that the points reach too rarely get their missing blocks at the end.
    reached = drawn.groupBy("_rank").agg(F.count(one).alias("_reached"))
    missing = (
        used.join(reached, "_rank", "left")
        .withColumn("_reached", F.coalesce("_reached", F.lit(0)))
        .filter("_reached < _need")
        .select("_rank", F.explode(F.sequence(F.col("_reached"), F.col("_need") - 1)).alias("_block"))
        .withColumn("slot", F.lit(2 * slots + 100) + F.col("_block") * n_sources + F.col("_rank"))
    )
    return ranked.select("slot", "_rank", "_block").unionByName(missing)


@dataclass(frozen=True)
class Mix:
    """``documents``: the rows with their place; ``slots``: which words of which document fill each slot."""

    documents: DataFrame
    slots: DataFrame


def mix(
    df: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    scratch: str | None = None,
) -> Mix:
    """Mix the documents of all sources to their targets.

    ``documents`` has the given columns, ``size``, ``source_size``, ``target``, and the place
    ``_rank`` (source), ``_start`` (first word within the source's stream); the pair is unique among
    documents that have words. ``slots`` has ``slot``, ``_rank``, ``_start``, ``epoch``, ``first_word``,
    ``end_word``: slots in ascending order are the mix, and parts of one slot follow ``_start``.

    The shuffle orders a source by the MD5 of the id as text, so runs agree. A NULL text has no words
    and is never taken, a NULL source is a source, a NULL id sorts first; equal rows count each, in an
    order that cannot be told apart. An empty table gives empty results, as does one without words.
    Clashing columns (``size``, ``source_size``, ``target``) are replaced, others carried along.
    """
    taken_names = ("size", "source_size", "target")
    carried = [c for c in df.columns if c not in taken_names]
    shuffled = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    columns = [F.col(f"`{c}`") for c in carried]
    docs = df.select(*columns, word_count(F.col(f"`{text}`")).alias("size"), shuffled.alias("_order"))
    narrow = stored(docs.select(F.col(f"`{source}`").alias("source"), F.col(f"`{key}`").alias("_key"), "size", "_order"), "mix", scratch)
    sources = stored(source_targets(narrow, weights), "mix-sources", scratch)

    bits = bits_for(narrow.count(), rows_per_bucket)
    leading = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")

    def placed(rows: DataFrame, source_column: str) -> DataFrame:
        lookup = sources.select(F.col("source").alias("_source"), "_rank", "source_size", "target", "_quota")
        known = rows.join(lookup, F.col(f"`{source_column}`").eqNullSafe(F.col("_source"))).drop("_source")
        known = known.withColumn("_bucket", F.shiftright(leading, 32 - bits) if bits else F.lit(0).cast("long"))
        order = [F.col("_order"), F.col("size")]
        return running_sum(known, ["_rank"], ["_bucket"], order, F.col("size"), "_start").drop("_bucket")

    streams = placed(narrow, "source").filter("size > 0")
    begin = F.col("epoch") * F.col("source_size") + F.col("_start")
    parts = (
        streams.select("*", F.explode(F.sequence(F.lit(0), F.lit(MOST_EPOCHS - 1))).alias("epoch"))
        .withColumn("_begin", begin)
        .withColumn("_end", F.least(F.col("_begin") + F.col("size"), F.col("_quota")))
        .filter("_begin < _end")
    )
    first, last = (F.floor(c / block_words).cast("long") for c in (F.col("_begin"), F.col("_end") - 1))
    parts = parts.select("_rank", "_start", "epoch", "_begin", "_end", F.explode(F.sequence(first, last)).alias("_block"))
    pieces = parts.select(
        "_rank",
        "_block",
        "_start",
        "epoch",
        (F.greatest("_begin", F.col("_block") * block_words) - F.col("_begin")).alias("first_word"),
        (F.least("_end", (F.col("_block") + 1) * block_words) - F.col("_begin")).alias("end_word"),
    )
    slots = pieces.join(schedule(sources, block_words), ["_rank", "_block"]).drop("_block")
    return Mix(placed(docs, source).drop("_order", "_quota"), slots)


def taken_words(mixed: Mix) -> DataFrame:
    """The documents with ``taken``, the words the mix takes of each, repeats counted."""
    place = ["_rank", "_start"]
    taken = mixed.slots.groupBy(*place).agg(F.sum(F.col("end_word") - F.col("first_word")).alias("_taken"))
    found = mixed.documents.join(taken, place, "left")
    words = F.when(F.col("size") > 0, F.coalesce("_taken", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return found.withColumn("taken", words).drop("_taken", *place)


def mixed_documents(mixed: Mix, text: str = "text") -> DataFrame:
    """One row per document and epoch the mix takes it in, its text cut after the last word taken.

    Adds ``epoch`` and ``slot``, the first slot that holds part of it.
    """
    place = ["_rank", "_start"]
    uses = mixed.slots.groupBy(*place, "epoch").agg(F.max("end_word").alias("_words"), F.min("slot").alias("slot"))
    rows = mixed.documents.filter("size > 0").join(uses, place)
    # Each part ends with a word, so that the first so many parts are the taken words as they stand.
    parts = F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    first_words = F.array_join(F.slice(parts, F.lit(1), F.col("_words").cast("int")), "")
    cut = F.when(F.col("_words") >= F.col("size"), F.col(text)).otherwise(first_words)
    return rows.withColumn(text, cut).drop("_words", "size", "source_size", "target", *place)
