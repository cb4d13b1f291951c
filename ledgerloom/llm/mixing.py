"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, content_order, or_empty, running_sums, with_bins

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Demand at the start and at the end of training for sources of each of those weights; each pair has mean 1. Heavy
#: sources fade, light ones rise.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: The mix takes so many times all words, and of no source more than so many times its words.
BUDGET, MOST = 1.5, 2.0


def _turn(rank: Column, values: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(_group, source, source_size) with target, start, end: a row for each source.

    Sharing by weight, stopping sources at their most and resharing the excess ends at one water level: sources sorted
    by most/weight stop as long as the level of what is left reaches them. There is one row for each source here, never
    one for each document.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("_w", _turn(F.col("_rank"), weights)).withColumn("_most", F.col("source_size") * F.lit(float(most)))
    up = W.orderBy(F.col("_most") / F.col("_w"), "_rank")
    every = up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("_most").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = ranked.withColumn("_level", left / F.sum("_w").over(up.rowsBetween(0, W.unboundedFollowing)))
    open_ = F.col("_level") * F.col("_w") < F.col("_most")
    level = level.withColumn("_open", open_).withColumn("_final", F.max(F.when(open_, F.col("_level"))).over(every))
    return level.select(
        "_group", "source", "source_size", F.when(F.col("_open"), F.col("_final") * F.col("_w")).otherwise(F.col("_most")).alias("target"),
        _turn(F.col("_rank"), [s for s, _ in schedules]).alias("start"), _turn(F.col("_rank"), [e for _, e in schedules]).alias("end"),
    )


def when_demanded(share: Column, start: Column, end: Column) -> Column:
    """The time in 0..1 by which a source's integrated schedule has demanded this share: the inverse of start * t + (end - start) * t * t / 2."""
    slope = end - start
    curved = (F.sqrt(F.greatest(start * start + F.lit(2.0) * slope * share, F.lit(0.0))) - start) / F.nullif(slope, F.lit(0.0))
    return F.least(F.greatest(F.when(slope == 0.0, share).otherwise(curved), F.lit(0.0)), F.lit(1.0)) + F.lit(0.0)


def mix(docs: DataFrame, keep: tuple[str, ...] = (), weights=WEIGHTS, schedules=SCHEDULES, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """What the mix takes of each document and when.

    Returns doc_id, source, size, source_size, target, taken, position, again and the columns of keep. Documents of a
    source stand in an order that their content decides. The source's demand runs through them once and, where the
    target exceeds the source, a second time; the document at which it ends is taken in part. position and again are
    the training times (0 to 1) at which the first and the second reading start: running demand, inverted through the
    source's integrated schedule. A null text has size 0 and is never taken; a null source is a source; repeated rows
    count each; an empty table gives no rows; very long texts are counted whole, by one expression in the JVM; other
    columns are ignored but for those of keep, whose names must not be those of the result.
    """
    text = or_empty("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *[c for c in keep if c not in ("doc_id", "source")],
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), content_order(F.col("doc_id"), text).alias("_order"),
    )
    rows = rows.withColumn("_group", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))  # a null source is a group too
    if not keep:  # sizes are counted once; all that follows reads this narrow table
        rows = Scratch(docs.sparkSession, "mixing").save(rows, "sizes")
    aims = targets(rows.groupBy("_group", "source").agg(F.sum("size").alias("source_size")), weights, schedules, budget, most).drop("source")
    rows = running_sums(with_bins(rows, "_order"), ["_group"], ["_order", "doc_id", "size"], {"_first": "size"}, of_group=aims)
    goal, second = F.floor(F.col("target") + F.lit(0.5)), F.col("_first") + F.col("source_size")
    part = lambda at: F.greatest(F.lit(0), F.least(at + F.col("size"), goal) - at).cast("long")
    time = lambda at: when_demanded(at / F.col("target"), F.col("start"), F.col("end"))
    rows = rows.withColumn("taken", part(F.col("_first")) + part(second))
    rows = rows.withColumn("position", F.when(part(F.col("_first")) > 0, time(F.col("_first"))))
    rows = rows.withColumn("again", F.when(part(second) > 0, time(second)))
    return rows.drop("_group", "_first", "_order", "start", "end")


def _first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    cut = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(cut, 1, n.cast("int")), "")


def readings(docs: DataFrame) -> DataFrame:
    """The documents as training reads them, in that order, with the columns of docs.

    A document that is read twice has two rows. One that is taken in part has its first words; n_chars, if there is such
    a column, is then counted anew. Documents that the mix doesn't take have no row.
    """
    rows = mix(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row")), keep=("text", "_row"))
    first = F.least("taken", "size")
    read = lambda n, at: F.when(n > 0, F.struct(n.alias("n"), at.alias("at")))
    rows = rows.withColumn("_read", F.explode(F.array_compact(F.array(read(first, F.col("position")), read(F.col("taken") - first, F.col("again"))))))
    whole = F.col("_read.n") >= F.col("size")
    fresh = {"text": F.when(whole, F.col("_row.text")).otherwise(_first_words(F.col("text").cast("string"), F.col("_read.n")))}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(whole, F.col("_row.n_chars")).otherwise(F.length(fresh["text"]))
    rows = rows.orderBy("_read.at", "doc_id")
    return rows.select(*[fresh[c].cast(docs.schema[c].dataType).alias(c) if c in fresh else F.col("_row")[c].alias(c) for c in docs.columns])


def mixed(docs: DataFrame) -> DataFrame:
    """The mix's plan, range-sorted by position: documents that are not taken come last."""
    out = mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position", "again")
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")
