"""Operators on report texts, listings, models and class vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerloom.functions import numbers as N
from ledgerloom.functions import text as X


def _metadata(text: str):
    both = lambda t: F.struct(X.security_code(t).alias("ticker"), X.report_date(t).alias("report_date_str"))
    return F.array(X.let(X.squeeze_digits(F.col(text)), both))


def _with(docs: DataFrame, found) -> DataFrame:
    """docs with the fields of each struct found: a generator's argument is evaluated once a row, however many fields it has."""
    kept = [c for c in docs.columns if c not in ("ticker", "report_date_str")]
    return docs.select(*kept, F.inline(found))


def extract_metadata(docs: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds ticker and report_date_str, from the raw text without white space between digits; null where missing."""
    return _with(docs, _metadata(text))


def found_metadata(docs: DataFrame, text: str = "raw_text") -> DataFrame:
    """As extract_metadata(), but only rows with both a ticker and a date."""
    return _with(docs, F.filter(_metadata(text), lambda m: ~X.missing(m["ticker"]) & ~X.missing(m["report_date_str"])))


def assemble_pages(pages: DataFrame, key: str, order: str, text: str, *more: Column) -> DataFrame:
    """One text for each document, its pages in order, and more aggregates of its pages."""
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return pages.groupBy(key).agg(X.join_pages(F.transform(own, lambda p: p["t"])).alias("raw_text"), *more)


def dedup_titles(rows: DataFrame, title: str, order: list[str], value: str) -> DataFrame:
    """For each title the last row, as files that overwrite each other leave it, and how many were written."""
    return rows.groupBy(title).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("n_written"))


def latest_model(registry: DataFrame) -> DataFrame:
    """The path of the folder changed last, in one row; an error if there is none."""
    best = registry.where("is_dir").agg(F.max_by("path", "modified_at").alias("path"), F.max("modified_at").alias("modified_at"))
    return best.withColumn("path", F.coalesce("path", F.raise_error(F.lit("no trained model")).cast("string")))


def predictions(rows: DataFrame, logits: str = "logits") -> DataFrame:
    """Adds pred_class, pred_label and confidence (0 to 100) from logits."""
    rows = rows.withColumn("_p", N.softmax(F.col(logits))).withColumn("pred_class", N.arg_max(F.col("_p")))
    rows = rows.withColumn("confidence", F.array_max("_p") * 100)
    return rows.withColumn("pred_label", N.class_text(F.col("pred_class"))).drop("_p")


def result_panel(rows: DataFrame) -> DataFrame:
    """Adds what a result view shows: panel (success or error), shown confidence, progress."""
    calm = F.contains("pred_label", F.lit(N.HOLD_MARK))
    return rows.withColumn("panel", F.when(calm, "success").otherwise("error")).withColumn("shown", F.format_string("%.1f", "confidence")).withColumn("progress", N.progress(F.col("confidence")))


def balanced(rows: DataFrame, label: str, key: str) -> DataFrame:
    """As many rows of each class as the rarest has, the first by a numeric key; one lazy plan.

    Ranges of the key are filled class by class from their counts; only in the range where a class runs full are its
    rows ranked, so no task ranks a whole class.
    """
    least = F.coalesce(rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("n")).scalar(), F.lit(0))
    rows = _in_ranges(rows, key)
    before = F.coalesce(F.sum("count").over(W.partitionBy(label).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    room = rows.groupBy(label, "_range").count().withColumn("_before", before).withColumn("_least", least)
    room = room.withColumn("_room", F.col("_least") - F.col("_before")).where("_room > 0")
    room = room.select(F.col(label).alias("_class"), F.col("_range").alias("_own"), "_room", (F.col("count") <= F.col("_room")).alias("_all"))
    met = rows.join(room, rows[label].eqNullSafe(F.col("_class")) & (F.col("_range") == F.col("_own")))
    ranked = met.where("NOT _all").withColumn("_rank", F.row_number().over(W.partitionBy("_class", "_own").orderBy(key))).where("_rank <= _room")
    return met.where("_all").unionByName(ranked.drop("_rank")).drop("_class", "_own", "_room", "_all", "_range")


def padded_tokens(docs: DataFrame, text: str, most: int = 128) -> DataFrame:
    """Adds tokens: at most so many words, padded to the longest row; one lazy plan."""
    docs = docs.withColumn("_t", X.tokens(F.col(text), most))
    longest = docs.agg(F.coalesce(F.max(F.size("_t")), F.lit(0)).alias("n"))
    return docs.withColumn("_n", longest.scalar()).withColumn("tokens", X.padded(F.col("_t"), F.col("_n"))).drop("_t", "_n")


#: Ranges of a key, in so many groups of as many each: places in them are found by looking at 2 * GROUPS cuts a row.
GROUPS = 64


def _in_ranges(rows: DataFrame, key: str) -> DataFrame:
    """Adds _range, 0 to GROUPS * GROUPS: which of the approximate quantiles of a numeric key a row lies between.

    The quantiles are part of the plan, and their number doesn't bound the rows: 1e11 of them are 2.4e7 in a range.
    """
    n = GROUPS * GROUPS
    told = rows.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 8 * n).alias("q"))
    every = F.array_distinct(F.coalesce("q", F.array().cast(f"array<{dict(rows.dtypes)[key]}>")))
    told = told.select(F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda k: F.slice(every, k * GROUPS + 1, GROUPS)).alias("c"))
    rows = rows.withColumn("_cuts", told.scalar())
    under = lambda cuts, at: F.size(F.filter(cuts, at))
    group = under(F.filter("_cuts", lambda g: F.size(g) > 0), lambda g: F.element_at(g, -1) < F.col(key))
    rows = rows.withColumn("_group", F.greatest(group, F.lit(0)))
    own = F.coalesce(F.get("_cuts", F.col("_group")), F.array().cast(f"array<{dict(rows.dtypes)[key]}>"))
    return rows.withColumn("_range", F.col("_group") * GROUPS + F.greatest(under(own, lambda c: c < F.col(key)), F.lit(0))).drop("_cuts", "_group")


def ordinals(rows: DataFrame, key: str, out: str = "ordinal") -> DataFrame:
    """Adds each row's place from 1 in the order of a numeric key; one lazy plan.

    Rows are ranked inside ranges of the key, between approximate quantiles, and a range starts behind the counts of
    those before it; no task ranks all rows.
    """
    rows = _in_ranges(rows, key)
    counts = rows.groupBy("_range").agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(GROUPS * GROUPS + 1).select(F.col("id").cast("int").alias("_range")).join(counts, "_range", "left")
    sorted_ = every.agg(F.sort_array(F.collect_list(F.struct("_range", F.coalesce("n", F.lit(0)).alias("n")))).alias("c"))
    none = F.array(F.lit(0).cast("long"))
    starts = sorted_.select(F.aggregate("c", none, lambda sums, r: F.concat(sums, F.array(F.element_at(sums, -1) + r["n"]))).alias("s"))
    rank = F.row_number().over(W.partitionBy("_range").orderBy(key))
    return rows.withColumn("_rank", rank).withColumn("_starts", starts.scalar()).withColumn(out, (F.col("_rank") + F.get("_starts", F.col("_range"))).cast("bigint")).drop("_range", "_rank", "_starts")
