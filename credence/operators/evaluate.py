"""Evaluation over labelled rows.

Everything here is an aggregation: per-row flags are narrow columns, metrics
are one global aggregate (partial per task, one tiny final merge), and the
per-label summaries are ``groupBy`` on a 3-valued key with map-side combine.
The exact median never sorts the values: rounds of exact counts around a
sketch's cuts narrow the part that holds the middle.  Numbering deals the rows
into as many ranges as their number asks for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.operators.features import ALL_FEATURES
from credence.params import CONFIDENCE_THRESHOLD
from credence.session import stored

LABELS = ("REAL", "FAKE", "UNCERTAIN")


def detail_flags(df: DataFrame, true_col: str = "true_label", pred_col: str = "predicted_label") -> DataFrame:
    """V2/V3: correctness and confusion flags (positive class FAKE; all
    false when either side is UNCERTAIN)."""
    t, p = F.col(true_col), F.col(pred_col)
    binary = (t != "UNCERTAIN") & (p != "UNCERTAIN")
    return df.select(
        "*",
        (p == t).alias("is_correct"),
        (binary & (t == "FAKE") & (p == "FAKE")).alias("true_positive"),
        (binary & (t == "REAL") & (p == "FAKE")).alias("false_positive"),
        (binary & (t == "REAL") & (p == "REAL")).alias("true_negative"),
        (binary & (t == "FAKE") & (p == "REAL")).alias("false_negative"),
    )


def eval_details(explained: DataFrame, key: str = "doc_id", label_col: str = "label") -> DataFrame:
    """V1: one evaluation row per labelled, analysed row (error rows keep
    their ``error``)."""
    base = explained.select(
        F.col(key), F.col("title"), F.col(label_col).alias("true_label"),
        F.col("prediction").alias("predicted_label"), F.col("confidence"), F.col("credibility_score"),
        F.lit(len(ALL_FEATURES)).alias("feature_count"),
        F.size("positive_factors").alias("positive_factors"),
        F.size("negative_factors").alias("negative_factors"),
        F.when(F.col("prediction") == "ERROR", F.lit("prediction failed")).alias("error"),
    )
    return detail_flags(base)


def _count_true(c: Column) -> Column:
    return F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0))).cast("long")


def metrics(details: DataFrame) -> DataFrame:
    """V4-V7, V9: one row of counts and rates over rows without error."""
    valid = details.where(F.col("error").isNull())
    binary = (F.col("true_label") != "UNCERTAIN") & (F.col("predicted_label") != "UNCERTAIN")
    agg = valid.agg(
        F.count(F.lit(1)).alias("valid_samples"),
        _count_true(F.col("is_correct")).alias("correct"),
        _count_true(binary).alias("binary_samples"),
        _count_true(F.col("true_positive")).alias("true_positives"),
        _count_true(F.col("false_positive")).alias("false_positives"),
        _count_true(F.col("true_negative")).alias("true_negatives"),
        _count_true(F.col("false_negative")).alias("false_negatives"),
        F.avg("confidence").alias("avg_confidence"),
    )

    def div(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, fp, tn, fn = (F.col(c) for c in ("true_positives", "false_positives", "true_negatives", "false_negatives"))
    s = agg.select(
        "*",
        div(F.col("correct"), F.col("valid_samples")).alias("overall_accuracy"),
        F.when(F.col("binary_samples") > 0, div(tp + tn, F.col("binary_samples"))).otherwise(F.lit(0.0))
         .alias("binary_accuracy"),
        div(tp, tp + fp).alias("precision"),
        div(tp, tp + fn).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return s.select(
        F.col("valid_samples").alias("total_samples"), "valid_samples", "binary_samples",
        "overall_accuracy", "binary_accuracy", "precision", "recall",
        F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1_score"),
        "true_positives", "false_positives", "true_negatives", "false_negatives",
        F.coalesce(F.col("avg_confidence"), F.lit(0.0)).alias("avg_confidence"),
        F.lit(CONFIDENCE_THRESHOLD).alias("confidence_threshold"),
    )


def confusion(details: DataFrame) -> DataFrame:
    """V5: the confusion counts of the binary subset."""
    return metrics(details).select("true_positives", "false_positives", "true_negatives", "false_negatives",
                                   "binary_samples")


def prediction_distribution(details: DataFrame, pred_col: str = "predicted_label") -> DataFrame:
    """Count and share of REAL, FAKE and UNCERTAIN (zeros kept).

    One global aggregate with a conditional count per label, then ``stack``
    turns the single row into three; no join and no shuffle of rows.
    """
    valid = details.where(F.col("error").isNull()) if "error" in details.columns else details
    p = F.col(pred_col)
    agg = valid.agg(F.count(F.lit(1)).alias("_total"),
                    *[_count_true(p == lab).alias(f"_n{i}") for i, lab in enumerate(LABELS)])
    stacked = agg.select(
        "_total",
        F.expr("stack(3, " + ", ".join(f"'{lab}', _n{i}" for i, lab in enumerate(LABELS)) + ") AS (label, n)"))
    return stacked.select(
        "label", "n",
        F.when(F.col("_total") > 0, F.col("n") * 100.0 / F.col("_total")).otherwise(F.lit(0.0)).alias("percentage"))


def evaluation_record(details: DataFrame, times: DataFrame, time_col: str = "value") -> DataFrame:
    """V5-V10 as one row: the metrics, the time statistics and the number and
    share of each predicted label.  Three one-row results side by side."""
    one = F.lit(1).alias("_one")
    shares = prediction_distribution(details).groupBy(one).agg(*[
        F.max(F.when(F.col("label") == lab, F.col(c))).alias(f"{name}_{lab.lower()}")
        for lab in LABELS for c, name in (("n", "n"), ("percentage", "share"))])
    t = latency_stats(times, time_col).withColumnRenamed("n", "timed_samples")
    return metrics(details).select("*", one).join(t.select("*", one), "_one").join(shares, "_one").drop("_one")


def tolerant_accuracy(details: DataFrame) -> DataFrame:
    """Per true label, how often the opposite verdict was avoided
    (UNCERTAIN counts as right), and the false positives / negatives."""
    t, p = F.col("true_label"), F.col("predicted_label")
    opposite = F.when(t == "REAL", F.lit("FAKE")).when(t == "FAKE", F.lit("REAL"))
    g = details.where(F.col("error").isNull()).groupBy("true_label").agg(
        F.count(F.lit(1)).alias("n"),
        _count_true(p != F.coalesce(opposite, F.lit(""))).alias("tolerant_correct"),
        _count_true((t == "REAL") & (p == "FAKE")).alias("false_positives"),
        _count_true((t == "FAKE") & (p == "REAL")).alias("false_negatives"),
    )
    return g.select("true_label", "n", "tolerant_correct",
                    (F.col("tolerant_correct") / F.col("n")).alias("tolerant_accuracy"),
                    "false_positives", "false_negatives")


#: rows of one range in a global order; the number of ranges follows the rows
ROWS_PER_RANGE = 1_000_000


def numbered(df: DataFrame, order_col: str, name: str = "sample_id", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """1..n in ``order_col`` order (null first, ties in any order).

    The rows are written once, so that whatever made them runs once, and
    dealt into ranges of about ``rows_per_range`` rows.  The range bounds are
    drawn from the value together with a row id, so a value that very many
    rows share is cut into several ranges as well.  Each row's place in its
    range is taken while the sorted range is written; the ranges' sizes (one
    row per range) then give the offsets.  No window holds rows, only sizes.
    """
    rows = stored(df.withColumn("_uid", F.monotonically_increasing_id()), "numbered")
    ranges = max(1, math.ceil(rows.count() / rows_per_range))
    placed = rows.repartitionByRange(ranges, F.col(order_col).asc_nulls_first(), "_uid").sortWithinPartitions(
        F.col(order_col).asc_nulls_first(), "_uid")
    # after the sort, the id counts a partition's rows in order: its upper bits are the partition, the lower 33 the place
    at = F.monotonically_increasing_id()
    placed = placed.select(*df.columns, at.alias("_at"))
    placed = stored(placed.select(*df.columns, F.shiftright("_at", 33).cast("int").alias("_range"),
                                  F.col("_at").bitwiseAND((1 << 33) - 1).alias("_place")), "numbered")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    out = placed.join(F.broadcast(offsets), "_range")  # a row per million rows
    return out.select(*df.columns, (F.col("_before") + F.col("_place") + 1).alias(name))


def report(details: DataFrame, key: str = "doc_id", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Display columns of the per-sample report."""
    n = numbered(details.where(F.col("error").isNull()), key, rows_per_range=rows_per_range)
    return n.select(
        "sample_id", F.col(key),
        F.when(F.col("is_correct"), F.lit("✓")).otherwise(F.lit("✗")).alias("status"),
        F.substring(F.coalesce(F.col("title"), F.lit("")), 1, 50).alias("title_50"),
        "true_label", "predicted_label",
        (F.col("confidence") * 100.0).alias("confidence_pct"),
        "credibility_score",
        F.concat(F.lit("+"), F.col("positive_factors").cast("string"), F.lit(" / -"),
                 F.col("negative_factors").cast("string")).alias("factors"),
    )


# ---------------------------------------------------------------------------
# V8: latency statistics with an exact median by distributed selection
# ---------------------------------------------------------------------------

#: values that may be collected to end a selection
FEW = 10_000
#: distances from the middle, as shares of the ranks, at which a round cuts
CUTS = (0.0, 0.0005, 0.005, 0.05, 0.25)


def select_rank(values: DataFrame, rank: int, n: int, few: int = FEW) -> float:
    """The value of 0-based ``rank`` among the ``n`` values ``v`` (not null).

    Distributed selection: a sketch proposes cuts, which are values of the
    table, close to the rank and farther away; one aggregate counts exactly
    what lies below and at each cut; the part between two cuts that holds the
    rank is kept and written, and the next round works on that part alone.
    A round leaves about a thousandth of the values and always drops the cuts
    themselves, so equal values end it at once.  The last ``few`` values are
    looked at one by one.  No window and no sort of the values.
    """
    low = high = None  # open ends of the part that is kept
    while n > few:
        shares = sorted({min(1.0, max(0.0, (rank + 0.5) / n + sign * c)) for c in CUTS for sign in (-1, 1)})
        cuts = sorted(set(values.agg(F.percentile_approx("v", shares, 10_000).alias("c")).first().c), key=_order)
        counts = values.agg(*[F.count(F.when(F.col("v") < c, 1)).alias(f"b{i}") for i, c in enumerate(cuts)],
                            *[F.count(F.when(F.col("v") <= c, 1)).alias(f"t{i}") for i, c in enumerate(cuts)]).first()
        low, high, below, upto = None, None, 0, n
        for i, c in enumerate(cuts):
            if counts[f"b{i}"] <= rank < counts[f"t{i}"]:
                return c
            if counts[f"t{i}"] <= rank:
                low, below = c, counts[f"t{i}"]
            else:
                high, upto = c, counts[f"b{i}"]
                break
        if low is not None:
            values = values.where(F.col("v") > low)
        if high is not None:
            values = values.where(F.col("v") < high)
        values, rank, n = stored(values, "selection"), rank - below, upto - below
    return sorted((r.v for r in values.collect()), key=_order)[rank]


def _order(v: float) -> tuple:
    return (v != v, v)  # NaN last, as Spark has it


def exact_median(df: DataFrame, col: str, few: int = FEW) -> DataFrame:
    """One row, ``median_time``: the exact median, the mean of the middle two
    (null without values).  See :func:`select_rank`."""
    values = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    n = values.count()
    median = None
    if n:
        first = second = select_rank(values, (n - 1) // 2, n, few)
        if n % 2 == 0:
            upto = values.agg(F.count(F.when(F.col("v") <= first, 1)).alias("n"),
                              F.min(F.when(F.col("v") > first, F.col("v"))).alias("next")).first()
            second = first if upto.n > n // 2 else upto.next
        median = (first + second) / 2.0
    return df.sparkSession.createDataFrame([(median,)], "median_time double")


def latency_stats(times: DataFrame, col: str = "value") -> DataFrame:
    """V8: mean, median, min, max and throughput (1/mean, 0 when mean is 0)."""
    agg = times.agg(F.avg(col).alias("avg_time"), F.min(col).alias("min_time"), F.max(col).alias("max_time"),
                    F.count(col).alias("n"))
    median = F.lit(exact_median(times, col).first().median_time).cast("double")
    return agg.select(
        "n",
        F.coalesce(F.col("avg_time"), F.lit(0.0)).alias("avg_time"),
        F.coalesce(median, F.lit(0.0)).alias("median_time"),
        F.coalesce(F.col("min_time"), F.lit(0.0)).alias("min_time"),
        F.coalesce(F.col("max_time"), F.lit(0.0)).alias("max_time"),
        F.when(F.col("avg_time") > 0, 1.0 / F.col("avg_time")).otherwise(F.lit(0.0)).alias("throughput"),
    )
