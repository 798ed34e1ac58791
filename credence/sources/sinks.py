"""Sinks: the analysis response record (S14) and evaluation output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def author_text(authors: Column) -> Column:
    """Authors joined by ', ', or 'Unknown' when there are none."""
    joined = F.array_join(F.coalesce(authors, F.array().cast("array<string>")), ", ")
    return F.when(joined == "", F.lit("Unknown")).otherwise(joined)


def response_struct(url_path: bool = True) -> Column:
    """The nested response of one analysed row (no timestamp inside)."""
    meta = [F.col("domain"), F.col("title"), author_text(F.col("authors")).alias("author"),
            F.col("publish_date"), F.col("word_count"), F.col("model_used")]
    if url_path:
        meta = [F.col("url")] + meta
    else:
        meta = [F.lit("direct-text").alias("source"), F.col("title"), F.col("word_count"), F.col("model_used")]
    return F.struct(
        F.lit(True).alias("success"), F.col("prediction"), F.col("confidence"), F.col("credibility_score"),
        F.col("summary"), F.col("positive_factors"), F.col("negative_factors"), F.col("key_concerns"),
        F.col("recommendations"), F.struct(*meta).alias("metadata"))


def write_responses(explained: DataFrame, path: str, key: str, url_path: bool = True, fmt: str = "json",
                    run_ts: str | None = None) -> None:
    """Write one response record per row; the run timestamp is a column."""
    out = explained.select(F.col(key), response_struct(url_path).alias("response"))
    out = out.withColumn("analysis_timestamp",
                         F.to_timestamp(F.lit(run_ts)) if run_ts else F.current_timestamp())
    out.write.mode("overwrite").format(fmt).save(path)


def write_evaluation(metrics: DataFrame, details: DataFrame, path: str, run_ts: str) -> None:
    """Metrics and detailed results, tagged with the run timestamp."""
    ts = F.to_timestamp(F.lit(run_ts))
    metrics.withColumn("run_ts", ts).write.mode("overwrite").json(f"{path}/metrics")
    details.withColumn("run_ts", ts).write.mode("overwrite").json(f"{path}/detailed_results")
