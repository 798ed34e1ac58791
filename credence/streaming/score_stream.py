"""Structured Streaming forms.

* ``page_score_stream``: pages arriving as parquet files are scored with the
  very same column functions as the batch path (all map-side, so the stream
  is stateless and exactly-once through the file sink + checkpoint).
* ``page_result_stream``: arriving pages into the result table and its
  quarantine, committed together.
* ``dedupe_results``: duplicate suppression per key, state bounded by the
  watermark (results that expire by timer are in ``stateful``).
* ``rate_over_limit``: requests per client and minute above the limit, a
  windowed count with a watermark (append mode emits a window once closed);
  rolling rates are in ``stateful``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.params import CORPUS, Params
from credence.plans import pipeline as pl
from credence.session import checkpoint_dir, stored
from credence.sources import pages as pg

PAGES_SCHEMA = "page_id BIGINT, url STRING, html STRING"


def score_pages(stream: DataFrame, params: Params = CORPUS) -> DataFrame:
    """The page analysis of a (streaming or batch) pages DataFrame."""
    return pl.analyse(pg.good_pages(pg.extract_pages(stream, params)), params)


def pages_stream(spark: SparkSession, source: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The pages that arrive at ``source``: a table folder, or one parquet
    file (a file source watches folders, so its folder is, for that name)."""
    reader = spark.readStream.schema(PAGES_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    files = spark.read.schema(PAGES_SCHEMA).parquet(source).inputFiles()
    if len(files) == 1 and files[0].rstrip("/").endswith("/" + os.path.basename(source)):
        return reader.option("pathGlobFilter", os.path.basename(source)).parquet(os.path.dirname(source))
    return reader.parquet(source)


def page_score_stream(spark: SparkSession, source: str, params: Params = CORPUS, out: str | None = None,
                      columns=("page_id", "url", "prediction", "confidence", "credibility_score"),
                      max_files_per_trigger: int | None = None, checkpoint: str | None = None):
    """Start the stream over ``source`` with an availableNow trigger; returns
    (query, out).  With ``out`` and ``checkpoint`` given a restart resumes
    after the last committed batch; without them it is a run of its own
    below the shared checkpoint folder."""
    base = os.path.join(checkpoint_dir(spark), f"stream-score-{uuid.uuid4().hex}")
    out, checkpoint = out or os.path.join(base, "out"), checkpoint or os.path.join(base, "_checkpoint")
    scored = score_pages(pages_stream(spark, source, max_files_per_trigger), params).select(*columns)
    q = (scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(out))
    return q, out


def dedupe_results(stream: DataFrame, key: str = "cache_key", ts: str = "cached_at",
                   ttl_seconds: int = 3600) -> DataFrame:
    """Drop a key's repeats that arrive within the TTL (watermark)."""
    return stream.withWatermark(ts, f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark([key])


def rate_over_limit(events: DataFrame, limit: int, ts: str = "ts", client: str = "user_id",
                    lateness: str = "1 minute", window: str = "1 minute") -> DataFrame:
    """(client, window) with more than ``limit`` requests."""
    if events.isStreaming:
        events = events.withWatermark(ts, lateness)
    counts = events.groupBy(F.window(F.col(ts), window).alias("w"), F.col(client)).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > limit).select(
        F.col(client), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def page_result_stream(spark: SparkSession, source: str, table_path: str, params: Params = CORPUS,
                       columns=("prediction", "confidence", "credibility_score"), use_cache: str | None = None,
                       max_files_per_trigger: int | None = None):
    """X1 + S10 + K2/K3 as a stream with two sinks: of every micro-batch of
    arriving pages, those whose URL the result table has not seen are read
    once; the good ones are scored and stored, the others go to the table's
    side table ``quarantine``.  Both are committed by one entry of the log,
    so a run that dies between the two writes leaves neither, and a batch
    that is replayed is committed once.  availableNow trigger; returns the
    query; the checkpoint makes a restarted stream resume."""
    from credence.plans import results as rs

    table = rs.ResultTable(spark, table_path)
    return (pages_stream(spark, source, max_files_per_trigger).writeStream
            .foreachBatch(lambda batch, epoch: commit_batch(table, batch, epoch, params, columns, use_cache))
            .option("checkpointLocation", os.path.join(table_path + "_checkpoint"))
            .trigger(availableNow=True).start())


def commit_batch(table, batch: DataFrame, epoch: int, params: Params = CORPUS,
                 columns=("prediction", "confidence", "credibility_score"), use_cache: str | None = None) -> None:
    """One micro-batch of :func:`page_result_stream`."""
    from credence.plans import results as rs

    if f"stream-{epoch}" in table.log.state().epochs:
        return
    todo = rs.pages_to_score(table, batch, use_cache=use_cache)
    content = stored(pg.extract_pages(todo, params), "extracted")  # read once, for both sinks
    scored = pl.analyse(pg.good_pages(content), params).select(
        rs.cache_key(F.col("url")).alias(rs.KEY), *columns, F.current_timestamp().alias(rs.TS))
    bad = pg.quarantined(content).select("page_id", "url", "error")
    table.append(scored, f"stream-{epoch}", also={"quarantine": bad})
