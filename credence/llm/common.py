"""Helpers shared by the operators: shared scratch tables, null-safe inputs
and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the cluster's ``spark.checkpoint.dir``.

    Only a ``local`` master may fall back to a temporary folder: elsewhere
    the executors would each write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="credence-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"llm-{uuid.uuid4().hex}")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared scratch folder and read back, which cuts
    its lineage: a lost executor costs a re-read, not a re-run.  The folders
    (``llm-*``) stay until whoever owns the scratch folder clears it."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front while ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a missing one is null.  Extra columns, also
    those whose names clash with columns made here, go."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).alias(n) for n in names])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u long, v long) as (node, root):
    ``root`` is the smallest node id that is reachable.

    Alternating large-star and small-star rounds.  Each is a min-aggregate
    per node (combined map-side) joined back to the edges, so a node with
    very many edges is an ordinary skewed join, which AQE splits.  Every
    round is written to the shared folder.
    """
    e = stored(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    before = _state(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        e = stored(_small_star(_large_star(e)))
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    # settled: each edge is (root, node)
    return e.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def _star(both: DataFrame, keep: Column) -> DataFrame:
    m = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    j = both.join(m, "a")
    return j.filter(keep).select(F.col("m").alias("u"), F.col("b").alias("v")).filter("u <> v")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(
        e.select(F.col("v").alias("a"), F.col("u").alias("b")))
    return _star(both, F.col("b") > F.col("a")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    # every edge is (u < v); v's smaller neighbours and v itself point at the smallest
    down = e.select(F.col("v").alias("a"), F.col("u").alias("b"))
    own = e.select(F.col("v").alias("a"), F.col("v").alias("b"))
    return _star(down.unionByName(own), F.lit(True)).distinct()
