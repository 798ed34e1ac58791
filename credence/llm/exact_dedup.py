"""Exact dedup by deterministic block naming (operator 9, DataFrame only).

A text, A-Z lower-cased, is cut into blocks of ``BLOCK_BYTES`` of its UTF-8
form.  The blocks are sorted and get integer names: equal blocks the same
name, different blocks different names.  Adjacent names of a document then
form pairs, pairs are sorted and named in turn, and after ``ceil(log2 n)``
levels each document of n blocks has one name.  Names come from comparing
the blocks themselves, so they cannot collide; hashes only route rows.

A block that a large part of the rows share would land in one sort bucket.
Such blocks are found with a count per 64-bit hash; at most ``HOT_SHARE``
hashes can reach the limit.  They are reduced map-side to their distinct
texts, named apart and joined back as a broadcast of at most ``HOT_SHARE``
blocks per colliding hash, so their rows are never gathered.

Defined cases: a null text counts as empty, all empty texts are one group;
a null doc_id never stays while its group has another (the largest doc_id
stays); rows repeated in full are separate members of the group and only one
of them stays; an empty table gives an empty result; extra columns are
ignored by :func:`exact_groups` and kept by :func:`keep_one`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from credence.llm.common import ascii_lower, free_name, plain, stored

BLOCK_BYTES = 16384
HOT_SHARE = 1000  # a block is hot from 1/HOT_SHARE of all blocks on
HOT_LEAST = 64
BUCKETS = 1 << 20


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    d = plain(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("norm"))
    d = d.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.encode("norm", "UTF-8").alias("bin"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("bin") / F.lit(block_bytes)).cast("int"))
    d = d.withColumn("n", n)
    cut = lambda i: F.substring("bin", i * block_bytes + 1, F.lit(block_bytes))
    d = d.select("doc_id", "text_sha256", "n", F.posexplode(
        F.transform(F.sequence(F.lit(0), F.col("n") - 1), cut)).alias("pos", "block"))
    return d.withColumn("h", F.xxhash64("block"))


def _name_sorted(df: DataFrame, *cols: str) -> DataFrame:
    """Integer names in the sort order of ``cols`` inside each hash bucket:
    bucket and rank together.  The ranks do not depend on the partitioning."""
    b = df.withColumn("bucket", F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)))
    rank = F.dense_rank().over(W.partitionBy("bucket").orderBy(*cols)).cast("long")
    return b.withColumn("name", F.shiftleft(F.col("bucket"), 40) + rank).drop("bucket")


def name_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text_sha256, n, name, copies): one row per distinct (doc_id,
    text); (n, name) is the collision-free identity of the text."""
    blocks = _blocks(docs, block_bytes)
    counts = blocks.groupBy("h").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c")).first()[0] or 0
    limit = max(HOT_LEAST, total // HOT_SHARE)
    hot = stored(counts.filter(F.col("c") >= limit).select("h"))  # at most HOT_SHARE rows
    cold = _name_sorted(blocks.join(F.broadcast(hot), "h", "left_anti"), "block")
    cold = cold.select("doc_id", "text_sha256", "n", "pos", "name")
    hot_rows = blocks.join(F.broadcast(hot), "h", "left_semi")
    names = hot_rows.groupBy("h", "block").agg(F.lit(1).alias("one"))
    names = _name_sorted(names, "block").select("h", "block", (-F.col("name")).alias("name"))
    warm = hot_rows.join(F.broadcast(names), ["h", "block"]).select(*cold.columns)
    level = stored(cold.unionByName(warm))

    most = level.agg(F.max("n")).first()[0] or 1
    done = level.filter("n = 1").groupBy("doc_id", "text_sha256", "n", "name").agg(F.count("*").alias("copies"))
    open_ = level.filter("n > 1")
    width, first = most, True
    while width > 1:
        pairs = open_.groupBy("doc_id", "text_sha256", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("b"),
            # rows repeated in full meet here; how many there were is carried on
            (F.count(F.when(F.col("pos") % 2 == 0, 1)) if first else F.max("copies")).alias("copies"))
        pairs = stored(pairs)
        named = _name_sorted(pairs.select("a", "b").groupBy("a", "b").agg(F.lit(1).alias("one")), "a", "b")
        open_ = stored(pairs.join(named.select("a", "b", "name"), ["a", "b"]).drop("a", "b"))
        width, first = (width + 1) // 2, False
    if most > 1:
        done = done.unionByName(open_.select("doc_id", "text_sha256", "n", "name", "copies"))
    return done


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    d = stored(name_documents(docs, block_bytes))
    # written, so that the join back is one of two plain scans, whose skewed keys Spark splits
    g = stored(d.groupBy("n", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    j = d.join(g, ["n", "name"])
    j = j.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return j.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    name = free_name(docs, "_key")

    def key(doc_id, sha):
        return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")), sha)

    kept = exact_groups(docs, block_bytes).filter("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias(name))
    norm = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.withColumn(name, key(F.col("doc_id"), F.sha2(norm, 256)))
    # rows that repeat in doc_id and text share a key: one of them stays, in the join's own partitioning
    return rows.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
