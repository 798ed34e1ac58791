"""The result table: an incremental, keyed store of analyses.

The single-process dict cache of the behaviour we reproduce becomes a table
``(cache_key, <analysis columns>, cached_at)`` keyed by ``md5(url)``:

* lookup  = inner equi-join on the key (hits),
* misses  = ``left_anti`` join (only these are scored),
* upsert  = union + ``max(struct(cached_at, ...))`` per key (last write wins).
  This is a partial/final aggregation, so a key that is written very often is
  combined map-side before the shuffle instead of landing whole in one task,
* stats   = number of keys, min and max of ``cached_at``,
* clear   = an empty table.

On disk it is a base, bucketed and sorted by key with one row per key, and
the batches appended since (deltas); ``credence.plans.commits`` keeps the log
that says which folders count.  A lookup or an anti-join shuffles the requests
into the base's buckets and never the base.  Beside the base lies a Bloom
filter of its keys: while that is small enough to broadcast, requests that it
has not seen skip the join altogether.  An append writes one folder;
``fold`` merges many small deltas into one, ``compact`` merges all into a new
base, ``vacuum`` deletes folders that no commit needs any more.
"""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.plans.commits import CommitLog, State

KEY = "cache_key"
TS = "cached_at"


def cache_key(url: Column) -> Column:
    """K1: hex MD5 of the UTF-8 URL."""
    return F.md5(url)


def lookup(requests: DataFrame, results: DataFrame, url_col: str = "url") -> DataFrame:
    """K3 hits: requests that have a stored result (joined with the latest)."""
    req = requests.withColumn(KEY, cache_key(F.col(url_col)))
    return req.join(latest(results), KEY, "inner")


def misses(requests: DataFrame, results: DataFrame, url_col: str = "url") -> DataFrame:
    """K3 misses: requests without a stored result; only these are scored."""
    req = requests.withColumn(KEY, cache_key(F.col(url_col)))
    return req.join(results.select(KEY), KEY, "left_anti")


def latest(rows: DataFrame) -> DataFrame:
    """One row per key, the latest (ties: larger payload)."""
    payload = [c for c in rows.columns if c not in (KEY, TS)]
    g = rows.groupBy(KEY).agg(F.max(F.struct(F.col(TS), *[F.col(c) for c in payload])).alias("_r"))
    return g.select(KEY, *[F.col(f"_r.{c}").alias(c) for c in payload], F.col(f"_r.{TS}").alias(TS))


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """K2: union old and new rows, keep the latest per key."""
    return latest(existing.unionByName(new.select(*existing.columns)))


def stats(results: DataFrame) -> DataFrame:
    """K4: number of keys, oldest and newest entry (null when empty)."""
    return latest(results.select(KEY, TS)).agg(
        F.count(F.lit(1)).alias("cache_size"), F.min(TS).alias("oldest_entry"), F.max(TS).alias("newest_entry"))


def fresh_before(results: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """X2 (batch): rows younger than ``ttl_seconds`` at ``now``."""
    return results.where(F.col(TS) >= now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


# ---------------------------------------------------------------------------
# Bloom filter over the stored keys
# ---------------------------------------------------------------------------

#: bits of one block (what ``bitmap_construct_agg`` makes), bits per key, and bits set per key
BLOCK_BITS, BITS_PER_KEY, PROBES = 8 * 4096, 12, 4
#: a filter of more blocks (64 MiB) is not broadcast; the join alone decides then
MOST_BLOCKS = 16_384


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, probe: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(probe), key), F.lit(BLOCK_BITS)).cast("int")


def bloom_blocks(keys: DataFrame, n: int, bits_per_key: int = BITS_PER_KEY) -> tuple[DataFrame, int]:
    """A blocked Bloom filter of ``keys``: (block, bits) rows, and how many
    blocks it has.  A key's bits all lie in one block of 4 KiB."""
    blocks = max(1, math.ceil(n * bits_per_key / BLOCK_BITS))
    k = F.col(KEY)
    bits = keys.select(_block(k, blocks).alias("block"), F.explode(F.array(*[_bit(k, i) for i in range(PROBES)])).alias("bit"))
    return bits.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bits")), blocks


def may_contain(df: DataFrame, bloom: DataFrame, blocks: int, name: str = "_maybe") -> DataFrame:
    """Add ``name``: false where the key is certainly not in the filter."""
    k = F.col(KEY)

    def is_set(i: int) -> Column:
        byte = F.conv(F.hex(F.substring("_bits", (_bit(k, i) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(_bit(k, i), F.lit(8)))), F.lit(2)) == 1

    j = df.withColumn("_block", _block(k, blocks)).join(
        F.broadcast(bloom.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))), "_block", "left")
    found = is_set(0)
    for i in range(1, PROBES):
        found = found & is_set(i)
    return j.withColumn(name, F.coalesce(found, F.lit(False))).drop("_block", "_bits")


def _packed(rows: DataFrame, name: str) -> DataFrame:
    """(key, struct): the struct starts with the time, so the greater is the later."""
    return rows.select(KEY, F.struct(TS, *[c for c in rows.columns if c not in (KEY, TS)]).alias(name))


class ResultTable:
    """The table under ``path``.  ``buckets`` is the base's number of buckets
    (one task each; raise it with the table), ``max_deltas`` how many batches
    may lie beside the base before an append folds them."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, max_deltas: int = 64, checkpoint_every: int = 100):
        self.spark, self.path, self.buckets, self.max_deltas = spark, path, buckets, max_deltas
        self.log = CommitLog(spark, os.path.join(path, "_log"), checkpoint_every)

    # -- reading ---------------------------------------------------------------

    def _at(self, *folders: str) -> list[str]:
        return [os.path.join(self.path, f) for f in folders]

    def _folders(self) -> list[str]:
        s = self.log.state()
        return ([s.base["folder"]] if s.base else []) + s.deltas

    def _base(self, state: State) -> DataFrame | None:
        """The base as a bucketed table: this session's catalog learns of it
        when it first reads it."""
        if not state.base:
            return None
        folder, buckets = state.base["folder"], state.base["buckets"]
        name, (place,) = "credence_" + folder.replace("-", "_"), self._at(folder)
        if not self.spark.catalog.tableExists(name):
            ddl = self.spark.read.parquet(place)._jdf.schema().toDDL()
            self.spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) "
                           f"INTO {buckets} BUCKETS LOCATION '{place}'")
        return self.spark.table(name)

    def _deltas(self, state: State) -> DataFrame | None:
        return self.spark.read.parquet(*self._at(*state.deltas)) if state.deltas else None

    def rows(self) -> DataFrame | None:
        """All committed rows, older ones of a key included."""
        s = self.log.state()
        parts = [d for d in (self._base(s), self._deltas(s)) if d is not None]
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def read(self, schema: str | None = None) -> DataFrame | None:
        """The latest row of each key; the base stays in its buckets."""
        s = self.log.state()
        base, deltas = self._base(s), self._deltas(s)
        if base is None and deltas is None:
            return self.spark.createDataFrame([], schema) if schema else None
        if deltas is None or base is None:
            return base if deltas is None else latest(deltas)
        cols = [c for c in base.columns if c != KEY]
        j = _packed(base, "_a").join(_packed(self._newest(s, deltas), "_b"), KEY, "full_outer")
        both = j.select(KEY, F.greatest("_a", "_b").alias("_r"))  # greatest skips null
        return both.select(KEY, *[F.col(f"_r.{c}").alias(c) for c in cols])

    def _newest(self, state: State, deltas: DataFrame) -> DataFrame:
        """The deltas' latest rows, dealt into the base's buckets, so that a
        join has no reason to deal the base anew."""
        return latest(deltas.repartition(state.base["buckets"], KEY) if state.base else deltas)

    def side(self, name: str) -> DataFrame | None:
        """All committed rows of a side table (``append``'s ``also``)."""
        folders = self.log.state().sides.get(name, [])
        return self.spark.read.parquet(*self._at(*folders)) if folders else None

    def misses(self, requests: DataFrame, url_col: str = "url", since: Column | None = None) -> DataFrame:
        """K3: requests (narrow rows, with a cache key) without a stored
        result.  With ``since`` a result stored before it does not count."""
        req = requests.withColumn(KEY, cache_key(F.col(url_col)))
        s = self.log.state()
        base, deltas = self._base(s), self._deltas(s)
        young = lambda d: d if since is None else d.where(F.col(TS) >= since)
        if base is not None:
            new = None
            if s.base["blocks"] <= MOST_BLOCKS:
                seen = may_contain(req, self.spark.read.parquet(*self._at(s.base["bloom"])), s.base["blocks"])
                new, req = (seen.where(c).drop("_maybe") for c in (~F.col("_maybe"), F.col("_maybe")))
            req = req.join(young(base).select(KEY), KEY, "left_anti")
            req = req if new is None else req.unionByName(new)
        if deltas is not None:
            req = req.join(young(deltas).select(KEY).distinct(), KEY, "left_anti")
        return req

    def hits(self, requests: DataFrame, url_col: str = "url", since: Column | None = None) -> DataFrame | None:
        """K3: requests with their latest stored result."""
        req = requests.withColumn(KEY, cache_key(F.col(url_col)))
        s = self.log.state()
        base, deltas = self._base(s), self._deltas(s)
        if base is None and deltas is None:
            return None
        cols = [c for c in (deltas if base is None else base).columns if c != KEY]
        j = req if base is None else req.join(_packed(base, "_a"), KEY, "left")
        j = j if deltas is None else j.join(_packed(self._newest(s, deltas), "_b"), KEY, "left")
        found = F.greatest("_a", "_b") if base is not None and deltas is not None else F.col("_b" if base is None else "_a")
        j = j.withColumn("_r", found).where(F.col("_r").isNotNull())
        j = j if since is None else j.where(F.col(f"_r.{TS}") >= since)
        return j.select(KEY, *requests.columns, *[F.col(f"_r.{c}").alias(c) for c in cols])

    # -- writing ---------------------------------------------------------------

    def _write(self, df: DataFrame, kind: str = "batch") -> str:
        folder = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(*self._at(folder))
        return folder

    def append(self, new: DataFrame, epoch: str | None = None, also: dict[str, DataFrame] | None = None) -> DataFrame:
        """Write a batch (one row per key) and commit it; returns the batch.
        ``also`` names side tables whose rows are committed with it, all or
        nothing: a run that dies between the writes leaves folders nobody
        reads.  An ``epoch`` that is committed already is not written again."""
        done = self.log.state().epochs.get(epoch) if epoch is not None else None
        if done is None:
            folder = self._write(latest(new))
            sides = {name: self._write(df, name) for name, df in (also or {}).items()}
            # another run of the same epoch may have been faster: its batch counts then
            folder = self.log.commit(add=[folder], sides=sides, epoch=epoch) or folder
        else:
            folder = done
        if len(self.log.state().deltas) > self.max_deltas:
            self.fold()
        return self.spark.read.parquet(*self._at(folder))

    def upsert(self, new: DataFrame) -> DataFrame:
        self.append(new)
        return self.read()

    def fold(self) -> None:
        """Merge the deltas into one; costs what they hold, not the base."""
        s = self.log.state()
        if len(s.deltas) > 1:
            self.log.commit(add=[self._write(latest(self._deltas(s)))], remove=s.deltas)

    def compact(self) -> DataFrame | None:
        """Merge everything into a new base, bucketed by key, with its filter."""
        s, rows = self.log.state(), self.read()
        if rows is None:
            return None
        folder = f"base-{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, KEY).write.format("parquet").bucketBy(self.buckets, KEY).sortBy(KEY)
         .option("path", *self._at(folder)).saveAsTable("credence_" + folder.replace("-", "_")))
        keys = self.spark.read.parquet(*self._at(folder)).select(KEY)
        bloom, blocks = bloom_blocks(keys, keys.count())
        base = {"folder": folder, "buckets": self.buckets, "blocks": blocks, "bloom": self._write(bloom, "bloom")}
        self.log.commit(base=base, remove=[*s.deltas, *([s.base["folder"]] if s.base else [])])
        return self.read()

    def clear(self, schema: str) -> DataFrame:
        """K5: an empty table."""
        self.log.commit(clear=True)
        return self.read(schema)

    def vacuum(self, older_than_seconds: float = 7 * 24 * 3600) -> int:
        """Delete folders that no commit needs and that nobody has touched
        for so long (a reader or an unfinished run may still use younger
        ones), and log entries before the last checkpoint; returns how many."""
        s = self.log.state()
        needed = set(s.deltas) | {f for fs in s.sides.values() for f in fs}
        if s.base:
            needed |= {s.base["folder"], s.base["bloom"]}
        return self.log.delete_old(self.path, needed, older_than_seconds) + self.log.clean(older_than_seconds)


def split_requests(table: ResultTable, requests: DataFrame, use_cache: str | None = None,
                   since: Column | None = None) -> tuple[DataFrame | None, DataFrame]:
    """K3: (requests answered from the table, requests to score).  Rows whose
    column ``use_cache`` is false are scored whatever is stored."""
    asks = requests if use_cache is None else requests.where(F.coalesce(F.col(use_cache), F.lit(True)))
    todo = table.misses(asks, since=since)
    if use_cache is not None:
        skip = requests.where(~F.coalesce(F.col(use_cache), F.lit(True)))
        todo = todo.unionByName(skip.withColumn(KEY, cache_key(F.col("url"))))
    return table.hits(asks, since=since), todo


def pages_to_score(table: ResultTable, pages: DataFrame, order: str = "page_id", use_cache: str | None = None,
                   since: Column | None = None) -> DataFrame:
    """The pages that must be extracted and scored, one page per URL: of
    pages that share a URL the one with the largest ``order``.  Only keys are
    compared and reduced; the pages' bodies are fetched by a semi-join."""
    keys = pages.select(order, "url", *([use_cache] if use_cache else []))
    _, todo = split_requests(table, keys, use_cache, since)
    first = todo.groupBy(KEY).agg(F.max(order).alias(order))
    found = pages.withColumn(KEY, cache_key(F.col("url"))).join(first, [KEY, order], "left_semi")
    # a page without URL has no key; it goes on to its error
    return found.select(*pages.columns).unionByName(pages.where(F.col("url").isNull()))


def incremental_score(table: ResultTable, pages: DataFrame, analyse_fn, columns, run_ts: Column, epoch: str | None = None,
                      order: str = "page_id", use_cache: str | None = None, since: Column | None = None) -> int:
    """One incremental run: score only the pages the table has not seen
    (anti-join on the key, before anything is extracted), each URL once, and
    append them.

    ``analyse_fn(pages_subset) -> DataFrame`` must keep ``url`` and produce
    ``columns``.  Returns the number of newly stored keys (0 on a rerun).
    Usable as a Structured Streaming ``foreachBatch`` body as well: a batch
    that is replayed with the same ``epoch`` is committed once.
    """
    todo = pages_to_score(table, pages, order, use_cache, since)
    scored = analyse_fn(todo).select(cache_key(F.col("url")).alias(KEY), *columns, run_ts.alias(TS))
    return table.append(scored, epoch).count()
