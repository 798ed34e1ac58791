import os

from pyspark.sql import functions as F

from conftest import SF
from credence.plans import results as rs
from credence.session import checkpoint_dir
from credence.streaming import score_stream as ss

SCHEMA = "cache_key STRING, prediction STRING, cached_at TIMESTAMP"


def test_upsert_last_write_wins(spark):
    old = spark.createDataFrame([("k1", "REAL", None), ("k2", "FAKE", None)], SCHEMA).withColumn(
        "cached_at", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    new = spark.createDataFrame([("k1", "FAKE", None)], SCHEMA).withColumn(
        "cached_at", F.to_timestamp(F.lit("2024-01-02 00:00:00")))
    got = {r.cache_key: r.prediction for r in rs.upsert(old, new).collect()}
    assert got == {"k1": "FAKE", "k2": "FAKE"}


def test_stats_of_empty_table(spark):
    r = rs.stats(spark.createDataFrame([], SCHEMA)).first()
    assert (r.cache_size, r.oldest_entry, r.newest_entry) == (0, None, None)


def test_lookup_and_misses(spark):
    req = spark.createDataFrame([(1, "http://a"), (2, "http://b")], "id INT, url STRING")
    cache = req.where("id = 1").select(rs.cache_key(F.col("url")).alias("cache_key"), F.lit("REAL").alias("prediction"),
                                       F.current_timestamp().alias("cached_at"))
    assert [r.id for r in rs.lookup(req, cache).collect()] == [1]
    assert [r.id for r in rs.misses(req, cache).collect()] == [2]


def test_versioned_table_and_clear(spark):
    path = os.path.join(checkpoint_dir(spark), "results-test")
    t = rs.ResultTable(spark, path)
    a = spark.createDataFrame([("k", "REAL", None)], SCHEMA).withColumn("cached_at", F.current_timestamp())
    t.upsert(a)
    t.upsert(a.withColumn("prediction", F.lit("FAKE")))
    assert t.read().first().prediction == "FAKE"
    assert t.clear(SCHEMA).count() == 0


def test_stream_equals_batch(spark):
    q, out = ss.page_score_stream(spark, os.path.join(SF, "pages.parquet"))
    q.awaitTermination()
    stream = {r.page_id: (r.prediction, r.credibility_score) for r in spark.read.parquet(out).collect()}
    batch_df = ss.score_pages(spark.read.parquet(os.path.join(SF, "pages.parquet")))
    batch = {r.page_id: (r.prediction, r.credibility_score) for r in batch_df.collect()}
    assert stream and stream == batch


def test_streaming_dedupe_and_rate(spark, tmp_path):
    events = spark.read.parquet(os.path.join(SF, "events.parquet"))
    src = str(tmp_path / "ev")
    events.select(F.col("ts"), F.col("user_id"), F.col("user_id").cast("string").alias("cache_key"),
                  F.col("ts").alias("cached_at")).write.parquet(src)
    stream = spark.readStream.schema("ts TIMESTAMP, user_id LONG, cache_key STRING, cached_at TIMESTAMP").parquet(src)
    d = ss.dedupe_results(stream)
    q = d.writeStream.format("memory").queryName("dedupe_t").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedupe_t").count() > 0
    r = ss.rate_over_limit(stream, 0)
    q = r.writeStream.format("memory").queryName("rate_t").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = ss.rate_over_limit(events, 0)
    emitted = {tuple(r) for r in spark.table("rate_t").collect()}
    # windows the watermark has closed are emitted, with the batch result's counts
    assert emitted and emitted <= {tuple(r) for r in batch.collect()}


def test_response_and_evaluation_sinks(spark, tmp_path):
    from conftest import SF
    from credence.plans import pipeline as pl
    from credence.sources import sinks as sk
    from credence.operators import evaluate as ev
    from credence.sources import tables as tb
    e = pl.analyse_pages(spark, SF)
    sk.write_responses(e, str(tmp_path / "resp"), "page_id", run_ts="2024-01-01 00:00:00")
    back = spark.read.json(str(tmp_path / "resp"))
    assert back.count() == e.count()
    assert back.select("response.metadata.author").first()[0] == "Unknown"
    d = ev.eval_details(pl.analyse(tb.labelled_content(spark, SF)), "doc_id", "label")
    sk.write_evaluation(ev.metrics(d), d, str(tmp_path / "eval"), "2024-01-01 00:00:00")
    assert spark.read.json(str(tmp_path / "eval" / "metrics")).count() == 1


def test_incremental_rerun_scores_nothing(spark):
    from conftest import SF
    from credence.sources import pages as pg
    from credence.plans import pipeline as pl
    path = os.path.join(checkpoint_dir(spark), f"results-inc-{os.getpid()}")
    t = rs.ResultTable(spark, path)
    pages = spark.read.parquet(os.path.join(SF, "pages.parquet"))

    def analyse(p):
        return pl.analyse(pg.good_pages(pg.extract_pages(p)))

    n1 = rs.incremental_score(t, pages, analyse, ["prediction", "credibility_score"], F.current_timestamp())
    n2 = rs.incremental_score(t, pages, analyse, ["prediction", "credibility_score"], F.current_timestamp())
    assert n1 == pg.good_pages(pg.extract_pages(pages)).count() and n2 == 0


def test_streaming_result_table(spark):
    from conftest import SF
    from credence.sources import pages as pg
    path = os.path.join(checkpoint_dir(spark), f"results-stream-{os.getpid()}")
    ss.page_result_stream(spark, os.path.join(SF, "pages.parquet"), path).awaitTermination()
    t = rs.ResultTable(spark, path).read()
    good = pg.good_pages(pg.extract_pages(spark.read.parquet(os.path.join(SF, "pages.parquet"))))
    assert t.count() == good.count() == t.select("cache_key").distinct().count()


def stored(spark, rows, ts="2024-01-01 00:00:00"):
    return spark.createDataFrame([(k, p, None) for k, p in rows], SCHEMA).withColumn("cached_at", F.to_timestamp(F.lit(ts)))


def test_first_batch_has_one_row_per_key(spark, tmp_path):
    t = rs.ResultTable(spark, str(tmp_path / "t"))
    assert t.append(stored(spark, [("k", "REAL"), ("k", "FAKE"), ("l", "REAL")])).count() == 2
    assert t.read().count() == 2 and rs.stats(t.rows()).first().cache_size == 2


def test_half_written_batch_is_skipped(spark, tmp_path):
    """A run that dies before its commit leaves a folder nobody reads, and
    the next run goes on."""
    path = str(tmp_path / "t")
    t = rs.ResultTable(spark, path)
    t.append(stored(spark, [("k", "REAL")]))
    stored(spark, [("x", "FAKE")]).write.parquet(f"{path}/batch-lost")
    os.remove(f"{path}/batch-lost/_SUCCESS")
    t.append(stored(spark, [("k", "FAKE")], "2024-01-02 00:00:00"))
    assert [(r.cache_key, r.prediction) for r in t.read().collect()] == [("k", "FAKE")]
    assert t.compact().count() == 1 and len(t._folders()) == 1


def test_replayed_epoch_is_committed_once(spark, tmp_path):
    t = rs.ResultTable(spark, str(tmp_path / "t"))
    t.append(stored(spark, [("k", "REAL")]), "e1")
    t.append(stored(spark, [("k", "FAKE"), ("l", "FAKE")], "2024-01-02 00:00:00"), "e1")
    assert [tuple(r)[:2] for r in t.read().collect()] == [("k", "REAL")]


def test_lookup_of_a_key_stored_twice(spark):
    req = spark.createDataFrame([(1, "http://a")], "id INT, url STRING")
    key = req.select(rs.cache_key(F.col("url"))).first()[0]
    cache = stored(spark, [(key, "REAL")]).unionByName(stored(spark, [(key, "FAKE")], "2024-01-02 00:00:00"))
    assert [r.prediction for r in rs.lookup(req, cache).collect()] == ["FAKE"]


def test_stream_over_a_folder_table_resumes(spark, tmp_path):
    pages = spark.read.parquet(os.path.join(SF, "pages.parquet"))
    src, out, cp = (str(tmp_path / x) for x in ("pages.parquet", "out", "cp"))
    pages.where("page_id < 20").repartition(3).write.parquet(src)
    for _ in range(2):
        q, _ = ss.page_score_stream(spark, src, out=out, checkpoint=cp)
        q.awaitTermination()
    first = spark.read.parquet(out).count()
    assert first == ss.score_pages(pages.where("page_id < 20")).count()
    pages.where("page_id >= 20").write.mode("append").parquet(src)
    q, _ = ss.page_score_stream(spark, src, out=out, checkpoint=cp)
    q.awaitTermination()
    got = [r.page_id for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) == ss.score_pages(pages).count()


def test_no_local_folder_on_a_cluster(spark):
    class Conf:
        def get(self, k, d=None):
            return {"spark.master": "spark://host:7077"}.get(k, d)

    class Session:
        conf = Conf()

    import pytest
    with pytest.raises(ValueError):
        checkpoint_dir(Session())


# ---------------------------------------------------------------------------
# the bucketed base, the log and the filter
# ---------------------------------------------------------------------------

def many(spark, lo, hi, label="REAL", ts="2024-01-01 00:00:00"):
    url = F.concat(F.lit("http://h/"), F.col("id"))
    return spark.range(lo, hi).select(rs.cache_key(url).alias("cache_key"), F.lit(label).alias("prediction"),
                                      F.to_timestamp(F.lit(ts)).alias("cached_at"))


def asked(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id")).alias("url"))


def test_base_and_deltas_read_as_one(spark, tmp_path):
    t = rs.ResultTable(spark, str(tmp_path / "t"), buckets=4)
    t.append(many(spark, 0, 300))
    assert t.compact().count() == 300
    t.append(many(spark, 200, 400, "FAKE", "2024-01-02 00:00:00"))
    t.append(many(spark, 0, 10, "OLD", "2023-01-01 00:00:00"))  # written later, stored earlier
    got = {r.prediction: r["count"] for r in t.read().groupBy("prediction").count().collect()}
    assert got == {"REAL": 200, "FAKE": 200}
    assert {r.page_id for r in t.misses(asked(spark, 390, 420)).collect()} == set(range(400, 420))
    assert t.hits(asked(spark, 390, 420)).count() == 10
    assert {r["prediction"]: r["count"] for r in t.compact().groupBy("prediction").count().collect()} == got
    # another session's handle: the base is known by its folder
    again = rs.ResultTable(spark, str(tmp_path / "t"))
    assert again.read().count() == 400 and again.log.state().base["buckets"] == 4


def test_stored_side_is_not_shuffled(spark, tmp_path):
    """Neither the anti-join nor the lookup nor the merge with the deltas exchanges the base."""
    t = rs.ResultTable(spark, str(tmp_path / "t"), buckets=4)
    t.append(many(spark, 0, 3000))
    t.compact()
    t.append(many(spark, 0, 5, "FAKE", "2024-01-02 00:00:00"))
    base = t.log.state().base["folder"]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (t.misses(asked(spark, 0, 4000)), t.hits(asked(spark, 0, 4000)), t.read()):
            plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
            scans = [i for i, line in enumerate(plan) if base[:20] in line.replace("_", "-") and "Scan" in line]
            assert scans
            for i in scans:
                depth = lambda line: len(line) - len(line.lstrip(" +-:"))
                at, above = depth(plan[i]), []
                for line in reversed(plan[:i]):
                    if depth(line) < at:
                        at = depth(line)
                        above.append(line)
                join = next(k for k, line in enumerate(above) if "Join" in line)
                assert not any("Exchange" in line for line in above[:join]), above[:join]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bloom_filter_has_no_false_negatives(spark, tmp_path):
    keys = many(spark, 0, 20_000)
    bloom, blocks = rs.bloom_blocks(keys, 20_000)
    assert blocks == 8 and bloom.count() == 8
    found = rs.may_contain(many(spark, 0, 40_000).withColumn("old", F.monotonically_increasing_id()), bloom, blocks)
    ids = found.join(keys.select("cache_key", F.lit(1).alias("is_stored")), "cache_key", "left")
    n = {(r.is_stored, r._maybe): r["count"] for r in ids.groupBy("is_stored", "_maybe").count().collect()}
    assert n[(1, True)] == 20_000 and (1, False) not in n
    assert n[(None, True)] < 400  # under 2 %
    t = rs.ResultTable(spark, str(tmp_path / "t"), buckets=4)
    t.append(many(spark, 0, 2000))
    t.compact()
    assert t.misses(asked(spark, 1000, 3000)).count() == 1000
    most, rs.MOST_BLOCKS = rs.MOST_BLOCKS, 0  # a filter too large to broadcast: the join alone decides
    try:
        assert t.misses(asked(spark, 1000, 3000)).count() == 1000
    finally:
        rs.MOST_BLOCKS = most


def test_ten_thousand_commits_are_read_without_a_listing(spark, tmp_path):
    import json

    from credence.plans.commits import CommitLog
    (tmp_path / "_log").mkdir()
    log = CommitLog(spark, str(tmp_path / "_log"), checkpoint_every=1000)
    s = log.state()
    for i in range(10_000):  # what commit() does for a single writer, with the state kept
        c = {"add": [f"batch-{i}"], "remove": [f"batch-{i - 5}"] if i >= 5 else [], "epoch": f"e{i}"}
        (tmp_path / "_log" / log.name(i)).write_text(json.dumps(c))
        s.apply(c)
        if (i + 1) % 1000 == 0:
            log.checkpoint(s)
    log.commit(add=["last"])
    for f in tmp_path.joinpath("_log").iterdir():  # what the checkpoint covers is not needed
        if f.name.lstrip(".")[:1].isdigit() and f.name.lstrip(".")[:20] < f"{9_999:020d}":
            f.unlink()
    again = CommitLog(spark, str(tmp_path / "_log"))
    got = again.state()
    assert again.opened <= 4 and got.version == 10_000
    assert got.deltas == [f"batch-{i}" for i in range(9_995, 10_000)] + ["last"] and len(got.epochs) == 1000


def test_two_writers_take_turns(spark, tmp_path):
    a, b = (rs.ResultTable(spark, str(tmp_path / "t")) for _ in range(2))
    a.append(stored(spark, [("k", "REAL")]))
    state = b.log.state()
    a.append(stored(spark, [("l", "REAL")]), "e")
    b.log.state = iter([state, *[type(b.log).state(b.log)] * 9]).__next__  # b has not seen a's commit yet
    b.append(stored(spark, [("m", "REAL")]), "f")
    assert {r.cache_key for r in a.read().collect()} == {"k", "l", "m"}
    assert not a.log._put(a.log.name(1), {})  # a number is taken once
    # a merge of folders that another writer has merged meanwhile does nothing
    live = a.log.state().deltas
    a.fold()
    a.log.commit(add=["batch-nowhere"], remove=live)
    assert {r.cache_key for r in a.read().collect()} == {"k", "l", "m"} and len(a.log.state().deltas) == 1


def test_deltas_are_folded_and_old_folders_go(spark, tmp_path):
    t = rs.ResultTable(spark, str(tmp_path / "t"), max_deltas=3, buckets=2, checkpoint_every=2)
    for i in range(6):
        t.append(stored(spark, [(f"k{i}", "REAL"), ("same", str(i))], f"2024-01-0{i + 1} 00:00:00"))
    assert len(t.log.state().deltas) <= 3 and t.read().count() == 7
    t.compact()
    assert t.vacuum(3600) == 0  # nobody's young folder goes
    before = {p.name for p in (tmp_path / "t").iterdir()}
    assert t.vacuum(-60) > 0
    after = {p.name for p in (tmp_path / "t").iterdir()}
    s = t.log.state()
    assert after < before and {f for f in after if f[0] != "_" and f[0] != "."} == {s.base["folder"], s.base["bloom"]}
    assert {r.cache_key: r.prediction for r in t.read().collect()}["same"] == "5"


def test_bypass_and_expiry_of_lookups(spark, tmp_path):
    t = rs.ResultTable(spark, str(tmp_path / "t"), buckets=2)
    t.append(many(spark, 0, 10))
    t.append(many(spark, 10, 20, ts="2024-01-01 02:00:00"))
    ask = asked(spark, 5, 25).withColumn("use_cache", F.when(F.col("page_id") % 5 == 0, F.col("page_id") % 2 == 1))
    hits, todo = rs.split_requests(t, ask, "use_cache")
    bypass = {i for i in range(5, 25) if i % 10 == 0}
    assert {r.page_id for r in todo.collect()} == bypass | set(range(20, 25))
    assert {r.page_id for r in hits.collect()} == set(range(5, 20)) - bypass
    since = F.to_timestamp(F.lit("2024-01-01 01:00:00"))
    hits, todo = rs.split_requests(t, ask.drop("use_cache"), since=since)
    assert {r.page_id for r in hits.collect()} == set(range(10, 20)) and todo.count() == 10


def test_pages_of_one_url_are_scored_once(spark, tmp_path):
    t = rs.ResultTable(spark, str(tmp_path / "t"))
    text = "<article><p>Some words that make a page of text.</p></article>"
    pages = spark.createDataFrame([(1, "http://a/x", text), (2, "http://a/x", text), (3, "http://a/y", text), (4, None, text)],
                                  "page_id LONG, url STRING, html STRING")
    assert [(r.page_id, r.url) for r in rs.pages_to_score(t, pages).orderBy("page_id").collect()] == [
        (2, "http://a/x"), (3, "http://a/y"), (4, None)]


def test_results_and_quarantine_are_committed_together(spark, tmp_path, monkeypatch):
    """A run dies between the two writes: neither shows; the replay commits both, once."""
    pages = spark.read.parquet(os.path.join(SF, "pages.parquet")).limit(20).unionByName(
        spark.createDataFrame([(900, "nonsense", "<p>x</p>"), (901, "http://e/", ""), (902, None, "<p>x</p>")], "page_id LONG, url STRING, html STRING"))
    t = rs.ResultTable(spark, str(tmp_path / "t"))
    write = rs.ResultTable._write

    def dies(self, df, kind="batch"):
        if kind == "quarantine":
            raise RuntimeError("the executor is gone")
        return write(self, df, kind)

    monkeypatch.setattr(rs.ResultTable, "_write", dies)
    import pytest
    with pytest.raises(RuntimeError):
        ss.commit_batch(t, pages, 0)
    assert t.read() is None and t.side("quarantine") is None
    monkeypatch.undo()
    ss.commit_batch(t, pages, 0)
    ss.commit_batch(t, pages, 0)
    content = ss.pg.extract_pages(pages, ss.CORPUS)
    assert t.read().count() == ss.pg.good_pages(content).count() == 20
    assert {r.page_id for r in t.side("quarantine").collect()} == {900, 901, 902} and t.side("quarantine").count() == 3


# ---------------------------------------------------------------------------
# expiring results and rolling rates: the stream equals the batch
# ---------------------------------------------------------------------------

SCRIPT = [  # files in arrival order: (key, seconds); rows of a file arrive out of order, some after the next file's
    [("a", 0), ("a", 30), ("b", 50), ("a", 20), ("a", 0)],
    [("a", 130), ("b", 40), ("a", 61), ("c", 100), ("a", 59)],
    [("b", 111), ("a", 190), ("b", 160), ("a", 125), ("a", 180), ("a", 181)],
    [("late", 5), ("a", 400), ("c", 399), ("b", 350)],
    [("end", 5000)],
]


def scripted(spark, tmp_path):
    from datetime import datetime, timedelta
    start = datetime(2024, 1, 1)
    for i, rows in enumerate(SCRIPT):
        df = spark.createDataFrame([(k, start + timedelta(seconds=s)) for k, s in rows], "client STRING, ts TIMESTAMP")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time
        time.sleep(1.1)  # files are taken by their time
    batch = spark.createDataFrame([(k, start + timedelta(seconds=s)) for rows in SCRIPT for k, s in rows if k not in ("late", "end")],
                                  "client STRING, ts TIMESTAMP")
    stream = spark.readStream.schema("client STRING, ts TIMESTAMP").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return batch, stream


def test_stateful_streams_equal_batch(spark, tmp_path):
    import pytest
    from credence.streaming import stateful as st
    batch, stream = scripted(spark, tmp_path)
    key = F.col("client")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for name, s, b in (("expiry", st.expiry_stream(stream, key, "ts", 60, "90 seconds"), st.expiry(batch, key, "ts", 60)),
                           ("rate", st.rolling_rate_stream(stream, key, "ts", 60, "90 seconds", 2), st.rolling_rate(batch, key, "ts", 60, 2))):
            q = (s.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
                 .option("checkpointLocation", str(tmp_path / f"cp-{name}")).start())
            q.awaitTermination()
            got = sorted(tuple(r) for r in spark.table(name).collect() if r.key != "end")
            assert got == sorted(tuple(r) for r in b.collect()) and len(got) > 3, name
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert pytest


def test_expiry_and_rate_against_brute_force(spark):
    import random
    from datetime import datetime, timedelta
    from credence.streaming import stateful as st
    r = random.Random(2)
    rows = [(r.choice("aab"), r.randrange(0, 4000)) for _ in range(900)] + [("hot", s) for s in range(0, 600)] * 2
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(k, start + timedelta(seconds=s, microseconds=r.randrange(10**6))) for k, s in rows], "k STRING, ts TIMESTAMP").repartition(4)
    zero = int(df.agg(F.min(F.unix_seconds(F.date_trunc("day", "ts")))).first()[0])
    got = sorted((x.key, x.second - zero, x.requests, x.stored_at - zero, x.scored) for x in st.expiry(df, F.col("k"), "ts", 100).collect())
    want = []
    for k in sorted({k for k, _ in rows}):
        at = None
        for s in sorted({s for key, s in rows if key == k}):
            new = at is None or s >= at + 100
            at = s if new else at
            want.append((k, s, rows.count((k, s)), at, new))
    assert got == want
    rate = sorted((x.key, x.second - zero, x.n) for x in st.rolling_rate(df, F.col("k"), "ts", 60, 5).collect())
    brute = [(k, s, sum(1 for key, x in rows if key == k and s - 60 < x <= s)) for k, s in sorted(set(rows))]
    assert rate == [x for x in brute if x[2] > 5]
