import os
import re
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bruteforce import words as bwords
from conftest import SF
from credence.functions import text as tx
from credence.operators import evaluate as ev
from credence.operators import keywords as kw

DSCHEMA = ("doc_id INT, title STRING, true_label STRING, predicted_label STRING, confidence DOUBLE, "
           "credibility_score INT, feature_count INT, positive_factors INT, negative_factors INT, error STRING")


def details(spark, pairs):
    rows = [(i, f"t{i}", t, p, 0.6, 50, 47, 1, 1, None) for i, (t, p) in enumerate(pairs)]
    return ev.detail_flags(spark.createDataFrame(rows, DSCHEMA))


def test_metrics_hand_values(spark):
    # 3 REAL, 3 FAKE, 2 UNCERTAIN true labels; predictions REAL 2, FAKE 4, UNCERTAIN 2
    pairs = [("REAL", "UNCERTAIN"), ("REAL", "REAL"), ("REAL", "UNCERTAIN"), ("FAKE", "FAKE"), ("FAKE", "FAKE"),
             ("FAKE", "FAKE"), ("UNCERTAIN", "REAL"), ("UNCERTAIN", "FAKE")]
    m = ev.metrics(details(spark, pairs)).first()
    assert (m.true_positives, m.false_positives, m.true_negatives, m.false_negatives) == (3, 0, 1, 0)
    assert m.binary_samples == 4 and m.overall_accuracy == 0.5
    assert m.binary_accuracy == m.precision == m.recall == m.f1_score == 1.0
    dist = {r.label: (r.n, r.percentage) for r in ev.prediction_distribution(details(spark, pairs)).collect()}
    assert dist == {"REAL": (2, 25.0), "FAKE": (4, 50.0), "UNCERTAIN": (2, 25.0)}


def test_empty_metrics_are_zero(spark):
    m = ev.metrics(details(spark, [("REAL", "UNCERTAIN")])).first()
    assert m.precision == m.recall == m.f1_score == m.binary_accuracy == 0.0


def test_tolerant_accuracy(spark):
    pairs = [("REAL", "REAL"), ("REAL", "UNCERTAIN"), ("REAL", "FAKE"), ("FAKE", "UNCERTAIN")]
    got = {r.true_label: (r.n, r.tolerant_correct, r.false_positives) for r in
           ev.tolerant_accuracy(details(spark, pairs)).collect()}
    assert got == {"REAL": (3, 2, 1), "FAKE": (1, 1, 0)}


def test_numbered_is_dense_and_ordered(spark):
    df = spark.range(0, 1000, 3).withColumnRenamed("id", "k").repartition(5)
    rows = ev.numbered(df, "k").orderBy("k").collect()
    assert [r.sample_id for r in rows] == list(range(1, len(rows) + 1))


def test_numbered_wide_rows_many_partitions(spark):
    """Wide and narrow plans of one table merge partitions differently; the
    numbers must not depend on it."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.range(600_000).select((F.col("id") * 7919 % 600_000).alias("k"), F.repeat(F.lit("x"), 512).alias("pad"))
        n = ev.numbered(df, "k")
        got = n.agg(F.count("*").alias("n"), F.count(F.when(F.col("sample_id") == F.col("k") + 1, 1)).alias("right"),
                    F.min(F.length("pad")).alias("w")).first()
        assert (got.n, got.right, got.w) == (600_000, 600_000, 512)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def placed_sizes(spark, df, **more):
    """Sizes of the ranges that the last stage of ``numbered`` joins."""
    n = ev.numbered(df, "k", **more)
    files = [f for f in n.inputFiles() if "numbered-" in f]
    return n, [r["count"] for r in spark.read.parquet(*files).groupBy("_range").count().collect()]


@pytest.mark.parametrize("rows", [2_000, 20_000, 60_000])
def test_ranges_follow_the_rows(spark, rows):
    """More rows, more ranges; the largest stays near its size, also where a third of all rows share one value."""
    k = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 7919 % rows).alias("k")
    n, sizes = placed_sizes(spark, spark.range(rows).select(k).repartition(6), rows_per_range=2_000)
    assert 0.5 * rows / 2_000 <= len(sizes) <= rows / 2_000 + 1 and max(sizes) <= 2 * 2_000
    got = sorted((r.sample_id, r.k) for r in n.collect())
    assert [i for i, _ in got] == list(range(1, rows + 1)) and [k for _, k in got] == sorted(k for _, k in got)


@pytest.mark.parametrize("kind", ["one", "two", "three", "distinct", "wide", "odd"])
def test_selection_narrows_exactly(spark, kind):
    n = 30_011 if kind == "odd" else 30_000
    i = F.col("id")
    v = {"one": F.lit(4.5), "two": F.when(i < n // 2, 1.0).otherwise(2.0), "three": F.when(i < 10, 1.0).when(i < n - 9, 5.0).otherwise(8.0),
         "distinct": (i * 7919 % n).cast("double"), "wide": F.pow(F.lit(1.02), i % 30_000), "odd": (i * i % 977).cast("double")}[kind]
    df = spark.range(n).select(v.alias("v")).repartition(5)
    assert ev.exact_median(df, "v", few=50).first()[0] == statistics.median([r.v for r in df.collect()])


def test_selection_of_every_rank(spark):
    df = spark.range(3_000).select((F.col("id") * F.col("id") % 701).cast("double").alias("v"))
    want = sorted(r.v for r in df.collect())
    for rank in (0, 1, 17, 1_500, 2_998, 2_999):
        assert ev.select_rank(df, rank, 3_000, few=10) == want[rank]


def test_numbered_ties_and_nulls(spark):
    df = spark.createDataFrame([(None,), (3,), (3,), (1,), (None,)], "k INT")
    rows = sorted((r.sample_id, r.k) for r in ev.numbered(df, "k").collect())
    assert rows == [(1, None), (2, None), (3, 1), (4, 3), (5, 3)]


def test_exact_median_of_ties_and_nothing(spark):
    df = spark.createDataFrame([(5.0,)] * 1000 + [(1.0,)] * 3 + [(None,)], "v DOUBLE")
    assert ev.exact_median(df, "v").first()[0] == 5.0
    assert ev.exact_median(df.where("v > 9"), "v").first()[0] is None
    assert ev.latency_stats(df.where("v > 9"), "v").first().median_time == 0.0


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_median(spark, n):
    vals = [float((i * 7919) % 1013) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in vals], "v DOUBLE").repartition(4)
    assert ev.exact_median(df, "v").first()[0] == statistics.median(vals)


def test_latency_stats(spark):
    e = spark.read.parquet(os.path.join(SF, "events.parquet")).where("event_type <> 'error'")
    vals = [r.value for r in e.collect()]
    r = ev.latency_stats(e, "value").first()
    assert r.median_time == pytest.approx(statistics.median(vals))
    assert r.throughput == pytest.approx(1 / statistics.mean(vals))


def test_top_terms_brute_force(spark):
    from credence.params import DEFAULT
    stop = set(DEFAULT.stopword_list())
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet")).select("doc_id", "text")
    d = kw.with_top_terms(docs.select("doc_id", "text", tx.words(F.col("text")).alias("w")), "w")
    for r in d.collect():
        terms = [re.sub(r"[^\w]|[\d_]", "", w.lower()) for w in bwords(r.text or "")]
        c = Counter(t for t in terms if t and t not in stop)
        exp = sorted(c.items(), key=lambda x: (-x[1], x[0].encode("utf-8")))[:10]
        assert [(x.term, x["count"]) for x in r.top] == exp, r.doc_id


def test_extractive_summary_keeps_text_order(spark):
    df = spark.createDataFrame([("Cats purr. Dogs bark loud. Cats sleep and cats eat. Birds fly.",)], "text STRING")
    d = kw.with_top_terms(df.select("text", tx.words(F.col("text")).alias("w")), "w")
    s = kw.with_summary(d, "text", "top", "s", n_sentences=2).first().s
    assert s == "Cats purr. Cats sleep and cats eat."
