"""Learned tables, lists as tables, sub-words and the batched model."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF, SF01
from credence.operators import abbreviations as ab
from credence.operators import domains as dm
from credence.operators import features as ft
from credence.operators import lexicon as lx
from credence.operators import subword as sw

PROSE = ["Dr. Smith met Mr. Jones at the clinic today.", "The clinic is open to the public.", "Dr. Jones said that he met the public.",
         "Mr. Smith left the clinic, e.g. at noon.", "He said that Smith is open to it, e.g. today.", "Jones left at noon with Dr. Brown.",
         "Today at noon Brown and Jones saw the public at the clinic too"] * 30


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(3)


def test_abbreviations_are_learned(spark):
    d = docs(spark, PROSE)
    got = {r.word: (r.with_period, r.without_period) for r in ab.learn(d).collect()}
    assert {"dr", "mr", "e.g"} <= set(got) and not {"noon", "clinic", "public", "brown", "today"} & set(got)
    assert got["dr"] == (90, 0)
    assert all(r.score >= ab.LEAST_SCORE for r in ab.learn(d).collect())


@pytest.mark.parametrize("most", [ab.MOST_LISTED, 0])
def test_dr_smith_is_one_sentence(spark, most):
    """In place and by join alike."""
    learned = ab.learn(docs(spark, PROSE))
    texts = ["Dr. Smith left.", "Dr. Smith left. Mr. Jones stayed.", "He met (Dr. Brown). She asked \"Mr. Who?\" It rained.", "", "mr.", None,
             "Was it Dr.? Yes.", "No. Yes."]
    d = spark.createDataFrame(list(enumerate(texts)) + [(7, "No. Yes.")], "doc_id LONG, text STRING")
    got = sorted((r.doc_id, r.sentence_count) for r in ab.sentence_stats(d, "doc_id", "text", learned, most).collect())
    assert got == [(0, 1), (1, 2), (2, 3), (3, 0), (4, 1), (5, 0), (6, 2), (7, 2), (7, 2)]


def test_abbreviation_scores_by_hand(spark):
    d = docs(spark, ["aa. bb cc.", "aa. bb dd", "bb bb. dd"])
    n, periods = 9, 4
    p1 = periods / n

    def score(a, k):
        null = k * math.log(p1) + (a - k) * math.log(1 - p1)
        alt = k * math.log(0.99) + (a - k) * math.log(0.01)
        return -2 * (null - alt) * math.exp(-2) * 2 ** -(a - k)

    got = {r.word: r.score for r in ab.learn(d, least=-100).collect()}
    assert got == pytest.approx({"aa": score(2, 2), "cc": score(1, 1), "bb": score(4, 1)})
    assert ab.learn(docs(spark, ["no period here"])).count() == 0 and ab.learn(docs(spark, PROSE).limit(0)).count() == 0


def test_lexicon_learns_the_company_of_seeds(spark):
    texts = ["the meal was excellent and tasty and cheap", "a tasty meal, really wonderful", "great tasty food"] * 5 + [
        "the room was terrible and moldy and cheap", "awful moldy walls", "a horrible moldy smell"] * 5 + ["nothing here at all"] * 5
    lex = {r.word: r for r in lx.learn(docs(spark, texts)).collect()}
    assert lex["tasty"].polarity > 0.5 and lex["moldy"].polarity < -0.5 and abs(lex["cheap"].polarity) < 0.2
    assert "nothing" not in lex and "terrible" not in lex and "the" not in lex
    good, bad = (set(x) for x in lx.seeds())
    count = Counter()
    for t in texts:
        w = re.sub("[^a-z' ]", "", t.lower()).split()
        for i, s in enumerate(w):
            for x in w[max(0, i - lx.SPAN):i] + w[i + 1:i + 1 + lx.SPAN]:
                count[x, "g"] += s in good
                count[x, "b"] += s in bad
    assert {w: (r.good, r.bad) for w, r in lex.items()} == {w: (count[w, "g"], count[w, "b"]) for w in lex}
    scored = {r.doc_id: r.polarity for r in ft.lexicon_sentiment(
        docs(spark, ["a tasty thing", "a moldy thing", "not tasty", "nothing"]), "doc_id", "text", lx.learn(docs(spark, texts))).collect()}
    assert scored[0] > 0.5 > 0 > scored[1] and scored[2] < 0 and scored[3] == 0.0


def test_domain_table_of_100_000_names(spark):
    names = spark.range(100_000).select(F.format_string("site%d.example", "id").alias("name"),
                                        F.when(F.col("id") % 2 == 0, "trusted").otherwise("unreliable").alias("kind"))
    more = spark.createDataFrame([("example", "unreliable"), ("News.Site7.Example.", "trusted"), ("co.uk", "unreliable"), ("bbc.co.uk:443", "trusted"),
                                  ("dup.org", "unreliable"), ("dup.org", "trusted"), ("", "trusted")], "name string, kind string")
    hosts = {"site4.example": 1, "www.site4.example:8080": 1, "site7.example": 0, "a.news.site7.example": 1, "NEWS.site7.example": 1,
             "xsite4.example": 0, "user@site4.example": 1, "bbc.co.uk": 1, "abbc.co.uk": 0, "x.dup.org": 1, "site4.example.org": None,
             "org": None, "": None, "site4.example.": 1}
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)] + [(99, None), (100, "site4.example")], "id INT, domain STRING")
    out = dm.source_flags(df, names.unionByName(more))
    got = {r.id: (r.is_trusted_domain, r.is_unreliable_domain, r.domain_kind) for r in out.collect()}
    for i, (h, trusted) in enumerate(hosts.items()):
        want = (0, 0, None) if trusted is None else (trusted, 1 - trusted, "trusted" if trusted else "unreliable")
        assert got[i] == want, h
    assert got[99] == (0, 0, None) and got[100][0] == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_subwords_against_the_tokenizer(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(sw.default_tokenizer())
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 3000)], "doc_id LONG, text STRING"))
    for r in d.select("text", sw.subword_ids(F.col("text"), sw.default_tokenizer()).alias("s")).collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert r.s.n == len(ids) and r.s.ids == ids[:512]


def test_subwords_hold_few_texts_as_objects():
    import tracemalloc
    import pyarrow as pa
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(sw.default_tokenizer())
    texts = pa.array(["zq " * 1500, None, ""] * 700)
    tracemalloc.start()
    out = sw.encode_texts(texts, tok, 512)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 2100 and out[1].as_py() == {"n": 0, "ids": []} and out[0].as_py()["n"] >= 1500
    assert peak < 10e6, peak  # all ids of all texts as lists: 14 MB at least


def test_batch_classifier_on_held_out_documents(spark):
    from credence.plans import catalog as ct
    out = ct.q_document_classify(spark, SF01)
    lab = spark.read.parquet(f"{SF01}/labels.parquet").join(out, "doc_id").where("held_out").select(
        F.when(F.col("quality") == 1, "REAL").otherwise("FAKE").alias("y"), "prediction", "confidence", "fake_probability", "real_probability")
    rows = lab.collect()
    right = sum(r.y == r.prediction for r in rows) / len(rows)
    assert len(rows) > 50 and right >= 0.9, right
    assert all(abs(r.fake_probability + r.real_probability - 1) < 1e-5 and r.confidence >= 0.5 for r in rows)
    assert {r.prediction for r in rows} == {"REAL", "FAKE"}


def test_batch_model_equals_its_formula(spark):
    import numpy as np
    w = np.linspace(-1, 1, 50)
    d = spark.createDataFrame([([1, 2, 2, 49],), ([],), ([0] * 9,)], "ids ARRAY<INT>")
    p = sw.probability(w, 0.25, 6, 2)
    got = [r.p for r in d.select(p(sw.padded(F.col("ids"), 6)).alias("p")).collect()]
    z = [0.25 + w[[1, 2, 49]].sum(), 0.25, 0.25 + w[0]]
    assert got == pytest.approx([1 / (1 + math.exp(-x)) for x in z])


def test_tokens_are_counted_before_they_are_looked_at(spark):
    """Marks, cases and white space as token by token; the patterns run after the first count."""
    texts = ["(Dr. \"'x'\" e.g., A.) a. A, ΟΔΟΣ. ΟΔΟΣ !!!b b!! [c.] 7. d7", None, "", "a. a\n\na ''' . .."] * 3
    d = docs(spark, texts)
    t = d.select(F.explode(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\s ]+"), "")).alias("t"))
    b = t.select(ab.bare(F.col("t")).alias("b")).select(F.regexp_replace("b", r"\.$", "").alias("word"), F.col("b").endswith(".").alias("p"))
    want = {(r.word, r.n, r.o) for r in b.where(F.col("word").rlike(ab.WORD)).groupBy("word").agg(
        F.count_if("p").alias("n"), F.count_if(~F.col("p")).alias("o")).collect()}
    counts = ab.period_counts(d)
    assert {tuple(r) for r in counts.collect()} == want and ("e.g", 0, 0) not in want
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2  # before: one, over a row with two patterns for each token


def test_classifier_tokens_by_the_faster_pattern(spark):
    from pyspark.ml.feature import RegexTokenizer

    from credence.functions import text as tx
    from credence.operators.classifier import build_pipeline
    d = spark.createDataFrame([(f"Aé{c}漢.{c}{c} ÿ᠎​{c}x",) for c in tx.WS_CHARS] + [("",), (" \t",), ("b",)], "text STRING")
    now = build_pipeline().getStages()[0]
    assert now.getPattern() == tx.GAPS != tx.WHITESPACE
    plain = RegexTokenizer(inputCol="text", outputCol="_tok", pattern=tx.WHITESPACE, toLowercase=True)
    assert now.transform(d).collect() == plain.transform(d).collect()
