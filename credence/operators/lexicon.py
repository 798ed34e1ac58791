"""A sentiment lexicon learned by association.

A word's polarity is how much more often it stands near words that are known
to be good than near words that are known to be bad (pointwise mutual
information, Turney 2002): two passes over the corpus, one that counts words
within ``SPAN`` tokens of a seed, one that counts the seeds themselves.  Both
are aggregations combined map-side; only words that meet a seed are shuffled,
so frequent words far from any seed cost nothing.  The learned table has the
columns that ``features.lexicon_sentiment`` joins on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions.text import materialize
from credence.operators.features import sentiment_tokens
from credence.params import DEFAULT, Params

#: tokens on each side of a seed; least number of meetings; |polarity| in bits that counts as 1
SPAN, LEAST_MEETINGS, FULL_BITS = 5, 3, 4.0


def seeds(params: Params = DEFAULT) -> tuple[list[str], list[str]]:
    """Good and bad words of the built-in lexicon."""
    return ([w for w, p, _, _ in params.lexicon if p > 0], [w for w, p, _, _ in params.lexicon if p < 0])


def meetings(df: DataFrame, text_col: str, params: Params = DEFAULT, span: int = SPAN) -> DataFrame:
    """(word, good, bad): how often a word stands within ``span`` tokens of
    a good and of a bad seed; a word near two seeds meets both."""
    good, bad = seeds(params)
    t = df.select(materialize(sentiment_tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("tk"))
    known = F.array(*[F.lit(w) for w in good + bad])
    t = t.where(F.arrays_overlap("tk", known))  # a hash test; other texts go no further
    at = t.select("tk", F.posexplode("tk").alias("i", "seed")).where(F.col("seed").isin(good + bad))
    near = at.select(F.col("seed").isin(good).alias("g"), F.explode(F.concat(
        F.slice("tk", F.greatest(F.col("i") + 1 - span, F.lit(1)), F.least(F.col("i"), F.lit(span))),
        F.slice("tk", F.col("i") + 2, span))).alias("word"))
    return near.groupBy("word").agg(F.count(F.when(F.col("g"), 1)).alias("good"), F.count(F.when(~F.col("g"), 1)).alias("bad"))


def learn(df: DataFrame, text_col: str = "text", params: Params = DEFAULT, span: int = SPAN, least: int = LEAST_MEETINGS) -> DataFrame:
    """(word, good, bad, polarity, subjectivity, intensity) of the words that
    meet seeds ``least`` times; seeds, negations and stop words stay out."""
    good, bad = seeds(params)
    m = meetings(df, text_col, params, span)
    total = m.agg(F.sum("good").alias("_g"), F.sum("bad").alias("_b"))
    skip = [*good, *bad, *params.negations, *params.stopword_list()]
    m = m.where((F.col("good") + F.col("bad") >= least) & ~F.col("word").isin(skip)).join(F.broadcast(total))  # one row
    return m.select("word", "good", "bad", polarity(F.col("good"), F.col("bad"), F.col("_g"), F.col("_b")).alias("polarity")).select(
        "*", F.abs("polarity").alias("subjectivity"), F.lit(1.0).alias("intensity"))


def polarity(good: Column, bad: Column, all_good: Column, all_bad: Column) -> Column:
    """The difference of the two mutual informations in bits (half a meeting
    added to each count), scaled and held to -1 .. 1."""
    bits = F.log2(((good + 0.5) * (all_bad + 0.5)) / ((bad + 0.5) * (all_good + 0.5)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), bits / FULL_BITS))
