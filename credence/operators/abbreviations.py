"""Learned sentence ends (T2/T3): abbreviations found without supervision.

A period after an abbreviation belongs to the word.  Such words are found by
counting (Kiss and Strunk, 2006): over the whole corpus, how often a word
stands with and without a period after it, against what would be expected if
periods fell anywhere.  The log-likelihood ratio is scaled by the word's
length (abbreviations are short), its inner periods, and the number of times
it stands without a period (an abbreviation hardly ever does).

Counting is one aggregation over all tokens, combined map-side, so a frequent
word is one row per task.  What is learned is a small table; it goes back into
the texts' scan as a hash set while it has at most ``MOST_LISTED`` words, and
by a join of the period words alone beyond that.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions import text as tx
from credence.session import stored

#: least score of an abbreviation, and the chance of a period after one (fixed values of the published method)
LEAST_SCORE, PERIOD_CHANCE = 0.3, 0.99
#: an abbreviation table of so many words is tested in place, a larger one is joined
MOST_LISTED = 50_000

OPENING, CLOSING = r"""^["'(\[]+""", r"""[,;:!?"')\]]+$"""
#: the same in a text of one space between tokens and one in front
OPENINGS, CLOSINGS = r""" ["'(\[]++""", r"""[,;:!?"')\]]++(?![^ ])"""
ENDING = r""" ([^ ]*[.!?]["')\]]*+)(?= )"""
FINAL_PERIOD = r"""[.]["')\]]*$"""
WORD = r"^\p{L}[\p{L}.]*$"


def bare(token: Column) -> Column:
    """A token without opening marks and what closes after it, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(token, OPENING, ""), CLOSING, ""))


def type_of(token: Column) -> Column:
    """The word before a token's final period (closing quotes may follow);
    null where there is none."""
    b = bare(token)
    w = F.substr(b, F.lit(1), F.length(b) - 1)
    return F.when(token.rlike(FINAL_PERIOD) & b.endswith(".") & w.rlike(WORD), w)


def period_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, with_period, without_period) of the corpus' words.  Texts are
    cleaned as a whole and tokens counted as they are; what a word is, is
    asked once for each different token."""
    t = F.regexp_replace(F.concat(F.lit(" "), tx.spaced(F.coalesce(F.col(text_col), F.lit("")))), OPENINGS, " ")
    t = F.lower(F.regexp_replace(t, CLOSINGS, ""))  # every token as bare() makes it
    t = df.select(F.explode(tx.split_spaced(t)).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    ends = F.col("b").endswith(".")
    t = t.select(F.when(ends, F.substr("b", F.lit(1), F.length("b") - 1)).otherwise(F.col("b")).alias("word"), ends.alias("p"), "n")
    return t.where(F.col("word").rlike(WORD)).groupBy("word").agg(
        F.sum(F.when(F.col("p"), F.col("n")).otherwise(0)).alias("with_period"),
        F.sum(F.when(F.col("p"), 0).otherwise(F.col("n"))).alias("without_period"))


def learn(df: DataFrame, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """(word, with_period, without_period, score) of the abbreviations."""
    counts = period_counts(df, text_col)
    total = counts.agg(F.sum(F.col("with_period") + F.col("without_period")).alias("n"), F.sum("with_period").alias("p"))
    c = counts.where("with_period > 0").join(F.broadcast(total))  # one row
    a, ab = F.col("with_period") + F.col("without_period"), F.col("with_period")
    p1 = F.col("p") / F.col("n")
    rest = F.when(a == ab, F.lit(0.0)).otherwise((a - ab) * F.log(F.greatest(1 - p1, F.lit(1e-300))))
    null = ab * F.log(p1) + rest
    alt = ab * F.lit(math.log(PERIOD_CHANCE)) + (a - ab) * F.lit(math.log(1 - PERIOD_CHANCE))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = (F.length("word") - inner).cast("double")
    score = -2 * (null - alt) * F.exp(-letters) * (inner + 1) * F.pow(letters, -F.col("without_period").cast("double"))
    return c.select("word", "with_period", "without_period", score.alias("score")).where(F.col("score") >= least)


def sentence_count(spaced_text: Column, abbreviations: list[str]) -> Column:
    """T2 from a text of ``tx.spaced`` with a list of abbreviations: only
    tokens that may end a sentence are looked at."""
    if not abbreviations:
        return tx.sentence_count(spaced_text)
    ends = F.regexp_extract_all(F.concat(F.lit(" "), spaced_text), F.lit(ENDING), 1)
    inner = F.size(F.filter(ends, lambda w: ~F.coalesce(type_of(w).isin(abbreviations), F.lit(False))))
    return F.when(spaced_text == "", F.lit(0)).otherwise(inner + 1)


def sentence_stats(df: DataFrame, key: str, text_col: str, abbreviations: DataFrame, most_listed: int = MOST_LISTED) -> DataFrame:
    """(key, n_tokens, sentence_count): T1/T2 with learned abbreviations."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    listed = [r.word for r in abbreviations.select("word").limit(most_listed + 1).collect()]
    if len(listed) <= most_listed:
        t = F.col("t")
        n = F.when(t == "", F.lit(0)).otherwise(tx.char_count(t, " ") + 1)
        return df.select(key, tx.materialize(tx.spaced(text)).alias("t")).select(
            key, n.alias("n_tokens"), sentence_count(t, listed).alias("sentence_count"))
    d = df.select(F.col(key), tx.words(text).alias("w"))
    d = d.withColumn("_row", F.monotonically_increasing_id())
    d = d.select(key, "_row", "w", tx.materialize(tx.sentence_end_flags(F.col("w"))).alias("e"))
    inner = F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))
    ends = F.array_compact(F.zip_with(inner, F.slice("e", 1, F.size(inner)), lambda w, f: F.when(f, type_of(w))))
    d = stored(d.select(key, "_row", F.size("w").alias("n_tokens"), tx.sentence_count_from_flags(F.col("e")).alias("_s"), ends.alias("_ends")))
    words = d.select("_row", F.explode("_ends").alias("word"))
    taken = words.join(abbreviations.select("word"), "word").groupBy("_row").agg(F.count(F.lit(1)).alias("_no"))
    return d.join(taken, "_row", "left").select(
        key, "n_tokens", (F.col("_s") - F.coalesce("_no", F.lit(0))).cast("int").alias("sentence_count"))
