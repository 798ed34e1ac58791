"""Explanations: factor lists, credibility score, summary,
key concerns and recommendations as nested column expressions.

Every factor is ``struct(factor, description, importance, icon)``; the lists
are ``array_compact(array(when(cond, factor), ...))`` in the fixed order, so
the whole explanation is still a per-row projection (no explode, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.params import (DEFAULT, DESC_AUTHOR_PREFIX, DESC_BALANCED, DESC_CAPS, DESC_CLICKBAIT,
                             DESC_DATE, DESC_EMOTIONAL, DESC_EXTREME, DESC_LACKS_SOURCES, DESC_NO_AUTHOR,
                             DESC_NO_DATE, DESC_PUNCT, DESC_QUOTES, DESC_READ_GOOD, DESC_READ_POOR,
                             DESC_SUBJECTIVE, DESC_TRUSTED, DESC_UNRELIABLE, DESC_URLS, ICON_OK, ICON_WARN,
                             IMPORTANCE, REC_ALWAYS, REC_CITATIONS, REC_CLICKBAIT, REC_MANY, REC_NO_AUTHOR,
                             REC_UNRELIABLE, SUMMARY_LIKELY_FAKE, SUMMARY_LIKELY_REAL, SUMMARY_POSSIBLY_REAL,
                             SUMMARY_POTENTIALLY_FAKE, SUMMARY_UNCERTAIN, Params)
from credence.functions.text import matched_keywords

FACTOR_TYPE = "struct<factor:string,description:string,importance:string,icon:string>"


def factor(name: str, description, importance: str, icon: str) -> Column:
    desc = description if isinstance(description, Column) else F.lit(description)
    return F.struct(F.lit(name).alias("factor"), desc.alias("description"),
                    F.lit(importance).alias("importance"), F.lit(icon).alias("icon"))


def _f(name: str) -> Column:
    return F.col(name)


def _compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items)).cast(f"array<{FACTOR_TYPE}>")


# --- G1-G3 ------------------------------------------------------------------

def source_factors_pos() -> list[Column]:
    authors = F.coalesce(_f("authors"), F.array().cast("array<string>"))
    author_text = F.when(F.size(authors) > 0, F.array_join(F.slice(authors, 1, 2), ", ")).otherwise(F.lit("Unknown"))
    return [
        F.when(_f("is_trusted_domain") == 1, factor("Trusted Domain", DESC_TRUSTED, "high", ICON_OK)),
        F.when(_f("has_author") == 1, factor("Author Present", F.concat(F.lit(DESC_AUTHOR_PREFIX), author_text),
                                             "medium", ICON_OK)),
        F.when(_f("has_publish_date") == 1, factor("Publication Date", DESC_DATE, "low", ICON_OK)),
    ]


def source_factors_neg() -> list[Column]:
    return [
        F.when((_f("is_trusted_domain") != 1) & (_f("is_unreliable_domain") == 1),
               factor("Unreliable Domain", DESC_UNRELIABLE, "critical", ICON_WARN)),
        F.when(_f("has_author") != 1, factor("No Author", DESC_NO_AUTHOR, "medium", ICON_WARN)),
        F.when(_f("has_publish_date") != 1, factor("Missing Date", DESC_NO_DATE, "low", ICON_WARN)),
    ]


# --- G4-G7 ------------------------------------------------------------------

def _flesch() -> Column:
    return F.coalesce(_f("flesch_reading_ease"), F.lit(50.0))


def quality_factors_pos() -> list[Column]:
    pre, post = DESC_QUOTES.split("{n}")
    fl = _flesch()
    return [
        F.when(_f("quote_count") > 2, factor("Citations Present",
                                             F.concat(F.lit(pre), _f("quote_count").cast("string"), F.lit(post)),
                                             "medium", ICON_OK)),
        F.when((fl >= 30) & (fl <= 80), factor("Appropriate Readability", DESC_READ_GOOD, "low", ICON_OK)),
    ]


def quality_factors_neg() -> list[Column]:
    fl = _flesch()
    return [
        F.when((_f("quote_count") <= 2) & (_f("word_count") > 100),
               factor("Lacks Citations", DESC_LACKS_SOURCES, "medium", ICON_WARN)),
        F.when(~((fl >= 30) & (fl <= 80)), factor("Unusual Readability", DESC_READ_POOR, "low", ICON_WARN)),
        F.when(_f("capital_ratio") > 0.15, factor("Excessive Capitalization", DESC_CAPS, "medium", ICON_WARN)),
        F.when(_f("url_ratio") > 0.05, factor("Excessive URLs", DESC_URLS, "low", ICON_WARN)),
    ]


# --- G8-G10 -----------------------------------------------------------------

def sentiment_factors_pos() -> list[Column]:
    return [F.when(_f("text_subjectivity") < 0.5, factor("Objective Tone", DESC_BALANCED, "medium", ICON_OK))]


def sentiment_factors_neg() -> list[Column]:
    subj = _f("text_subjectivity")
    return [
        F.when((subj >= 0.5) & (subj > 0.7), factor("High Subjectivity", DESC_SUBJECTIVE, "medium", ICON_WARN)),
        F.when(_f("emotional_word_ratio") > 0.03, factor("Emotional Language", DESC_EMOTIONAL, "medium", ICON_WARN)),
        F.when(F.abs(_f("text_polarity")) > 0.5, factor("Extreme Sentiment", DESC_EXTREME, "low", ICON_WARN)),
    ]


# --- G11-G12 ----------------------------------------------------------------

def clickbait_factors_neg(params: Params = DEFAULT) -> list[Column]:
    pre, post = DESC_CLICKBAIT.split("{keywords}")
    title_lower = F.lower(F.coalesce(_f("title"), F.lit("")))
    found = F.array_join(F.slice(matched_keywords(title_lower, params.clickbait_keywords), 1, 3), ", ")
    ppre, ppost = DESC_PUNCT.split("{n}")
    return [
        F.when(_f("clickbait_keyword_count") > 0,
               factor("Clickbait Language", F.concat(F.lit(pre), found, F.lit(post)), "high", ICON_WARN)),
        F.when(_f("exclamation_ratio") > 0.01,
               factor("Excessive Punctuation",
                      F.concat(F.lit(ppre), _f("exclamation_count").cast("string"), F.lit(ppost)),
                      "medium", ICON_WARN)),
    ]


def positive_factors() -> Column:
    return _compact(*source_factors_pos(), *quality_factors_pos(), *sentiment_factors_pos())


def negative_factors(params: Params = DEFAULT) -> Column:
    return _compact(*source_factors_neg(), *quality_factors_neg(), *sentiment_factors_neg(),
                    *clickbait_factors_neg(params))


# --- G14-G19 ----------------------------------------------------------------

def _weight(importance: Column) -> Column:
    e = F.lit(5)
    for name, w, _ in reversed(IMPORTANCE):
        e = F.when(importance == name, F.lit(w)).otherwise(e)
    return e


def _rank(importance: Column) -> Column:
    e = F.lit(3)
    for name, _, r in reversed(IMPORTANCE):
        e = F.when(importance == name, F.lit(r)).otherwise(e)
    return e


def credibility_score(pos: Column, neg: Column) -> Column:
    """50 + weights of positives - weights of negatives, clamped once."""
    sp = F.aggregate(pos, F.lit(0), lambda a, x: a + _weight(x["importance"]))
    sn = F.aggregate(neg, F.lit(0), lambda a, x: a + _weight(x["importance"]))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(50) + sp - sn))


def summary_text(prediction: Column, score: Column, is_fake: Column) -> Column:
    """One of five templates."""
    def tpl(t: str) -> Column:
        a, b = t.split("{score}")
        return F.concat(F.lit(a), score.cast("string"), F.lit(b))

    return (F.when(prediction == "UNCERTAIN", tpl(SUMMARY_UNCERTAIN))
            .when(is_fake & (score < 30), tpl(SUMMARY_LIKELY_FAKE))
            .when(is_fake, tpl(SUMMARY_POTENTIALLY_FAKE))
            .when(score > 70, tpl(SUMMARY_LIKELY_REAL))
            .otherwise(tpl(SUMMARY_POSSIBLY_REAL)))


def key_concerns(neg: Column, top: int = 5) -> Column:
    """Stable sort of negatives by importance rank, first ``top``."""
    keyed = F.transform(neg, lambda x, i: F.struct(_rank(x["importance"]).alias("r"), i.alias("i"),
                                                   F.concat(x["icon"], F.lit(" "), x["factor"]).alias("label")))
    return F.transform(F.slice(F.array_sort(keyed), 1, top), lambda x: x["label"])


def recommendations(neg: Column) -> Column:
    """One fixed line plus one per concern type present."""
    names = F.transform(neg, lambda x: x["factor"])
    return F.array_compact(F.array(
        F.lit(REC_ALWAYS),
        F.when(F.array_contains(names, "Unreliable Domain"), F.lit(REC_UNRELIABLE)),
        F.when(F.array_contains(names, "No Author"), F.lit(REC_NO_AUTHOR)),
        F.when(F.array_contains(names, "Clickbait Language"), F.lit(REC_CLICKBAIT)),
        F.when(F.array_contains(names, "Lacks Citations"), F.lit(REC_CITATIONS)),
        F.when(F.size(neg) > 3, F.lit(REC_MANY)),
    ))


def explain(df: DataFrame, params: Params = DEFAULT, is_fake_col: str | None = None) -> DataFrame:
    """Add the explanation columns to a scored feature table.

    Needs the feature columns, ``prediction``, ``confidence``, and the content
    columns ``title`` and ``authors`` (missing ones count as empty).
    """
    cols = set(df.columns)
    # the content record's own 'summary' field only feeds has_summary; the
    # explanation's summary text takes its name
    base = df.drop("summary") if "summary" in cols else df
    if "title" not in cols:
        base = base.withColumn("title", F.lit(""))
    if "authors" not in cols:
        base = base.withColumn("authors", F.array().cast("array<string>"))
    s1 = base.select("*", positive_factors().alias("positive_factors"),
                     negative_factors(params).alias("negative_factors"))
    pos, neg = F.col("positive_factors"), F.col("negative_factors")
    is_fake = F.col("prediction") == "FAKE"
    if is_fake_col:
        is_fake = F.coalesce(F.col(is_fake_col), F.lit(False)) | is_fake
    s2 = s1.select("*", credibility_score(pos, neg).alias("credibility_score"))
    score = F.col("credibility_score")
    out = s2.select(
        "*",
        summary_text(F.col("prediction"), score, is_fake).alias("summary"),
        F.struct(F.size(pos).alias("positive"), F.size(neg).alias("negative")).alias("factor_count"),
        key_concerns(neg).alias("key_concerns"),
        recommendations(neg).alias("recommendations"),
    )
    drop = [c for c in ("title", "authors") if c not in cols]
    return out.drop(*drop) if drop else out


def explanation_struct() -> Column:
    """The nested explanation record (G20) of an explained row."""
    return F.struct(
        F.col("summary"), F.col("prediction"), F.col("confidence"), F.col("credibility_score"),
        F.col("positive_factors"), F.col("negative_factors"), F.col("factor_count"),
        F.col("key_concerns"), F.col("recommendations"),
    )
