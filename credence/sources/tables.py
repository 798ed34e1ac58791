"""Table sources: the parquet corpus and the intake paths built on it.

Reads always name the columns they need, so the parquet scan prunes to them
(``ReadSchema`` in the plan) and row-group filters are pushed down.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.params import DEFAULT, Params

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DIRECT_TEXT_DOMAIN = "direct-text"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"])


def title_of(text):
    """Documents carry no title column: the first line of the text is used."""
    return F.substring_index(text, "\n", 1)


def as_content(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Text rows as content records: the domain is the literal 'direct-text'
    and there is never an author, date or image."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col(key),
        text.alias("text"),
        title_of(text).alias("title"),
        F.lit(DIRECT_TEXT_DOMAIN).alias("domain"),
        F.array().cast("array<string>").alias("authors"),
        F.lit(None).cast("string").alias("publish_date"),
    )


def text_intake(docs: DataFrame, params: Params = DEFAULT, key: str = "doc_id") -> DataFrame:
    """The direct-text path; keeps texts of at least ``min_text_length``
    characters."""
    return as_content(docs.where(F.length(F.coalesce(F.col("text"), F.lit(""))) >= params.min_text_length), key)


def text_rejects(docs: DataFrame, params: Params = DEFAULT, key: str = "doc_id") -> DataFrame:
    """Rows the direct-text path refuses (shorter than the minimum)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.where(F.length(text) < params.min_text_length).select(
        F.col(key), F.lit(f"text shorter than {params.min_text_length} characters").alias("error"))


def combined_text(title, text, always: bool = False):
    """The classifier input.  URL path: ``title + '. ' + text`` always;
    text path: only when the title is non-empty."""
    joined = F.concat(title, F.lit(". "), text)
    if always:
        return joined
    return F.when(title != "", joined).otherwise(text)


def labelled_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation intake: labelled documents as content records.

    The text is stripped, the title is its first line, the document's
    ``source`` is its domain; there are no authors or dates.  Unlike the
    direct-text path there is no minimum length.
    """
    from credence.functions.text import WS_CHARS

    from credence.plans.pipeline import spread

    docs = spread(read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"]))
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    j = docs.join(labels, "doc_id")
    text = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(WS_CHARS))
    return j.select(
        "doc_id", text.alias("text"), title_of(text).alias("title"),
        F.coalesce(F.col("source"), F.lit("")).alias("domain"),
        F.array().cast("array<string>").alias("authors"), F.lit(None).cast("string").alias("publish_date"),
        F.when(F.col("quality") == 1, F.lit("REAL")).otherwise(F.lit("FAKE")).alias("label"),
    )


#: what a derived title, text or description is made of (see ``enriched_content``)
BAIT_TITLE = "You won't believe what happens next: 7 facts that will shock you"
LINKED = ' See https://example.com/a?b=1 and http://t.example/x "said one" "said two".\n\nA second paragraph.'
EMOTIONAL = "SHOCKING outrageous horrifying terrifying disgusting bombshell, very good but not bad. "


def enriched_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the columns the corpus lacks, derived from doc_id:
    authors, date, images, description, keywords, summary, domains of every
    kind, clickbait titles, links and quotes, a base probability that is null
    now and then, and an UNCERTAIN label where there is none.  It reaches the
    branches that plain documents cannot."""
    from credence.plans.pipeline import spread

    docs = spread(read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"]))
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    j = docs.join(labels, "doc_id", "left")
    d, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))
    title = title_of(text)
    names = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    return j.select(
        "doc_id",
        F.when(d % 8 == 0, F.concat(text, F.lit(LINKED))).when(d % 8 == 1, F.concat(F.lit(EMOTIONAL), text)).otherwise(text).alias("text"),
        F.when(d % 7 == 0, F.lit(BAIT_TITLE)).when(d % 7 == 1, F.concat(title, F.lit("!!!"))).otherwise(title).alias("title"),
        F.when(d % 6 == 0, F.lit("www.reuters.com")).when(d % 6 == 1, F.lit("infowars.com")).when(d % 6 == 2, F.lit("news.bbc.co.uk"))
         .when(d % 6 == 3, F.concat(F.coalesce("source", F.lit("")), F.lit(".example.net"))).when(d % 6 == 4, F.lit("blog.example.co"))
         .otherwise(F.lit("")).alias("domain"),
        F.when(d % 5 == 0, names("A. Writer")).when(d % 5 == 1, names("A. Writer", "B. Writer", "C. Writer")).otherwise(names()).alias("authors"),
        F.when(d % 4 < 2, F.lit("2024-01-15")).alias("publish_date"),
        F.array_repeat(F.lit("img.png"), (d % 4).cast("int")).alias("images"),
        F.when(d % 9 == 0, F.concat(F.lit("About "), title)).otherwise(F.lit("")).alias("meta_description"),
        F.when(d % 9 < 3, names("one", "two")).otherwise(names()).alias("keywords"),
        F.when(d % 10 == 0, F.lit("A summary.")).otherwise(F.lit("")).alias("summary"),
        F.when(d % 13 != 0, (d * 37 % 101) / F.lit(100.0)).alias("base_fake_probability"),
        F.when(F.col("quality") == 1, "REAL").when(F.col("quality") == 0, "FAKE").otherwise("UNCERTAIN").alias("label"),
    )
