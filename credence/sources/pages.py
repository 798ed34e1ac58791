"""Crawled pages -> content records.

The crawl is an input table ``(page_id, url, html)``; fetching is not part of
the job.  Markup needs element depths, which JVM expressions cannot carry in
linear time, so pages are read by an Arrow-batched UDF (``html.read_page``),
one pass per page; everything else is column expressions in the same narrow
stage.  Scripts, styles, comments and page chrome are never looked at (a test
page holds ``<script>var t="</p>"``).

Two extractors exist, as in the behaviour we reproduce: a *primary* one that
keeps paragraph structure (the text units of the first article, or the
paragraphs of a page without one, joined by a blank line) and a *fallback*
one (all text nodes of the article, else the paragraphs, joined by spaces);
the fallback is used when the primary text is empty (S8).
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from credence.functions.text import words
from credence.operators.keywords import with_summary, with_top_terms
from credence.params import DEFAULT, ERROR_INVALID_URL, ERROR_NO_TEXT, ERROR_TOO_LARGE, Params
from credence.sources.html import decode_page, read_page

FALLBACK_IMAGES = 10  # the fallback extractor keeps so many images
VALID_URL = r"^(?i)https?://[^/?#]+"
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


LISTS = ("authors", "images", "raw_images", "videos", "meta_keywords")
PAGE_TYPE = T.StructType([T.StructField(name, T.ArrayType(T.StringType()) if name in LISTS else T.StringType())
                          for name in ("title", "primary", "fallback", "authors", "publish_date", "meta_description", "images",
                                       "raw_images", "top_image", "videos", "meta_keywords")])
#: fields that only the primary extractor has
MEDIA = ("top_image", "videos", "meta_keywords", "source_url")


#: pages that are Python objects at a time; the rest of a batch stays in Arrow
READ_ROWS = 64


@F.arrow_udf(PAGE_TYPE)
def _read_pages(html: pa.Array, url: pa.Array) -> pa.Array:
    made = [pa.array([], to_arrow_type(PAGE_TYPE))]
    for lo in range(0, len(html), READ_ROWS):
        part = zip(html.slice(lo, READ_ROWS).to_pylist(), url.slice(lo, READ_ROWS).to_pylist(), strict=True)
        made.append(pa.array([read_page(x, u) for x, u in part], made[0].type))
    return pa.concat_arrays(made)


def page_record(html: Column, url: Column) -> Column:
    """The struct of :func:`html.read_page`.  Not re-evaluated for filters on
    its fields: the UDF counts as non-deterministic."""
    return _read_pages.asNondeterministic()(html, url)


def source_url(url: Column) -> Column:
    """Scheme and authority."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)


@F.pandas_udf(T.StringType())
def _decode_pages(raw: pd.Series) -> pd.Series:
    return raw.map(decode_page)


def file_pages(spark: SparkSession, root: str, params: Params = DEFAULT, pattern: str = "*", scheme: str = "https") -> DataFrame:
    """S1/S9 over files: one page per file below ``root`` as (page_id, url,
    html, error).  The folders are the URL: ``root/host/path`` is
    ``scheme://host/path``; page_id is the URL's hash.

    The length filter reaches the scan, which never opens a page that is too
    large; such pages come from a listing alone and carry their error.  Bytes
    are decoded by :func:`html.decode_page`.  A file without any byte has no
    row: Spark's scans leave empty files out.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root))
    path = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    plain_root = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", root.rstrip("/")) + "/"
    url = F.concat(F.lit(f"{scheme}://"), F.substr(path, F.instr(path, F.lit(plain_root)) + F.lit(len(plain_root))))
    page = lambda d, html, error: d.select(F.xxhash64(url).alias("page_id"), url.alias("url"), html.alias("html"), error.alias("error"))
    most = params.max_content_size
    read = page(files.where(F.col("length") <= most), _decode_pages(F.col("content")), F.lit(None).cast("string"))
    large = page(files.where(F.col("length") > most), F.lit(None).cast("string"), F.lit(ERROR_TOO_LARGE))
    return read.unionByName(large)


def url_is_valid(url: Column) -> Column:
    """Scheme http/https (any case) and a non-empty authority."""
    return F.coalesce(url.rlike(VALID_URL), F.lit(False))


def url_domain(url: Column) -> Column:
    """S3: the authority lower-cased; port, userinfo and www. are kept."""
    return F.lower(F.regexp_extract(url, AUTHORITY, 1))


def page_errors(url: Column, html: Column, params: Params = DEFAULT) -> Column:
    """The error of a page before extraction, null when fine."""
    return (F.when(~url_is_valid(url), F.lit(ERROR_INVALID_URL))
            .when(F.octet_length(F.coalesce(html, F.lit(""))) > params.max_content_size, F.lit(ERROR_TOO_LARGE)))


def extract_pages(pages: DataFrame, params: Params = DEFAULT, key: str = "page_id") -> DataFrame:
    """One content record per page.

    Columns: key, url, domain, title, text, authors, publish_date,
    meta_description, images, extraction_method, error, top_image, videos,
    meta_keywords, source_url, keywords, summary.  The primary extractor's
    images are absolute URLs; the fallback's are as written, and it has none
    of the fields in ``MEDIA``.  Rows that fail (bad URL, too large, no text)
    keep an ``error`` and empty text; a page whose error is known beforehand,
    also one that the source gives in a column ``error``, is not read.
    """
    before = page_errors(F.col("url"), F.col("html"), params)
    before = F.coalesce(F.col("error"), before) if "error" in pages.columns else before
    s1 = pages.select(F.col(key), F.col("url"), F.col("html"), before.alias("_err0"))
    s2 = s1.select(F.col(key), F.col("url"), F.col("_err0"),
                   page_record(F.when(F.col("_err0").isNull(), F.col("html")).otherwise(F.lit("")), F.col("url")).alias("_p"))
    use_primary = F.length("_p.primary") > 0
    text = F.when(use_primary, F.col("_p.primary")).otherwise(F.col("_p.fallback"))
    err = F.coalesce(F.col("_err0"), F.when(text == "", F.lit(ERROR_NO_TEXT)))
    images = F.when(use_primary, F.col("_p.images")).otherwise(F.slice("_p.raw_images", 1, FALLBACK_IMAGES))
    none = F.array().cast("array<string>")
    record = s2.select(
        F.col(key), F.col("url"), url_domain(F.col("url")).alias("domain"), F.col("_p.title").alias("title"), text.alias("text"),
        F.col("_p.authors").alias("authors"), F.col("_p.publish_date").alias("publish_date"),
        F.col("_p.meta_description").alias("meta_description"), images.alias("images"),
        F.when(F.col("_err0").isNotNull(), F.lit(None).cast("string"))
         .when(use_primary, F.lit("paragraphs")).otherwise(F.lit("fallback")).alias("extraction_method"),
        err.alias("error"),
        F.when(use_primary, F.col("_p.top_image")).otherwise(F.lit("")).alias("top_image"),
        *[F.when(use_primary, F.col(f"_p.{c}")).otherwise(none).alias(c) for c in ("videos", "meta_keywords")],
        F.when(use_primary, source_url(F.col("url"))).otherwise(F.lit("")).alias("source_url"),
    )
    # The primary extractor also keeps keywords and a summary
    w = F.when(F.col("extraction_method") == "paragraphs", words(F.col("text"))).otherwise(F.array().cast("array<string>"))
    staged = with_summary(with_top_terms(record.withColumn("_w", w), "_w", "_top"), "text", "_top", "_summary")
    return staged.select(
        *[F.col(c) for c in record.columns], F.transform("_top", lambda x: x["term"]).alias("keywords"),
        F.when(F.col("extraction_method") == "paragraphs", F.col("_summary")).otherwise(F.lit("")).alias("summary"))


def both_texts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The texts of both extractors (``primary``, ``fallback``)."""
    s = pages.select(F.col(key), page_record(F.col("html"), F.lit("")).alias("_p"))
    return s.select(F.col(key), F.col("_p.primary").alias("primary"), F.col("_p.fallback").alias("fallback"))


def fallback_extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """S5 alone: the fallback extractor's record for every page."""
    s = pages.select(F.col(key), F.col("url"), page_record(F.col("html"), F.col("url")).alias("_p"))
    return s.select(F.col(key), F.col("url"), F.col("_p.title").alias("title"), F.col("_p.fallback").alias("text"),
                    F.col("_p.meta_description").alias("meta_description"),
                    F.slice("_p.raw_images", 1, FALLBACK_IMAGES).alias("images"))


def fenced_filter(df: DataFrame, cond: Column) -> DataFrame:
    """``df.where(cond)`` evaluated *after* ``df``'s projection.

    Catalyst pushes a filter below a deterministic projection by inlining the
    aliased expressions, so a condition on an extracted column would run the
    whole regex extraction twice (measured: 8x slower on the page path).  The
    filter references a non-deterministic column (the partition id), which
    keeps it above the projection; the column is dropped afterwards.
    """
    fenced = df.withColumn("_fence", F.spark_partition_id())
    return fenced.where(cond & (F.col("_fence") >= 0)).drop("_fence")


def good_pages(content: DataFrame) -> DataFrame:
    """Rows that may be scored."""
    return fenced_filter(content, F.col("error").isNull() & (F.col("text") != ""))


def quarantined(content: DataFrame) -> DataFrame:
    """Rows that may not be scored."""
    return fenced_filter(content, F.col("error").isNotNull() | (F.coalesce(F.col("text"), F.lit("")) == ""))
