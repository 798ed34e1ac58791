"""End-to-end plans: content -> features -> verdict -> explanation.

Every step is a per-row projection, so a whole analysis is one narrow stage
per input split: the plan reads only the columns it needs, never shuffles
and scoring and explanation never leave the JVM.  A small table stored in few
files yields few input splits; since this work is CPU-bound its rows are
spread over the cores by ``spread``, a no-op on tables of many files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.operators.explain import explain
from credence.operators.features import extract_features
from credence.operators.score import ensemble
from credence.params import DEFAULT, Params
from credence.sources import pages as pg
from credence.sources import tables as tb

BASE_COL = "base_fake_probability"


def spread(scan: DataFrame) -> DataFrame:
    """Round-robin a table scan over the cores when it has fewer files than
    cores.  Only the file listing is asked, so nothing runs while a query is
    built; it is applied to scans alone, never to a join."""
    files, cores = len(scan.inputFiles()), scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if files < cores else scan


def with_base_probability(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Use the given base probability column, or the configured default."""
    if BASE_COL in df.columns:
        return df
    return df.withColumn(BASE_COL, F.lit(float(params.default_base_probability)))


def score(content: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Features + ensemble verdict; content columns are kept."""
    feats = extract_features(with_base_probability(content, params), params)
    return ensemble(feats, BASE_COL, params)


def analyse(content: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Features + verdict + explanation."""
    return explain(score(content, params), params)


def document_content(spark: SparkSession, sf_dir: str, params: Params = DEFAULT) -> DataFrame:
    """Direct-text content (S11): texts of the minimum length and more."""
    return tb.text_intake(spread(tb.documents(spark, sf_dir)), params)


def all_document_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a content record, empty and short texts included."""
    return tb.as_content(spread(tb.documents(spark, sf_dir)))


def page_content(spark: SparkSession, sf_dir: str, params: Params = DEFAULT) -> DataFrame:
    return pg.extract_pages(spread(tb.read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])), params)


def analyse_documents(spark: SparkSession, sf_dir: str, params: Params = DEFAULT) -> DataFrame:
    return analyse(document_content(spark, sf_dir, params), params)


def analyse_pages(spark: SparkSession, sf_dir: str, params: Params = DEFAULT) -> DataFrame:
    return analyse(pg.good_pages(page_content(spark, sf_dir, params)), params)


MODEL_NOT_RUN = "NOT_RUN"


def score_with_classifier(content: DataFrame, model, params: Params = DEFAULT, url_path: bool = False) -> DataFrame:
    """Features -> base classifier only where the verdict needs it -> ensemble.

    A trust override decides a row without the base probability, so the
    model input of such rows is blanked in the same pass (no second branch,
    no recomputed features): the classifier then works on an empty string,
    and the row reports ``bert_prediction = 'NOT_RUN'``.  ``model`` is a
    fitted ``classifier.fit`` pipeline whose input column is ``text``.
    """
    from credence.operators import classifier as clf
    from credence.operators.score import needs_base_model

    feats = extract_features(content, params)
    model_text = F.when(needs_base_model(), tb.combined_text(F.col("title"), F.col("text"), always=url_path))
    staged = (feats.withColumn("_model_text", F.coalesce(model_text, F.lit("")))
              .withColumnRenamed("text", "_content_text").withColumnRenamed("_model_text", "text"))
    predicted = clf.predict(model, staged, params).drop("base_prediction", "text").withColumnRenamed(
        "_content_text", "text")
    predicted = predicted.withColumn(
        BASE_COL, F.when(needs_base_model(), F.col(BASE_COL)))
    scored = ensemble(predicted, BASE_COL, params)
    return scored.withColumn(
        "bert_prediction", F.when(needs_base_model(), F.col("bert_prediction")).otherwise(F.lit(MODEL_NOT_RUN)))
