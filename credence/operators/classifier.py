"""The base text classifier, re-aimed as a Spark ML pipeline.

The transformer model of the behaviour we reproduce is not reproducible (its
head is randomly initialised and dropout stays on), so the base probability
comes from a model trained on the corpus itself:

    RegexTokenizer -> StopWordsRemover -> HashingTF -> IDF
      -> LogisticRegression,  P(FAKE) = probability[1]

The whole text is read: hashed counts have no length limit, so the token cut
of P18 is left to models that have one (``external_model``).

All stages are distributed Spark ML stages; fitting makes a few passes over
the term counts of the labelled rows (cached, not their texts), scoring is a per-row ``transform``.  A user model
can be plugged in instead with ``predict_batch_udf`` (Arrow batches) as long
as it yields a ``base_fake_probability`` column.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions.text import GAPS
from credence.operators.score import base_label
from credence.params import BATCH_SIZE, DEFAULT, Params


def build_pipeline(text_col: str = "text", params: Params = DEFAULT, num_features: int = 1 << 18,
                   max_iter: int = 50, reg: float = 0.01) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=GAPS, toLowercase=True),
        StopWordsRemover(inputCol="_tok", outputCol="_tok_kept", stopWords=list(params.stopword_list())),
        HashingTF(inputCol="_tok_kept", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_y", maxIter=max_iter, regParam=reg,
                           probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred"),
    ])


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", params: Params = DEFAULT,
        **kw) -> PipelineModel:
    """Fit on rows labelled REAL/FAKE (FAKE is the positive class).  The
    texts are read once: what the two fits share, and what is kept between
    them, are the hashed term counts."""
    train = labelled.where(F.col(label_col).isin("REAL", "FAKE")).select(
        F.col(text_col), (F.col(label_col) == "FAKE").cast("double").alias("_y"))
    *before, idf, regression = build_pipeline(text_col, params, **kw).getStages()
    counts = PipelineModel(before).transform(train).select("_tf", "_y").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        weights = idf.fit(counts)
        return PipelineModel([*before, weights, regression.fit(weights.transform(counts))])
    finally:
        counts.unpersist()


def predict(model: PipelineModel, df: DataFrame, params: Params = DEFAULT, batch: bool = False) -> DataFrame:
    """Add ``base_fake_probability`` and the base label (P20; P21 when
    ``batch``: no UNCERTAIN)."""
    out = model.transform(df)
    p = vector_to_array(F.col("_prob"))[1]
    keep = [c for c in df.columns]
    return out.select(*keep, p.alias("base_fake_probability"),
                      base_label(p, params.confidence_threshold, uncertain=not batch).alias("base_prediction"))


def external_model(make_predict_fn, batch_size: int = BATCH_SIZE):
    """P17 plug-in: a user model as an Arrow-batched ``predict_batch_udf``.

    ``make_predict_fn()`` is called once per Python worker (load the model
    there) and returns ``predict(texts: numpy.ndarray) -> numpy.ndarray`` of
    P(FAKE).  Apply the returned UDF to the combined text, cut with
    ``score.truncate_tokens`` if the model has a length limit, and
    name the result ``base_fake_probability``.  Rows decided by a trust
    override never need it: filter on ``score.needs_base_model()`` first.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import DoubleType

    return predict_batch_udf(make_predict_fn, return_type=DoubleType(), batch_size=batch_size)
