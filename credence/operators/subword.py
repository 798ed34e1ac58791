"""Sub-word ids (P18) and a batched model over them.

A model with a length limit counts sub-words, not words.  The tokenizer is a
vocabulary file that exists on every worker (a parameter; nothing is trained
or copied); texts are encoded in Arrow batches, whole, and the ids are cut at
the limit.  The model is a logistic regression over which ids occur, fitted by
Spark ML on all labelled rows given; it predicts through
``predict_batch_udf``: each worker loads the weights once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from credence.operators.score import base_label
from credence.params import BATCH_SIZE, DEFAULT, Params

PAD = -1
#: texts that are Python objects at a time; the rest of a batch stays in Arrow
ENCODE_ROWS = 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def encode_texts(texts: pa.Array, tok, max_tokens: int) -> pa.Array:
    """struct(n, ids) of every text, ``ENCODE_ROWS`` texts at a time."""
    n, cut = np.zeros(len(texts), np.int32), []
    for lo in range(0, len(texts), ENCODE_ROWS):
        for i, t in enumerate(texts.slice(lo, ENCODE_ROWS).to_pylist(), lo):
            ids = tok.encode(t or "", add_special_tokens=False).ids
            n[i] = len(ids)
            cut.append(np.array(ids[:max_tokens], np.int32))
    edge = np.concatenate(([0], np.cumsum([len(x) for x in cut]))).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate([np.zeros(0, np.int32), *cut])))
    return pa.StructArray.from_arrays([pa.array(n), ids], ["n", "ids"])


def subword_ids(text: Column, path: str, max_tokens: int = DEFAULT.max_tokens) -> Column:
    """struct(n, ids): how many ids the whole text has, and the first
    ``max_tokens`` of them, without special tokens."""
    @F.arrow_udf("n int, ids array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        from tokenizers import Tokenizer

        return encode_texts(texts, _loaded(path, Tokenizer), max_tokens)

    return encode.asNondeterministic()(text)


_TOKENIZERS: dict = {}


def _loaded(path: str, kind):
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = kind.from_file(path)
    return _TOKENIZERS[path]


def fit(labelled: DataFrame, ids_col: str, label_col: str, vocabulary: int, max_iter: int = 40, reg: float = 0.01) -> tuple[np.ndarray, float]:
    """(weights by id, intercept) of P(FAKE), from rows labelled REAL/FAKE."""
    rows = labelled.where(F.col(label_col).isin("REAL", "FAKE")).select(
        F.transform(F.col(ids_col), lambda i: i.cast("string")).alias("_i"), (F.col(label_col) == "FAKE").cast("double").alias("_y"))
    counts = CountVectorizerModel.from_vocabulary([str(i) for i in range(vocabulary)], inputCol="_i", outputCol="_f")
    counts.setBinary(True)
    model = LogisticRegression(featuresCol="_f", labelCol="_y", maxIter=max_iter, regParam=reg).fit(counts.transform(rows))
    return np.asarray(model.coefficients.toArray()), float(model.intercept)


def probability(weights: np.ndarray, intercept: float, max_tokens: int, batch_size: int = BATCH_SIZE):
    """The model as an Arrow-batched UDF over padded ids (:func:`padded`)."""
    def make():
        def predict(ids: np.ndarray) -> np.ndarray:
            x = np.sort(ids.astype(np.int64), axis=1)
            first = np.ones(x.shape, bool)
            first[:, 1:] = x[:, 1:] != x[:, :-1]
            z = intercept + np.where(first & (x >= 0), weights[np.maximum(x, 0)], 0.0).sum(axis=1)
            return 1.0 / (1.0 + np.exp(-z))

        return predict

    return predict_batch_udf(make, return_type=DoubleType(), batch_size=batch_size, input_tensor_shapes=[[max_tokens]])


def padded(ids: Column, max_tokens: int) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(PAD), max_tokens)), 1, max_tokens)


def batch_classify(df: DataFrame, labelled: DataFrame, key: str, text_col: str = "text", label_col: str = "label",
                   path: str | None = None, params: Params = DEFAULT) -> DataFrame:
    """Every row of ``df`` (key, text) classified without UNCERTAIN by a
    model fitted on ``labelled`` (text, label)."""
    path = path or default_tokenizer()
    cut = lambda d, *more: d.select(*more, subword_ids(F.col(text_col), path, params.max_tokens).alias("s"))
    train = cut(labelled, label_col).select(label_col, F.col("s.ids").alias("ids"))
    train = train.persist(StorageLevel.MEMORY_AND_DISK)  # the fit reads it more than once
    try:
        weights, intercept = fit(train, "ids", label_col, vocabulary_size(path))
    finally:
        train.unpersist()
    p = probability(weights, intercept, params.max_tokens, 64)
    out = cut(df, key).select(key, F.col("s.n").alias("n_ids"), p(padded(F.col("s.ids"), params.max_tokens)).alias("p"))
    return out.select(key, "n_ids", base_label(F.col("p"), uncertain=False).alias("prediction"),
                      F.greatest(F.col("p"), 1 - F.col("p")).alias("confidence"),
                      F.col("p").alias("fake_probability"), (1 - F.col("p")).alias("real_probability"))
