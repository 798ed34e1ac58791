"""Quality classifier: naive Bayes support vectors (operator 3).

Features are indicators of the token unigrams and bigrams of a text, and of
the n-gram classes "one token three times in a row" and "every other token
the same, three times", hashed to ``2**BITS`` columns.  Each indicator is scaled by the log-count ratio of
its column between the classes (smoothed by ``ALPHA``), rows are scaled to
unit length, and a linear hinge-loss model is fitted by dual coordinate
descent.  The margin becomes a score by a logistic curve fitted on rows that
the descent did not see.

The fit takes a sample of at most about ``MAX_FIT`` labelled rows, chosen by
a hash of doc_id (a documented bound, it runs in one task); scoring covers
every whole text.  The model has a fixed size (``2**BITS`` weights).

Defined cases: null and empty texts have no features and get the score of
the bias alone; a null label is no label; without rows of both classes every
score is the share of label 1 among the labelled (0.5 without any); repeated
rows are scored one by one; a null doc_id is scored and never learned from;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm import textvec as tv
from credence.llm.common import plain

BITS = 18
ALPHA = 1.0
COST = 1.0
EPOCHS = 12
MAX_FIT = 8000
BIAS = 0.1  # value of the bias column


def features(texts: list, bits: int, spans: tv.Spans) -> tuple[np.ndarray, np.ndarray]:
    """(row offsets, columns): the distinct n-gram columns of each text."""
    classes, shift = tv.byte_classes(), np.uint64(64 - bits)
    offsets, cols = [np.zeros(1, np.int64)], []
    for lo, hi, buf, at in tv.chunks(texts):
        start, end = tv.tokens(buf, classes)
        h = spans.hashes(spans.prefix(buf), start, end)
        doc = tv.owners(start, at)
        same = doc[1:] == doc[:-1]
        two = tv.mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(0x632BE59BD9B4E019))[same]
        more_h, more_row = [h, two], [doc, doc[1:][same]]
        for number, lag in enumerate((1, 2)):  # a token three times, next to each other or every other one
            again = np.flatnonzero((h[2 * lag:] == h[lag:-lag]) & (h[lag:-lag] == h[:-2 * lag]) & (doc[2 * lag:] == doc[:-2 * lag]))
            more_h.append(np.full(len(again), tv.mix(np.array([number + 1], np.uint64))[0]))
            more_row.append(doc[again])
        ids = np.concatenate(more_h) >> shift
        row = np.concatenate(more_row).astype(np.uint64)
        u = np.unique((row << np.uint64(bits)) | ids)
        n = np.bincount((u >> np.uint64(bits)).astype(np.int64), minlength=hi - lo)
        offsets.append(offsets[-1][-1] + np.cumsum(n))
        cols.append((u & np.uint64((1 << bits) - 1)).astype(np.int32))
    return np.concatenate(offsets), np.concatenate(cols) if cols else np.zeros(0, np.int32)


def ratios(offsets, cols, y, bits: int, alpha: float) -> np.ndarray:
    row = np.repeat(np.arange(len(y)), np.diff(offsets))
    pos = np.bincount(cols[y[row] > 0], minlength=1 << bits) + alpha
    neg = np.bincount(cols[y[row] <= 0], minlength=1 << bits) + alpha
    return np.log(pos / pos.sum()) - np.log(neg / neg.sum())


def unit_rows(offsets, values) -> np.ndarray:
    """One over the length of each row, the bias column included."""
    sums = np.add.reduceat(np.concatenate((values ** 2, [0.0])), np.minimum(offsets[:-1], len(values)))
    sums = np.where(np.diff(offsets) > 0, sums, 0.0)
    return 1.0 / np.sqrt(sums + BIAS ** 2)


def margins(offsets, cols, w) -> np.ndarray:
    """``w`` = (ratios, weights, bias weight)."""
    r, weight, bias = w
    v = r[cols]
    scale = unit_rows(offsets, v)
    dots = np.add.reduceat(np.concatenate((v * weight[cols], [0.0])), np.minimum(offsets[:-1], len(v)))
    return (np.where(np.diff(offsets) > 0, dots, 0.0) + BIAS * bias) * scale


def descend(offsets, cols, y, r, cost: float, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss, the costs of the classes
    balanced: each step solves for one row's multiplier."""
    n = len(y)
    v = r[cols]
    scale = unit_rows(offsets, v)
    v = v * np.repeat(scale, np.diff(offsets))
    b = BIAS * scale
    q = 1.0  # squared length of a row
    upper = np.where(y > 0, cost * n / (2 * max(1, (y > 0).sum())), cost * n / (2 * max(1, (y <= 0).sum())))
    a, w, bias = np.zeros(n), np.zeros(len(r)), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(n).tolist():
            s = slice(offsets[i], offsets[i + 1])
            c, x = cols[s], v[s]
            g = y[i] * (w[c] @ x + bias * b[i]) - 1
            new = min(max(a[i] - g / q, 0.0), upper[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[c] += step * x
                bias += step * b[i]
                a[i] = new
    return w, bias


def curve(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margin to P(label 1), by
    Newton steps with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def held_out(doc_id=None, folds: int = 3, held: int = 1):
    c = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % folds == held, F.lit(False))


def sample_labels(labels: DataFrame, label: str, allowed, max_fit: int) -> DataFrame:
    """(doc_id, y) of at most about ``max_fit`` labelled rows: all of them,
    or those whose hash is below the share that gives ``max_fit``."""
    lab = plain(labels, "doc_id", label).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    lab = lab.filter("doc_id is not null and y is not null").filter(allowed).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = lab.count()
    share = 1.0 if n <= max_fit else max_fit / n
    return lab.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", allowed=None, bits: int = BITS,
        max_fit: int = MAX_FIT, alpha: float = ALPHA, cost: float = COST, epochs: int = EPOCHS) -> dict:
    """The fitted model, of fixed size: ratios, weights, bias, curve."""
    lab = sample_labels(labels, label, ~held_out() if allowed is None else allowed, max_fit)
    d = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = d.join(F.broadcast(lab), "doc_id")  # at most about max_fit label rows

    def featurize(batches: Iterator[pa.RecordBatch]):
        spans = tv.Spans()
        for b in batches:
            off, cols = features(b.column("text").cast(pa.binary()).to_pylist(), bits, spans)
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(cols))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), lists], ["doc_id", "y", "cols"])

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        lists = t.column("cols").combine_chunks()
        off = lists.offsets.to_numpy().astype(np.int64)
        cols = lists.values.to_numpy()[off[0]:off[-1]]
        off = off - off[0]
        y = np.where(t.column("y").to_numpy() > 0, 1, -1)
        model = solve_rows(off, cols, y, bits, alpha, cost, epochs)
        return pa.table({"model": pa.array([x.tobytes() for x in model], pa.binary()), "part": pa.array(range(len(model)), pa.int32())})

    feats = rows.mapInArrow(featurize, "doc_id long, y int, cols array<int>")
    got = feats.groupBy(F.lit(1).alias("one")).applyInArrow(solve, "model binary, part int").collect()
    if not got:
        return {"prior": 0.5, "bits": bits}
    parts = {r["part"]: np.frombuffer(r["model"], np.float64) for r in got}
    r, w, rest = parts[0], parts[1], parts[2]
    return {"bits": bits, "ratios": r, "weights": w, "bias": rest[0], "slope": rest[1], "offset": rest[2], "prior": rest[3]}


def solve_rows(off, cols, y, bits, alpha, cost, epochs) -> list[np.ndarray]:
    """Ratios, weights and (bias, slope, offset, share of label 1).  A quarter
    of the rows is kept from the descent for the curve."""
    share = float((y > 0).mean())
    if share in (0.0, 1.0):
        return [np.zeros(1), np.zeros(1), np.array([0.0, 0.0, 0.0, share])]
    idx = np.arange(len(y))
    aside = idx % 4 == 3
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside[:] = False

    def pick(mask):
        keep = np.repeat(mask, np.diff(off))
        n = np.diff(off)[mask]
        return np.concatenate(([0], np.cumsum(n))), cols[keep], y[mask]

    o, c, t = pick(~aside)
    r = ratios(o, c, t, bits, alpha)
    w, bias = descend(o, c, t, r, cost, epochs)
    o, c, t = pick(aside if aside.any() else ~aside)
    slope, at = curve(margins(o, c, (r, w, bias)), t)
    return [r, w, np.array([bias, slope, at, share])]


def score_texts(texts: list, model: dict, step: int = 512) -> np.ndarray:
    """Scores of a batch, ``step`` texts at a time: the indicators of few
    texts are in memory at once."""
    if len(model.get("weights", ())) < 2:
        return np.full(len(texts), model["prior"])
    spans, out = tv.Spans(), [np.zeros(0)]
    for lo in range(0, len(texts), step):
        off, cols = features(texts[lo:lo + step], model["bits"], spans)
        m = margins(off, cols, (model["ratios"], model["weights"], model["bias"]))
        out.append(1 / (1 + np.exp(-np.clip(model["slope"] * m + model["offset"], -30, 30))))
    return np.concatenate(out)


def score_column(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of the rows of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            s = score_texts(b.column("text").cast(pa.binary()).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    d = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **params) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    s = score_column(docs, fit(docs, labels, **params))
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **params) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject.  The score
    is computed beside the rows, in one narrow pass."""
    model = fit(docs, labels, **params)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd
        return pd.Series(score_texts([None if x is None else x.encode() for x in texts], model))

    return docs.filter(score(F.col("text").cast("string")) >= threshold)
