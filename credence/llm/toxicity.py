"""Toxicity by class-conditional Kneser-Ney models (operator 5).

The models predict each byte of a word from the ``ORDER - 1`` bytes before
it (words of letters and digits, A-Z folded, padded at the start, closed at
the end).  At the highest order each class has its own counts, from all
labelled documents but the curve's: the labels are broadcast in blocks of
about ``BLOCK_LABELS``, one counting scan each, so that no text is shuffled.
What the classes back off to is shared: Kneser-Ney continuation counts of the lower orders from all documents.  A rare expression, or a new
form of one, that a class has not seen so takes the shared estimate and only
the weight of the backoff tells the classes apart.

A document's evidence is the difference of its length-normalised (per byte)
log-likelihoods, over the whole text and over its best window of ``WINDOWS``
words; a logistic curve, fitted on labelled documents that the counts leave
out (at most about ``MAX_CURVE`` of them), makes it a score.

Counts are combined in each task, shuffled by n-gram and joined order by
order.  The scorer is the table of every n-gram and context that a class has
seen, sorted and broadcast whole: its size grows with the labelled texts'
distinct n-grams.

Defined cases: null and empty texts have no evidence; a null label is no
label; without labels of both classes the score is the share of label 1
among the labelled (0 without any); a null doc_id is scored and never
learned from; repeated rows are scored one by one; very long texts are read
whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm import textvec as tv
from credence.llm.common import plain, stored
from credence.llm.quality import held_out

ORDER = 6
WINDOWS = (1, 3, 12)
TABLE_BITS = 21
BLOCK_LABELS = 1 << 20
MAX_CURVE = 6000
FLUSH = 1_000_000
OPEN, CLOSE = b"\x02", b"\x03"
MASK = (1 << 8 * ORDER) - 1


def words_of(buf: np.ndarray, spans: tv.Spans):
    """Word tokens of a chunk, and its distinct words: (start, end, index of
    each token's word, grams, gram's word)."""
    start, end = tv.tokens(buf, tv.byte_classes(tv.SPACE))
    h = spans.hashes(spans.prefix(buf), start, end)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    raw = buf.tobytes()
    pad = OPEN * (ORDER - 1)
    seq = np.frombuffer(b"".join([pad + raw[a:b] + CLOSE for a, b in zip(start[first].tolist(), end[first].tolist())]), np.uint8)
    n = (end - start)[first]
    size = n + ORDER
    at = np.cumsum(size) - size
    own = np.repeat(np.arange(len(n)), n + 1)
    pos = np.arange(len(own)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1) + at[own]
    g = np.zeros(len(own), dtype=np.int64)
    for j in range(ORDER):
        g = (g << 8) | seq[pos + j]
    return start, end, which, g, own


def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(keys, return_inverse=True)
    return u, np.stack([np.bincount(inv, weights=c, minlength=len(u)) for c in counts])


def gather(docs: DataFrame, labels: DataFrame, block: int = BLOCK_LABELS) -> DataFrame:
    """(gram, toxic, other, seen): counts of the highest-order n-grams in
    the labelled documents of each class and in all documents."""
    d = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-labels.count() // block))

    def count(batches: Iterator[pa.RecordBatch], everything: bool):
        spans, held, size = tv.Spans(), [], 0
        for b in batches:
            y = b.column("y").fill_null(-1).to_numpy(zero_copy_only=False)
            for lo, hi, buf, at in tv.chunks(b.column("text").cast(pa.binary()).to_pylist()):
                start, _, which, g, own = words_of(buf, spans)
                if not len(start):
                    continue
                cls = y[lo:hi][tv.owners(start, at)]
                by = [np.bincount(which[m], minlength=which.max() + 1) for m in (cls == 1, cls == 0, slice(None) if everything else slice(0))]
                held.append(merge(g, np.stack([c[own] for c in by])))
                size += len(held[-1][0])
                if size > FLUSH:
                    held = [merge(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held], axis=1))]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*merge(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held], axis=1)))

    def rows(k, c):
        return pa.RecordBatch.from_arrays([pa.array(k)] + [pa.array(x.astype(np.int64)) for x in c], ["gram", "toxic", "other", "seen"])

    # the first scan counts all documents, the others their block's
    parts = None
    for i in range(blocks):
        part = labels.select("doc_id", "y").filter(F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(blocks)) == i)
        j = d.join(F.broadcast(part), "doc_id", "left" if i == 0 else "inner").select("y", "text")  # at most about a block
        one = j.mapInArrow(partial(count, everything=i == 0), "gram long, toxic long, other long, seen long")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("toxic", "other", "seen")])


def _discount(n1, n2):
    """The usual estimate from the n-grams seen once and twice."""
    return F.when(n1 + n2 > 0, F.greatest(F.lit(0.1), n1 / (n1 + 2 * n2))).otherwise(0.5)


def shared_backoff(grams: DataFrame) -> DataFrame:
    """(g, p): interpolated Kneser-Ney probability of the last byte of every
    (ORDER-1)-gram of the corpus, from continuation counts of all orders."""
    levels, cur = [], grams.select(F.col("gram").alias("g"))
    for k in range(ORDER - 1, 0, -1):
        cur = stored(cur.groupBy(F.col("g").bitwiseAND((1 << 8 * k) - 1).alias("g")).agg(F.count("*").alias("n")))
        levels.append(cur)
    p = None
    for k, level in zip(range(1, ORDER), reversed(levels)):
        t = level.withColumn("ctx", F.shiftright("g", 8) if k > 1 else F.lit(0).cast("long"))
        sums = t.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"),
                                    F.count(F.when(F.col("n") == 1, 1)).alias("n1"), F.count(F.when(F.col("n") == 2, 1)).alias("n2"))
        d = sums.agg(_discount(F.sum("n1"), F.sum("n2")).alias("d")).first().d or 0.5
        j = t.join(sums, "ctx")
        if p is None:
            lower = F.lit(1 / 256)
        else:
            j = j.withColumn("low", F.col("g").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(p.select(F.col("g").alias("low"), F.col("p").alias("p_low")), "low")
            lower = F.col("p_low")
        p = stored(j.select("g", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total") + d * F.col("kinds") / F.col("total") * lower).alias("p")))
    return p


def ratio_table(grams: DataFrame) -> DataFrame:
    """(kind, key, value): kind 0: log ratio of the class models for an
    n-gram that a class has seen; kind 1: log ratio of the backoff weights of
    a context."""
    seen = grams.filter("toxic + other > 0").withColumn("ctx", F.shiftright("gram", 8))
    sums = stored(seen.groupBy("ctx").agg(*[f(c) for c in ("toxic", "other") for f in (
        lambda c: F.sum(c).alias(f"{c}_n"), lambda c: F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_kinds"))]))
    ones = seen.agg(*[_discount(F.count(F.when(F.col(c) == 1, 1)), F.count(F.when(F.col(c) == 2, 1))).alias(c) for c in ("toxic", "other")]).first()
    p = shared_backoff(grams)
    weight = {c: F.when(F.col(f"{c}_n") > 0, ones[c] * F.col(f"{c}_kinds") / F.col(f"{c}_n")).otherwise(1.0) for c in ("toxic", "other")}

    def prob(c):
        own = F.when(F.col(f"{c}_n") > 0, F.greatest(F.col(c) - ones[c], F.lit(0.0)) / F.col(f"{c}_n")).otherwise(0.0)
        return own + weight[c] * F.col("p")

    low = seen.join(sums, "ctx").withColumn("g", F.col("gram").bitwiseAND((1 << 8 * (ORDER - 1)) - 1)).join(p, "g")
    a = low.select(F.col("gram").alias("key"), F.log(prob("toxic") / prob("other")).alias("value"), F.lit(0).alias("kind"))
    b = sums.select(F.col("ctx").alias("key"), F.log(weight["toxic"] / weight["other"]).alias("value"), F.lit(1).alias("kind"))
    return a.unionByName(b).select("kind", "key", F.col("value").cast("float").alias("value"))


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """The slot that Spark's ``xxhash64`` of one long (seed 42) gives."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = np.uint64(42) + p5 + np.uint64(8)
    h = h ^ (rot(keys.view(np.uint64) * p2, 31) * p1)
    h = rot(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    h = h ^ (h >> np.uint64(32))
    return (h & np.uint64((1 << bits) - 1)).astype(np.int64)


class Ratios:
    """The scorer's tables: a slot holds one key, its others are searched in
    a sorted rest."""

    def __init__(self, table, bits: int):
        self.bits = bits
        self.keys = np.full((2, 1 << bits), -1, dtype=np.int64)
        self.values = np.zeros((2, 1 << bits), dtype=np.float32)
        self.rest = []
        kinds = table.column("kind").to_numpy()
        for kind in (0, 1):
            key, value = (table.column(c).to_numpy()[kinds == kind] for c in ("key", "value"))
            o = np.argsort(key)
            key, value = key[o], value[o]
            slot = _slots(key, bits)
            self.keys[kind, slot] = key
            self.values[kind, slot] = value
            # the key that stayed in the slot brings its own value
            kept = self.keys[kind, slot] == key
            self.values[kind, slot[kept]] = value[kept]
            self.rest.append((key[~kept], value[~kept]))

    def find(self, kind: int, g: np.ndarray, other: np.ndarray) -> np.ndarray:
        s = _slots(g, self.bits)
        hit = self.keys[kind][s] == g
        out = np.where(hit, self.values[kind][s], other)
        key, value = self.rest[kind]
        if len(key):
            miss = np.flatnonzero(~hit)
            at = np.minimum(np.searchsorted(key, g[miss]), len(key) - 1)
            true = key[at] == g[miss]
            out[miss[true]] = value[at[true]]
        return out

    def __call__(self, g: np.ndarray) -> np.ndarray:
        return self.find(0, g, self.find(1, g >> 8, np.zeros(len(g), np.float32)))


def evidence(texts: list, ratios: Ratios, spans: tv.Spans) -> np.ndarray:
    """Per text: the per-byte log ratio of the whole and of the best window
    of each of ``WINDOWS`` words, and the log of the number of words."""
    out = np.zeros((len(texts), len(WINDOWS) + 2))
    for lo, hi, buf, at in tv.chunks(texts):
        start, end, which, g, own = words_of(buf, spans)
        if not len(start):
            continue
        word = np.bincount(own, weights=ratios(g))
        s = np.concatenate(([0.0], np.cumsum(word[which])))
        n = np.concatenate(([0], np.cumsum(end - start + 1)))
        doc = tv.owners(start, at)
        first = np.searchsorted(doc, np.arange(hi - lo + 1))
        some = first[1:] > first[:-1]
        a, z = first[:-1][some], first[1:][some]
        rows = np.flatnonzero(some) + lo
        out[rows, 0] = (s[z] - s[a]) / (n[z] - n[a])
        for k, w in enumerate(WINDOWS):
            last = np.minimum(np.arange(len(start)) + w, z[np.searchsorted(a, np.arange(len(start)), side="right") - 1])
            here = (s[last] - s[:-1]) / (n[last] - n[:-1])
            # windows at the end of a text are shorter: they count as if of full length
            here = np.where(last - np.arange(len(start)) < w, (s[last] - s[:-1]) / (n[last] - n[:-1]) * (last - np.arange(len(start))) / np.minimum(w, (z - a)[np.searchsorted(a, np.arange(len(start)), side="right") - 1]), here)
            out[rows, 1 + k] = np.maximum.reduceat(here, a)
        out[rows, -1] = np.log1p(z - a)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (last one the offset) of a logistic curve, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w = w - step
        if abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", allowed=None, bits: int = TABLE_BITS,
        max_curve: int = MAX_CURVE, block: int = BLOCK_LABELS) -> dict:
    """The scorer: ratio tables and curve."""
    spark = docs.sparkSession
    lab = plain(labels, "doc_id", label).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    lab = lab.filter("doc_id is not null and y is not null").filter(~held_out(folds=4, held=2) if allowed is None else allowed)
    lab = stored(lab.groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y")))
    n = lab.count()
    # the curve's documents: a third of the labelled, at most about max_curve
    part = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(1 << 30)) < int(min(1 / 3, max_curve / max(1, n)) * (1 << 30))
    grams = stored(gather(docs, lab.filter(~part), block))
    table = ratio_table(grams).toArrow()  # every n-gram and context of the labelled texts
    ratios = Ratios(table, bits)
    shared = spark.sparkContext.broadcast(ratios)

    def measure(batches):
        spans = tv.Spans()
        for b in batches:
            x = evidence(b.column("text").cast(pa.binary()).to_pylist(), shared.value, spans)
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    d = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    curve = d.join(F.broadcast(lab.filter(part)), "doc_id").select("y", "text")  # at most about max_curve rows
    got = curve.mapInArrow(measure, "y int, x array<double>").toArrow()
    y = got.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        share = lab.agg(F.avg("y")).first()[0]
        return {"prior": float(share or 0.0)}
    x = np.array(got.column("x").to_pylist())
    return {"shared": shared, "weights": logistic(x, y)}


def score_column(docs: DataFrame, model: dict) -> DataFrame:
    def run(batches):
        spans = tv.Spans()
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            if "weights" in model:
                x = evidence(texts, model["shared"].value, spans)
                s = 1 / (1 + np.exp(-np.clip(np.hstack([x, np.ones((len(x), 1))]) @ model["weights"], -30, 30)))
            else:
                s = np.full(len(texts), model["prior"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    d = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    s = score_column(docs, fit(docs, labels, **params))
    return s.select("doc_id", held_out(folds=4, held=2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
