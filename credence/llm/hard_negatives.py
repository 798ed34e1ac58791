"""Hard-negative mining with segment summaries (operator 11).

An anchor's positives are its best rows of the same label; a hard negative of
an (anchor, positive) pair is a row of another label whose score lies in a
band below the positive's.  Scores are inner products of integer vectors.

Every vector is cut into 1, 4, 16, ... segments, and the mean and deviation
(norm of what is left after the mean) of each segment are stored with it.
For two vectors the product of the means, times the segment's length, plus or
minus the product of the deviations, bounds each segment's part of the score
(Cauchy-Schwarz), and the sum bounds the score.  A batch of rows meets a
block of anchors level by level: pairs whose upper bound is below the k-th
best lower bound seen, or whose bounds miss every band, go; the others are
refined with four times as many segments, and the last ones scored exactly.
Bounds get a slack for rounding, so no row is lost; the result is exact.

The anchors are the query set: blocks of at most about ``BLOCK`` anchors are
broadcast, one after another, whatever the number of rows, and every block
scans the stored rows twice (positives, then negatives).  A task keeps the
best k per anchor (and band) and emits only those; ranks are taken by a
window over what tasks emit, cut map-side by Spark's group limit.  Each
block's result is written before the next one starts and its broadcast freed.

Defined cases: rows with a null label, a null vector or any null or
non-finite component take no part, nor do rows without vec_id (they could not
be named); repeated rows are rows of their own, but an anchor that repeats in
full is one anchor, and 'other rows' have another vec_id; vectors of
different lengths have no score; empty vectors score 0 with each other; equal
scores rank the smaller vec_id first; scores beyond the range of a long are
held at its ends; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from credence.llm.common import stored

POSITIVES, NEGATIVES = 5, 10
#: percent of the positive's score
LOW, HIGH = 30, 90
#: anchors in one broadcast; also parts of the batch and anchors that meet at a time
BLOCK, ROWS, ANCHORS = 8192, 2048, 256

LEAST, MOST = -(1 << 63), (1 << 63) - 1
EXACT = float(1 << 52)
#: share of |x| |y| that covers the rounding of summaries to 32 bits
SLACK = 1e-6


def cuts(d: int) -> list[np.ndarray]:
    """Ends of the segments of a vector of ``d`` components, level by level:
    1, 4, 16, ... segments of four components or more."""
    out, parts = [np.array([0, d])], 4
    while parts * 4 <= d:
        out.append(np.linspace(0, d, parts + 1).astype(int))
        parts *= 4
    return out


def summaries(x: np.ndarray) -> np.ndarray:
    """Means, then deviations, of each level's segments: one row per vector."""
    n, d = x.shape
    out = []
    for cut in cuts(d):
        size = np.diff(cut)
        if not d:
            out += [np.zeros((n, 1))] * 2
            continue
        mean = np.add.reduceat(x, cut[:-1], axis=1) / size
        out += [mean, np.sqrt(np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, cut[:-1], axis=1))]
    with np.errstate(over="ignore"):
        return np.concatenate(out, axis=1).astype(np.float32)


class Vectors:
    """Vectors of one length with ids, labels and their stored summaries."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, summary: np.ndarray):
        self.ids, self.labels, self.values, self.summary = ids, labels, values, summary
        with np.errstate(over="ignore", invalid="ignore"):
            self.norm = np.sqrt((values ** 2).sum(axis=1))

    def take(self, rows) -> Vectors:
        out = object.__new__(Vectors)
        for name in ("ids", "labels", "values", "summary", "norm"):
            setattr(out, name, getattr(self, name)[rows])
        return out


def bounds(x: Vectors, y: Vectors, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the scores of all pairs of the two parts."""
    ends = cuts(x.values.shape[1])
    at = 2 * sum(len(c) - 1 for c in ends[:level])
    size = np.diff(ends[level])
    mean, dev = slice(at, at + len(size)), slice(at + len(size), at + 2 * len(size))
    with np.errstate(over="ignore", invalid="ignore"):
        middle = (x.summary[:, mean].astype(float) * size) @ y.summary[:, mean].astype(float).T
        spread = x.summary[:, dev].astype(float) @ y.summary[:, dev].astype(float).T
        spread += SLACK * x.norm[:, None] * y.norm + 1e-6
        low, high = middle - spread, middle + spread
    low[np.isnan(low)], high[np.isnan(high)] = -np.inf, np.inf
    return np.maximum(low, float(LEAST)), np.minimum(high, float(MOST))


def scores(x: Vectors, y: Vectors, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs (a, r), held within the range of a long."""
    if x.norm.max(initial=0) * y.norm.max(initial=0) < EXACT:  # every partial sum is an exact double
        if len(a) * 8 > len(x.ids) * len(y.ids):
            out = (x.values @ y.values.T)[a, r]
        else:
            out = np.einsum("ij,ij->i", x.values[a], y.values[r])
        return np.rint(out).astype(np.int64)
    dot = lambda p, q: sum(int(c) * int(d) for c, d in zip(p, q, strict=True))
    return np.array([min(MOST, max(LEAST, dot(x.values[i], y.values[j]))) for i, j in zip(a.tolist(), r.tolist(), strict=True)],
                    np.int64)


def kth_of_rows(m: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row, -inf where a row is shorter."""
    return np.partition(m, m.shape[1] - k, axis=1)[:, m.shape[1] - k] if m.shape[1] >= k else np.full(len(m), -np.inf)


class Best:
    """The best k (score, id) of each group; ties go to the smaller id."""

    def __init__(self, k: int, groups: int):
        self.k = k
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: what a newcomer must reach, -inf where there is room
        self.least = np.full(groups, -np.inf)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        near = np.isin(self.group, group)  # the groups that change
        g, s, i = (np.concatenate(x) for x in ((self.group[near], group), (self.score[near], score), (self.id[near], ids)))
        order = np.lexsort((i, ~s, g))  # ~s falls as s grows and cannot overflow
        place = np.arange(len(g)) - np.searchsorted(g[order], g[order])
        keep, full = order[place < self.k], order[place == self.k - 1]
        self.group, self.score, self.id = (np.concatenate((old[~near], new[keep])) for old, new in (
            (self.group, g), (self.score, s), (self.id, i)))
        self.least[g[full]] = np.nextafter(s[full].astype(float), -np.inf)


def best_positives(x: Vectors, y: Vectors, best: Best, offset: int) -> None:
    """Put the rows ``y`` of the anchors' labels into ``best``."""
    live = (x.labels[:, None] == y.labels) & (x.ids[:, None] != y.ids)
    least = best.least[offset:offset + len(x.ids)]
    for level in range(len(cuts(x.values.shape[1]))):
        cols = live.any(axis=0)
        if not cols.any():
            return
        y, live = (y, live) if cols.all() else (y.take(cols), live[:, cols])
        low, high = bounds(x, y, level)
        least = np.maximum(least, kth_of_rows(np.where(live, low, -np.inf), best.k))
        live &= high >= least[:, None]
    a, r = np.nonzero(live)
    best.add(a + offset, scores(x, y, a, r), y.ids[r])


def best_in_bands(x: Vectors, y: Vectors, bands: np.ndarray, best: Best, offset: int) -> None:
    """Put the rows ``y`` of other labels into ``best``, whose groups are
    anchor * n_bands + band; ``bands``: (anchor, band, least and most score),
    least above most for none."""
    n, k, _ = bands.shape
    floor, ceil = bands[..., 0].astype(float), bands[..., 1].astype(float)
    none = bands[..., 0] > bands[..., 1]
    slack = (np.abs(floor) + np.abs(ceil)) * 1e-12
    floor, ceil = np.where(none, np.inf, floor - slack), np.where(none, -np.inf, ceil + slack)
    least = best.least[offset * k:(offset + n) * k].reshape(n, k).copy()
    other = x.labels[:, None] != y.labels
    live = [other & ~none[:, j, None] for j in range(k)]
    for level in range(len(cuts(x.values.shape[1]))):
        cols = np.any([m.any(axis=0) for m in live], axis=0)
        if not cols.any():
            return
        if not cols.all():
            y, live = y.take(cols), [m[:, cols] for m in live]
        low, high = bounds(x, y, level)
        for j, m in enumerate(live):
            lo, hi, sl = floor[:, j, None], ceil[:, j, None], slack[:, j, None]
            inside = m & (low >= lo + 2 * sl) & (high <= hi - 2 * sl)
            if inside.any():
                least[:, j] = np.maximum(least[:, j], kth_of_rows(np.where(inside, low, -np.inf), best.k))
            m &= (low <= hi) & (high >= np.maximum(lo, least[:, j, None]))
    a, r = np.nonzero(np.any(live, axis=0))
    s = scores(x, y, a, r)
    for j, m in enumerate(live):
        own = m[a, r] & (s >= bands[a, j, 0]) & (s <= bands[a, j, 1])
        best.add((a[own] + offset) * k + j, s[own], y.ids[r[own]])


# -- Spark --------------------------------------------------------------------

def summarised(vectors: DataFrame, id_col: str, vector: str, label: str, noise: int | None, labels: int, scale: int) -> DataFrame:
    """(id, label, v, summary) of the rows that take part.  Where the id is
    divisible by ``noise`` the label moves on by one."""
    col = F.col(f"`{vector}`")
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    v = col.cast(kind)
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    lab, i = F.col(f"`{label}`").cast("long"), F.col(f"`{id_col}`").cast("long")
    moved = lab if noise is None else F.when(i % noise == 0, (lab + 1) % labels).otherwise(lab)
    rows = vectors.where(i.isNotNull() & lab.isNotNull() & v.isNotNull() & whole).select(
        i.alias("id"), moved.alias("label"), v.alias("v"))

    def add(batches):
        for b in batches:
            out = np.empty(len(b), object)
            for rows, x in _matrices(b.column(2), scale):
                out[rows] = list(summaries(x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out.tolist(), pa.list_(pa.float32()))],
                                             ["id", "label", "v", "summary"])

    return rows.mapInArrow(add, f"id long, label long, v {kind}, summary array<float>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(size) - size, size, column.flatten().to_numpy(zero_copy_only=False)


def _matrices(column: pa.Array, scale: int):
    """(rows, their vectors as integers in doubles) for each vector length."""
    start, size, flat = _flat(column)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        x = flat[start[rows][:, None] + np.arange(d)].reshape(len(rows), d).astype(float)
        with np.errstate(over="ignore"):
            yield rows, np.clip(np.floor(scale * x), -1e60, 1e60)


def _vectors(batch, scale: int):
    """The :class:`Vectors` of a batch (id, label, v, summary), by length."""
    ids, labels = (batch.column(j).to_numpy(zero_copy_only=False) for j in range(2))
    start, _, flat = _flat(batch.column(3))
    for rows, x in _matrices(batch.column(2), scale):
        width = 2 * sum(len(c) - 1 for c in cuts(x.shape[1]))
        yield Vectors(ids[rows], labels[rows], x, flat[start[rows][:, None] + np.arange(width)])


def mine(vectors: DataFrame, anchor_every: int = 100, noise: int | None = None, positives: int = POSITIVES,
         negatives: int = NEGATIVES, low_pct: int = LOW, high_pct: int = HIGH, scale: int = 256, labels: int = 10,
         block: int = BLOCK, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for the rows whose id is divisible by ``anchor_every``
    and each of their ``positives`` best rows of the same label, the best
    ``negatives`` rows of another label with a score of ``low_pct`` to
    ``high_pct`` percent of the positive's.  Components count as
    floor(``scale`` * x)."""
    rows = stored(summarised(vectors, id_col, vector, label, noise, labels, scale))
    anchors = rows.filter(F.col("id") % anchor_every == 0).distinct()
    n_blocks = math.ceil(anchors.count() / block)
    if not n_blocks:
        return vectors.sparkSession.createDataFrame([], RESULT)
    # spread by the whole row, so that an id with very many vectors fills several blocks
    anchors = stored(anchors.withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(n_blocks))))
    result = None
    for no in range(n_blocks):
        own = anchors.filter(F.col("block") == no).select("id", "label", "v", "summary").toArrow().combine_chunks()
        if own.num_rows:
            found = stored(_mine_block(rows, own, positives, negatives, low_pct, high_pct, scale))
            result = found if result is None else result.unionByName(found)
    return result


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _mine_block(rows: DataFrame, anchors: pa.Table, positives: int, negatives: int, low_pct: int, high_pct: int, scale: int) -> DataFrame:
    spark = rows.sparkSession
    groups = [g for b in anchors.to_batches() for g in _vectors(b, scale)]
    n = sum(len(g.ids) for g in groups)
    shared = spark.sparkContext.broadcast(groups)

    def meet(batches, each):
        """Calls each(anchors, rows, first anchor's number) for every part of the block and of the batches."""
        cut, at = [], 0
        for g in shared.value:
            cut += [(g.take(slice(lo, lo + ANCHORS)), at + lo) for lo in range(0, len(g.ids), ANCHORS)]
            at += len(g.ids)
        for b in batches:
            for y in _vectors(b, scale):
                for lo in range(0, len(y.ids), ROWS):
                    part = y.take(slice(lo, lo + ROWS))
                    for x, offset in cut:
                        if x.values.shape[1] == part.values.shape[1]:
                            each(x, part, offset)

    def emit(best, k):
        for lo in range(0, len(best.group), 10_000):
            g, s, i = (c[lo:lo + 10_000] for c in (best.group, best.score, best.id))
            yield pa.RecordBatch.from_arrays([pa.array(g // k), pa.array((g % k).astype(np.int32)), pa.array(s), pa.array(i)],
                                             ["anchor", "band", "score", "id"])

    def pass_one(batches):
        best = Best(positives, n)
        meet(batches, lambda x, y, at: best_positives(x, y, best, at))
        yield from emit(best, 1)

    schema = "anchor long, band int, score long, id long"
    ranked = lambda d, k: d.withColumn("rank", F.row_number().over(
        W.partitionBy("anchor", "band").orderBy(F.col("score").desc(), "id"))).filter(F.col("rank") <= k)
    # at most BLOCK x positives rows
    top = ranked(rows.mapInArrow(pass_one, schema), positives).select("anchor", "rank", "score", "id").toArrow()
    bands = np.zeros((n, positives, 2), np.int64)
    bands[..., 0] = 1  # no score is both 1 at least and 0 at most
    inside = lambda c: min(MOST, max(LEAST, c))
    for a, k, s in zip(top["anchor"].to_pylist(), top["rank"].to_pylist(), top["score"].to_pylist(), strict=True):
        bands[a, k - 1] = inside(-(-low_pct * s // 100)), inside(high_pct * s // 100)
    known = spark.sparkContext.broadcast(bands)

    def pass_two(batches):
        bands = known.value
        best = Best(negatives, n * positives)
        meet(batches, lambda x, y, at: best_in_bands(x, y, bands[at:at + len(x.ids)], best, at))
        yield from emit(best, positives)

    found = ranked(rows.mapInArrow(pass_two, schema), negatives)
    ids = np.concatenate([g.ids for g in groups])
    pairs = spark.createDataFrame(pa.table({
        "anchor": top["anchor"], "band": pa.array(top["rank"].to_numpy().astype(np.int32) - 1),
        "anchor_id": pa.array(ids[top["anchor"].to_numpy()]), "positive_id": top["id"], "positive_score": top["score"]}))
    return found.join(pairs, ["anchor", "band"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
