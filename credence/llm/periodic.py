"""Periodic runs of words (operator 12): online dyadic square catching.

Words are appended to a stream.  At every power of two B the stream is cut
into blocks of B words, and each completed block is a catcher: it waits for
its own words to come again 'period' words later, for the periods B to 2B-1.
An appended word advances, for every B, the suffix of B words that ends with
it: its hash follows from two suffixes of half that length.  A suffix is
compared with the one block whose distance is B to 2B-1; equality is a square
in the making.  Any stretch of period q and of four periods or more holds a
whole block of the largest B <= q within its first two periods, so no run is
missed.  A caught square is extended to both sides by the stored suffixes
(longest first), and squares that extend to the same stretch merge into one
run, whose period is the smallest of theirs; a square that lies whole inside
a run of shorter period can only be that run again and is left out.  Runs are
checked word by word against the words' codes at the end.

A document costs O(n log n) for the suffixes and O(log n) for each caught
square, of which there are at most n at each B.  The documents of a batch are
one stream, up to ``CHUNK`` words of it at a time, with a code of its own
between two documents, which nothing equals; a longer document is a stream
of its own, whole.  Rows are independent: no shuffle, no state between tasks.

Defined cases: words are runs of bytes other than space and 0x09-0x0D; null
and empty texts have no words, no runs and an empty collapsed text; repeated
rows give repeated results; an empty table gives an empty result; extra
columns are ignored; a missing ``text`` column is an error.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import plain
from credence.llm.textvec import mix

EXPONENT, LEAST = 4, 6
#: words of one stream; a longer document is one stream
CHUNK = 1 << 18

_JOIN = np.uint64(0xD1342543DE82EF95)


class Catchers:
    """The catchers of one stream; ``longest`` bounds the words that may
    stand together (a document), and so the periods that are of use."""

    def __init__(self, longest: int, exponent: int = EXPONENT, seed: int = 0):
        if exponent < 4:
            raise ValueError("blocks catch every run of four periods or more")
        self.exponent, self.seed = exponent, np.uint64(seed)
        self.codes = np.zeros(0, np.int64)
        most = longest // exponent  # the longest period
        #: suffixes[k][e]: hash of the 2**k words that end with word e (0 where there are fewer)
        self.suffixes = [np.zeros(0, np.uint64) for _ in range(most.bit_length())]
        #: caught[k]: pairs (block start, place of the repeat)
        self.caught: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in self.suffixes]

    def append(self, codes: np.ndarray) -> None:
        """Append words; each advances one suffix comparison at every B."""
        old, n = len(self.codes), len(self.codes) + len(codes)
        self.codes = np.concatenate((self.codes, codes)) if old else np.asarray(codes, np.int64)
        for k, before in enumerate(self.suffixes):
            block = 1 << k
            if k == 0:
                new = mix(self.codes[old:].astype(np.uint64) + self.seed)
            else:
                half, new = self.suffixes[k - 1], np.zeros(n - old, np.uint64)
                lo = max(old, block - 1)
                if lo < n:
                    new[lo - old:] = mix(half[lo - block // 2:n - block // 2] * _JOIN + half[lo:n])
            s = self.suffixes[k] = np.concatenate((before, new)) if old else new
            # the suffix that ends with e starts at e-B+1; its catcher is the block before the one that start lies in
            lo = max(old, 2 * block - 1)
            if lo < n:
                first = (lo - block + 1) // block  # the block of the first start
                ends = s[block - 1::block][first - 1:]
                skip = (lo - block + 1) - first * block
                hit = np.flatnonzero(s[lo:n] == np.repeat(ends, block)[skip:skip + n - lo]) if len(ends) else ()
                if len(hit):
                    start = hit + (lo - block + 1)
                    self.caught[k].append(((start // block - 1) * block, start))

    def _same(self, k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the 2**k words that end with x and with y are equal; x < y."""
        ok = (x >= (1 << k) - 1) & (y < len(self.codes))
        s = self.suffixes[k]
        return ok & (s[np.where(ok, x, 0)] == s[np.where(ok, y, 0)])

    def _extend(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """How many words on (step 1) or back (-1) from x and y are equal."""
        got = np.zeros(len(x), np.int64)
        top = len(self.suffixes) - 1
        live = np.arange(len(x))
        while len(live):  # the longest suffix as often as it fits
            off = (1 << top) - 1 if step > 0 else 0
            live = live[self._same(top, x[live] + step * got[live] + off, y[live] + step * got[live] + off)]
            got[live] += 1 << top
        for k in range(top - 1, -1, -1):
            off = (1 << k) - 1 if step > 0 else 0
            got += np.where(self._same(k, x + step * got + off, y + step * got + off), 1 << k, 0)
        return got

    def runs(self, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, period) of the runs so far, by start, then period."""
        n = len(self.codes)
        found = np.zeros((0, 3), np.int64)
        cover = np.zeros(n + 1, np.int64)  # the farthest end of a known run that starts at or before
        for k, parts in enumerate(self.caught):
            if not parts:
                continue
            b, i = (np.concatenate(x) for x in zip(*parts, strict=True))
            keep = cover[b] < i + (1 << k)
            b, i = b[keep], i[keep]
            if not len(b):
                continue
            q = i - b
            start = b - self._extend(b - 1, i - 1, -1)
            end = i + (1 << k) + self._extend(b + (1 << k), i + (1 << k), 1)
            keep = end - start >= np.maximum(least, self.exponent * q)
            got = np.stack((start[keep], end[keep], q[keep]), 1)
            if len(got):
                found = np.concatenate((found, got))
                found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
                other = np.ones(len(found), bool)
                other[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
                found = found[other]  # of equal stretches the smallest period
                cover[:] = 0
                np.maximum.at(cover, found[:, 0], found[:, 1])
                np.maximum.accumulate(cover, out=cover)
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
        for s, e, q in found.tolist():
            c = self.codes
            if (c[s:e - q] != c[s + q:e]).any() or s and c[s - 1] == c[s + q - 1] or e < n and c[e] == c[e - q]:
                raise ArithmeticError("two different stretches of words share a hash")
        return found[:, 0], found[:, 1], found[:, 2]


def find_runs(codes: np.ndarray, longest: int, exponent: int = EXPONENT, least: int = LEAST):
    """The runs of a whole stream of codes; equal words have equal codes."""
    for seed in itertools.count():
        c = Catchers(longest, exponent, seed * 0x9E3779B9)
        c.append(codes)
        try:
            return c.runs(least)
        except ArithmeticError:
            if seed == 3:
                raise


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def text_runs(texts: list, exponent: int = EXPONENT, least: int = LEAST):
    """For each text: number of words, [(start, length, period)] and the
    words that are left of it, joined by one space."""
    out, lo = [], 0
    while lo < len(texts):
        words, hi, size = [], lo, 0
        while hi < len(texts) and (hi == lo or size < CHUNK):
            w = (texts[hi] or b"").split()  # bytes split at space and 0x09-0x0D
            if hi > lo and size + len(w) > CHUNK:
                break
            words.append(w)
            size += len(w) + 1
            hi += 1
        codes, known, starts, at = np.empty(size, np.int64), _Codes(), [], 0
        for no, w in enumerate(words):
            starts.append(at)
            codes[at:at + len(w)] = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
            codes[at + len(w)] = -1 - no
            at += len(w) + 1
        s, e, q = find_runs(codes, max(map(len, words)), exponent, least)
        doc = np.searchsorted(starts, s, side="right") - 1
        bound = np.searchsorted(doc, np.arange(len(words) + 1)).tolist()
        for no, w in enumerate(words):
            own = range(bound[no], bound[no + 1])
            keep = w
            if len(own):
                left = np.ones(len(w), bool)
                for j in own:
                    left[s[j] + q[j] - starts[no]:e[j] - starts[no]] = False
                keep = itertools.compress(w, left)
            out.append((len(w), [(int(s[j]) - starts[no], int(e[j] - s[j]), int(q[j])) for j in own], b" ".join(keep)))
        lo = hi
    return out


SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by
    start, then period) and collapsed, the words that no run holds after its
    first period."""
    run = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def scan(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for lo in range(0, len(batch), 512):
                rows = text_runs(texts.slice(lo, 512).to_pylist(), exponent, least)
                runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x[1]] for x in rows]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, 512), pa.array([x[0] for x in rows], pa.int64()), pa.array(runs, pa.list_(run)),
                    pa.array([x[2] for x in rows], pa.binary()).cast(pa.string())], schema=schema)

    if "text" not in docs.columns:
        raise ValueError("documents need a column named text")
    d = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(scan, SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """The result of :func:`periodic_runs` as figures: the number of runs,
    the longest one (ties: smallest start, then period) and digests."""
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))
    d = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.array_min(order).alias("best"), "runs", "collapsed")
    length = -F.col("best.l")
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return d.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
                    F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
                    F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_loops(docs: DataFrame) -> DataFrame:
    """The documents, one in ten of them rewritten: from word a on, its next
    p words come again and again (h: crc32 of doc_id; h divisible by 10)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+"), "")
    n = F.when(F.size("_words") > 0, F.size("_words").cast("long"))
    d = docs.select("doc_id", "text").withColumn("_g", g).withColumn(
        "_words", F.when(h % 10 == 0, words))  # null elsewhere: those texts are not split
    a = F.col("_g") % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("_g") % 8))
    again = F.flatten(F.array_repeat(F.slice("_words", (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    looped = F.concat(F.slice("_words", F.lit(1), a.cast("int")), F.slice(again, F.lit(1), (n - a).cast("int")))
    return d.select("doc_id", F.when(n.isNotNull(), F.array_join(looped, " ")).otherwise(F.col("text")).alias("text"))
