"""Benchmark decontamination (operator 4).

1. The test items' word ``GRAM``-grams are looked up in every document and
   their document frequency is counted over the whole corpus.
2. Of each item the rarest ``SEED_SHARE`` of its n-grams are its seeds.  The
   share is of the item's own n-grams, so an item that leaked into many
   documents keeps its seeds.
3. A second pass joins passages to items on the seeds.  Around the seed hits
   of a document and an item the Smith-Waterman alignment of the item's words
   against the document's is scored: a match ``MATCH``, anything else a
   penalty.  A pair counts from ``THRESHOLD`` of the item's full score on, so
   edited and partly reworded copies count and shared phrases do not.

The benchmark is the stated query set.  It is taken in blocks of at most
``BLOCK_ITEMS`` items by hash, each block's n-grams held by the tasks; the
documents are scanned per block, never shuffled.  Several hits of an item in
one document are one row, the best.

Defined cases: words are runs of ASCII letters, digits and non-ASCII bytes,
A-Z folded; null and empty texts have no words and match nothing; items of
fewer than ``LEAST_WORDS`` words count where they stand word for word; very long texts are read
whole, as one alignment per cluster of hits; equal scores take the earliest
place; repeated items (one item_id, several texts) give their best row;
repeated rows give repeated results; a null doc_id or item_id stays null; an
empty table gives an empty result; extra columns are ignored, or kept by
:func:`drop_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm import textvec as tv
from credence.llm.common import plain

GRAM = 3
SEED_SHARE = 2 / 3
LEAST_WORDS = 8
MATCH, OTHER, GAP = 2, -1, -1
THRESHOLD = 0.5
BLOCK_ITEMS = 20_000
FILTER_BITS = 22


def word_hashes(buf: np.ndarray, spans: tv.Spans):
    """(hash of each word, start of each word in the chunk)."""
    start, end = tv.tokens(buf, tv.byte_classes(tv.SPACE))
    return spans.hashes(spans.prefix(buf), start, end), start


def gram_hashes(h: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of the n-grams of a word sequence (across texts too; the
    caller drops those)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    g = h[: len(h) - n + 1]
    for j in range(1, n):
        g = tv.mix(g * np.uint64(3) + h[j: len(h) - n + 1 + j] * np.uint64(0x632BE59BD9B4E019))
    return g


class Items:
    """A block of test items: words and n-gram index."""

    def __init__(self, ids: list, texts: list, gram: int):
        spans = tv.Spans()
        self.ids, self.words, self.gram = [], [], gram
        short: dict[int, list] = {}  # by number of words: (hash of all words, item_id)
        for i, t in zip(ids, texts):
            _, _, buf, _ = next(tv.chunks([(t or "").encode()]))
            h, _ = word_hashes(buf, spans)
            if len(h) >= LEAST_WORDS:
                self.ids.append(i)
                self.words.append(h)
            elif len(h):
                short.setdefault(len(h), []).append((gram_hashes(h, len(h))[0], i))
        self.short = {n: (np.array([k for k, _ in sorted(x, key=lambda e: int(e[0]))], np.uint64),
                          [i for _, i in sorted(x, key=lambda e: int(e[0]))]) for n, x in sorted(short.items())}
        self.index([np.ones(max(0, len(w) - gram + 1), bool) for w in self.words])

    def index(self, use: list[np.ndarray]) -> None:
        """(gram, item, place) of the n-grams in use, sorted by gram."""
        g = [gram_hashes(w, self.gram)[u] for w, u in zip(self.words, use)]
        item = [np.full(u.sum(), k) for k, u in enumerate(use)]
        at = [np.flatnonzero(u) for u in use]
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.grams, self.item, self.at = cat(g, np.uint64), cat(item, np.int64), cat(at, np.int64)
        o = np.argsort(self.grams, kind="stable")
        self.grams, self.item, self.at = self.grams[o], self.item[o], self.at[o]
        self.keys = np.unique(self.grams)
        self.maybe = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.maybe[self.keys >> np.uint64(64 - FILTER_BITS)] = True

    def seeds(self, frequency: dict[int, int], share: float) -> None:
        use = []
        for w in self.words:
            g = gram_hashes(w, self.gram)
            f = np.array([frequency.get(int(x), 0) for x in g.view(np.int64)])
            rank = np.lexsort((g, f))
            u = np.zeros(len(g), bool)
            u[rank[: max(1, int(np.ceil(share * len(g))))]] = True
            use.append(u)
        self.index(use)

    def hits(self, texts: list, spans: tv.Spans):
        """(first row, words, first word of each text, word positions whose
        n-gram is indexed, their text)."""
        for lo, hi, buf, at in tv.chunks(texts):
            h, start = word_hashes(buf, spans)
            first = np.searchsorted(start, np.concatenate((at, [len(buf)])))
            g = gram_hashes(h, self.gram)
            pos = np.flatnonzero(self.maybe[g >> np.uint64(64 - FILTER_BITS)])
            doc = np.searchsorted(first, pos, side="right") - 1
            pos, doc = pos[pos + self.gram <= first[doc + 1]], doc[pos + self.gram <= first[doc + 1]]
            if len(self.keys) and len(pos):
                k = np.minimum(np.searchsorted(self.keys, g[pos]), len(self.keys) - 1)
                true = self.keys[k] == g[pos]
                pos, doc = pos[true], doc[true]
            else:
                pos, doc = pos[:0], doc[:0]
            yield lo, h, g, first, pos, doc

    def short_pairs(self, lo: int, h: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
        """The earliest place of each short item in each text."""
        for n, (keys, ids) in self.short.items():
            g = gram_hashes(h, n)
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            pos = np.flatnonzero(keys[at] == g)
            doc = np.searchsorted(first, pos, side="right") - 1
            inside = pos + n <= first[doc + 1]
            pos, doc = pos[inside], doc[inside]
            _, one = np.unique(np.stack([doc, at[pos]]), axis=1, return_index=True)
            for p, x in zip(pos[one].tolist(), doc[one].tolist()):
                k = int(at[p])
                while k < len(keys) and keys[k] == g[p]:
                    yield lo + x, ids[k], 1.0, p - int(first[x]), p - int(first[x]) + n
                    k += 1

    def pairs(self, texts: list, spans: tv.Spans, threshold: float) -> Iterator[tuple]:
        """(row, item, score, first word, last word + 1) of the best
        alignment of each text and item that reach the threshold."""
        for lo, h, g, first, pos, doc in self.hits(texts, spans):
            yield from self.short_pairs(lo, h, first)
            if not len(pos):
                continue
            a = np.searchsorted(self.grams, g[pos])
            n = np.searchsorted(self.grams, g[pos], side="right") - a
            rep = np.repeat(np.arange(len(pos)), n)
            ix = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(len(rep))
            d, it = doc[rep], self.item[ix]
            begin = pos[rep] - self.at[ix]  # where the item would begin
            size = np.array([len(w) for w in self.words])[it]
            slack = size // 2 + 2
            o = np.lexsort((begin, it, d))
            d, it, begin, size, slack = d[o], it[o], begin[o], size[o], slack[o]
            new = np.concatenate(([True], (d[1:] != d[:-1]) | (it[1:] != it[:-1]) | (begin[1:] > begin[:-1] + size[1:] + 2 * slack[1:])))
            s = np.flatnonzero(new)
            e = np.concatenate((s[1:], [len(d)])) - 1
            best: dict[tuple, tuple] = {}
            for i, j in zip(s.tolist(), e.tolist()):
                x, y = int(d[i]), int(it[i])
                left = max(int(first[x]), int(begin[i] - slack[i]))
                right = min(int(first[x + 1]), int(begin[j] + size[i] + slack[i]))
                w = self.words[y]
                score, end = align(w, h[left:right])
                part = score / (MATCH * len(w))
                if part >= threshold and part > best.get((x, y), (0,))[0]:
                    _, back = align(w[::-1], h[left:left + end][::-1], full=score)
                    best[x, y] = (part, left + end - back - int(first[x]), left + end - int(first[x]))
            for (x, y), (part, b, z) in best.items():
                yield lo + x, self.ids[y], part, b, z


def align(item: np.ndarray, words: np.ndarray, full: int | None = None) -> tuple[int, int]:
    """Smith-Waterman local alignment with linear gaps: best score and the
    end (in ``words``) of the first alignment that has it; with ``full`` the
    end of the first alignment of that score."""
    n = len(words)
    ramp = np.arange(n + 1) * -GAP
    row = np.zeros(n + 1, dtype=np.int64)
    best, at = 0, 0
    for x in item:
        step = np.where(words == x, MATCH, OTHER)
        cur = np.zeros(n + 1, dtype=np.int64)
        cur[1:] = np.maximum(np.maximum(row[:-1] + step, row[1:] + GAP), 0)
        # a gap along the words: the best earlier cell, one step less for each word
        row = np.maximum.accumulate(cur + ramp) - ramp
        top = int(row.max())
        if top > best:
            best, at = top, int(row.argmax())
            if full is not None and best >= full:
                break
    return best, at


def blocks(benchmark: DataFrame, block_items: int) -> list[DataFrame]:
    """The items in parts of about ``block_items`` by hash."""
    b = plain(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n = b.count()
    parts = max(1, -(-n // block_items))
    return [b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) for i in range(parts)]


def prepare(docs: DataFrame, block: DataFrame, gram: int, share: float) -> Items:
    """A block's items with their seeds, from the document frequencies of
    all their n-grams in the whole corpus."""
    got = block.orderBy("item_id", "text").toArrow()  # at most about BLOCK_ITEMS rows
    items = Items(got.column("item_id").to_pylist(), got.column("text").to_pylist(), gram)

    def count(batches):
        spans = tv.Spans()
        total = np.zeros(len(items.keys), np.int64)
        for b in batches:
            for _, _, g, _, pos, doc in items.hits(b.column("text").cast(pa.binary()).to_pylist(), spans):
                k = np.searchsorted(items.keys, g[pos])
                one = np.unique((doc << 40) | k) & ((1 << 40) - 1)
                total += np.bincount(one, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(items.keys[some].view(np.int64)), pa.array(total[some])], ["gram", "n"])

    text = plain(docs, "text").select(F.col("text").cast("string").alias("text"))
    f = text.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    items.seeds({r.gram: r.n for r in f.collect()}, share)  # at most the block's n-grams
    return items


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, share: float = SEED_SHARE,
                       threshold: float = THRESHOLD, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): the pairs whose best
    alignment reaches ``threshold`` of the item's full score."""
    d = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names, out = "doc_id long, item_id long, score double, first_word long, end_word long", None
    for block in blocks(benchmark, block_items):
        items = prepare(docs, block, gram, share)

        def run(batches, items=items):
            spans = tv.Spans()
            for b in batches:
                ids, best = b.column("doc_id").to_pylist(), {}
                for row, item, score, lo, hi in items.pairs(b.column("text").cast(pa.binary()).to_pylist(), spans, threshold):
                    if score > best.get((row, item), (0,))[0]:
                        best[row, item] = (score, lo, hi)
                rows = [(ids[r], i, *v) for (r, i), v in best.items()]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.float64()] + [pa.int64()] * 2)],
                                                 [x.split()[0] for x in names.split(", ")])

        part = d.mapInArrow(run, names)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, share: float = SEED_SHARE,
                      threshold: float = THRESHOLD, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs`` without a contaminated passage, all columns kept."""
    for block in blocks(benchmark, block_items):
        items = prepare(docs, block, gram, share)

        @F.pandas_udf("boolean")
        def clean(texts, items=items):
            import pandas as pd
            t = [None if x is None else x.encode() for x in texts.tolist()]
            ok = np.ones(len(t), bool)
            for row, *_ in items.pairs(t, tv.Spans(), threshold):
                ok[row] = False
            return pd.Series(ok)

        docs = docs.filter(clean(F.col("text").cast("string")))
    return docs
