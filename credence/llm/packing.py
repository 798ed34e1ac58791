"""Vector bin packing of token sequences (operator 2).

Every document becomes ids (tokenizer, then ``END``), is cut into full
sequences of ``capacity`` ids and a remainder, and the remainders are packed.
A sequence has three limits at once: ids, segments (pieces) and loss-bearing
ids.  A sequence is filled bin by bin with the dot-product heuristic: of the
waiting remainders that fit, the one whose demand vector has the largest dot
product with the free capacity (both as shares of the limits) goes in.  When
none fits and a worthwhile gap is left, the largest waiting remainder is cut
to fill it.

Each task packs the documents of its own partition, so no ids are shuffled;
at most ``window`` remainders wait at a time.  The last, unfilled sequence of
a task is cut at powers of two, which are not padded.  Sequence ids are made
of the partition number and a counter, so a task that runs again makes the
same ones.

Defined cases: a null text counts as empty and has the one id ``END``; very
long texts are cut as they come, with the pieces of one document at hand;
ties in the heuristic go to the remainder that waited longest; repeated rows
are packed each by itself; a null doc_id stays null; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import plain

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 1
CAPACITY = 2048
MAX_SEGMENTS = 64
WINDOW = 256
LEAST_CUT = 8
CACHE = 500_000

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, loss_tokens long")


#: a piece that ends in ASCII symbols after a letter (ASCII or Latin-1): the
#: tokenizer's split pattern always separates the two, save at an apostrophe
TRAIL = re.compile(rb"([^']*(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([^A-Za-z0-9'\x80-\xff]+)")

#: lower-case letters of ASCII and Latin-1 alone: one token of the split
#: pattern that the normalizer leaves as it is
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def byte_level() -> dict[int, int]:
    """The tokenizer's alphabet: printable Latin-1 bytes stand for
    themselves, the others, in order, for the code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: 256 + i for i, b in enumerate(others)}


class WordIds:
    """Ids of texts, as little-endian unsigned 32-bit bytes.

    This tokenizer folds case and never joins characters across white space
    (its normalizer and its split pattern both stop there), so a text's ids
    are those of its white-space pieces in turn, A-Z folded or not.  Pieces
    seen before come from a bounded cache.  Of the others plain words go
    straight to the tokenizer's model, the rest to the whole tokenizer as one
    string in which the ids' offsets tell the pieces apart.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok, self.size, self.known = Tokenizer.from_file(path), cache, {}
        self.model, self.alphabet = self.tok.model, byte_level()
        self.number = [i.to_bytes(4, "little") for i in range(max(self.tok.get_vocab().values()) + 1)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # the special tokens are lower case: fold no text that may hold one in capitals
        pieces = [(t if b"<|" in t else t.lower()).split() for t in texts]
        known = self.known
        new = set().union(*pieces).difference(known)
        if len(known) + len(new) > self.size:
            known = self.known = {}
            new = set().union(*pieces)
        # ASCII letters alone (most new pieces) have no trail
        parts = [(w, m) for w in new if not w.isalpha() and (m := TRAIL.fullmatch(w)) and b"<|" not in w]
        split = {w for w, _ in parts}
        fresh = new - split
        fresh.update(x for _, m in parts for x in m.groups() if x not in known)
        self.learn(list(fresh))
        for w, m in parts:
            known[w] = known[m[1]] + known[m[2]]
        return [b"".join(map(known.__getitem__, p)) for p in pieces]

    def learn(self, words: list[bytes]) -> None:
        tokenize, alphabet, plain_words = self.model.tokenize, self.alphabet, LETTERS.fullmatch
        known, number = self.known, self.number
        rest = []
        for w in words:
            if (w.isalpha() and w.islower()) or plain_words(w):
                x = w.decode("latin-1")
                if not x.isprintable():  # the bytes that do not stand for themselves
                    x = x.translate(alphabet)
                known[w] = b"".join([number[t.id] for t in tokenize(x)])
            else:
                rest.append(w)
        words = rest
        for i in range(0, len(words), 2048):
            part = [w.decode() for w in words[i:i + 2048]]
            e = self.tok.encode(" ".join(part), add_special_tokens=False)
            lens = np.fromiter(map(len, part), np.int64, len(part)) + 1
            begin = np.cumsum(lens) - lens
            at = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
            cut = np.searchsorted(at, begin)
            ids = np.array(e.ids, dtype="<u4").tobytes()
            for w, a, z in zip(words[i:i + 2048], (4 * cut).tolist(), (4 * np.concatenate((cut[1:], [len(at)]))).tolist()):
                self.known[w] = ids[a:z]


class Packer:
    """Packs remainders (doc_id, start, ids, doc_tokens, loss) of one task."""

    def __init__(self, base: int, capacity: int, max_segments: int, max_loss: int, window: int):
        self.next, self.cap, self.window = base, capacity, window
        self.limits = np.array([capacity, max_segments, max_loss], dtype=np.float64)
        self.items: list[tuple] = []
        self.demand = np.zeros((0, 3))
        self.out: list[tuple] = []

    def place(self, items: list[tuple]) -> None:
        """One sequence with these pieces, without gaps."""
        offset = 0
        for doc_id, start, ids, doc_tokens, loss in items:
            self.out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, self.next, offset, loss))
            offset += len(ids) // 4
        self.next += 1

    def add(self, items: list[tuple]) -> None:
        self.items += items
        self.demand = np.vstack([self.demand, np.array([[len(i[2]) // 4, 1, i[4]] for i in items], dtype=np.float64).reshape(-1, 3)])
        while len(self.items) > self.window:
            self.fill()

    def take(self, at: int) -> tuple:
        self.demand = np.delete(self.demand, at, axis=0)
        return self.items.pop(at)

    def fill(self) -> None:
        """One sequence, or the last ones if what waits doesn't fill it."""
        free, chosen = self.limits.copy(), []
        while free[0] > 0 and free[1] > 0 and self.items:
            fits = (self.demand <= free).all(axis=1)
            if fits.any():
                score = np.where(fits, (self.demand / self.limits) @ (free / self.limits), -1)
                item = self.take(int(score.argmax()))
            else:
                at = int(self.demand[:, 0].argmax())
                n, loss = len(self.items[at][2]) // 4, self.items[at][4]
                size = min(int(free[0]), n - 1, int(free[2]) + n - loss)
                if size < LEAST_CUT:
                    break
                item, rest = _cut(self.items[at], size)
                self.items[at] = rest
                self.demand[at] = (n - size, 1, rest[4])
            chosen.append(item)
            free -= (len(item[2]) // 4, 1, item[4])
        if self.items or free[0] < LEAST_CUT:
            self.place(chosen)
            return
        # the last sequence is not full: cut it at powers of two, which are not padded
        for size in _runs(self.cap - int(free[0])):
            part = []
            while size:
                item = chosen.pop(0)
                if len(item[2]) // 4 > size:
                    item, rest = _cut(item, size)
                    chosen.insert(0, rest)
                part.append(item)
                size -= len(item[2]) // 4
            self.place(part)

    def rows(self) -> list[tuple]:
        got, self.out = self.out, []
        return got


def _cut(item: tuple, size: int) -> tuple[tuple, tuple]:
    """The first ``size`` ids of a piece and the rest.  Loss-bearing ids are
    the last ones of a piece."""
    doc_id, start, ids, doc_tokens, loss = item
    n = len(ids) // 4
    head = max(0, loss - (n - size))
    return (doc_id, start, ids[:4 * size], doc_tokens, head), (doc_id, start + size, ids[4 * size:], doc_tokens, loss - head)


def _runs(total: int) -> list[int]:
    """Powers of two, largest first, that sum to ``total``."""
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, capacity: int = CAPACITY,
         max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, window: int = WINDOW,
         loss_from: str | None = None) -> DataFrame:
    """One row per piece (see ``SCHEMA``).  ``loss_from`` names a column with
    the number of leading ids that bear no loss; without it all ids do."""
    names = ["doc_id", "text"] + ([loss_from] if loss_from else [])
    d = plain(docs, *names)
    d = d.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                 (F.coalesce(F.col(loss_from).cast("long"), F.lit(0)) if loss_from else F.lit(0).cast("long")).alias("skip"))
    most_loss = capacity if max_loss is None else max_loss
    if not 0 < most_loss <= capacity or max_segments < 1:
        raise ValueError("limits must be positive and max_loss at most the capacity")
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = WordIds(tokenizer)
        p = Packer(TaskContext.get().partitionId() << 32, capacity, max_segments, most_loss, window)
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                texts = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
                rows = zip(part.column("doc_id").to_pylist(), part.column("skip").to_pylist(), enc.encode(texts))
                p.add([x for doc_id, skip, ids in rows for x in pieces(p, doc_id, skip, ids + tail)])
                if p.out:
                    yield batch(p.rows())
        while p.items:
            p.fill()
            if len(p.out) > 4096 or not p.items:
                yield batch(p.rows())

    def pieces(p: Packer, doc_id, skip: int, ids: bytes) -> list[tuple]:
        total, start, waiting = len(ids) // 4, 0, []
        while start < total:
            size = min(capacity, total - start)
            loss = max(0, start + size - max(start, skip))
            if loss > most_loss:  # the loss limit ends this piece early
                size -= loss - most_loss
                loss = most_loss
            item = (doc_id, start, ids[4 * start:4 * (start + size)], total, loss)
            if size == capacity:
                p.place([item])
            else:
                waiting.append(item)
            start += size
        return waiting

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names_ = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names_)

    return d.mapInArrow(run, SCHEMA)
