"""Exact substring dedup with suffix arrays (operator 8).

Every byte that is covered by a ``LENGTH``-byte string which also starts
anywhere else is removed.  The corpus is cut into shards such that equal
strings meet:

1. Anchors.  The string that starts at p belongs to the position of the
   smallest hash among its ``GRAM``-byte substrings (leftmost on ties), which
   depends on the string alone.  Neighbouring strings share anchors, about
   one per 85 bytes.
2. Strings whose anchor substring occurs once cannot repeat.  The others are
   found by a count per anchor hash (combined map-side) and a join back.
3. For them the bytes around the anchor are shuffled by the anchor hash.  A
   task packs whole anchor groups into shards of about ``SHARD`` bytes, builds
   each shard's suffix array by induced sorting (:mod:`sufsort`) and its
   permuted common prefixes, and marks the strings that share ``LENGTH``
   bytes with a neighbour.  Copies of one region enter a shard as one string
   with a count.
4. An anchor group that outgrows ``LIMIT`` bytes is not held: its regions go
   on to a further round, halved by the distance between string and anchor
   and keyed by the longer substring that the strings of a half share.  After
   at most eight rounds a key is the whole string.
5. Marked strings become covered spans per text and are cut out.

Hashes only route rows; bytes are compared in the suffix array.  Texts are
identified by MD5 and a repeated text is handled once.  Only texts with a
repeated anchor or a copy are shuffled; a bitmap of fixed size (``MAP_BITS``)
tells them apart, and where it is too full it merely lets more texts through.

Defined cases: null and empty texts have zero bytes and the digest of the
empty string; texts under ``LENGTH`` bytes lose nothing; rows repeated in
full are copies of each other; a null doc_id stays null; very long texts
are handled in one task, whole; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm import sufsort
from credence.llm import textvec as tv
from credence.llm.common import plain, stored

LENGTH = 200
GRAM = 32
SHARD = 1 << 19
LIMIT = 1 << 20
MAP_BITS = 1 << 24


def anchors(buf: np.ndarray, at: np.ndarray, length: int, gram: int, spans: tv.Spans):
    """(text, first start, number of starts, anchor - first start, hash) of
    the runs of string starts that share an anchor."""
    ends = np.concatenate((at[1:], [len(buf)])) - 1
    w = length - gram + 1
    if len(buf) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    prefix = spans.prefix(buf)
    i = np.arange(len(buf) - gram + 1)
    h = spans.hashes(prefix, i, i + gram)
    low = np.uint64((1 << len(buf).bit_length()) - 1)
    key = (h & ~low) | i.astype(np.uint64)
    blocks = -(-len(key) // w)
    a = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    a[:len(key)] = key
    a = a.reshape(blocks, w)
    head = np.minimum.accumulate(a, axis=1).ravel()
    tail = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(key) - w + 1
    best = (np.minimum(tail[:n], head[w - 1:w - 1 + n]) & low).astype(np.int64)
    counts = np.maximum(ends - at - length + 1, 0)
    doc = np.repeat(np.arange(len(at)), counts)
    p = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + at[doc]
    best = best[p]
    new = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])))) if len(p) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((new, [len(p)])))
    return doc[new], p[new] - at[doc[new]], size, best[new] - p[new], h[best[new]]


def find_anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, p, n, off, sub) of all texts (key binary, bin binary)."""
    def run(batches: Iterator[pa.RecordBatch]):
        spans = tv.Spans()
        for b in batches:
            keys = b.column("key")
            for lo, hi, buf, at in tv.chunks(b.column("bin").to_pylist(), fold=False):
                doc, p, n, off, sub = anchors(buf, at, length, gram, spans)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(doc + lo)), pa.array(p, pa.int64()), pa.array(n.astype(np.int32)),
                     pa.array(off.astype(np.int32)), pa.array(sub.view(np.int64))], ["key", "p", "n", "off", "sub"])

    return texts.mapInArrow(run, "key binary, p long, n int, off int, sub long")


def _bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """(bucket, map): which hash values the keys have, at most ``bits``."""
    v = keys.select(F.pmod(F.xxhash64("key"), F.lit(bits)).alias("v"))
    return v.groupBy(F.expr("bitmap_bucket_number(v)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(v))").alias("map"))


def _with_hit(texts: DataFrame, bitmap: DataFrame, bits: int) -> DataFrame:
    """``texts`` with ``hit``: false only where no key has the text's hash."""
    t = texts.withColumn("_v", F.pmod(F.xxhash64("key"), F.lit(bits)))
    t = t.withColumn("bucket", F.expr("bitmap_bucket_number(_v)")).withColumn("_p", F.expr("bitmap_bit_position(_v)"))
    j = t.join(F.broadcast(bitmap), "bucket", "left")  # at most bits / 8 bytes
    byte = F.conv(F.hex(F.substring(F.col("map"), F.floor(F.col("_p") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce((F.call_function("shiftright", byte, (F.col("_p") % 8).cast("int")).bitwiseAND(1) == 1), F.lit(False))
    return j.withColumn("hit", hit).drop("_v", "_p", "bucket", "map")


def cut_regions(rows: DataFrame, length: int, widest: int) -> DataFrame:
    """``REGION`` rows: the bytes around each anchor.  In a text that repeats
    itself the third and later copies of a region are sent without bytes:
    they are covered whatever the others are."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out: list[tuple] = []
            for key, text, runs in zip(b.column("key").to_pylist(), b.column("bin").to_pylist(), b.column("runs").to_pylist()):
                seen: dict[tuple, int] = {}
                for r in runs:
                    part = text[r["p"]:r["p"] + r["n"] - 1 + length]
                    seen[r["sub"], part] = times = seen.get((r["sub"], part), 0) + 1
                    # a copy without bytes meets nobody: any task will do
                    sub = r["sub"] if times < 3 else int.from_bytes(key[:7], "little") ^ r["p"] * 0x9E3779B1
                    out.append((sub, part if times < 3 else b"", key, r["p"], r["n"], r["off"], 0, widest))
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return rows.mapInArrow(run, REGION)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 8
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in REGION.split(", ")])


REGION = "sub long, text binary, key binary, p long, n int, off int, lo int, hi int"


def halve(text: bytes, p: int, n: int, off: int, lo: int, hi: int, length: int) -> list[tuple]:
    """A region's strings in two halves by their distance to the anchor
    (``off`` for the one at p, one less for each later one), each half under
    the hash of the bytes that all strings of such distances share."""
    mid, out = (lo + hi) // 2, []
    for a, z in ((lo, mid), (mid + 1, hi)):
        first, last = max(0, off - z), min(n - 1, off - a)
        if first > last:
            continue
        core = text[off - a:off - z + length]
        sub = int.from_bytes(hashlib.blake2b(core + a.to_bytes(4, "little"), digest_size=8).digest(), "little", signed=True)
        out.append((sub, text[first:last + length], p + first, last - first + 1, off - first, a, z))
    return out


def mark(rows: DataFrame, length: int, shard: int, limit: int) -> DataFrame:
    """Sorted regions to (kind 0) covered spans (key, p, n = bytes) and
    (kind 1) regions of the next round."""
    def run(batches: Iterator[pa.RecordBatch]):
        cur, groups, size, giving_up = None, [], 0, False
        held: dict[bytes, list] = {}
        held_bytes = 0
        for b in batches:
            done: list[tuple] = []
            for sub, text, key, p, n, off, lo, hi in zip(*[b.column(i).to_pylist() for i in range(8)]):
                if sub != cur:
                    if held and not giving_up:
                        groups.append(held)
                        size += held_bytes
                    cur, held, held_bytes, giving_up = sub, {}, 0, False
                    if size >= shard:
                        done += solve(groups)
                        groups, size = [], 0
                if not text:
                    done.append((0, key, p, n - 1 + length))
                    continue
                if giving_up:
                    done += later(text, key, p, n, off, lo, hi)
                    continue
                got = held.get(text)
                if got is None:
                    held[text] = [(key, p, n, off, lo, hi)]
                    held_bytes += len(text)
                    if held_bytes > limit and lo < hi:
                        for t, members in held.items():
                            for m in members:
                                done += later(t, *m)
                        held, held_bytes, giving_up = {}, 0, True
                elif len(got) == 1 and got[0][:2] != (key, p):
                    # the second copy: from now on every copy is covered as it comes
                    got.append((key, p, n, off, lo, hi))
                    done += [(0, key, p, n - 1 + length), (0, got[0][0], got[0][1], n - 1 + length)]
                elif len(got) > 1:
                    done.append((0, key, p, n - 1 + length))
            yield batch(done)
        if held and not giving_up:
            groups.append(held)
        if groups:
            yield batch(solve(groups))

    def later(text, key, p, n, off, lo, hi):
        return [(1, key, p2, n2, sub, part, off2, lo2, hi2) for sub, part, p2, n2, off2, lo2, hi2 in halve(text, p, n, off, lo, hi, length)]

    def solve(groups: list[dict]) -> list[tuple]:
        texts = [t for g in groups for t in g]
        joined = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.int16) + 2
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.cumsum(lens + 1) - (lens + 1)
        joined[start + lens] = 1  # between regions
        rep = sufsort.repeated(np.concatenate((joined, [0])).astype(np.int16), 258, length)[:-1]
        out, i = [], 0
        for g in groups:
            for members in g.values():
                if len(members) == 1:
                    key, p, n = members[0][:3]
                    on = rep[start[i]:start[i] + n]
                    if on.any():
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], on.view(np.int8), [0]))))
                        out += [(0, key, p + a, z - a - 1 + length) for a, z in zip(edge[::2].tolist(), edge[1::2].tolist())]
                i += 1
        return out

    def batch(rows_: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*[r if len(r) == 9 else r + (None,) * 5 for r in rows_])) or [()] * 9
        kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                          ["kind", "key", "p", "n", "sub", "text", "off", "lo", "hi"])

    s = rows.repartition(F.col("sub")).sortWithinPartitions("sub", "text")
    return s.mapInArrow(run, "kind int, key binary, p long, n int, sub long, text binary, off int, lo int, hi int")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, limit: int = LIMIT,
                   map_bits: int = MAP_BITS, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256; with ``keep_text`` also ``kept``, the remaining bytes."""
    if not 8 <= gram <= length:
        raise ValueError("gram must be between 8 and length")
    d = plain(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("bin"))
    d = d.withColumn("key", F.unhex(F.md5("bin")))
    found = stored(find_anchors(d.filter(F.octet_length("bin") >= length).select("key", "bin"), length, gram))
    # an anchor hash repeats if it is at two places at least
    place = F.xxhash64("key", "p")
    again = stored(found.groupBy("sub").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("sub"))
    runs = found.join(again, "sub").groupBy("key").agg(F.collect_set(F.struct("p", "n", "off", "sub")).alias("runs"))
    runs = stored(runs)
    copies = stored(d.filter(F.octet_length("bin") >= length).groupBy("key").agg(F.count("*").alias("c"), F.max(F.octet_length("bin")).alias("size")).filter("c > 1"))
    bitmap = stored(_bitmap(runs.select("key").union(copies.select("key")), map_bits))

    hit = _with_hit(d, bitmap, map_bits)
    texts = hit.filter("hit").select("key", "bin").dropDuplicates(["key"])
    rows = cut_regions(texts.join(runs, "key").select("key", "bin", "runs"), length, length - gram)
    covers = None
    for _ in range(12):
        got = stored(mark(rows, length, shard, limit))
        c = got.filter("kind = 0").select("key", "p", "n")
        covers = c if covers is None else covers.unionByName(c)
        rows = got.filter("kind = 1").select(*[x.split()[0] for x in REGION.split(", ")])
        if rows.isEmpty():
            break
    else:
        raise RuntimeError("the regions did not run out")
    covers = covers.unionByName(copies.select("key", F.lit(0).cast("long").alias("p"), F.col("size").cast("int").alias("n")))
    spans = covers.groupBy("key").agg(F.collect_set(F.struct("p", "n")).alias("spans"))

    names = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")

    def cut(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out = []
            for doc_id, text, got in zip(b.column("doc_id").to_pylist(), b.column("bin").to_pylist(), b.column("spans").to_pylist()):
                runs: list[list[int]] = []
                for p, z in sorted((s["p"], s["p"] + s["n"]) for s in got or ()):
                    if runs and p <= runs[-1][1]:  # runs that touch are one
                        runs[-1][1] = max(runs[-1][1], z)
                    else:
                        runs.append([p, z])
                kept, at = [], 0
                for p, z in runs:
                    kept.append(text[at:p])
                    at = z
                kept.append(text[at:])
                left = b"".join(kept)
                out.append((doc_id, len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left)[:5 + keep_text])
            cols = list(zip(*out)) or [()] * (5 + keep_text)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in names.split(", ")])

    touched = hit.filter("hit").join(spans, "key", "left").select("doc_id", "bin", "spans").mapInArrow(cut, names)
    size = F.octet_length("bin").cast("long")
    zero = F.lit(0).cast("long")
    rest = hit.filter("not hit").select("doc_id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
                                        F.sha2("bin", 256).alias("kept_sha256"), *([F.col("bin").alias("kept")] if keep_text else []))
    return touched.unionByName(rest)
