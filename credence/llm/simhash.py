"""SimHash near-dedup with Golay fuzzy hashing (operator 1).

A fingerprint has 64 bits: a bit is 1 if it is set in over half of the
XXH64 values (seed 42) of the text's 4-word shingles.  Two fingerprints link
when at most ``max_bits`` (4) bits differ.

Search.  The 64 bits are cut into segments of 23, 23 and 18 bits.  With four
differing bits in all, the two segments that differ least differ by two bits
together (pigeonhole).  Each segment is decoded against the perfect (23,12)
Golay code to the indices of all codewords within distance 4: one or six of
them.  Any two words at distance 2 or less share such a codeword (checked
over all cosets in the tests), so any two linked fingerprints share a pair of
codeword indices in one of the three segment pairs.  Fingerprints are joined
on these keys (about 84 each) and verified by their bit distance.

Rows of one key arrive sorted and are compared as they stream by; of a long
run only a spanning forest of its links is emitted, never all pairs.  A run
of over ``block`` fingerprints is cut into blocks whose pairs go to separate
tasks, so no task holds more than two blocks.

Defined cases: null and empty texts have fingerprint zero and link with each
other; a text of one to three words is one shingle; equal fingerprints are
collapsed first (pre-aggregated); repeated rows are kept, one output row
each; a null doc_id takes part and is ignored in the minimum; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import components, free_name, plain, stored

SEED = 42
SHINGLE = 4
MAX_BITS = 4
SEGMENTS = (23, 23, 18)
BLOCK = 200_000
GOLAY = 0xAE3  # generator polynomial of the binary (23,12) Golay code


# -- fingerprints -------------------------------------------------------------

def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text; ``bytes.split`` cuts at exactly
    the white space bytes 0x20 and 0x09-0x0D, ``bytes.lower`` maps A-Z only."""
    words = text.lower().split() if text else []
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n <= k:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lens = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lens + 1) - 1
        starts = ends - lens
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1:].tolist())]
    counts = np.zeros(64, np.int64)
    v = np.array(hashes, dtype=np.uint64)
    for i in range(0, len(v), 1 << 16):  # bounded memory for very long texts
        counts += np.unpackbits(v[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(v)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE, keyed: bool = False) -> DataFrame:
    """(doc_id long, fp long): the fingerprint's bits as a signed long;
    ``keyed``: also the row's key (its doc_id, or its text without one)."""
    d = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"),
                                             F.col("text").cast("string").alias("text"))
    if keyed:
        d = d.withColumn("key", row_key())
    names = ["doc_id", "key"] if keyed else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint(x.as_py(), k) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(fps.view(np.int64))], [*names, "fp"])

    return d.mapInArrow(run, "doc_id long, key string, fp long" if keyed else "doc_id long, fp long")


def row_key():
    """doc_id and text: rows that are equal in both are one document."""
    text = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), text)


# -- Golay keys ---------------------------------------------------------------

def _syndrome(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    for bit in range(22, 10, -1):
        x = x ^ np.where((x >> bit) & 1, GOLAY << (bit - 11), 0)
    return x


def golay_tables() -> np.ndarray:
    """For each of the 2048 syndromes: the offsets from a word to all
    codewords within distance 4 (six columns, unused ones -1)."""
    weights = [sum(1 << i for i in c) for w in range(4) for c in combinations(range(23), w)]
    out = np.full((2048, 6), -1, dtype=np.int64)
    leaders = np.array(weights, dtype=np.int64)
    syn = _syndrome(leaders)
    out[syn, 0] = leaders
    used = np.ones(2048, dtype=np.int64)
    four = np.array([sum(1 << i for i in c) for c in combinations(range(23), 4)], dtype=np.int64)
    for s, e in zip(_syndrome(four).tolist(), four.tolist()):
        # an error pattern of weight 4 leads to another codeword at distance 4
        out[s, used[s]] = e
        used[s] += 1
    return out


def golay_keys(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices of 23-bit words, -1 where a word has fewer."""
    e = table[_syndrome(words)]
    return np.where(e < 0, -1, (words[:, None] ^ e) >> 11)


def link_keys(fp: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row index): the segment pair and both codeword indices."""
    u = fp.view(np.uint64)
    seg, shift = [], 0
    for width in SEGMENTS:
        seg.append(golay_keys(((u >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64), table))
        shift += width
    keys, rows = [], []
    for p, (a, b) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        x, y = seg[a][:, :, None], seg[b][:, None, :]
        r, i, j = np.nonzero((x >= 0) & (y >= 0))
        keys.append((p << 24) | (seg[a][r, i] << 12) | seg[b][r, j])
        rows.append(r)
    return np.concatenate(keys), np.concatenate(rows)


# -- links within the runs of one key ----------------------------------------

def forest(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: search
    from one row to all rows that are not reached yet."""
    rest, us, vs = fp.view(np.uint64), [], []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                found = rest[near]
                us.append(np.full(len(found), x))
                vs.append(found)
                front.extend(found)
                rest = rest[~near]
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)


def run_links(key: np.ndarray, fp: np.ndarray, max_bits: int, short: int = 6):
    """Links within runs of equal keys (sorted): all of a short run's by
    comparing neighbours at each lag, a spanning forest of a longer run's."""
    bound = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(bound)
    us, vs = [], []
    for s in np.flatnonzero(size > short).tolist():
        u, v = forest(fp[bound[s]:bound[s + 1]], max_bits)
        us.append(u)
        vs.append(v)
    keep = np.repeat((size > 1) & (size <= short), size)
    k, f = key[keep], fp[keep].view(np.uint64)
    for lag in range(1, short):
        if len(k) <= lag:
            break
        hit = (k[lag:] == k[:-lag]) & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= max_bits)
        us.append(f[:-lag][hit].view(np.int64))
        vs.append(f[lag:][hit].view(np.int64))
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fp`` that keep every
    connected component together."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the codeword keys find links of at most 4 differing bits")

    def expand(batches):
        table = golay_tables()
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 4096):
                part = fp[i:i + 4096]
                k, r = link_keys(part, table)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(part[r])], ["key", "fp"])

    def scan(batches):
        """kind 0: a link (u, v); kind 1: a row (key, fp) of a long run's block ``no``."""
        key, fp, no, deferring = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, False

        def later(k, f, at):
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(k), np.int32)), pa.array(k), pa.array(f),
                                               pa.array(np.full(len(k), at, np.int64))], ["kind", "u", "v", "no"])

        def found(k, f):
            u, v = run_links(k, f, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(u), np.int32)), pa.array(u), pa.array(v),
                                               pa.array(np.zeros(len(u), np.int64))], ["kind", "u", "v", "no"])

        for b in batches:
            k, f = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            key, fp = np.concatenate((key, k)), np.concatenate((fp, f))
            while len(key):
                end = int(np.searchsorted(key, key[0], side="right"))
                if deferring and end < len(key):  # the long run ends
                    yield later(key[:end], fp[:end], no)
                    key, fp, no, deferring = key[end:], fp[end:], 0, False
                elif end == len(key) and end >= block:  # a long run goes on
                    yield later(key[:block], fp[:block], no)
                    key, fp, no, deferring = key[block:], fp[block:], no + 1, True
                else:
                    break
            if not deferring and len(key):
                last = int(np.searchsorted(key, key[-1], side="left"))
                if last:
                    yield found(key[:last], fp[:last])
                    key, fp = key[last:], fp[last:]
        if deferring:
            yield later(key, fp, no)
        elif len(key):
            yield found(key, fp)

    keyed = fps.select("fp").mapInArrow(expand, "key long, fp long")
    sorted_ = keyed.repartition(F.col("key")).sortWithinPartitions("key", "fp")
    got = stored(sorted_.mapInArrow(scan, "kind int, u long, v long, no long"))
    direct = got.filter("kind = 0").select("u", "v")
    long_runs = got.filter("kind = 1")
    if long_runs.isEmpty():
        return direct
    return direct.unionByName(_block_pairs(long_runs, max_bits))


def _block_pairs(rows: DataFrame, max_bits: int) -> DataFrame:
    """Long runs: each pair of blocks of a run is a group of its own."""
    last = rows.groupBy("u").agg(F.max("no").alias("last"))
    j = rows.join(last, "u").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))))
    j = j.select(F.col("u").alias("key"), F.col("v").alias("fp"), F.least("no", "other").alias("i"),
                 F.greatest("no", F.col("other").cast("long")).alias("j"))

    def pair(table: pa.Table) -> pa.Table:
        u, v = forest(np.unique(table.column("fp").to_numpy()), max_bits)
        return pa.table({"u": u, "v": v})

    return j.groupBy("key", "i", "j").applyInArrow(pair, "u long, v long")


# -- the operator -------------------------------------------------------------

def _labelled(docs: DataFrame, k: int, max_bits: int, block: int, keyed: bool) -> DataFrame:
    """The rows of :func:`fingerprints` with component_id and, if ``keyed``,
    the key of the component's first row: of its smallest doc_id (null last),
    then of the smallest key."""
    fp = stored(fingerprints(docs, k, keyed))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"] if keyed else F.lit(None).cast("string")
    distinct = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("least"), first.alias("least_key")))
    comp = components(links(distinct, max_bits, block))
    ids = stored(distinct.join(comp, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", "least_key", F.coalesce("root", "fp").alias("root")))
    least = F.min(F.struct(F.col("least").isNull(), "least", "least_key"))
    # written, so that both joins back are of two plain scans, whose skewed keys Spark splits
    roots = stored(ids.groupBy("root").agg(F.min("least").alias("component_id"), least["least_key"].alias("first_key")))
    return fp.join(stored(ids.join(roots, "root").select("fp", "component_id", "first_key")), "fp")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits),
    component_id (smallest doc_id reachable over links)."""
    return _labelled(docs, k, max_bits, block, False).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Of each component one document, with all columns: that of the smallest
    doc_id (of several texts with that doc_id the smallest digest; rows
    without doc_id last).  Rows equal in doc_id and text are one document."""
    near = _labelled(docs, k, max_bits, BLOCK, True)
    name = free_name(docs, "_row_key")
    kept = near.filter(F.col("key") == F.col("first_key")).select(F.col("key").alias(name)).distinct()
    return docs.withColumn(name, row_key()).join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
