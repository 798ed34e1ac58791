"""Operators 1, 8 and 9 against brute force, and on awkward rows."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from credence.llm import exact_dedup, simhash, suffix_dedup, sufsort
from fixtures import SF, ascii_lower, edge_docs, edge_rows, empty_docs, prose


# -- 9 ------------------------------------------------------------------------

def exact_brute(rows):
    g = defaultdict(list)
    for i, t in rows:
        g[ascii_lower(t or "")].append(i)
    out = []
    for t, ids in g.items():
        real = [i for i in ids if i is not None]
        keep, kept = max(real) if real else None, False
        for i in sorted(ids, key=lambda x: (x is not None, x)):
            out.append((i, keep, len(ids), i == keep and not kept, hashlib.sha256(t.encode()).hexdigest()))
            kept = kept or i == keep
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8, 64, 16384])
def test_exact_groups(spark, block):
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(edge_docs(spark), block).collect()), key=str)
    assert got == exact_brute(edge_rows())


def test_exact_hot_block(spark):
    rows = [(i, "the very same text") for i in range(300)] + [(1000 + i, f"other {i}") for i in range(100)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()
    assert {r.group_size for r in got if r.doc_id < 1000} == {300}
    assert [r.doc_id for r in got if r.kept and r.doc_id < 1000] == [299] and sum(r.kept for r in got) == 101


def test_exact_keep_one(spark):
    d = edge_docs(spark)
    kept = exact_dedup.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        {(i, t) for i, t in edge_rows()
         if (i, True) in {(b[0], b[3]) for b in exact_brute(edge_rows()) if b[4] == hashlib.sha256(ascii_lower(t or "").encode()).hexdigest()}}, key=str)
    assert exact_dedup.keep_one(empty_docs(spark)).count() == exact_dedup.exact_groups(empty_docs(spark)).count() == 0


# -- 1 ------------------------------------------------------------------------

def fp_brute(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", ascii_lower(t or "")) if x]
    if not w:
        return 0
    sh = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_brute(ids, fps, bits=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprint():
    for _, t in edge_rows():
        assert simhash.fingerprint(None if t is None else t.encode()) == fp_brute(t)


def test_near_duplicates(spark):
    rows = edge_rows()
    fps = [fp_brute(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], components_brute([i for i, _ in rows], fps)), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(edge_docs(spark)).collect()), key=str) == want
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


def test_registered_query_on_the_table(spark):
    from credence.llm.entry import QUERIES
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = [fp_brute(r.text) for r in docs]
    want = {(r.doc_id, f"{f:016x}", c) for r, f, c in zip(docs, fps, components_brute([r.doc_id for r in docs], fps))}
    assert {tuple(r) for r in QUERIES["op1_simhash"](spark, SF).collect()} == want


def test_golay_keys_share():
    table, rng = simhash.golay_tables(), np.random.default_rng(5)
    words = rng.integers(0, 1 << 23, 3000)
    for flips in (0, 1, 2):
        other = words.copy()
        for _ in range(flips):
            other ^= 1 << rng.integers(0, 23, len(words))
        a, b = simhash.golay_keys(words, table), simhash.golay_keys(other, table)
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b))


@pytest.mark.parametrize("block", [3, 1000])
def test_all_links_within_four_bits(spark, block):
    """Dense clusters around random centres; tiny blocks force the block-pair path."""
    rng = np.random.default_rng(9)
    fps = []
    for c in rng.integers(0, 1 << 62, 6).tolist():
        for _ in range(40):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                x ^= 1 << b
            fps.append(x)
    signed = np.unique(np.array(fps, dtype=np.uint64)).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp LONG")
    from credence.llm.common import components
    comp = {r.node: r.root for r in components(simhash.links(df, 4, block)).collect()}
    want = components_brute(signed.tolist(), [int(x) & (1 << 64) - 1 for x in signed])
    assert [comp.get(int(x), int(x)) for x in signed] == want


def test_simhash_keep_one(spark):
    d = edge_docs(spark)
    kept = simhash.keep_one(d)
    rows = edge_rows()
    comp = components_brute([i for i, _ in rows], [fp_brute(t) for _, t in rows])
    want = sorted({c for c in comp if c is not None})
    got = [r.doc_id for r in kept.collect()]
    assert kept.columns == d.columns and sorted(x for x in got if x is not None) == want
    assert got.count(None) == len([1 for c in comp if c is None]) <= 1


# -- 8 ------------------------------------------------------------------------

def cut_brute(rows, length):
    where = defaultdict(int)
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        for p in range(len(b) - length + 1):
            where[b[p:p + length]] += 1
    out = []
    for i, b in data:
        on = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - length + 1):
            if where[b[p:p + length]] > 1:
                on[p] += 1
                on[p + length] -= 1
        on = np.cumsum(on)[:-1] > 0
        kept = bytes(x for x, f in zip(b, on) if not f)
        spans = int((np.diff(np.concatenate(([0], on.astype(int)))) == 1).sum())
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,gram,limit", [(200, 32, 1 << 20), (50, 16, 1 << 20), (50, 16, 400)])
def test_remove_repeats(spark, length, gram, limit):
    """A tiny limit sends every group through the halving rounds."""
    rows = [(i, t[:6000] if t else t) for i, t in edge_rows()] + [(30, prose(1, 120)[:333]), (31, "a" * 300), (32, prose(7, 80))]
    d = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    got = suffix_dedup.remove_repeats(d, length, gram, 1 << 16, limit).collect()
    assert sorted((tuple(r) for r in got), key=str) == cut_brute(rows, length)


def test_remove_repeats_shapes(spark):
    assert suffix_dedup.remove_repeats(empty_docs(spark)).count() == 0
    got = suffix_dedup.remove_repeats(edge_docs(spark), keep_text=True).collect()
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in got) and len(got) == len(edge_rows())


def test_registered_cut_on_the_table(spark):
    from credence.llm.entry import QUERIES
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op8_suffix_dedup"](spark, SF).collect()), key=str) == cut_brute(docs, 200)


def test_suffix_array():
    rng = np.random.default_rng(3)
    for _ in range(150):
        a = int(rng.choice([1, 2, 3, 20]))
        t = np.concatenate((rng.integers(1, a + 1, rng.integers(1, 200)), [0])).astype(np.int16)
        raw = t.astype(np.uint8).tobytes()
        sa = sufsort.suffix_array(t, a + 1, 1 << 20)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: raw[i:])
        lcp = sufsort.permuted_lcp(t, sa, 500)
        for x, y in zip(sa[:-1].tolist(), sa[1:].tolist()):
            n = 0
            while x + n < len(raw) and y + n < len(raw) and raw[x + n] == raw[y + n]:
                n += 1
            assert lcp[y] == n


def test_unlike_rows_of_one_doc_id_stay(spark):
    a, b, c = prose(81, 90), prose(82, 90), prose(83, 90)
    rows = [(5, a, "x"), (5, b, "x"), (5, b, "x"), (6, a, "y"), (None, c, "z"), (None, c, "z"), (7, c, "w"), (5, b + " tail", "u")]
    d = spark.createDataFrame(rows, "doc_id LONG, text STRING, _row_key STRING")
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    near = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(d).collect()}
    got = sorted((r.doc_id, r.text) for r in kept.collect())
    same = len({v for (i, _), v in near.items() if i == 5}) >= 1
    assert same and (5, a) in got and (7, c) in got and sum(t in (b, b + " tail") for _, t in got) in (1, 2) and all(i is not None for i, _ in got)
    only = simhash.keep_one(spark.createDataFrame([(5, a), (5, b)], "doc_id LONG, text STRING"))
    assert sorted((r.doc_id, r.text) for r in only.collect()) == sorted([(5, a), (5, b)])
    e = exact_dedup.keep_one(spark.createDataFrame([(1, "Q", "k"), (2, "q", "k")], "doc_id LONG, text STRING, _key STRING"))
    assert [tuple(r) for r in e.collect()] == [(2, "q", "k")]
