"""Operators 3, 4, 5 and 6: held-out accuracy, brute force, awkward rows."""

import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.llm import decontaminate, passages, quality, toxicity
from credence.llm import textvec as tv
from fixtures import SF, ascii_upper, edge_docs, edge_rows, empty_docs, prose, vocabulary

SF01 = "/root/testdata/sf0.01"
SF1 = "/root/testdata/sf0.1"


def labelled(spark, label, n=240):
    v = vocabulary()
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        t = prose(100 + i, 60)
        if bad:
            w = t.split()
            if label == "quality":
                t = " ".join(x + "%%%" for x in w)
            else:
                for k in (5, 25, 45):
                    w[k] = "blorgh" + v[(i + k) % 50][:2]
                t = " ".join(w)
        rows.append((i, t))
        labels.append((i, int(not bad) if label == "quality" else int(bad)))
    return (spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3),
            spark.createDataFrame(labels, f"doc_id LONG, {label} INT"))


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_held_out_accuracy(spark, label):
    docs, labels = labelled(spark, label)
    op, folds, held = (quality, 3, 1) if label == "quality" else (toxicity, 4, 2)
    got = op.classify(docs, labels).collect()
    truth = {r[0]: r[1] for r in labels.collect()}
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in got)
    assert all(r.predicted == int(r.score >= (0.5 if label == "quality" else 0.3)) for r in got)
    out = [r.predicted == truth[r.doc_id] for r in got if r.held_out]
    assert sum(out) >= 0.95 * len(out)


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_held_out_labels_are_never_read(spark, label):
    """Turning every held-out label around changes no score."""
    docs, labels = labelled(spark, label, 150)
    op, folds, held = (quality, 3, 1) if label == "quality" else (toxicity, 4, 2)
    turned = labels.withColumn(label, F.when(quality.held_out(folds=folds, held=held), 1 - F.col(label)).otherwise(F.col(label)))
    key = lambda d: {r.doc_id: r.score for r in d.collect()}
    assert key(op.classify(docs, labels)) == key(op.classify(docs, turned))


@pytest.mark.parametrize("op,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_edges(spark, op, label):
    docs, labels = labelled(spark, label, 90)
    d = edge_docs(spark)
    both = docs.unionByName(d.select("doc_id", "text"))
    got = op.classify(both, labels).collect()
    assert len(got) == 90 + len(edge_rows()) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert op.classify(empty_docs(spark), labels).count() == 0
    none = labels.filter("doc_id < 0")
    assert {r.score for r in op.classify(d, none).collect()} == {0.5 if op is quality else 0.0}
    one = labels.filter(f"{label} = 1")
    assert {r.score for r in op.classify(both, one).collect()} == {1.0}


def test_on_the_tables(spark):
    from credence.llm.entry import QUERIES
    for name, label, least in (("op3_quality", "quality", 0.97), ("op5_toxicity", "toxic", 0.9)):
        truth = {r.doc_id: r[1] for r in spark.read.parquet(f"{SF1}/labels.parquet").select("doc_id", label).collect()}
        rows = [r for r in QUERIES[name](spark, SF1).collect() if r.held_out and r.doc_id in truth]
        assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) >= least


def test_kneser_ney_against_brute_force(spark):
    """Shared backoff probabilities from a plain implementation."""
    from collections import Counter, defaultdict

    import pyspark.sql.functions as F
    words = ["abra", "cadabra", "abracad", "bra"]
    n = toxicity.ORDER
    grams = sorted({w[i:i + n] for x in words for w in [b"\x02" * (n - 1) + x.encode() + b"\x03"] for i in range(len(w) - n + 1)})
    df = spark.createDataFrame([(int.from_bytes(g, "big"),) for g in grams], "gram LONG")
    got = {r.g: r.p for r in toxicity.shared_backoff(df).collect()}
    level, levels = Counter(grams), []
    for k in range(n - 1, 0, -1):
        level = Counter(g[-k:] for g in level)
        levels.append(level)
    p = {}
    for k, c in zip(range(1, n), reversed(levels)):
        tot, kinds = defaultdict(int), defaultdict(int)
        for g, m in c.items():
            tot[g[:-1]] += m
            kinds[g[:-1]] += 1
        n1, n2 = sum(m == 1 for m in c.values()), sum(m == 2 for m in c.values())
        d = max(0.1, n1 / (n1 + 2 * n2)) if n1 + n2 else 0.5
        p = {g: max(m - d, 0) / tot[g[:-1]] + d * kinds[g[:-1]] / tot[g[:-1]] * (p[g[1:]] if k > 1 else 1 / 256) for g, m in c.items()}
    assert {int.from_bytes(g, "big"): pytest.approx(v) for g, v in p.items()} == got
    keys = np.array([1, -5, 1 << 47, 123456789], dtype=np.int64)
    want = [r[0] for r in spark.createDataFrame([(int(k),) for k in keys], "k LONG").select(F.pmod(F.xxhash64("k"), F.lit(1 << 21))).collect()]
    assert toxicity._slots(keys, 21).tolist() == want


def test_class_counts_of_all_labels(spark):
    """Blocks of labels count as one: each labelled document once, none left out."""
    docs, labels = labelled(spark, "toxic", 60)
    lab = labels.select("doc_id", F.col("toxic").alias("y"))
    key = lambda block: {r.gram: tuple(r) for r in toxicity.gather(docs, lab, block).collect()}
    got = key(7)
    assert got == key(1000) and all(r[1] + r[2] == r[3] for r in got.values())


def test_no_ngram_is_evicted():
    """Many keys for each slot: every one keeps its value."""
    import pyarrow as pa
    key = np.arange(500, dtype=np.int64) * 7919 + 300
    kind = np.repeat([0, 1], 250)
    value = np.arange(500).astype(np.float32)
    r = toxicity.Ratios(pa.table({"kind": kind, "key": key, "value": value, "slot": toxicity._slots(key, 4)}), 4)
    assert (r(key[:250]) == value[:250]).all() and (r(key[250:] << 8) == value[250:]).all()


# -- 4 ------------------------------------------------------------------------

def sw_brute(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.OTHER
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
    return int(h.max())


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 30))
        score, end = decontaminate.align(a, b)
        assert score == sw_brute(a, b) == sw_brute(a, b[:end])


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())


def test_contaminated_pairs(spark):
    items = [(1, prose(50, 20)), (2, prose(51, 30)), (3, "too short"), (4, None), (5, "")]  # the third is nowhere
    w = items[1][1].split()
    edited = w[:10] + ["changed"] + w[11:20] + w[21:]
    rows = [(1, prose(60, 100) + " " + ascii_upper(items[0][1]) + " " + prose(61, 50)), (2, prose(62, 80) + " " + " ".join(edited)),
            (3, prose(63, 200)), (None, items[0][1]), (4, None), (5, ""), (6, items[0][1] + " and " + items[1][1]), (6, items[0][1]),
            (7, " ".join(w[:8]) + " " + prose(64, 40))]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    bench = spark.createDataFrame(items, "item_id LONG, text STRING")
    for block in (20_000, 2):
        got = decontaminate.contaminated_pairs(docs, bench, block_items=block).collect()
        assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted(
            [(1, 1), (2, 2), (None, 1), (6, 1), (6, 2), (6, 1)], key=str)
    for r in got:
        if (r.doc_id, r.item_id) == (1, 1):
            assert (r.score, r.first_word, r.end_word) == (1.0, 100, 120)
    clean = decontaminate.drop_contaminated(docs, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 7]
    assert decontaminate.contaminated_pairs(docs, bench.filter("item_id < 0")).count() == 0
    assert decontaminate.contaminated_pairs(empty_docs(spark), bench).count() == 0
    edge = edge_docs(spark)
    assert decontaminate.drop_contaminated(edge, bench).columns == edge.columns


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_short_items_count_word_for_word(spark, n):
    item = ["what", "is", "the", "capital", "of", "old", "france"][:n]
    text = " ".join(item)
    rows = [(1, prose(70, 30) + " " + text.upper() + "? " + prose(71, 10)), (2, " ".join([*item[:-1], "other"])), (3, text), (4, text + " " + text),
            (5, "x".join(item) + "x"), (6, None), (7, prose(72, 50))]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    bench = spark.createDataFrame([(1, text), (2, text), (3, "nowhere to be found"), (4, "...")], "item_id LONG, text STRING")
    got = sorted((r.doc_id, r.item_id, r.score, r.first_word, r.end_word) for r in decontaminate.contaminated_pairs(docs, bench).collect())
    assert got == [(d, i, 1.0, at, at + n) for d, at in ((1, 30), (3, 0), (4, 0)) for i in (1, 2)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [2, 5, 6, 7]


def test_decontamination_against_brute_force(spark):
    """All pairs of the small tables that reach the threshold anywhere."""
    from credence.llm.entry import QUERIES
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = set()
    for b in bench:
        ids = {w: i for i, w in enumerate(dict.fromkeys(words(b.text)))}
        a = np.array([ids[w] for w in words(b.text)])
        for d in docs:
            w = np.array([ids.get(x, -1) for x in words(d.text)])
            if len(w) and (w >= 0).sum() >= len(a) / 2:
                score, _ = decontaminate.align(a, w)
                if score >= decontaminate.THRESHOLD * decontaminate.MATCH * len(a):
                    want.add((d.doc_id, b.item_id))
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_decontaminate"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_descent_reaches_the_hinge_optimum(seed):
    """The gap between the loss and its dual, with the multipliers read off the weights."""
    g = np.random.default_rng(seed)
    n, dim = 40, 400
    lists = [np.sort(g.choice(dim, g.integers(5, 30), replace=False)) for _ in range(n)]
    off, cols = np.concatenate(([0], np.cumsum([len(x) for x in lists]))), np.concatenate(lists)
    y = np.where(g.random(n) < 0.35, 1, -1)
    r = g.normal(size=dim)
    w, bias = quality.descend(off, cols, y, r, quality.COST, quality.EPOCHS)
    scale = quality.unit_rows(off, r[cols])
    x = np.zeros((n, dim + 1))
    for i, c in enumerate(lists):
        x[i, c] = r[c] * scale[i]
        x[i, dim] = quality.BIAS * scale[i]
    assert np.allclose((x ** 2).sum(axis=1), 1)
    full = np.concatenate((w, [bias]))
    a, *_ = np.linalg.lstsq((x * y[:, None]).T, full, rcond=None)
    upper = quality.COST * n / 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    assert np.allclose((x * y[:, None]).T @ a, full, atol=1e-8) and (a > -1e-6).all() and (a < upper + 1e-6).all()
    primal = 0.5 * full @ full + (upper * np.maximum(0, 1 - y * (x @ full))).sum()
    dual = a.sum() - 0.5 * full @ full
    assert 0 <= primal - dual + 1e-9 and primal - dual < 1e-3 * max(1.0, primal)


# -- 6 ------------------------------------------------------------------------

def test_compact_windows_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lens = rng.integers(1, 60, 3)
        doc = np.repeat(np.arange(3), lens)
        n, w = len(doc), 8
        low = np.uint64((1 << n.bit_length()) - 1) if isinstance(n, int) else np.uint64(255)
        low = np.uint64((1 << int(n).bit_length()) - 1)
        key = (rng.integers(0, 40, n).astype(np.uint64) << np.uint64(20)) & ~low | np.arange(n, dtype=np.uint64)
        edge = np.searchsorted(doc, np.arange(4))
        c, left, right = passages.compact_windows(key, doc, edge[doc], edge[doc + 1] - 1, w, low)
        want = []
        for i in range(n):
            a = b = i
            while a > edge[doc[i]] and key[a - 1] > key[i]:
                a -= 1
            while b < edge[doc[i] + 1] - 1 and key[b + 1] > key[i]:
                b += 1
            if b - a + 1 >= w:
                want.append((i, i - a, b - i))
        assert list(zip(c.tolist(), left.tolist(), right.tolist())) == want


def passage_rows():
    p = [prose(70 + i, 60) for i in range(4)]
    w = p[1].split()
    near = " ".join(w[:25] + ["changed"] + w[26:])
    short = prose(99, 12)
    rows = [(1, prose(200, 80) + " " + p[0] + " " + prose(201, 70)), (2, prose(202, 30) + " " + ascii_upper(p[0])),
            (3, p[1] + " " + prose(203, 90)), (4, prose(204, 50) + " " + near), (5, prose(205, 300)), (6, prose(206, 90)),
            (7, prose(206, 90)), (8, None), (9, ""), (None, prose(207, 40) + " " + p[0])]
    rows += [(100 + i, prose(300 + i, 40) + " " + short + " " + prose(400 + i, 40)) for i in range(40)]
    return rows


def test_shared_passages(spark):
    docs = spark.createDataFrame(passage_rows(), "doc_id LONG, text STRING").repartition(3)
    got = {r.doc_id: r for r in passages.shared_passages(docs).collect()}
    assert set(got) == {1, 2, 3, 4, 6, 7, None}  # a shared line of 12 words is no passage
    assert {d: got[d].class_id for d in got} == {1: 1, 2: 1, None: 1, 3: 3, 4: 3, 6: 6, 7: 6}
    assert [tuple(x) for x in got[1].passages] == [(80, 140)] and [tuple(x) for x in got[6].passages] == [(0, 90)]
    assert got[1].n_links >= 1 and got[7].n_links == 1
    assert passages.shared_passages(empty_docs(spark)).count() == 0
    edge = {r.doc_id for r in passages.shared_passages(edge_docs(spark)).collect()}
    assert {1, 2, 7, 8, 9, 10, 14, 17} <= edge and not edge & {4, 5, 6, 11, 12, 13, None}


def test_passages_against_brute_force(spark):
    """Every run of 49 words that two documents share lies in a passage, and
    every reported passage is similar to one elsewhere."""
    from collections import defaultdict

    from credence.llm.entry import QUERIES
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in QUERIES["op6_passages"](spark, SF01).collect()}
    toks = {d: re.findall(rb"[a-z0-9\x80-\xff]+", t.encode().lower()) for d, t in docs.items()}
    runs = defaultdict(set)
    for d, w in toks.items():
        for i in range(len(w) - 48):
            runs[hash(tuple(w[i:i + 49]))].add(d)
    for d, w in toks.items():
        for i in range(len(w) - 48):
            if len(runs[hash(tuple(w[i:i + 49]))]) > 1:
                assert any(s.first_word <= i and i + 49 <= s.end_word for s in got[d].passages)
    sets = {d: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} for d, w in toks.items()}
    where = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            where[x].add(d)
    for d, r in got.items():
        for s in r.passages:
            own = [tuple(toks[d][i:i + 5]) for i in range(s.first_word, s.end_word - 4)]
            shared = [sum(x in sets[o] for x in own) for o in set().union(*(where[x] for x in own)) - {d}]
            assert len(own) >= passages.WIDTH - 5 and shared and max(shared) >= 0.5 * len(own)


def classes_brute(rows, verify_all):
    """Class of each text from all pairs, or from all candidates of the windows."""
    spans, n = tv.Spans(), len(rows)
    sh = [passages.shingles(t.encode(), passages.SHINGLE, spans) for _, t in rows]
    at = [(d, k, x, y) for d, k, _, x, y, _, _ in zip(*map(np.concatenate, zip(*passages.text_windows(
        [t.encode() for _, t in rows], passages.HASHES, passages.WIDTH, passages.SIDE, passages.SHINGLE, spans))))]
    near = {(i, j) for i in range(n) for j in range(i)} if verify_all else {
        (max(d, e), min(d, e)) for d, k, x, y in at for e, m, u, v in at if k == m and d != e and min(x, u) + min(y, v) + 1 >= passages.WIDTH}
    root = list(range(n))
    for i, j in sorted(near):
        if root[i] != root[j] and passages.verify(sh[i], sh[j], passages.WIDTH, passages.SIMILARITY):
            root = [root[j] if r == root[i] else r for r in root]
    ids = [i for i, _ in rows]
    return {ids[i]: min(ids[k] for k in range(n) if root[k] == root[i]) for i in range(n) if root.count(root[i]) > 1}


@pytest.mark.parametrize("block", [passages.BLOCK, 7])
def test_families_against_brute_force(spark, block):
    """Copies unlike their group's head, and passages around a phrase that many texts hold."""
    import random
    r = random.Random(4)
    edited = []
    for f in range(6):
        p = prose(500 + f, 55).split()
        for i in range(14):
            w = list(p)
            for at in r.sample(range(55), 2):
                w[at] = f"edit{f}x{i}x{at}"
            edited.append((100 * f + i, prose(2000 + 50 * f + i, 30 + i) + " " + " ".join(w) + " " + prose(4000 + 50 * f + i, 30)))
    phrase = prose(600, 40)
    common = [(1000 + 2 * i + k, prose(6000 + 2 * i + k, 25 + (3 * i + 7 * k) % 20) + " " + prose(7000 + i, 8) + " " + phrase + " " + prose(8000 + i, 8) + " " + prose(9000 + 2 * i + k, 30))
              for i in range(20) for k in range(2)]
    for rows, verify_all in ((edited, False), (common, True)):
        docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
        got = {x.doc_id: x.class_id for x in passages.shared_passages(docs, block=block).collect()}
        assert got == classes_brute(rows, verify_all)


def test_edited_passages_are_found(spark):
    """Pairs of texts around passages of 50 to 160 words with word edits, against all pairs."""
    import random
    r = random.Random(8)
    rows = []
    for i in range(60):
        p = prose(20_000 + i, 50 + (i * 11) % 111).split()
        w = list(p)
        for _ in range(1 + (len(p) > 90)):
            at = r.randrange(len(w))
            kind = r.choice("cid")
            w[at:at + (kind != "i")] = [] if kind == "d" else [f"edit{i}x{at}"]
        rows += [(2 * i, prose(30_000 + i, 40) + " " + " ".join(p) + " " + prose(40_000 + i, 20)),
                 (2 * i + 1, prose(50_000 + i, 15) + " " + " ".join(w) + " " + prose(60_000 + i, 60))]
    spans = tv.Spans()
    sh = {i: passages.shingles(t.encode(), passages.SHINGLE, spans) for i, t in rows}
    want = {i for i in range(60) if passages.verify(sh[2 * i], sh[2 * i + 1], passages.WIDTH, passages.SIMILARITY)}
    got = {x.doc_id: x.class_id for x in passages.shared_passages(
        spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)).collect()}
    found = {i for i in range(60) if got.get(2 * i) == got.get(2 * i + 1) == 2 * i}
    assert len(want) > 40 and found <= want and len(found) >= 0.95 * len(want), (len(found), len(want))


def test_all_places_of_a_key():
    doc = np.zeros(4, np.int64)
    key, ctx = np.array([5, 5, 5, 5]), np.array([1, 1, 1, 2])
    kept = passages.widest(doc, key, ctx, np.array([30, 20, 10, 0]), np.array([10, 20, 15, 9]))
    assert sorted(kept.tolist()) == [0, 1, 3]


@pytest.mark.parametrize("few, block", [(passages.FEW, passages.BLOCK), (2, 7), (40, 512)])
def test_all_links_of_a_passage_count(spark, few, block):
    """30 texts around one passage, some with a second one that the group's head lacks."""
    rows = [(i, prose(2000 + i, 20 + i) + " " + prose(700, 60) + " " + prose(3000 + i, 40) + (" " + prose(701, 55) if i % 3 == 1 else ""))
            for i in range(30)]
    docs = spark.createDataFrame(rows + [(90, rows[4][1])], "doc_id LONG, text STRING").repartition(3)
    got = {r.doc_id: r for r in passages.shared_passages(docs, few=few, block=block).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: 30 if i in (4, 90) else 29 for i in [*range(30), 90]}
    assert {r.class_id for r in got.values()} == {0}
    assert all(len(got[i].passages) == (2 if i % 3 == 1 else 1) for i in range(30) if i != 4)


def overlapping_families(n):
    """Edited copies of one long text, some with a phrase that texts unlike them have, too."""
    import random
    r = random.Random(n)
    base, phrase = prose(40, 200).split(), prose(41, 30)
    rows = []
    for i in range(n):
        w = list(base)
        for at in r.sample(range(200), 4):
            w[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(w) + (" " + phrase if i % 4 == 0 else "")))
    return rows + [(500 + i, prose(5000 + i, 60) + " " + phrase + " " + prose(6000 + i, 40)) for i in range(n)] + [
        (900 + i, prose(42, 60) + f" tail{i} " + phrase + " " + prose(7000 + i, 30)) for i in range(n // 2)]


def test_texts_of_overlapping_groups_travel_few_times(spark):
    """A text that has many large groups goes to the few blocks where their texts live, not to each group."""
    d = spark.createDataFrame(overlapping_families(40), "doc LONG, text STRING")
    w = passages.shared_windows(passages.window_table(d, passages.HASHES, passages.WIDTH, passages.SIDE, passages.SHINGLE)).cache()
    large = w.join(w.groupBy("key").agg(F.count("*").alias("n")).filter("n > 16"), "key").cache()
    got = passages.meeting_blocks(large, passages.BLOCK).collect()
    assert len(got) == large.select("doc").distinct().count()
    travels = sum(c.parts for r in got for c in r.cells)
    assert large.count() > 4 * travels and travels <= 3 * len(got)
    home = {r.doc: r.home for r in got}
    members = {}
    for r in large.collect():
        members.setdefault(r.key, set()).add(r.doc)
    for r in got:  # wherever a text with one of its keys lives, and at home
        assert {c.home for c in r.cells} == {home[o] for k in r["keys"] for o in members[k]} and r.home in {c.home for c in r.cells}


@pytest.mark.parametrize("few, block", [(16, passages.BLOCK), (3, 6), (8, 25)])
def test_links_over_several_blocks(spark, few, block):
    """Links and spans against every pair of texts with a common key, each pair once."""
    rows = overlapping_families(24)
    spans = tv.Spans()
    own = [passages.shingles(t.encode(), passages.SHINGLE, spans) for _, t in rows]
    keys = [set() for _ in rows]
    for d, k, *_ in passages.text_windows([t.encode() for _, t in rows], passages.HASHES, passages.WIDTH, passages.SIDE, passages.SHINGLE, spans):
        for i, key in zip(d.tolist(), k.tolist()):
            keys[i].add(key)
    links, on = [0] * len(rows), [np.zeros(len(o), bool) for o in own]
    for i in range(len(rows)):
        for j in range(i):
            v = keys[i] & keys[j] and passages.verify(own[i], own[j], passages.WIDTH, passages.SIMILARITY)
            if v:
                links[i] += 1
                links[j] += 1
                on[i] |= v[1]
                on[j] |= v[2]
    assert 0 in links and max(links) >= 23
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    got = {r.doc_id: r for r in passages.shared_passages(docs, few=few, block=block).collect()}
    assert {d: r.n_links for d, r in got.items()} == {rows[i][0]: n for i, n in enumerate(links) if n}
    for i, (d, _) in enumerate(rows):
        if links[i]:
            words = np.zeros(len(own[i]) + passages.SHINGLE - 1, bool)
            for at in np.flatnonzero(on[i]):
                words[at:at + passages.SHINGLE] = True
            assert sum(s.end_word - s.first_word for s in got[d].passages) == words.sum()


@pytest.mark.parametrize("chunk, bucket", [(passages.CHUNK, passages.BUCKET), (3000, 100)])
def test_only_regions_of_possible_passages_travel(spark, chunk, bucket):
    """The regions of texts against all shingles that two texts have; a text with a common phrase alone has none."""
    rows = overlapping_families(20) + [(2000 + i, prose(42, 20) + " " + prose(8000 + i, 300)) for i in range(30)] + [(3000, ""), (3001, "Ünder " * 70)]
    spans = tv.Spans()
    own = [passages.shingles(t.encode(), passages.SHINGLE, spans) for _, t in rows]
    text = np.repeat(np.arange(len(own)), [len(o) for o in own])
    _, kind = np.unique(np.concatenate(own), return_inverse=True)
    shared = np.bincount(np.unique(np.stack([kind, text]), axis=1)[0])[kind] > 1
    want = passages.possible(shared, text, passages.WIDTH, passages.fewest(passages.WIDTH, passages.SIMILARITY))
    docs = spark.createDataFrame(rows + rows[:5], "doc LONG, text STRING").repartition(4)
    size = sum(len(t) for _, t in rows)
    got = {r.doc: r for r in passages.regions(docs, size, passages.WIDTH, passages.SHINGLE, passages.SIMILARITY, chunk, bucket).collect()}
    for i, (d, t) in enumerate(rows):
        at = np.zeros(len(own[i]), bool)
        for a, piece in zip(got[d].at, got[d].pieces) if d in got else ():
            g = passages.shingles(bytes(piece), passages.SHINGLE, spans)
            assert (own[i][a:a + len(g)] == g).all()
            at[a:a + len(g)] = True
        assert (at == want[text == i]).all()
    assert {d for d, _ in rows if d < 500} <= got.keys() and not any(d >= 2000 for d in got)
    assert sum(len(p) for r in got.values() for p in r.pieces) < size / 2


def test_blocks_meet_in_rounds(spark):
    """However little may travel at once, all blocks meet, each two in one round."""
    rows = overlapping_families(24)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    want = passages.shared_passages(docs, few=3, block=6).collect()
    assert sorted(passages.shared_passages(docs, few=3, block=6, most=30_000).collect()) == sorted(want) and len(want) > 24
    d = docs.withColumnRenamed("doc_id", "doc")
    w = passages.shared_windows(passages.window_table(d, passages.HASHES, passages.WIDTH, passages.SIDE, passages.SHINGLE)).cache()
    large = w.join(w.groupBy("key").agg(F.count("*").alias("n")).filter("n > 3"), "key")
    parts = passages.regions(d, 100_000, passages.WIDTH, passages.SHINGLE, passages.SIMILARITY)
    large = large.join(parts.select("doc"), "doc").select("key", "doc", "n").cache()
    got = [passages.met_in_place(large, parts, passages.WIDTH, passages.SHINGLE, passages.SIMILARITY, 6, most) for most in (1 << 30, 30_000)]
    rounds = [len({os.path.dirname(f) for f in x.inputFiles()}) for x in got]
    assert rounds[0] == 1 and rounds[1] > 3
    assert len({str(sorted((r.doc, r.rep, r.links, r.spans) for r in x.collect())) for x in got}) == 1


def test_shuffle_files_go_with_what_is_written(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with passages.released(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before


def test_blocks_leave_out_what_no_window_needs():
    """Places with too few shingles that another text has are not compared; repeats inside a text are no such shingles."""
    spans, alone = tv.Spans(), " ".join(["same"] * 60)
    own = [passages.shingles(t.encode(), passages.SHINGLE, spans) for t in (
        prose(1, 300) + " " + prose(9, 70) + " " + prose(2, 300), prose(3, 200) + " " + prose(9, 70), prose(9, 20) + " " + prose(4, 90), alone, "")]
    b = passages.Block(own, passages.WIDTH, passages.SIMILARITY)
    assert b.n_kept[2:].tolist() == [0, 0, 0] and all(66 <= n <= 66 + 10 for n in b.n_kept[:2])
    assert np.argwhere(np.triu(b.may_link(), 1)).tolist() == [[0, 1]]
    good, cover = b.verify(np.array([0, 0, 3]), np.array([1, 2, 4]))
    assert good.tolist() == [True, False, False] and len(cover) == sum(map(len, own)) and cover.sum() == 132


def test_blocks_verify_like_single_pairs():
    import random
    r, spans = random.Random(9), tv.Spans()
    texts = []
    for i in range(40):
        w = (prose(50 + i % 4, 90 + 30 * (i % 3)) + " " + prose(50 + i % 4, 20)).split()
        for at in r.sample(range(len(w)), i % 7):
            w[at] = f"edit{i}x{at}"
        texts.append(" ".join(w if i % 5 else w[:20]))
    own = [passages.shingles(t.encode(), passages.SHINGLE, spans) for t in texts]
    x, y = np.triu_indices(len(own), 1)
    found = 0
    for part in (np.arange(len(x)), *np.array_split(np.arange(len(x)), 60)):
        b = passages.Block(own, passages.WIDTH, passages.SIMILARITY)
        good, cover = b.verify(x[part], y[part])
        want, on = [], [np.zeros(len(o), bool) for o in own]
        for i, j in zip(x[part], y[part]):
            v = passages.verify(own[i], own[j], passages.WIDTH, passages.SIMILARITY)
            want.append(v is not None)
            if v:
                on[i] |= v[1]
                on[j] |= v[2]
        assert good.tolist() == want and (cover == np.concatenate(on)).all()
        found += sum(want)
    assert found > 50
