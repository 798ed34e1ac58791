"""Operators 2, 7 and 10 and the pipeline."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from credence.llm import chat, packing, url_rules
from fixtures import SF, edge_docs, edge_rows, empty_docs


def ids_of(text, tok=Tokenizer.from_file(packing.TOKENIZER)):
    return tok.encode(text or "", add_special_tokens=False).ids + [packing.END]


def check_pieces(rows, docs, capacity=2048, max_segments=packing.MAX_SEGMENTS):
    """Each id in exactly one piece, sequences gapless and within limits."""
    want = defaultdict(list)
    for d, t in docs:
        want[d].append(ids_of(t))
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(want)
    for d, texts in want.items():
        pieces = by_doc[d]
        assert sum(r.length for r in pieces) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                part = np.array(texts[0][at:at + r.length], dtype="<u4").tobytes()
                assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(part), len(texts[0]))
                at += r.length
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append(r)
    padding = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity and len(s) <= max_segments
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing_edges(spark):
    rows = packing.pack(edge_docs(spark)).collect()
    check_pieces(rows, edge_rows())
    assert packing.pack(empty_docs(spark)).count() == 0


def test_packing_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id LONG, text STRING").repartition(3)).collect()
    padding = check_pieces(rows, docs)
    assert padding <= 0.01 * sum(r.length for r in rows)


@pytest.mark.parametrize("segments,loss", [(2, 2048), (64, 500)])
def test_packing_limits(spark, segments, loss):
    d = edge_docs(spark)
    d = d.withColumn("skip", d.n * 3)
    rows = packing.pack(d, max_segments=segments, max_loss=loss, loss_from="skip").collect()
    check_pieces(rows, edge_rows(), max_segments=segments)
    per = defaultdict(int)
    for r in rows:
        per[r.sequence_id] += r.loss_tokens
    assert max(per.values()) <= loss
    total = {}
    for r in rows:
        if r.doc_id is not None and r.doc_id != 14:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.loss_tokens
    want = {i: max(0, len(ids_of(t)) - 9) for i, t in edge_rows() if i is not None and i != 14}
    assert total == want


def test_cached_ids_equal_the_tokenizer():
    import random
    r = random.Random(4)
    alphabet = ["a", "B", "é", "É", "ß", "İ", "Σ", "ς", "'s", "'", "’", "—", ".", "!!", "%%%", "<|endoftext|>", "<|ENDOFTEXT|>", "<|",
                "1", "½", "中", "🙂", "é", "́", " ", "\n", "\t", "\x1c", "\x85", "　", "th", "ING", "×", "ª", "̸", "<", "K", "ﬁ", "‍", "\x00"]
    enc = packing.WordIds(packing.TOKENIZER, cache=50)
    for _ in range(4000):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 14)))
        assert np.frombuffer(enc.encode([t.encode()])[0], "<u4").tolist() + [packing.END] == ids_of(t)


# -- 7 ------------------------------------------------------------------------

CONV = "conv_id LONG, turn LONG, role STRING, text STRING, ck STRING, node LONG"


def conv_rows():
    return [(1, 0, "user", "hi"), (1, 1, "assistant", "### Assistant:\n</turn>\\"), (1, 2, "user", None), (1, 3, "assistant", ""),
            (2, 0, "assistant", "\\### x </turn>\\\\</turn>"), (2, 0, "assistant", "\\### x </turn>\\\\</turn>"), (3, 5, None, "no role\n"),
            (None, 1, "user", "nobody's"), (4, None, "a b\n###", "odd role 🙂"), (4, 1, "assistant", "é 🙂 é"),
            *[(5, i, ("user", "assistant")[i % 2], f"turn {i} " + "x" * (i % 50)) for i in range(300)],
            (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def test_chat_round_trip(spark):
    rows = conv_rows()
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], CONV).repartition(4)
    got = {r.conv_id: r for r in chat.read_back(chat.format_paths(df)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, role, x in turns if role == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, _, role, x in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_paths(df.filter("conv_id > 99"))).count() == 0


def test_reply_tree(spark):
    rows = [(1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "bad", 1.0), (1, 2, 0, "assistant", "good", 3.0),
            (1, 3, 2, "user", "more", 0.0), (1, 4, 3, "assistant", "end", 1.0), (1, 5, 1, "user", "other", 0.0),
            (2, 0, 1, "user", "cycle", 0.0), (2, 1, 0, "user", "cycle", 0.0), (3, 7, 99, "user", "parent is missing", 0.0)]
    df = spark.createDataFrame(rows, "conv_id LONG, turn LONG, reply_to LONG, role STRING, text STRING, votes DOUBLE")
    got = chat.format_paths(df, parent="reply_to", score="votes", keep=2).collect()
    texts = {(r.conv_id, r.path_rank): re.findall(r"### \w+\n(.*)\n</turn>", r.formatted) for r in got}
    assert texts == {(1, 1): ["q", "good", "more", "end"], (1, 2): ["q", "bad", "other"], (3, 1): ["parent is missing"]}
    for r in got:
        assert all(r.formatted[a:b] in ("good", "end", "bad") for a, b in r.loss_spans)


def test_chat_plan_has_no_python(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    plan = chat.read_back(chat.format_paths(df))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# -- 10 -----------------------------------------------------------------------

def judge_brute(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
    fits = sorted(((-len(h + p), h + p, v) for v, h, p in url_rules.RULES if ("." + host).endswith("." + h) and path.startswith(p)))
    hit = sorted(rx for rx, _ in url_rules.PATTERNS if re.search(rx, url or ""))
    if fits:
        return host, path, fits[0][1], fits[0][2], None
    return host, path, None, "block" if hit else "allow", hit[0] if hit else None


def test_urls(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.org/es/x?q#f", "https://a.b.example.org/en/12", "http://example.org/EN/1", "http://org/",
            "http://notexample.org/es/", "http://x.com/de/", "http://x.com/fr/de/", "ftp://x.com?a=://b/c", "http://x.net/de/y", "http://m.a.net/de/1",
            "http://ads.x.net/", "http://x.net/?sessionid=ab12", "http://x.net/a?page=123", "http://x.net/a?page=12", "http://x.org", "://org/", "http://é.com/de/é",
            "http://x.com/de/" + "y" * 50_000] + ["http://hot.com/de/1"] * 5
    rows = [(i, u, "v", "h") for i, u in enumerate(urls)] + [(None, urls[3], "v", "h")]
    df = spark.createDataFrame(rows, "page_id LONG, url STRING, verdict STRING, host STRING").repartition(3)
    got = sorted((tuple(r) for r in url_rules.judge(df).collect()), key=str)
    assert got == sorted(((i, *judge_brute(u)) for i, u, *_ in rows), key=str)
    assert url_rules.judge(df.filter("page_id < 0")).count() == 0


# -- pipeline -----------------------------------------------------------------

def test_pipeline(spark):
    from credence.llm import decontaminate, exact_dedup, quality, simhash
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    left = set(text)
    good = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted}
    left &= good
    from test_dedup import components_brute, exact_brute, fp_brute
    left = {r[0] for r in exact_brute([(d, text[d]) for d in left]) if r[3]}
    ids = sorted(left)
    left = set(components_brute(ids, [fp_brute(text[d]) for d in ids]))
    some = docs.filter(docs.doc_id.isin(list(left)))
    left -= {r.doc_id for r in decontaminate.contaminated_pairs(some, bench).collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == left
    check_pieces(rows, [(d, text[d]) for d in left])


def test_stages_keep_the_columns(spark):
    d = edge_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns, name
        assert stage(spark, empty_docs(spark), SF).count() == 0, name


def test_rules_of_every_kind_fire(spark):
    """Hyphens, other letters, upper case, no host, no tokens, open ends."""
    rules = [("block", "my-site.org", "/"), ("block", "b\u00fccher.de", "/"), ("allow", "Shop.b\u00fccher.de", "/A-b"), ("block", "", "/tmp/x"),
             ("allow", "net", "/"), ("block", "quiet.net", "/Ab/cd")]
    patterns = [(r"[?]q=$", []), (r"^ftp://", [["ftp"]]), (r"%%", [[]])]
    urls = ["http://my-site.org/a", "https://x.my-site.org/", "http://notmy-site.org/", "http://b\u00fccher.de/", "http://shop.b\u00fccher.de/A-bc",
            "http://shop.b\u00fccher.de/a-b", "http://a.example/tmp/xyz", "http://a.example/tmp/y", "http://a.net/tmp/x", "http://quiet.net/Ab/cde",
            "http://quiet.net/ab/cd", "http://a.example/?q=", "ftp://a.example/", "http://a.example/%%", "http://my-site.org", None, "", "nothing"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id LONG, url STRING")
    got = {r.page_id: (r.rule, r.verdict, r.pattern) for r in url_rules.judge(d, url_rules.rule_table(spark, rules, patterns)).collect()}

    def brute(url):
        u = url or ""
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), h.lower() + p, v) for v, h, p in rules if url and (not h or ("." + host).endswith("." + h.lower())) and path.startswith(p)]
        if fit:
            _, name, v = max(fit)
            return name, v, None
        hit = [rx for rx, _ in patterns if re.search(rx, u)]
        return None, "block" if hit else "allow", min(hit, default=None)

    for i, u in enumerate(urls):
        if u != "http://a.net/tmp/x":
            assert got[i] == brute(u), u
    assert got[8] == ("/tmp/x", "block", None)  # the longer rule
    assert got[0][1] == got[3][1] == got[6][1] == got[11][1] == got[12][1] == got[13][1] == "block"


@pytest.mark.parametrize("seed", [1, 2])
def test_random_reply_forests(spark, seed):
    """Ties, missing parents, cycles, repeated nodes, chains of over 64 replies, against a walk."""
    import random
    r = random.Random(seed)
    rows = []
    for conv in range(12):
        n = r.choice((1, 5, 20, 90))
        for i in range(n):
            parent = None if i == 0 else (i - 1 if n == 90 else r.choice((r.randrange(i), r.randrange(i), r.randrange(n), 1000, None)))
            rows.append((conv, i, r.choice(("user", "assistant")), f"c{conv} n{i} ### x", parent, r.choice((0.0, 0.5, 0.5, -1.0, None))))
    rows += [(3, 0, "zzz", "a second row of node 0", None, 9.0), (50, 1, "user", "loop", 2, 1.0), (50, 2, "user", "loop", 1, 1.0), (50, 3, "user", "hangs on it", 1, 1.0)]
    d = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING, parent LONG, score DOUBLE").repartition(4)
    got = sorted((x.conv_id, x.path_rank, x.formatted) for x in chat.format_paths(d, "parent", "score", keep=3).collect())
    want = []
    for conv in {c for c, *_ in rows}:
        nodes = {}
        for _, i, role, text, parent, score in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2], x[3])):
            nodes.setdefault(i, (role, text, parent if parent is not None else None, score or 0.0))
        inner = {v[2] for v in nodes.values()}
        paths = []
        for leaf in nodes:
            if leaf in inner:
                continue
            path, at = [], leaf
            while at in nodes and at not in path:
                path.append(at)
                at = nodes[at][2]
            if at not in path:
                paths.append((-round(sum(nodes[p][3] for p in path), 6), leaf, path[::-1]))
        for rank, (_, _, path) in enumerate(sorted(paths)[:3], 1):
            want.append((conv, rank, "".join(f"### {nodes[p][0]}\n{nodes[p][1].replace('### ', chr(92) + '### ')}\n</turn>\n" for p in path)))
    assert got == sorted(want) and len(want) > 12


def test_plain_words_skip_the_patterns(monkeypatch):
    """Ids as the whole tokenizer's; words of ASCII letters meet no pattern."""
    class Watch:
        def __init__(self, pattern):
            self.pattern, self.seen = pattern, []

        def fullmatch(self, w):
            self.seen.append(w)
            return self.pattern.fullmatch(w)

    trail, letters = Watch(packing.TRAIL), Watch(packing.LETTERS)
    monkeypatch.setattr(packing, "TRAIL", trail)
    monkeypatch.setattr(packing, "LETTERS", letters)
    words = packing.WordIds(packing.TOKENIZER)
    texts = ["plain words Only here", "voilà straße día über garçon naïve ÿ ª", "end. don't, x1 中文 café! ", ""]
    for t in texts * 2:
        assert np.frombuffer(words.encode([t.encode()])[0], "<u4").tolist() == ids_of(t)[:-1]
    assert not [w for w in trail.seen + letters.seen if w.isalpha()]
    assert "ß".encode() not in words.known and "straße".encode() in words.known
