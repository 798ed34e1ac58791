"""Secret scans by corpus-wide ownership (operator 13).

Three base kinds are found by pattern: ``assign`` (a name such as password,
an equals sign or colon and a value), ``access`` (key ids) and ``hex`` (long
hexadecimal strings).  Their values, and any other long token, are
candidates.  A candidate travels as the SHA-256 of its value; for each hash
the corpus says in how many distinct repositories and with how many distinct
owners it stands.  A value that more than ``MAX_OWNERS`` owners have is a
widely copied example.  One that stays with few owners and looks live (mixed,
unordered characters, no placeholder word) is a credential, and its span is
added as kind ``live``.  Base spans stay whatever the verdict.

The texts are scanned where they are read and no text is shuffled: a
vectorised pass over each batch's bytes finds the texts with a name or a long
token at all, and only those meet the regular expressions.  What is counted
are (hash, owner, repository) triples, combined map-side, then per (hash,
owner), then per hash, so a value that a third of all documents share is
never gathered in one task.  Documents without candidates, nearly all, pass
straight through; the others get their live spans back by the row key that
is written with the scan's result.  The join back meets widely copied values
as ordinary skewed keys of an inner join of two written tables, which AQE
splits; they are dropped on the counting side before it.

Defined cases: a null text is empty; empty texts have no spans; a null owner
or repository counts as one value of its own; repeated rows give repeated
results (and count once: same repository); a span starts and ends in code
points; an empty table gives an empty result; extra columns are ignored; a
missing ``text`` or owner column is an error.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import stored
from credence.llm.textvec import chunks

KINDS = ("assign", "access", "hex")
ADDED = "live"
#: owners that a credential may have; copies of one text carry its secrets to a few sources
MAX_OWNERS = 3

NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: any other token that may be a secret
LEAST_TOKEN = 20
TOKEN = re.compile(r"[A-Za-z0-9+/_=]{%d,}" % LEAST_TOKEN)

PLACEHOLDER = re.compile(r"(?ai:example|sample|dummy|placeholder|changeme|change_me|redacted|your|xxxx|test)")
CASE_RUN = re.compile(r"[a-z]+|[A-Z]+")


def looks_live(value: str) -> bool:
    """Unordered characters: enough entropy for the length, letters and
    digits mixed, no long run of letters of one case, no placeholder word."""
    body = value.removeprefix("AKIA").strip("=")
    n = len(body)
    if n < LEAST_ASSIGN or PLACEHOLDER.search(body):
        return False
    digits = sum(c.isdigit() for c in body)
    letters = sum(c.isalpha() for c in body)
    if n >= 12 and (not digits or not letters):
        return False
    if max(map(len, CASE_RUN.findall(body)), default=0) > max(7, n // 2):
        return False
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(body).values())
    return entropy >= min(3.0, 0.7 * math.log2(n))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Places of values: those of the base spans, and other long tokens that
    look live and lie outside of them; equal places once."""
    out = {m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN}
    for s, e, kind in base:
        if kind != "assign" and not any(a <= s and e <= b for a, b in out):
            out.add((s, e))
    known = sorted(out)
    for m in TOKEN.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in known) and looks_live(m[0]):
            out.add(m.span())
    return sorted(out)


def suspects(texts: list, least: int = LEAST_TOKEN) -> np.ndarray:
    """Which texts (UTF-8) hold a name or a long token at all."""
    token = np.zeros(256, bool)
    token[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_="]] = True
    out = np.zeros(len(texts), bool)
    for lo, _, buf, starts in chunks(texts):
        edge = np.flatnonzero(np.diff(token[buf], prepend=False, append=False))
        begin, end = edge[::2], edge[1::2]
        at = [begin[end - begin >= least]]
        raw = buf.tobytes()
        for name in NAMES:
            i, hits = raw.find(name), []
            while i >= 0:
                hits.append(i)
                i = raw.find(name, i + len(name))
            at.append(np.array(hits, np.int64))
        out[lo + np.searchsorted(starts, np.concatenate(at), side="right") - 1] = True
    return out


def shown(spans) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


FOUND = ("doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, "
         "base string, values array<struct<start: long, end: long, hash: binary, live: boolean>>")


def scan(docs: DataFrame, owner: str, repo: str) -> DataFrame:
    """One row per document: its base spans and the hashes of its values."""
    for name in ("doc_id", "text", owner, repo):
        if name not in docs.columns:
            raise ValueError(f"documents need a column named {name}")
    value = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("hash", pa.binary()), ("live", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("owner", pa.string()), ("repo", pa.string()),
                        *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("base", pa.string()),
                        ("values", pa.list_(value))])
    nothing = hashlib.sha256(b"").hexdigest()

    def one(text: str):
        base = base_spans(text)
        values = []
        for s, e in candidates(text, base):
            v = text[s:e]
            values.append({"start": s, "end": e, "hash": hashlib.sha256(v.encode()).digest(), "live": looks_live(v)})
        n = Counter(kind for *_, kind in base)
        said = shown(base)
        return *(n[k] for k in KINDS), hashlib.sha256(said.encode()).hexdigest(), said, values

    def part(batches):
        for batch in batches:
            texts = batch.column(3).cast(pa.binary())
            for lo in range(0, len(batch), 512):
                own = texts.slice(lo, 512).to_pylist()
                flagged = suspects(own)
                rows = [one(t.decode()) if f else (0, 0, 0, nothing, "", []) for t, f in zip(own, flagged, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, 512) for i in range(3)),
                     *(pa.array(x, schema.field(i + 3).type) for i, x in enumerate(zip(*rows, strict=True)))], schema=schema)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{owner}`").cast("string").alias("owner"),
                    F.col(f"`{repo}`").cast("string").alias("repo"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(part, FOUND)


def ownership(values: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of (hash, owner, repo) rows: distinct
    triples first, so that no key gathers its rows."""
    triples = values.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = triples.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def secrets(docs: DataFrame, owner: str = "source", repo: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans (base and live ones) and n_live."""
    found = stored(scan(docs, owner, repo).withColumn("row", F.monotonically_increasing_id()))
    clear, rest = found.filter(F.size("values") == 0), found.filter(F.size("values") > 0)
    values = stored(rest.select("row", "owner", "repo", F.explode("values").alias("v")).select("row", "owner", "repo", "v.*"))
    counted = stored(ownership(values))
    few = values.filter("live").join(counted.filter(F.col("owners") <= max_owners), "hash")
    live = few.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("places"))
    out = rest.join(live, "row", "left")
    # 'kind:start:end' strings back to numbers, to put the live ones in by start; the added kind comes last
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(
        F.split(x, ":")[1].cast("long").alias("start"),
        F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.split(x, ":")[0]).cast("int").alias("kind"), x.alias("said")))
    more = F.transform(F.coalesce("places", F.array()), lambda p: F.struct(
        p["start"].alias("start"), F.lit(len(KINDS) + 1).alias("kind"), F.concat_ws(":", F.lit(ADDED), p["start"], p["end"]).alias("said")))
    n_live = F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long")
    spans = F.array_join(F.transform(F.array_sort(F.concat(base, more)), lambda x: x["said"]), ",")
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    return clear.select(*names, F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_live")).unionByName(
        out.select(*names, spans.alias("spans"), n_live.alias("n_live")))
