"""Suffix arrays of byte shards by induced sorting, and permuted common
prefixes, with whole buckets as numpy vectors."""

from __future__ import annotations

import numpy as np


def types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one.  ``t`` ends with
    a unique smallest value."""
    n = len(t)
    d = np.sign(t[1:].astype(np.int64) - t[:-1])
    at = np.where(d != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    s = np.ones(n, dtype=bool)
    s[:-1] = d[at] > 0
    return s


def _spread(lists: list[list], values: np.ndarray, keys: np.ndarray) -> None:
    """Appends ``values`` to the lists named by ``keys``, in order."""
    if not len(values):
        return
    order = np.argsort(keys, kind="stable")
    values, keys = values[order], keys[order]
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    for c, part in zip(keys[np.concatenate(([0], cut))].tolist(), np.split(values, cut)):
        lists[c].append(part)


def induce(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The suffix array from the leftmost-smaller suffixes ``seeds``, given
    in their order within each first byte: larger suffixes are induced from
    left to right, then the smaller ones from right to left.  Suffixes that a
    bucket induces into itself follow in waves."""
    none = np.zeros(0, dtype=np.int64)
    start: list[list] = [[] for _ in range(k)]
    _spread(start, seeds, t[seeds])
    up: list[list] = [[] for _ in range(k)]
    large = [none] * k
    for c in range(k):
        wave = np.concatenate(up[c]) if up[c] else none
        waves = [wave]
        while len(wave):
            p = wave[wave > 0] - 1
            wave = p[(t[p] == c) & ~smaller[p]]
            waves.append(wave)
        large[c] = np.concatenate(waves)
        source = np.concatenate([large[c], *start[c]])
        p = source[source > 0] - 1
        p = p[(t[p] > c) & ~smaller[p]]
        _spread(up, p, t[p])
    down: list[list] = [[] for _ in range(k)]
    out = [none] * k
    for c in range(k - 1, -1, -1):
        wave = np.concatenate(down[c]) if down[c] else none
        waves = [wave]
        while len(wave):
            p = wave[wave > 0] - 1
            wave = p[(t[p] == c) & smaller[p]]
            waves.append(wave)
        small = np.concatenate(waves)
        if c == 0:  # the closing value itself
            small = np.array([len(t) - 1], dtype=np.int64)
        source = np.concatenate([small, large[c][::-1]])
        p = source[source > 0] - 1
        p = p[(t[p] < c) & smaller[p]]
        _spread(down, p, t[p])
        out[c] = np.concatenate([large[c], small[::-1]])
    return np.concatenate(out)


def name_substrings(t: np.ndarray, order: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Names, in text order, of the substrings between neighbouring leftmost-
    smaller positions ``where``; ``order``: these positions as sorted."""
    after = np.full(len(t), len(t) - 1, dtype=np.int64)
    after[where[:-1]] = where[1:]
    a, b = order[:-1], order[1:]
    size = after[a] - a
    differ = size != after[b] - b
    live = np.flatnonzero(~differ)
    j = 0
    while len(live):
        ne = t[a[live] + j] != t[b[live] + j]
        differ[live[ne]] = True
        j += 1
        live = live[~ne]
        live = live[size[live] >= j]
    names = np.empty(len(t), dtype=np.int64)
    names[order] = np.concatenate(([0], np.cumsum(differ)))
    return names[where]


def sort_names(names: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of a string of names, exact for at least
    their first ``depth`` names, by doubling the length that is ranked."""
    rank, h = names.astype(np.int64), 1
    while True:
        second = np.zeros(len(rank), dtype=np.int64)
        second[:-h] = rank[h:] + 1
        key = rank * (len(rank) + 2) + second
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
        rank = np.empty_like(rank)
        rank[order] = new
        h *= 2
        if new[-1] == len(rank) - 1 or h >= depth or h >= len(rank):
            return order


def suffix_array(t: np.ndarray, k: int, depth: int) -> np.ndarray:
    """Suffix array of ``t`` (values below ``k``, the last one 0 and nowhere
    else), exact for at least the first ``depth`` values of each suffix."""
    smaller = types(t)
    where = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(where) > 1:
        first = induce(t, smaller, where, k)
        is_seed = np.zeros(len(t), dtype=bool)
        is_seed[where] = True
        order = first[is_seed[first]]
        names = name_substrings(t, order, where)
        if names.max() < len(names) - 1:
            # a name covers two values at least
            order = where[sort_names(names, depth // 2 + 2)]
    else:
        order = where
    return induce(t, smaller, order, k)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, in
    text order, up to ``most``.  Only where a suffix and its predecessor do
    not both follow from the position before are values compared."""
    n = len(t)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    heads = np.flatnonzero(np.concatenate(([True], (phi[1:] != phi[:-1] + 1) | (phi[:-1] < 0) | (t[:-1] != t[phi[:-1]]))))
    size = np.diff(np.concatenate((heads, [n])))
    lcp = np.zeros(len(heads), dtype=np.int64)
    pad = np.concatenate((t, np.zeros(most + 8, dtype=t.dtype)))
    live = np.flatnonzero(phi[heads] >= 0)
    a, b = heads[live], phi[heads[live]]
    # a chain needs its head's value up to its own length more
    need = size[live] + most
    j = 0
    while len(live):
        eq = pad[np.minimum(a + j, n)] == pad[np.minimum(b + j, n)]
        eq &= (a + j < n) & (b + j < n) & (j < need)
        lcp[live[eq]] += 1
        live, a, b, need = live[eq], a[eq], b[eq], need[eq]
        j += 1
    return np.maximum(np.repeat(lcp, size) - (np.arange(n) - np.repeat(heads, size)), 0)


def repeated(t: np.ndarray, k: int, length: int) -> np.ndarray:
    """True at positions whose next ``length`` values start anywhere else too."""
    sa = suffix_array(t, k, length + 8)
    lcp = permuted_lcp(t, sa, length)
    long = lcp >= length
    out = long.copy()
    before = np.empty(len(t), dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = sa[0]
    out[before[long]] = True
    return out
