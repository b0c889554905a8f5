"""Suffix arrays in numpy, and repeats of a fixed length found with them."""

from __future__ import annotations

import numpy as np

WORD = 8


def words_at(text: np.ndarray, at: np.ndarray, offset: int = 0) -> np.ndarray:
    """The eight bytes from each position on as big-endian numbers; text must have eight spare bytes."""
    out = np.zeros(len(at), np.uint64)
    for i in range(WORD):
        out = (out << np.uint64(8)) | text[at + (offset + i)].astype(np.uint64)
    return out


def all_words(text: np.ndarray, n: int) -> np.ndarray:
    """words_at for positions 0..n-1; text must have eight spare bytes."""
    raw, out = text.tobytes(), np.empty(n, np.uint64)
    for i in range(WORD):
        part = out[i::WORD]
        part[:] = np.frombuffer(raw, ">u8", (len(raw) - i) // WORD, i)[: len(part)]
    return out


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank by position) by Larsson-Sadakane refinement: start from the first eight bytes, then sort only
    what is still tied, by the rank h further on, and double h."""
    n = len(text)
    first = all_words(np.concatenate([text, np.zeros(2 * WORD, np.uint8)]), n)
    sa = np.argsort(first, kind="stable")
    own = first[sa]
    # zeros past the end tie with zero bytes; a suffix of under eight bytes is told apart by its length
    short = n - sa < WORD
    new = np.r_[True, own[1:] != own[:-1]] if n else np.zeros(0, bool)
    if n and ((own[1:] == own[:-1]) & (short[1:] | short[:-1])).any():
        # within a tie, shorter suffixes first and alone
        order = np.lexsort((np.where(short, n - sa, WORD), np.cumsum(new)))
        sa, own, short = sa[order], own[order], short[order]
        new = np.r_[True, (own[1:] != own[:-1]) | short[1:] | short[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = np.flatnonzero(~(new & np.r_[new[1:], True])) if n else np.zeros(0, np.int64)
    h = WORD
    while len(tied):
        s = sa[tied]
        ahead = s + h
        key = rank[s] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        s, key = s[order], key[order]
        sa[tied] = s
        new = np.r_[True, key[1:] != key[:-1]]
        rank[s] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        tied = tied[~(new & np.r_[new[1:], True])]
        h *= 2
    return sa, rank


def common_prefixes(text: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Length shared with the suffix before, in suffix order. Kasai's rule in text order: where the bytes before two
    neighbours are equal, the length is one less than at the position before; only the other places are compared."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    follows = (before > 0) & (at > 0) & (before >= 0)
    follows[follows] = text[at[follows] - 1] == text[before[follows] - 1]
    root = np.maximum.accumulate(np.where(follows, 0, at))
    need = np.flatnonzero(~follows & (before >= 0))
    length = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(2 * WORD, np.uint8)])
    words = all_words(padded, n + WORD)
    a, b, live = need.copy(), before[need], np.arange(len(need))
    run = np.zeros(len(need), np.int64)
    while len(live):
        differ = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        same = (differ == 0) & (np.maximum(a, b) + WORD <= n)
        stop = ~same
        if stop.any():
            d = differ[stop].astype(">u8").view(np.uint8).reshape(-1, WORD)
            k = np.where(d.any(axis=1), (d != 0).argmax(axis=1), WORD)
            run[live[stop]] += np.minimum(k, n - np.maximum(a[stop], b[stop]))
        run[live[same]] += WORD
        a, b, live = a[same] + WORD, b[same] + WORD, live[same]
    length[need] = run
    plcp = np.maximum(length[root] - (at - root), 0)
    plcp[before < 0] = 0
    return plcp[sa]


class Repeats:
    """Distinct strings of one length at the given positions of a text, in suffix order, with the smallest owner of each."""

    def __init__(self, text: np.ndarray, at: np.ndarray, owner: np.ndarray, length: int):
        sa, rank = suffix_array(text)
        group = np.cumsum(common_prefixes(text, sa, rank) < length)  # neighbours that share the length are one string
        place = rank[at]
        order = np.argsort(place)
        g = group[place[order]]
        edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
        self.least = np.minimum.reduceat(owner[order], edge) if len(edge) else np.zeros(0, np.int64)
        self.of = np.empty(len(at), np.int64)
        self.of[order] = np.cumsum(np.r_[True, g[1:] != g[:-1]]) - 1 if len(g) else 0
        padded = np.concatenate([text, np.zeros(length + WORD, np.uint8)])
        first = at[order[edge]]
        columns = [words_at(padded, first, o) for o in range(0, length, WORD)]
        if length % WORD:
            columns[-1] &= ~np.uint64((1 << (8 * (WORD - length % WORD))) - 1)
        self.strings = np.stack(columns, axis=1)

    def merge(self, other: "Repeats") -> None:
        """Give both sides the smaller owner of each string they share, found by binary search."""
        # the first eight bytes narrow each search to the strings that begin alike, if there are any
        low, high = (np.searchsorted(other.strings[:, 0], self.strings[:, 0], side) for side in ("left", "right"))
        alike = np.flatnonzero(low < high)
        low, high, own = low[alike], high[alike], self.strings[alike]
        last = high.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            less, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for c in range(1, own.shape[1]):  # other's string comes before
                a, b = own[open_, c], other.strings[mid, c]
                less |= equal & (b < a)
                equal &= b == a
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        met = low < last
        met[met] = (other.strings[low[met]] == own[met]).all(axis=1)
        found, low = alike[met], low[met]
        least = np.minimum(self.least[found], other.least[low])
        self.least[found] = least
        other.least[low] = least


def smallest_owners(texts: list[np.ndarray], at: list[np.ndarray], owners: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For texts of several shards: the smallest owner, over all of them, of the string at each position."""
    shards = [Repeats(*x, length) for x in zip(texts, at, owners, strict=True)]
    for i, a in enumerate(shards):
        for b in shards[i + 1 :]:
            a.merge(b)
    # the first holder of a string has met all others by then, so the last knows the smallest when the others meet it
    return [s.least[s.of] for s in shards]
