"""Suffix arrays by two-stage sorting, and repeated windows from adjacent common prefixes; numpy, inside tasks.

A suffix is of type S if it is smaller than its successor (the suffix one byte later), else of type L. Only
suffixes of type S are sorted directly. Those of type L are induced: buckets of the first byte are scanned in
ascending order, and in a bucket the L suffixes take the order of their successors, which are already in place;
they precede the bucket's S suffixes.

Many short texts lie in one array; a text's end is smaller than any byte. Suffixes are compared up to
DEPTH bytes, and only those at wanted positions, with the chains of successors that induce them, are placed.
"""

from __future__ import annotations

import numpy as np

DEPTH = 100


def _types(b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """True for type S. b: bytes + 1 with 0 as the end of each text at `last`."""
    n = len(b)
    change = np.flatnonzero(b[1:] != b[:-1])  # i where the next byte differs
    following = np.searchsorted(change, np.arange(n))
    s = np.zeros(n, bool)
    ok = following < len(change)
    at = change[following[ok]]
    s[ok] = b[at] < b[at + 1]
    s[last] = False
    return s


def suffix_order(b: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted suffixes in ascending order. b: uint16 bytes + 1, each text closed by a 0; wanted: mask."""
    n = len(b)
    ends = np.flatnonzero(b == 0)
    is_s = _types(b, ends)
    # a wanted L suffix needs its successors up to the next S suffix or the text's end
    stop = is_s | (b == 0)
    places = np.where(stop, np.arange(n), n)
    next_stop = np.minimum.accumulate(places[::-1])[::-1]
    need = np.zeros(n + 1, np.int64)
    w = np.flatnonzero(wanted)
    np.add.at(need, w, 1)
    np.add.at(need, next_stop[w] + 1, -1)
    needed = np.cumsum(need[:n]) > 0
    s_places = np.flatnonzero(needed & is_s & (b > 0))
    if len(s_places):
        # direct sort, by rows of DEPTH bytes; what lies past a text's end counts as 0
        padded = np.concatenate([b, np.zeros(DEPTH, b.dtype)])
        rows = np.lib.stride_tricks.sliding_window_view(padded, DEPTH)[s_places]
        past = np.maximum.accumulate(rows == 0, axis=1)
        # two bytes only where a text holds byte 255
        rows = np.where(past, 0, rows)
        keys = np.ascontiguousarray(rows.astype(">u2" if b.max() > 255 else np.uint8))
        s_places = s_places[np.argsort(keys.view(f"S{keys.shape[1] * keys.itemsize}").ravel(), kind="stable")]
    rank = np.full(n, -1, np.int64)  # ends are smallest
    order: list[np.ndarray] = []
    count = 0
    l_places = np.flatnonzero(needed & ~is_s & (b > 0))
    l_byte, s_byte = b[l_places], b[s_places]
    by_l = np.argsort(l_byte, kind="stable")
    l_places, l_byte = l_places[by_l], l_byte[by_l]
    for c in np.unique(np.concatenate([l_byte, s_byte])):
        bucket = l_places[np.searchsorted(l_byte, c) : np.searchsorted(l_byte, c, side="right")]
        wave = bucket[b[bucket + 1] < c]
        inside = np.zeros(0, np.int64) if len(wave) == len(bucket) else bucket[b[bucket + 1] == c]
        while len(wave):
            wave = wave[np.argsort(rank[wave + 1], kind="stable")]
            rank[wave] = np.arange(count, count + len(wave))
            count += len(wave)
            order.append(wave)
            if not len(inside):
                break
            ready = rank[inside + 1] >= 0
            wave, inside = inside[ready], inside[~ready]
        own = s_places[np.searchsorted(s_byte, c) : np.searchsorted(s_byte, c, side="right")]  # sorted by first byte too
        rank[own] = np.arange(count, count + len(own))
        count += len(own)
        order.append(own)
    sa = np.concatenate(order) if order else np.zeros(0, np.int64)
    return sa[wanted[sa]]


def adjacent_repeats(b: np.ndarray, sa: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each suffix in order: does it share its first `depth` bytes with the one before?"""
    same = np.zeros(len(sa), bool)
    view = np.lib.stride_tricks.sliding_window_view(b, depth) if len(b) >= depth else np.zeros((0, depth), b.dtype)
    for i in range(1, len(sa), 20_000):
        j = min(len(sa), i + 20_000)
        same[i:j] = (view[sa[i:j]] == view[sa[i - 1 : j - 1]]).all(1)
    return same


def repeated_windows(texts: list[bytes], first: np.ndarray, starts: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Mask over the windows of all texts, in order: is there an equal window of `depth` bytes with a smaller place?

    Text i offers counts[i] windows, which begin at its bytes 0, 1, ...; window k of it has the place
    (first[i], starts[i] + k).
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 1
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    joined[begin + lengths] = 0
    total = int(counts.sum())
    owner = np.repeat(np.arange(len(texts)), counts)
    offset = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begin[owner] + offset
    wanted = np.zeros(len(joined), bool)
    wanted[at] = True
    window_at = np.full(len(joined), -1, np.int64)
    window_at[at] = np.arange(total)
    sa = suffix_order(joined, wanted)
    group = np.cumsum(~adjacent_repeats(joined, sa, depth))
    w = window_at[sa]
    place = np.lexsort((starts[owner[w]] + offset[w], first[owner[w]], group))
    g, w = group[place], w[place]
    f, s = first[owner[w]], starts[owner[w]] + offset[w]
    leads = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(leads, np.arange(len(g)), 0))
    out = np.zeros(total, bool)
    out[w] = (f != f[lead]) | (s != s[lead])
    return out
