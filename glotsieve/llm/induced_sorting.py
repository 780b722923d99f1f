"""Suffix arrays by induced sorting, and permuted longest common prefixes.

A suffix is smaller (S) or larger (L) than the next one; an S suffix after an
L suffix is a leftmost smaller one. The substrings between leftmost smaller
suffixes are sorted by inducing, and named; if names repeat, the string of
names is sorted by recursion. From the sorted leftmost smaller suffixes all
others are induced in two linear scans, one for L and one for S.

A scan goes through the buckets (suffixes of one first symbol) in order. All
suffixes of a bucket are at hand when the scan has reached it, but for those
that a suffix of the same bucket induces; so whole buckets, or several small
ones, are induced at once by array operations, and those within by waves.
"""

from __future__ import annotations

import numpy as np

RANGE = 1 << 13  # suffixes of several small buckets scanned at once


def classify(text: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than the next one. The end counts as smaller than any symbol."""
    n = len(text)
    small = np.zeros(n, bool)
    if n < 2:
        return small
    # the next symbol that differs decides
    differs = np.flatnonzero(text[1:] != text[:-1])
    ends = np.append(differs, n - 1)
    rises = np.append(text[differs + 1] > text[differs], False)
    return np.repeat(rises, np.diff(ends, prepend=-1))


def leftmost(small: np.ndarray) -> np.ndarray:
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _ranges(starts: np.ndarray, size: int = RANGE) -> list[tuple[int, int]]:
    """Buckets in runs (first, past) of up to ``size`` suffixes, or of a single bucket."""
    out, first, buckets = [], 0, len(starts) - 1
    while first < buckets:
        past = int(np.searchsorted(starts, starts[first] + size, side="right")) - 1
        past = min(max(past, first + 1), buckets)
        out.append((first, past))
        first = past
    return out


def _scan(text: np.ndarray, chosen: np.ndarray, starts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One scan: seeds, and all suffixes of the type ``chosen`` that they induce, in order.

    ``text`` is scanned upward. In a bucket, induced suffixes come first, in
    the order of the suffixes that induce them, then the seeds. For the scan of
    S suffixes the caller turns the order of symbols round.
    """
    counts = np.bincount(text[chosen], minlength=len(starts) - 1)
    total = counts + np.bincount(text[seeds], minlength=len(starts) - 1)
    offset = np.concatenate([[0], np.cumsum(total)])
    out = np.full(offset[-1], -1, text_index(len(text)))
    head = offset[:-1].copy()
    place = offset[1:] - np.bincount(text[seeds], minlength=len(starts) - 1)
    symbols = text[seeds]
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_symbols, sorted_symbols)
    out[place[sorted_symbols] + rank] = seeds[order]
    for first, past in _ranges(offset):
        low, high = offset[first], offset[past]
        if low == high:
            continue
        if past == first + 1:
            # one bucket: what it induces in itself follows wave by wave
            wave = out[low : head[first]]
            while len(wave):
                before = wave[wave > 0] - 1
                wave = before[chosen[before] & (text[before] == first)]
                out[head[first] : head[first] + len(wave)] = wave
                head[first] += len(wave)
            # seeds induce in their own bucket only where that bucket is not the scanned type
            members = out[low:high]
        else:
            members = _settle_range(text, chosen, out[low:high], first, past)
            out[low:high] = members
        before = members[members > 0] - 1
        before = before[chosen[before]]
        before = before[text[before] >= past]
        if len(before):
            symbols = text[before]
            order = np.argsort(symbols, kind="stable")
            before, symbols = before[order], symbols[order]
            edges = np.flatnonzero(np.diff(symbols, prepend=-1))
            sizes = np.diff(np.append(edges, len(symbols)))
            target = symbols[edges]
            out[np.repeat(head[target] - edges, sizes) + np.arange(len(symbols))] = before
            head[target] += sizes
    return out


def _settle_range(text, chosen, part: np.ndarray, first: int, past: int) -> np.ndarray:
    """Suffixes of several buckets in order, with those that they induce among themselves."""
    known = part[part >= 0]
    symbols = text[known].astype(np.int64)
    seed = ~chosen[known]
    n = len(part) + 1
    members, inner = known, 0
    while True:
        before = members - 1
        at = np.flatnonzero(members > 0)
        before = before[at]
        good = chosen[before] & (text[before] < past)
        if int(good.sum()) == inner and inner == len(members) - len(known):
            if not inner or members is not known:
                return members
        at, before = at[good], before[good]
        inner = len(before)
        # suffixes from earlier buckets, those induced here by the place of what induces them, seeds
        key = np.concatenate([
            symbols * (3 * n) + np.where(seed, 2 * n, 0) + np.arange(len(known)),
            text[before].astype(np.int64) * (3 * n) + n + at,
        ])
        again = np.concatenate([known, before])[np.argsort(key, kind="stable")]
        if len(again) == len(members) and (again == members).all():
            return again
        members = again


def text_index(n: int):
    return np.int32 if n < 1 << 31 else np.int64


def _induce(text: np.ndarray, small: np.ndarray, starts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost smaller ones in order."""
    symbols = len(starts) - 1
    # the last suffix is L and induced by the end, before all others of its bucket
    large = ~small
    # an L scan whose first seed is the end: a symbol below all others is put at the end
    ended = np.append(text + 1, 0)
    order = _scan(
        ended, np.append(large, False), np.concatenate([[0, 1], starts[1:] + 1]), np.concatenate([[len(text)], seeds])
    )
    order = order[order < len(text)]
    order = order[large[order]]
    # the S scan: from the largest symbol down, seeds are the L suffixes from the last to the first
    turned = symbols - 1 - text
    back = np.concatenate([[0], np.cumsum(np.diff(starts)[::-1])])
    return _scan(turned, small, back, order[::-1])[::-1]


def _names(text: np.ndarray, small: np.ndarray, marks: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """A name for each leftmost smaller substring: its rank among those that differ."""
    lengths = np.diff(np.append(marks, len(text) - 1)) + 1
    index = np.empty(len(text), np.int64)
    index[marks] = np.arange(len(marks))
    sorted_marks = order[np.isin(order, marks)] if len(order) != len(marks) else order
    at = index[sorted_marks]
    size = lengths[at]
    same = np.zeros(len(at), bool)
    active = np.flatnonzero(size[1:] == size[:-1]) + 1
    # the last one ends with the text, and equals no other
    active = active[(at[active] != len(marks) - 1) & (at[active - 1] != len(marks) - 1)]
    step = 0
    while len(active):
        a, b = sorted_marks[active], sorted_marks[active - 1]
        equal = text[a + step] == text[b + step]
        active = active[equal]
        done = size[active] == step + 1
        same[active[done]] = True
        active = active[~done]
        step += 1
    rank = np.cumsum(~same) - 1
    names = np.empty(len(marks), np.int64)
    names[at] = rank
    return names, int(rank[-1]) + 1


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of all suffixes of ``text`` (whole numbers below ``symbols``), in order."""
    n = len(text)
    if n < 2:
        return np.zeros(n, text_index(n))
    text = text.astype(np.int32 if symbols < 1 << 30 else np.int64, copy=False)
    small = classify(text)
    starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
    marks = leftmost(small).astype(text_index(n))
    if len(marks) > 1:
        # substrings: induce from marks in the order of their first symbols
        rough = _induce(text, small, starts, marks)
        is_mark = np.zeros(n, bool)
        is_mark[marks] = True
        rough = rough[is_mark[rough]]
        names, different = _names(text, small, marks, rough)
        order = rough if different == len(marks) else marks[suffix_array(names, different)]
    else:
        order = marks
    return _induce(text, small, starts, order).astype(text_index(n))


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix, by place in the text, the length it has in common with the one before it in order.

    If the symbols before the two are equal, the length is that of the place
    before less one; only the other places are compared, symbol by symbol.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    places = np.arange(n)
    follows = np.zeros(n, bool)
    ok = (before > 0) & (places > 0)
    follows[ok] = text[before[ok] - 1] == text[places[ok] - 1]
    start = np.flatnonzero(~follows)
    length = np.zeros(len(start), np.int64)
    active = np.flatnonzero(before[start] >= 0)
    while len(active):
        a, b = start[active] + length[active], before[start[active]] + length[active]
        inside = (a < n) & (b < n)
        active, a, b = active[inside], a[inside], b[inside]
        active = active[text[a] == text[b]]
        length[active] += 1
    last = np.maximum.accumulate(np.where(follows, -1, places))
    out[start] = length
    return np.maximum(out[last] - (places - last), 0)
