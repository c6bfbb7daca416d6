"""Suffix arrays by induced sorting, with permuted common prefixes.

Induction goes bucket by bucket in numpy while the alphabet is small (bytes), and place by place over the names of a reduced
text, whose buckets are many and small; both are linear and give the same order.
"""

from __future__ import annotations

import numpy as np

FEW_BUCKETS = 1024


def _induce(s: np.ndarray, low: np.ndarray, seeds: list[np.ndarray], sigma: int) -> np.ndarray:
    """The order of all suffixes (or substrings) induced from the sorted leftmost-smaller ones in ``seeds``.

    ``low``: whether a suffix is smaller than the next one. Larger ones are induced from left to right, smaller
    ones from right to left; within a bucket the entries that it gives itself follow in batches.
    """
    larger: list[list[np.ndarray]] = [[] for _ in range(sigma)]

    def give(batch: np.ndarray, want: bool, to: list[list[np.ndarray]]) -> None:
        before = batch[batch > 0] - 1
        before = before[low[before] == want]
        if not len(before):
            return
        c = s[before]
        order = np.argsort(c, kind="stable")
        before, c = before[order], c[order]
        cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
        at = 0
        for end in [*cuts.tolist(), len(c)]:
            to[int(c[at])].append(before[at:end])
            at = end

    for c in range(sigma):
        done = 0
        while done < len(larger[c]):
            batch = larger[c][done] if len(larger[c]) == done + 1 else np.concatenate(larger[c][done:])
            done = len(larger[c])
            give(batch, False, larger)
        if len(seeds[c]):
            give(seeds[c], False, larger)
    smaller: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    for c in range(sigma - 1, -1, -1):
        done = 0
        while done < len(smaller[c]):
            batch = smaller[c][done] if len(smaller[c]) == done + 1 else np.concatenate(smaller[c][done:])
            done = len(smaller[c])
            give(batch, True, smaller)
        if larger[c]:
            give(np.concatenate(larger[c])[::-1], True, smaller)
    parts: list[np.ndarray] = [np.array([len(s) - 1])]
    for c in range(sigma):
        parts += larger[c]
        if smaller[c]:
            parts.append(np.concatenate(smaller[c])[::-1])
    return np.concatenate(parts)


def _seeds(s: np.ndarray, places: np.ndarray, sigma: int) -> list[np.ndarray]:
    order = places[np.argsort(s[places], kind="stable")]
    return np.split(order, np.searchsorted(s[order], np.arange(1, sigma)))


def _induce_by_place(s: np.ndarray, low: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """The same as ``_induce``, for ``seeds`` in one array in order."""
    n, text, small = len(s), s.tolist(), low.tolist()
    ends = np.cumsum(np.bincount(s, minlength=sigma))
    order, tail = [-1] * n, ends.tolist()
    for p in reversed(seeds.tolist()):
        c = text[p]
        tail[c] -= 1
        order[tail[c]] = p
    head = [0, *ends[:-1].tolist()]
    for i in range(n):
        p = order[i] - 1
        if p >= 0 and not small[p]:
            c = text[p]
            order[head[c]] = p
            head[c] += 1
    tail = ends.tolist()
    for i in range(n - 1, -1, -1):
        p = order[i] - 1
        if p >= 0 and small[p]:
            c = text[p]
            tail[c] -= 1
            order[tail[c]] = p
    return np.array(order)


def _induced(s: np.ndarray, low: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """``seeds``: the leftmost-smaller places, in order within each symbol."""
    return _induce(s, low, _seeds(s, seeds, sigma), sigma) if sigma <= FEW_BUCKETS else _induce_by_place(s, low, seeds, sigma)


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Suffixes of ``s`` in order; s holds 1..sigma-1 and ends with its only 0."""
    n = len(s)
    if n < 3:
        return np.arange(n)[::-1]
    differs = np.append(s[1:] != s[:-1], True)
    place = np.where(differs, np.arange(n), n)
    change = np.minimum.accumulate(place[::-1])[::-1]  # the end of each run of equal symbols
    low = s < s[np.minimum(change + 1, n - 1)]
    low[n - 1] = True
    lms = np.flatnonzero(low[1:] & ~low[:-1]) + 1
    order = _induced(s, low, lms, sigma)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_substring = order[is_lms[order]]

    end = np.full(n, n - 1)
    end[lms[:-1]] = lms[1:]
    size = end[by_substring] - by_substring + 1
    same = np.append(False, size[1:] == size[:-1])
    left = np.flatnonzero(same)
    for j in range(int(size.max())):
        left = left[j < size[left]]
        if not len(left):
            break
        off = s[by_substring[left] + j] != s[by_substring[left - 1] + j]
        same[left[off]] = False
        left = left[~off]
    name = np.zeros(n, "i8")
    name[by_substring] = np.cumsum(~same) - 1
    names = int(name[by_substring[-1]]) + 1
    if names < len(lms):
        by_substring = lms[suffix_array(name[lms], names)]
    return _induced(s, low, by_substring, sigma)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, most: int, restart: np.ndarray | None = None) -> np.ndarray:
    """For each place in text order, how many symbols it shares with the suffix before it in order.

    Only irreducible places, whose preceding symbol differs from that of their neighbour, are compared; each
    following place shares one symbol less. Comparisons end at ``most`` symbols, so a count is exact where the place's
    irreducible one lies less than ``most`` minus the count before it; places in ``restart`` are compared themselves.
    """
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    known = before >= 0
    prior = np.where((at > 0) & (before > 0), 1, 0).astype(bool) & known
    reducible = np.zeros(n, bool)
    reducible[prior] = text[at[prior] - 1] == text[before[prior] - 1]
    if restart is not None:
        reducible[restart] = False
    start = np.flatnonzero(~reducible & known)
    size = np.zeros(len(start), "i8")
    left = np.arange(len(start))
    padded = np.append(text, np.zeros(most + 1, text.dtype))
    for j in range(most):
        a, b = start[left] + j, before[start[left]] + j
        left = left[(padded[a] == padded[b]) & (a < n) & (b < n)]
        if not len(left):
            break
        size[left] += 1
    out = np.zeros(n, "i8")
    out[start] = size + start
    out[~known] = np.flatnonzero(~known)
    is_start = ~reducible
    last = np.maximum.accumulate(np.where(is_start, at, 0))
    return np.clip(out[last] - at, 0, most)
