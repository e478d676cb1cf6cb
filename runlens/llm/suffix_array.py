"""Suffix arrays by two-stage sorting, to a given depth.

Suffixes smaller than their successors are sorted directly, eight bytes at a
time and only where still tied. All others are induced: buckets of first bytes
are scanned in ascending order, and each suffix found puts the one that starts
a byte before it at the end of that one's bucket. Adjacent common prefixes are
then computed up to the depth.
"""

from __future__ import annotations

import numpy as np


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as a big-endian number, zeros beyond."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    out = padded[:-8].astype(np.uint64)
    width = 1
    padded = out
    while width < 8:
        shifted = np.concatenate((padded[width:], np.zeros(min(width, len(padded)), np.uint64)))[: len(padded)]
        padded = (padded << np.uint64(8 * width)) | shifted
        width *= 2
    return padded


def rising(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each position is smaller than its successor."""
    n = len(text)
    if not n:
        return np.zeros(0, bool)
    last = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    up = np.append(text[last[:-1]] < text[last[:-1] + 1], False)
    return np.repeat(up, np.diff(np.append(-1, last)))


def _sort_directly(at: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """Positions by the ``depth`` bytes that follow, rounded up to the step."""
    if len(at) < 2:
        return at
    n = len(word)
    order = np.argsort(word[at])
    at = at[order]
    first = word[at]
    same = np.append(False, first[1:] == first[:-1])
    done = 8
    while done < depth and same.any():
        tied = same.copy()
        tied[:-1] |= same[1:]
        where = np.flatnonzero(tied)
        group = np.cumsum(~same[where])
        step = 5 if len(where) < 1 << 24 else 3
        ahead = at[where] + done
        key = np.where(ahead < n, word[np.minimum(ahead, n - 1)], np.uint64(0)) >> np.uint64(64 - 8 * step)
        key |= group.astype(np.uint64) << np.uint64(8 * step)
        order = np.argsort(key)
        at[where] = at[where][order]
        key = key[order]
        same[where] = np.append(False, key[1:] == key[:-1])
        done += step
    return at


def suffix_array(text: np.ndarray, depth: int, word: np.ndarray | None = None) -> np.ndarray:
    """All positions of ``text`` (uint8), by their suffixes' first ``depth`` bytes.

    Suffixes that agree that far stand together, in no stated order.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    word = words(text) if word is None else word
    up = rising(text)
    direct = _sort_directly(np.flatnonzero(up), word, depth)
    direct_cut = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    size = np.bincount(text, minlength=256)
    lists: list[list[np.ndarray]] = [[] for _ in range(256)]
    lists[text[-1]].append(np.array([n - 1], np.int64))  # the shortest suffix is the least of its bucket
    before = np.empty(n, np.int16)  # byte before each position; none before the first
    before[0] = -1
    before[1:] = text[:-1]
    out = []
    for byte in np.flatnonzero(size):
        part = lists[byte]
        current = np.concatenate(part) if part else np.zeros(0, np.int64)
        whole = [current]
        while len(current):  # runs of this byte induce within the bucket
            current = current[before[current] == byte] - 1
            if len(current):
                whole.append(current)
        whole.append(direct[direct_cut[byte] : direct_cut[byte + 1]])
        whole = np.concatenate(whole)
        lists[byte] = []
        out.append(whole)
        prior = before[whole]
        larger = prior > byte
        source, prior = whole[larger] - 1, prior[larger].astype(np.uint8)
        order = np.argsort(prior, kind="stable")
        source, prior = source[order], prior[order]
        cut = np.flatnonzero(np.append(True, prior[1:] != prior[:-1])) if len(prior) else []
        for a, b in zip(cut, np.append(cut[1:], len(prior)) if len(prior) else []):
            lists[prior[a]].append(source[a:b])
    return np.concatenate(out)


def common_prefixes(word: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it, at most ``depth``."""
    n = len(word)
    out = np.zeros(len(order), np.int32)
    still = np.arange(1, len(order))
    done = 0
    while done < depth and len(still):
        a, b = order[still] + done, order[still - 1] + done
        inside = np.maximum(a, b) < n
        diff = np.where(inside, word[np.minimum(a, n - 1)] ^ word[np.minimum(b, n - 1)], np.uint64(1) << np.uint64(63))
        equal = diff == 0
        left = still[~equal]
        if len(left):
            d = diff[~equal]
            lead = np.zeros(len(d), np.int32)
            for shift in (32, 16, 8):
                high = d >> np.uint64(64 - shift)
                none = high == 0
                lead += np.where(none, shift // 8, 0).astype(np.int32)
                d = np.where(none, d << np.uint64(shift), d)
            out[left] = done + lead
        still = still[equal]
        done += 8
        out[still] = done
    # zeros stand beyond the end: no prefix reaches past it
    if len(order) > 1:
        out[1:] = np.minimum(out[1:], n - np.maximum(order[1:], order[:-1]))
    return np.minimum(out, depth)
