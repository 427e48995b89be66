"""Two-stage suffix sorting with numpy, and repeated windows found by it.

A suffix is of the first kind if it is smaller than its successor.  Only those
are sorted directly; the others are induced: buckets of the first byte are
scanned in ascending order, and each suffix met puts its predecessor, if of the
second kind, at the next free place of the predecessor's bucket.  A bucket is
scanned in whole arrays: what it holds from smaller buckets, then what it
induces in itself, round after round, then its directly sorted suffixes.
"""

from __future__ import annotations

import numpy as np


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a big-endian number; zeros behind the end.
    A view that overlaps itself: what is looked up is copied, the rest is not."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8", buffer=padded, strides=(1,))


def _at(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    return words[places].astype(np.uint64)


def direct(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The places in the order of their first ``depth`` bytes."""
    order = places[np.argsort(_at(words, places), kind="stable")]
    group = _at(words, order)
    same = group[1:] == group[:-1]
    tied = np.zeros(len(order), bool)
    tied[1:] |= same
    tied[:-1] |= same
    at = np.flatnonzero(tied)
    # number of the tie that each tied place is in
    number = np.cumsum(np.concatenate([[False], ~same]))[at] if len(at) else at
    for shift in range(8, depth, 8):
        if not len(at):
            break
        mine = order[at]
        key = _at(words, np.minimum(mine + shift, len(words) - 1))
        key = np.where(mine + shift < len(words), key, np.uint64(0))
        sort = np.lexsort((key, number))
        order[at] = mine[sort]
        key = key[sort]
        same = (key[1:] == key[:-1]) & (number[1:] == number[:-1])
        tied = np.zeros(len(at), bool)
        tied[1:] |= same
        tied[:-1] |= same
        number = np.cumsum(np.concatenate([[False], ~same]))[tied]
        at = at[tied]
    return order


def suffix_array(data: np.ndarray, depth: int = 1 << 30) -> np.ndarray:
    """Places of all suffixes in the order of at least their first ``depth`` bytes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = np.int32 if n < 1 << 31 else np.int64
    # smaller than the successor: a smaller byte, or the same as for the next place if equal; the last is not
    ends = np.append(np.flatnonzero(data[1:] != data[:-1]), n - 1)
    rises = np.append(data[ends[:-1] + 1] > data[ends[:-1]], False)
    upward = np.repeat(rises, np.diff(ends, prepend=-1))
    ups = direct(_words(data), np.flatnonzero(upward).astype(kind), depth)
    up_first = np.searchsorted(data[ups], np.arange(257))
    down_count = np.bincount(data[~upward], minlength=256)
    all_count = np.bincount(data, minlength=256)
    first = np.concatenate([[0], np.cumsum(all_count)])
    out = np.empty(n, kind)
    filled = first[:256].copy()

    def induce(found: np.ndarray, least: int) -> None:
        """Put the predecessors of the second kind behind what their buckets hold."""
        before = found[found > 0] - 1
        before = before[~upward[before]]
        if not len(before):
            return
        heads = data[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        cut = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(heads)], strict=True):
            c = int(heads[a])
            out[filled[c] : filled[c] + b - a] = before[a:b]
            filled[c] += b - a

    # the empty suffix at the end comes first of all and induces the last one
    last = n - 1
    out[filled[data[last]]] = last
    filled[data[last]] += 1
    for c in range(256):
        at = int(first[c])
        while at < filled[c]:  # includes what the bucket induces in itself
            end = int(filled[c])
            induce(out[at:end], c)
            at = end
        own = ups[up_first[c] : up_first[c + 1]]
        out[first[c] + down_count[c] : first[c + 1]] = own
        induce(own, c)
    return out


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of the common prefix of each suffix and the one before it."""
    words = _words(data)
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    left, right = order[:-1], order[1:]
    live = np.arange(len(left))
    for shift in range(0, most, 8):
        a, b = left[live] + shift, right[live] + shift
        inside = (a < len(data)) & (b < len(data))
        live, a, b = live[inside], a[inside], b[inside]
        differ = _at(words, a) ^ _at(words, b)
        rest = differ > 0
        if rest.any():
            bits = np.zeros(int(rest.sum()), np.int64)
            value = differ[rest]
            for k in range(8):  # equal leading bytes
                bits += (value >> np.uint64(8 * (7 - k))) == 0
            out[live[rest] + 1] = shift + bits
        live = live[~rest]
        out[live + 1] = shift + 8
        if not len(live):
            break
    ends = np.minimum(len(data) - left, len(data) - right)
    out[1:] = np.minimum(np.minimum(out[1:], ends), most)
    return out


def repeated_windows(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """True for each given start whose window of ``length`` bytes also begins at
    another given start.  Windows do not reach beyond the data."""
    if len(starts) < 2:
        return np.zeros(len(starts), bool)
    wanted = np.zeros(len(data), bool)
    wanted[starts] = True
    order = suffix_array(data, length)
    order = order[wanted[order]]
    same = common_prefixes(data, order, length)[1:] >= length
    hit = np.zeros(len(data), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return hit[starts]
