"""Exact Jaccard similarity within a group of sets."""

from __future__ import annotations

import heapq

import numpy as np

#: Sets of a group above which links are sought by parities, most bits of these, words they are folded to at first, cells
#: worked on at once.
MANY, MOST_BITS, FOLDED, AT_ONCE = 8, 4096, 4, 1 << 20


def _distinct(sorted_: np.ndarray) -> np.ndarray:
    """Where a value of a sorted array comes first."""
    new = np.ones(len(sorted_), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    return new


def _size(values: np.ndarray) -> int:
    return int(np.count_nonzero(_distinct(np.sort(values))))


def similar_links(shingles: np.ndarray, owner: np.ndarray, n: int, least: tuple[int, int], side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (by place) of a spanning forest of the graph of sets whose similarity is ``least`` (a fraction) or more.

    ``shingles`` are 64-bit hashes, ``owner`` the place (0 to n - 1, each at least once) of the set that has each;
    repeats count once. ``side``: two blocks, of which only crossing pairs count. Common shingles are counted over the
    lists of the sets that hold each, so unlike sets cost nothing. Of more than MANY sets only those that have no link
    yet are looked at, and counted only where parities of their shingles leave it open.
    """
    part, whole = least
    if n == 2:
        second = owner == 1
        either = _size(shingles)
        like = whole * (_size(shingles[~second]) + _size(shingles[second]) - either) >= part * either and (side is None or side[0] != side[1])
        return np.arange(int(like)), np.arange(1, 1 + int(like))
    # The owner in place of the hash's last bits makes one plain sort do; if that takes two shingles for one, they are named anew.
    low = np.uint64((n - 1).bit_length())
    if _size(shingles >> low) < _size(shingles):
        shingles = np.unique(shingles, return_inverse=True)[1].astype(np.uint64) << low
    held = np.sort(shingles >> low << low | owner.astype(np.uint64))
    held = held[_distinct(held)]
    holder, shingle = (held & (np.uint64(1) << low) - np.uint64(1)).view(np.int64), np.cumsum(_distinct(held >> low)) - 1
    size = np.bincount(holder, minlength=n)
    many = np.bincount(shingle)
    if n > MANY:
        return _links_by_parity(holder, shingle, size, many, least, side)
    begin = np.cumsum(many) - many
    own, ends = shingle[np.argsort(holder, kind="stable")], np.cumsum(size)
    open_ = np.ones(n, bool)
    u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for first in range(n):
        if not open_[first]:
            continue
        open_[first] = False
        queue = [first]
        while queue and open_.any():
            x = queue.pop()
            mine = own[ends[x] - size[x] : ends[x]]
            m = many[mine]
            at = np.repeat(begin[mine] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            common = np.bincount(holder[at], minlength=n)
            hit = open_ & (whole * common >= part * (size[x] + size - common))
            if side is not None:
                hit &= side != side[x]
            found = np.flatnonzero(hit)
            open_[found] = False
            u.append(np.full(len(found), x))
            v.append(found)
            queue += found.tolist()
    return np.concatenate(u), np.concatenate(v)


def _parities(holder: np.ndarray, shingle: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Per set (rows in order of holder) bits that each of its shingles flips one of: two sets differ in no more bits than shingles."""
    bits = 64
    while bits < min(2 * size.mean(), MOST_BITS):
        bits *= 2
    out = np.empty((len(size), bits // 64), np.uint64)
    ends, step = np.cumsum(size), max(1, AT_ONCE // bits)
    for at in range(0, len(size), step):
        to = min(at + step, len(size))
        part = slice(ends[at] - size[at], ends[to - 1])
        flips = np.bincount((holder[part] - at) * bits + shingle[part] % bits, minlength=(to - at) * bits)
        out[at:to] = np.packbits((flips & 1).astype(bool)).view(np.uint64).reshape(to - at, -1)
    return out


def _links_by_parity(holder: np.ndarray, shingle: np.ndarray, size: np.ndarray, many: np.ndarray, least: tuple[int, int], side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """As ``similar_links``, of distinct (shingle, holder); ``size`` and ``many`` count the shingles of sets and the reverse.

    Each set in turn is held against those without a link whose size allows one. Parities, folded to a few words at
    first, bound from below in how many shingles two sets differ, so no link is lost, and the shingles of the few pairs
    left are counted. Sets of common shingles come first: they have most links.
    """
    part, whole = least
    n = len(size)
    old = np.argsort(-np.bincount(holder, many[shingle], n) / size, kind="stable")
    new = np.empty(n, np.int64)
    new[old] = np.arange(n)
    both = np.sort(new[holder] << 32 | shingle)
    flat, size, side = both & (1 << 32) - 1, size[old], None if side is None else side[old]
    starts = np.cumsum(size) - size
    bits = _parities(both >> 32, flat, size)
    few = np.ascontiguousarray(np.bitwise_xor.reduce(bits.reshape(n, -1, min(FOLDED, bits.shape[1])), axis=1).T)
    open_, mark = np.ones(n, bool), np.zeros(len(many), bool)
    rest, left = np.argsort(size, kind="stable"), n
    rest_few, rest_size = few[:, rest], size[rest]
    u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for first in range(n):
        if not open_[first]:
            continue
        open_[first] = False
        left -= 1
        queue = [first]
        while queue and left:
            if 2 * left < len(rest):
                rest = rest[open_[rest]]
                rest_few, rest_size = few[:, rest], size[rest]
            x = heapq.heappop(queue)
            a, b = np.searchsorted(rest_size, [-(-part * size[x] // whole), whole * size[x] // part + 1]).tolist()
            differ = np.bitwise_count(rest_few[:, a:b] ^ few[:, x, None]).sum(axis=0, dtype=np.int64)
            some = rest[a:b][(whole + part) * differ <= (whole - part) * (size[x] + rest_size[a:b])]
            some = some[open_[some]]
            if side is not None:
                some = some[side[some] != side[x]]
            if len(some) and len(few) < bits.shape[1]:
                differ = np.bitwise_count(bits[some] ^ bits[x]).sum(axis=1, dtype=np.int64)
                some = some[(whole + part) * differ <= (whole - part) * (size[x] + size[some])]
            if not len(some):
                continue
            mine = flat[starts[x] : starts[x] + size[x]]
            mark[mine] = True
            total = np.cumsum(size[some])
            bounds = np.searchsorted(total, np.arange(0, total[-1] + AT_ONCE, AT_ONCE), side="right").tolist()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if a == b:
                    continue
                some_size = size[some[a:b]]
                before = np.cumsum(some_size) - some_size
                theirs = flat[np.repeat(starts[some[a:b]] - before, some_size) + np.arange(some_size.sum())]
                common = np.add.reduceat(mark[theirs], before, dtype=np.int64)
                found = some[a:b][whole * common >= part * (size[x] + some_size - common)]
                open_[found] = False
                left -= len(found)
                u.append(np.full(len(found), x))
                v.append(found)
                for k in found.tolist():
                    heapq.heappush(queue, k)
            mark[mine] = False
    return old[np.concatenate(u)], old[np.concatenate(v)]
