"""External induced suffix sorting with common-prefix values.

``sort_suffixes(text)`` returns the suffixes of a byte string in order, with the length (up to a cap)
of the prefix that each shares with the one before.

Suffixes are of type L (greater than the next suffix) or S. Those S suffixes that follow an L suffix
(LMS) are sorted first: induction sorts the substrings between them, these get names, and the string
of names is sorted by the same procedure, recursively, until it has at most BASE names, which are sorted
in memory. From the sorted LMS suffixes all L suffixes are induced in ascending order, and from those all
S suffixes in descending order.

Induction runs on a priority queue of (first symbol, arrival): a suffix that leaves the queue inserts
the suffix one symbol longer. Since insertions under a symbol arrive in the order of their rank, a
bucket for each symbol (or range of symbols, in the recursion) is first-in first-out, and its entries,
suffixes with their common-prefix values, are handled as arrays. Buckets beyond the queue's memory
limit are appended to a scratch file of the task that has no name and ends with it. A new entry's
common prefix with the entry before it in its bucket is one more than the least value that left the
queue between the two; range minima over each array give all of them at once.
"""

from __future__ import annotations

import tempfile

import numpy as np

QUEUE_BYTES = 64 << 20
#: Buckets of a queue over names; fewer mean larger arrays and more rounds in each.
RANGES = 96
#: Names that are sorted in memory, where the recursion ends.
BASE = 4 << 20


class BucketQueue:
    """Arrays of (suffix, prefix) by bucket, first in first out; a bucket's arrays go to disk beyond the limit."""

    def __init__(self, limit: int | None = None):
        self.limit = QUEUE_BYTES if limit is None else limit
        self.held: dict[int, list] = {}
        self.bytes = 0
        self.file = None

    def push(self, bucket: int, suffixes: np.ndarray, prefix: np.ndarray | None) -> None:
        self.held.setdefault(bucket, []).append((suffixes, prefix))
        self.bytes += suffixes.nbytes
        if self.bytes > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for parts in self.held.values():
            for k, part in enumerate(parts):
                if len(part) == 2 and part[0] is not None:
                    s, p = part
                    at = self.file.seek(0, 2)
                    self.file.write(s.tobytes())
                    if p is not None:
                        self.file.write(p.tobytes())
                    parts[k] = (None, at, len(s), s.dtype, p is not None)
        self.bytes = 0

    def pop(self, bucket: int) -> tuple[np.ndarray, np.ndarray | None]:
        out = []
        for part in self.held.pop(bucket, ()):
            if part[0] is None:
                _, at, n, dtype, has = part
                self.file.seek(at)
                s = np.frombuffer(self.file.read(n * dtype.itemsize), dtype)
                out.append((s, np.frombuffer(self.file.read(n), np.uint8) if has else None))
            else:
                self.bytes -= part[0].nbytes
                out.append(part)
        if not out:
            return np.zeros(0, np.int32), np.zeros(0, np.uint8)
        return np.concatenate([s for s, _ in out]), None if out[0][1] is None else np.concatenate([p for _, p in out])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _range_min(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(a[lo..hi]) of each pair, ends included."""
    levels, step = [a], 1
    longest = int((hi - lo).max()) + 1 if len(lo) else 1
    while 2 * step <= longest:
        b = levels[-1]
        levels.append(np.minimum(b[:-step], b[step:]) if len(b) > step else b[:0])
        step *= 2
    k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), a.dtype)
    for level in range(len(levels)):
        on = np.flatnonzero(k == level)
        if len(on):
            b = levels[level]
            out[on] = np.minimum(b[lo[on]], b[hi[on] - (1 << level) + 1])
    return out


def types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes."""
    n = len(t)
    s = np.zeros(n, bool)
    if n > 1:
        rise = t[:-1] < t[1:]
        differs = t[:-1] != t[1:]
        nxt = np.where(differs, np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
        nxt = np.minimum.accumulate(nxt[::-1])[::-1]
        inside = nxt < n - 1
        s[:-1][inside] = rise[nxt[inside]]
    return s


def _by_symbol(t, placed, seeds, prefix, first, cap):
    """Induce with one bucket for each byte. Returns {symbol: (suffixes, prefix)} of the placed type, in order."""
    queue = BucketQueue()
    since = np.full(256, 255, np.int16)  # least prefix that left the queue since the last insertion into a bucket
    used = np.zeros(256, bool)
    track = prefix is not None
    prior = np.concatenate(([False], placed[:-1]))
    seed_symbol = t[seeds]
    counts = np.bincount(seed_symbol, minlength=256)
    seed_at = np.concatenate(([0], np.cumsum(counts)))
    out = {}

    def leave(s, p, symbol):
        """Insert what ``s`` (with ``p``) induces; returns what stays in the bucket being read."""
        nonlocal since
        own, own_p = s[:0], None
        at = np.flatnonzero(prior[s])
        if len(at):
            pred = s[at] - 1
            to = t[pred]
            order = np.argsort(to, kind="stable")
            at, to = at[order], to[order]
            starts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            if track:
                new = np.zeros(len(at), bool)
                new[starts] = True
                lo = np.concatenate(([0], at[:-1] + 1))
                lo[new] = 0
                low = _range_min(p, lo, at).astype(np.int16)
                low[new] = np.minimum(low[new], since[to[starts]])
                value = np.minimum(low + 1, cap)
                value[starts[~used[to[starts]]]] = 0
                value = value.astype(np.uint8)
                tail = np.full(256, -1)
                ends = np.append(starts[1:], len(at)) - 1
                tail[to[ends]] = at[ends]
                backward = np.minimum.accumulate(p[::-1])[::-1].astype(np.int16)
                least = np.append(backward, 255)
                since = np.where(tail >= 0, least[tail + 1], np.minimum(since, least[0]))
                used[to[starts]] = True
            pred = s[at] - 1
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
                part = pred[a:b]
                if to[a] == symbol:
                    own, own_p = part, value[a:b] if track else None
                else:
                    queue.push(int(to[a]), part, value[a:b] if track else None)
        elif track and len(p):
            since = np.minimum(since, p.min())
        return own, own_p

    if first is not None:
        queue.push(int(t[first]), np.array([first], np.int32), np.zeros(1, np.uint8) if track else None)
        used[t[first]] = True
        since[:] = 0
    for symbol in range(256):
        s, p = queue.pop(symbol)
        got, got_p = [], []
        opened = False
        while len(s):
            if track:
                p = p.copy()
                if not opened:
                    p[0] = 0
            opened = True
            got.append(s)
            got_p.append(p)
            s, p = leave(s, p, symbol)
        a, b = seed_at[symbol], seed_at[symbol + 1]
        if b > a:
            s = seeds[a:b]
            if track:
                p = prefix[a:b].copy()
                p[0] = _common(t, int(got[-1][-1]), int(s[0]), cap) if opened else 0
            leave(s, p, symbol)
        if got:
            out[symbol] = (np.concatenate(got), np.concatenate(got_p) if track else None)
    queue.close()
    return out


def _by_range(t, placed, seeds, first, size):
    """Induce with a bucket for each range of symbols; the placed type in order."""
    n_ranges = max(1, min(RANGES, len(t) // 64))
    share = np.cumsum(np.bincount(t, minlength=size))
    of = np.minimum((share - 1) * n_ranges // max(1, len(t)), n_ranges - 1)
    queue = BucketQueue()
    seed_range = of[t[seeds]]
    seed_at = np.searchsorted(seed_range, np.arange(n_ranges + 1))
    place = np.full(len(t), -1, np.int64)
    wide = len(t) + 1
    out = []
    if first is not None:
        queue.push(int(of[t[first]]), np.array([first], np.int32), None)

    def preds(s):
        p = s - 1
        p = p[p >= 0]
        return p[placed[p]]

    for r in range(n_ranges):
        new, _ = queue.pop(r)
        own_seeds = seeds[seed_at[r] : seed_at[r + 1]]
        if not len(new) and not len(own_seeds):
            continue
        outer, outer_rank = new, np.arange(len(new))
        inner = np.zeros(0, np.int32)
        order = None
        while True:
            every = np.concatenate((outer, inner, own_seeds)).astype(np.int64)
            kind = np.concatenate((np.zeros(len(outer) + len(inner), np.int8), np.ones(len(own_seeds), np.int8)))
            inside = np.concatenate((np.zeros(len(outer), np.int8), np.ones(len(inner), np.int8), np.zeros(len(own_seeds), np.int8)))
            rank = np.concatenate((outer_rank, place[inner + 1] if len(inner) else np.zeros(0, np.int64), np.arange(len(own_seeds))))
            order = np.argsort(((t[every].astype(np.int64) * 2 + kind) * 2 + inside) * wide + rank)
            place[every[order]] = np.arange(len(every))
            more = preds(every)
            more = more[of[t[more]] == r]
            if len(more) == len(inner):
                break
            inner = more
        # a last order in which every rank is that of the complete set
        while len(inner):
            rank = np.concatenate((outer_rank, place[inner + 1], np.arange(len(own_seeds))))
            again = np.argsort(((t[every].astype(np.int64) * 2 + kind) * 2 + inside) * wide + rank)
            if (again == order).all():
                break
            order = again
            place[every[order]] = np.arange(len(every))
        ordered = every[order]
        out.append(ordered[kind[order] == 0])
        p = preds(ordered)
        to = of[t[p]]
        p, to = p[to != r], to[to != r]
        o = np.argsort(to, kind="stable")
        p, to = p[o].astype(np.int32), to[o]
        starts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else []
        for a, b in zip(starts, [*starts[1:], len(to)], strict=True) if len(to) else ():
            queue.push(int(to[a]), p[a:b], None)
        place[every] = -1
    queue.close()
    return np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)


def _common(t: np.ndarray, i: int, j: int, cap: int) -> int:
    k = min(cap, len(t) - max(i, j))
    d = np.flatnonzero(t[i : i + k] != t[j : j + k])
    return int(d[0]) if len(d) else k


def _common_pairs(t: np.ndarray, a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes of each pair, up to its bound."""
    bound = np.minimum(bound, len(t) - np.maximum(a, b))
    out = bound.copy()
    pad = np.concatenate((t, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(t) + 1,), "<u8", pad, strides=(1,))
    on = np.flatnonzero(bound > 0)
    a, b = a.astype(np.int64)[on], b.astype(np.int64)[on]
    k = 0
    while len(on) > 64:
        x = eight[a + k] ^ eight[b + k]
        stop = np.flatnonzero(x)
        low = x[stop] & (~x[stop] + np.uint64(1))
        at = on[stop]
        out[at] = np.minimum(bound[at], k + (np.frexp(low.astype(np.float64))[1] - 1 >> 3))
        k += 8
        go = (x == 0) & (bound[on] > k)
        on, a, b = on[go], a[go], b[go]
    for at, i, j in zip(on.tolist(), a.tolist(), b.tolist(), strict=True):
        out[at] = k + _common(t, i + k, j + k, int(bound[at]) - k)
    return out


def _common_seeds(t: np.ndarray, s: np.ndarray, lms: np.ndarray, names: np.ndarray | None, cap: int) -> np.ndarray:
    """Common prefix of each sorted LMS suffix with the one before it, up to cap.

    Where neighbours both follow LMS substrings of one name, the suffixes that begin with these are neighbours
    too, and share as much more as that substring is long. Only the first of such a chain is compared.
    """
    m = len(s)
    if m < 2:
        return np.zeros(m, np.uint8)
    nth = np.empty(len(t), np.int32)
    nth[lms] = np.arange(m, dtype=np.int32)
    of = nth[s]
    before = np.full(m, -1, np.int32)  # the neighbour before, both counted in the order of the text
    before[of[1:]] = of[:-1]
    first = np.ones(m, bool)
    if names is not None:
        i = before[1:]
        first[1:] = (i < 1) | (names[i - 1] != names[:-1]) | (before[:-1] != i - 1)
    heads = np.flatnonzero(first)
    last = np.append(heads[1:], m) - 1
    head_at = lms[heads].astype(np.int64)
    lone = before[heads] < 0  # the least suffix
    shared = _common_pairs(t, lms[np.where(lone, 0, before[heads])], lms[heads], np.where(lone, 0, lms[last] - head_at + cap))
    each = last - heads + 1
    return np.minimum(np.repeat(shared + head_at, each) - lms, cap).clip(0).astype(np.uint8)[of]


def _order(t: np.ndarray, size: int, s: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The LMS suffixes of ``t`` in order; the names of their substrings in the order of the text, None if all differ."""
    if len(lms) < 2:
        return lms, None
    n = len(t)
    wide = size > 256
    by = lms[np.argsort(t[lms], kind="stable")]
    if wide:
        ls = _by_range(t, ~s, by, n - 1, size)
        ss = _by_range((size - 1 - t), s, ls[::-1], None, size)[::-1]
    else:
        b8 = t if t.dtype == np.uint8 else t.astype(np.uint8)
        got = _by_symbol(b8, ~s, by, None, n - 1, 0)
        ls = np.concatenate([got[k][0] for k in sorted(got)])
        got = _by_symbol(255 - b8, s, ls[::-1], None, None, 0)
        ss = (np.concatenate([got[k][0] for k in sorted(got)]) if got else np.zeros(0, np.int32))[::-1]
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = ss[is_lms[ss]]
    # names: equal neighbours, symbol by symbol up to the next LMS position
    nth = np.full(n + 1, -1, np.int32)
    nth[lms] = np.arange(len(lms))
    end = np.append(lms[1:] + 1, n)
    length = (end - lms)[nth[ordered]]
    final = ordered == lms[-1]
    differs = np.ones(len(ordered), bool)
    on = np.flatnonzero((length[1:] == length[:-1]) & ~final[1:] & ~final[:-1]) + 1
    k = 0
    while len(on):
        same = t[ordered[on] + k] == t[ordered[on - 1] + k]
        on = on[same]
        k += 1
        done = length[on] == k
        differs[on[done]] = False
        on = on[~done]
    names = np.cumsum(differs) - 1
    if names[-1] + 1 == len(ordered):
        return ordered, None
    by = nth[ordered]
    reduced = np.empty(len(lms), np.int32)
    reduced[by] = names
    if len(reduced) <= BASE:
        return lms[_doubled(by.astype(np.int64), differs)], reduced
    return lms[_all(reduced, int(names[-1]) + 1, types(reduced))], reduced


def _doubled(order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All suffixes of a string of names in order, in memory: ranks by 1, 2, 4, ... names, of those that still tie.

    ``order`` has them by their first name; ``first``: the name differs from that of the one before.
    """
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    ties = _tied(np.arange(n), first)
    h = 1
    while len(ties):
        s = order[ties]
        key = rank[s] * (n + 1) + np.where(s + h < n, rank[np.minimum(s + h, n - 1)] + 1, 0)
        o = np.argsort(key)
        s, key = s[o], key[o]
        order[ties] = s
        first = np.concatenate(([True], key[1:] != key[:-1]))
        rank[s] = np.maximum.accumulate(np.where(first, ties, 0))
        ties = _tied(ties, first)
        h *= 2
    return order


def _tied(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Those of the places ``at`` that aren't alone in their group."""
    return at[~(first & np.append(first[1:], True))]


def _lms(s: np.ndarray) -> np.ndarray:
    return (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(np.int32)


def _all(t: np.ndarray, size: int, s: np.ndarray) -> np.ndarray:
    """All suffixes of the string of names in order."""
    n = len(t)
    seeds, _ = _order(t, size, s, _lms(s))
    seeds = seeds[np.argsort(t[seeds], kind="stable")]
    ls = _by_range(t, ~s, seeds, n - 1, size)
    ss = _by_range(size - 1 - t, s, ls[::-1], None, size)[::-1]
    both = np.concatenate((ls, ss))
    rank = np.concatenate((np.arange(len(ls)), np.arange(len(ss))))
    return both[np.lexsort((rank, s[both], t[both]))]


def sort_suffixes(text: np.ndarray, cap: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes of the bytes in order, prefix shared with the suffix before, at most ``cap`` <= 254)."""
    t = np.asarray(text, np.uint8)
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.uint8)
    s = types(t)
    lms = _lms(s)
    seeds, names = _order(t, 256, s, lms)
    ls = _by_symbol(t, ~s, seeds, _common_seeds(t, seeds, lms, names, cap), n - 1, cap)
    flat = [ls[k] for k in sorted(ls)]
    l_s = np.concatenate([x for x, _ in flat])
    l_p = np.concatenate([p for _, p in flat])
    back = np.concatenate((l_p[1:], np.zeros(1, np.uint8)))[::-1]
    got = _by_symbol(255 - t, s, l_s[::-1].copy(), back.copy(), None, cap)
    order, prefix = [], []
    for c in range(256):
        tail = None
        if c in ls:
            order.append(ls[c][0])
            prefix.append(ls[c][1])
            tail = int(ls[c][0][-1])
        if 255 - c in got:
            x, p = got[255 - c]
            up = np.concatenate((np.zeros(1, np.uint8), p[1:][::-1]))
            x = x[::-1]
            if tail is not None:
                up[0] = _common(t, tail, int(x[0]), cap)
            order.append(x)
            prefix.append(up)
    return np.concatenate(order), np.concatenate(prefix)
