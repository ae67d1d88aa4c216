"""Line dedup by a segment-partition edit join.

A line that may have ``k`` edits is cut into ``k + 1`` segments, of which a line that close has at least one unchanged.
Those of the left half are counted from the line's start and those of the right half from its end: with ``k`` edits
either the left half has fewer edits than segments or the right half has. In that half, the first segment ``i`` (from
its end of the line) up to which the edits are no more than ``i`` is unchanged itself and moved by at most ``i``. So a
line indexes its segments as they stand and looks up the substrings moved by up to ``i``, under its length class and,
where a line close to it may be shorter, under the class before.

A segment is told by its smallest gram: substrings moved by a little have mostly the same one, so that a line looks up
about two keys a segment instead of one for each move. Grams are as long as the moves leave them: one that never moves is
the whole segment, so that unlike lines seldom have a key in common, however many there are.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidewater.llm.tables import give_back, row_key, table
from tidewater.operators.components import connected_components
from tidewater.spool import drop_spool, scratch, spool

#: Lines of fewer characters are compared for equality only.
LEAST_CHARS = 32
#: One edit and one more for every so many characters of the shorter line.
CHARS_AN_EDIT = 40
#: Lines with more edits look up all their smallest grams, whichever segment it is: there the moves overlap anyway.
NUMBERED = 50
#: Lines under one key up to which they are compared pairwise at once, and those up to which pairs are made at all.
FEW, PAIRWISE = 4, 32
#: Lines of a family, held together by such larger keys, up to which all of it is compared; beyond it, lines of one key up to which these are.
FAMILY, KEYED = 4_096, 65_536
#: Lines of a block of either, and blocks from which these grow instead, up to eight times.
BLOCK, BLOCKS = 512, 16
#: Pairs of a group that a task looks at together, and pairs that are a task's.
PAIRS, PAIRS_A_TASK = 50_000, 2_000
#: Rows (of two longs) up to which a table is broadcast; beyond it, it is shuffled.
BROADCAST_ROWS = 200_000
#: Edits up to which pairs are looked at side by side: their bands are four words wide at most.
WIDEST = 127
#: Rows that a Python worker gets together.
BATCH = 2_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Characters worked through together, and those whose keys are made together.
AT_A_TIME, KEYED_AT_A_TIME = 250_000, 1_000_000
#: Lines that a task remembers to have met.
MOST_MET = 200_000
#: Keys that a task holds before it deals them out or looks them up, and characters of a line for each of its keys.
KEYS_HELD, CHARS_A_KEY = 500_000, 13
DEALT = "bucket int, keys binary, lids binary"
_PRIME = 0x9E3779B97F4A7C15 | 1


class _Powers:
    """Powers of a prime and of its inverse, modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            back = pow(_PRIME, -1, 1 << 64)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]).cumprod(dtype=np.uint64) for x in (_PRIME, back))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _mixed(h: np.ndarray, length_class: int) -> np.ndarray:
    x = h ^ np.uint64(length_class * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def most_edits(size: int | np.ndarray) -> int | np.ndarray:
    return 1 + size // CHARS_AN_EDIT


def _bounds() -> np.ndarray:
    """First sizes of the length classes: each wider than the edits of its lines, so that a pair is in one or two neighbours."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] + max(4, out[-1] // 4))
    return np.array(out, np.int64)


_BOUNDS = _bounds()


class Lines:
    """The lines of some texts that are not blank, in normal form: A-Z lower-cased."""

    def __init__(self, texts: list[str], clashing: frozenset[int] = frozenset()):
        cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        cp[(cp >= 65) & (cp <= 90)] += 32
        self.cp = cp
        ends = np.append(np.flatnonzero(cp == 10), len(cp))
        starts = np.append(0, ends[:-1] + 1)
        text_end = np.cumsum([len(t) + 1 for t in texts]) - 1
        of = np.searchsorted(text_end, starts)
        nth = np.arange(len(starts)) - np.searchsorted(of, of)
        marks = np.append(np.int32(0), np.cumsum((cp > 32) | (cp < 9) | ((cp > 13) & (cp < 32)), dtype=np.int32))
        full = marks[ends] > marks[starts]
        self.start, self.end, self.text, self.nth = starts[full], ends[full], of[full], nth[full]
        self.size = self.end - self.start
        digest = xxhash.xxh3_128_intdigest
        both = [digest(cp[a:z].data) for a, z in zip(self.start.tolist(), self.end.tolist(), strict=True)]
        low, high = (np.array([x >> at & (1 << 64) - 1 for x in both], np.uint64).view(np.int64) for at in (0, 64))
        self.lid = np.where(np.isin(low, list(clashing)), high, low) if clashing else low
        self.check = high

    def signature(self) -> tuple[np.ndarray, np.ndarray]:
        """How often the characters of each of 16 classes occur, modulo 256, eight classes in a long."""
        gaps = np.append(self.start[1:], len(self.cp)) - self.start if len(self.start) else self.start
        kind = (self.cp[self.start[0] if len(self.start) else 0 :] * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.int32)
        # A line's row and one for what stands between it and the next one.
        row = np.repeat(np.arange(0, 32 * len(self.size), 16, dtype=np.int32), np.stack([self.size, gaps - self.size], axis=1).ravel())
        counts = np.bincount(row + kind, minlength=32 * len(self.size)).astype(np.uint8).reshape(-1, 32)[:, :16].copy().view("<i8")
        return counts[:, 0].copy(), counts[:, 1].copy()

    def keys(self, which: np.ndarray, edits: Callable = most_edits) -> tuple[pa.Array, pa.Array]:
        """Keys under which each line is indexed, and those it looks up besides; none for lines not in ``which`` (a mask)."""
        total, down = self._hashed()
        kind = np.searchsorted(_BOUNDS, self.size, side="right")
        shorter = np.searchsorted(_BOUNDS, np.maximum(self.size - edits(self.size), 1), side="right")
        found: tuple[list, list] = ([], [])
        for c in np.unique(kind[which]).tolist():
            for probed in (c, c - 1):
                own = np.flatnonzero(which & (kind == c) & (shorter <= probed))
                k = int(edits(int(_BOUNDS[probed]) - 1)) if probed else 0
                if not len(own) or not probed or _BOUNDS[probed - 1] <= k:
                    continue
                for line, key, index in self._class_keys(own, probed, k, total, down):
                    found[0 if index and probed == c else 1].append((own[line], key))
        return tuple(_lists(f, len(self.size)) for f in found)

    def _class_keys(self, own: np.ndarray, c: int, k: int, total: np.ndarray, down: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Lines (places in ``own``), keys, and whether these are the segments as they stand."""
        s = int(_BOUNDS[c - 1]) // (k + 1)
        segments = [(side, i) for side, parts in ((0, (k + 2) // 2), (1, (k + 1) // 2)) for i in range(parts)]
        if k <= NUMBERED:
            last = self.size[own] - s
            for side, i in segments:
                wide = min(1 + s // 2, max(1, 3 * i))
                gram = s - wide + 1
                # Grams from the first of the substring moved by -i to the last of that moved by i; what would stand beyond the line is another key at most.
                at = (i * s if side == 0 else last - i * s) + np.arange(-i, i + wide)[:, None]
                at = np.clip(at, 0, last + wide - 1) + self.start[own]
                low, w = _mixed((total.take(at + gram) - total.take(at)) * down.take(at), c), 1
                while 2 * w <= wide:
                    low, w = np.minimum(low[:-w], low[w:]), 2 * w
                if wide > w:
                    low = np.minimum(low[: w - wide], low[wide - w :])
                yield np.arange(len(own)), _numbered(low[i], 2 * i + side), True
                if i:
                    new = low != low[i]
                    new[1:] &= low[1:] != low[:-1]
                    yield np.nonzero(new)[1], _numbered(low[new], 2 * i + side), False
            return
        low, begin, last = self._smallest(own, s, c, total, down)
        n = self.size[own] - (s - s // 2) + 1
        for side, i in segments:
            yield np.arange(len(own)), _numbered(low[begin + (i * s if side == 0 else last - i * s)], 0), True
        inside = np.arange(len(low)) - np.repeat(begin, n)[: len(low)] <= np.repeat(last, n)[: len(low)]
        new = inside & np.append(True, low[1:] != low[:-1])
        yield np.repeat(np.arange(len(own)), n)[: len(low)][new], _numbered(low[new], 0), False

    def _hashed(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of all characters so far, each times its power of the prime, and the powers of its inverse."""
        up, down = _POWERS.upto(len(self.cp) + 1)
        total = np.zeros(len(self.cp) + 1, np.uint64)
        np.multiply(self.cp, up[: len(self.cp)], out=total[1:])
        return np.cumsum(total, out=total), down

    def fine_keys(self, edits: Callable = most_edits) -> tuple[pa.Array, pa.Array]:
        """Keys of twice as many segments as above, and of all substrings of their length.

        A line with ``k`` edits leaves ``k + 2`` of ``2 k + 2`` segments unchanged: of any ``k + 1`` of them at least one.
        """
        total, down = self._hashed()
        kind = np.searchsorted(_BOUNDS, self.size, side="right")
        shorter = np.searchsorted(_BOUNDS, np.maximum(self.size - edits(self.size), 1), side="right")
        found: tuple[list, list] = ([], [])
        for c in np.unique(kind).tolist():
            for probed in (c, c - 1):
                own = np.flatnonzero((kind == c) & (shorter <= probed))
                k = int(edits(int(_BOUNDS[probed]) - 1)) if probed else 0
                if not len(own) or not probed or _BOUNDS[probed - 1] < 2 * k + 2:
                    continue
                s = int(_BOUNDS[probed - 1]) // (2 * k + 2)
                low, begin, last = self._smallest(own, s, probed, total, down)
                if probed == c:
                    for i in range(2 * k + 2):
                        found[0].append((own, _numbered(low[begin + i * s], 0)))
                n = last + 1 + s // 2
                of = np.repeat(np.arange(len(own)), n)[: len(low)]
                inside = np.arange(len(low)) - begin[of] <= last[of]
                new = inside & np.append(True, low[1:] != low[:-1])
                new[begin] = True
                found[1].append((own[of[new]], _numbered(low[new], 0)))
        return tuple(_lists(f, len(self.size)) for f in found)

    def _smallest(self, own: np.ndarray, s: int, salt: int, total: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each substring of ``s`` characters of the lines ``own`` the hash of its smallest gram; where each line's begin, and its last one."""
        gram, wide = s - s // 2, 1 + s // 2
        size = self.size[own]
        n = size - gram + 1
        begin = np.cumsum(n) - n
        at = np.repeat(self.start[own] - begin, n) + np.arange(int(n.sum()))
        low, w = _mixed((total[at + gram] - total[at]) * down[at], salt), 1
        while 2 * w <= wide:
            low, w = np.minimum(low[: len(low) - w], low[w:]), 2 * w
        return np.minimum(low[: len(low) - (wide - w)], low[wide - w :]), begin, size - s


def _numbered(h: np.ndarray, number: int) -> np.ndarray:
    return (h ^ np.uint64(number * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.int64)


def _lists(found: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.Array:
    """The keys of each of ``n`` lines."""
    line = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    key = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    order = np.argsort(line, kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(line, minlength=n)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[order]))


def _alike(a: str, b: str) -> int:
    """Characters at the start that both have."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _ends(a: str, b: str) -> tuple[int, int]:
    """Characters that both start with, and those that both end with after these: they take no edits."""
    head = _alike(a, b)
    return head, _alike(a[head:][::-1], b[head:][::-1])


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: bit-parallel over the band around the diagonal."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    head, tail = _ends(a, b)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(b) <= edits:
        return True
    if len(a) < edits:  # shorter than the band is wide
        row = list(range(len(a) + 1))
        for j, c in enumerate(b):
            last, row[0] = row[0], j + 1
            for i, x in enumerate(a):
                last, row[i + 1] = row[i + 1], min(row[i] + 1, row[i + 1] + 1, last + (c != x))
        return row[-1] <= edits
    # Bit r of the band at column j is row j - edits + r of the matrix; rows are characters of a.
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << (i + edits)
    plus, minus, at = full ^ ((1 << edits) - 1), 0, edits
    mark = top
    for j, c in enumerate(b):
        same = where.get(c, 0) >> j & full
        zero = (((same & plus) + plus) ^ plus | same | minus) & full
        right, left = minus | full & ~(zero | plus), zero & plus
        if j + edits < len(a):
            at += not zero & top
        else:
            mark >>= 1
            at += bool(right & mark) - bool(left & mark)
        if at > 3 * edits:  # nothing in the band can be as low as allowed
            return False
        plus, minus = left | full & ~(zero >> 1 | right), zero >> 1 & right
    return at <= edits


def within_all(ones: list[str], others: list[str], edits: list[int]) -> np.ndarray:
    """``within`` of many pairs, side by side where the band fits a word and the lines are longer than it is wide."""
    out = np.zeros(len(ones), bool)
    ones, others, own = list(ones), list(others), []
    for i, (x, y, k) in enumerate(zip(ones, others, edits, strict=True)):
        if abs(len(x) - len(y)) > k:
            continue
        head, tail = _ends(x, y)
        n = min(len(x), len(y))
        if max(len(x), len(y)) - head - tail <= k:
            out[i] = True
        elif k > WIDEST or n < k:
            out[i] = within(x, y, k)
        else:  # what is left is as long as the band is wide at least
            head = min(head, n - k)
            tail = min(tail, n - k - head)
            ones[i], others[i] = x[head : len(x) - tail], y[head : len(y) - tail]
            own.append(i)
    words = [2 * k // 64 for k in edits]
    own.sort(key=lambda i: (words[i], -max(len(ones[i]), len(others[i]))))
    at = 0
    while at < len(own):
        most = max(1, AT_A_TIME * 4 // (len(max(ones[own[at]], others[own[at]], key=len)) + 63))
        some = [i for i in own[at : at + most] if words[i] == words[own[at]]]
        out[some] = _side_by_side([ones[i] for i in some], [others[i] for i in some], np.array([edits[i] for i in some]))
        at += len(some)
    return out


def _bits(n: np.ndarray, words: int) -> np.ndarray:
    """For each of some numbers a row of words, here a column, with so many of the lowest bits set."""
    left = np.clip(n - 64 * np.arange(words)[:, None], 0, 64).astype(np.uint64)
    return np.where(left == 64, ~np.uint64(0), (np.uint64(1) << left % np.uint64(64)) - np.uint64(1))


def _halved(x: np.ndarray) -> np.ndarray:
    out = x >> np.uint64(1)
    out[:-1] |= x[1:] << np.uint64(63)
    return out


def _side_by_side(ones: list[str], others: list[str], edits: np.ndarray) -> np.ndarray:
    """One band for each pair, as in ``within``, of its own width, in as many words as the widest takes; the pairs with the longest line first."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(ones, others, strict=True)]
    n, m = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    widest = 2 * int(edits.max()) + 1
    words = -(-widest // 64)
    a = np.full((len(pairs), int(m.max()) + widest), 0xFFFFFFFF, np.uint32)  # no character
    b = np.zeros((len(pairs), int(m.max())), np.uint32)
    for i, ((x, y), k) in enumerate(zip(pairs, edits.tolist(), strict=True)):
        a[i, k : k + len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
        b[i, : len(y)] = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), np.uint32)
    full = _bits(2 * edits + 1, words)
    top = full ^ _bits(2 * edits, words)
    good, live = np.zeros(len(pairs), bool), np.arange(len(pairs))
    plus, minus = full ^ _bits(edits, words), np.zeros_like(full)
    at, mark = edits.copy(), top.copy()
    for j in range(int(m.max())):
        over = m <= j
        if over.any() or j % 16 == 15:
            good[live[over]] = (at <= edits)[over]
            stay = ~over & (at <= 3 * edits)  # beyond it nothing in the band can be as low as allowed
            if not stay.all():
                live, a, b, n, m, at, edits = (v[stay] for v in (live, a, b, n, m, at, edits))
                plus, minus, mark, top, full = (v[:, stay] for v in (plus, minus, mark, top, full))
            if not len(live):
                return good
        packed = np.packbits(a[:, j : j + widest] == b[:, j : j + 1], axis=1, bitorder="little")
        bits = np.zeros((len(live), 8 * words), np.uint8)
        bits[:, : packed.shape[1]] = packed
        same = bits.view("<u8").T & full
        both = same & plus
        total = both + plus
        for w in range(1, words):
            # Carries of the word below, whose own carry is in already.
            carry = (both[w - 1] & plus[w - 1] | (both[w - 1] | plus[w - 1]) & ~total[w - 1]) >> np.uint64(63)
            total[w] += carry
        zero = (total ^ plus | same | minus) & full
        right, left = minus | full & ~(zero | plus), zero & plus
        inside = j + edits < n
        mark = np.where(inside, mark, _halved(mark))
        at = at + np.where(inside, (zero & top == 0).all(axis=0).astype(np.int64), (right & mark != 0).any(axis=0).astype(np.int64) - (left & mark != 0).any(axis=0))
        down = _halved(zero)
        plus, minus = left | full & ~(down | right), down & right
    good[live] = at <= edits
    return good


def _texts(column: pa.Array, at_a_time: int = AT_A_TIME) -> Iterator[tuple[int, list[str]]]:
    """First row and texts, null as empty, about so many characters at a time."""
    out, size, first = [], 0, 0
    for i, text in enumerate(column):
        out.append(text.as_py() or "")
        size += len(out[-1])
        if size > at_a_time or i + 1 == len(column):
            yield first, out
            out, size, first = [], 0, i + 1


def _occurrences(docs: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """``doc, lid, check, size, sig1, sig2`` of every line that is not blank."""
    schema = pa.schema([("doc", pa.int64()), ("lid", pa.int64()), ("check", pa.int64()), ("size", pa.int32()), ("sig1", pa.int64()), ("sig2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for first, texts in _texts(batch.column(1)):
                x = Lines(texts, clashing)
                if len(x.lid):
                    arrays = [pa.array(a) for a in (doc[first + x.text], x.lid, x.check, x.size.astype(np.int32), *x.signature())]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)
            give_back()

    return docs.select(row_key().alias("doc"), "text").mapInArrow(run, "doc long, lid long, check long, size int, sig1 long, sig2 long")


def dealt(held: list[tuple[np.ndarray, np.ndarray]], buckets: int, short: bool = False) -> pa.RecordBatch:
    """``DEALT`` rows of keys and what has them. A key's bucket is told by its own bits, so all of a key meet.

    Of a ``short`` key a row has four bytes beside its bucket: of as many keys as fit the buckets about one in 17,000 meets another one.
    """
    key, lid = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    key = key.view(np.uint64) >> np.uint64(33 - buckets.bit_length() if short else 0)
    bucket = (key % np.uint64(buckets)).astype(np.int32)
    key = (key // np.uint64(buckets)).astype(np.uint32) if short else key
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    used, starts = np.unique(bucket[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    blobs = [pa.array([v[a:z].tobytes() for a, z in zip(starts, ends, strict=True)], pa.binary()) for v in (key[order], lid[order])]
    return pa.RecordBatch.from_arrays([pa.array(used), *blobs], names=["bucket", "keys", "lids"])


def _dealt_keys(docs: DataFrame, clashing: frozenset[int], buckets: int) -> DataFrame:
    """``bucket, keys, lids``: the keys of lines of ``LEAST_CHARS`` or more where a task first meets them, many in a row.

    Keys are short ones (``dealt``), of lines' ids all eight bytes are there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(0, np.int64)
        held, n = [], 0
        for batch in batches:
            for _, texts in _texts(batch.column(0), KEYED_AT_A_TIME):
                x = Lines(texts, clashing)
                lid, first = np.unique(x.lid, return_index=True)
                at = np.searchsorted(met, lid)
                first = first[(x.size[first] >= LEAST_CHARS) & (np.append(met, 0)[at] != lid)]
                if not len(first):
                    continue
                new = np.zeros(len(x.lid), bool)
                new[first] = True
                lid = x.lid[first]
                met = np.insert(met, np.searchsorted(met, lid), lid) if len(met) < MOST_MET else lid  # keys again, which only costs time
                for lists in x.keys(new):
                    of = np.repeat(x.lid, np.diff(lists.offsets.to_numpy()))
                    held.append((lists.values.to_numpy(), of))
                    n += len(of)
                if n >= KEYS_HELD:
                    yield dealt(held, buckets, short=True)
                    held, n = [], 0
        if held:
            yield dealt(held, buckets, short=True)
        del held, met
        give_back()

    return docs.select("text").mapInArrow(run, DEALT)


class _Met:
    """Which line each key of a bucket was first met with; keys met with another one come out, that first line included."""

    def __init__(self):
        self.key = self.lid = np.zeros(0, np.int64)
        self.told = np.zeros(0, bool)

    def add(self, key: np.ndarray, lid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        key, lid = key[order], lid[order]
        begins = np.append(True, key[1:] != key[:-1])
        heads = np.flatnonzero(begins)
        own = np.searchsorted(self.key, key[heads])
        known = np.zeros(len(heads), bool)
        inside = own < len(self.key)
        known[inside] = self.key[own[inside]] == key[heads[inside]]
        first = lid[heads].copy()
        first[known] = self.lid[own[known]]
        group = np.cumsum(begins) - 1
        other = lid != first[group]
        shared = np.zeros(len(heads), bool)
        shared[group[other]] = True
        told = np.zeros(len(heads), bool)
        told[known] = self.told[own[known]]
        late = shared & ~told
        out = np.concatenate([key[other], key[heads[late]]]), np.concatenate([lid[other], first[late]])
        self.told[own[known]] |= shared[known]
        new = ~known
        at = own[new]
        self.key, self.lid, self.told = np.insert(self.key, at, key[heads[new]]), np.insert(self.lid, at, first[new]), np.insert(self.told, at, shared[new])
        return out


def met_again(packed: DataFrame, buckets: int = 0) -> DataFrame:
    """``key, lid`` of the keys that several distinct lines have. A task holds each of its keys once, however many lines have it.

    Short keys are those of so many ``buckets``.
    """
    schema = pa.schema([("key", pa.int64()), ("lid", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, _Met] = {}
        held: dict[int, list] = {}

        def told(bucket: int) -> pa.RecordBatch:
            key, lid = (np.concatenate(v) for v in zip(*held.pop(bucket), strict=True))
            found = met.setdefault(bucket, _Met()).add(key, lid)
            return pa.RecordBatch.from_arrays([pa.array(f) for f in found], schema=schema)

        for batch in batches:
            for bucket, keys, lids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                own = held.setdefault(bucket, [])
                key = np.frombuffer(keys.as_buffer(), np.uint32).astype(np.int64) * buckets + bucket if buckets else np.frombuffer(keys.as_buffer(), np.int64)
                own.append((key, np.frombuffer(lids.as_buffer(), np.int64)))
                if sum(len(k) for k, _ in own) >= KEYS_HELD:
                    yield told(bucket)
        for bucket in list(held):
            yield told(bucket)
            met.pop(bucket)
        give_back()

    return packed.mapInArrow(run, "key long, lid long")


@contextlib.contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """Python workers get fewer rows at once: here rows are whole texts."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(BATCH, int(before)) if int(before) > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def _small(df: DataFrame) -> DataFrame:
    """A spooled table, marked for broadcast only if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _shared_keys(plain: DataFrame, distinct: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """``key, lid, n, size, sig1, sig2, times`` of keys that several distinct lines have, ``n`` of them; spooled.

    Most keys are one line's only: these go in the one shuffle that all keys take, packed by the thousand. There are as many
    buckets as hold ``KEYS_HELD`` keys each, told by the characters of all distinct lines.
    """
    chars = distinct.where(F.col("size") >= LEAST_CHARS).agg(F.sum("size")).first()[0] or 0
    buckets = max(plain.sparkSession.sparkContext.defaultParallelism, int(chars // (CHARS_A_KEY * KEYS_HELD)) + 1)
    packed = _dealt_keys(plain, clashing, buckets)
    met = met_again(packed.repartition(buckets, "bucket"), buckets).repartition("key").distinct()
    shared = spool(met.withColumn("n", F.count("*").over(Window.partitionBy("key"))))
    out = spool(shared.join(distinct.select("lid", "size", "sig1", "sig2", "times"), "lid"))
    drop_spool(shared)
    return out


def _off(a: str, b: str) -> Column:
    """By how much two lines' character counts differ in all, each class modulo 256; four classes at a time, 16 bits each."""
    lanes = F.lit(0).cast("long")
    for sig in ("sig1", "sig2"):
        for at in (0, 8):
            x, y = (F.shiftrightunsigned(f"{p}_{sig}", at).bitwiseAND(F.lit(0x00FF00FF00FF00FF)) for p in (a, b))
            d = (x.bitwiseOR(F.lit(0x0100010001000100)) - y).bitwiseAND(F.lit(0x00FF00FF00FF00FF))
            half = F.shiftrightunsigned(d, 7).bitwiseAND(F.lit(0x0001000100010001))
            lanes = lanes + d.bitwiseXOR(F.shiftleft(half, 8) - half) + half  # 256 less the difference where that is nearer
    return sum((F.shiftrightunsigned(lanes, at).bitwiseAND(F.lit(0xFFFF)) for at in (16, 32, 48)), lanes.bitwiseAND(F.lit(0xFFFF)))


def _edits(a: str, b: str) -> Column:
    return F.lit(1) + F.floor(F.least(F.col(f"{a}_size"), F.col(f"{b}_size")) / CHARS_AN_EDIT)


def _close_ones(both: DataFrame) -> DataFrame:
    """``a, b`` once, where they may be close by their character counts. Every edit changes these by two at most."""
    x, y = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    off = both.groupBy(x, y).agg(F.min(_off("a", "b")).alias("off"), F.min(_edits("a", "b")).alias("edits"))
    return off.where(F.col("off") <= 2 * F.col("edits")).select("a", "b")


def _near_length(a: str, b: str) -> Column:
    return F.abs(F.col(f"{b}_size") - F.col(f"{a}_size")) <= _edits(a, b)


def _pairs(held: DataFrame, apart: Column | bool = True) -> DataFrame:
    """``a, b`` of close lines that share a key."""
    pick = lambda p: held.select("key", *[F.col(c).alias(p if c == "lid" else f"{p}_{c}") for c in held.columns if c not in ("key", "n", "times")])
    return _close_ones(pick("a").join(pick("b"), "key").where((F.col("a") < F.col("b")) & _near_length("a", "b") & apart))


def _linked(held: DataFrame, plain: DataFrame, distinct: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """Edges between lines within the edits allowed that connect all such.

    Under keys of more than ``FEW`` lines these are first compared with the one that stands most often, which near copies
    are mostly made from. Of those that did not connect this way, pairs are made where the key has no more than
    ``PAIRWISE`` lines. Lines that larger keys hold together are a family: up to ``FAMILY`` lines are compared block by
    block, two blocks a task. In a larger one mostly chains of keys hold lines together that have none in common: there only
    lines of one key are compared, likewise; those of a key of more than ``KEYED`` are looked up once more by the rarest of
    twice as many segments.
    """
    few = _pairs(held.where(F.col("n") <= FEW))
    many = spool(held.where(F.col("n") > FEW))
    facts = ["lid", "size", "sig1", "sig2"]
    top = many.groupBy("key").agg(F.min(F.struct((-F.col("times")).alias("rank"), *facts)).alias("h")).select("key", *[F.col(f"h.{c}").alias("b" if c == "lid" else f"b_{c}") for c in facts])
    stars = many.select("key", *[F.col(c).alias("a" if c == "lid" else f"a_{c}") for c in facts]).join(top, "key").where((F.col("a") != F.col("b")) & _near_length("a", "b"))
    first = spool(few.unionByName(_close_ones(stars)).distinct())
    edges = _verified(first, plain, distinct, clashing)
    part = connected_components(edges)
    parts = many.join(part, many.lid == part.node, "left").select("key", "n", *facts, F.coalesce("component", "lid").alias("part"))
    apart = parts.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key")
    parts = spool(parts.join(apart, "key", "left_semi"))
    rest = _pairs(parts.where(F.col("n") <= PAIRWISE), F.col("a_part") != F.col("b_part"))
    more = _verified(spool(rest.join(first, ["a", "b"], "left_anti")), plain, distinct, clashing)
    hot = parts.where(F.col("n") > PAIRWISE)
    if hot.isEmpty():
        return edges.unionByName(more)
    held_by = hot.join(hot.groupBy("key").agg(F.min("lid").alias("b")), "key").select(F.col("lid").alias("a"), "b")
    family = connected_components(held_by)
    family = spool(family.join(family.groupBy("component").agg(F.count("*").alias("members")), "component"))
    hot = spool(hot.drop("n").join(family, F.col("lid") == F.col("node")).drop("node"))
    groups = hot.where(F.col("members") <= FAMILY).select("component", "members", "lid", "part", F.array().cast("array<long>").alias("keys")).distinct()
    large = hot.where(F.col("members") > FAMILY).drop("component", "members")
    if large.isEmpty():
        return edges.unionByName(more).unionByName(_group_links(groups, plain, distinct, clashing))
    keyed = spool(_one_key_each(large))
    groups = groups.unionByName(_by_key(keyed.where(F.col("members") <= KEYED)))
    out = edges.unionByName(more).unionByName(_group_links(groups, plain, distinct, clashing))
    rest = keyed.where(F.col("members") > KEYED).select(*facts, "part").distinct()
    if rest.isEmpty():
        return out
    return out.unionByName(_verified(spool(_rare_pairs(spool(rest), plain, distinct, clashing)), plain, distinct, clashing))


def _one_key_each(hot: DataFrame) -> DataFrame:
    """``hot`` with ``members``, the lines of a key, and of keys that the same lines have only the smallest; sets are told by 128 bits."""
    sets = hot.groupBy("key").agg(F.count("*").alias("members"), F.bit_xor("lid").alias("x"), F.bit_xor(F.xxhash64("lid")).alias("y"))
    return hot.join(sets.groupBy("members", "x", "y").agg(F.min("key").alias("key")).select("key", "members"), "key")


def _by_key(keyed: DataFrame) -> DataFrame:
    """Groups as ``_group_links`` takes them, one for each key; a line is in several."""
    keys = keyed.groupBy("lid").agg(F.collect_list("key").alias("keys"))
    return keyed.join(keys, "lid").select(F.col("key").alias("component"), "members", "lid", "part", "keys")


def _group_links(groups: DataFrame, plain: DataFrame, distinct: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """Edges ``a, b`` within groups (``component``, of ``members`` lines) between lines that are in different parts so far.

    Pairs are looked at inside the tasks and never rows; of those that links found before connect, none is. Where groups are
    those of keys (``keys`` has all of a line's), a pair is looked at under the smallest that both have.
    """
    texts = _line_texts(plain, distinct.join(groups.select("lid").distinct(), "lid").select("doc", "lid"), clashing)
    few, many = (F.ceil(F.col("members") / n) for n in (BLOCK, 8 * BLOCK))
    own = groups.withColumn("blocks", F.greatest(F.least(few, F.lit(BLOCKS)), many).cast("int")).join(texts, "lid").withColumn("block", F.pmod(F.xxhash64("lid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = own.withColumn("other", other).select((F.size("keys") > 0).alias("keyed"), "component", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "lid", "part", "keys", "line")

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("lid")
        lids, text, block = x["lid"].to_numpy(), x["line"].tolist(), x["block"].to_numpy()
        key = x["component"].iloc[0] if x["keyed"].iloc[0] else None
        keys = [frozenset(k.tolist()) for k in x["keys"]]
        label = np.unique(x["part"].to_numpy(), return_inverse=True)[1]
        size = np.array([len(t) for t in text])
        counts = np.stack([np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64) for t in text]).astype(np.int32)
        found: tuple[list, list] = ([], [])

        def look(i: np.ndarray, j: np.ndarray) -> None:
            new = label[i] != label[j]
            if key is not None:
                new[new] = [min(keys[p] & keys[q]) == key for p, q in zip(i[new].tolist(), j[new].tolist(), strict=True)]
            i, j = i[new], j[new]
            good = within_all([text[k] for k in i], [text[k] for k in j], most_edits(np.minimum(size[i], size[j])).tolist())
            for p, q in zip(i[good].tolist(), j[good].tolist(), strict=True):
                if label[p] != label[q]:
                    found[0].append(lids[p])
                    found[1].append(lids[q])
                    label[label == label[q]] = label[p]

        held, n, apart = [], 0, x["one"].iloc[0] != x["two"].iloc[0]
        for i in range(len(text)):
            j = np.arange(i + 1, len(text))
            bound = most_edits(np.minimum(size[i], size[j]))
            near = (np.abs(size[j] - size[i]) <= bound) & (label[j] != label[i]) & ((block[j] != block[i]) | (not apart))
            j, bound = j[near], bound[near]
            j = j[np.abs(counts[j] - counts[i]).sum(axis=1) <= 2 * bound]
            held.append((np.full(len(j), i), j))
            n += len(j)
            if n >= PAIRS:
                look(*(np.concatenate(v) for v in zip(*held, strict=True)))
                held, n = [], 0
        if n:
            look(*(np.concatenate(v) for v in zip(*held, strict=True)))
        return pd.DataFrame({"a": np.array(found[0], np.int64), "b": np.array(found[1], np.int64)})

    # Bytes don't tell how long a task takes: its partitions are not put together.
    dealt = dealt.repartition(8 * groups.sparkSession.sparkContext.defaultParallelism, "keyed", "component", "one", "two")
    return spool(dealt.groupBy("keyed", "component", "one", "two").applyInPandas(compare, "a long, b long"))


def _rare_pairs(hot: DataFrame, plain: DataFrame, distinct: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """``a, b`` of close lines of ``hot`` in different parts that share one of the rarest half of one's fine segments.

    Lines that have a common passage, and so common keys, are told apart by what else they hold.
    """
    keys = pa.list_(pa.int64())
    schema = pa.schema([("lid", pa.int64()), ("own", keys), ("more", keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lids = batch.column(0).to_numpy()
            for first, texts in _texts(batch.column(1)):
                x = Lines(texts)
                yield pa.RecordBatch.from_arrays([pa.array(lids[first + x.text]), *x.fine_keys()], schema=schema)

    texts = _line_texts(plain, distinct.join(hot.select("lid"), "lid").select("doc", "lid"), clashing)
    fine = spool(texts.select("lid", "line").mapInArrow(run, "lid long, own array<long>, more array<long>"))
    index = fine.select("lid", (F.size("own") / 2).alias("half"), F.posexplode("own").alias("i", "key"))
    often = index.groupBy("key").agg(F.count_distinct("lid").alias("often"))
    nth = F.row_number().over(Window.partitionBy("lid").orderBy("often", "i"))
    rare = index.join(often, "key").withColumn("nth", nth).where(F.col("nth") <= F.col("half")).select("lid", "key").distinct()
    probe = fine.select("lid", F.explode("more").alias("key")).distinct()
    side = lambda p: hot.select(*[F.col(c).alias(p if c == "lid" else f"{p}_{c}") for c in hot.columns])
    met = rare.withColumnRenamed("lid", "a").join(probe.withColumnRenamed("lid", "b"), "key").where("a <> b").select("a", "b").distinct()
    both = met.join(side("a"), "a").join(side("b"), "b").where((F.col("a_part") != F.col("b_part")) & _near_length("a", "b"))
    return _close_ones(both)


def _line_texts(docs: DataFrame, wanted: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """``lid, line`` (normal form) for the lines wanted: ``doc`` where one stands and ``lid``."""
    per_doc = spool(wanted.groupBy("doc").agg(F.collect_set("lid").alias("lids")))
    schema = pa.schema([("lid", pa.int64()), ("line", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _texts(batch.column(0)):
                x, asked = Lines(texts, clashing), batch.column(1).slice(first, len(texts))
                lid, of = asked.flatten().to_numpy(), np.repeat(np.arange(len(texts)), np.diff(asked.offsets.to_numpy()))
                open_ = set(zip(of.tolist(), lid.tolist(), strict=True))
                lids, lines = [], []
                for i in np.flatnonzero(np.isin(x.lid, lid)).tolist():
                    if (at := (int(x.text[i]), int(x.lid[i]))) in open_:
                        open_.discard(at)
                        lids.append(at[1])
                        lines.append(x.cp[x.start[i] : x.end[i]].tobytes().decode("utf-32-le"))
                yield pa.RecordBatch.from_arrays([pa.array(lids, pa.int64()), pa.array(lines, pa.string())], schema=schema)

    found = docs.select(row_key().alias("doc"), "text").join(_small(per_doc), "doc").select("text", "lids")
    return found.mapInArrow(run, "lid long, line string").dropDuplicates(["lid"])


def _verified(pairs: DataFrame, plain: DataFrame, distinct: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """The pairs (a spooled table) whose edit distance is no more than allowed."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = within_all(one, two, [most_edits(min(len(x), len(y))) for x, y in zip(one, two, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_())), batch.column(1).filter(pa.array(good, pa.bool_()))], schema=schema)

    asked = pairs.select(F.explode(F.array("a", "b")).alias("lid")).distinct()
    texts = spool(_line_texts(plain, distinct.join(asked, "lid").select("doc", "lid"), clashing))
    one = texts.select(F.col("lid").alias("a"), F.col("line").alias("la"))
    two = texts.select(F.col("lid").alias("b"), F.col("line").alias("lb"))
    # Dealt out evenly: bytes don't tell how long pairs take. A task takes enough of them to look at many side by side.
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "la", "lb").repartition(pairs.count() // PAIRS_A_TASK + 1)
    return spool(both.mapInArrow(run, "a long, b long"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id, text`` and more) with the lines taken out that stand, or nearly stand, earlier.

    Lines are compared in normal form (A-Z in lower case). Two of ``LEAST_CHARS`` characters or more are linked if
    their edit distance is at most ``most_edits`` of the shorter one; shorter lines only if they are equal; classes
    are what links connect. Of a class the first line of the document with the smallest ``doc_id`` stays, and of a
    short line all that this document has. Blank lines stay. Columns ``n_lines`` and ``n_dropped`` are added (replaced if
    there). A null text stays null with 0 lines. Rows with one ``doc_id`` count as one document; a row without one
    comes last and goes by its text. Rows are never taken out here. Equal lines are told by a 128-bit digest.

    The texts are read four times: for lines, for their keys, for the few lines to verify, and to be cut; they are shuffled once.
    """
    docs = docs.drop("n_lines", "n_dropped")
    plain = docs.withColumn("text", F.col("text").cast("string"))
    with scratch(docs.sparkSession) as keep, _short_batches(docs.sparkSession):
        seen, distinct, clashing = _seen(plain)
        nodes = connected_components(_linked(_shared_keys(plain, distinct, clashing), plain, distinct, clashing))
        classes = spool(distinct.select("lid", "doc", "again").join(nodes, distinct.lid == nodes.node, "left").where("again or component is not null"))
        classes = classes.select("lid", "doc", F.coalesce("component", "lid").alias("class"))
        owners = classes.groupBy("class").agg(F.min("doc").alias("owner"))
        known = spool(classes.join(owners, "class").select("lid", "class", "owner"))
        marks = keep(seen.select("doc", "lid").join(known, "lid").groupBy("doc").agg(F.collect_set(F.struct("lid", "class", (F.col("doc") == F.col("owner")).alias("own"))).alias("marks")))
    return _cut(plain, marks, clashing)


def _seen(plain: DataFrame) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """All lines, one row for each distinct one, and the 64-bit ids that two different lines would share.

    Of lines with such an id the other half of the 128-bit digest is the id instead. Of 10^12 distinct lines about
    27,000 ids are so; they come to the driver.
    """
    clashing: frozenset[int] = frozenset()
    while True:
        seen = spool(_occurrences(plain, clashing))
        facts = [F.min("doc").alias("doc"), (F.min("doc") < F.max("doc")).alias("again"), F.max("size").alias("size"), F.max("sig1").alias("sig1"), F.max("sig2").alias("sig2"), F.count("*").alias("times"), F.min("check").alias("low"), F.max("check").alias("high")]
        distinct = spool(seen.groupBy("lid").agg(*facts))
        more = [r["lid"] for r in distinct.where("low <> high").select("lid").collect()]
        if not more:
            return seen, distinct, clashing
        clashing |= frozenset(more)


def _cut(docs: DataFrame, marks: DataFrame, clashing: frozenset[int]) -> DataFrame:
    names, at = docs.columns, docs.columns.index("text")
    rows = docs.select(row_key().alias("key"), F.struct("*").alias("row")).join(_small(marks), F.col("key") == F.col("doc"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n, gone = [], [], []
            columns = batch.column(0).flatten()
            for first, texts in _texts(columns[at]):
                kept, dropped = _kept_lines(texts, batch.column(1).slice(first, len(texts)), clashing)
                there = columns[at].slice(first, len(texts)).is_valid().to_pylist()
                out += [k if t else None for k, t in zip(kept, there, strict=True)]
                n += [text.count("\n") + 1 if t else 0 for text, t in zip(texts, there, strict=True)]
                gone += dropped
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "n_lines", "n_dropped"])
            del out, columns
            give_back()

    return rows.select("row", "marks").mapInArrow(run, T.StructType([*docs.schema, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))


def _repeats(text: str) -> bool:
    """Whether a line that is not empty stands twice in a text, but for the case of A-Z."""
    lines = [line for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n") if line]
    return len(set(lines)) < len(lines)


def _kept_lines(texts: list[str], marks: pa.ListArray, clashing: frozenset[int]) -> tuple[list[str], list[int]]:
    """What stays of each text, and how many lines go."""
    known: list[dict] = [{m["lid"]: m for m in own or ()} for own in marks.to_pylist()]
    out, gone = list(texts), [0] * len(texts)
    some = [i for i, text in enumerate(texts) if known[i] or _repeats(text)]
    x = Lines([texts[i] for i in some], clashing)
    ends = np.searchsorted(x.text, np.arange(len(some) + 1)).tolist()
    for i, a, z in zip(some, ends, ends[1:], strict=False):
        used, drop = set(), set()
        for lid, nth, size in zip(x.lid[a:z].tolist(), x.nth[a:z].tolist(), x.size[a:z].tolist(), strict=True):
            m = known[i].get(lid)
            one = m["class"] if m else lid
            if m and not m["own"] or one in used and size >= LEAST_CHARS:
                drop.add(nth)
            used.add(one)
        if drop:
            out[i], gone[i] = "\n".join(v for j, v in enumerate(texts[i].split("\n")) if j not in drop), len(drop)
    return out, gone


def dedup_documents(docs: DataFrame) -> DataFrame:
    """``dedup_lines`` as a stage: the columns of ``docs``, ``n_chars`` brought up to date, and no document whose words all went."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    cut = dedup_lines(docs.select("doc_id", "text", own)).where((F.col("n_dropped") == 0) | F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    columns = {c: F.col("text") if c == "text" else F.col("row")[c] for c in docs.columns}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return cut.select(*[v.alias(c) for c, v in columns.items()])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, those dropped, and the SHA-256 of what stays."""
    cut = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
