"""Byte-level BPE by forced boundaries.

A byte pair that stands inside no token of the vocabulary can never be merged across: wherever it occurs in a
word there is a certain cut. Words are cut there, the fragments are encoded independently and the ids put
together again. The merges of many fragments run side by side, a round at a time, in arrays.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Splits a text into words before any merge (fixed by the vocabulary).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of text whose ids a task keeps at most; beyond it starts afresh, which only costs time.
MOST_KEPT = 400_000
#: Characters encoded together.
AT_A_TIME = 500_000
#: Bytes of a fragment beyond which its pairs go on a heap.
LONG = 4096


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBpe:
    """Encoder and decoder for one byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        pairs = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        self.tokens = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.tokens[i] = t
        self.first = np.array([vocab[bytes([b])] for b in range(256)], np.uint32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        self.ranks = _PairTable(np.array([[vocab[a], vocab[b]] for a, b in pairs], np.uint64))
        self.inside = np.zeros(1 << 16, bool)
        for t in vocab:
            for x, y in zip(t, t[1:], strict=False):
                self.inside[x << 8 | y] = True
        self.words = regex.compile(WORDS).findall
        self.odd = re.compile(r" (?:\s|\Z)").search
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.kept: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self._pieces(t) for t in texts]
        if len(self.kept) > MOST_KEPT:
            self.kept.clear()
        found = [list(map(self.kept.get, own)) for own in pieces]
        new = list({p for own, ids in zip(pieces, found, strict=True) for p, i in zip(own, ids, strict=True) if i is None})
        made = dict(zip(new, self._encode_new(new), strict=True))
        out = [
            b"".join(ids) if None not in ids else b"".join([made[p] if i is None else i for p, i in zip(own, ids, strict=True)])
            for own, ids in zip(pieces, found, strict=True)
        ]
        self.kept |= ((p, i) for p, i in made.items() if len(p) <= 32)  # longer ones hardly come again
        return out

    def _pieces(self, text: str) -> list[str]:
        """The text in pieces between certain word boundaries; special tokens stand alone."""
        if any(x in text for x in self.special):
            return [p for x in self.split(text) if x for p in ([x] if x in self.special else self._pieces(x))]
        # A space before anything but white space always begins a word.
        if self.odd(text):
            return self.words(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def _encode_new(self, pieces: list[str]) -> list[bytes]:
        words = [[] if p in self.special else self.words(p) for p in pieces]
        ids, ends = self._merge([w.encode() for own in words for w in own])
        ends = np.concatenate([[0], ends])[np.cumsum([0, *map(len, words)])].tolist()
        buffer = ids.astype("<u4").tobytes()
        return [
            struct.pack("<I", self.special[p]) if p in self.special else buffer[4 * start : 4 * end]
            for p, start, end in zip(pieces, ends, ends[1:], strict=False)
        ]

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word's end."""
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        if not len(data):
            return np.zeros(0, np.uint32), ends
        # cut[i]: a fragment begins at byte i, because a word does or because no token holds the pair before it.
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.inside[data[:-1].astype(np.int32) << 8 | data[1:]]
        cut[ends[:-1][ends[:-1] < len(data)]] = True
        ids = self.first[data]
        where = np.flatnonzero(cut)
        whole, at = self._merge_fragments(ids, where, np.diff(np.append(where, len(data))))
        return whole, np.searchsorted(at, ends)

    def _merge_fragments(self, ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges every fragment, lowest rank first, a round at a time for all; ids and the bytes they begin at."""
        none = len(self.made)
        real = (length > 1) & (length <= LONG)
        live, single = np.repeat(real, length), np.repeat(length == 1, length)
        done_ids, done_at = [ids[single]], [np.flatnonzero(single)]
        for i in np.flatnonzero(length > LONG).tolist():
            own, places = self._merge_long(ids[start[i] : start[i] + length[i]])
            done_ids.append(own)
            done_at.append(places + start[i])
        ids, at, length = ids[live], np.flatnonzero(live), length[real]
        last = np.cumsum(length) - 1
        rank = np.full(len(ids), none, np.int64)
        rank[:-1] = self.ranks.find(ids[:-1], ids[1:])
        rank[last] = none
        while len(ids):
            first = last - length + 1
            best = np.minimum.reduceat(rank, first)
            over = best == none
            if over.any():
                gone = np.repeat(over, length)
                done_ids.append(ids[gone])
                done_at.append(at[gone])
                ids, at, rank, length, best = ids[~gone], at[~gone], rank[~gone], length[~over], best[~over]
                last = np.cumsum(length) - 1
                if not len(ids):
                    break
                first = last - length + 1
            # All places of the best pair at once, which is the same as from the left: a pair with the token made comes
            # later in the order of merges. In a run of one token every other place is one.
            hits = np.flatnonzero(rank == np.repeat(best, length))
            nth = np.arange(len(hits))
            nth -= np.maximum.accumulate(np.where(np.append(True, hits[1:] != hits[:-1] + 1), nth, 0))
            left = hits[nth % 2 == 0]
            fragment = np.searchsorted(last, left)
            ids[left] = self.made[best[fragment]]
            keep = np.ones(len(ids), bool)
            keep[left + 1] = False
            ids, at, rank = ids[keep], at[keep], rank[keep]
            left -= np.arange(len(left))
            length = length - np.bincount(fragment, minlength=len(length))
            last = np.cumsum(length) - 1
            ends_here = left == last[fragment]
            here = left[~ends_here]
            rank[left[ends_here]] = none
            rank[here] = self.ranks.find(ids[here], ids[here + 1])
            before = left[left > (last - length + 1)[fragment]] - 1
            rank[before] = self.ranks.find(ids[before], ids[before + 1])
        ids, at = np.concatenate(done_ids), np.concatenate(done_at)
        order = np.argsort(at, kind="stable")
        return ids[order], at[order]

    def _merge_long(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One long fragment by a heap of its pairs, in time of n log n: rounds would be as many as its distinct merges."""
        none, own = len(self.made), ids.tolist()
        rank = self.ranks.find(ids[:-1], ids[1:])
        after, before = list(range(1, len(own) + 1)), list(range(-1, len(own) - 1))
        heap = [(r, i, own[i], own[i + 1]) for i, r in enumerate(rank.tolist()) if r < none]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int, j: int) -> None:
            pair = own[i], own[j]
            r = known.get(pair, -1)
            if r < 0:
                r = known[pair] = self.ranks.one(*pair)
            if r < none:
                heapq.heappush(heap, (r, i, own[i], own[j]))

        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if own[i] != x or j == len(own) or own[j] != y:
                continue  # merged meanwhile
            own[i], own[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < len(own):
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        own = np.array(own, np.int64)
        stay = np.flatnonzero(own >= 0)
        return own[stay].astype(np.uint32), stay

    def decode(self, ids: bytes) -> str:
        """The text of the ids; what is no UTF-8 becomes replacement characters."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _PairTable:
    """Rank of a pair of ids, for whole arrays: a two-way hash table that grows until every pair has a place."""

    def __init__(self, pairs: np.ndarray):
        keys, self.none = pairs[:, 0] << np.uint64(32) | pairs[:, 1], len(pairs)
        bits = max(8, int(len(pairs)).bit_length() + 1)
        while True:
            place = self._place(keys, bits)
            order = np.lexsort((np.arange(len(keys)), place))
            depth = np.arange(len(keys)) - np.searchsorted(place[order], place[order])
            if depth.max(initial=0) < 4:
                break
            bits += 1
        self.bits = bits
        self.keys = np.full((4, 1 << bits), np.iinfo(np.uint64).max, np.uint64)
        self.rank = np.full((4, 1 << bits), self.none, np.int64)
        self.keys[depth, place[order]] = keys[order]
        self.rank[depth, place[order]] = order

    @staticmethod
    def _place(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def one(self, a: int, b: int) -> int:
        """Rank of one pair."""
        key = a << 32 | b
        place = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits
        return next((int(self.rank[i, place]) for i in range(4) if int(self.keys[i, place]) == key), self.none)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(32) | b
        place = self._place(keys, self.bits)
        out = np.full(len(keys), self.none, np.int64)
        for own, rank in zip(self.keys, self.rank, strict=True):
            hit = own[place] == keys
            out[hit] = rank[place[hit]]
        return out


_LOADED: dict[str, ForcedBoundaryBpe] = {}


def loaded(path: str) -> ForcedBoundaryBpe:
    """One per worker process."""
    if path not in _LOADED:
        _LOADED[path] = ForcedBoundaryBpe(path)
    return _LOADED[path]


def _some(column: pa.Array) -> Iterator[list[str]]:
    """The texts, null as empty, about ``AT_A_TIME`` characters at a time."""
    out, size = [], 0
    for text in column:
        text = text.as_py() or ""
        out.append(text)
        size += len(text)
        if size > AT_A_TIME:
            yield out
            out, size = [], 0
    if out:
        yield out


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes the ``text`` of every row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    With ``keep_ids`` also ``ids`` (array of int) and ``decoded`` (string). A null text counts as empty, an
    empty text has no ids; repeated rows are encoded as often as they occur; other columns are left out. No
    shuffle: each row is on its own. The vocabulary file must be at ``path`` on every machine.
    """
    path = path or str(public_tokenizers.path("byte_bpe_50k.json"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if keep_ids:
        schema += ", ids array<int>, decoded string"
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    out = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            rows = []
            for texts in _some(batch.column(1)):
                for ids in bpe.encode(texts):
                    back = bpe.decode(ids)
                    row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
                    rows.append(row + ((np.frombuffer(ids, "<i4").tolist(), back) if keep_ids else ()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * (len(fields) - 1)
            arrays = [batch.column(0).cast(pa.int64())] + [pa.array(c, f[1]) for c, f in zip(columns, fields[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    from tidewater.llm.tables import table

    return encode_documents(table(spark, sf_dir, "documents"))
