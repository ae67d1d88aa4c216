"""Phrase collocations from sorted count streams."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewater.llm.tables import table
from tidewater.spool import spool

LONGEST, LEAST, FIRST = 5, 100, 2000
#: Languages up to which a table of them is broadcast; beyond it, it is shuffled.
BROADCAST_ROWS = 20_000
#: Bytes of text whose windows are counted at a time.
SLICE = 4 << 20
#: Windows looked at to deal the stream out evenly (results don't depend on them), and documents they come from, about.
SAMPLE_WINDOWS, SAMPLE_DOCUMENTS = 65_536, 2_000
#: Between words of a window: the lowest byte, so that what starts with the same words stands together. Words hold no tab, so a zero byte of a word is written as one.
GAP, ZERO = b"\x00", b"\x09"


# --- windows ---------------------------------------------------------------------------------------------------------


def _letters():
    """For each byte what it becomes in a window, and its kind: 0 of a word, 1 between words, 2 between pieces."""
    import numpy as np

    own, kind = np.arange(256, dtype=np.uint8), np.zeros(256, np.uint8)
    own[ord("A") : ord("Z") + 1] += 32
    own[0] = ZERO[0]
    kind[[0x20, 0x09]] = 1
    kind[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
    return own, kind


def _slices(texts, size: int, longest: int) -> Iterator[tuple[bytes, int]]:
    """The texts as runs of about ``size`` bytes that end where a piece ends; texts don't meet in a piece.

    A piece that is longer itself is cut between words: then the run ends with some words of the next, whose number comes with it.
    """
    stop, gap = re.compile(rb"[.,;:!?\x0A-\x0D]"), re.compile(rb"[\x20\x09]+")
    ahead = re.compile(rb"(?:[^\x20\x09.,;:!?\x0A-\x0D]+[\x20\x09]*){0,%d}" % (longest - 1))
    held, total = [], 0
    for text in texts:
        data, at = text.encode("utf-8", "surrogatepass"), 0
        while total + len(data) - at >= size:
            least = at + max(0, size - total)
            end = stop.search(data, least, least + size) or gap.search(data, least)
            cut = end.end() if end else len(data)
            more = ahead.match(data, cut)[0] if end and not stop.match(end[0]) else b""
            yield b"\n".join([*held, data[at:cut] + more]), len(more.split())
            held, total, at = [], 0, cut
        if at < len(data):
            held.append(data[at:])
            total += len(data) - at + 1
    if held:
        yield b"\n".join(held), 0


def _counted(data: bytes, ahead: int, longest: int):
    """The windows of a slice, each once and in order, with their counts: two Arrow arrays.

    A window is a word with those after it in its piece, ``longest`` words at most; none begins at the last ``ahead`` words.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    own, kinds = _letters()
    raw = np.frombuffer(data, np.uint8)
    kind = kinds[raw]
    word = kind == 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return pa.array([], pa.binary()), pa.array([], pa.int64())
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(own[raw[word]])])
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    vocabulary = coded.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    ids = rank[coded.indices.to_numpy()]
    piece = np.cumsum(kind == 2)[start]
    columns = [ids]
    for k in range(1, longest):
        shifted = np.zeros_like(ids)
        if k < len(ids):
            shifted[:-k] = np.where(piece[k:] == piece[:-k], ids[k:], 0)
        columns.append(shifted)
    columns = [c[: len(ids) - ahead] for c in columns]
    if not len(columns[0]):
        return pa.array([], pa.binary()), pa.array([], pa.int64())
    bits = len(order).bit_length()
    keys, packed, room = [], None, 0
    for c in columns:
        packed, room = (c.copy(), 63 - bits) if room < bits else ((packed << bits) | c, room - bits)
        if room < bits or c is columns[-1]:
            keys.append(packed)
    by = np.lexsort(keys[::-1])
    changed = np.zeros(len(by), bool)
    changed[0] = True
    for k in keys:
        ordered = k[by]
        changed[1:] |= ordered[1:] != ordered[:-1]
    at = np.flatnonzero(changed)
    first = by[at]
    parts = [vocabulary.take(pa.array(np.maximum(c[first] - 1, 0), mask=c[first] == 0)) for c in columns]
    windows = pc.binary_join_element_wise(*parts, pa.scalar(GAP, pa.binary()), null_handling="skip")
    return windows, pa.array(np.diff(np.append(at, len(by))))


def _lang_key(lang: str | None) -> bytes:
    """A language as the first part of a stream's key: without a zero byte, none taken for another."""
    return ("und" if lang is None else lang).encode("utf-8", "surrogatepass").replace(b"\\", b"\\\\").replace(b"\x00", b"\\0")


def _lang(key: bytes) -> str:
    return key.replace(b"\\0", b"\x00").replace(b"\\\\", b"\\").decode("utf-8", "surrogatepass") if b"\\" in key else key.decode("utf-8", "surrogatepass")


def windows(docs: DataFrame, longest: int = LONGEST, bounds: list[bytes] | None = None) -> DataFrame:
    """``part, window, c``: the windows of ``docs`` (``lang, text``) under their language, equal ones of a slice counted together.

    ``part`` is the range between the sorted ``bounds`` in which a window lies.
    """
    bounds = bounds or []

    def of_batches(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            by = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                if text.is_valid:
                    by.setdefault(_lang_key(lang), []).append(text)
            for lang, texts in by.items():
                for data, ahead in _slices((t.as_py() for t in texts), SLICE, longest):
                    found, counts = _counted(data, ahead, longest)
                    if not len(found):
                        continue
                    keys = pc.binary_join_element_wise(pa.scalar(lang, pa.binary()), found, pa.scalar(GAP, pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array(_between(keys, bounds)), keys, counts], ["part", "window", "c"])
                    del found, counts, keys
                    pa.default_memory_pool().release_unused()

    return docs.select("lang", "text").mapInArrow(of_batches, "part int, window binary, c long")


def _between(keys, bounds: list[bytes]):
    """For each of the sorted keys the number of bounds that are not above it."""
    import numpy as np

    low, high = bisect.bisect_right(bounds, keys[0].as_py()), bisect.bisect_right(bounds, keys[-1].as_py())
    cuts = [bisect.bisect_left(range(len(keys)), x, key=lambda i: keys[i].as_py()) for x in bounds[low:high]]
    return (low + np.searchsorted(np.asarray(cuts, np.int64), np.arange(len(keys)), side="right")).astype(np.int32)


def _bounds(docs: DataFrame, longest: int, parts: int, seed: int = 1) -> list[bytes]:
    """Windows that part a sample of the stream evenly, ``parts - 1`` at most."""
    n = docs.count()
    if parts < 2 or not n:
        return []
    some = windows(docs.sample(min(1.0, SAMPLE_DOCUMENTS / n), seed), longest)
    some = spool(some.groupBy("window").count().select("window"))
    found = some.count()
    picked = some.sample(min(1.0, 0.9 * SAMPLE_WINDOWS / max(1, found)), seed).limit(SAMPLE_WINDOWS).collect()
    listed = sorted(bytes(r["window"]) for r in picked)
    return sorted({listed[i * len(listed) // parts] for i in range(1, parts)}) if listed else []


# --- counts ----------------------------------------------------------------------------------------------------------


def _runs(batches, longest: int, least: int):
    """Over a sorted stretch of the stream: each phrase of up to ``longest`` words with its count, if it reaches ``least``.

    One that may go on before or after the stretch comes out whatever its count, and so does each language's number of words.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    open_runs: dict[int, list] = {}  # words -> [phrase, count, began with the stretch]
    out: list[tuple[bytes, int, int]] = []

    def close(k):
        run = open_runs.pop(k, None)
        if run and (run[2] or k == 0 or run[1] >= least):
            out.append((run[0], k, run[1]))

    begun = False
    for b in batches:
        if not b.num_rows:
            continue
        keys, counts = b.column(0), b.column(1).to_numpy()
        lists = pc.split_pattern(keys, GAP)
        flat = lists.flatten().dictionary_encode().indices.to_numpy()
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        size = np.diff(at) - 1
        table = np.full((len(keys), longest + 1), -1, np.int64)
        for k in range(longest + 1):
            has = size >= k
            table[has, k] = flat[at[:-1][has] + k]
        changed = np.zeros(len(keys), bool)
        changed[0] = True
        for k in range(longest + 1):
            changed[1:] |= table[1:, k] != table[:-1, k]
            begin = np.flatnonzero(changed)
            sums = np.add.reduceat(counts, begin)
            whole = size[begin] >= k
            interior = whole & (sums >= (1 if k == 0 else least))
            interior[[0, -1]] = False
            prefix = lambda i: GAP.join(keys[int(i)].as_py().split(GAP)[: k + 1])  # noqa: B023, E731
            if whole[0]:
                name = prefix(begin[0])
                if k in open_runs and open_runs[k][0] == name:
                    open_runs[k][1] += int(sums[0])
                else:
                    close(k)
                    open_runs[k] = [name, int(sums[0]), not begun]
            else:
                close(k)
            if len(begin) > 1:
                close(k)
                out.extend((prefix(begin[i]), k, int(sums[i])) for i in np.flatnonzero(interior))
                if whole[-1]:
                    open_runs[k] = [prefix(begin[-1]), int(sums[-1]), False]
        begun = True
        if len(out) > 10_000:
            yield out
            out = []
    out.extend((name, k, count) for k, (name, count, _) in open_runs.items())
    if out:
        yield out


def counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, parts: int | None = None) -> DataFrame:
    """``lang, k, phrase, f``: the phrases of ``k`` words that stand at least ``least`` times within pieces, by language.

    With ``k = 0`` and an empty phrase: all words of a language. One stream of windows is dealt out by ranges of its order,
    which split a language or a word of any size, and sorted; equal windows of a slice travel once. A phrase's count is the
    length of a run, whatever its length; runs that end with a range are put together afterwards.
    """
    import pyarrow as pa

    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(docs, longest, parts)
    stream = windows(docs, longest, bounds).repartitionById(len(bounds) + 1, F.col("part")).select("window", "c").sortWithinPartitions("window")

    def of_batches(batches):
        for out in _runs(batches, longest, least):
            listed = [(_lang(p[0]), k, b" ".join(w.replace(ZERO, b"\x00") for w in p[1:]).decode("utf-8", "surrogatepass"), c) for p, k, c in ((p.split(GAP), k, c) for p, k, c in out)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*listed), (pa.string(), pa.int32(), pa.string(), pa.int64()))], ["lang", "k", "phrase", "f"])

    found = stream.mapInArrow(of_batches, "lang string, k int, phrase string, f long")
    return found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("k") == 0))


# --- collocations ----------------------------------------------------------------------------------------------------


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, first: int = FIRST, parts: int | None = None) -> DataFrame:
    """The ``first`` collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``docs`` has ``lang`` (null: ``und``) and ``text`` (null: empty); other columns are ignored, repeated rows count each.
    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends and those into words at spaces and tabs.
    Phrases of 2 to ``longest`` words with ``a >= least`` occurrences are scored by their weakest cut into counts ``l`` and
    ``r``, ``floor(1000 a n / (l r))``, ties to the earliest; those that always stand inside a longer one are dropped. By
    score and ``a`` descending, then phrase in byte order. An empty table gives none.

    The count stream is kept in two orders, by phrase and by phrase without its first words: each cut of a phrase is
    merge-joined (sorted on both sides, read side by side) with the stream of left parts, then with that of right parts.
    That a phrase has a longer one with the same count shows at its first and last cut.
    """
    every = spool(counts(docs, longest, least, parts))
    total = every.where("k = 0").select(F.col("lang").alias("t_lang"), F.col("f").alias("n"))
    total = F.broadcast(total) if total.count() <= BROADCAST_ROWS else total
    words = F.split("phrase", " ")
    cut = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    cuts = every.where("k >= 2").select("lang", "phrase", F.col("f").alias("a"), F.col("k").alias("m"), words.alias("words")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "m", "cut", cut(F.lit(1), F.col("cut")).alias("left"), cut(F.col("cut") + 1, F.col("m") - F.col("cut")).alias("right"))
    stream = every.where("k between 1 and %d" % (longest - 1))
    by_prefix = stream.select(F.col("lang").alias("l_lang"), F.col("phrase").alias("l_phrase"), F.col("f").alias("l"))
    by_suffix = stream.select(F.col("lang").alias("r_lang"), F.col("phrase").alias("r_phrase"), F.col("f").alias("r"))
    met = cuts.join(by_prefix.hint("merge"), (F.col("lang") == F.col("l_lang")) & (F.col("left") == F.col("l_phrase")))
    met = met.join(by_suffix.hint("merge"), (F.col("lang") == F.col("r_lang")) & (F.col("right") == F.col("r_phrase")))
    met = spool(met.select("lang", "phrase", "a", "m", "cut", "left", "right", "l", "r"))

    inner = met.where("m >= 3")
    inside = inner.where("cut = m - 1 and l = a").select("lang", F.col("left").alias("phrase")).unionByName(inner.where("cut = 1 and r = a").select("lang", F.col("right").alias("phrase")))
    score = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = met.join(total, F.col("lang") == F.col("t_lang")).withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b"))
    left = best.join(inside.distinct().hint("merge"), ["lang", "phrase"], "left_anti").select("lang", "phrase", "b.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return left.withColumn("rank", rank.cast("long")).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), words as (
  select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces
), grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from words, range(1, 6) t(k)
), counts as (
  select lang, k, phrase, count(*) as f from grams group by all having count(*) >= 100
), totals as (
  select lang, sum(len(w))::hugeint as n from words group by 1
), cuts as (
  select c.lang, c.phrase, c.f as a, c.k, t.cut, string_split(c.phrase, ' ') as w from counts c, range(1, 5) t(cut) where c.k >= 2 and t.cut < c.k
), scored as (
  select c.lang, c.phrase, c.k, c.cut, c.a, l.f as l, r.f as r, n, (1000 * c.a::hugeint * n) // (l.f::hugeint * r.f) as score
  from cuts c join counts l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:c.cut], ' ')
    join counts r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.cut + 1:], ' ') join totals t on t.lang = c.lang
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), longer as (
  select lang, f, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') as phrase from counts, range(1, 6) s(i), range(2, 5) t(m) where m < k and i + m - 1 <= k
)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from best b where not exists (select 1 from longer x where x.lang = b.lang and x.phrase = b.phrase and 100 * x.f >= 100 * b.a)
qualify rank <= 2000
"""
