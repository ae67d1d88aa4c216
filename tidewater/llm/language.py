"""Language identification of code-switched text by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewater.llm.tables import give_back, table

#: Languages that are learned at most, the commonest, and labelled rows of each that the model is fitted on at most, the smallest by a hash.
MOST_LANGUAGES, ROWS_PER_LANGUAGE = 256, 150
#: Windows of a sampled text that are taken, evenly over all of it, and their characters; shorter texts are taken whole.
WINDOWS, WINDOW = 64, 300
#: Words of each of these rows that go into one training sequence, at most, spread over the whole text.
TRAINING_RUN = 25
#: Sampled texts of a language that a word must stand in to be in that language's lexicon.
LEXICON_TEXTS = 3
#: Feature weights are shared by hash among so many places.
PLACES = 1 << 16
STEPS = 60
#: Words of a block; blocks of all texts at hand are worked through side by side.
BLOCK = 64
#: Bytes of text worked through together.
AT_A_TIME = 1 << 18
UNKNOWN = "und"
_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """Languages in order, weights of features (places, languages), of the first word and of transitions.

    ``lexicon`` has the hashes of the languages' words in order and for each a number that tells in which lexicons it is.
    """

    languages: list[str]
    weights: np.ndarray
    start: np.ndarray
    moves: np.ndarray
    lexicon: tuple[np.ndarray, np.ndarray] | None = None


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: remainder 2 of the CRC-32 of its id as text, by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word of texts laid end to end in code points: runs of letters and other non-ASCII characters."""
    letter = (data >= 128) | ((data | 32) >= 97) & ((data | 32) <= 122)
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = letter[1:] != letter[:-1]
    edge[ends[:-1]] = True  # a word ends with its text
    edge[0] = edge[-1] = True
    at = np.flatnonzero(edge)
    begin, end = at[:-1], at[1:]
    real = letter[begin] if len(data) else np.zeros(0, bool)
    begin, end = begin[real], end[real]
    return begin, end, np.searchsorted(ends, begin, side="right")


def features(rows: np.ndarray, size: np.ndarray, word: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, their places in one array, and where each word's begin.

    ``rows`` has the words end to end, each with a zero before and after it as a mark; ``size`` their letters, ``word``
    their hashes, ``listed`` in which languages' lexicons they are. Of each: itself and its lexicons, its first and
    last letters up to three (affixes), and all pairs and triples of neighbouring letters with the marks (n-grams).
    """

    def place(x: np.ndarray, kind: int) -> np.ndarray:
        return ((x << np.uint64(4) | np.uint64(kind)) * _MIX >> np.uint64(48)).astype(np.int64)

    wide = size + 2
    first = np.cumsum(wide) - wide
    last = first + wide - 1
    x = rows.astype(np.uint64)
    two = x[:-1] << np.uint64(21) | x[1:]
    three = two[:-1] << np.uint64(21) | x[2:]
    four = np.append(three[:-1] * _PRIME ^ x[3:], np.zeros(1, np.uint64))
    fixed = [word, listed, two[first], two[last - 1], three[first], three[last - 2], four[np.minimum(first, last - 3 + (size < 2))], four[np.maximum(last - 3, first)]]
    # All n-grams that start in a word's row, but for those reaching over its end.
    start = np.ones(len(rows) - 1, bool)
    start[last[:-1]] = False
    at2 = np.flatnonzero(start)
    start = start[:-1]
    start[last[:-1] - 1] = False
    at3 = np.flatnonzero(start)
    total = len(fixed) + 2 * size + 1
    begins = np.cumsum(total) - total
    out = np.empty(int(total.sum()), np.int64)
    for i, v in enumerate(fixed):
        out[begins + i] = place(v, i)
    step = np.arange(len(at2)) - np.repeat(np.cumsum(size + 1) - (size + 1), size + 1)
    out[np.repeat(begins + len(fixed), size + 1) + step] = place(two[at2], 9)
    step = np.arange(len(at3)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begins + len(fixed) + size + 1, size) + step] = place(three[at3], 10)
    return out, begins


@dataclass
class Words:
    """The words of some texts: the text of each, which distinct word it is, and the features of those."""

    text: np.ndarray
    which: np.ndarray
    hashes: np.ndarray
    places: np.ndarray
    begins: np.ndarray

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Of each distinct word for each language: the mean weight of its features, times 8."""
        per = np.diff(np.append(self.begins, len(self.places)))
        return np.stack([np.add.reduceat(w[self.places], self.begins) for w in weights.T], axis=1) * (8.0 / per)[:, None]


def read_words(texts: list[bytes], lexicon: tuple[np.ndarray, np.ndarray] | None = None) -> Words:
    """The words of texts in UTF-8."""
    plain = [t.decode("utf-8", "replace") for t in texts]
    data = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32)
    begin, end, text = words_of(data, np.cumsum([len(t) for t in plain]))
    size = end - begin
    if not len(size):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none, none)
    low = data | ((data >= 65) & (data <= 90)).astype(np.uint32) << np.uint32(5)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    letters = low[np.repeat(begin, size) + inside]
    powers = np.full(int(size.max()), _PRIME, np.uint64).cumprod(dtype=np.uint64)
    word = np.add.reduceat(letters.astype(np.uint64) * powers[inside], np.cumsum(size) - size)
    word, one, which = np.unique(word, return_index=True, return_inverse=True)
    begin, size = begin[one], size[one]
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    rows = np.zeros(int((size + 2).sum()), np.uint32)
    rows[np.repeat(np.cumsum(size + 2) - size - 1, size) + inside] = low[np.repeat(begin, size) + inside]
    listed = np.zeros(len(word), np.uint64)
    if lexicon is not None and len(lexicon[0]):
        at = np.minimum(np.searchsorted(lexicon[0], word), len(lexicon[0]) - 1)
        listed = np.where(lexicon[0][at] == word, lexicon[1][at], np.uint64(0))
    return Words(text, which, word, *features(rows, size, word, listed))


def learned_lexicon(own: Words, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that stand in ``LEXICON_TEXTS`` texts of a language or more; ``label`` is each word's language."""
    seen = np.unique(np.stack([own.which, label, own.text]), axis=1)
    (which, lang), texts = np.unique(seen[:2], axis=1, return_counts=True)
    which, lang = which[texts >= LEXICON_TEXTS], lang[texts >= LEXICON_TEXTS]
    if not len(which):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
    return own.hashes[which[first]], np.add.reduceat((lang.astype(np.uint64) + np.uint64(1)) * _MIX, first)


class _Blocks:
    """Words of all texts in blocks, longest first, so that those with a next word are always the first ones."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        new = np.ones(n, bool)
        new[1:] = text[1:] != text[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        nth = np.arange(n) - first
        begin = np.flatnonzero(nth % BLOCK == 0)
        size = np.diff(np.append(begin, n))
        order = np.argsort(-size, kind="stable")
        self.begin, self.size = begin[order], size[order]
        self.nth = nth[self.begin] // BLOCK  # of the block in its text
        self.text = text[self.begin]
        self.live = [int((self.size > t).sum()) for t in range(int(self.size.max()))]

    def chain(self) -> list[np.ndarray]:
        """Blocks that are the first, second, ... of their text; each in order of text."""
        by = np.lexsort((self.text, self.nth))
        return np.split(by, np.cumsum(np.bincount(self.nth[by]))[:-1])


def forward_backward(scores: np.ndarray, text: np.ndarray, model: Model, pairs: bool = False):
    """Chances of each language for each word, and with ``pairs`` the expected moves and log-likelihood parts.

    Every block is first taken as a matrix from the state before it to the state after it; these are chained along
    each text, and then all blocks are filled in side by side.
    """
    n, k = scores.shape
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    a, begin = np.exp(model.moves), np.exp(model.start)
    b = _Blocks(text)
    m = len(b.begin)
    opening = b.nth == 0
    matrix = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    for t, live in enumerate(b.live):
        x = matrix[:live] if t else None
        x = np.where(opening[:live, None, None], matrix[:live], matrix[:live] @ a) if t == 0 else x @ a
        x = x * e[b.begin[:live] + t][:, None, :]
        matrix[:live] = x / x.max(axis=(1, 2), keepdims=True)
    before, after = np.empty((m, k)), np.ones((m, k))
    rounds = b.chain()
    before[rounds[0]] = begin / begin.sum()
    for prev, own in zip(rounds, rounds[1:], strict=False):
        prev = prev[np.isin(b.text[prev], b.text[own])]
        v = np.einsum("bi,bij->bj", before[prev], matrix[prev])
        before[own] = v / v.sum(axis=1, keepdims=True)
    for own, prev in zip(rounds[:0:-1], rounds[-2::-1], strict=False):
        prev = prev[np.isin(b.text[prev], b.text[own])]
        v = np.einsum("bij,bj->bi", matrix[own], after[own])
        after[prev] = v / v.sum(axis=1, keepdims=True)
    f = np.empty((n, k))
    v = before.copy()
    for t, live in enumerate(b.live):
        x = np.where(opening[:live, None], v[:live], v[:live] @ a) if t == 0 else v[:live] @ a
        x = x * e[b.begin[:live] + t]
        v[:live] = x / x.sum(axis=1, keepdims=True)
        f[b.begin[:live] + t] = v[:live]
    moves = np.zeros((k, k))
    chances = np.empty((n, k))
    v = after
    for t in range(len(b.live) - 1, -1, -1):
        live = b.live[t]
        at = b.begin[:live] + t
        x = f[at] * v[:live]
        chances[at] = x / x.sum(axis=1, keepdims=True)
        back = e[at] * v[:live]
        if pairs and t:
            xi = f[at - 1][:, :, None] * a * back[:, None, :]
            moves += (xi / xi.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        v[:live] = back @ a.T
        v[:live] /= v[:live].sum(axis=1, keepdims=True)
    return (chances, moves) if pairs else chances


def fit(texts: list[str], langs: list[str]) -> Model:
    """A model from labelled texts: conditional likelihood, by Adam, from the same start each time.

    Every word has its text's label. The texts are cut into runs that follow each other in an order that mixes the
    languages, so that moves between languages are learned as well.
    """
    names = sorted(set(langs))
    model = Model(names, np.zeros((PLACES, len(names))), np.zeros(len(names)), np.zeros((len(names), len(names))))
    own = read_words([t.encode("utf-8", "replace") for t in texts])
    if not len(own.text):
        return model
    label = np.array([names.index(x) for x in langs])[own.text]
    model.lexicon = learned_lexicon(own, label)
    own = read_words([t.encode("utf-8", "replace") for t in texts], model.lexicon)
    new = np.flatnonzero(np.append(True, own.text[1:] != own.text[:-1]))
    nth = np.arange(len(label)) - np.repeat(new, np.diff(np.append(new, len(label))))
    run = np.cumsum((nth % TRAINING_RUN == 0)) - 1
    order = np.argsort(np.random.default_rng(7).permutation(run[-1] + 1)[run], kind="stable")
    which, label = own.which[order], label[order]
    text = np.arange(len(label)) // BLOCK  # sequences of one block each
    truth = np.eye(len(names))[label]
    begins = text != np.append(-1, text[:-1])
    seen = np.zeros_like(model.moves)
    np.add.at(seen, (label[:-1][~begins[1:]], label[1:][~begins[1:]]), 1)
    per = np.diff(np.append(own.begins, len(own.places)))
    feature_word = np.repeat(np.arange(len(per)), per)
    params = [model.weights, model.start, model.moves]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        chances, moves = forward_backward(own.scores(model.weights)[which], text, model, pairs=True)
        miss = (truth - chances) / len(label)
        by_word = np.stack([np.bincount(which, m, len(per)) for m in miss.T], axis=1) * (8.0 / per)[:, None]
        up = np.stack([np.bincount(own.places, w[feature_word], PLACES) for w in by_word.T], axis=1)
        ups = [up - 1e-6 * model.weights, miss[begins].sum(axis=0), (seen - moves) / len(label)]
        for p, g, m, s in zip(params, ups, mean, square, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    return model


def train(docs: DataFrame) -> Model:
    """Fits a model on a bounded sample of ``docs`` (``doc_id, text, lang``) that are not held out.

    For each of the ``MOST_LANGUAGES`` commonest languages the ``ROWS_PER_LANGUAGE`` rows with the smallest hash, of any
    length: of a long text ``WINDOWS`` windows over all of it.
    """
    rows = docs.where("lang is not null and text is not null and char_length(text) > 0").where(~held_out(F.col("doc_id")))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")).alias("h"))
    # Far more rows than needed by a share of the hash range, the smallest of them by a window; the rest only where too few.
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not sizes:
        return Model([], np.zeros((PLACES, 0)), np.zeros(0), np.zeros((0, 0)))
    cut = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, 3 * ROWS_PER_LANGUAGE / n))])
    share = F.pmod(F.shiftright("h", 4), F.lit(1 << 40)) / float(1 << 40)
    some = rows.where(share <= cut[F.col("lang")])
    nth = F.row_number().over(_by_lang())
    step = F.length("text") / WINDOWS
    windows = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda i: F.regexp_replace(F.substring("text", F.floor(i * step).cast("int") + 1, F.lit(WINDOW)), r"^\S*\s|\s\S*$", ""))
    taken = F.when(F.length("text") <= WINDOWS * WINDOW, F.col("text")).otherwise(F.array_join(windows, "\n"))
    sample = some.withColumn("nth", nth).where(F.col("nth") <= ROWS_PER_LANGUAGE).select("lang", "h", taken.alias("text")).collect()
    sample.sort(key=lambda r: (r["lang"], r["h"], r["text"]))
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def _by_lang():
    from pyspark.sql import Window

    return Window.partitionBy("lang").orderBy(F.pmod(F.shiftright("h", 4), F.lit(1 << 40)), "h", "text")


def label_texts(texts: list[bytes], model: Model) -> tuple[list[str], list[float]]:
    """The language with the largest mean chance over a text's words, the first by name at ties, and that mean."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    own = read_words(texts, model.lexicon)
    if not len(own.text) or not model.languages:
        return names, scores
    chances = forward_backward(own.scores(model.weights)[own.which], own.text, model)
    new = np.flatnonzero(np.append(True, own.text[1:] != own.text[:-1]))
    means = np.add.reduceat(chances, new, axis=0) / np.diff(np.append(new, len(chances)))[:, None]
    for i, m in zip(own.text[new].tolist(), means, strict=True):
        best = int(m.argmax())
        names[i], scores[i] = model.languages[best], float(min(m[best], 1.0))
    return names, scores


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` (needs ``text``) with ``lang_pred`` and ``score``.

    ``und`` and 0.0 for a null text and one without a letter. The rest of each row passes unchanged; columns of these
    two names are replaced. No shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    own = docs.drop("lang_pred", "score")
    names = own.columns
    schema = T.StructType([*own.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            some, size = [], 0
            for i, text in enumerate(batch.column(at)):
                some.append((text.as_py() or "").encode("utf-8", "replace"))
                size += len(some[-1])
                if size > AT_A_TIME or i + 1 == batch.num_rows:
                    x, y = label_texts(some, model)
                    langs += x
                    scores += y
                    some, size = [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])
            give_back()

    out = own.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)
    letter = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    return out.withColumns({"lang_pred": F.when(letter, F.col("lang_pred")).otherwise(UNKNOWN), "score": F.when(letter, F.col("score")).otherwise(0.0)})


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs`` without rows whose language is unknown or has a mean chance below ``least``."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    known = identify(docs.select("text", own), model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return known.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
