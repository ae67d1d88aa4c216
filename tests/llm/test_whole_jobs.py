"""What the operators of a corpus take in: near copies, edited, short and numeric lines, vectors of any length."""

import os
import random
import time

import numpy as np
import pytest

from tidewater import spool
from tidewater.llm import lines, nearcopies, simhash

SCHEMA = "doc_id long, text string"


def grams(text, k=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def groups(ids, linked):
    label = {i: i for i in ids}
    while True:
        new = {i: min(label[j] for j in ids if i == j or linked(i, j)) for i in ids}
        if new == label:
            return label
        label = new


def test_near_dedup_against_brute_force_jaccard(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(8):
        base = [r.choice(words) for _ in range(r.randrange(3, 220))]
        texts.append(" ".join(base))
        for _ in range(8):
            own = list(base)
            for _ in range(r.randrange(0, 6)):
                own[r.randrange(len(own))] = r.choice(words)
            texts.append(" ".join(own + [r.choice(words)] * r.randrange(0, 3)))
    texts += [None, "", " \n", texts[0].upper(), "one two", "one two three"]
    sets = {i: grams(t) for i, t in enumerate(texts)}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    edited = [(i, j) for i in sets for j in sets if i < j and 0.8 <= jaccard(sets[i], sets[j]) < 1]
    assert len(edited) > 20
    label = groups(list(sets), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    got = simhash.keep_one_each(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert sorted(x["doc_id"] for x in got) == sorted(set(label.values()))


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(q[-1] + 1, p[j + 1] + 1, p[j] + (x != y)))
        p = q
    return p[-1]


@pytest.mark.parametrize("few, pairwise, family, block", [(lines.FEW, lines.PAIRWISE, lines.FAMILY, lines.BLOCK), (1, 1, lines.FAMILY, 3), (1, 1, 1, 3)])
def test_line_edits_grow_with_length(spark, monkeypatch, few, pairwise, family, block):
    monkeypatch.setattr(lines, "FAMILY", family)
    monkeypatch.setattr(lines, "BLOCK", block)
    monkeypatch.setattr(lines, "FEW", few)
    monkeypatch.setattr(lines, "PAIRWISE", pairwise)
    r = random.Random(3)
    texts = []
    for n in (32, 39, 40, 79, 80, 120, 200, 300):
        base = "".join(r.choice("abcdefgh ij") for _ in range(n - 2))
        base = f"x{base}x"
        for _ in range(8):
            own = list(base)
            for _ in range(r.randrange(0, n // 40 + 3)):
                i = r.randrange(len(own))
                own[i : i + 1] = r.choice(["", "z", own[i] + "y"])
            texts.append("".join(own))
    sizes = [len(t) for t in texts]
    close = lambda i, j: texts[i] == texts[j] or min(sizes[i], sizes[j]) >= 32 and abs(sizes[i] - sizes[j]) < 15 and edit(texts[i], texts[j]) <= 1 + min(sizes[i], sizes[j]) // 40
    known = {(i, j): close(i, j) for i in range(len(texts)) for j in range(i, len(texts))}
    label = groups(list(range(len(texts))), lambda i, j: known[min(i, j), max(i, j)])
    got = {x["doc_id"]: x["n_dropped"] for x in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert got == {i: int(label[i] != i) for i in label}


def test_short_lines_that_stand_in_an_earlier_document_go(spark):
    rows = [(1, "All rights reserved.\n\nnew"), (2, "own\n\nALL RIGHTS RESERVED."), (3, "\u4f60\u597d\u3002\n \nAll rights reserved!"), (4, "\u4f60\u597d\u3002\n ")]
    got = {x["doc_id"]: x["text"] for x in lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: rows[0][1], 2: "own\n", 3: rows[2][1], 4: " "}


def test_lines_of_other_numbers_stay(spark):
    table = "\n".join(f"{i * 7919 % 100000:05d} | {i * 104729 % 10**9:09d} | {i * 15485863 % 10**12:012d}" for i in range(1, 40))
    got = lines.dedup_lines(spark.createDataFrame([(1, table)], SCHEMA)).first()
    assert (got["text"], got["n_dropped"]) == (table, 0)


def test_a_common_passage_makes_no_pairs(spark, monkeypatch):
    """Unlike texts that share a passage: rows to compare grow with the texts, not with their square."""
    r = random.Random(17)
    passage = " ".join(f"p{i}" for i in range(24))
    made, counts = nearcopies._candidates, []

    def counting(rows):
        rows = rows.cache()
        counts.append(rows.count())
        return made(rows)

    monkeypatch.setattr(nearcopies, "_candidates", counting)
    for n in (150, 600):
        texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(30)) + f" {passage} " + " ".join(f"w{r.randrange(10**6)}" for _ in range(30)) for _ in range(n)]
        texts += [texts[0] + " more", texts[1].replace("p5", "p6")]
        got = nearcopies.near_copies(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
        assert {x["doc_id"]: x["component_id"] for x in got} == {i: {n: 0, n + 1: 1}.get(i, i) for i in range(n + 2)}
    assert sum(counts) < 1000


def test_near_dedup_links_by_fingerprints_first(spark, monkeypatch):
    """Long texts that differ in a word are linked by their fingerprints; nothing of them is left for the join by shingles."""
    r = random.Random(11)
    base = [f"w{r.randrange(10**6)}" for _ in range(4000)]
    texts = [" ".join([*base[:-1], f"end{i}"]) for i in range(12)] + [" ".join(base[::-1])]
    fps = [simhash.fingerprint_of([nearcopies.shingle_set(t, 5)]) for t in texts]
    label = groups(list(range(12)), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 2)
    assert set(label.values()) == {0} and len(set(fps[:12])) > 1 and len(set(texts)) == 13
    rows, made = [], nearcopies._candidates

    def counting(df):
        rows.append(df.count())
        return made(df)

    monkeypatch.setattr(nearcopies, "_candidates", counting)
    got = simhash.keep_one_each(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert sorted(x["doc_id"] for x in got) == [0, 12] and sum(rows) == 0


@pytest.mark.parametrize("held", [1, 7, 500])
def test_keys_met_again_against_brute_force(held):
    r = random.Random(held)
    rows = [(r.randrange(-60, 60) if r.random() < 0.6 else 5, r.randrange(40)) for _ in range(900)]
    met, got = lines._Met(), set()
    for at in range(0, len(rows), held):
        key, lid = (np.array(v, np.int64) for v in zip(*rows[at : at + held], strict=True))
        found = met.add(key, lid)
        got |= set(zip(*(f.tolist() for f in found), strict=True))
    own = {k: {y for x, y in rows if x == k} for k, _ in rows}
    assert got == {(k, v) for k, vs in own.items() if len(vs) > 1 for v in vs}
    assert (np.diff(met.key) > 0).all() and len(met.key) == len(own)


def test_a_key_of_one_line_repeated_stays_alone():
    met = lines._Met()
    for _ in range(3):
        key, lid = met.add(np.array([4, 4, 9], np.int64), np.array([2, 2, 3], np.int64))
        assert not len(key) and not len(lid)
    key, lid = met.add(np.array([4], np.int64), np.array([8], np.int64))
    assert sorted(lid.tolist()) == [2, 8] and key.tolist() == [4, 4]


def test_pairs_of_many_bounds_are_verified_side_by_side():
    r = random.Random(23)
    ones, others, bounds = [], [], []
    for _ in range(300):
        n = r.randrange(1, 90)
        a = "".join(r.choice("ab\x00c") for _ in range(n))
        own = list(a)
        for _ in range(r.randrange(6)):
            own.insert(r.randrange(len(own) + 1), r.choice("ab\x00d")) if r.random() < 0.5 else own and own.pop(r.randrange(len(own)))
        ones.append(a)
        others.append("".join(own))
        bounds.append(r.choice([1, 2, 3, 5, 8, 20, 31, 40]))
    want = [edit(a, b) <= k for a, b, k in zip(ones, others, bounds, strict=True)]
    assert lines.within_all(ones, others, bounds).tolist() == want and 20 < sum(want) < 290


def test_prefix_keys_of_several_sets_only(spark):
    """What prefixes hold alone isn't kept; copies of one set count as one."""
    r = random.Random(5)
    rows = [(sid, [r.randrange(300) - 150 for _ in range(r.randrange(12))]) for sid in range(60)]
    rows = [(sid, sorted(set(keys))) for sid, keys in rows] * 2
    marked = spark.createDataFrame(rows, "sid long, keys array<long>").repartition(3)
    got = [(x["key"], x["sid"]) for x in nearcopies._shared_keys(marked).collect()]
    holders = {}
    for sid, keys in rows:
        for k in keys:
            holders.setdefault(k, set()).add(sid)
    assert sorted(got) == sorted((k, sid) for k, own in holders.items() if len(own) > 1 for sid in own)


@pytest.mark.parametrize("stage", [simhash.keep_one_each, lines.dedup_documents])
def test_stages_leave_one_table_behind(spark, stage):
    """Only what the result still reads stays on disk."""
    base = [" ".join(f"w{i * j}" for j in range(1, 40)) for i in range(1, 8)]
    texts = [*base, base[0] + " more", base[1].replace("w4", "v4"), base[2]]
    folder = spool.run_dir(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = stage(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    assert 7 <= got.count() < len(texts)
    assert len(set(os.listdir(folder)) - before) == 1


def test_scratch_keeps_what_it_is_asked_to(spark):
    with spool.scratch(spark) as outer:
        with spool.scratch(spark) as keep:
            gone = spool.spool(spark.range(3))
            inner = keep(gone.selectExpr("id + 1 id"))
        assert not os.path.exists(gone.inputFiles()[0].removeprefix("file://"))
        last = outer(inner.selectExpr("id + 1 id"))
    assert sorted(x["id"] for x in last.collect()) == [2, 3, 4]
    assert not any(os.path.exists(f.removeprefix("file://")) for f in inner.inputFiles())


def test_dealing_keys_takes_no_longer_for_more_buckets():
    """Keys of a task are put in order once, not once for each bucket; nothing of them is lost."""
    r = np.random.default_rng(2)
    key, lid = (r.integers(-(1 << 63), 1 << 63, 300_000, np.int64) for _ in range(2))
    for short in (False, True):
        began = time.process_time()
        rows = lines.dealt([(key[:1000], lid[:1000]), (key[1000:], lid[1000:])], 5000, short)
        assert time.process_time() - began < 2 and rows.num_rows == 5000
        got = [np.frombuffer(v.as_buffer(), np.int64) for v in rows.column(2)]
        assert sorted(np.concatenate(got).tolist()) == sorted(lid.tolist())
    whole = {}
    for bucket, keys, lids in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        whole |= dict(zip(np.frombuffer(lids, np.int64).tolist(), ((bucket, k) for k in np.frombuffer(keys, np.uint32).tolist()), strict=True))
    told = dict(zip(lid.tolist(), (key.view(np.uint64) >> np.uint64(33 - 5000 .bit_length())).tolist(), strict=True))
    assert {k: at[1] * 5000 + at[0] for k, at in whole.items()} == told


def test_unlike_lines_of_common_syllables_share_few_keys():
    """Keys are nearly whole segments: what lines of a small vocabulary have in common by chance seldom makes one."""
    r = random.Random(4)
    syllables = [a + b for a in "bdfklmnrst" for b in ("a", "e", "i", "on", "er ", "th ")]
    x = lines.Lines(["".join(r.choice(syllables) for _ in range(r.randrange(16, 60))) for _ in range(6000)])
    holders = {}
    for lists in x.keys(x.size >= 32):
        for line, keys in enumerate(lists.to_pylist()):
            for k in keys:
                holders.setdefault(k, set()).add(line)
    assert len(holders) > 30_000 and sum(len(v) for v in holders.values() if len(v) > 1) < 600


@pytest.mark.parametrize("family, keyed", [(lines.FAMILY, lines.KEYED), (1, lines.KEYED), (1, 1)])
def test_links_of_large_families(spark, monkeypatch, family, keyed):
    """Chains of keys hold unlike lines together; they are compared under their keys only, and no link is lost."""
    monkeypatch.setattr(lines, "FEW", 1)
    monkeypatch.setattr(lines, "PAIRWISE", 1)
    monkeypatch.setattr(lines, "FAMILY", family)
    monkeypatch.setattr(lines, "KEYED", keyed)
    r = random.Random(31)
    halves = ["".join(r.choice("abcdefghijklmnop") for _ in range(18)) for _ in range(41)]
    texts = [halves[i + i % 2] + halves[i + 1 - i % 2] for i in range(40)]  # each has a half in common with the next one
    texts += [t[:3] + "z" + t[4:] if i % 3 else t[:9] + "yyy" + t[12:] for i, t in enumerate(texts)]
    sizes, made = [], lines._group_links

    def counting(rows, *more):
        sizes.append(rows.groupBy("component").count().agg({"count": "max"}).first()[0] or 0)
        return made(rows, *more)

    monkeypatch.setattr(lines, "_group_links", counting)
    close = lambda i, j: edit(texts[i], texts[j]) <= 1 + min(len(texts[i]), len(texts[j])) // 40
    known = {(i, j): close(i, j) for i in range(len(texts)) for j in range(i, len(texts))}
    label = groups(list(range(len(texts))), lambda i, j: known[min(i, j), max(i, j)])
    got = {x["doc_id"]: x["n_dropped"] for x in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert got == {i: int(label[i] != i) for i in label} and 20 < sum(got.values()) < 60
    if family == 1 < keyed:
        assert 0 < max(sizes) < 12
