"""Archives byte by byte, and phrases and tries against brute force."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import zstandard
from same import assert_same, database

from tidewater.llm import collocations, registry, trie, warc

FOLDER = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("name", ["op11_warc_zstd", "op12_sorted_collocations", "op13_prefix_trie"])
def test_same_as_sql(spark, name):
    assert_same(registry.queries()[name](spark, FOLDER), database(FOLDER), registry.oracle_sql()[name])


# --- archives --------------------------------------------------------------------------------------------------------


def archived(spark, tmp_path, rows, **kw):
    path = f"file://{tmp_path}/a"
    warc.write(spark.createDataFrame(rows, PAGES + ", extra string" if rows and len(rows[0]) == 4 else PAGES), path, **kw)
    return warc.read(spark, path)


def test_pages_come_back_whole(spark, tmp_path):
    r = random.Random(3)
    big = "".join(r.choice("abcdefgh \r\n\x00é🙂") for _ in range(300_000))
    texts = [None, "", "short", "a" * 999, "a" * 1000, "é" * 500, "WARC/1.1\r\n\r\n", big, "x" * 5_000_000]
    rows = [(i, f"http://h/{i}", t, "e") for i, t in enumerate(texts + texts)]
    rows += [(None, None, "a" * 1000, "e"), (13, "a b\nc", "a" * 1000, "e"), (None, "n", "only" * 300, "e"), (-5, "m", "only" * 300, "e"), (None, "u", "none" * 300, "e")]
    got = archived(spark, tmp_path, rows, archive_bytes=1 << 20)
    assert got.where("problem is not null").count() == 0
    plain = Counter((i, (t or "").encode()) for i, _, t, _ in rows)
    whole = got.where("record_type = 'response'").collect()
    assert all(plain[(x["page_id"], bytes(x["payload"]))] for x in whole)
    assert {x["url"] for x in whole if x["page_id"] == 13 and x["url"]} >= {"a%20b%0Ac"}
    tops = defaultdict(lambda: None)
    for i, _, t, _ in rows:
        if t and len(t.encode()) >= 1000 and i is not None:
            tops[t] = max(i, tops[t]) if tops[t] is not None else i
    want = Counter()
    for i, _, t, _ in rows:
        b, top = (t or "").encode(), tops[t] if t and len(t.encode()) >= 1000 else None
        revisit = top is not None and i != top
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None)] += 1
    found = warc.resolved(got).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_page", "found").collect()
    assert all(x["found"] for x in found)
    assert Counter(tuple(x)[:5] for x in found) == want


def test_no_pages_make_no_archive(spark, tmp_path):
    (tmp_path / "a").mkdir()
    assert archived(spark, tmp_path, []).count() == 0


def records(n):
    return [warc._record(i, f"http://h/{i}", f"<html>{i} some words that come again".encode() * (1 + i % 7), None, False, "1970-01-01T00:00:00Z") for i in range(n)]


def test_dictionary_is_loaded_from_the_first_frame():
    own = records(300)
    data = b"".join(warc._frames(iter(own), 3))
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY
    assert [x for x, _ in warc.frames(data)] == own
    with pytest.raises(zstandard.ZstdError):
        start = 8 + struct.unpack_from("<I", data, 4)[0]
        zstandard.ZstdDecompressor().decompressobj().decompress(data[start : warc.frame_end(memoryview(data), start)])
    plain = zstandard.train_dictionary(4096, own, k=256, d=8)
    press = zstandard.ZstdCompressor(dict_data=plain, write_content_size=False)
    bare = struct.pack("<II", warc.DICTIONARY, len(plain.as_bytes())) + plain.as_bytes() + b"".join(press.compress(x) + warc.BETWEEN for x in own)
    assert [x for x, _ in warc.frames(bare)] == own
    few = b"".join(warc._frames(iter(own[:1]), 3))
    assert struct.unpack_from("<I", few)[0] == warc.FRAME and [x for x, _ in warc.frames(few)] == own[:1]


def test_broken_archives_say_what_is_wrong(spark, tmp_path):
    own = records(20)
    data = b"".join(warc._frames(iter(own), 3))
    for cut in (3, len(data) // 2, len(data) - 1):
        found = list(warc.frames(data[:cut]))
        assert found[-1][1] and all(x == y for (x, p), y in zip(found[:-1], own) if not p)
    flipped = bytearray(data)
    flipped[-1] ^= 1
    assert [bool(p) for _, p in warc.frames(bytes(flipped))] == [False] * 19 + [True]
    one = own[0]
    say = lambda b: warc.parse(b)["problem"]
    assert say(one) is None
    assert say(b"nothing") == "no record header"
    assert say(one.replace(b"WARC-Date", b"WARC-Late")) == "missing field: warc-date"
    assert say(one[:-1]) == say(one + b"x") == "length differs from Content-Length"
    assert say(one.replace(b"some", b"same")) == "block digest differs"
    bare = re.sub(rb"WARC-Block-Digest[^\n]*\n", b"", one)
    assert say(bare.replace(b"some", b"same")) == "payload digest differs"
    assert say(re.sub(rb"(\d)\r\n\r\n<", lambda m: b"%d\r\n\r\n<" % (9 - int(m[1])), bare)) == "payload length differs from the http header"
    path = tmp_path / "b"
    path.mkdir()
    (path / "x.warc.zst").write_bytes(data[:-5])
    got = warc.read(spark, f"file://{path}").collect()
    assert len([x for x in got if x["problem"]]) == 1 and len(got) == 20


# --- phrases ---------------------------------------------------------------------------------------------------------


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute_windows(texts):
    out = Counter()
    for t in texts:
        for w in pieces(t):
            for i in range(len(w)):
                out[b"\0".join(x.encode().replace(b"\0", b"\t") for x in w[i : i + 5])] += 1
    return out


def odd_texts(n, length, seed):
    r = random.Random(seed)
    return ["".join(r.choice(["a", "b", "C", "\x00", "\x01", "é", "  ", " ", "\t", ".", "\n"]) for _ in range(r.randrange(length))) for _ in range(n)]


@pytest.mark.parametrize("size", [7, 30, 1000, 10**6])
def test_windows_do_not_depend_on_slices(size):
    texts = odd_texts(50, 400, 1) + ["a b c d e f " * 50, "x" * 300]
    got = Counter()
    for data, ahead in collocations._slices(texts, size, 5):
        keys, counts = collocations._counted(data, ahead, 5)
        keys = keys.to_pylist()
        assert keys == sorted(set(keys))
        for k, c in zip(keys, counts.to_pylist()):
            got[k] += c
    assert got == brute_windows(texts)


def brute_collocations(rows, longest, least, first):
    out = []
    for lang in {"und" if x is None else x for x, _ in rows}:
        f, n = Counter(), 0
        for own, text in rows:
            if ("und" if own is None else own) == lang:
                for w in pieces(text):
                    n += len(w)
                    for i in range(len(w)):
                        for k in range(1, longest + 1):
                            if i + k <= len(w):
                                f[tuple(w[i : i + k])] += 1
        cands = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = {p[i : i + m] for p, c in cands.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if f[p[i : i + m]] <= c}
        best = []
        for p, a in cands.items():
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if p not in inside:
                best.append((score, a, " ".join(p), f[p[:k]], f[p[k:]], n))
        best.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n, s) for i, (s, a, p, l, r, n) in enumerate(best[:first])]
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 7])
def test_collocations_against_brute_force(spark, parts):
    r = random.Random(5)
    words = ["the", "a", "of", "Ärger", "x\x00y", "x", "end\x1f"]
    rows = [(r.choice(["en", "de", None, "und", "a\\b"]), " ".join(r.choice(words) if r.random() < 0.8 else r.choice([".", ",", "New York City Hall", "\n"]) for _ in range(r.randrange(60)))) for _ in range(300)]
    rows += [("en", None), (None, ""), ("fr", "!!"), *[("en", "one very common passage of seven words here. ") for _ in range(50)], *[("de", t) for t in odd_texts(60, 300, 2)]]
    docs = spark.createDataFrame([(*x, "c") for x in rows], "lang string, text string, phrase string").repartition(3)
    for least, first in ((10, 40), (3, 2000)):
        got = collocations.collocations(docs, 5, least, first, parts).collect()
        assert sorted(tuple(x) for x in got) == brute_collocations(rows, 5, least, first)
    assert collocations.collocations(docs.where("false")).count() == 0


# --- tries -----------------------------------------------------------------------------------------------------------


def brute_trie(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    nodes = defaultdict(list)
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + x[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append((c, d == len(path)))
    kids, leaves, saved = Counter(), Counter(), Counter()
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p in nodes:
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c, e in sorted(members) if e)
        parent = min(c for c, _ in nodes[p[:-1]]) if p else None
        out.append((min(members)[0], len(p), parent, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("shard_nodes, shards, most", [(trie.SHARD_NODES, trie.SHARDS, trie.IN_MEMORY), (30, 10**9, 5), (1, 10**9, 1), (9, 10**9, 2)])
def test_trie_against_brute_force(spark, shard_nodes, shards, most):
    r = random.Random(11)
    say = lambda: (r.choice(["user", "bot", None]), r.choice(["hi", "ho", "", None, "é" * 5]))
    rows = [(c, t, *say()) for c in range(0, 160) for t in range(r.randrange(1, 14)) if c % 7]
    rows += [(7 * c, t, "user", "same") for c in range(20) for t in range(9)]
    rows += [(1000, t, "bot", f"step {t % 3}") for t in range(300)] + [(1001, None, "bot", "first"), (1001, 2, "bot", "last"), (1003, 5, "a", "x")]
    rows += [(None, 1, "user", "nobody's"), (-7, 0, "user", "below"), (-10, 0, "user", "zero"), (-10, 0, "user", "zero")]
    df = spark.createDataFrame([(*x, 1) for x in rows], TURNS + ", key int")
    got = sorted((tuple(x) for x in trie.trie(df, shard_nodes, shards, most).collect()), key=repr)
    assert got == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)).count() == 0


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_inbox_gives_sums_in_order(most):
    r = random.Random(2)
    keys = [(d, bytes([k])) for d in range(20, 0, -1) for k in range(9)]
    box, want = trie.Inbox(most), Counter()
    for i, at in enumerate(keys):
        for _ in range(r.randrange(4)):
            if i + 1 < len(keys):
                to, n = keys[r.randrange(i + 1, len(keys))], r.randrange(100)
                box.put(*to, n, 2 * n)
                want[to] += n
        assert box.take(*at) == (want[at], 2 * want[at])
