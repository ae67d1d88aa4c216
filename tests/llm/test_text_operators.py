"""Text operators against brute force, and on nulls, empty texts, repeats, ties, extra columns and empty tables."""

import hashlib
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import bpe, golay, language, lines, mixing, pii, secrets, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta omega river water level station mesh node flow".split()


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 60))), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, rows[3][1], "en", None, 0), (3, rows[3][1], "en", "s0", 0), (None, "no id here", "en", "s1", 0), (103, "é" * 40 + "\n" + "x y\n" * 3000, "fr", "s2", 1)]
    return frame(spark, rows).withColumns({"size": F.lit("clash"), "fp": F.lit(1), "score": F.lit(None).cast("double"), "kind": F.lit("k")})


def empty(spark):
    return frame(spark, [])


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_mix_reaches_targets_and_agrees(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert all(r["size"] == n_words(r["text"]) and 0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        t = by.setdefault(r["source"], [r["target"], 0, r["source_size"]])
        t[1] += r["taken"]
    assert None in by and sum(t[0] for t in by.values()) == pytest.approx(1.5 * sum(t[2] for t in by.values()))
    largest = {s: max(r["size"] for r in got if r["source"] == s) for s in by}  # documents are taken whole
    assert all(abs(t[1] - t[0]) <= largest[s] / 2 and t[0] <= 2 * t[2] for s, t in by.items())
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).columns == empty(spark).columns


def test_documents_without_an_id_are_taken_whatever_their_size(spark):
    rows = [(None, " ".join(["w"] * (1 + i % 50)) + f" {i}", "en", "s", 0) for i in range(600)] + [(1, "x " * 3000, "en", "t", 0)]
    got = mixing.mix(frame(spark, rows, SCHEMA), weights=(1, 2), share=0.9).where("source = 's'").collect()
    out = [r["size"] for r in got if not r["copies"]]
    mean = sum(r["size"] for r in got) / len(got)
    assert 50 < len(out) < 550 and abs(sum(out) / len(out) - mean) < 0.12 * mean


def test_mix_with_document_weights_prefers_heavy_ones(spark):
    rows = [(i, "a b c d", "en", "s", 0, 4.0 if i % 2 else 1.0) for i in range(400)] + [(1000 + i, "a b c d", "en", "t", 0, 1.0) for i in range(400)]
    got = mixing.mix(frame(spark, rows, SCHEMA + ", w double"), weights=(1, 5), share=1.0, document_weight="w").where("source = 's'").collect()
    heavy, light = (sum(r["copies"] for r in got if r["doc_id"] % 2 == k) for k in (1, 0))
    assert heavy > 2.5 * light and abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 4


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(ids, linked):
    label = {i: i for i in ids}
    while True:
        new = {i: min(label[j] for j in ids if i == j or linked(i, j)) for i in ids}
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("pairwise", [simhash.PAIRWISE, 1])
def test_simhash_components(spark, docs, monkeypatch, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    got = simhash.near_duplicates(docs).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(got) == len(texts)
    fps = {f: brute_fingerprint(f) for f in {t for _, t in texts}}
    assert sorted((r["doc_id"] or -1, r["fp"] % (1 << 64)) for r in got) == sorted((i or -1, fps[t]) for i, t in texts)
    label = components(sorted(set(fps.values())), lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for i, t in texts:
        if i is not None:
            least[label[fps[t]]] = min(least.get(label[fps[t]], i), i)
    assert all(r["component_id"] == least.get(label[r["fp"] % (1 << 64)]) for r in got)
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("pairwise", [64, 1])
def test_links_of_close_fingerprints(spark, monkeypatch, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ sum(1 << i for i in r.sample(range(64), r.randrange(0, 5))) for b in base for _ in range(40)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = {tuple(sorted((e["a"], e["b"]))) for e in simhash.linked(frame(spark, [(f,) for f in signed], "fp long")).collect()}
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    pairs = lambda a, b: tuple(sorted((a, b))) in edges
    assert components(signed, near) == components(signed, pairs)


def test_golay_words_two_bits_apart_share_an_index():
    import numpy as np

    x = np.random.default_rng(2).integers(0, 1 << 23, 3000)
    for a, b in ((0, 0), (0, 1), (3, 17), (21, 22)):
        y = x ^ (1 << a) ^ (1 << b)
        one, two = golay.near_indices(x), golay.near_indices(y)
        assert ((one[:, :, None] == two[:, None, :]) & (one[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_keep_one_each_keeps_clean_documents(spark, docs):
    kept = simhash.keep_one_each(docs.drop("fp"))
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 3 in ids and 102 not in ids and None in ids


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_secrets(spark):
    weak = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
    texts = ['PassWord = "abcdefgh" token:short', "AKIA1234567890ABCD é " + "0a" * 20, f"key {weak}", f"AKIAABCDEFGHIJKL12 and {weak} at https://x.y/z", f"AKIAABCDEFGHIJKL12 {'pad ' * 300} {weak}", "f" * 100_000, "", None, 'secret=token:"abcdefghij"', "😀 api_key='abcd1234'"]
    got = {r["doc_id"]: r for r in secrets.scan(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
        assert [(s["start"], s["end"]) for s in got[i]["base"] if s["kind"] == "assign"] == want
        for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)):
            assert [(s["start"], s["end"]) for s in got[i]["base"] if s["kind"] == kind] == [m.span() for m in re.finditer(pattern, t) if len(m[0]) >= least]
    assert {s["kind"] for s in got[3]["linked"]} == {"weak_secret", "endpoint"}
    assert not got[2]["linked"] and not got[4]["linked"]
    assert secrets.scan(empty(spark)).count() == 0


def test_linked_parts_against_brute_force(spark):
    """Thousands of texts with parts near their counterparts, far from them, alone and overlapping."""
    r = random.Random(12)
    alnum = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    part = {
        "access": lambda: "AKIA" + "".join(r.choice(alnum) for _ in range(16)),
        "weak_id": lambda: r.choice(["ASIA" + "".join(r.choice(alnum) for _ in range(16)), "user = bob.w", "client_id: 'x99y'"]),
        "weak_secret": lambda: r.choice(["".join(r.choice("abcXYZ0189+/") for _ in range(40)), "pwd=hunter2!", "token: abc12"]),
        "hex": lambda: "%032x" % r.getrandbits(128),
        "assign": lambda: "password = longenough1",
        "endpoint": lambda: r.choice(["https://h.example/p?q=1", "host: db.internal"]),
    }
    rows = []
    for i in range(3000):
        text = ""
        for _ in range(r.randrange(0, 7)):
            text += "lorem é ipsum. " * r.choice([0, 1, 2, 26, 27, 60]) + r.choice([*part.values()])() + r.choice([" ", "\n", ", "])
        rows.append((i, text, None, None, None))
    patterns = dict(zip(secrets.KINDS, (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.WEAK_ID, secrets.WEAK_SECRET, secrets.ENDPOINT), strict=True))
    got = {x["doc_id"]: x for x in secrets.scan(frame(spark, rows).withColumns({"row": F.lit("clash"), "base": F.lit(1)})).collect()}
    assert len(got) == len(rows)
    kinds = {k: 0 for k in secrets.NEEDS}
    for i, text, *_ in rows:
        spans = []
        for no, (k, p) in enumerate(patterns.items()):
            for m in re.finditer(p, text):
                own = m[0]
                if k == "assign" and len(m[1]) < 8 or k == "weak_secret" and re.fullmatch("[A-Za-z0-9+/]{40}", own) and not (re.search("[0-9]", own) and re.search("[a-z]", own) and re.search("[A-Z]", own)):
                    continue
                spans.append((m.start(), no, m.end(), k))
        near = lambda s, role: any(secrets.ROLES[o[3]] == role and o[0] <= s[2] + secrets.SCOPE and o[2] >= s[0] - secrets.SCOPE and (o[2] <= s[0] or o[0] >= s[2]) for o in spans)  # noqa: E731, B023
        want = sorted(s for s in spans if s[3] in secrets.NEEDS and all(near(s, n) for n in secrets.NEEDS[s[3]]))
        assert [(s["start"], s["no"], s["end"], s["kind"]) for s in got[i]["linked"]] == want
        assert [(s["start"], s["no"], s["end"], s["kind"]) for s in got[i]["base"]] == sorted(s for s in spans if s[3] not in secrets.NEEDS)
        for s in want:
            kinds[s[3]] += 1
    assert min(kinds.values()) > 100


def test_personal_data(spark):
    texts = ["mail a.b@c.de..x@y.z!", "ip 1.2.3.4.5 and 256.1.1.1, 10.0.0.001", "card 4111 1111 1111 1111 or 4111111111111112", "call +1 (212) 555-0100.", "phone: 212-555-0100 or ssn 123-45-6789", "order #212-555-0100", "1." * 2000, "", None]
    got = {r["doc_id"]: r for r in pii.find(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    spans = lambda i, what="base": [(s["kind"], texts[i][s["start"] : s["end"]]) for s in got[i][what]]
    assert spans(0) == [("email", "a.b@c.de"), ("email", "..x@y.z")]
    assert spans(1) == [("ip", "1.2.3.4"), ("ip", "10.0.0.001")]
    assert spans(2) == [("card", "4111 1111 1111 1111")] and spans(3) == [("phone", "+1 (212) 555-0100")]
    assert ("local_phone", "212-555-0100") in spans(4, "added")
    assert len(got[6]["base"]) == 500 and got[7]["base"] == got[8]["base"] == []
    assert pii.find(empty(spark)).count() == 0


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_base_spans_of_personal_data_against_brute_force(spark):
    r = random.Random(21)
    bits = ["a.b@c.de", "@", ".", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+49 30 1", "0123456789012345", "é", " ", "-", "x", "+", "12", "user@host", "\n"]
    rows = [(i, "".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(0, 25))), None, None, None) for i in range(1500)]
    got = {x["doc_id"]: x["base"] for x in pii.find(frame(spark, rows).withColumns({"row": F.lit("clash"), "loose": F.lit(1)})).collect()}
    n = lambda m: re.sub("[^0-9]", "", m)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(n(m)) <= 19 and luhn(n(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(n(m)) <= 15),
    }
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        want = [(k, m.start(), m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0])]
        assert [(s["kind"], s["start"], s["end"]) for s in got[i]] == want


def test_classifier_learns_from_votes(spark):
    """Planted spans and look-alikes: precision and recall of what is added, of all and of those without any word near them."""
    r = random.Random(6)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    true = [
        lambda: ("local_phone", f"phone: {r.choice(pii.GAZETTEERS['local_phone'])}-{r.randrange(200, 999)}-{digits(4)} "),
        lambda: ("local_phone", f"call ({r.choice(pii.GAZETTEERS['local_phone'])}) {r.randrange(200, 999)}-{digits(4)} "),
        lambda: ("national_id", f"ssn {r.randrange(100, 600)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)} "),
        lambda: ("account", f"iban DE{r.randrange(10, 98)}{digits(18)} "),
        lambda: ("email_like", f"mail bob{digits(2)} (at) example (dot) org "),
        lambda: ("person", f"Dear Mr. {r.choice(['Smith', 'Muller', 'Lopez'])}, "),
        lambda: ("local_phone", f"lorem {r.choice(pii.GAZETTEERS['local_phone'])}-{r.randrange(200, 999)}-{digits(4)} "),
    ]
    false = [
        lambda: ("local_phone", f"order #{digits(3)}-{digits(3)}-{digits(4)} "),
        lambda: ("local_phone", f"page 0{digits(2)}.1{digits(2)}.{digits(4)} "),
        lambda: ("national_id", f"invoice 000-{digits(2)}-{digits(4)} "),
        lambda: ("account", f"version ZZ99{digits(12)} "),
        lambda: ("card_like", f"item 99{digits(13)} "),
        lambda: ("ip_like", f"build {r.randrange(300, 999)}.{digits(2)}.1.{digits(2)} "),
    ]
    rows, truth = [], {}
    for i in range(1200):
        text = ""
        for _ in range(r.randrange(1, 5)):
            text += "lorem ipsum dolor " * r.randrange(1, 3)
            real = r.random() < 0.5
            kind, piece = r.choice(true if real else false)()
            truth[i, kind, len(text) + re.search(r"[0-9(]|bob|Mr|DE|ZZ", piece).start()] = real
            text += piece
        rows.append((i, text, None, None, None))
    got = {(x["doc_id"], s["kind"], s["start"]) for x in pii.find(frame(spark, rows)).collect() for s in x["added"]}
    found = {k for k, v in truth.items() if v}
    assert len(got & found) >= 0.95 * len(found) and len(got & found) >= 0.95 * len(got), (len(got & found), len(found), len(got))


def test_votes_teach_which_labelers_to_trust():
    row = lambda n, *v: {"kind": "local_phone", **dict(zip(pii.LABELERS, v, strict=True)), "n": n, "features": [0, 1 + (v[0] > 0), 40, 90, 200, 700]}
    patterns = [row(60, 1, 0, 1, 1, 0), row(50, -1, 0, 0, 0, -1), row(20, 1, 0, 0, 1, 0), row(15, -1, 0, 0, 0, 0)]
    truth = pii.estimate(patterns)
    assert truth["local_phone", 1, 0, 1, 1, 0] > 0.9 and truth["local_phone", -1, 0, 0, 0, -1] < 0.1
    weights = pii.train(patterns, truth)
    assert weights[2] > 0 > weights[1]


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(q[-1] + 1, p[j + 1] + 1, p[j] + (x != y)))
        p = q
    return p[-1]


def mutated(r, s, most):
    s = list(s)
    for _ in range(r.randrange(0, most + 1)):
        i, k = r.randrange(len(s) + 1), r.random()
        if k < 0.4 or not s:
            s.insert(i, r.choice("abé"))
        elif k < 0.7:
            del s[min(i, len(s) - 1)]
        else:
            s[min(i, len(s) - 1)] = r.choice("abé")
    return "".join(s)


def test_edit_distance_and_keys(monkeypatch):
    monkeypatch.setattr(lines, "LEAST_CHARS", 6)
    r = random.Random(0)
    for _ in range(1500):
        a = "".join(r.choice("abé") for _ in range(r.randrange(0, 40)))
        b = mutated(r, a, 4)
        for t in (1, 2, 3):
            near = edit(a, b) <= t
            assert lines.within(a, b, t) == near
            if near and a != b and min(len(a), len(b)) >= 6:
                x = lines.Lines([a, b])
                own, more = (k.to_pylist() for k in x.keys(np.array([True, True]), lambda n: t + 0 * n))
                i, j = (0, 1) if x.size[0] <= x.size[1] else (1, 0)
                assert set(own[i]) & set(own[j] + more[j])


def test_pairs_side_by_side_are_as_one_by_one():
    r = random.Random(3)
    ones, others, bounds = [], [], []
    for _ in range(1500):
        a = "".join(r.choice("abé") for _ in range(r.randrange(0, 60)))
        ones.append(a)
        others.append(mutated(r, a, 6) if r.random() < 0.8 else "".join(r.choice("abé") for _ in range(len(a))))
        bounds.append(r.choice([1, 2, 3, 5, 31, 40]))
    want = [edit(a, b) <= k for a, b, k in zip(ones, others, bounds, strict=True)]
    assert lines.within_all(ones, others, bounds).tolist() == want and 100 < sum(want) < 1400
    assert [lines.within(a, b, k) for a, b, k in zip(ones, others, bounds, strict=True)] == want


@pytest.mark.parametrize("numbered", [lines.NUMBERED, 2])
def test_long_lines_within_their_edits_share_a_key(monkeypatch, numbered):
    monkeypatch.setattr(lines, "NUMBERED", numbered)
    r = random.Random(8)
    for n in [r.randrange(32, 900) for _ in range(400)]:
        a = "".join(r.choice("abcdefgh ") for _ in range(n - 2)).join("xx")
        b = mutated(r, a, lines.most_edits(n) + 1)
        if a != b and lines.within(a, b, lines.most_edits(min(len(a), len(b)))) and min(len(a), len(b)) >= 32:
            x = lines.Lines([a, b])
            own, more = (k.to_pylist() for k in x.keys(np.array([True, True])))
            i, j = (0, 1) if x.size[0] <= x.size[1] else (1, 0)
            assert set(own[i]) & set(own[j] + more[j])
            own, more = (k.to_pylist() for k in x.fine_keys())
            assert len(own[i]) % 2 == 0 and sum(k in set(more[j]) for k in own[i]) > len(own[i]) // 2


def test_line_dedup(spark):
    long = "the quick brown fox jumps over the lazy dog 12"
    rows = [(1, f"{long}\nshort\nshort", "en", "s", 0), (2, f"x\n{long.upper().replace('12', '77')}", "en", "s", 0), (3, long.replace("quick", "quik"), "en", "s", 0), (4, long.replace("quick", "slow"), "en", "s", 0), (5, None, None, None, None), (6, "", "en", "s", 0), (7, f"{long}s\n{long}", "en", "s", 0), (None, long, "en", "s", 0)]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("x", 1) and got[3] == ("", 1) and got[4][1] == 0
    assert got[5] == (None, 0) and got[6] == ("", 0) and got[7] == ("", 2) and got[None] == ("", 1)
    stay = {r["doc_id"] for r in lines.dedup_documents(frame(spark, rows)).collect()}
    assert stay == {1, 2, 4, 5, 6}
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_bpe_same_as_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    r = random.Random(4)
    bits = ["a", " ", "  ", "\n", "'s", "é", "1", "<|endoftext|>", ".", "\x00", "\xa0", "zz", "ſ", "٣", "\x1c", "the", " the", "😀"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 40))) for _ in range(400)] + ["ab" * 20_000, "e" * 5000, "", "a" * 1_000_000, "".join(r.choice("etaoinshr") for _ in range(60_000)), " ".join("x" * n for n in range(1, 60))]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x for x in bpe.encode_documents(frame(spark, [*rows, (9999, None, None, None, None)]), keep_ids=True).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t, add_special_tokens=False).ids
        assert got[i]["ids"] == want and got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert got[i]["decoded"] == library.decode(want, skip_special_tokens=False)
    assert got[9999]["n_tokens"] == 0
    assert bpe.encode_documents(docs).count() == docs.count() and bpe.encode_documents(empty(spark)).count() == 0


def test_forward_backward_is_exact():
    import numpy as np

    rng = np.random.default_rng(0)
    text = np.repeat([0, 2, 3, 5], [1, 64, 130, 300])
    scores = rng.normal(size=(len(text), 3))
    model = language.Model(list("abc"), None, rng.normal(size=3), rng.normal(size=(3, 3)))
    got = language.forward_backward(scores, text, model)
    a = np.exp(model.moves)
    for t in set(text.tolist()):
        e = np.exp(scores[text == t])
        f, b = [np.exp(model.start) * e[0]], [np.ones(3)]
        for k in range(1, len(e)):
            f.append((f[-1] / f[-1].sum()) @ a * e[k])
            b.insert(0, a @ (e[-k] * b[0] / b[0].sum()))
        want = np.array(f) * np.array(b)
        assert np.allclose(got[text == t], want / want.sum(axis=1, keepdims=True))


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = frame(spark, [(9001, None, "en", "s", 0), (9002, "123 ... !!", "de", "s", 0), (9003, "", None, "s", 0)])
    model = language.train(docs)
    assert model.languages == sorted(model.languages) and len(model.languages) > 1
    got = language.identify(docs.unionByName(extra), model).withColumn("held_out", language.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 9000]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.9 * len(held)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] > 9000)
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = language.train(empty(spark))
    assert {r["lang_pred"] for r in language.identify(extra, nothing).collect()} == {"und"}
    assert language.identify(empty(spark), model).count() == 0


def test_code_switched_words_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('en', 'de')")
    model = language.train(docs)
    one, two = (docs.where(F.col("lang") == x).where("char_length(text) between 300 and 900").orderBy("doc_id").first()["text"].encode() for x in ("en", "de"))
    own = language.read_words([one + b" " + two])
    chances = language.forward_backward(own.scores(model.weights)[own.which], own.text, model)
    cut = len(language.read_words([one]).text)
    at = model.languages.index("en")
    assert (chances[:cut, at] > 0.5).mean() > 0.9 and (chances[cut:, at] < 0.5).mean() > 0.9
