"""Personal data by weak supervision. Built-in functions only.

Strict patterns give the base spans. Looser ones give candidates on which labelers vote: the shape of the value, its
check digits, a gazetteer, the words before it and what speaks against it. Counts of vote patterns over all documents
go into expectation-maximisation, which estimates how reliable each labeler is and how probable each pattern is. With
these as soft labels a classifier of the spans' own tokens and shapes is trained, which decides about all candidates:
also about those on which no labeler has a say.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from tidewater.llm.spans import BEFORE, by_kind, count_kind, digits, listed, luhn, matches, of_kind, within_scope
from tidewater.llm.tables import table
from tidewater.spool import spool

BASE = ("email", "ip", "card", "phone")
#: Each begins at the start of a run, or where the match before ended, and gives nothing back: one pass over a text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
#: Whole runs of 16 digits or more.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Names that begin a person's (with a capital), domains' ends, area codes, issuers' first digits, countries' account lengths.
GAZETTEERS: dict[str, tuple[str, ...]] = {
    "person": tuple("anna ben carla carlos clara daniel david elena emma eva felix francisco georg hans ines james jan jean john jose juan julia karl klaus laura lena lucas luis maria marie mark marta mary michael miguel nina olivia otto pablo paul pedro peter pierre robert rosa sara sofia thomas ursula walter".split()),
    "email_like": tuple("at biz ca ch co com de edu es eu fr gov info int io it mil name net nl org pt uk us".split()),
    "ip_like": ("10", "100", "127", "169", "172", "192", "2001", "fd00", "fe80"),
    "card_like": ("30", "34", "35", "36", "37", "38", *map(str, range(40, 50)), *map(str, range(51, 56)), "60", "62", "64", "65"),
    "local_phone": tuple("201 202 203 205 206 207 208 210 212 213 214 215 216 217 301 302 303 304 305 307 310 312 313 314 315 317 401 402 404 405 406 408 410 412 415 501 502 503 504 505 508 510 512 513 515 516 517 518 601 602 603 605 606 608 609 612 614 615 616 617 701 702 703 704 706 707 712 713 714 716 717 718 773 800 801 802 803 804 805 808 816 818 860 877 888 901 903 904 906 907 908 909 912 913 914 916 918 919".split()),
    "account": ("AT20", "BE16", "CH21", "DE22", "ES24", "FR27", "GB22", "IE22", "IT27", "LU20", "NL18", "PT25"),
}
_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Señor|Señora"
#: Candidates: kind -> (pattern, shape that speaks for it, what of it the gazetteer has, words before it).
CANDIDATES = {
    "email_like": (
        r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)*+",
        r"(?:\.|dot[\])]\x20?)[A-Za-z]{2,8}$",
        r"([A-Za-z]+)$",
        r"(?i)\b(?:e-?mail|mail|contact|write|reach|kontakt|correo|courriel)\b",
    ),
    "ip_like": (
        r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9]|\.[0-9])|(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){2,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
        r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$|::",
        r"^([0-9A-Fa-f]+)",
        r"(?i)\b(?:ip|address|host|server|client|from|adresse|dirección)\b",
    ),
    "card_like": (
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?[0-9])",
        r"^(?:[0-9]{4}[ -]){3}[0-9]{4}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$",
        r"^([0-9]{2})",
        r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte)\b",
    ),
    "local_phone": (
        r"(?<![0-9A-Za-z+.()-])(?:\([0-9]{3}\) |[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
        r"^\(?[2-9][0-8][0-9]\)?[ .-]+[2-9][0-9]{2}",
        r"^\(?([0-9]{3})",
        r"(?i)\b(?:phone|tel|call|mobile|cell|fax|contact|tél|telefon|teléfono|anruf)\b",
    ),
    "national_id": (
        r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
        r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
        "",
        r"(?i)\b(?:ssn|social security|national id|tax id|insured)\b",
    ),
    "account": (
        r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
        r"^[A-Z]{2}(?:0[2-9]|[1-8][0-9]|9[0-8])",
        r"^([A-Z]{2})",
        r"(?i)\b(?:iban|account|konto|cuenta|compte|bank)\b",
    ),
    "person": (
        rf"(?<!\p{{L}})(?:(?:{_TITLES})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?|(?:{'|'.join(n.capitalize() for n in GAZETTEERS['person'])}) \p{{Lu}}\p{{Ll}}+)(?!\p{{L}})",
        rf"^(?:{_TITLES})\b",
        r"(\p{Lu}\p{Ll}+) \p{Lu}\p{Ll}+$",
        r"(?i)\b(?:name|called|by|author|contact|dear|sincerely|von|por|par|sir|madam)\b",
    ),
}
AGAINST = r"(?i)(?:\b(?:no|nr|order|invoice|version|page|isbn|total|item|build|release)\b\.?[:# ]*|[$#€=/])$"
LABELERS = ("shape", "check", "gazetteer", "context", "against")
ROUNDS = 30
KEEP_FROM = 0.5
#: Distinct rows of features and votes, the smallest by hash, that the classifier is trained on at most, with their counts.
TRAIN_ROWS = 20_000
#: Places that the words before and the characters after a candidate share by hash.
PLACES = 64
#: Features of a candidate: its kind, the classes below of one kind, the word before it and the character after it.
STEPS = 300


def _found_in(kind: str, m: Column, gazetteers: Mapping[str, Sequence[str]]) -> Column:
    names = gazetteers.get(kind)
    if not names:
        return F.lit(0)
    own = F.regexp_extract(m, CANDIDATES[kind][2], 1)
    if kind == "account":
        own = F.concat(own, F.length(F.regexp_replace(m, " ", "")).cast("string"))
        return F.when(F.array_contains(F.lit(list(names)), own), 1).otherwise(-1)
    return F.when(F.array_contains(F.lit([n.lower() for n in names]), F.lower(own)), 1).otherwise(0)


def _check(kind: str, m: Column) -> Column:
    """What check digits or ranges say, for the kinds that have any."""
    if kind == "card_like":
        return F.when(luhn(m), 1).otherwise(-1)
    if kind == "ip_like":
        return F.when(F.contains(m, F.lit(".")), -1).otherwise(0)  # four parts up to 255 are base spans
    return F.lit(0)


def _votes(kind: str, span: Column, text: Column, gazetteers: Mapping[str, Sequence[str]]) -> Column:
    _, shape, _, words = CANDIDATES[kind]
    before = F.substring(text, F.greatest(span["start"] - BEFORE + 1, F.lit(1)), F.least(span["start"], F.lit(BEFORE)))
    vote = lambda x, yes, no: F.when(x, yes).otherwise(no).cast("int")
    return F.struct(
        vote(F.regexp_like(span["m"], F.lit(shape)), 1, -1).alias("shape"),
        _check(kind, span["m"]).cast("int").alias("check"),
        _found_in(kind, span["m"], gazetteers).cast("int").alias("gazetteer"),
        vote(F.regexp_like(before, F.lit(words)), 1, 0).alias("context"),
        vote(F.regexp_like(before, F.lit(AGAINST)), -1, 0).alias("against"),
    )


def _features(kind: str, number: int, span: Column, text: Column) -> Column:
    """Places of what a candidate looks like: kind, and with the kind its length, digits, separators, the word before and the character after."""
    m, width = span["m"], len(CANDIDATES)
    n = F.length(m)
    size = F.least(F.floor(n / 4), F.lit(9))
    share = F.floor(9 * F.length(digits(m)) / n)
    marks = sum((F.when(F.contains(m, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate(" -.(")), F.lit(0))
    near = F.substring(text, F.greatest(span["start"] - 24 + 1, F.lit(1)), F.least(span["start"], F.lit(24)))
    word = F.lower(F.regexp_extract(near, r"(\p{L}+|[^\p{L}\s])[^\p{L}]{0,2}$", 1))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    kinds = [(size, 10), (share, 10), (marks, 16), (F.pmod(F.xxhash64(word), F.lit(PLACES)), PLACES), (F.pmod(F.xxhash64(F.regexp_replace(after, r"\p{L}", "a")), F.lit(PLACES)), PLACES)]
    out, at = [F.lit(number)], width
    for value, places in kinds:
        out.append(F.lit(at + number * places) + value.cast("int"))
        at += width * places
    return F.array(*[x.cast("int") for x in out])


N_FEATURES = len(CANDIDATES) * (1 + 10 + 10 + 16 + 2 * PLACES)


def candidates(docs: DataFrame, gazetteers: Mapping[str, Sequence[str]] = GAZETTEERS) -> DataFrame:
    """``doc_id, row, base, loose``: base spans by kind and start, and candidates with their votes and features."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    width = lambda s: F.length(digits(s["m"]))

    def voted(kind: str, number: int):
        return lambda s: F.struct(
            s["start"].alias("start"), F.lit(len(BASE) + number).alias("no"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["m"].alias("m"), _votes(kind, s, text, gazetteers).alias("votes"), _features(kind, number, s, text).alias("features")
        )

    found = docs.select(
        F.col("doc_id").alias("doc_id"),
        matches(text, EMAIL).alias("email"),
        F.filter(matches(text, IP), lambda s: F.regexp_like(s["m"], F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))).alias("ip"),
        F.filter(matches(text, CARD), lambda s: width(s).between(16, 19) & luhn(s["m"])).alias("card"),
        F.filter(matches(text, PHONE), lambda s: width(s).between(8, 15)).alias("phone"),
        *[F.transform(matches(text, p[0]), voted(k, i)).alias(k) for i, (k, p) in enumerate(CANDIDATES.items())],
    )
    base = F.concat(*[of_kind(F.col(k), k, i) for i, k in enumerate(BASE)])
    return found.select("doc_id", F.monotonically_increasing_id().alias("row"), by_kind(base).alias("base"), F.concat(*CANDIDATES).alias("loose"))


def estimate(patterns: list[Row]) -> dict[tuple, float]:
    """EM over counts of vote patterns (``kind``, a vote for each labeler, ``n``): how probable each pattern is personal.

    A labeler votes independently given the truth; its chances of each vote are shared by the kinds, the share of
    true candidates is each kind's own. Starts from labelers that are right in 8 of 10 votes.
    """
    kinds = sorted({p["kind"] for p in patterns})
    prior = dict.fromkeys(kinds, 0.5)
    start = {(t, v): 1 / 3 if v == 0 else (8 if v == t else 2) / 15 for t in (1, -1) for v in (-1, 0, 1)}
    chance = {(t, x, v): start[t, v] for t in (1, -1) for x in LABELERS for v in (-1, 0, 1)}
    truth: dict[tuple, float] = {}
    for _ in range(ROUNDS):
        for p in patterns:
            yes, no = prior[p["kind"]], 1 - prior[p["kind"]]
            for x in LABELERS:
                yes, no = yes * chance[1, x, p[x]], no * chance[-1, x, p[x]]
            truth[p["kind"], *(p[x] for x in LABELERS)] = yes / (yes + no)
        weigh = [(p, p["n"], truth[p["kind"], *(p[x] for x in LABELERS)]) for p in patterns]
        for k in kinds:
            own = [(n, t) for p, n, t in weigh if p["kind"] == k]
            prior[k] = (1 + sum(n * t for n, t in own)) / (2 + sum(n for n, _ in own))
        for x in LABELERS:
            for t in (1, -1):
                mass = {v: start[t, v] for v in (-1, 0, 1)}
                for p, n, q in weigh:
                    mass[p[x]] += n * (q if t == 1 else 1 - q)
                for v in mass:
                    chance[t, x, v] = mass[v] / sum(mass.values())
    return truth


def train(rows: list[Row], truth: dict[tuple, float]) -> list[float]:
    """Logistic regression of the estimated probabilities on features (``features``, a vote for each labeler, ``kind``, ``n``): a weight for each place."""
    weights = np.zeros(N_FEATURES)
    if not rows:
        return weights.tolist()
    at = np.array([r["features"] for r in rows])
    n = np.array([r["n"] for r in rows], float)
    aim = np.array([truth[r["kind"], *(r[x] for x in LABELERS)] for r in rows])
    mean, square = np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for step in range(1, STEPS + 1):
        miss = (1 / (1 + np.exp(-weights[at].sum(axis=1))) - aim) * n
        slope = np.bincount(at.ravel(), np.repeat(miss, at.shape[1]), N_FEATURES) / n.sum() + 1e-4 * weights
        mean += 0.1 * (slope - mean)
        square += 0.01 * (slope**2 - square)
        weights -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return weights.tolist()


def find(docs: DataFrame, gazetteers: Mapping[str, Sequence[str]] = GAZETTEERS) -> DataFrame:
    """``doc_id, text`` in; ``doc_id, base, added`` out, arrays of spans (start, no, end, kind, m).

    The texts are read once and never shuffled; what is found in them is written out. Candidates that overlap a base
    span are left aside (an interval join over bins of a text). Votes are counted over all others, at most 7 kinds
    times 243 patterns, and the classifier trained on at most ``TRAIN_ROWS`` distinct rows; then all are decided. Null
    texts count as empty; repeated rows each have a row; other columns are left out; an empty table gives an empty one.
    """
    found = spool(candidates(docs, gazetteers))
    open_ = found.where(F.size("loose") > 0)
    loose = open_.select("row", F.explode("loose").alias("c")).select("row", "c.start", "c.end", "c")
    base = open_.select("row", F.explode("base").alias("b")).select("row", "b.start", "b.end")
    taken = within_scope(loose.drop("c"), base, 0, F.lit(True), apart=False)
    clear = spool(loose.join(taken, ["row", "start", "end"], "left_anti").select("row", "c"))
    votes = [F.col("c.votes")[x].alias(x) for x in LABELERS]
    counted = clear.groupBy("c.kind", *votes).agg(F.count("*").alias("n"))
    truth = estimate(sorted(counted.collect()))
    shown = clear.groupBy("c.kind", "c.features", *votes).agg(F.count("*").alias("n"))
    rows = shown.orderBy(F.xxhash64("kind", "features", *LABELERS)).limit(TRAIN_ROWS).collect()
    weights = F.lit(train(rows, truth))
    score = F.aggregate("c.features", F.lit(0.0), lambda s, i: s + F.element_at(weights, i + 1))
    cut = math.log(KEEP_FROM / (1 - KEEP_FROM))
    span = F.struct(*[F.col("c")[x].alias(x) for x in ("start", "no", "end", "kind", "m")])
    added = clear.where(score > cut).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("added"))
    none = F.slice("base", 1, 0)
    rest = found.where(F.size("loose") == 0).select("doc_id", "base", none.alias("added"))
    return rest.unionByName(open_.join(added, "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added")))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count_kind(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(by_kind(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
