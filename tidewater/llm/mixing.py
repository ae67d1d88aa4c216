"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidewater.llm.tables import table, word_count
from tidewater.spool import spool

#: The order of a source's documents is dealt into so many ranges, so that no task orders a whole source.
BINS = 4096
#: Sources up to which a table of them is broadcast; beyond it, it is shuffled.
BROADCAST_ROWS = 20_000
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2


def random_share(key: Column, seed: int) -> Column:
    """A number between 0 and 1 that depends on the key and the seed only."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def _small(df: DataFrame) -> DataFrame:
    """A spooled table, marked for broadcast only if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """``source, size`` (one row a source) in; ``source, source_size, target`` out.

    By code point, null last, sources take the weights in turn. Each gets a part of ``share`` times all sizes by
    weight, at most ``most`` times its own size; what is cut off goes to the others by weight until none is above.
    Only sums come to the driver; the list of sources (not of documents) is numbered in one task.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    own = spool(
        sources.select("source", F.col("size").alias("source_size"), F.element_at(listed, turn % len(weights) + 1).alias("w"))
        .withColumn("most", F.col("source_size") * float(most))
    )
    level, stopped = 0.0, -1
    while True:
        at = own.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(F.col("w") * level > F.col("most"), F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(F.col("w") * level <= F.col("most"), F.col("w"))), F.lit(0.0)),
            F.count_if(F.col("w") * level > F.col("most")),
        ).first()
        if at[3] == stopped or not at[2]:
            break
        level, stopped = (at[0] * share - at[1]) / at[2], at[3]
    return own.select("source", "source_size", F.least(F.col("w") * level, F.col("most")).alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
    seed: int = 1,
    document_weight: str | None = None,
    size: Column | None = None,
) -> DataFrame:
    """All rows of ``docs`` (needs ``doc_id, text, source``, no text where ``size`` is given) with ``size, source_size, target, copies, taken``.

    A document is expected in the mix (target / source size) times, more or less by ``document_weight`` (a column
    of positive numbers) if one is named, at most ``most`` times. The whole part of that number is allocated for
    certain. For one more copy, documents of a source are ranked by random odds divided by the odds of their
    fraction, and taken in this order until the source's words are reached; the last place goes to the document
    whose size fits the words still missing best. ``taken`` is copies times size.

    Sizes are words; a null text has 0, and a document of size 0 takes no words. A null source is a source of its
    own. Repeated rows are separate documents; those equal in every column tie, and any of them may be the one
    taken. Rows without a ``doc_id`` are ranked by random numbers of their whole content. Columns of ``docs`` with one of the names added are
    replaced; all others stay, whatever their name. An empty table gives an empty one. Reruns agree.

    Texts are never shuffled: what is taken of a source is told by the last rank taken, so each row decides by
    itself next to its source's line of the plan.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    words = word_count(F.col("text").cast("string")) if size is None else size
    weight = F.coalesce(F.col(document_weight).cast("double"), F.lit(1.0)) if document_weight else F.lit(1.0)
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))])
    facts = F.struct(F.col("source").alias("source"), words.alias("size"), weight.alias("weight"), F.col("doc_id").alias("doc_id"), random_share(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), whole.cast("string"))), seed).alias("u"), whole.alias("tie"))
    narrow = spool(docs.select(facts.alias("f")).select("f.*"))
    plan = _plan(narrow, weights, share, most)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added]).alias("row"), facts.alias("f"))
    placed = rows.join(_small(plan.withColumnRenamed("source", "of")), F.col("f.source").eqNullSafe(F.col("of")))
    placed = placed.withColumn("o", F.struct(*_order("f.")))
    extra = _taken(F.col("o"))
    if not plan.where("ties > 0").isEmpty():
        # Of rows that are equal in everything, and stand where the taking stops, so many get one more.
        ends = (F.col("ties") > 0) & ((F.col("o") == F.col("cut")) | (F.col("o") == F.col("last")))
        rest = placed.where(~F.coalesce(ends, F.lit(False))).withColumn("extra", extra)
        nth = F.row_number().over(Window.partitionBy("of", "o").orderBy(F.lit(0)))
        due = F.when(F.col("o") == F.col("cut"), F.col("cut_taken")).otherwise(0) + F.coalesce(F.col("o") == F.col("last"), F.lit(False)).cast("int")
        placed = rest.unionByName(placed.where(F.coalesce(ends, F.lit(False))).withColumn("extra", nth <= due))
    else:
        placed = placed.withColumn("extra", extra | F.coalesce(F.col("o") == F.col("last"), F.lit(False)))
    certain, _ = _expected(F.col("f.weight"), most)
    copies = (certain + F.col("extra").cast("int")).cast("int")
    return placed.select("row.*", F.col("f.size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("f.size")).alias("taken"))


def _expected(weight: Column, most: int) -> tuple[Column, Column]:
    """Copies of a document that are certain, and the fraction of one more; needs its source's ``rate``."""
    expected = F.least(F.col("rate") * weight, F.lit(float(most)))
    certain = F.floor(expected).cast("int")
    return certain, expected - certain


def _rank(u: Column, part: Column) -> Column:
    """Random odds over inclusion odds, o, as o / (1 + o): the same order, between 0 and 1; 2 where no more is due."""
    return F.when(part > 0, u * (1 - part) / (u * (1 - part) + (1 - u) * part)).otherwise(2.0)


def _order(f: str = "") -> list[Column]:
    """What a source's documents are ordered by; needs its ``rate`` and ``most``."""
    c = lambda n: F.col(f + n)
    expected = F.least(F.col("rate") * c("weight"), F.col("most"))
    return [_rank(c("u"), expected - F.floor(expected).cast("int")).alias("rank"), c("doc_id").isNull().alias("none"), c("doc_id").alias("doc_id"), c("tie").alias("tie"), c("size").alias("size")]


def _taken(o: Column) -> Column:
    """Whether a document's rank is before the end of what its source takes."""
    return (o["rank"] < 2) & ((o["rank"] < F.col("from")) | F.coalesce(o <= F.col("cut"), F.lit(False)))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def _plan(narrow: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """One row a source: ``source, source_size, target, rate, most`` and where its taking ends.

    Ranks below ``from`` are taken, and those up to ``cut`` in the order of ``_order``; besides the document ``last``.
    ``cut_taken`` of the rows equal to ``cut`` are taken; ``ties`` is above 0 if equal rows part at ``cut`` or ``last``.

    Ranks are spread evenly over ``BINS`` ranges, whose sums tell the one where the words run out; that one is dealt
    out again in as many, so that of a source only 1 in ``BINS`` squared is ever put in order.
    """
    sums = spool(narrow.groupBy("source").agg(F.sum("size").alias("size"), F.sum(F.col("weight") * F.col("size")).alias("weighted")))
    rate = F.when(F.col("weighted") > 0, F.col("target") / F.col("weighted")).otherwise(0.0)
    aims = targets(sums, weights, share, most).alias("t").join(sums.alias("s"), _same("t", "s"))
    aims = spool(aims.select("t.source", "source_size", "target", rate.alias("rate"), F.lit(float(most)).alias("most")))
    certain, part = _expected(F.col("weight"), most)
    ranked = narrow.alias("n").join(_small(aims.select("source", "rate", "most")).alias("a"), _same("n", "a")).withColumns({"certain": certain, "part": part})
    means = ranked.groupBy("n.source").agg(F.sum(F.col("certain") * F.col("size")).alias("sure"), F.avg(F.when(F.col("part") > 0, F.col("part"))).alias("mean"))
    open_ = spool(aims.alias("a").join(means.alias("m"), _same("a", "m")).select("a.source", (F.col("target") - F.col("sure")).alias("open"), "mean"))
    # Only documents with a fraction of a copy are in the race: a source that is taken in whole copies has none.
    race = ranked.where("part > 0").select("n.source", "size", F.struct(*_order()).alias("o")).alias("r").join(_small(open_).alias("p"), _same("r", "p"))
    race = spool(race.select("r.source", "size", "o", "open", "mean"))
    # Even between 0 and 1 where all fractions are alike, in any case in the order of the ranks.
    even = F.col("o.rank") * F.col("mean") / (F.col("o.rank") * F.col("mean") + (1 - F.col("o.rank")) * (1 - F.col("mean")))
    left = race.select("source", "size", "o", "open", (even * BINS).alias("at"))
    for _ in range(2):
        left = left.withColumn("bin", F.floor("at").cast("int"))
        bins = left.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.min("o.rank").alias("from"), F.first("open").alias("open"))
        upto = bins.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
        stop = upto.where("upto > open").groupBy("source").agg(F.min(F.struct("bin", (F.col("open") - F.col("upto") + F.col("words")).alias("open"), "from")).alias("s"))
        stop = spool(stop.select("source", "s.*"))
        left = left.alias("b").join(_small(stop).alias("s"), _same("b", "s") & (F.col("b.bin") == F.col("s.bin")))
        left = spool(left.select("b.source", "size", "o", "s.open", ((F.col("at") - F.col("b.bin")) * BINS).alias("at")))
    ordered = left.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)))
    stays = F.col("upto") <= F.col("open")
    alike = ordered.groupBy("source", "o").agg(F.count_if(stays).alias("in"), F.count("*").alias("of"), F.sum(F.when(stays, F.col("size")).otherwise(0)).alias("words"))
    cuts = alike.groupBy("source").agg(F.max(F.when(F.col("in") > 0, F.struct("o", "in", "of"))).alias("c"), F.sum("words").alias("words"))
    ends = stop.alias("s").join(cuts.alias("c"), _same("s", "c"))
    ends = spool(ends.select("s.source", "from", F.col("c.o").alias("cut"), F.coalesce("c.in", F.lit(0)).alias("cut_taken"), F.coalesce("c.of", F.lit(0)).alias("cut_of"), (F.col("open") - F.col("words")).alias("gap")))
    # The document that fits best what is still missing, of those not taken.
    others = race.alias("r").join(_small(ends).alias("e"), _same("r", "e")).withColumn("off", F.abs(F.col("size") - F.col("gap"))).where("size > 0 and off < gap")
    others = others.where(~_taken(F.col("o")) | F.coalesce((F.col("o") == F.col("cut")) & (F.col("cut_taken") < F.col("cut_of")), F.lit(False)))
    last = spool(others.groupBy("r.source").agg(F.min(F.struct("off", "o")).alias("l")).select("source", F.col("l.o").alias("last")))
    equal = race.alias("r").join(_small(last).alias("l"), _same("r", "l")).where("o = last").groupBy("r.source").agg(F.count("*").alias("last_of"))
    out = aims.alias("a").join(ends.alias("e"), _same("a", "e"), "left").join(last.alias("l"), _same("a", "l"), "left").join(equal.alias("q"), _same("a", "q"), "left")
    ties = F.coalesce((F.col("cut_taken") < F.col("cut_of")).cast("int"), F.lit(0)) + F.coalesce((F.col("last_of") > 1).cast("int"), F.lit(0))
    return spool(out.select("a.*", F.coalesce("from", F.lit(2.0)).alias("from"), "cut", F.coalesce("cut_taken", F.lit(0)).alias("cut_taken"), "last", ties.alias("ties")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it was taken."""
    chosen = mix(docs.select(F.struct("*").alias("row"), "doc_id", "text", "source"), **options)
    return chosen.where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each."""
    docs = table(spark, sf_dir, "documents")
    # Only the sizes are shuffled, not the texts.
    sized = docs.select("doc_id", "source", word_count(F.col("text").cast("string")).alias("words"))
    return mix(sized, size=F.col("words")).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long"), "source", "copies")


OP1_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), sums as (
  select source, sum(size)::bigint as source_size,
    case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w
  from sized group by source
), capped as (
  select *, coalesce(sum(2.0::double * source_size) over (order by 2.0::double * source_size / w, source rows between unbounded preceding and 1 preceding), 0) as cut_before,
    sum(w) over (order by 2.0::double * source_size / w, source rows between current row and unbounded following) as w_left,
    sum(source_size) over () as everything
  from sums
), level as (
  select max((everything * 1.5::double - cut_before) / w_left) as level from capped
  where (everything * 1.5::double - cut_before) / w_left * w <= 2.0::double * source_size
), plan as (
  select source, source_size, least(w * level, 2.0::double * source_size) as target from capped, level
), ranked as (
  select d.doc_id, d.size, d.source, p.source_size, p.target, floor(rate)::int as certain, rate - floor(rate) as part,
    (('0x' || substr(md5('1:' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double as u
  from sized d join (select *, case when source_size > 0 then target / source_size else 0 end as rate from plan) p on d.source is not distinct from p.source
), ordered as (
  select *, case when part > 0 then u * (1 - part) / (u * (1 - part) + (1 - u) * part) else 1.0 end as r from ranked
), placed as (
  select *, sum(size) over (partition by source order by r, doc_id, size rows unbounded preceding) as upto,
    row_number() over (partition by source order by r, doc_id, size) as place,
    target - sum(certain * size) over (partition by source) as open_words
  from ordered
), chosen as (
  select *, part > 0 and upto <= open_words as taken_in,
    open_words - coalesce(sum(case when part > 0 and upto <= open_words then size end) over (partition by source), 0) as gap
  from placed
), last as (
  select source, min(struct_pack(o := abs(size - gap), p := place)) as l from chosen
  where part > 0 and not taken_in and size > 0 and abs(size - gap) < gap group by source
)
select c.doc_id, c.size, c.source_size, c.target, c.size * (certain + (case when taken_in or coalesce(place = l.p, false) then 1 else 0 end)) as taken,
  c.source, certain + (case when taken_in or coalesce(place = l.p, false) then 1 else 0 end) as copies
from chosen c left join last on c.source is not distinct from last.source
"""
