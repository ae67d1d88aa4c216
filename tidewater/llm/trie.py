"""Prefix trie of conversations: totals of subtrees by time-forward processing."""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewater.llm.tables import table
from tidewater.spool import spool

#: Conversations that share a head are so many ids apart at most, and a head has fewer turns than this.
FAMILY, HEADS = 5, 9
#: A subtree goes to one shard if it can't have more nodes than this and this part of all turns.
SHARD_NODES, SHARDS = 4096, 4096
#: Messages a priority queue holds in memory before it spills.
IN_MEMORY = 200_000
#: Bytes of ids that are hashed at a time.
BLOCK_BYTES = 1 << 16
LIMBS = ("s1", "s2", "s3", "s4")


# --- conversations as paths ------------------------------------------------------------------------------------------


def _limbs(digest: Column, depth: Column) -> list[Column]:
    """A turn at a depth as four numbers below 2^32; their sums along a path tell the path."""
    hexed = F.md5(F.concat_ws(":", depth.cast("string"), digest))
    return [F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(LIMBS)]


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums])))


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, part, own, digest, bytes`` of each turn and ``conv_id, part, n, before`` of each part of a conversation.

    A turn stands at ``before + own`` in its conversation. Parts are ranges of the order of all turns, so that a
    conversation of any length is numbered by many tasks. Texts stay where they are: a digest of role and text goes on.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    dealt = told.repartitionByRange("conv_id", "turn", "digest").withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    local = spool(dealt.select("conv_id", "part", place.cast("long").alias("own"), "digest", "bytes"))
    parts = local.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return local, spool(parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, part, depth, digest, bytes, size`` of each turn of the rebuilt conversations, and ``conv_id, size`` of each of these.

    Conversation c begins with the first h turns of conversation c - c mod 5 (mod is never negative), as far as it has
    them, and goes on with its own turns after the first h; h is crc32 of c in decimal, mod 9.
    """
    local, parts = numbered(turns)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    each = parts.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY)))
    bases = each.select(F.col("conv_id").alias("b_id"), F.col("n").alias("b_n"))
    each = each.join(bases, F.col("base") == F.col("b_id"), "left").withColumn("b", F.least("h", F.coalesce("b_n", F.lit(0))))
    convs = spool(each.select("conv_id", "base", "h", "b", (F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")))

    own = parts.join(convs, "conv_id").select("conv_id", "part", "before", "h", "b", "size")
    tails = local.join(own, ["conv_id", "part"]).withColumn("at", F.col("before") + F.col("own")).where("at > h")
    tails = tails.select("conv_id", "part", (F.col("b") + F.col("at") - F.col("h")).alias("depth"), "digest", "bytes", "size")
    first = parts.where(F.col("before") < HEADS)
    heads = local.where(F.col("own") < HEADS).join(first, ["conv_id", "part"]).select(F.col("conv_id").alias("of"), (F.col("before") + F.col("own")).alias("at"), "digest", "bytes")
    lead = convs.join(heads, (F.col("base") == F.col("of")) & (F.col("at") <= F.col("h")))
    lead = lead.select("conv_id", F.lit(-1).alias("part"), F.col("at").alias("depth"), "digest", "bytes", "size")
    return tails.unionByName(lead), convs.select("conv_id", "size")


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, depth, key, parent, bytes, size``: the nodes each conversation goes through, the root included.

    A node's ``key`` stands for its depth and all turns down to it, told by 128 bits that add up turn by turn: so a long
    conversation's nodes are found by sums over its parts, not one after the other.
    """
    told = spool(turns.select("conv_id", "part", "depth", "bytes", "size", *_limbs(F.col("digest"), F.col("depth"))))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = told.groupBy("conv_id", "part").agg(*[F.sum(c).alias(f"t_{c}") for c in LIMBS])
    carried = sums.select("conv_id", "part", *[F.coalesce(F.sum(f"t_{c}").over(earlier), F.lit(0)).alias(f"c_{c}") for c in LIMBS])
    here = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = told.select("conv_id", "part", "depth", "bytes", "size", *LIMBS, *[F.sum(c).over(here).alias(f"r_{c}") for c in LIMBS]).join(carried, ["conv_id", "part"])
    whole = [F.col(f"c_{c}") + F.col(f"r_{c}") for c in LIMBS]
    above = [w - F.col(c) for w, c in zip(whole, LIMBS)]
    found = run.select("conv_id", "depth", _key(F.col("depth"), whole).alias("key"), _key(F.col("depth") - 1, above).alias("parent"), "bytes", "size")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), _key(zero, [zero] * 4).alias("key"), F.lit(None).cast("binary").alias("parent"), zero.alias("bytes"), "size")
    return spool(found.unionByName(root))


# --- time-forward processing -----------------------------------------------------------------------------------------


class Inbox:
    """Messages to nodes that come later, smallest depth last; those beyond ``most`` wait in sorted runs on a file without a name.

    The file is the task's own scratch space: it has no name, is gone with the task, and nothing else reads it.
    """

    def __init__(self, most: int = IN_MEMORY):
        self.most, self.heap, self.heads, self.runs = most, [], [], []

    def put(self, depth: int, key: bytes, leaves: int, saved: int) -> None:
        heapq.heappush(self.heap, (-depth, key, leaves, saved))
        if len(self.heap) > self.most:
            self._spill()

    def take(self, depth: int, key: bytes) -> tuple[int, int]:
        """The sums of all messages to a node."""
        leaves = saved = 0
        for heap in (self.heap, self.heads):
            while heap and heap[0][0] == -depth and heap[0][1] == key:
                m = heapq.heappop(heap)
                leaves, saved = leaves + m[2], saved + m[3]
                if heap is self.heads:
                    self._advance(m[4])
        return leaves, saved

    def _spill(self) -> None:
        """Puts the queue on file as one run, messages to a node added up."""
        self.heap.sort()
        run, held = tempfile.TemporaryFile(), None
        for m in self.heap:
            if held and held[:2] == m[:2]:
                held = (*m[:2], held[2] + m[2], held[3] + m[3])
            else:
                if held:
                    pickle.dump(held, run)
                held = m
        pickle.dump(held, run)
        run.seek(0)
        self.heap = []
        self.runs.append(run)
        self._advance(len(self.runs) - 1)

    def _advance(self, i: int) -> None:
        try:
            heapq.heappush(self.heads, (*pickle.load(self.runs[i]), i))
        except EOFError:
            self.runs[i].close()


#: What ``forward`` reads: a node, the node that its total goes to, whether that is in the same shard, and its own weights.
STEP = ["depth", "key", "up_depth", "up", "inside", "leaves", "saved"]


def forward(nodes: DataFrame, shard: str | None, keep: list[str], most: int = IN_MEMORY) -> DataFrame:
    """``keep`` and ``n_leaves, saved_tokens``: each node's own ``leaves, saved`` and those of all below it in its shard.

    Time-forward processing: a shard's nodes come deepest first (Spark sorts them, on disk where they are many); each takes
    its messages from the queue, and sends its total on to where it is read later. Shards are told apart by the column
    ``shard`` and share tasks; with none all nodes are one shard.
    """
    import pyarrow as pa

    dealt = nodes.repartition(1) if shard is None else nodes.repartition(F.col(shard))
    schema = nodes.select(*keep).schema.add("n_leaves", "long").add("saved_tokens", "long")
    columns = list(dict.fromkeys([*STEP, *keep]))

    def run(batches):
        inbox = Inbox(most)
        for b in batches:
            totals = []
            for depth, key, up_depth, up, inside, leaves, saved in zip(*(b.column(c).to_pylist() for c in STEP)):
                more = inbox.take(depth, key)
                leaves, saved = leaves + more[0], saved + more[1]
                totals.append((leaves, saved))
                if inside:
                    inbox.put(up_depth, up, leaves, saved)
            sums = [pa.array(x, pa.int64()) for x in zip(*totals)] or [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *sums], [*keep, "n_leaves", "saved_tokens"])

    return dealt.select(*columns).sortWithinPartitions(F.desc("depth"), "key").mapInArrow(run, schema)


def _within(nodes: DataFrame, top: Column) -> DataFrame:
    """Nodes with what ``forward`` reads, each one's total going to its parent, unless it is the top of its shard."""
    return nodes.withColumns({"up_depth": F.col("depth") - 1, "up": F.col("parent"), "inside": F.col("key") != top})


def totals(nodes: DataFrame, routes: DataFrame, shard_nodes: int = SHARD_NODES, shards: int = SHARDS, most: int = IN_MEMORY) -> DataFrame:
    """``nodes`` with ``n_leaves`` and ``saved_tokens`` of their subtrees.

    ``reach`` is the most nodes a node's subtree can have, summed over its conversations. Subtrees of small reach whose
    parent's is large are shards. The nodes above them are cut into regions: those below one node within a band of levels.
    Shards first send their totals to the nodes above, regions add up what is in them, their tops are put together in one
    task (a few thousand rows and the square root of the longest conversation), and what that gives is spread back over
    the regions' nodes.
    """
    reach = nodes.agg(F.max("reach")).first()[0] or 0
    limit = shard_nodes + reach // shards
    band = math.isqrt(limit)
    weigh = nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    out = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children"]
    light, heavy = weigh.where(F.col("reach") <= limit), weigh.where(F.col("reach") > limit)
    is_top = F.col("parent_reach").isNull() | (F.col("parent_reach") > limit)
    tops = light.where(is_top).select(F.col("key").alias("top"))
    top_of = routes.join(tops, F.col("key") == F.col("top")).select(F.col("conv_id").alias("t_id"), "top")
    small = _within(light.join(top_of, F.col("conv_id") == F.col("t_id")), F.col("top"))
    done = spool(forward(small, "top", [*out, "parent", "inside"], most))

    sent = done.where("not inside").groupBy(F.col("parent").alias("s_key")).agg(F.sum("n_leaves").alias("s_leaves"), F.sum("saved_tokens").alias("s_saved"))
    marks = routes.where(F.col("depth") % band == 0).select(F.col("conv_id").alias("m_id"), F.col("depth").alias("m_depth"), F.col("key").alias("top"))
    upper = heavy.join(sent, F.col("key") == F.col("s_key"), "left").join(marks, (F.col("conv_id") == F.col("m_id")) & (F.col("depth") - F.col("depth") % band == F.col("m_depth")))
    added = {"leaves": F.col("leaves") + F.coalesce("s_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("s_saved", F.lit(0))}
    upper = spool(_within(upper.withColumns(added), F.col("top")).select(*out, "parent", "top", "leaves", "saved", "up_depth", "up", "inside"))
    regions = forward(upper, "top", ["key", "depth", "parent", "inside"], most).where("not inside").drop("inside")
    homes = upper.select(F.col("key").alias("h_key"), F.col("top").alias("up"))
    regions = regions.join(homes, F.col("parent") == F.col("h_key"), "left").select("key", "parent", "depth", (F.col("depth") - band).alias("up_depth"), "up", F.col("up").isNotNull().alias("inside"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    across = forward(spool(regions), None, ["parent"], most)
    back = across.groupBy(F.col("parent").alias("s_key")).agg(F.sum("n_leaves").alias("s_leaves"), F.sum("saved_tokens").alias("s_saved"))
    again = upper.join(back, F.col("key") == F.col("s_key"), "left").withColumns(added)
    return done.select(*out, "n_leaves", "saved_tokens").unionByName(forward(again, "top", out, most))


def ends(routes: DataFrame) -> DataFrame:
    """``e_key, ends_sha256`` of nodes at which conversations end: SHA-256 of their ids, ascending, comma-joined.

    Ids are sorted in ranges and joined to blocks there; a node's blocks are then hashed one after the other.
    """
    import pyarrow as pa

    def blocks(batches):
        key, first, ids, size = None, None, [], 0
        for b in batches:
            out = []
            for k, c in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist()):
                if ids and (k != key or size >= BLOCK_BYTES):
                    out.append((key, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    key, first = k, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if out:
                yield _rows(pa, out, ["key", "first", "ids"], [pa.binary(), pa.int64(), pa.string()])
        if ids:
            yield _rows(pa, [(key, first, ",".join(ids))], ["key", "first", "ids"], [pa.binary(), pa.int64(), pa.string()])

    def hashed(batches):
        key, state = None, None
        for b in batches:
            out = []
            for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
                if k == key:
                    state.update(b",")
                else:
                    if state:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield _rows(pa, out, ["e_key", "ends_sha256"], [pa.binary(), pa.string()])
        if state:
            yield _rows(pa, [(key, state.hexdigest())], ["e_key", "ends_sha256"], [pa.binary(), pa.string()])

    own = routes.where("depth = size").select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = own.mapInArrow(blocks, "key binary, first long, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "e_key binary, ends_sha256 string")


def _rows(pa, rows: list[tuple], names: list[str], kinds: list) -> Iterator:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


def trie(turns: DataFrame, shard_nodes: int = SHARD_NODES, shards: int = SHARDS, most: int = IN_MEMORY) -> DataFrame:
    """The trie of the rebuilt conversations, one row a node.

    ``turns`` has ``conv_id, turn, role, text``. A null role or text is empty, null turns come first; turns that tie go by a
    digest of role and text, repeated rows are turns of their own. Turns without a ``conv_id`` belong to no conversation.
    Very long texts are read for their digest and length only. Other columns are ignored. An empty table gives no nodes.
    """
    told, convs = rebuilt(turns)
    routes = paths(told, convs)
    found = routes.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes"), F.sum(F.col("size") - F.col("depth") + 1).alias("reach"))
    found = spool(found)
    below = found.where("parent is not null").groupBy(F.col("parent").alias("b_key")).agg(F.count("*").alias("n_children"))
    above = found.select(F.col("key").alias("a_key"), F.col("conv_id").alias("parent_conv_id"), F.col("reach").alias("parent_reach"))
    nodes = found.join(above, F.col("parent") == F.col("a_key"), "left").join(below, F.col("key") == F.col("b_key"), "left")
    nodes = spool(nodes.drop("a_key", "b_key").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    summed = totals(nodes, routes, shard_nodes, shards, most)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return summed.join(ends(routes), F.col("key") == F.col("e_key"), "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return trie(table(spark, sf_dir, "conversations"))


OP13_SQL = """
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) as p from conversations where conv_id is not null
), convs as (
  select conv_id, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint), lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 as h, count(*) as n
  from turns group by conv_id
), own as (
  select c.conv_id, c.h, c.conv_id - c.conv_id % 5 as base, least(c.h, coalesce(b.n, 0)) as b from convs c left join convs b on b.conv_id = c.conv_id - c.conv_id % 5
), rebuilt as (
  select o.conv_id, t.p as d, t.role, t.text from own o join turns t on t.conv_id = o.base and t.p <= o.h
  union all
  select o.conv_id, o.b + t.p - o.h, t.role, t.text from own o join turns t on t.conv_id = o.conv_id and t.p > o.h
), routes as (
  select conv_id, d, md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, '' order by d) over (partition by conv_id order by d)) as key, octet_length(encode(text)) as bytes from rebuilt
  union all
  select conv_id, 0, '', 0 from convs
), last as (
  select conv_id, max(d) as size from routes group by 1
), nodes as (
  select d, key, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes from routes group by d, key
), edges as (
  select distinct c.d, c.key, p.key as parent from routes c join routes p on p.conv_id = c.conv_id and p.d = c.d - 1
), kids as (
  select d - 1 as d, parent as key, count(*) as n_children from edges group by 1, 2
), under as (
  select distinct a.d, a.key, b.d as d2, b.key as key2 from routes a join routes b on b.conv_id = a.conv_id and b.d >= a.d
), sums as (
  select u.d, u.key, count(*) filter (where k.n_children is null) as n_leaves, sum((n.n_convs - 1) * n.bytes) as saved_tokens
  from under u join nodes n on n.d = u.d2 and n.key = u.key2 left join kids k on k.d = u.d2 and k.key = u.key2 group by 1, 2
), ending as (
  select r.d, r.key, string_agg(r.conv_id::varchar, ',' order by r.conv_id) as ids from routes r join last l on l.conv_id = r.conv_id and l.size = r.d group by 1, 2
)
select n.conv_id, n.d::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n left join edges g on g.d = n.d and g.key = n.key left join nodes p on p.d = n.d - 1 and p.key = g.parent
  left join kids k on k.d = n.d and k.key = n.key join sums s on s.d = n.d and s.key = n.key left join ending e on e.d = n.d and e.key = n.key
"""
