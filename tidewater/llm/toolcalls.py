"""Chat formatting: linking tool calls and their results. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewater.llm.tables import table, word_count
from tidewater.spool import drop_spool, spool

#: What a message with calls, or with a result, looks like.
CALLS = "tool_calls array<struct<id:string,name:string,arguments:variant,after:array<string>>>, tool_result struct<id:string,content:string>"
#: Tools: argument -> (types as Spark names them in a variant, whether it must be there).
SCHEMAS = {"reply": {"chars": (("BIGINT",), True), "words": (("BIGINT",), True), "tone": (("STRING",), False)}}
_DONE = "level is not null"


def _errors(name: Column, arguments: Column, schemas: dict) -> Column:
    """What is wrong with a call's arguments, in order of the alphabet."""
    known = F.array(*[F.lit(t) for t in schemas])
    found = [F.when(name.isNull() | ~F.array_contains(known, name), F.lit("unknown tool"))]
    keys = F.map_keys(F.from_json(F.to_json(arguments), "map<string,string>"))
    for tool, args in schemas.items():
        own = name == tool
        found.append(F.when(own & keys.isNull(), F.lit("arguments are no object")))
        extra = F.array_except(keys, F.array(*[F.lit(a) for a in args]))
        found.append(F.when(own & (F.size(extra) > 0), F.concat(F.lit("unknown argument: "), F.array_join(F.array_sort(extra), ", "))))
        for arg, (types, needed) in args.items():
            value = F.try_variant_get(arguments, f"$.{arg}", "variant")
            if needed:
                found.append(F.when(own & keys.isNotNull() & value.isNull(), F.lit(f"missing argument: {arg}")))
            found.append(F.when(own & value.isNotNull() & ~F.schema_of_variant(value).isin(*types), F.lit(f"wrong type: {arg}")))
    return F.array_sort(F.array_compact(F.array(*found)))


def link(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """Calls of all conversations, linked, ordered, validated and serialised.

    ``messages`` has ``conv_id, turn, text``; texts that are JSON objects with ``tool_calls`` or ``tool_result`` count,
    all others (plain, null, empty, broken) are passed over. One row comes out for each distinct call id of a
    conversation, that of its first call (by turn, then place; at ties the first by content), and for each result
    without a call:

    ``conv_id, call_id, turn, place, name, level`` (0 for calls that wait for none, else one more than the highest they
    wait for; null in a cycle or behind one), ``result_turn`` (of the first result by turn), ``status`` (linked,
    unanswered, early for a result before the call, orphan for one without a call), ``repeats`` (further calls of the
    id), ``missing`` (ids waited for that nobody calls), ``errors`` and ``json``: arguments and result as JSON with
    sorted keys and no white space. By ``level, turn, place`` a conversation's calls are in topological order.
    Calls without an id have no row. Extra columns are ignored.
    """
    read = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.from_json(F.col("text").cast("string"), CALLS).alias("m"))
    read = spool(read.where("m.tool_calls is not null or m.tool_result is not null").select("conv_id", "turn", F.transform("m.tool_calls", lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), F.to_json(c["arguments"]).alias("arguments"), c["after"].alias("after"))).alias("calls"), F.col("m.tool_result").alias("result")))
    every = read.select("conv_id", "turn", F.posexplode("calls").alias("place", "c")).where("c.id is not null")
    first = every.groupBy("conv_id", F.col("c.id").alias("call_id")).agg(F.min(F.struct("turn", "place", "c.name", "c.arguments", "c.after")).alias("f"), (F.count("*") - 1).alias("repeats"))
    calls = spool(first.select("conv_id", "call_id", "f.turn", "f.place", "f.name", "f.arguments", F.coalesce("f.after", F.array()).alias("after"), "repeats"))
    answers = read.where("result.id is not null").groupBy("conv_id", F.col("result.id").alias("call_id")).agg(F.min(F.struct("turn", "result.content")).alias("a"))
    answers = answers.select(F.col("conv_id").alias("a_conv"), F.col("call_id").alias("a_id"), F.col("a.turn").alias("result_turn"), F.col("a.content").alias("content"))

    waits = calls.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("on")).where("on is not null")
    there = calls.select(F.col("conv_id").alias("t_conv"), F.col("call_id").alias("t_id"))
    waits = spool(waits.join(there, F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("on") == F.col("t_id")), "left"))
    missing = waits.where("t_id is null").groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("on")).alias("missing"))
    levels = _levels(calls.select("conv_id", "call_id"), waits.where("t_id is not null").select("conv_id", "call_id", "on"))

    by = lambda x, y: F.col(f"{x}.conv_id").eqNullSafe(F.col(f"{y}.conv_id")) & (F.col(f"{x}.call_id") == F.col(f"{y}.call_id"))
    own = calls.alias("c").join(levels.alias("l"), by("c", "l"), "left").join(missing.alias("m"), by("c", "m"), "left").select("c.*", "level", "missing")
    linked = own.join(answers, F.col("conv_id").eqNullSafe(F.col("a_conv")) & (F.col("call_id") == F.col("a_id")), "full")
    status = F.when(F.col("call_id").isNull(), "orphan").when(F.col("result_turn").isNull(), "unanswered").when(F.col("result_turn") < F.col("turn"), "early").otherwise("linked")
    arguments = F.try_parse_json("arguments")
    record = F.struct(F.array_sort("after").alias("after"), arguments.alias("arguments"), F.coalesce("call_id", "a_id").alias("id"), F.col("name"), F.col("content").alias("result"))
    return linked.select(
        F.coalesce("conv_id", "a_conv").alias("conv_id"),
        F.coalesce("call_id", "a_id").alias("call_id"),
        "turn",
        "place",
        "name",
        "level",
        "result_turn",
        status.alias("status"),
        "repeats",
        F.coalesce("missing", F.array().cast("array<string>")).alias("missing"),
        F.when(F.col("call_id").isNotNull(), _errors(F.col("name"), arguments, schemas)).alias("errors"),
        F.to_json(record).alias("json"),
    )


def _levels(calls: DataFrame, waits: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of all calls that are not in a cycle or behind one.

    A call that waits for one other points to it; pointers are doubled until they reach a call that waits for none or for
    several, in as many rounds as the logarithm of the longest chain. Only calls that wait for several are then ordered
    round by round.
    """
    call = ["conv_id", "call_id"]
    same = lambda x, y, key: F.col(f"{x}.conv_id").eqNullSafe(F.col(f"{y}.conv_id")) & (F.col(f"{x}.{key}") == F.col(f"{y}.call_id"))
    waits = spool(waits)
    fan = waits.groupBy(*call).agg(F.count("*").alias("n"), F.min("on").alias("on"))
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    chains = spool(calls.alias("c").join(fan.alias("f"), same("c", "f", "call_id"), "left").select("c.conv_id", "c.call_id", F.when(one, F.col("on")).otherwise(F.col("c.call_id")).alias("top"), one.cast("long").alias("steps"), one.alias("open"), (F.col("n") > 1).alias("joins")))
    left, before = chains.where("open").count(), -1
    while left and left != before:  # a round in which none arrives leaves only cycles
        up = chains.select(*call, F.col("top").alias("up"), F.col("steps").alias("more"), F.col("open").alias("on"))
        moved = chains.where("open").alias("c").join(up.alias("u"), same("c", "u", "top")).select("c.conv_id", "c.call_id", F.col("up").alias("top"), (F.col("steps") + F.col("more")).alias("steps"), F.col("on").alias("open"), "joins")
        nxt = spool(chains.where("not open").unionByName(moved))
        drop_spool(chains)
        chains, before = nxt, left
        left = chains.where("open").count()
    known = spool(chains.where("not open and joins is null and steps = 0").select(*call, F.lit(0).cast("long").alias("level")))
    several = waits.alias("w").join(chains.where("joins").alias("j"), same("w", "j", "call_id"), "left_semi")
    if not several.isEmpty():
        own = several.alias("w").join(chains.alias("c"), same("w", "c", "on")).select("w.conv_id", "w.call_id", "top", (F.col("steps") + 1).alias("steps"), F.col("open").alias("stuck"), F.lit(None).cast("long").alias("at"))
        known = _joined(spool(own), known, same)
    tops = chains.where("not open").alias("c").join(known.alias("k"), same("c", "k", "top"))
    return tops.select("c.conv_id", "c.call_id", (F.col("level") + F.col("steps")).alias("level"))


def _joined(edges: DataFrame, known: DataFrame, same) -> DataFrame:
    """``known`` with the calls that wait for several: each after all that it waits for, one row of ``edges`` for each."""
    done, new = [known], known
    while not new.isEmpty():
        nxt = edges.alias("e").join(new.alias("k"), same("e", "k", "top"), "left").select("e.conv_id", "e.call_id", "top", "steps", "stuck", F.coalesce("at", F.col("level") + F.col("steps")).alias("at"))
        nxt = spool(nxt)
        ready = nxt.groupBy("conv_id", "call_id").agg(F.max("at").alias("level"), F.count_if(F.col("at").isNull() | F.col("stuck")).alias("open"))
        new = spool(ready.where("open = 0").select("conv_id", "call_id", "level"))
        edges = spool(nxt.alias("e").join(new.alias("n"), same("e", "n", "call_id"), "left_anti"))
        drop_spool(nxt)
        done.append(new)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return spool(out)


def as_tool_messages(turns: DataFrame) -> DataFrame:
    """Conversations in the form of calls: a user's or system's turn is a call, one of an assistant the result of the turn before it.

    A call waits for the one at half its turn, if that was a call. By the length ``n`` of their text, some calls have
    bad arguments, wait for a call that is nowhere or for a later one, and some results come with a repeated call.
    """
    name = lambda t: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    turn, words, n = F.col("turn").cast("long"), word_count(F.col("text")).cast("string"), F.coalesce(F.length("text"), F.lit(0))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    joined = lambda a, b, *parts: F.concat(F.lit(a), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit(b))
    arguments = joined(
        "{", "}",
        F.when(n % 11 != 0, F.concat(F.lit('"chars":'), n.cast("string"))),
        F.when(n % 5 == 0, F.lit('"note":"n"')),
        F.concat(F.lit('"words":'), F.when(n % 7 == 0, quoted(words)).otherwise(words)),
    )
    half = F.when(n % 17 == 0, name(turn + 2)).otherwise(name(F.floor(turn / 2)))
    after = joined("[", "]", F.when(turn > 0, quoted(half)), F.when(n % 13 == 0, quoted(F.concat(F.lit("gone-"), turn.cast("string")))))
    tool = F.when(F.col("role") == "system", "setup").otherwise("reply")
    call = lambda i, t, args, on: F.concat(F.lit('{"tool_calls":[{"id":'), quoted(i), F.lit(',"name":'), quoted(t), F.lit(',"arguments":'), args, F.lit(',"after":'), on, F.lit("}]"))
    result = F.concat(F.lit('"tool_result":{"id":'), quoted(name(turn - 1)), F.lit(',"content":'), quoted(F.md5(F.coalesce("text", F.lit("")))), F.lit("}}"))
    again = F.concat(call(name(turn - 1), F.lit("reply"), F.lit("{}"), F.lit("[]")), F.lit(","))
    answer = F.concat(F.when(n % 3 == 0, again).otherwise(F.lit("{")), result)
    return turns.select("conv_id", "turn", F.when(F.col("role") == "assistant", answer).otherwise(F.concat(call(name(turn), tool, arguments, after), F.lit("}"))).alias("text"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as tool calls, linked."""
    found = link(as_tool_messages(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "call_id", "turn", F.col("level").cast("long").alias("level"), "result_turn", "status", "repeats", F.array_join("missing", ",").alias("missing"), F.array_join("errors", "; ").alias("errors"), "json")


OP6_SQL = r"""
with turns as (
  select conv_id, turn, role, coalesce(text, '') as text, length(coalesce(text, '')) as n, 'c' || conv_id || '-' as stem from conversations
), every as (
  select conv_id, stem || turn as id, turn, case when role = 'system' then 'setup' else 'reply' end as name,
    '{' || concat_ws(',', case when n % 11 <> 0 then '"chars":' || n end, case when n % 5 = 0 then '"note":"n"' end,
      '"words":' || case when n % 7 = 0 then '"' || len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) || '"' else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::varchar end) || '}' as arguments,
    list_filter([case when turn > 0 then stem || case when n % 17 = 0 then turn + 2 else turn // 2 end end, case when n % 13 = 0 then 'gone-' || turn end], lambda x: x is not null) as after,
    case when role = 'system' then 'unknown tool' else concat_ws('; ', case when n % 11 = 0 then 'missing argument: chars' end, case when n % 5 = 0 then 'unknown argument: note' end, case when n % 7 = 0 then 'wrong type: words' end) end as errors
  from turns where role is distinct from 'assistant'
  union all
  select conv_id, stem || (turn - 1), turn, 'reply', '{}', [], 'missing argument: chars; missing argument: words' from turns where role = 'assistant' and n % 3 = 0
), calls as (
  select *, count(*) over (partition by conv_id, id) - 1 as repeats, row_number() over (partition by conv_id, id order by turn, name, arguments, after) as nth from every qualify nth = 1
), waits as (
  select w.conv_id, w.id, w.wait_for, c.id is not null as there from (select conv_id, id, unnest(after) as wait_for from calls) w left join calls c on c.conv_id is not distinct from w.conv_id and c.id = w.wait_for
), results as (
  select conv_id, stem || (turn - 1) as id, min(turn) as result_turn, arg_min(md5(text), turn) as content from turns where role = 'assistant' group by 1, 2
), leveled as (
  with recursive down as (
    select c.conv_id, c.id, 0 as level from calls c where not exists (select 1 from waits w where w.conv_id is not distinct from c.conv_id and w.id = c.id and w.there)
    union all
    select w.conv_id, w.id, d.level + 1 from waits w join down d on w.conv_id is not distinct from d.conv_id and w.wait_for = d.id
  ) select * from down
), missing as (select conv_id, id, string_agg(wait_for, ',' order by wait_for) as missing from waits where not there group by 1, 2)
select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.id, r.id) as call_id, c.turn, l.level::bigint as level, r.result_turn,
  case when c.id is null then 'orphan' when r.result_turn is null then 'unanswered' when r.result_turn < c.turn then 'early' else 'linked' end as status,
  c.repeats, coalesce(m.missing, '') as missing, c.errors,
  '{' || concat_ws(',', '"after":[' || list_aggregate(list_transform(list_sort(c.after), lambda x: '"' || x || '"'), 'string_agg', ',') || ']', case when len(c.after) = 0 then '"after":[]' end,
    '"arguments":' || c.arguments, '"id":"' || coalesce(c.id, r.id) || '"', '"name":"' || c.name || '"', '"result":"' || r.content || '"') || '}' as json
from calls c full join results r on c.conv_id is not distinct from r.conv_id and c.id = r.id
  left join leveled l on l.conv_id is not distinct from c.conv_id and l.id = c.id left join missing m on m.conv_id is not distinct from c.conv_id and m.id = c.id
"""
