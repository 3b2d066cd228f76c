"""Chat formatting with tool-call linking, with built-in functions only.

A message's text may be a JSON object with `tool_calls` (id, name, arguments) or,
for the role tool, with `tool_call_id` and `content`. Calls and results are linked by
a hash join on conversation, identifier and occurrence (a result answers the last call
of its identifier before it, else the first). Arguments are validated against the
tools' schemas. Calls are in topological order: a call whose arguments name "$id" has
a level above every such call that appears later, and not below one that appears
earlier; calls go by level, then by appearance. Levels hold for a whole conversation,
so the parts of a long one can be merged by them. Each part becomes one canonical JSON
object: sorted keys, no blanks.

Levels need no work where no call names a later one. Other conversations place, again
and again, the calls whose references are all placed: in one array of calls where a
conversation has at most `array_calls`, else by joins, round by round, on written tables.

The unit of output is a piece of a conversation: a part is `part_turns` turns long, and
a part of more than `piece_messages` messages is cut into pieces by hash, so no piece
has more than about that many, whatever the turns are.

Defined results: exact repeats of a message count once; messages of one turn are
ordered by role and text. A message without a conversation (null conv_id) is one of its
own. Null turns come first, null roles and texts are left out of the JSON. Text that is
no JSON object is plain text. Of several results for one call the first counts. A
reference to an identifier that occurs more than once means its first call; calls
without an identifier are kept, and linked to nothing. Calls on a cycle, and those that
need one, have no level, come last in order of appearance and are counted. A result
without a call counts in the piece that it stands in.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

PART_TURNS, PIECE_MESSAGES, ARRAY_CALLS = 4096, 65_536, 2048
_MESSAGE = "content string, tool_call_id string, tool_calls array<struct<id: string, name: string, arguments: string>>"
#: Variant type names that a JSON schema type admits.
_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL[(].*[)]", "boolean": "BOOLEAN", "object": "OBJECT<.*>", "array": "ARRAY<.*>"}


@dataclass(frozen=True)
class Tool:
    """A tool's name, the types of its parameters, which are required, and whether others are allowed."""

    name: str
    types: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    others: bool = False


def _faults(tools: list[Tool]) -> Column:
    """What is wrong with the arguments `args` (a JSON text) of the tool `name`."""
    value = F.try_parse_json("args")
    branches = F.when(value.isNull(), F.array(F.lit("arguments are no JSON")))
    for t in tools:
        checks = []
        for name in sorted({*t.types, *t.required}):
            kind = F.schema_of_variant(F.try_variant_get(value, f"$['{name}']", "variant"))
            absent = kind.isNull() | (kind == "VOID")
            if name in t.required:
                checks.append(F.when(absent, F.lit(f"missing {name}")))
            if name in t.types:
                checks.append(F.when(~absent & ~kind.rlike(f"^({_KINDS[t.types[name]]})$"), F.lit(f"{name} is no {t.types[name]}")))
        found = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
        if not t.others:
            extra = F.array_except(F.coalesce(F.json_object_keys("args"), F.array().cast("array<string>")), F.array(*map(F.lit, t.types)) if t.types else F.array().cast("array<string>"))
            found = F.concat(found, F.transform(F.array_sort(extra), lambda k: F.concat(F.lit("unknown "), k)))
        branches = branches.when(F.col("name") == t.name, found)
    return branches.otherwise(F.array(F.lit("unknown tool")))


#: Levels of an array of calls with `refs` (places of other calls), null where none comes out.
_LEVELS = """
aggregate(sequence(1, size(calls) + 1), named_struct('level', transform(calls, c -> -1), 'go', true), (s, k) -> if(not s.go, s,
  transform(array(transform(calls, (c, i) -> if(s.level[i] >= 0 or exists(c.refs, j -> s.level[j] < 0), s.level[i],
      aggregate(c.refs, 0, (m, j) -> greatest(m, s.level[j] + if(j >= i, 1, 0)))))),
    n -> named_struct('level', n, 'go', n <> s.level))[0])).level
"""


def _in_arrays(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(talk, place, level) of whole conversations, each as one array; places count from 0 without gaps."""
    refs = edges.groupBy("talk", "place").agg(F.sort_array(F.collect_set("ref")).alias("refs"))
    whole = calls.join(refs, ["talk", "place"], "left").groupBy("talk").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("refs", F.array().cast("array<int>")).alias("refs")))).alias("calls"))
    return whole.select("talk", F.posexplode(F.expr(_LEVELS)).alias("place", "level"))


def _by_joins(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """The same for conversations of any length: a round places every call whose references are placed."""
    edges = shared.written(edges.select("talk", "place", "ref"), "edges")
    needs = edges.groupBy("talk", "place").agg(F.count("*").alias("needed"))
    done = shared.written(calls.join(needs, ["talk", "place"], "left_anti").select("talk", "place", F.lit(0).alias("level")), "levels")
    last, out = done, done
    waiting = calls.join(needs, ["talk", "place"]).select("talk", "place", "needed", F.lit(0).cast("long").alias("met"), F.lit(0).alias("high"))
    while not last.isEmpty():
        news = edges.join(last.select("talk", F.col("place").alias("ref"), "level"), ["talk", "ref"])
        news = news.groupBy("talk", "place").agg(F.count("*").alias("more"), F.max(F.col("level") + F.when(F.col("ref") >= F.col("place"), 1).otherwise(0)).alias("top"))
        step = waiting.join(news, ["talk", "place"], "left").select("talk", "place", "needed", (F.col("met") + F.coalesce("more", F.lit(0))).alias("met"), F.greatest("high", F.coalesce("top", F.lit(0))).alias("high"))
        step = shared.written(step, "waiting")
        last = step.where("met = needed").select("talk", "place", F.col("high").alias("level"))
        out, waiting = out.unionByName(last), step.where("met < needed")
    return out.unionByName(waiting.select("talk", "place", F.lit(-1).alias("level")))


def levels(calls: DataFrame, array_calls: int = ARRAY_CALLS) -> DataFrame:
    """Adds `level` (null on or behind a cycle) to calls with talk, place (0, 1, .. in a conversation), id and refs (identifiers)."""
    targets = calls.where(F.col("id").isNotNull()).groupBy("talk", "id").agg(F.min("place").alias("ref"))
    named = calls.select("talk", "place", F.explode("refs").alias("id")).distinct()
    edges = named.join(targets, ["talk", "id"]).select("talk", "place", "ref")
    forward = edges.where("ref >= place").select("talk").distinct()
    size = calls.join(forward, "talk", "left_semi").groupBy("talk").agg(F.count("*").alias("size"))
    size = shared.written(size, "forward")
    out = []
    for large in (False, True):
        own = size.where((F.col("size") > array_calls) == large).select("talk")
        if not own.isEmpty():
            pick = lambda df: df.join(own, "talk", "left_semi")  # noqa: E731, B023
            out.append((_by_joins if large else _in_arrays)(pick(calls).select("talk", "place"), pick(edges)))
    if not out:
        return calls.withColumn("level", F.lit(0))
    found = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    found = found.select("talk", "place", F.col("level").alias("found"))
    level = F.when(F.col("found").isNull(), 0).when(F.col("found") >= 0, F.col("found"))
    return calls.join(found, ["talk", "place"], "left").withColumn("level", level).drop("found")


def _placed(calls: DataFrame) -> DataFrame:
    """Adds `place`, the number of a call in its conversation by turn, role, text and position.

    Numbers within a stretch of turns come from a window, those before a stretch from sums
    of stretches, so a conversation with very many calls isn't sorted in one task.
    """
    stretch = F.coalesce(F.floor(F.col("turn") / 1024), F.lit(-(2**62)))
    calls = calls.withColumn("stretch", stretch)
    sums = calls.groupBy("talk", "stretch").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("talk").orderBy("stretch")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("talk", "stretch").orderBy("turn", "role", "text", "pos")) - 1
    return calls.withColumn("within", within).join(before, ["talk", "stretch"]).withColumn("place", (F.col("before") + F.col("within")).cast("int")).drop("stretch", "before", "within")


def formatted(
    df: DataFrame, tools: list[Tool] | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    part_turns: int = PART_TURNS, piece_messages: int = PIECE_MESSAGES, array_calls: int = ARRAY_CALLS,
) -> DataFrame:
    """Per piece of a conversation: id, part, piece, n_messages, n_calls, n_linked, n_invalid, n_orphans (results without a call), n_cyclic, chat (canonical JSON)."""
    m = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    alone = F.concat(F.lit("n"), F.sha2(F.to_json(F.struct("turn", "role", "text")), 256))
    m = m.select("*", F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), alone).alias("talk"), F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(0)).alias("part")).dropDuplicates(["talk", "turn", "role", "text"])
    large = m.groupBy("talk", "part").agg(F.count("*").alias("n")).where(F.col("n") > piece_messages).select("talk", "part", F.ceil(F.col("n") / piece_messages).alias("pieces"))
    piece = F.coalesce(F.pmod(F.xxhash64("turn", "role", "text"), F.col("pieces")), F.lit(0))
    body = F.when(F.startswith(F.ltrim("text"), F.lit("{")), F.from_json("text", _MESSAGE))
    m = shared.written(m.join(large, ["talk", "part"], "left").withColumn("piece", piece).drop("pieces").withColumn("body", body), "messages")

    unit, place = ["talk", "part", "piece"], ["turn", "role", "text", "pos"]
    calls = m.where(F.size("body.tool_calls") > 0).select(*unit, "turn", "role", "text", F.posexplode("body.tool_calls").alias("pos", "call"))
    calls = calls.select(*unit, *place, F.col("call.id").alias("id"), F.col("call.name").alias("name"), F.coalesce("call.arguments", F.lit("{}")).alias("args"))
    results = m.where((F.col("role") == "tool") & F.col("body.tool_call_id").isNotNull()).select(*unit, "turn", "role", "text", F.lit(-1).alias("pos"), F.col("body.tool_call_id").alias("id"), F.col("body.content").alias("content"))
    # Which occurrence of its identifier a call is, and a result answers.
    both = calls.where(F.col("id").isNotNull()).withColumns({"is_call": F.lit(1), "content": F.lit(None).cast("string")}).unionByName(results.withColumn("is_call", F.lit(0)), allowMissingColumns=True)
    seen = F.sum("is_call").over(Window.partitionBy("talk", "id").orderBy("turn", F.col("is_call").desc(), "role", "text", "pos"))
    both = both.withColumn("nth", F.greatest(seen, F.lit(1)))
    answers = both.where("is_call = 0").groupBy("talk", "id", "nth").agg(F.min(F.struct("turn", "text", "content")).alias("r"))
    named = both.where("is_call = 1").drop("is_call", "content").join(answers, ["talk", "id", "nth"], "left").withColumns({"result": F.col("r.content"), "answered": F.col("r").isNotNull()}).drop("r", "nth")
    calls = named.unionByName(calls.where(F.col("id").isNull()).withColumns({"result": F.lit(None).cast("string"), "answered": F.lit(False)}))
    refs = F.array_distinct(F.regexp_extract_all("args", F.lit(r'"\$([^"]+)"'), F.lit(1)))
    placed = shared.written(_placed(calls.withColumn("refs", refs)), "calls")
    canonical = F.coalesce(F.to_json(F.try_parse_json("args")), F.to_json(F.struct(F.col("args").alias("invalid"))))
    ordered = levels(placed, array_calls).withColumns({"args": canonical, "faults": _faults(tools or [])})
    call_json = F.concat(
        F.lit('{"arguments":'), "args", F.when(F.size("faults") > 0, F.concat(F.lit(',"errors":'), F.to_json("faults"))).otherwise(""),
        F.lit(","), F.expr("substring(to_json(named_struct('id', id, 'level', level, 'name', name, 'result', result)), 2)"),
    )
    call = F.struct(F.coalesce("level", F.lit(2**31 - 1)).alias("level"), "place", "answered", (F.size("faults") > 0).alias("invalid"), F.regexp_replace(call_json, ",}$", "}").alias("json"))
    tool_ids = placed.where(F.col("id").isNotNull()).select("talk", "id").distinct()
    lost = results.join(tool_ids, ["talk", "id"], "left_anti")

    plain = F.col("body.tool_calls").isNull() & F.col("body.tool_call_id").isNull()
    entry = F.struct(F.when(plain, F.col("text")).otherwise(F.col("body.content")).alias("content"), F.col("role"), F.col("body.tool_call_id").alias("tool_call_id"), F.col("turn"))
    message = F.struct("turn", "role", "text", F.to_json(entry).alias("json"))
    rows = m.select(*unit, "conv", message.alias("message")).unionByName(ordered.select(*unit, call.alias("call")), allowMissingColumns=True)
    rows = rows.unionByName(lost.select(*unit, F.lit(1).alias("lost")), allowMissingColumns=True)
    out = rows.groupBy(*unit).agg(F.min("conv").alias("conv"), F.sort_array(F.collect_list("message")).alias("messages"), F.sort_array(F.collect_list("call")).alias("calls"), F.coalesce(F.sum("lost"), F.lit(0)).cast("long").alias("n_orphans"))
    chat = F.expr("""concat('{', if(size(calls) > 0, concat('"calls":[', array_join(transform(calls, c -> c.json), ','), '],'), ''),
        if(conv is null, '', concat(substring(to_json(named_struct('conv_id', conv)), 2, length(to_json(named_struct('conv_id', conv))) - 2), ',')), '"messages":[', array_join(transform(messages, x -> x.json), ','), ']}')""")
    count = lambda x: F.expr(f"cast({x} as bigint)")
    return out.select(
        F.col("conv").alias(conv_col), "part", "piece", count("size(messages)").alias("n_messages"), count("size(calls)").alias("n_calls"), count("size(filter(calls, c -> c.answered))").alias("n_linked"),
        count("size(filter(calls, c -> c.invalid))").alias("n_invalid"), "n_orphans", count("size(filter(calls, c -> c.level = 2147483647))").alias("n_cyclic"), chat.alias("chat"),
    )
