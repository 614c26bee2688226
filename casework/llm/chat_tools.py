"""Tool calls of conversations: linked to results, ordered, validated, written as canonical JSON.

Calls and results of an identifier are ordered by their turns; a call has the earliest
result after it and before the next call of that identifier.  A call may name calls that
it builds on: its level is one more than the highest of theirs, worked out level by
level on the few rows that have such references.  Arguments are parsed once; their
types and names are compared with the schema of the tool.  Canonical JSON has sorted
keys, no white space and no nulls.

Rows stay rows: no conversation is gathered into one.  Within a conversation, ``level``
and then ``turn`` is a topological order.

Defined results: a call without a result has no ``result``; a result that
no call has is a row without a name (problem ``no_call``, ``early_result`` or
``extra_result``); repeated calls share a result, calls with the same identifier a level,
and repeated rows stay; references
to calls that are not there are ignored for the order (problem ``unknown_reference``);
calls on a cycle have a null level (problem ``cycle``); null conversations or identifiers
link nothing; arguments that are no JSON object are left out (problem ``not_an_object``);
empty tables give an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from casework.llm.work import stored

#: Types of JSON values by the names that schemas use.
TYPES = {
    "string": r"^STRING$",
    "integer": r"^BIGINT$",
    "number": r"^(BIGINT|DOUBLE|DECIMAL.*)$",
    "boolean": r"^BOOLEAN$",
    "array": r"^ARRAY.*",
    "object": r"^OBJECT.*",
}
CALLS = "conv_id, turn, call_id, name, arguments, after"


def answers(calls: DataFrame, results: DataFrame) -> DataFrame:
    """``conv_id, call_id, turn, asked, calls, n, content`` of the distinct results: ``asked`` is the turn of the last call before it.

    ``calls`` tells whether the identifier has a call at all, ``n`` how often the result is there.
    Calls and results of an identifier are put in one order, so that no pairs of them are made.
    """
    known = "conv_id IS NOT NULL AND call_id IS NOT NULL AND turn IS NOT NULL"
    asking = calls.filter(known).select("conv_id", "call_id", "turn", F.lit(True).alias("call"), F.lit(None).cast("string").alias("content"), F.lit(0).alias("one"))
    given = results.filter(known).select("conv_id", "call_id", "turn", F.lit(False).alias("call"), "content", F.lit(1).alias("one"))
    rows = asking.unionByName(given).groupBy("conv_id", "call_id", "turn", "call", "content").agg(F.sum("one").alias("n"))
    group = Window.partitionBy("conv_id", "call_id")
    before = group.orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    asked = F.max(F.when(F.col("call"), F.col("turn"))).over(before)
    rows = rows.withColumn("asked", asked).withColumn("calls", F.max("call").over(group))
    return rows.filter("NOT call").drop("call")


def linked_answers(found: DataFrame) -> DataFrame:
    """``conv_id, call_id, turn, result_turn, result``: for each call the earliest result after it and before the next call of its identifier."""
    first = F.min(F.struct(F.col("turn").alias("result_turn"), F.col("content").alias("result"))).alias("r")
    rows = found.filter("asked IS NOT NULL").groupBy("conv_id", "call_id", F.col("asked").alias("turn")).agg(first)
    return rows.select("conv_id", "call_id", "turn", "r.*")


def unlinked_results(found: DataFrame, linked: DataFrame, results: DataFrame) -> DataFrame:
    """``conv_id, call_id, turn, result, problem`` of every result that no call has, repeated ones included.

    ``no_call``: no call has its identifier; ``early_result``: they all come later; ``extra_result``: the call has an earlier one.
    """
    taken = linked.select("conv_id", "call_id", F.col("result_turn").alias("turn"), F.col("result").alias("r"), F.lit(1).alias("taken"))
    a, b = found.alias("a"), taken.alias("b")
    same = (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.call_id") == F.col("b.call_id")) & (F.col("a.turn") == F.col("b.turn"))
    rows = a.join(b, same & F.col("a.content").eqNullSafe(F.col("b.r")), "left")
    rows = rows.select("a.*", (F.col("a.n") - F.coalesce("b.taken", F.lit(0))).cast("int").alias("left")).filter("left > 0")
    problem = F.when(~F.col("calls"), F.lit("no_call")).when(F.col("asked").isNull(), F.lit("early_result")).otherwise(F.lit("extra_result"))
    rows = rows.select("conv_id", "call_id", "turn", F.col("content").alias("result"), problem.alias("problem"), F.explode(F.sequence(F.lit(1), "left")).alias("i"))
    nameless = results.filter("conv_id IS NULL OR call_id IS NULL OR turn IS NULL")
    nameless = nameless.select("conv_id", "call_id", "turn", F.col("content").alias("result"), F.lit("no_call").alias("problem"))
    return rows.drop("i").unionByName(nameless)


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level, unknown_reference, cycle`` of the calls that refer to others."""
    ids = calls.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").select("conv_id", "call_id").distinct()
    asked = calls.filter("size(after) > 0").select("conv_id", "call_id", F.explode("after").alias("parent")).distinct()
    there = ids.withColumnRenamed("call_id", "parent").withColumn("there", F.lit(True))
    edges = stored(asked.join(there, ["conv_id", "parent"], "left").withColumn("there", F.coalesce("there", F.lit(False))), "references")
    known_edges = edges.filter("there")
    total = stored(edges.groupBy("conv_id", "call_id").agg(F.count_if("there").alias("n"), F.bool_or(~F.col("there")).alias("unknown_reference")), "referring")
    done = total.filter("n = 0").select("conv_id", "call_id", F.lit(0).alias("level"))
    # A call that refers to nothing has level 0 and is looked up by its absence.
    plain = known_edges.join(total.select("conv_id", F.col("call_id").alias("parent")), ["conv_id", "parent"], "left_anti")
    plain = plain.select("conv_id", F.col("parent").alias("call_id"), F.lit(0).alias("level")).distinct()
    done, n, before = stored(done.unionByName(plain), "levels"), None, -1
    while True:
        n = done.count()
        if n == before:
            break
        before = n
        above = done.withColumnRenamed("call_id", "parent")
        reached = known_edges.join(above, ["conv_id", "parent"]).groupBy("conv_id", "call_id")
        reached = reached.agg(F.count("*").alias("m"), (F.max("level") + 1).alias("level"))
        ready = reached.join(total, ["conv_id", "call_id"]).filter("m = n").select("conv_id", "call_id", "level")
        new = ready.join(done, ["conv_id", "call_id"], "left_anti")
        done = stored(done.unionByName(new), "levels")
    rows = total.join(done, ["conv_id", "call_id"], "left")
    return rows.select("conv_id", "call_id", "level", "unknown_reference", F.col("level").isNull().alias("cycle"))


def argument_problems(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Names of the ways in which ``arguments`` (JSON text) break the schema of the tool ``name``.

    A schema maps a property to its type and whether it must be there.
    """
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    tools = F.when(name.isNull() | ~name.isin(*schemas), F.array(F.lit("unknown_tool")))
    for tool, properties in schemas.items():
        found = []
        for p, (kind, required) in sorted(properties.items()):
            value = F.schema_of_variant(F.try_variant_get(parsed, f"$['{p}']", "variant"))
            absent = F.lit(f"missing:{p}") if required else F.lit(None).cast("string")
            found.append(F.when(value.isNull(), absent).when(~value.rlike(TYPES[kind]), F.lit(f"type:{p}")))
        extra = F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(p) for p in properties]))
        extra = F.transform(F.array_sort(extra), lambda k: F.concat(F.lit("unexpected:"), k))
        problems = F.array_compact(F.concat(F.array(*found), F.coalesce(extra, F.array().cast("array<string>"))))
        tools = tools.when(name == tool, F.when(is_object, problems).otherwise(F.array(F.lit("not_an_object"))))
    return tools


def calls_and_results(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """``conv_id, turn, call_id, name, level, result_turn, problems, json`` of every call and every result: each result is with its call or a row of its own."""
    calls = calls.select(*[c.strip() for c in CALLS.split(",")])
    found = stored(answers(calls, results), "answers")
    linked = stored(linked_answers(found), "linked")
    return _formatted(calls, linked, unlinked_results(found, linked, results), schemas)


def _formatted(calls: DataFrame, linked: DataFrame, unlinked: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    rows = calls.join(levels(calls), ["conv_id", "call_id"], "left").join(linked, ["conv_id", "call_id", "turn"], "left")
    rows = rows.withColumn("level", F.when(F.coalesce("cycle", F.lit(False)), F.lit(None)).otherwise(F.coalesce("level", F.lit(0))))
    flags = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(c)) for c in ("cycle", "unknown_reference")]))
    rows = rows.withColumn("problems", F.concat(argument_problems(F.col("name"), F.col("arguments"), schemas), flags))
    lone = unlinked.select(
        "conv_id", "turn", "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"),
        F.lit(0).alias("level"), F.col("turn").alias("result_turn"), "result", F.array("problem").alias("problems"),
    )
    rows = rows.select(*lone.columns).unionByName(lone)
    parsed = F.try_parse_json("arguments")
    usable = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)
    # Keys in code point order.
    json = F.to_json(F.struct(usable.alias("arguments"), F.col("call_id").alias("id"), "name", "result"))
    return rows.select("conv_id", "turn", "call_id", "name", F.col("level").cast("bigint").alias("level"), "result_turn", "problems", json.alias("json"))
