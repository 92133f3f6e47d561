"""Tool calls of conversations: linked to results, ordered, validated, as canonical JSON lines.

Only DataFrame operations. Calls and results meet in a hash join by call identifier. Calls are ordered
topologically by levels: level 0 depends on nothing, a call's level is one more than the greatest of
those it depends on. Calls with exactly one dependency form chains, whose ends are found by doubling the
distance each round; only calls with several dependencies are then settled round by round, over chains
that are one edge each. So a chain of any length takes a logarithmic number of rounds, the edges never
grow beyond the dependencies, and a hot conversation costs no more than others. Calls in a cycle, or that
depend on an unknown call, never settle and get no level.

Arguments are parsed as they are written and checked by type at every depth (`checked_arguments`). A line
has its keys in alphabetical order, no white space, and no null fields; so have arguments, whose values are
those that were written.

Defined results: a call without identifier is linked with nothing, depends on nothing others see and
is still given; of repeated call rows each is given; of several results of one call the least turn,
then the least text, is taken, and `results` counts them; results without a call are left out
(`orphans` lists them); null or broken arguments and unknown tools are invalid; a null dependency is
ignored; no calls give no rows; extra columns are ignored; arguments beyond the size Spark's variants hold
(16 MB) are invalid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glasspool.operators.joins import reshuffled
from glasspool.workspace import Workspace

#: call frame: conv_id, turn, call_id, name, arguments (JSON text), depends_on (array of call ids)
#: result frame: call_id, turn, content


def _chains(nodes: DataFrame, edges: DataFrame, workspace: Workspace) -> DataFrame:
    """(call_id, anchor, distance) of calls with one dependency: the first call on their way that has none or
    several, and the steps to it. Calls whose way ends in an unknown call, or never, have no row."""
    single = edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("anchor")).filter("n = 1")
    singles = workspace.store(single.select("call_id", "anchor"))
    others = reshuffled(nodes, "call_id").join(reshuffled(singles, "call_id"), "call_id", "left_anti")
    ends = workspace.store(others)
    # `on`: the anchor is a chain's call itself, so the way goes on from there
    going = singles.select(F.col("call_id").alias("anchor"), F.lit(True).alias("on"))
    reached = ends.select(F.col("call_id").alias("anchor"), F.lit(False).alias("on"))
    ways = workspace.store(
        singles.join(reshuffled(going.unionByName(reached), "anchor"), "anchor")
        .select("call_id", "anchor", F.lit(1).cast("long").alias("distance"), "on")
    )
    # every round doubles the distance of those that go on; beyond all calls there are only cycles
    for _ in range(max(1, singles.count()).bit_length()):
        if ways.filter("on").isEmpty():
            break
        further = ways.select(
            F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("distance").alias("more"), F.col("on").alias("next_on")
        )
        moved = ways.filter("on").join(reshuffled(further, "anchor"), "anchor").select(
            "call_id", F.col("next").alias("anchor"), (F.col("distance") + F.col("more")).alias("distance"), F.col("next_on").alias("on")
        )
        ways = workspace.store(ways.filter(~F.col("on")).unionByName(moved))
    return ways.filter(~F.col("on")).drop("on")


def levels(calls: DataFrame, workspace: Workspace) -> DataFrame:
    """(call_id, level) of every call that can be ordered."""
    known = calls.filter(F.col("call_id").isNotNull())
    nodes = workspace.store(known.select("call_id").distinct())
    edges = workspace.store(
        known.select("call_id", F.explode("depends_on").alias("needs")).filter(F.col("needs").isNotNull()).distinct()
    )
    chains = workspace.store(_chains(nodes, edges, workspace))
    counts = workspace.store(edges.groupBy("call_id").count())
    free = nodes.join(reshuffled(counts, "call_id"), "call_id", "left_anti").withColumn("level", F.lit(0).cast("long"))
    # the levels of calls with none or several dependencies, all rounds in one table
    path = workspace.fresh_path("levels")
    free.write.parquet(path)
    settled = calls.sparkSession.read.schema("call_id string, level long").parquet(path)
    several = edges.join(reshuffled(counts.filter("count > 1"), "call_id"), "call_id", "left_semi")
    by_chain = chains.select(F.col("call_id").alias("needs"), "anchor", "distance")
    waiting = workspace.store(
        several.join(reshuffled(by_chain, "needs"), "needs", "left").select(
            "call_id", F.coalesce("anchor", "needs").alias("needs"), (F.coalesce("distance", F.lit(0)) + 1).cast("long").alias("distance"),
            F.lit(None).cast("long").alias("level"),
        )
    )
    latest = settled
    while not waiting.isEmpty():
        # dependencies that settled last are filled in; calls without open ones settle now
        found = latest.select(F.col("call_id").alias("needs"), F.col("level").alias("found"))
        filled = workspace.store(
            waiting.join(reshuffled(found, "needs"), "needs", "left").select(
                "call_id", "needs", "distance", F.coalesce("level", F.col("found") + F.col("distance")).alias("level")
            )
        )
        state = filled.groupBy("call_id").agg(F.max("level").alias("level"), F.bool_and(F.col("level").isNotNull()).alias("ready"))
        latest = workspace.store(state.filter("ready").select("call_id", "level"))
        if latest.isEmpty():
            break
        latest.write.mode("append").parquet(path)
        waiting = workspace.store(filled.join(reshuffled(latest, "call_id"), "call_id", "left_anti"))
    settled = calls.sparkSession.read.schema("call_id string, level long").parquet(path)
    on_chains = chains.join(reshuffled(settled.withColumnRenamed("call_id", "anchor"), "anchor"), "anchor").select(
        "call_id", (F.col("level") + F.col("distance")).alias("level")
    )
    return settled.unionByName(on_chains)


def _kind(value: Column) -> Column:
    """The type of a parsed value, VOID for a JSON null."""
    return F.schema_of_variant(value)


def _checked(value: Column, kind: T.DataType) -> tuple[Column, Column]:
    """(fits, typed): whether a parsed value that is not null has the type, and the value with the fields of
    structs in alphabetical order and without nulls."""
    written = _kind(value)
    if isinstance(kind, T.StructType):
        return _checked_struct(F.try_variant_get(value, "$", "map<string,variant>"), written, kind)
    if isinstance(kind, T.ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        fits = F.forall(items, lambda x: _checked_part(x, kind.elementType, kind.containsNull)[0])
        typed = F.transform(items, lambda x: _checked_part(x, kind.elementType, kind.containsNull)[1])
        return written.startswith("ARRAY<") & fits, typed
    if isinstance(kind, T.MapType):
        held = F.try_variant_get(value, "$", "map<string,variant>")
        fits = F.forall(F.map_values(held), lambda x: _checked_part(x, kind.valueType, kind.valueContainsNull)[0])
        typed = F.transform_values(held, lambda _, x: _checked_part(x, kind.valueType, kind.valueContainsNull)[1])
        return written.startswith("OBJECT<") & fits, typed
    if isinstance(kind, T.StringType):
        return written == "STRING", value
    if isinstance(kind, T.BooleanType):
        return written == "BOOLEAN", value
    if isinstance(kind, T.IntegralType):
        # written without a point, and within the range of the type
        return (written == "BIGINT") & F.try_variant_get(value, "$", kind.simpleString()).isNotNull(), value
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        number = (written == "BIGINT") | (written == "DOUBLE") | written.startswith("DECIMAL(")
        return number & F.try_variant_get(value, "$", kind.simpleString()).isNotNull(), value
    # dates and times are written as text
    return (written == "STRING") & F.try_variant_get(value, "$", kind.simpleString()).isNotNull(), value


def _checked_part(value: Column, kind: T.DataType, nullable: bool) -> tuple[Column, Column]:
    """As `_checked` for a value that may be null."""
    fits, typed = _checked(value, kind)
    void = _kind(value) == "VOID"
    return F.when(void, F.lit(nullable)).otherwise(fits), F.when(~void, typed)


def _checked_struct(held: Column, written: Column, kind: T.StructType) -> tuple[Column, Column]:
    """Fields that are not nullable must be there, fields the struct lacks must not; a nullable one may be null."""
    names = F.array(*(F.lit(field.name) for field in kind.fields)).cast("array<string>")
    fits, fields = [written.startswith("OBJECT<"), F.size(F.array_except(F.map_keys(held), names)) == 0], []
    for field in sorted(kind.fields, key=lambda f: f.name):
        good, typed = _checked_part(F.try_element_at(held, F.lit(field.name)), field.dataType, field.nullable)
        there = F.map_contains_key(held, field.name)
        fits.append(F.when(there, good).otherwise(F.lit(field.nullable)))
        fields.append(F.when(there, typed).alias(field.name))
    whole = F.struct(*fields) if fields else F.create_map().cast("map<string,string>")
    return reduce(Column.__and__, fits), whole


def checked_arguments(name: Column, arguments: Column, schemas: dict[str, T.StructType]) -> tuple[Column, Column]:
    """(valid, canonical JSON) by the types of the tool's schema, at every depth.

    The text must be one JSON object and nothing after it, with no key twice. To be sure of its end it is
    parsed as the first of two items, the second being its own digest. A value must be written in its
    type: no text for a number, no number for a text. Values are given as they were written, numbers in
    their shortest form.
    """
    mark = F.sha2(arguments.cast("binary"), 256)
    pair = F.try_parse_json(F.concat(F.lit("["), arguments, F.lit(',"'), mark, F.lit('"]')))
    whole = F.try_variant_get(pair, "$[1]", "string") == mark
    value = F.try_variant_get(pair, "$[0]", "variant")
    valid, canonical = F.lit(False), F.lit(None).cast("string")
    for tool, schema in schemas.items():
        fits, typed = _checked(value, schema)
        good = F.coalesce(whole & fits, F.lit(False))
        here = name == tool
        valid = F.when(here, good).otherwise(valid)
        canonical = F.when(here & good, F.to_json(typed)).otherwise(canonical)
    return valid, canonical


def linked_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, T.StructType], workspace: Workspace) -> DataFrame:
    """(conv_id, turn, call_id, name, level, valid, results, line), one row per call.

    Within a conversation (level, turn, call_id) is a topological order.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on")
    order = levels(calls, workspace)
    answers = results.filter(F.col("call_id").isNotNull()).groupBy("call_id").agg(
        F.min(F.struct("turn", "content")).alias("answer"), F.count("*").alias("results")
    )
    # calls without identifier meet nothing; a key of their own keeps them out of one partition
    key = F.coalesce(F.col("call_id"), F.concat(F.lit("\u0000"), F.xxhash64("conv_id", "turn", "arguments").cast("string")))
    joined = (
        calls.withColumn("call_key", key)
        .join(reshuffled(answers.withColumnRenamed("call_id", "call_key"), "call_key").hint("shuffle_hash"), "call_key", "left")
        .join(reshuffled(order.withColumnRenamed("call_id", "call_key"), "call_key").hint("shuffle_hash"), "call_key", "left")
    )
    valid, arguments = checked_arguments(F.col("name"), F.col("arguments"), schemas)
    line = F.to_json(
        F.struct(
            arguments.alias("arguments"),
            F.col("call_id").alias("id"),
            F.col("name").alias("name"),
            F.col("answer.content").alias("result"),
        )
    )
    level = F.when(F.col("call_id").isNotNull(), F.col("level"))
    return joined.select(
        "conv_id", "turn", "call_id", "name", level.alias("level"), valid.alias("valid"),
        F.coalesce("results", F.lit(0)).cast("long").alias("results"), line.alias("line"),
    )


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose call is not there."""
    ids = calls.select("call_id").filter(F.col("call_id").isNotNull()).distinct()
    return results.join(reshuffled(ids, "call_id"), "call_id", "left_anti")
