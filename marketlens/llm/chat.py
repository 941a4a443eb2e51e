"""Chat formatting: tool calls linked to their results.

Calls and results meet in a hash join on the identifier (results are first reduced to one row per identifier,
so repeated identifiers never multiply).  Dependencies between calls give topological levels by pointer
doubling: each round replaces a call's ancestor by that ancestor's ancestor, so a chain of n calls takes log n
joins; calls without an ancestor left take no part in further rounds.  Arguments are validated against a schema as column expressions on a parsed variant, and every link is
serialised as one line of canonical JSON: keys in order, no blanks.

Defined results: a call without a result has none and null in its line; several results of one identifier
count, the first by sequence and content is used; results without a call come as rows of kind "orphan"; a call
that depends on an unknown call is a root with an error; calls on a cycle, or behind one, have a null level and
an error; arguments that are no JSON object are invalid; null identifiers link with nothing; messages of other roles,
null ones too, are rows of kind "message"; columns beside those named are dropped, whatever their names; repeated calls
each have a row; very long texts are kept whole; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import stored


@dataclass(frozen=True)
class Field:
    """One argument of a tool: JSON type (string, integer, number, boolean), whether it must be there, bounds."""

    name: str
    kind: str
    required: bool = True
    least: float | None = None
    most: float | None = None


#: Variant types that satisfy a JSON type.
_FITS = {"string": r"STRING", "integer": r"BIGINT", "number": r"BIGINT|DECIMAL.*|DOUBLE|FLOAT", "boolean": r"BOOLEAN"}


def errors(arguments: Column, schema: list[Field]) -> Column:
    """Array of what is wrong with a JSON text of arguments, in the schema's order; empty if it is valid."""
    v = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    checks = [F.when(F.coalesce(~F.schema_of_variant(v).startswith("OBJECT"), F.lit(True)), F.lit("not an object"))]
    for f in schema:
        at = F.try_variant_get(v, f"$.{f.name}", "variant")
        there = F.coalesce(F.array_contains(keys, f.name), F.lit(False)) & at.isNotNull() & (F.schema_of_variant(at) != "VOID")
        if f.required:
            checks.append(F.when(~there, F.lit(f"{f.name}: missing")))
        checks.append(F.when(there & ~F.schema_of_variant(at).rlike(rf"\A(?:{_FITS[f.kind]})\z"), F.lit(f"{f.name}: not {f.kind}")))
        size = F.length(F.try_variant_get(v, f"$.{f.name}", "string")) if f.kind == "string" else F.try_variant_get(v, f"$.{f.name}", "double")
        if f.least is not None:
            checks.append(F.when(there & (size < f.least), F.lit(f"{f.name}: below {f.least:g}")))
        if f.most is not None:
            checks.append(F.when(there & (size > f.most), F.lit(f"{f.name}: above {f.most:g}")))
    extra = F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*[F.lit(f.name) for f in schema]))
    return F.concat(F.array_compact(F.array(*checks)), F.transform(F.array_sort(extra), lambda k: F.concat(k, F.lit(": unknown"))))


def levels(calls: DataFrame) -> DataFrame:
    """(id, level, dangling) of each distinct identifier of ``calls`` (id, after); level is null on a cycle.

    Only calls that still have an ancestor go on to the next round; the others are set aside.
    """
    nodes = stored(calls.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("after").alias("after")), "nodes")
    known = nodes.select(F.col("id").alias("after"), F.lit(True).alias("known"))
    roots = nodes.where(F.col("after").isNull()).select("id", F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("level"), F.lit(False).alias("dangling"))
    rest = nodes.where(F.col("after").isNotNull()).join(known, "after", "left")
    up, level = F.when(F.col("known"), F.col("after")), F.when(F.col("known"), 1).otherwise(0).cast("long")
    rest = stored(rest.select("id", up.alias("up"), level.alias("level"), F.col("known").isNull().alias("dangling")), "levels")
    done, open_ = roots.unionByName(rest.where(F.col("up").isNull())), rest.where(F.col("up").isNotNull())
    for _ in range(max(1, nodes.count()).bit_length() + 1):
        if not open_.head(1):
            break
        above = done.unionByName(open_).select(F.col("id").alias("up"), F.col("up").alias("up_"), F.col("level").alias("level_"))
        step = open_.join(above, "up", "left").select("id", F.col("up_").alias("up"), (F.col("level") + F.coalesce("level_", F.lit(0))).alias("level"), "dangling")
        step = stored(step, "levels")
        done, open_ = done.unionByName(step.where(F.col("up").isNull())), step.where(F.col("up").isNotNull())
    return done.unionByName(open_).select("id", F.when(F.col("up").isNull(), F.col("level")).alias("level"), "dangling")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, list[Field]], messages: DataFrame | None = None) -> DataFrame:
    """Calls (id, seq, name, arguments, after) with results (id, seq, content) as lines of canonical JSON, and other
    messages (id, seq, role, content) as lines of their own.

    Gives kind, id, seq, level, n_results, errors, line: one row per call, result without a call, and message.
    """
    calls = calls.select("id", "seq", "name", "arguments", "after")
    results = results.select("id", "seq", "content")
    known = F.lit(None).cast("array<string>")
    for name, schema in schemas.items():
        known = F.when(F.col("name") == name, errors(F.col("arguments"), schema)).otherwise(known)
    first = results.where(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n_results"), F.min(F.struct("seq", "content")).alias("first"))
    joined = calls.join(first, "id", "left").join(levels(calls), "id", "left")
    wrong = F.concat(
        F.coalesce(known, F.array(F.lit("unknown tool"))),
        F.array_compact(F.array(F.when(F.col("dangling"), F.lit("depends on an unknown call")), F.when(F.col("id").isNotNull() & F.col("level").isNull(), F.lit("depends on itself")))),
    )
    sorted_json = F.coalesce(F.to_json(F.try_parse_json(F.col("arguments"))), F.to_json(F.struct(F.col("arguments").alias("raw"))))
    line = F.concat(
        F.lit('{"arguments":'), sorted_json,
        F.lit(',"id":'), _text(F.col("id")),
        F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")),
        F.lit(',"name":'), _text(F.col("name")),
        F.lit(',"result":'), _text(F.col("first.content")),
        F.lit("}"),
    )
    done = joined.select(F.lit("call").alias("kind"), "id", "seq", "level", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.array_join(wrong, "; ").alias("errors"), line.alias("line"))
    alone = results.join(calls.select("id").where(F.col("id").isNotNull()).distinct(), "id", "left_anti")
    orphan = F.concat(F.lit('{"id":'), _text(F.col("id")), F.lit(',"result":'), _text(F.col("content")), F.lit("}"))
    none = F.lit(None).cast("long")
    out = done.unionByName(alone.select(F.lit("orphan").alias("kind"), "id", "seq", none.alias("level"), F.lit(1).cast("long").alias("n_results"), F.lit("no call").alias("errors"), orphan.alias("line")))
    if messages is None:
        return out
    said = F.concat(F.lit('{"content":'), _text(F.col("content")), F.lit(',"id":'), _text(F.col("id")), F.lit(',"role":'), _text(F.col("role")), F.lit("}"))
    return out.unionByName(messages.select(F.lit("message").alias("kind"), "id", "seq", none.alias("level"), F.lit(0).cast("long").alias("n_results"), F.lit("").alias("errors"), said.alias("line")))


def _text(c: Column) -> Column:
    """A JSON string, or null."""
    quoted = F.to_json(F.struct(c.alias("x")))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(quoted, 6, 2147483647).substr(F.lit(1), F.length(quoted) - 6))
