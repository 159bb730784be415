"""JSON command payloads as staged column expressions.

Each payload is parsed once into a VARIANT. The stages are separate projections, so that the parsed
document and the field types are computed once and then referenced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from delayfold.functions.text import base64_problem, is_base64, utf8, whole_number

# Grammar of a JSON number; a `time` given as text must match it.
NUMBER = r"\A-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"


_FIELDS = ("time", "topic", "key", "value", "headers")


def _kind(name: str) -> Column:
    """Type of a field's value; VOID when it is null or not there."""
    return F.coalesce(F.col(f"_{name}_kind"), F.lit("VOID"))


def _text(name: str) -> Column:
    return F.try_variant_get(F.col(f"_nodes.{name}"), "$", "string")


def _numbers_as_text(json: Column) -> Column:
    """JSON with every number in quotes. U+0001, which JSON text cannot hold, marks the places."""
    mark = "\u0001"
    pattern = r'("(?:[^"\\]|\\.)*")|(-?[0-9][0-9.eE+-]*)'
    marked = F.regexp_replace(json, pattern, f"$1{mark}$2{mark}")
    return F.replace(F.replace(marked, F.lit(mark * 2), F.lit("")), F.lit(mark), F.lit('"'))


def _time() -> Column:
    """The due time: a whole number within BIGINT, as a number or as text.

    A number that is not plainly a BIGINT is decided on its text as it was written.
    """
    node, kind = F.col("_nodes.time"), _kind("time")
    written = F.from_json(_numbers_as_text(F.col("_text")), "time string")["time"]
    numeric = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    return (
        F.when(kind == "BIGINT", F.try_variant_get(node, "$", "bigint"))
        .when(numeric, whole_number(written))
        .when((kind == "STRING") & _text("time").rlike(NUMBER), whole_number(_text("time")))
    )


def parse(raw: DataFrame) -> DataFrame:
    """Adds the payload's text, its fields and `_json` / `_shape` (did the checks pass).

    The text is parsed inside brackets, so that anything behind the first value breaks the syntax or
    shows as a second element. A text holding ``]`` could close the bracket itself; only then a
    second parse inside braces decides.
    """
    text = F.col("_text")
    closed = F.when(
        text.contains("]"), F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    ).otherwise(F.lit(True))
    element = lambda i: F.try_variant_get(F.col("_doc"), f"$[{i}]", "variant")
    parsed = raw.withColumn("_text", utf8(F.col("value"))).withColumn(
        "_doc", F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    )
    nodes = parsed.withColumns(
        {
            "_json": element(0).isNotNull() & element(1).isNull() & closed,
            "_nodes": F.try_variant_get(
                F.col("_doc"),
                "$[0]",
                "struct<" + ",".join(f"{name}:variant" for name in _FIELDS) + ">",
            ),
        }
    )
    typed = nodes.withColumns(
        {
            **{
                f"_{name}_kind": F.schema_of_variant(F.col(f"_nodes.{name}"))
                for name in ("time", "topic", "key", "value")
            },
            "_headers_map": F.try_variant_get(F.col("_nodes.headers"), "$", "map<string,variant>"),
            "_no_headers": F.col("_nodes.headers").isNull()
            | F.is_variant_null(F.col("_nodes.headers")),
        }
    )
    header_texts = F.transform(
        F.map_entries("_headers_map"),
        lambda e: F.struct(
            e["key"].alias("key"),
            F.when(
                F.schema_of_variant(e["value"]) == "STRING",
                F.try_variant_get(e["value"], "$", "string"),
            ).alias("text"),
        ),
    )
    no_entries = F.array().cast("array<struct<key:string,text:string>>")
    fields = typed.withColumns(
        {
            "_time": _time(),
            "_topic": _text("topic"),
            "_key64": _text("key"),
            "_value64": _text("value"),
            "_headers64": F.when(F.col("_no_headers"), no_entries).otherwise(header_texts),
        }
    )
    shape = (
        F.col("_time").isNotNull()
        & (_kind("topic") == "STRING")
        & (_kind("key") == "STRING")
        & _kind("value").isin("VOID", "STRING")
        & F.col("_headers64").isNotNull()
        & ~F.coalesce(F.exists("_headers64", lambda h: h["text"].isNull()), F.lit(False))
    )
    return fields.withColumn("_shape", shape)


def check(parsed: DataFrame) -> DataFrame:
    """Adds `_read`: whether and how the payload is readable, its fields, and the bad Base64 fields.

    Strictness is decided once for each field; messages are made for bad ones only. The verdict comes
    from a generator of one row: filters on the envelope pass it, down to the scan, while a filter on
    decoded columns stays above and does not drag a copy of the parse along.
    """
    flagged = parsed.withColumns(
        {
            "_key_good": F.coalesce(is_base64(F.col("_key64")), F.lit(True)),
            "_value_good": F.coalesce(is_base64(F.col("_value64")), F.lit(True)),
            "_headers64": F.transform(
                "_headers64",
                lambda h: F.struct(
                    h["key"].alias("key"), h["text"].alias("text"), is_base64(h["text"]).alias("good")
                ),
            ),
        }
    )
    clean = F.col("_key_good") & F.col("_value_good") & F.forall("_headers64", lambda h: h["good"])

    def problem(path: Column, column: Column) -> Column:
        return F.struct(path.alias("path"), base64_problem(column).alias("message"))

    candidates = F.concat(
        F.array(
            problem(F.lit("key"), F.col("_key64")),
            problem(F.lit("value"), F.col("_value64")),
        ),
        F.transform(
            "_headers64",
            lambda h: problem(F.concat(F.lit("headers("), h["key"], F.lit(")")), h["text"]),
        ),
    )
    no_paths = F.array().cast("array<struct<path:string,message:string>>")
    paths = F.when(clean, no_paths).otherwise(
        F.filter(candidates, lambda c: c["message"].isNotNull())
    )
    shape = F.coalesce(F.col("_json") & F.col("_shape"), F.lit(False))
    good = shape & F.coalesce(clean, F.lit(False))
    verdict = F.struct(
        F.coalesce(F.col("_json"), F.lit(False)).alias("json"),
        shape.alias("shape"),
        good.alias("good"),
        F.when(shape, paths).alias("paths"),
        F.when(good, F.col("_time")).alias("time"),
        F.when(good, F.col("_topic")).alias("topic"),
        F.when(good, F.unbase64("_key64")).alias("key"),
        F.when(good, F.unbase64("_value64")).alias("value"),
        F.when(good, _out_headers()).alias("headers"),
    )
    return flagged.withColumn("_read", F.explode(F.array(verdict)))


def _out_headers() -> Column:
    return F.map_from_entries(
        F.transform(
            "_headers64",
            lambda h: F.struct(h["key"].alias("key"), F.unbase64(h["text"]).alias("value")),
        )
    )


def write(
    due: Column, topic: Column, key: Column, value: Column, headers: Column
) -> Column:
    """JSON payload text of a schedule, bytes as Base64, without spaces."""
    return F.to_json(
        F.struct(
            due.alias("time"),
            topic.alias("topic"),
            F.base64(key).alias("key"),
            F.base64(value).alias("value"),
            F.transform_values(headers, lambda _, v: F.base64(v)).alias("headers"),
        ),
        {"ignoreNullFields": "false"},
    )
