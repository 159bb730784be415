"""The error value carried by a command that could not be read.

Fixed values: the class names and the message texts.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from delayfold.model import ERROR


def _error(kind: str, cause: Column, message: Column, cause_message: Column, paths: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("class"),
        cause.alias("cause_class"),
        message.alias("message"),
        cause_message.alias("cause_message"),
        paths.alias("paths"),
    ).cast(ERROR)


def undecodable(schedule_id: Column, cause_class: Column, cause_message: Column) -> Column:
    """A payload that is not readable in its format, with the finer reason as the cause."""
    return _error(
        "decode",
        cause_class,
        F.concat(F.lit("Failed to decode ["), schedule_id, F.lit("]")),
        cause_message,
        F.array(),
    )


def untransformable(schedule_id: Column, paths: Column) -> Column:
    """A readable payload with fields that cannot be converted; one path per bad field."""
    listed = F.array_join(
        F.transform(
            paths,
            lambda p: F.concat(F.lit("error transforming "), p["path"], F.lit(": "), p["message"]),
        ),
        ", ",
    )
    return _error(
        "transformation",
        F.lit("transformation"),
        F.concat(F.lit("Failed to decode ["), schedule_id, F.lit("]: "), listed),
        F.lit(None).cast("string"),
        paths,
    )


def none() -> Column:
    return F.lit(None).cast(ERROR)
