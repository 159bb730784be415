"""Record headers as a map with case-insensitive names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from delayfold.functions.text import utf8
from delayfold.model import EXPIRED_KEY, EXPIRED_VALUE


def empty() -> Column:
    return F.expr("cast(map() as map<string, string>)")


def header_entries(headers: Column) -> Column:
    """Named text values of the record headers; a header without a value is dropped."""
    present = F.filter(headers, lambda h: h["value"].isNotNull())
    return F.transform(
        present, lambda h: F.struct(F.lower(h["key"]).alias("key"), utf8(h["value"]).alias("value"))
    )


def from_entries(entries: Column) -> Column:
    """Map of header entries; of equal names the last one counts (a session setting, see `prepare`)."""
    return F.coalesce(F.map_from_entries(entries), empty())


def combine(left: Column, right: Column) -> Column:
    """Union of two maps; the right one wins. The empty map changes nothing."""
    return F.map_concat(left, right)


def transform(metadata: Column, change: Callable[[Column], Column]) -> Column:
    """Metadata after `change`, which takes and gives a map; names stay case-insensitive."""
    lowered = F.transform(
        F.map_entries(change(metadata)),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
    )
    return from_entries(lowered)


def to_map(metadata: Column) -> Column:
    """A plain map of text; an absent one is empty."""
    return F.coalesce(metadata, empty())


def expire(metadata: Column) -> Column:
    return combine(metadata, F.create_map(F.lit(EXPIRED_KEY), F.lit(EXPIRED_VALUE)))


def is_expired(metadata: Column) -> Column:
    return F.lower(F.coalesce(metadata[EXPIRED_KEY], F.lit(""))) == EXPIRED_VALUE
