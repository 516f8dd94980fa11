"""Array and map functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_ws


def replace_tag(tags: Column, old: Column | str, new: Column | str) -> Column:
    """A tag replaced, each tag kept once in its first place."""
    old, new = (F.lit(x) if isinstance(x, str) else x for x in (old, new))
    return F.array_distinct(F.transform(tags, lambda t: F.when(t == old, new).otherwise(t)))


def csv_list(c: Column) -> Column:
    """Comma-separated values, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, ","), trim_ws), lambda x: x != "")


def as_list(c: Column) -> Column:
    """A list written ``[a, b]`` or as one scalar."""
    inner = F.regexp_extract(trim_ws(c), r"^\[(.*)\]$", 1)
    values = F.when(trim_ws(c).rlike(r"^\[.*\]$"), csv_list(inner)).otherwise(F.filter(F.array(trim_ws(c)), lambda x: x != ""))
    return F.transform(values, lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))


def segment_key(tag: Column) -> Column:
    """The set of a tag's segments, in order, as one string."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(tag, "/"))), "/")


def with_parents(parent: Column, children: Column) -> Column:
    """A parent and each ``parent/child``."""
    return F.concat(F.array(parent), F.transform(children, lambda c: F.concat(parent, F.lit("/"), c)))


def attribute(pairs: Column, key: str) -> Column:
    """The value of ``Key: value`` lines by key, case aside."""
    entries = F.transform(F.filter(pairs, lambda p: p.contains(":")), lambda p: F.struct(F.lower(trim_ws(F.split_part(p, F.lit(":"), F.lit(1)))).alias("k"), trim_ws(F.regexp_replace(p, r"^[^:]*:", "")).alias("v")))
    return F.try_element_at(F.transform(F.filter(entries, lambda e: e["k"] == key.lower()), lambda e: e["v"]), F.lit(1))


def tagged(tags: Column, tag: str) -> Column:
    """Whether any tag is the given one or below it."""
    return F.exists(tags, lambda t: (t == tag) | t.startswith(tag + "/"))
