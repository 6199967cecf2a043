"""Sets of formats: what is asked for, and whether a handler has a part in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_formats(formats: Column, extra: Column) -> Column:
    """Both sets as one, sorted; null counts as empty."""
    none = lambda c: F.coalesce(c, F.array())
    return F.sort_array(F.array_union(none(formats), none(extra)))


def takes_part(own: Column, asked: Column) -> Column:
    """Whether a handler's formats, in and out, meet those that are asked for; false where either is null."""
    return F.coalesce(F.arrays_overlap(own, asked), F.lit(False))
