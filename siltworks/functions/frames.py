"""Durations of the frames of animated images."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def whole_ms(value: Column) -> Column:
    """A duration as whole milliseconds, at least one; noise beyond the sixth decimal doesn't count."""
    return F.greatest(F.lit(1), F.floor(F.round(value, 6))).cast("long")


def filled_ms(value: Column, by: list[str]) -> Column:
    """The same, where a missing duration is the mean of the other frames of the file, which ``by`` names."""
    return whole_ms(F.coalesce(value, F.avg(value).over(Window.partitionBy(*by))))
