"""Outcomes: the size gate, the class of each item, and the sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replaces(bytes_in: Column, bytes_out: Column, bigger: bool = False, dry_run: bool = False) -> Column:
    """Whether the new bytes take the place of the old ones."""
    return F.lit(not dry_run) & (bytes_out > 0) & ((bytes_out < bytes_in) | F.lit(bigger))


def outcome(bytes_in: Column, bytes_out: Column, converted: Column, error: Column, dry_run: Column) -> Column:
    """error, dry_run, converted, saved or lost; no saving counts as lost."""
    smaller = F.when(bytes_out < bytes_in, F.when(converted, "converted").otherwise("saved")).otherwise("lost")
    return F.when(error, "error").when(dry_run, "dry_run").otherwise(smaller)


def percent_saved(bytes_in: Column, bytes_out: Column) -> Column:
    return F.when(bytes_in <= 0, F.lit(0.0)).otherwise(100.0 * (bytes_in - bytes_out) / bytes_in)


def two_places(number: Column) -> Column:
    """A number with two decimal places, rounded by its exact binary value and half to even, as Python and C print it (printf of Java rounds the shortest decimal form half up)."""
    return F.call_function("format_number", number, F.lit("0.00"))


def report_text(name: Column, bytes_in: Column, bytes_out: Column, dry_run: bool = False, bigger: bool = False) -> Column:
    """One line about an item that didn't fail."""
    saved = bytes_in - bytes_out
    words = F.concat(
        F.lit(" would be" if dry_run else ""),
        F.when(saved > 0, " saved").when(saved < 0, " lost").otherwise(""),
        F.when((saved <= 0) & F.lit(not bigger), ", kept original").otherwise(""),
    )
    return F.concat(name, F.lit(": "), two_places(percent_saved(bytes_in, bytes_out)), F.lit("% ("), saved.cast("string"), F.lit(" bytes)"), words)


def error_text(name: Column, error: Column) -> Column:
    """The lines about an item that failed; a program's error tells its return code, command and words."""
    return F.concat(name, F.lit("\n\n\t"), error)


def summary(reports: DataFrame, bigger: bool = False) -> DataFrame:
    """A row per kind: items, bytes in and out. What didn't shrink counts with its old size."""
    smaller = (F.col("bytes_out") < F.col("bytes_in")) & F.lit(not bigger)
    out = F.when(smaller, F.col("bytes_out")).otherwise(F.col("bytes_in"))
    return reports.groupBy("kind").agg(
        F.count("*").alias("n_items"), F.sum("bytes_in").alias("bytes_in"), F.sum(out).alias("bytes_out")
    )


def total_text(totals: DataFrame, dry_run: bool = False) -> DataFrame:
    """The closing sentence, from the rows of :func:`summary`."""
    verbs = ("Could save", "Could even out for", "Could lose") if dry_run else ("Saved", "Evened out", "Lost")
    sums = totals.agg(F.coalesce(F.sum("bytes_in"), F.lit(0)).alias("i"), F.coalesce(F.sum("bytes_out"), F.lit(0)).alias("o"))
    saved = F.col("i") - F.col("o")
    verb = F.when(saved > 0, verbs[0]).when(saved == 0, verbs[1]).otherwise(verbs[2])
    share = two_places(F.abs(percent_saved(F.col("i"), F.col("o"))))
    said = F.concat(verb, F.lit(" a total of "), F.abs(saved).cast("string"), F.lit(" bytes or "), share, F.lit("%"))
    return sums.select(F.when(F.col("i") == 0, "Didn't optimize any files.").otherwise(said).alias("text"))
