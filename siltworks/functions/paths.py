"""Column expressions over paths and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of content that deflating again doesn't shrink.
INCOMPRESSIBLE = (".avif", ".gif", ".jpeg", ".jpg", ".jxl", ".png", ".webp")
#: What is ignored unless that is switched off.
DEFAULT_IGNORES = (r"^\.", r"/\.", r"\.sparsebundle$")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The last suffix with its dot, or ``.tar`` and the last one; empty for a name that only begins with a dot."""
    name = base_name(path)
    last = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    tar = F.regexp_extract(name, r"^.+(\.tar\.[^.]+)$", 1)
    return F.when(tar != "", tar).otherwise(last)


def stem(path: Column) -> Column:
    """The path without its suffix, and without a ``.tar`` before that."""
    return F.regexp_replace(path, r"(?<=[^/])(\.tar)?\.[^./]+$", "")


def final_path(path: Column, out_suffix: Column) -> Column:
    return F.concat(stem(path), out_suffix)


def output_suffix(path: Column, claimed: Column, canonical: Column) -> Column:
    """The path's own suffix if the handler claims it, else the handler's own."""
    return F.when(F.array_contains(claimed, F.lower(suffix(path))), suffix(path)).otherwise(canonical)


def item_name(entry: Column, path: Column, frame: Column) -> Column:
    """Entry name, else path, else the frame's name, else ``Unknown``."""
    framed = F.when(frame.isNotNull(), F.format_string("frame_#%03d.img", frame))
    return F.coalesce(entry, path, framed, F.lit("Unknown"))


def display_name(parents: Column, name: Column) -> Column:
    return F.concat_ws(":", parents, name)


def pseudo_path(parents: Column, name: Column) -> Column:
    """The history as a nested path."""
    return F.concat_ws("/", parents, name)


def working_name(parents: Column, name: Column) -> Column:
    return F.translate(F.concat_ws("__", parents, name), " /", "__")


def pdf_member(number: Column, generation: Column) -> Column:
    """The name of a picture inside a PDF, from which its object is found again."""
    return F.format_string("pdf_obj_%d_%d.jpg", number, generation)


def pdf_object(name: Column) -> Column:
    """The number and the generation of the object that a member's name tells; null for other names."""
    part = lambda k: F.regexp_extract(base_name(name), r"^pdf_obj_(\d+)_(\d+)\.jpg$", k).cast("long")
    return F.when(base_name(name).rlike(r"^pdf_obj_\d+_\d+\.jpg$"), F.struct(part(1).alias("number"), part(2).alias("generation")))


def incompressible(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*INCOMPRESSIBLE)


def ancestors(path: Column) -> Column:
    """The path and all folders above it, as an array: by component, so /a/b is none of /a/bc."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))


def globs_to_regex(globs: list[str], defaults: bool = True) -> str:
    """One expression that finds any of the globs (``*`` runs match anything) or of the default patterns."""
    told = ["^" + ".*".join(re.escape(x) for x in re.split(r"\*+", g)) + "$" for g in globs]
    return "|".join([*told, *(DEFAULT_IGNORES if defaults else ())]) or "(?!)"


def globs_column(globs: Column) -> Column:
    """The same for a column of globs parted by commas, without the defaults; null stays null."""
    each = F.transform(F.split(globs, ","), lambda g: F.regexp_replace(F.btrim(g), r"([.^$+?()\[\]{}|\\])", r"\\$1"))
    told = F.transform(F.filter(each, lambda g: g != ""), lambda g: F.concat(F.lit("^"), F.regexp_replace(g, r"\*+", ".*"), F.lit("$")))
    return F.when(F.size(told) > 0, F.array_join(told, "|"))
