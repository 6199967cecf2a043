"""Which handler takes an item: a join with the table of routes, then a rank."""

from __future__ import annotations

from collections.abc import Mapping
from importlib.metadata import entry_points

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Format, lossless, animated, archive; the native handler; the conversions in the order in which they are tried.
FORMATS = (
    ("GIF", True, False, False, "Gif", ("JXL", "PNG", "WEBP")),
    ("GIF", True, True, False, "GifAnimated", ("PNG", "WEBP")),
    ("JPEG", False, False, False, "Jpeg", ("JXL",)),
    ("MPO", False, True, False, None, ("JPEG",)),
    ("JXL", True, False, False, "JxlLossless", ("WEBP", "PNG")),
    ("PNG", True, False, False, "Png", ("JXL", "WEBP")),
    ("PNG", True, True, False, "PngAnimated", ("WEBP",)),
    ("WEBP", True, False, False, "WebPLossless", ("JXL",)),
    ("WEBP", True, True, False, "WebPAnimated", ("WEBP",)),
    ("SVG", True, False, False, "Svg", ()),
    ("PDF", True, False, True, "Pdf", ()),
    ("ZIP", True, False, True, "Zip", ()),
    ("CBZ", True, False, True, "Cbz", ()),
    ("EPUB", True, False, True, "EPub", ()),
    ("RAR", True, False, True, "Rar", ("ZIP",)),
    ("7Z", True, False, True, "SevenZip", ("ZIP",)),
    ("TAR", True, False, True, "Tar", ("ZIP",)),
    ("TGZ", True, False, True, "TarGz", ("ZIP",)),
    ("TBZ", True, False, True, "TarBz", ("ZIP",)),
    ("TXZ", True, False, True, "TarXz", ("ZIP",)),
    ("CBR", True, False, True, "Cbr", ("CBZ",)),
    ("CB7", True, False, True, "Cb7", ("CBZ",)),
    ("CBT", True, False, True, "Cbt", ("CBZ",)),
)
#: Still formats that can only be converted, in this order; and handlers that can't pack.
CONVERT_ONLY = ("BMP", "CUR", "DIB", "FITS", "IMT", "PCX", "PIXAR", "PPM", "PSD", "QOI", "SGI", "SPIDER", "SUN", "TGA", "TIFF", "XBM", "XPM")
CONVERT_ONLY_TO = ("JXL", "WEBP", "PNG")
NO_PACK = ("Rar", "Cbr")
#: Conversions that an option of their own must switch on.
OPT_IN = {("JPEG", "JXL"): "convert_jpeg_to_jxl", ("WEBP", "JXL"): "convert_webp_to_jxl"}
KEYS = ["format", "lossless", "animated", "archive"]


ROUTE = (
    "plugin string, place int, format string, lossless boolean, animated boolean, archive boolean, "
    "handler string, role string, pos int, out_format string, can_pack boolean, enabled_key string"
)
#: The entry-point group under which other packages register a function that returns rows of ROUTE without plugin and place.
GROUP = "siltworks.routes"


def builtin_routes() -> list[tuple]:
    """The fixed routes as contributions: format columns, handler, role, pos, out_format, can_pack, enabled_key."""
    rows = []
    still = [(f, True, False, False, None, CONVERT_ONLY_TO) for f in CONVERT_ONLY]
    for name, lossless, animated, archive, native, chain in (*FORMATS, *still):
        rows += [(name, lossless, animated, archive, f"To{to}", "convert", i, to, archive, OPT_IN.get((name, to))) for i, to in enumerate(chain)]
        if native:
            rows.append((name, lossless, animated, archive, native, "native", 0, name, archive and native not in NO_PACK, None))
    return rows


def contributions(spark: SparkSession, plugins: Mapping[str, list[tuple]] | None = None) -> DataFrame:
    """All contributed routes (ROUTE): the fixed ones first, then those of installed packages by name, then ``plugins`` in their order."""
    found = {e.name: e.load()() for e in sorted(entry_points(group=GROUP), key=lambda e: e.name)}
    each = {"builtin": builtin_routes(), **found, **(plugins or {})}
    return spark.createDataFrame([(name, place, *row) for place, (name, rows) in enumerate(each.items()) for row in rows], ROUTE)


def merge_routes(each: DataFrame, enabled: list[str] = ()) -> DataFrame:
    """One table of routes from the contributions ``each`` (ROUTE), for any number of them.

    A format has one native handler, that of the last contribution; conversions
    are joined in the order of the contributions, a handler counting where it comes
    first. Routes with an ``enabled_key`` count only if it is among ``enabled``.
    """
    on = each.where(F.col("enabled_key").isNull() | F.coalesce(F.col("enabled_key").isin(*enabled), F.lit(False)) if enabled else F.col("enabled_key").isNull())
    order = F.struct("place", "pos", "handler")
    what = F.struct("out_format", "can_pack")
    native = on.where("role = 'native'").groupBy(*KEYS).agg(F.max_by(F.struct("handler", "out_format", "can_pack"), order).alias("of"))
    native = native.select(*KEYS, "of.handler", F.lit("native").alias("role"), F.lit(0).alias("pos"), "of.out_format", "of.can_pack")
    first = on.where("role = 'convert'").groupBy(*KEYS, "handler").agg(F.min(order).alias("at"), F.min_by(what, order).alias("of"))
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("at")) - 1
    convert = first.select(*KEYS, "handler", F.lit("convert").alias("role"), place.alias("pos"), "of.out_format", "of.can_pack")
    return native.unionByName(convert)


def routes(spark: SparkSession, plugins: Mapping[str, list[tuple]] | None = None, enabled: list[str] = ()) -> DataFrame:
    """format, lossless, animated, archive, handler, role (convert or native), pos, out_format, can_pack."""
    return merge_routes(contributions(spark, plugins), enabled)


def convert_sources(table: DataFrame, convert_to: list[str], ready: DataFrame | None = None) -> DataFrame:
    """out_format and sources: for each target the formats that a run turns into it, by the decision that the run makes."""
    keys = table.select(*KEYS).distinct().withColumn("convert", F.lit(True))
    out = None
    for archive in (False, True):
        own = keys.where(F.col("archive") == archive).withColumn("item_id", F.struct(*KEYS))
        picked = pick_handlers(own, table, convert_to, repack=archive, ready=ready).where("role = 'convert'")
        picked = picked.select("out_format", F.col("item_id.format").alias("format"))
        out = picked if out is None else out.unionByName(picked)
    return out.groupBy("out_format").agg(F.sort_array(F.collect_set("format")).alias("sources"))


def pick_tools(tools: DataFrame, disabled: list[str] = ()) -> DataFrame:
    """The first tool at hand of each handler's tier; ``tools``: handler, tier, alt, tool, required, available."""
    first = Window.partitionBy("handler", "tier").orderBy("alt")
    at_hand = tools.where(F.col("available") & ~F.coalesce(F.col("tool").isin(*disabled), F.lit(False)) if disabled else F.col("available"))
    return at_hand.withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank")


def ready_handlers(tools: DataFrame) -> DataFrame:
    """handler and ready: whether each tier that has a required tool has one at hand."""
    tiers = tools.groupBy("handler", "tier").agg(F.bool_or("available").alias("ok"), F.bool_or("required").alias("needed"))
    return tiers.groupBy("handler").agg(F.bool_and(F.col("ok") | ~F.col("needed")).alias("ready"))


def pick_handlers(
    items: DataFrame, table: DataFrame, convert_to: list[str] | Column, key: str = "item_id", repack: bool = False, ready: DataFrame | None = None
) -> DataFrame:
    """``items`` (with the four format columns and convert) and the handler, out_format and role that take them.

    ``convert_to`` are the formats asked for, or a column of ``items`` that has them.
    The table of routes is a constant of some eighty rows, so it is broadcast; the
    rank is an aggregate by item, without a sort of the items. Archives are
    converted only when they are repacked, and then only by what can pack. Handlers
    that ``ready`` (see :func:`ready_handlers`) tells to lack a required tool are
    passed over, as if they had no route; those that it doesn't name need no tool.
    """
    if ready is not None:
        table = table.join(ready.where("not ready").select("handler"), "handler", "left_anti")
    asked = F.coalesce(F.array_contains(convert_to, F.col("out_format")), F.lit(False)) if isinstance(convert_to, Column) else F.col("out_format").isin(*convert_to)
    may = F.col("convert") & asked & (~F.col("archive") | F.lit(repack))
    held = items.join(F.broadcast(table), KEYS).where(((F.col("role") == "native") | may) & (F.col("can_pack") | F.lit(not repack)))
    best = F.min_by(F.struct("handler", "out_format", "role"), F.struct("role", "pos"))
    chosen = held.groupBy(key).agg(best.alias("of"))
    return chosen.select(key, "of.handler", "of.out_format", "of.role")
