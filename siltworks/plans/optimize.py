"""The whole run: scan, skip, detect, unpack, optimise, pack, gate, report.

Containers are opened level by level, until none is left or down to ``max_depth``
where that is given, and packed level by level up again. Contents are written once:
a level is a view of the table that its members were unpacked to, with their
formats and sizes beside them, so what asks for those reads no content.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.jpeg import tiff_is_lossless
from siltworks.functions.paths import base_name, final_path, globs_column, suffix
from siltworks.functions.pdf import may_be_rewritten
from siltworks.functions.sniff import bytes_column, jxl_lossless, magic_format, webp_lossless
from siltworks.operators.archives import TARS, ZIPS, pack, unpack
from siltworks.operators.codecs import tools
from siltworks.operators.reports import outcome, replaces
from siltworks.operators.routing import pick_handlers, pick_tools, ready_handlers, routes
from siltworks.operators.skip import STAMP_MEMBER, changed, wanted
from siltworks.operators.stamps import member_stamps, newest_member_stamp
from siltworks.operators.tiers import Stage, of_codecs, pipelines, run_tiers
from siltworks.sources.staging import stage

#: Formats of containers by suffix, and the kinds of bytes that each may have.
BY_SUFFIX = {
    ".zip": "ZIP", ".cbz": "CBZ", ".epub": "EPUB", ".tar": "TAR", ".cbt": "CBT", ".tar.gz": "TGZ", ".tgz": "TGZ",
    ".tar.bz2": "TBZ", ".tbz": "TBZ", ".tar.xz": "TXZ", ".txz": "TXZ", ".rar": "RAR", ".cbr": "CBR", ".7z": "7Z", ".cb7": "CB7",
}
BYTES = {"ZIP": ("ZIP", "CBZ", "EPUB"), "RAR": ("RAR", "CBR"), "7Z": ("7Z", "CB7"), "GZ": ("TGZ",), "BZ2": ("TBZ",), "XZ": ("TXZ",), "TAR": ("TAR", "CBT")}

#: Formats of which only some files may be written anew, lossless ones or those that aren't signed, and what tells them.
LOSSLESS = {"WEBP": webp_lossless, "JXL": jxl_lossless, "TIFF": tiff_is_lossless, "PDF": may_be_rewritten}
CONTAINERS = (*ZIPS, *TARS, "APNG")
#: Leaves that may become another format here: format, lossless, animated, and the format that they become.
LEAF_TARGETS = (("MPO", False, True, "JPEG"),)
#: Names that settings have for formats that are told apart here.
AS_NAMED = {"APNG": "PNG"}


def described(items: DataFrame) -> DataFrame:
    """``items`` (path or name, content) with format and size, which go into a staged table beside the contents.

    Rules are tried by priority: pictures by their bytes first, then containers,
    whose suffix and bytes must agree, then what is told by its suffix alone. Each
    step is a column of its own, as an expression that is used often would be
    planned as often.
    """
    name, content, told = F.col("path" if "path" in items.columns else "name"), F.col("content"), F.col("_told")
    out = items.withColumn("_told", magic_format(content)).withColumn("_end", F.lower(suffix(name)))
    # the control chunk of an animation, with the length that it always has; and the list of pictures of an MPO, a segment
    moves = F.instr(F.hex(F.substring(content, 1, 4096)), "000000086163544C")
    several = F.hex(F.substring(content, 1, 1 << 17)).rlike("FFE2.{4}4D504600")
    finer = F.when(told == "PNG", F.when((moves > 0) & (moves % 2 == 1), "APNG").otherwise("PNG")).when(told == "JPEG", F.when(several, "MPO").otherwise("JPEG"))
    out = out.withColumn("_told", finer.when(told.isNull() & tar_header(content), "TAR").otherwise(told))
    out = out.withColumn("_precise", F.create_map(*(F.lit(x) for pair in BY_SUFFIX.items() for x in pair))[F.col("_end")])
    agrees = F.array_contains(F.create_map(*(x for kind, kinds in BYTES.items() for x in (F.lit(kind), F.array(*map(F.lit, kinds)))))[told], F.col("_precise"))
    other = F.coalesce(F.when(~told.isin("GZ", "BZ2", "XZ", "TAR"), told), F.when(F.col("_end") == ".svg", "SVG"))
    out = out.withColumn("format", F.when(agrees, F.col("_precise")).otherwise(other))
    return out.withColumn("size", F.octet_length("content").cast("long")).drop("_told", "_end", "_precise")


def tar_header(content: Column) -> Column:
    """Whether the first block's sum is the one it tells, as in tars of before the magic number: octal digits, the sum's own place as blanks."""
    block = F.substring(content, 1, 512)
    field = F.regexp_extract(F.decode(F.substring(content, 149, 8), "ISO-8859-1"), r"^ *([0-7]+)[\x00 ]", 1)
    each = F.sequence(F.lit(1), F.lit(512))
    byte = lambda i: F.conv(F.hex(F.substring(block, i, F.lit(1))), 16, 10).cast("int")
    total = F.aggregate(each, F.lit(0), lambda a, i: a + F.when((i > 148) & (i <= 156), 32).otherwise(byte(i)))
    # cheap tests come first; most files have no octal number there
    return F.when((F.octet_length(content) >= 512) & (field != ""), total == F.conv(field, 8, 10).cast("int")).otherwise(F.lit(False))


def chosen_pipelines(spark: SparkSession, disabled: list[str] = ()) -> dict[str, tuple[tuple[str, Stage], ...]]:
    """Each format's tools, from the table of tools as they are where tasks run: some twenty rows."""
    found = tools(spark)
    found = found.where(~F.col("tool").isin(*disabled)) if disabled else found
    ready = [r["handler"] for r in ready_handlers(found).where("ready").collect()]
    return pipelines(pick_tools(found).collect(), ready)


def optimize(
    items: DataFrame,
    ignore: str = r"^\.|/\.",
    bigger: bool = False,
    max_depth: int | None = None,
    codecs: Mapping[str, Callable[[bytes], bytes]] | None = None,
    convert_to: list[str] = (),
    dry_run: bool = False,
    fail_fast: bool = False,
    fail_fast_container: bool = False,
    disabled: list[str] = (),
    plugins: Mapping[str, list[tuple]] | None = None,
    enabled: list[str] = (),
) -> DataFrame:
    """item_id, path, target, format, bytes_in, bytes_out, changed, kind, error, stages, scanned and data of ``items`` (path, content).

    data holds the new bytes where they replace the old ones, and target the path
    that they go to. A member that fails keeps its bytes and marks its container
    with the error. Containers become one of ``convert_to`` (ZIP, CBZ) by the table
    of routes, and an MPO a JPEG if that is asked for; if the new bytes pass the
    gate, a member gets the new suffix. Lossy files of formats that may be lossless
    are left alone. A dry run works all out and changes nothing. Animated PNGs are
    containers of frames.

    Leaves go through the tools at hand for their format (not ``disabled``), or
    through ``codecs`` in their place; stages tells what each tool made of them, and
    scanned is the sha256 of the old content. ``plugins`` contribute routes, and
    ``enabled`` switches on those that need it.

    ``items`` may have settings, a map of the options that hold where they lie:
    formats, convert_to, ignore (names, or globs, parted by commas), bigger,
    keep_metadata, near_lossless, png_max. They beat this call's arguments, hold for
    members of containers too, and what isn't among the formats is left out, or
    carried over as a member. ``items`` that are staged with :func:`described` are
    not written again.

    Archives may hold stamp files: members that are no newer than their stamp there
    are carried over, and the stamp files go when the archive is packed anew, which
    they call for. With ``fail_fast_container`` a failure anywhere in a container
    leaves the outermost one as it was; with ``fail_fast`` the run raises an error
    at the first level of which a container has failed.
    """
    spark = items.sparkSession
    by_format = chosen_pipelines(spark, disabled) if codecs is None else of_codecs(codecs)
    ready = ready_handlers(tools(spark))
    settled = "settings" in items.columns
    settings = F.to_json("settings") if settled else F.lit(None).cast("string")
    if "format" not in items.columns:
        items = stage(described(items))
    top = items.select(
        F.col("path").alias("item_id"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("archive_index"),
        F.col("path").alias("name"), F.lit("file").alias("kind"), settings.alias("settings"), "content", "size", "format",
    )
    named = F.regexp_extract("name", r"([^/]*)$", 1)
    top = top.where(_wanted(named, ignore, settled) & _in_scope(settled)).withColumn("process", F.lit(True))
    levels, entries = [top], []
    while max_depth is None or len(entries) < max_depth:
        opened = levels[-1].where(F.col("process") & F.col("format").isin(*CONTAINERS))
        frame = F.col("header").startswith('{"frame"') & (F.col("format") == "PNG")
        members = stage(described(unpack(opened)).withColumn("format", F.when(frame, "PNGFRAME").otherwise(F.col("format"))))
        has = members.agg(F.count("*").alias("rows"), F.count_if(stamp_file(F.col("name"))).alias("stamp_files")).first()
        if not has["rows"]:
            break
        entries.append(members)
        child = members.where("kind = 'file'").where(~stamp_file(F.col("name")))
        if has["stamp_files"]:
            newest = newest_member_stamp(child.select("container_id", "archive_index", "name"), member_stamps(members))
            child = child.join(newest, ["container_id", "archive_index"], "left")
        else:  # as in most runs, and then contents need no join
            child = child.withColumn("stamp", F.lit(None).cast("double"))
        process = _wanted(F.col("name"), ignore, settled) & _in_scope(settled) & changed(F.col("mtime"), F.col("stamp"))
        levels.append(
            child.select(
                F.concat_ws(":", "container_id", F.format_string("%d", "archive_index")).alias("item_id"), F.col("container_id").alias("parent"),
                "archive_index", "name", "kind", "settings", "content", "size", "format", F.coalesce(process, F.lit(False)).alias("process"),
            )
        )
    below = None
    for depth in range(len(levels) - 1, -1, -1):
        level = _routed(levels[depth], convert_to, settled, routes(spark, plugins, enabled), ready)
        new = run_tiers(_lossless(level.where("process"), by_format), by_format)
        if below is not None:
            new = new.unionByName(_repack(level, entries[depth], below), allowMissingColumns=True)
        converted = F.col("format") != F.col("out_format")
        larger = F.coalesce(F.lower(_setting("bigger")) == "true", F.lit(bigger)) if settled else F.lit(bigger)
        gate = replaces(F.col("size"), F.coalesce(F.octet_length("optimized"), F.lit(0)), larger)
        if fail_fast_container:
            gate = gate & F.col("error").isNull()
        below = stage(
            level.join(new, "item_id", "left").select(
                "item_id", "parent", "archive_index", "format", F.col("size").alias("bytes_in"),
                F.coalesce(F.octet_length("optimized"), F.col("size")).cast("long").alias("bytes_out"),
                gate.alias("changed"), "error", "stages", F.when(gate, F.col("optimized")).alias("data"), (gate & converted).alias("converted"),
                F.when(gate & converted, final_path(F.col("name"), F.lower(F.concat(F.lit("."), "out_format")))).otherwise(F.col("name")).alias("new_name"),
                F.sha2("content", 256).alias("scanned") if depth == 0 else F.lit(None).cast("string").alias("scanned"),
            )
        )
        if fail_fast and (bad := below.where(F.col("error").isNotNull() & F.col("format").isin(*CONTAINERS)).select("item_id", "error").first()):
            raise RuntimeError(f"{bad.item_id}: {bad.error}")
    kind = outcome(F.col("bytes_in"), F.col("bytes_out"), F.coalesce("converted", F.lit(False)), F.col("error").isNotNull(), F.lit(dry_run))
    return below.select(
        "item_id", F.col("item_id").alias("path"), F.col("new_name").alias("target"), "format", "bytes_in", "bytes_out",
        (F.col("changed") & F.lit(not dry_run)).alias("changed"), kind.alias("kind"), "error", "stages", "scanned", F.when(F.lit(not dry_run), F.col("data")).alias("data"),
    )


def _setting(name: str) -> Column:
    """An item's setting; null where it has none."""
    return F.get_json_object("settings", f"$.{name}")


def _list(name: str) -> Column:
    """The upper-cased names that a setting lists; null where it isn't set."""
    return F.transform(F.split(_setting(name), ","), lambda x: F.upper(F.btrim(x)))


def _wanted(name: Column, ignore: str, settled: bool) -> Column:
    """Not ignored by the run, nor by the globs that hold where the item lies."""
    told = wanted(name, ignore)
    return told & ~F.coalesce(F.regexp_like(name, globs_column(_setting("ignore"))), F.lit(False)) if settled else told


def _in_scope(settled: bool) -> Column:
    """Whether the item's format is one of those that its settings name, if they do."""
    if not settled:
        return F.lit(True)
    kind = F.col("format")
    for own, name in AS_NAMED.items():
        kind = F.when(F.col("format") == own, name).otherwise(kind)
    return _setting("formats").isNull() | (F.col("format") == "PNGFRAME") | F.coalesce(F.array_contains(_list("formats"), kind), F.lit(False))


def stamp_file(name: Column) -> Column:
    """Whether a member of an archive is a file of stamps."""
    return base_name(name) == STAMP_MEMBER


def _routed(level: DataFrame, convert_to: list[str], settled: bool, table: DataFrame, ready: DataFrame) -> DataFrame:
    """``level`` and out_format: what a container is packed as, or a leaf becomes. A leaf that can only be converted isn't processed else."""
    only = [kind for kind, *_ in LEAF_TARGETS]
    if not convert_to and not settled:
        return level.withColumn("out_format", F.col("format")).withColumn("process", F.col("process") & ~F.coalesce(F.col("format").isin(*only), F.lit(False)))
    archive = F.col("format").isin(*ZIPS, *TARS)
    lossless, animated = (F.lit(default) for default in (True, False))
    for kind, loses_nothing, moves, _ in LEAF_TARGETS:
        lossless = F.when(F.col("format") == kind, loses_nothing).otherwise(lossless)
        animated = F.when(F.col("format") == kind, moves).otherwise(animated)
    asked = F.array(*(F.lit(x) for x in convert_to)).cast("array<string>")
    asked = F.coalesce(_list("convert_to"), asked) if settled else asked
    of = level.where(F.col("process") & (archive | F.col("format").isin(*only))).select(
        "item_id", "format", lossless.alias("lossless"), animated.alias("animated"), archive.alias("archive"), F.lit(True).alias("convert"), asked.alias("asked")
    )
    packs = pick_handlers(of.where("archive"), table, F.col("asked"), repack=True, ready=ready)
    picked = pick_handlers(of.where("not archive"), table, F.col("asked"), ready=ready)
    chosen = packs.unionByName(picked).select("item_id", F.col("out_format").alias("to"))
    out = level.join(chosen, "item_id", "left").withColumn("out_format", F.coalesce("to", "format"))
    return out.withColumn("process", F.col("process") & ~F.coalesce(F.col("format").isin(*only) & F.col("to").isNull(), F.lit(False))).drop("to")


def _lossless(items: DataFrame, by_format: Mapping[str, object]) -> DataFrame:
    """``items`` that a pipeline takes, without the lossy ones; contents are read in Python only for formats that may be either."""
    for kind in [k for k in LOSSLESS if k in by_format]:
        may = items.where(F.col("format") == kind).where(F.coalesce(bytes_column(LOSSLESS[kind], "boolean")("content"), F.lit(False)))
        items = items.where(~F.coalesce(F.col("format") == kind, F.lit(False))).unionByName(may)
    return items


def _repack(level: DataFrame, members: DataFrame, below: DataFrame) -> DataFrame:
    """item_id, optimized, error of the containers of ``level``: packed anew where a member changed, or as another format."""
    of = below.select(F.col("parent").alias("container_id"), "archive_index", "changed", F.col("new_name").alias("name"), F.col("error").alias("failed"))
    work = of.groupBy("container_id").agg(F.bool_or("changed").alias("had_work"), F.max("failed").alias("failed"))
    broken = members.where("kind = 'error'").select(F.col("container_id").alias("item_id"), F.lit(None).cast("binary").alias("optimized"), "error")
    work = work.join(level.select(F.col("item_id").alias("container_id"), (F.col("format") != F.col("out_format")).alias("converts")), "container_id")
    held = (F.col("kind") == "file") & stamp_file(F.col("name"))
    stamped = members.where(held).select("container_id", F.lit(True).alias("stamped")).distinct()
    work = work.join(stamped, "container_id", "left")
    work = work.select("container_id", (F.col("had_work") | F.col("converts") | F.coalesce("stamped", F.lit(False))).alias("had_work"), "failed")
    busy = work.where("had_work").select(F.col("container_id").alias("item_id"))
    patches = below.select(F.col("parent").alias("container_id"), "archive_index", F.col("data").alias("content"), F.col("new_name").alias("name"))
    done = pack(members.where(~held), level.join(busy, "item_id", "left_semi").select("item_id", F.col("out_format").alias("format")), patches)
    done = done.join(work.select(F.col("container_id").alias("item_id"), "failed"), "item_id")
    done = done.select("item_id", F.col("packed").alias("optimized"), F.coalesce("error", "failed").alias("error"))
    idle = work.where("not had_work and failed is not null").select(
        F.col("container_id").alias("item_id"), F.lit(None).cast("binary").alias("optimized"), F.col("failed").alias("error")
    )
    return done.unionByName(idle).unionByName(broken)
