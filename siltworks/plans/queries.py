"""The library's queries over the test tables, each beside the SQL that it can be held against.

Tables stand for corpora: ``documents`` are files below /lib, ``conversations``
are archives with ordered members, ``events`` are frames with durations, ``orders``
and ``lineitem`` are archives some of which are empty, ``pages`` are web assets.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.functions import formats, frames, images, paths, sniff
from siltworks.functions.batches import by_bytes
from siltworks.functions.verify import fault_column
from siltworks.operators import animated, archives, reports, routing, settings, skip, stamps, tiers
from siltworks.operators.codecs import distinct_lines as distinct_line_bytes
from siltworks.operators.codecs import tools
from siltworks.plans.optimize import described, optimize
from siltworks.sources.files import remove_files, write_files
from siltworks.sources.folders import Folder
from siltworks.sources.scan import scan
from siltworks.sources.staging import shared_folder, stage
from siltworks.sources.stamp_store import StampStore, configuration

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Suffixes that documents get by the remainder of their ids.
SUFFIXES = (".txt", ".tar.gz", ".PNG", ".cbz", "")
IGNORE = paths.globs_to_regex(["*/src1/*", "*.cbz"])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: item_id, path, bytes_in, text."""
    end = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("doc_id") % len(SUFFIXES) + 1).cast("int"))
    path = F.concat(F.lit("/lib/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), end)
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), path.alias("path"), F.octet_length("text").cast("long").alias("bytes_in"), "text", "source", "lang"
    )


FILES = """WITH files AS (SELECT doc_id AS item_id, source, lang, text, strlen(text) AS bytes_in,
  '/lib/' || source || '/' || lang || '/doc_' || doc_id || ['.txt', '.tar.gz', '.PNG', '.cbz', ''][(doc_id % 5 + 1)::INT] AS path FROM documents)
"""
SUFFIX = r"CASE WHEN regexp_matches({0}, '[^/]\.tar\.[^./]+$') THEN regexp_extract({0}, '(\.tar\.[^./]+)$', 1) ELSE regexp_extract({0}, '[^/](\.[^./]+)$', 1) END"


#: The pipeline of the text corpus.
TEXT = tiers.of_codecs({"TXT": distinct_line_bytes})


def distinct_lines(text: Column) -> Column:
    """The leaf codec of the text corpus: lines that repeat an earlier one go."""
    return F.array_join(F.array_distinct(F.split(text, "\n", -1)), "\n")


@query(FILES + f"SELECT {SUFFIX.format('path')} AS suffix, count(*) AS n, cast(sum(bytes_in) AS BIGINT) AS bytes FROM files GROUP BY 1")
def suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes by suffix."""
    return files(spark, sf_dir).groupBy(paths.suffix(F.col("path")).alias("suffix")).agg(F.count("*").alias("n"), F.sum("bytes_in").alias("bytes"))


@query(
    FILES
    + r"""SELECT item_id, regexp_replace(path, '(\.tar)?\.[^./]+$', '') || '.webp' AS final,
  replace(replace('a.zip__' || path, ' ', '_'), '/', '_') AS working, 'a.zip:' || path AS display, 'a.zip/' || path AS pseudo,
  regexp_extract(path, '([^/]*)$', 1) AS base,
  CASE WHEN item_id % 3 = 0 THEN path WHEN item_id % 3 = 1 THEN 'frame_#' || lpad((item_id % 1000)::VARCHAR, 3, '0') || '.img' ELSE 'Unknown' END AS name,
  coalesce(lower(regexp_extract(path, '(\.[^./]+)$', 1)) IN ('.avif', '.gif', '.jpeg', '.jpg', '.jxl', '.png', '.webp'), false) AS stored FROM files"""
)
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that a run derives from a path."""
    parents, path = F.array(F.lit("a.zip")), F.col("path")
    case = F.col("item_id") % 3
    return files(spark, sf_dir).select(
        "item_id", paths.final_path(path, F.lit(".webp")).alias("final"), paths.working_name(parents, path).alias("working"),
        paths.display_name(parents, path).alias("display"), paths.pseudo_path(parents, path).alias("pseudo"), paths.base_name(path).alias("base"),
        paths.item_name(F.lit(None).cast("string"), F.when(case == 0, path), F.when(case == 1, F.col("item_id") % 1000).cast("int")).alias("name"),
        paths.incompressible(path).alias("stored"),
    )


@query(FILES + "SELECT source, lang, count(*) AS n, cast(sum(bytes_in) AS BIGINT) AS bytes, max(bytes_in) AS largest FROM files WHERE source <> 'src3' GROUP BY ALL")
def scan_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of documents that were written as files, by folder; one folder's settings keep it shut."""
    at = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    root = at.removeprefix("file:").replace("//", "/")
    written = write_files(files(spark, sf_dir).select(F.concat(F.lit(root), "path").alias("path"), F.col("text").cast("binary").alias("content")))
    written.write.format("noop").mode("overwrite").save()
    layers = spark.createDataFrame([(f"{root}/lib/src3", "recurse", "false"), (f"{root}/lib", "recurse", "true")], "path string, option string, value string")
    # all rounds are staged, so the files may go, many at a time and then the folders
    found = scan(spark, [root], layers)
    remove_files(files(spark, sf_dir).select(F.concat(F.lit(root), "path").alias("path"))).write.format("noop").mode("overwrite").save()
    Folder(spark, at).remove("")
    part = lambda k: F.element_at(F.split("path", "/"), k)
    return found.groupBy(part(-3).alias("source"), part(-2).alias("lang")).agg(F.count("*").alias("n"), F.sum("bytes_in").alias("bytes"), F.max("bytes_in").alias("largest"))


@query(FILES + r"SELECT source, count(*) AS n FROM files WHERE NOT regexp_matches(path, '^.*/src1/.*$|^.*\.cbz$|^\.|/\.|\.sparsebundle$') GROUP BY source")
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are neither ignored nor the library's own."""
    return skip.skip_items(files(spark, sf_dir), IGNORE).groupBy("source").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT user_id, min(ts) + INTERVAL 10 DAY AS stamp FROM events WHERE user_id % 2 = 0 GROUP BY user_id)
SELECT event_type, count(*) AS n, count(*) FILTER (s.user_id IS NULL) AS unstamped FROM events e LEFT JOIN s USING (user_id)
WHERE stamp IS NULL OR ts > stamp GROUP BY event_type"""
)
def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items that are newer than their stamp, or have none."""
    events = read(spark, sf_dir, "events")
    limit = events.where("user_id % 2 = 0").groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 10 DAYS")).alias("stamp"))
    held = events.join(limit, "user_id", "left").where(skip.changed(F.col("ts"), F.col("stamp")))
    return held.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("stamp").isNull()).alias("unstamped"))


STAMPS = """, st AS (SELECT '/lib/' || source AS path, cast(max(doc_id) AS DOUBLE) AS ts FROM documents WHERE source <> 'src2' GROUP BY source
  UNION ALL SELECT '/lib/' || source || '/' || lang, cast(min(doc_id) AS DOUBLE) + 100 FROM documents GROUP BY source, lang)
, up AS (SELECT item_id, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda n: '/' || array_to_string(string_split(path, '/')[2:n + 1], '/'))) AS above FROM files)
"""


def folder_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    top = docs.where("source <> 'src2'").groupBy("source").agg(F.max("doc_id").cast("double").alias("ts"))
    low = docs.groupBy("source", "lang").agg((F.min("doc_id").cast("double") + 100).alias("ts"))
    return top.select(F.concat(F.lit("/lib/"), "source").alias("path"), "ts").unionByName(
        low.select(F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang").alias("path"), "ts")
    )


@query(FILES + STAMPS + "SELECT item_id, max(ts) AS stamp FROM up LEFT JOIN st ON above = path GROUP BY item_id")
def ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest stamp of a path or a folder above it."""
    return stamps.ancestor_stamp(files(spark, sf_dir).select("item_id", "path"), folder_stamps(spark, sf_dir))


@query(
    FILES
    + STAMPS
    + """SELECT s.path, s.ts FROM st s WHERE NOT EXISTS (SELECT 1 FROM st a WHERE starts_with(s.path, a.path || '/') AND a.ts >= s.ts)"""
)
def stamp_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps that no folder above supersedes."""
    return stamps.compact(folder_stamps(spark, sf_dir))


@query(
    FILES
    + """, f AS (SELECT path, coalesce(toxic, 0) = 1 AS failed FROM files LEFT JOIN labels ON doc_id = item_id)
, u AS (SELECT failed, unnest(list_transform(range(1, len(string_split(path, '/')) - 1), lambda n: '/' || array_to_string(string_split(path, '/')[2:n + 1], '/'))) AS folder FROM f)
SELECT folder, count(*) AS n_items, bool_or(failed) AS poisoned FROM u GROUP BY folder"""
)
def poison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that may not be stamped since an item below failed."""
    failed = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    items = files(spark, sf_dir).join(read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "item_id"), "item_id", "left")
    return stamps.folder_status(items.select("path", failed.alias("failed")))


@query(
    """WITH d AS (SELECT source, CASE WHEN doc_id % 10 = 0 THEN '' ELSE coalesce(lang, '') || '/' END || doc_id AS path, coalesce(text, '') AS text FROM documents)
, p AS (SELECT source, substr(sha256(path), 1, 3) AS part, sha256(string_agg(path || ':' || sha256(text), chr(10) ORDER BY path || ':' || sha256(text))) AS h
  FROM d WHERE contains(path, '/') GROUP BY ALL)
, f AS (SELECT source, sha256(string_agg(part || ':' || h, chr(10) ORDER BY part)) AS fingerprint FROM p GROUP BY source)
SELECT r.source, coalesce(fingerprint, sha256('')) AS fingerprint
FROM (SELECT DISTINCT source FROM documents UNION SELECT 'none') r LEFT JOIN f ON r.source IS NOT DISTINCT FROM f.source"""
)
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of all settings below a root, without the root's own file; documents are settings, and a root has none."""
    docs = read(spark, sf_dir, "documents")
    folder = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.concat(F.coalesce("lang", F.lit("")), F.lit("/")))
    path = F.concat(folder, F.col("doc_id").cast("string"))
    roots = docs.select("source").unionByName(spark.sql("SELECT 'none' AS source"))
    return stamps.fingerprint(docs.select("source", path.alias("path"), "text"), ["source"], roots)


@query(
    """SELECT CASE WHEN event_type = 'purchase' THEN 'changed' ELSE 'same' END AS config, '/lib/' || event_type || '/' || user_id AS path, cast(max(event_id) AS DOUBLE) AS ts
FROM events WHERE event_type <> 'purchase' GROUP BY ALL"""
)
def stamp_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps in versions for each root (event types), committed twice, of which a changed configuration voids one."""
    store = StampStore(spark, f"{shared_folder(spark)}/stamps-{uuid.uuid4().hex}")
    events = read(spark, sf_dir, "events")
    path = F.concat(F.lit("/lib/"), "event_type", F.lit("/"), F.col("user_id").cast("string"))
    config, out = configuration({"formats": ["PNG"]}), None
    for kind in (r.event_type for r in events.select("event_type").distinct().collect()):
        own = events.where(F.col("event_type") == kind).groupBy(path.alias("path"), (F.col("event_id") % 2).alias("run"))
        own = own.agg(F.max("event_id").cast("double").alias("ts"))
        for run in (1, 0):
            store.commit(f"/lib/{kind}", own.where(F.col("run") == run), config)
        told = "changed" if kind == "purchase" else "same"
        held = store.load(f"/lib/{kind}", configuration({"formats": ["GIF" if told == "changed" else "PNG"]}))
        held = held.select(F.lit(told).alias("config"), "path", "ts")
        out = held if out is None else out.unionByName(held)
    return out


LAYERS = (
    ("/lib", "recurse", "true"), ("/lib", "formats", "PNG,GIF"), ("/lib/src1", "formats", "WEBP"), ("/lib/src1/en", "bigger", "true"),
    ("/lib/src2/fr", "formats", "JXL"), ("/lib/src", "formats", "never"), ("/lib/src3", "recurse", "false"),
)
LAYERS_SQL = "VALUES " + ", ".join(map(str, LAYERS))


@query(
    FILES
    + f""", d AS (SELECT DISTINCT '/lib/' || source || '/' || lang AS folder FROM files), l(path, option, value) AS ({LAYERS_SQL})
SELECT folder, option, CASE WHEN option = 'bigger' THEN 'pinned' ELSE arg_max(value, length(path)) END AS value
FROM d JOIN l ON starts_with(folder || '/', path || '/') GROUP BY folder, option"""
)
def dir_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder's settings, the nearest file above winning, options of the command line winning over all."""
    folders = files(spark, sf_dir).select(F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang").alias("folder"))
    return settings.folder_settings(folders, spark.createDataFrame(list(LAYERS), "path string, option string, value string"), {"bigger": "pinned"})


ROUTES_SQL = "VALUES " + ", ".join(
    f"('{f}', '{h or ''}', [{', '.join(repr(c) for c in chain)}]::VARCHAR[], {str(a).lower()}, {str(bool(h) and h not in routing.NO_PACK).lower()})"
    for f, _, anim, a, h, chain in (*routing.FORMATS, *((f, True, False, False, None, routing.CONVERT_ONLY_TO) for f in routing.CONVERT_ONLY))
    if not anim
)
KINDS = ("PNG", "GIF", "JPEG", "TAR", "BMP", "RAR", "ZIP", "SVG", "WEBP", "CBR", "TXT")


def route_sql(repack: str) -> str:
    return (
        f"""WITH i AS (SELECT doc_id AS item_id, {list(KINDS)}[(doc_id % {len(KINDS)} + 1)::INT] AS f, doc_id % 2 = 0 AS c FROM documents),
r(f, native, chain, archive, packs) AS ({ROUTES_SQL}),
x AS (SELECT item_id, native, packs, list_filter(CASE WHEN c AND (NOT archive OR {repack}) AND (archive OR NOT {repack}) THEN chain ELSE []::VARCHAR[] END, lambda t: t IN ('WEBP', 'ZIP', 'CBZ'))[1] AS to_, f FROM i JOIN r USING (f))
SELECT item_id, CASE WHEN to_ IS NOT NULL THEN 'To' || to_ ELSE native END AS handler, coalesce(to_, f) AS out_format,
  CASE WHEN to_ IS NOT NULL THEN 'convert' ELSE 'native' END AS role FROM x WHERE to_ IS NOT NULL OR (native <> '' """
        + ("AND packs AND f IN ('TAR', 'RAR', 'ZIP', 'CBR'))" if repack == "true" else ")")
    )


def routed(spark: SparkSession, sf_dir: str, repack: bool) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    items = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), kind.alias("format"), (~kind.isin("JPEG")).alias("lossless"), F.lit(False).alias("animated"),
        kind.isin("TAR", "RAR", "ZIP", "CBR").alias("archive"), (F.col("doc_id") % 2 == 0).alias("convert"),
    )
    return routing.pick_handlers(items, routing.routes(spark), ["WEBP", "ZIP", "CBZ"], repack=repack)


@query(route_sql("false"))
def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first conversion that is asked for, else the format's own handler."""
    return routed(spark, sf_dir, False)


@query(route_sql("true"))
def route_repack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W03 in the pass that packs archives: conversions between archives, and only by what can pack."""
    return routed(spark, sf_dir, True)


TOOLS_SQL = """WITH t AS (SELECT p_partkey % 97 AS handler, p_partkey % 3 AS tier, p_partkey AS alt, 'tool_' || p_partkey AS tool, p_size % 2 = 0 AS required, p_size % 3 > 0 AS available FROM part)
"""


def tool_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 97).alias("handler"), (F.col("p_partkey") % 3).alias("tier"), F.col("p_partkey").alias("alt"),
        F.concat(F.lit("tool_"), F.col("p_partkey").cast("string")).alias("tool"), (F.col("p_size") % 2 == 0).alias("required"), (F.col("p_size") % 3 > 0).alias("available"),
    )


@query(
    TOOLS_SQL
    + "SELECT handler, tier, alt, tool, required, available FROM t WHERE available AND tool <> 'tool_5' QUALIFY row_number() OVER (PARTITION BY handler, tier ORDER BY alt) = 1"
)
def tool_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tool at hand of every tier, without the disabled ones."""
    return routing.pick_tools(tool_table(spark, sf_dir), ["tool_5"])


@query(
    TOOLS_SQL
    + """, g AS (SELECT handler, tier, bool_or(available) AS ok, bool_or(required) AS needed FROM t GROUP BY handler, tier)
SELECT handler, bool_and(ok OR NOT needed) AS ready FROM g GROUP BY handler"""
)
def doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers all of whose required tiers have a tool."""
    return routing.ready_handlers(tool_table(spark, sf_dir))


@query()
def doctor_here(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the kind that they stand for, and whether its handler has its tools here, probed where tasks run."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    of = F.create_map(*(F.lit(x) for pair in tiers.HANDLERS.items() for x in pair))
    docs = read(spark, sf_dir, "documents").select(kind.alias("format"), of[kind].alias("handler")).groupBy("format", "handler").agg(F.count("*").alias("n"))
    return docs.join(routing.ready_handlers(tools(spark)), "handler", "left")


@query(
    """SELECT page_id, CASE WHEN starts_with(html, '<!DOCTYPE') THEN 'doctype' WHEN starts_with(html, '<html') THEN 'html' ELSE 'other' END AS kind,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, strlen(html) AS bytes FROM pages"""
)
def magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by leading bytes, and a field drawn from the content."""
    raw = F.col("html").cast("binary")
    kind = F.when(sniff.starts_at(raw, 0, b"<!DOCTYPE"), "doctype").when(sniff.starts_at(raw, 0, b"<html"), "html").otherwise("other")
    return read(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.octet_length("html").cast("long").alias("bytes"))


@query(
    """SELECT l_orderkey % 256 AS palette, concat_ws(',', ((l_orderkey % 256) >> 5 & 7) * 36, ((l_orderkey % 256) >> 2 & 7) * 36, (l_orderkey % 256 & 3) * 36) AS rgb,
  count(*) AS n FROM lineitem GROUP BY ALL"""
)
def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palette indexes as colours."""
    index = (F.col("l_orderkey") % 256).alias("palette")
    return read(spark, sf_dir, "lineitem").groupBy(index).agg(F.count("*").alias("n")).select("palette", F.array_join(sniff.palette_rgb(F.col("palette")).cast("array<string>"), ",").alias("rgb"), "n")


def archived(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """``conversations`` as archives (item_id, format, content), a member for each turn, in order."""
    rows, none = read(spark, sf_dir, "conversations"), lambda t: F.lit(None).cast(t)
    members = rows.select(
        F.col("conv_id").cast("string").alias("container_id"), F.col("turn").alias("archive_index"), none("string").alias("header"),
        F.concat("role", F.lit("_"), F.col("turn").cast("string")).alias("name"), F.lit("file").alias("kind"), F.lit("").alias("linkname"), F.lit(0.0).alias("mtime"),
        none("int").alias("mode"), none("int").alias("compress_type"), none("binary").alias("comment"), F.col("text").cast("binary").alias("content"),
    )
    formats = members.select(F.col("container_id").alias("item_id"), F.lit(kind).alias("format")).distinct()
    return archives.pack(members, formats).select("item_id", F.lit(kind).alias("format"), F.col("packed").alias("content"))


#: Pictures are as wide as a text that is told so often, so that every one shrinks.
TIMES = 20


def gray_png(text: bytes, broken: bool = False) -> bytes:
    """A picture of one row, a point for each byte, not compressed; a broken one is cut off."""
    row = text * TIMES
    body = animated.chunk(b"IHDR", struct.pack(">IIBBBBB", len(row), 1, 8, 0, 0, 0, 0)) + animated.chunk(b"IDAT", zlib.compress(b"\0" + row, 0))
    return animated.MAGIC + body + (b"" if broken else animated.chunk(b"IEND", b""))


def picture(text: str, broken: Column) -> Column:
    """The picture of a column of texts."""

    @F.pandas_udf("binary")
    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, flags in parts:
            yield from by_bytes(gray_png((t or "").encode() + b"x", f) for t, f in zip(texts, flags))

    return of(text, broken)


def head_of(width: str) -> Column:
    """The head of pictures of one row of a column's widths."""

    @F.pandas_udf("binary")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for widths in parts:
            yield pd.Series([animated.chunk(b"IHDR", struct.pack(">IIBBBBB", n, 1, 8, 0, 0, 0, 0)) for n in widths], dtype=object)

    return of(width)


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as zips (path, content) of pictures: the system's are hidden, those after turn 6 are broken."""
    rows, none = read(spark, sf_dir, "conversations"), lambda t: F.lit(None).cast(t)
    name = F.concat(F.when(F.col("role") == "system", ".").otherwise(""), F.col("turn").cast("string"), F.lit(".png"))
    members = rows.select(
        F.col("conv_id").cast("string").alias("container_id"), F.col("turn").alias("archive_index"), none("string").alias("header"), name.alias("name"),
        F.lit("file").alias("kind"), F.lit("").alias("linkname"), F.lit(0.0).alias("mtime"), none("int").alias("mode"), none("int").alias("compress_type"),
        none("binary").alias("comment"), picture("text", F.col("turn") > 6).alias("content"),
    )
    zips = archives.pack(members, members.select(F.col("container_id").alias("item_id"), F.lit("ZIP").alias("format")).distinct())
    return zips.select(F.col("item_id").alias("path"), F.col("packed").alias("content"))


@query("SELECT conv_id, turn, 'PNG' AS format, CASE WHEN turn > 6 THEN 'PNG: no end' END AS fault FROM conversations")
def verified_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formats of turns' pictures by the rules of a run, and what is wrong with them."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("p.png").alias("path"), picture("text", F.col("turn") > 6).alias("content"))
    return described(rows).select("conv_id", "turn", "format", fault_column()("format", "content").alias("fault"))


@query(
    f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS frame, turn, strlen(coalesce(text, '')) + 1 AS n FROM conversations)
SELECT conv_id, frame::INT AS frame, (10 * turn + 1)::BIGINT AS ms, {TIMES} * n AS width FROM t"""
)
def animated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Animated pictures packed from frames and opened again, with their durations; conversations are animations."""
    rows, order = read(spark, sf_dir, "conversations"), Window.partitionBy("conv_id").orderBy("turn")
    wide = (F.octet_length(F.coalesce("text", F.lit(""))) + 1) * TIMES
    frame = rows.select(
        F.col("conv_id").cast("string").alias("container_id"), F.row_number().over(order).alias("archive_index"), "turn", wide.alias("width"), picture("text", F.lit(False)).alias("content")
    )
    told = F.to_json(F.struct(
        F.col("archive_index").alias("frame"), "width", F.lit(1).alias("height"), F.lit(0).alias("x"), F.lit(0).alias("y"),
        (10 * F.col("turn") + 1).alias("num"), F.lit(1000).alias("den"), F.lit(0).alias("dispose"), F.lit(0).alias("blend"),
    ))
    none = lambda t: F.lit(None).cast(t)
    rest = [F.lit("").alias("linkname"), none("double").alias("mtime"), none("int").alias("mode"), none("int").alias("compress_type"), none("binary").alias("comment")]
    frames_ = frame.select("container_id", "archive_index", told.alias("header"), F.format_string("frame_#%03d.img", "archive_index").alias("name"), F.lit("file").alias("kind"), *rest, "content")
    size = frame.groupBy("container_id").agg(F.max("width").alias("width"))
    heads = size.select("container_id", F.lit(0).alias("archive_index"), F.lit('{"plays": 0}').alias("header"), F.lit(animated.HEAD).alias("name"), F.lit("meta").alias("kind"), *rest, head_of("width").alias("content"))
    packed = archives.pack(frames_.unionByName(heads), size.select(F.col("container_id").alias("item_id"), F.lit("APNG").alias("format")))
    members = stage(archives.unpack(packed.select("item_id", F.lit("APNG").alias("format"), F.col("packed").alias("content"))))
    told = animated.frames(members).withColumn("width", F.conv(F.hex(F.substring("content", 17, 4)), 16, 10).cast("long"))
    ms = animated.frame_durations(told.select("container_id", "frame", "duration"))
    return told.select("container_id", "frame", "width").join(ms, ["container_id", "frame"]).select(F.col("container_id").cast("long").alias("conv_id"), "frame", "ms", "width")


@query(
    """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS frame, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events),
d AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS frame FROM e WHERE v IS NOT NULL),
m AS (SELECT user_id, avg(v) AS mean FROM d GROUP BY user_id)
SELECT e.user_id, e.frame::INT AS frame, cast(greatest(1, floor(round(coalesce(d.v, mean), 6))) AS BIGINT) AS ms FROM e JOIN m USING (user_id) LEFT JOIN d USING (user_id, frame)"""
)
def frame_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations go to frames by position, and frames that are left over get the mean; events are frames of their users."""
    events = read(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("event_id")
    told = events.select(F.col("user_id").alias("container_id"), F.row_number().over(order).alias("frame"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("duration"))
    return animated.frame_durations(told).where("ms is not null").select(F.col("container_id").alias("user_id"), "frame", "ms")


def contributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as contributions of plugins (suppliers): flag and status are a format, a line a route."""
    first = F.col("l_linenumber") == 1
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("plugin"), F.col("l_suppkey").cast("int").alias("place"), F.concat("l_returnflag", "l_linestatus").alias("format"), F.lit(True).alias("lossless"),
        F.lit(False).alias("animated"), F.lit(False).alias("archive"), F.concat(F.lit("H"), (F.col("l_partkey") % 9).cast("string")).alias("handler"),
        F.when(first, "native").otherwise("convert").alias("role"), F.col("l_orderkey").cast("int").alias("pos"), F.concat(F.lit("F"), (F.col("l_partkey") % 9 % 4).cast("string")).alias("out_format"),
        F.lit(False).alias("can_pack"), F.when(F.col("l_partkey") % 5 == 0, "opt_in").alias("enabled_key"),
    )


MERGED = """WITH c AS (SELECT l_suppkey AS place, l_orderkey AS pos, l_returnflag || l_linestatus AS format, 'H' || (l_partkey % 9) AS handler, 'F' || (l_partkey % 9 % 4) AS out_format, l_linenumber = 1 AS native
  FROM lineitem WHERE l_partkey % 5 <> 0),
n AS (SELECT format, arg_max({'h': handler, 'o': out_format}, {'a': place, 'b': pos, 'c': handler}) AS x FROM c WHERE native GROUP BY format),
f AS (SELECT format, handler, min({'a': place, 'b': pos, 'c': handler}) AS first, any_value(out_format) AS out_format FROM c WHERE NOT native GROUP BY ALL),
r AS (SELECT format, x.h AS handler, 'native' AS role, 0 AS pos, x.o AS out_format FROM n
  UNION ALL SELECT format, handler, 'convert', row_number() OVER (PARTITION BY format ORDER BY first) - 1, out_format FROM f)
"""


@query(MERGED + "SELECT format, handler, role, pos::INT AS pos, out_format FROM r")
def merged_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of many plugins in one table, the last native handler and the first place of each conversion winning."""
    return routing.merge_routes(contributed(spark, sf_dir)).select("format", "handler", "role", "pos", "out_format")


@query(
    MERGED
    + """SELECT out_format, array_to_string(list_sort(list(DISTINCT format)), ',') AS sources
FROM (SELECT format, arg_min(out_format, pos) AS out_format FROM r WHERE role = 'convert' AND out_format IN ('F1', 'F3') GROUP BY format) GROUP BY out_format"""
)
def convert_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target the formats that a run turns into it, over the merged routes."""
    table = routing.merge_routes(contributed(spark, sf_dir))
    return routing.convert_sources(table, ["F1", "F3"]).select("out_format", F.array_join("sources", ",").alias("sources"))


@query(
    """SELECT conv_id AS container_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS archive_index, role || '_' || turn AS name, length(text) AS size FROM conversations"""
)
def unpack_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zips exploded to members with their places."""
    each = archives.unpack(archived(spark, sf_dir, "ZIP"))
    size = F.length(F.decode("content", "UTF-8")).cast("long")
    return each.select(F.col("container_id").cast("long").alias("container_id"), F.col("archive_index").cast("long").alias("archive_index"), "name", size.alias("size"))


@query("SELECT conv_id AS container_id, sha256(string_agg(text, chr(0) ORDER BY turn)) AS packed, count(*) AS n_members FROM conversations GROUP BY conv_id")
def pack_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members packed in their order as compressed tars, told by what is read back."""
    each = archives.unpack(archived(spark, sf_dir, "TGZ")).withColumn("text", F.decode("content", "UTF-8"))
    held = each.groupBy(F.col("container_id").cast("long").alias("container_id")).agg(F.sort_array(F.collect_list(F.struct("archive_index", "text"))).alias("m"))
    return held.select("container_id", F.sha2(F.array_join("m.text", "\0"), 256).alias("packed"), F.size("m").cast("long").alias("n_members"))


@query(
    """SELECT conv_id AS container_id, bool_or(role <> 'system' AND turn <= 6) AS had_work, bool_or(role <> 'system' AND turn > 6) AS had_error,
  bool_or(role <> 'system' AND turn <= 6) AS changed, CASE WHEN bool_or(role <> 'system' AND turn > 6) THEN 'error' WHEN bool_or(role <> 'system') THEN 'saved' ELSE 'lost' END AS kind
FROM conversations GROUP BY conv_id"""
)
def repack_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over archives of pictures; those with a picture that shrank are packed anew, those with a broken one tell the error."""
    rows = optimize(pictures(spark, sf_dir))
    return rows.select(
        F.col("path").cast("long").alias("container_id"), F.col("changed").alias("had_work"), F.col("error").isNotNull().alias("had_error"), "changed", "kind"
    )


@query("SELECT conv_id, turn, CASE WHEN role = 'system' OR regexp_matches(text, '^[A-E]') THEN 'copy' ELSE 'process' END AS action FROM conversations")
def member_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """members that are carried over as they are, and members that are optimised."""
    name = F.when(F.col("role") == "system", ".system").otherwise(F.col("text"))
    action = skip.member_action(name, r"^\.|^[A-E]", F.lit(1.0), F.lit(None).cast("double"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", action.alias("action"))


@query(
    """SELECT o_orderkey, count(l_orderkey) AS n_members FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber > 3 GROUP BY o_orderkey"""
)
def empty_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tars with and without members, packed and read again; orders are archives of their later lines."""
    lines, none = read(spark, sf_dir, "lineitem").where("l_linenumber > 3"), lambda t: F.lit(None).cast(t)
    members = lines.select(
        F.col("l_orderkey").cast("string").alias("container_id"), F.col("l_linenumber").alias("archive_index"), none("string").alias("header"),
        F.col("l_linenumber").cast("string").alias("name"), F.lit("file").alias("kind"), F.lit("").alias("linkname"), F.lit(0.0).alias("mtime"),
        none("int").alias("mode"), none("int").alias("compress_type"), none("binary").alias("comment"), F.lit(b"").alias("content"),
    )
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("item_id"), F.lit("ZIP").alias("format"))
    packed = stage(archives.pack(members, orders))
    each = archives.unpack(packed.select("item_id", F.lit("ZIP").alias("format"), F.col("packed").alias("content"))).groupBy("container_id").agg(F.count("*").alias("n"))
    held = packed.join(each, F.col("item_id") == F.col("container_id"), "left")
    return held.select(F.col("item_id").cast("long").alias("o_orderkey"), F.coalesce("n", F.lit(0)).cast("long").alias("n_members"))


@query(
    """WITH c AS (SELECT conv_id, bool_or(role <> 'system' AND turn > 6) AS bad, bool_or(role <> 'system') AS work FROM conversations GROUP BY conv_id)
SELECT bad AS rolled_back, work AND NOT bad AS changed, count(*) AS n FROM c GROUP BY ALL"""
)
def rollback_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With failing fast by container, a failure anywhere in one leaves it as it was."""
    rows = optimize(pictures(spark, sf_dir), fail_fast_container=True)
    return rows.groupBy(F.col("error").isNotNull().alias("rolled_back"), "changed").agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE t AS (SELECT conv_id AS id, 0 AS depth, conv_id % 3 AS deep FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT id, depth + 1, deep FROM t WHERE depth < deep)
SELECT depth, count(*) AS n FROM t GROUP BY depth"""
)
def nested_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many archives each round opens, where archives are packed into archives; every round is a real one."""
    level = archived(spark, sf_dir, "ZIP").withColumn("left", F.col("item_id").cast("long") % 3)
    for _ in range(2):
        inner = level.where("left > 0").select(
            F.col("item_id").alias("container_id"), F.lit(0).alias("archive_index"), F.lit(None).cast("string").alias("header"), F.lit("in.zip").alias("name"), F.lit("file").alias("kind"),
            F.lit("").alias("linkname"), F.lit(0.0).alias("mtime"), F.lit(None).cast("int").alias("mode"), F.lit(None).cast("int").alias("compress_type"), F.lit(None).cast("binary").alias("comment"), "content",
        )
        packed = archives.pack(inner, inner.select(F.col("container_id").alias("item_id"), F.lit("ZIP").alias("format")))
        packed = packed.join(level.select("item_id", (F.col("left") - 1).alias("left")), "item_id").select("item_id", F.lit("ZIP").alias("format"), F.col("packed").alias("content"), "left")
        level = stage(level.where("left = 0").unionByName(packed))
    out = None
    for depth in range(3):
        n = level.agg(F.lit(depth).alias("depth"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
        each = archives.unpack(level).where("name = 'in.zip'")
        level = stage(each.select(F.col("container_id").alias("item_id"), F.lit("ZIP").alias("format"), "content"))
    return out


@query(
    """WITH d AS (SELECT user_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events),
f AS (SELECT user_id, ts, coalesce(v, avg(v) OVER (PARTITION BY user_id)) AS v FROM d)
SELECT user_id, cast(sum(greatest(1, floor(round(v, 6)))) AS BIGINT) AS total, min(greatest(1, floor(round(v, 6))))::BIGINT AS least, count(*) AS n FROM f GROUP BY user_id"""
)
def duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing frame durations get the mean; none is under a millisecond."""
    events = read(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return events.select("user_id", frames.filled_ms(F.col("v"), ["user_id"]).alias("ms")).groupBy("user_id").agg(F.sum("ms").alias("total"), F.min("ms").alias("least"), F.count("*").alias("n"))


@query(
    """SELECT user_id, string_agg(cast(greatest(1, floor(round(value, 6))) AS BIGINT)::VARCHAR, ',' ORDER BY ts, event_id) AS frames FROM events GROUP BY user_id"""
)
def frame_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations in the order of their frames."""
    ms = frames.whole_ms(F.col("value")).cast("string")
    held = read(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", ms.alias("ms")))).alias("f"))
    return held.select("user_id", F.array_join("f.ms", ",").alias("frames"))


@query("SELECT event_id, greatest(epoch_ms(date_trunc('second', ts - INTERVAL 44 YEAR)) // 2000 * 2, 315532800)::DOUBLE AS member_time FROM events")
def epoch_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member times as a zip tells them: in steps of two seconds, never before 1980; events are members, moved there by 44 years."""
    events, none = read(spark, sf_dir, "events"), lambda t: F.lit(None).cast(t)
    when = F.unix_timestamp((F.col("ts") - F.expr("INTERVAL 44 YEARS")).cast("timestamp")).cast("double")
    members = events.select(
        F.col("user_id").cast("string").alias("container_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("archive_index"),
        none("string").alias("header"), F.col("event_id").cast("string").alias("name"), F.lit("file").alias("kind"), F.lit("").alias("linkname"), when.alias("mtime"),
        none("int").alias("mode"), none("int").alias("compress_type"), none("binary").alias("comment"), F.lit(b"").alias("content"),
    )
    zips = archives.pack(members, members.select(F.col("container_id").alias("item_id"), F.lit("ZIP").alias("format")).distinct())
    each = archives.unpack(zips.select("item_id", F.lit("ZIP").alias("format"), F.col("packed").alias("content")))
    return each.select(F.col("name").cast("long").alias("event_id"), F.col("mtime").alias("member_time"))


DEDUP = """, g AS (SELECT item_id, path, source, bytes_in,
  strlen(list_aggregate(list_transform(list_filter(list_zip(string_split(text, chr(10)), range(1, len(string_split(text, chr(10))) + 1)), lambda x: list_position(string_split(text, chr(10)), x[1]) = x[2]), lambda x: x[1]), 'string_agg', chr(10))) AS bytes_out FROM files)
"""


@query(FILES + DEDUP + "SELECT item_id, bytes_in, bytes_out FROM g")
def dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes before and after the text corpus's leaf codec, as the tiers run it and tell it."""
    items = files(spark, sf_dir).select("item_id", "bytes_in", F.col("text").cast("binary").alias("content"))
    told = tiers.run_tiers(items.select(F.col("item_id").cast("string").alias("item_id"), F.lit("TXT").alias("format"), "content", F.lit(None).cast("string").alias("settings")), TEXT)
    return told.select(F.col("item_id").cast("long").alias("item_id"), F.get("stages", F.lit(0))["bytes_in"].alias("bytes_in"), F.get("stages", F.lit(0))["bytes_out"].alias("bytes_out"))


@query(
    FILES
    + DEDUP
    + """, r AS (SELECT g.*, CASE WHEN coalesce(toxic, 0) = 1 THEN 'error' WHEN bytes_out < bytes_in THEN 'saved' ELSE 'lost' END AS kind FROM g LEFT JOIN labels ON doc_id = item_id)
SELECT kind, count(*) AS n_items, cast(sum(bytes_in) AS BIGINT) AS bytes_in, cast(sum(least(bytes_in, bytes_out)) AS BIGINT) AS bytes_out FROM r GROUP BY kind"""
)
def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size gate, each item's class, the sums by class."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), (F.col("toxic") == 1).alias("failed"))
    items = dedup_lines(spark, sf_dir).join(labels, "item_id", "left")
    kind = reports.outcome(F.col("bytes_in"), F.col("bytes_out"), F.lit(False), F.coalesce("failed", F.lit(False)), F.lit(False))
    return reports.summary(items.withColumn("kind", kind))


@query(
    FILES
    + DEDUP
    + """SELECT path || ': ' || printf('%.2f', CASE WHEN bytes_in <= 0 THEN 0.0 ELSE 100.0 * (bytes_in - bytes_out) / bytes_in END) || '% (' || (bytes_in - bytes_out) || ' bytes)'
  || CASE WHEN bytes_in > bytes_out THEN ' saved' WHEN bytes_in < bytes_out THEN ' lost' ELSE '' END || CASE WHEN bytes_in <= bytes_out THEN ', kept original' ELSE '' END AS text,
  bytes_out > 0 AND bytes_out < bytes_in AS changed FROM g"""
)
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line about every item, and whether it is replaced."""
    sizes = files(spark, sf_dir).select("path", "bytes_in", F.octet_length(distinct_lines(F.col("text"))).cast("long").alias("bytes_out"))
    changed = reports.replaces(F.col("bytes_in"), F.col("bytes_out"))
    return sizes.select(reports.report_text(F.col("path"), F.col("bytes_in"), F.col("bytes_out")).alias("text"), changed.alias("changed"))


@query(
    FILES
    + DEDUP
    + """SELECT CASE WHEN sum(bytes_in) > sum(least(bytes_in, bytes_out)) THEN 'Saved' ELSE 'Evened out' END || ' a total of '
  || cast(sum(bytes_in) - sum(least(bytes_in, bytes_out)) AS BIGINT) || ' bytes or ' || printf('%.2f', 100.0 * (sum(bytes_in) - sum(least(bytes_in, bytes_out))) / sum(bytes_in)) || '%' AS text FROM g"""
)
def total_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closing sentence of a run."""
    return reports.total_text(reports.summary(dedup_lines(spark, sf_dir).withColumn("kind", F.lit("any"))))


@query(FILES + DEDUP + "SELECT bytes_out < bytes_in AS saved, count(*) AS n, cast(sum(bytes_in - bytes_out) AS BIGINT) AS bytes FROM g GROUP BY 1")
def dedup_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: files, their codec, the gate, the sums."""
    sizes = dedup_lines(spark, sf_dir)
    return sizes.groupBy((F.col("bytes_out") < F.col("bytes_in")).alias("saved")).agg(F.count("*").alias("n"), F.sum(F.col("bytes_in") - F.col("bytes_out")).alias("bytes"))


@query(
    """WITH s AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL)
SELECT role, array_to_string(list_sort(list(DISTINCT n)), ',') AS sizes, array_to_string(list_sort(list_distinct(list_concat(list(DISTINCT n), [99]))), ',') AS with_extra, list_has_any(list(n), [2, 5]) AS in_scope FROM s GROUP BY role"""
)
def format_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sets, their unions, and whether they meet."""
    s = read(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    sets = s.groupBy("role").agg(F.sort_array(F.collect_set("n")).alias("sizes"))
    extra = formats.all_formats(F.col("sizes"), F.array(F.lit(99).cast("long")))
    told = lambda a: F.array_join(a.cast("array<string>"), ",")
    return sets.select("role", told(F.col("sizes")).alias("sizes"), told(extra).alias("with_extra"), formats.takes_part(F.col("sizes"), F.array(F.lit(2).cast("long"), F.lit(5).cast("long"))).alias("in_scope"))


@query(
    """WITH u AS (SELECT user_id AS path, cast(max(event_id) AS DOUBLE) AS ts FROM events GROUP BY 1 UNION ALL SELECT user_id, cast(min(event_id) + 500 AS DOUBLE) FROM events GROUP BY 1)
SELECT 'r' AS root, cast(path AS VARCHAR) AS path, max(ts) AS ts FROM u GROUP BY path"""
)
def stamp_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps of an earlier run and of this one, the later winning."""
    of = read(spark, sf_dir, "events").groupBy(F.lit("r").alias("root"), F.col("user_id").cast("string").alias("path"))
    return stamps.upsert(of.agg(F.max("event_id").cast("double").alias("ts")), of.agg((F.min("event_id") + 500).cast("double").alias("ts")))


MODES = ("RGB", "P", "CMYK", "1", "I", "LA", "XYZ")


@query(
    """WITH t AS (SELECT page_id, page_id % 17 AS depth, ['RGB', 'P', 'CMYK', '1', 'I', 'LA', 'XYZ'][(page_id % 7 + 1)::INT] AS mode, page_id % 2 = 0 AS transparent FROM (SELECT p_partkey AS page_id FROM part))
SELECT page_id AS item_id, depth BETWEEN 1 AND 8 AS pngout, 'duration=' || page_id || ',loop=0' AS saved, 'duration=' || page_id || ',exif=,loop=0' AS jxl,
  CASE mode WHEN 'P' THEN CASE WHEN transparent THEN 'RGBA' ELSE 'RGB' END WHEN '1' THEN 'L' WHEN 'I' THEN 'I;16' WHEN 'LA' THEN 'LA' ELSE 'RGB' END AS jxl_mode FROM t"""
)
def image_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What encoders get of an image's information, and in which mode; parts are images."""
    key = F.col("p_partkey")
    mode = F.element_at(F.array(*map(F.lit, MODES)), (key % len(MODES) + 1).cast("int"))
    info = F.create_map(F.lit("loop"), F.lit("0"), F.lit("duration"), key.cast("string"), F.lit("icc_profile"), F.lit("x"), F.lit("exif"), F.lit("y"))
    told = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return read(spark, sf_dir, "part").select(
        key.alias("item_id"), images.pngout_takes(key % 17).alias("pngout"), told(images.saved_info(info)).alias("saved"),
        told(images.jxl_info(info)).alias("jxl"), images.jxl_mode(mode, key % 2 == 0).alias("jxl_mode"),
    )


@query("SELECT 'pdf_obj_' || l_orderkey || '_' || l_linenumber || '.jpg' AS name, l_orderkey AS number, l_linenumber::BIGINT AS generation, o_custkey AS held FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def pdf_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of PDFs get names that tell their objects, and go back to them by a join; orders are PDFs."""
    members = read(spark, sf_dir, "lineitem").select(paths.pdf_member(F.col("l_orderkey"), F.col("l_linenumber")).alias("name"))
    back = members.select("name", paths.pdf_object(F.col("name")).alias("of")).select("name", "of.*")
    return back.join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), F.col("o_custkey").alias("held")), "number")


@query(
    """SELECT '/lib/' || user_id AS path, cast(max(event_id) AS DOUBLE) AS ts FROM events WHERE event_id % 3 = 0 GROUP BY user_id"""
)
def marker_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marker files of a scan, in which users are folders and two of three events other files."""
    name = F.when(F.col("event_id") % 3 == 0, skip.MARKER).otherwise(F.concat(F.lit("a"), F.lit(skip.MARKER)))
    path = F.concat(F.lit("/lib/"), F.col("user_id").cast("string"), F.lit("/"), name)
    return stamps.marker_stamps(read(spark, sf_dir, "events").select(path.alias("path"), F.col("event_id").cast("double").alias("mtime")))


@query(
    """WITH t AS (SELECT cast(conv_id AS VARCHAR) AS c, turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
SELECT c AS container_id, cast(turn AS INT) AS archive_index, cast(max(CASE WHEN turn % 2 = 0 THEN 100 + last ELSE last END) AS DOUBLE) AS stamp FROM t GROUP BY ALL"""
)
def member_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamp files in archives, for members and for folders; conversations are archives, and even turns lie in a folder."""
    turns = read(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").groupBy(F.col("conv_id").cast("string").alias("container_id"), "turn").agg(F.lit("file").alias("kind"))
    name = F.concat(F.when(F.col("turn") % 2 == 0, "even/").otherwise("odd/"), F.col("turn").cast("string"))
    members = turns.select("container_id", F.col("turn").cast("int").alias("archive_index"), name.alias("name"), "kind")
    last = turns.groupBy("container_id").agg(F.max("turn").alias("last"))
    text = F.concat(F.lit("config: {}\n.: "), F.col("last").cast("string"), F.lit("\neven: "), (F.col("last") + 100).cast("string"), F.lit("\n"))
    told = last.select("container_id", F.lit("file").alias("kind"), F.lit(skip.STAMP_MEMBER).alias("name"), F.encode(text, "UTF-8").alias("content"))
    return stamps.newest_member_stamp(members, stamps.member_stamps(told))
