"""Leaf transforms as pipelines of tiers: each tier's tool works on what the one before passed on.

A handler's tools come from the table of tools (:func:`routing.pick_tools`): the
first at hand of each tier. A whole pipeline is one pass over the rows. The smaller
of a tier's input and output is passed on; a tool that doesn't take an input (as it
is acceptable already, or of another kind) leaves it untouched.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from siltworks.functions.batches import BATCH_BYTES
from siltworks.functions.jpeg import is_mpo, primary_picture
from siltworks.functions.images import PNGOUT_DEPTH
from siltworks.functions.verify import verify
from siltworks.operators.codecs import redeflate_png
from siltworks.operators.programs import IN, run_program

Options = Mapping[str, str]
Codec = Callable[[bytes], bytes]
LEAF = "item_id string, optimized binary, error string, stages array<struct<tool:string,bytes_in:long,bytes_out:long>>"


def on(options: Options, name: str, default: bool = False) -> bool:
    """A setting that is on or off."""
    return {"true": True, "false": False}.get(str(options.get(name, default)).strip().lower(), default)


@dataclass(frozen=True)
class Stage:
    """What a tool does with bytes under the settings of their folder, and which it takes."""

    run: Callable[[bytes, Options], bytes]
    takes: Callable[[bytes], bool] = lambda raw: True


def program(*args: str, meta: tuple[tuple[str, ...], tuple[str, ...]] = ((), ()), more: Mapping[str, tuple[str, ...]] | None = None, takes: Callable[[bytes], bool] = lambda raw: True, last: tuple[str, ...] = ()) -> Stage:
    """A program's stage; ``meta``: arguments that keep or strip metadata, ``more``: those of settings that are on."""

    def run(raw: bytes, options: Options) -> bytes:
        extra = [a for name, given in (more or {}).items() if on(options, name) for a in given]
        return run_program((*args, *meta[0 if on(options, "keep_metadata", True) else 1], *extra, *last), raw)

    return Stage(run, takes)


def _shallow(raw: bytes) -> bool:
    """A PNG of a bit depth that pngout takes."""
    return raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) > 24 and 1 <= raw[24] <= PNGOUT_DEPTH


def _oxipng(raw: bytes, options: Options) -> bytes:
    import oxipng

    told = {"level": 3, "fix_errors": True, "force": True, "optimize_alpha": True}
    if on(options, "png_max"):
        told |= {"level": 5, "deflate": oxipng.Deflaters.zopfli(15)}
    if not on(options, "keep_metadata", True):
        told["strip"] = oxipng.StripChunks.safe
    return oxipng.optimize_from_memory(raw, **told)


def _mozjpeg(raw: bytes, options: Options) -> bytes:
    import mozjpeg_lossless_optimization as mozjpeg

    keep = mozjpeg.COPY_MARKERS.ALL if on(options, "keep_metadata", True) else mozjpeg.COPY_MARKERS.NONE
    return mozjpeg.optimize(raw, keep)


#: Tools by name, and the arguments that programs get.
STAGES: dict[str, Stage] = {
    "redeflate": Stage(lambda raw, options: redeflate_png(raw, on(options, "keep_metadata", True))),
    "oxipng": Stage(_oxipng),
    "pngout": program("pngout", "-", "-", "-force", "-y", "-q", meta=(("-k1",), ("-k0",)), takes=_shallow),
    "mozjpeg_lossless_optimization": Stage(_mozjpeg),
    "mpo_extract": Stage(lambda raw, options: primary_picture(raw), is_mpo),
    "gifsicle": program("gifsicle", "--optimize=3", "--threads", "--output", "-", "-"),
    "cwebp": program(
        "cwebp", "-mt", "-q", "100", "-m", "6", "-o", "-", "-quiet", "-lossless", "-sharp_yuv", "-alpha_filter", "best",
        meta=(("-metadata", "all"), ("-metadata", "none")), more={"near_lossless": ("-near_lossless", "0")}, last=(IN,),
    ),
    "gif2webp": program("gif2webp", "-mt", "-q", "100", "-m", "6", "-o", "-", "-quiet", "-min_size", meta=(("-metadata", "all"), ("-metadata", "none")), last=(IN,)),
    "svgo": program("svgo", "--multipass", "--output", "-", "--input", "-"),
}
#: The handler of each format's leaves.
HANDLERS = {"PNG": "Png", "PNGFRAME": "PngFrame", "JPEG": "Jpeg", "MPO": "ToJPEG", "GIF": "Gif", "WEBP": "WebPLossless", "SVG": "Svg"}
#: Frames share one header, so only what keeps it may work on them.
FRAME_TOOLS = ("redeflate",)


def pipelines(picked: Iterable[Row], ready: Iterable[str], stages: Mapping[str, Stage] = STAGES) -> dict[str, tuple[tuple[str, Stage], ...]]:
    """For each format with a handler that is ready, its (tool, stage) by tier.

    ``picked`` are the rows of :func:`routing.pick_tools`, ``ready`` the handlers
    whose required tiers all have a tool; tools without a stage here are left out.
    """
    ready, by = set(ready), {}
    for row in sorted(picked, key=lambda r: r["tier"]):
        if row["handler"] in ready and row["tool"] in stages:
            by.setdefault(row["handler"], []).append((row["tool"], stages[row["tool"]]))
    by["PngFrame"] = [(t, stages[t]) for t in FRAME_TOOLS if t in stages]
    return {kind: tuple(by[handler]) for kind, handler in HANDLERS.items() if by.get(handler)}


def of_codecs(codecs: Mapping[str, Codec]) -> dict[str, tuple[tuple[str, Stage], ...]]:
    """Pipelines of one stage each, from functions of bytes; frames of pictures go with PNG."""
    each = {kind: (("codec", Stage(lambda raw, options, f=codec: f(raw))),) for kind, codec in codecs.items()}
    return each | ({"PNGFRAME": (("redeflate", STAGES["redeflate"]),)} if "PNG" in codecs else {})


class MadeNothing(ValueError):
    """A tool that made nothing of something; ``told`` is what the tiers were given and made, down to that one."""

    def __init__(self, tool: str, told: list[tuple[str, int, int]]):
        super().__init__(f"{tool} made nothing")
        self.told = told


def fold(raw: bytes, tiers: Iterable[tuple[str, Stage]], options: Options) -> tuple[bytes, list[tuple[str, int, int]]]:
    """What ``raw`` has become after all tiers, and what each was given and made. Nothing may stay nothing."""
    told, first = [], True
    for tool, stage in tiers:
        if not stage.takes(raw):
            told.append((tool, len(raw), len(raw)))
            continue
        new = stage.run(raw, options) or b""
        told.append((tool, len(raw), len(new)))
        if raw and not new:
            raise MadeNothing(tool, told)
        # of another format's bytes the first result counts, whatever its size
        raw = new if len(new) < len(raw) or (first and stage.takes is is_mpo) else raw
        first = False
    return raw, told


def run_tiers(items: DataFrame, by_format: Mapping[str, tuple[tuple[str, Stage], ...]]) -> DataFrame:
    """item_id, optimized, error and stages of ``items`` (item_id, format, content, settings) whose format has a pipeline.

    Contents are verified before any tool runs. An item that fails keeps its old
    bytes: optimized is null and the error told. stages has the bytes that each
    tool was given and made, also where the last of them made nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["item_id", "optimized", "stages", "error"]

        def batch(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            out["stages"] = [[{"tool": t, "bytes_in": i, "bytes_out": o} for t, i, o in told] for told in out["stages"]]
            return out[["item_id", "optimized", "error", "stages"]]

        for part in batches:
            rows, size = [], 0
            for item, kind, raw, settings in zip(part["item_id"], part["format"], part["content"], part["settings"]):
                try:
                    raw = bytes(raw)
                    verify(raw, kind)
                    rows.append((item, *fold(raw, by_format[kind], json.loads(settings) if settings else {}), None))
                    size += len(rows[-1][1])
                except Exception as error:  # noqa: BLE001  any failure of a tool is the item's
                    rows.append((item, None, error.told if isinstance(error, MadeNothing) else [], str(error) or type(error).__name__))
                if size >= BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
            # a table without rows has no type that Arrow takes for stages
            if rows:
                yield batch(rows)

    held = items.where(F.col("format").isin(*by_format)).select("item_id", "format", "content", "settings")
    return held.mapInPandas(run, LEAF)
