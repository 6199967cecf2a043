"""Leaf transforms: bytes to bytes that mean the same, run where the rows are."""

from __future__ import annotations

import importlib.util
import shutil
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Tools by handler: handler, tier, alternative, tool, library or program, required.
TOOLS = (
    ("Png", 0, 0, "oxipng", "library", False),
    ("Png", 0, 1, "redeflate", "builtin", True),
    ("Png", 1, 0, "pngout", "program", False),
    ("Jpeg", 0, 0, "mozjpeg_lossless_optimization", "library", True),
    ("ToJPEG", 0, 0, "mpo_extract", "builtin", True),
    ("ToJPEG", 1, 0, "mozjpeg_lossless_optimization", "library", False),
    ("Gif", 0, 0, "gifsicle", "program", False),
    ("Gif", 0, 1, "PIL", "library", True),
    ("WebPLossless", 0, 0, "cwebp", "program", False),
    ("WebPLossless", 0, 1, "PIL", "library", True),
    ("GifAnimated", 0, 0, "gif2webp", "program", False),
    ("GifAnimated", 0, 1, "PIL", "library", True),
    ("WebPAnimated", 0, 0, "webpmux", "program", True),
    ("Svg", 0, 0, "svgo", "program", False),
    ("Svg", 0, 1, "npx", "program", True),
    ("JxlLossless", 0, 0, "pillow_jxl", "library", True),
    ("Pdf", 0, 0, "pikepdf", "library", True),
    ("Rar", 0, 0, "unrar", "program", True),
    ("Zip", 0, 0, "zipfile", "library", True),
    ("Tar", 0, 0, "tarfile", "library", True),
    ("SevenZip", 0, 0, "py7zr", "library", True),
)


def probe(tool: str, kind: str) -> bool:
    if kind == "library":
        return importlib.util.find_spec(tool) is not None
    return kind == "builtin" or shutil.which(tool) is not None


#: What was found, by application.
_found: dict[str, list[tuple]] = {}


def tools(spark: SparkSession) -> DataFrame:
    """handler, tier, alt, tool, kind, required and available, probed where tasks run, once an application: some twenty rows."""
    schema = "handler string, tier int, alt int, tool string, kind string, required boolean, available boolean"
    own = spark.sparkContext.applicationId
    if own not in _found:
        _found[own] = [tuple(r) for r in probed(spark).collect()]
    return spark.createDataFrame(_found[own], schema)


def probed(spark: SparkSession) -> DataFrame:
    """The same, asked anew."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part.assign(available=[probe(t, k) for t, k in zip(part["tool"], part["kind"])])

    schema = "handler string, tier int, alt int, tool string, kind string, required boolean"
    return spark.createDataFrame(list(TOOLS), schema).mapInPandas(ask, f"{schema}, available boolean")


def redeflate_png(raw: bytes, keep_metadata: bool = True) -> bytes:
    """The same PNG with its image data deflated anew, as small as zlib makes it."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, chunks, data = 8, [], b""
    while at + 12 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("cut off")
        if kind == b"IDAT":
            if not data:
                chunks.append((kind, b""))
            data += body
        elif keep_metadata or kind[0] & 0x20 == 0 or kind in (b"tRNS", b"gAMA", b"sRGB", b"iCCP", b"cHRM", b"acTL", b"fcTL", b"fdAT"):
            chunks.append((kind, body))
        at += 12 + size
    pixels = zlib.decompress(data)
    tried = []
    for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_FILTERED, zlib.Z_RLE):
        packer = zlib.compressobj(9, zlib.DEFLATED, 15, 9, strategy)
        tried.append(packer.compress(pixels) + packer.flush())
    best = min([data, *tried], key=len)
    out = [raw[:8]]
    for kind, body in chunks:
        body = best if kind == b"IDAT" else body
        out.append(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)))
    return b"".join(out)


def distinct_lines(raw: bytes) -> bytes:
    """A text without lines that repeat an earlier one."""
    return b"\n".join(dict.fromkeys(raw.split(b"\n")))
