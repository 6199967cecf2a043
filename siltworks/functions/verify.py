"""Structural verification: a corrupt picture is an error of its kind before any tool sees it."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F

from siltworks.functions.jpeg import segments


class UnreadableImage(ValueError):
    """A file that has the magic number of a picture and isn't one."""


def _png(raw: bytes) -> None:
    """Chunks with right sums, IHDR first, image data, IEND."""
    at, kinds = 8, []
    while at + 12 <= len(raw):
        size = struct.unpack_from(">I", raw, at)[0]
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(raw):
            raise UnreadableImage(f"PNG: {kind.decode('latin-1')} is cut off")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", raw, at + 8 + size)[0]:
            raise UnreadableImage(f"PNG: wrong sum of {kind.decode('latin-1')}")
        kinds.append(kind)
        at += 12 + size
        if kind == b"IEND":
            break
    if not kinds or kinds[0] != b"IHDR" or b"IDAT" not in kinds:
        raise UnreadableImage("PNG: no header or no image data")
    if kinds[-1] != b"IEND":
        raise UnreadableImage("PNG: no end")


def _gif(raw: bytes) -> None:
    """Header, colour table, blocks of known kinds up to the trailer, with a picture."""

    def blocks(at: int) -> int:
        while raw[at]:
            at += 1 + raw[at]
        return at + 1

    try:
        at = 13 + (3 << (raw[10] & 7) + 1 if raw[10] & 0x80 else 0)
        found = False
        while raw[at] != 0x3B:
            if raw[at] == 0x21:
                at = blocks(at + 2)
            elif raw[at] == 0x2C:
                table = raw[at + 9]
                at = blocks(at + 11 + (3 << (table & 7) + 1 if table & 0x80 else 0))
                found = True
            else:
                raise UnreadableImage("GIF: a block of no kind")
    except IndexError:
        raise UnreadableImage("GIF: cut off") from None
    if not found:
        raise UnreadableImage("GIF: no picture")


def _jpeg(raw: bytes) -> None:
    """Segments of told lengths with a frame header, up to the image data."""
    try:
        kinds = [m for m, _, _ in segments(raw)]
    except ValueError as error:
        raise UnreadableImage(f"JPEG: {error}") from None
    if not any(0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC) for m in kinds):
        raise UnreadableImage("JPEG: no frame")


def _bmp(raw: bytes) -> None:
    """A header with a size and a depth, and image data within the file."""
    if len(raw) < 26:
        raise UnreadableImage("BMP: cut off")
    start, head = struct.unpack_from("<II", raw, 10)
    if head == 12:
        width, height, _, depth = struct.unpack_from("<HHHH", raw, 18)
    elif len(raw) < 30:
        raise UnreadableImage("BMP: cut off")
    else:
        width, height, _, depth = struct.unpack_from("<iiHH", raw, 18)
    if not width or not height or depth not in (1, 4, 8, 16, 24, 32):
        raise UnreadableImage(f"BMP: {width} by {height} of depth {depth}")
    if start > len(raw):
        raise UnreadableImage("BMP: image data lies outside")


def _webp(raw: bytes) -> None:
    if struct.unpack_from("<I", raw, 4)[0] + 8 > len(raw):
        raise UnreadableImage("WEBP: cut off")


#: What verifies a format, in the order in which formats are tried.
RULES: dict[str, Callable[[bytes], None]] = {"PNG": _png, "PNGFRAME": _png, "APNG": _png, "GIF": _gif, "JPEG": _jpeg, "MPO": _jpeg, "WEBP": _webp, "BMP": _bmp}


def verify(raw: bytes, kind: str | None) -> None:
    """Raises :class:`UnreadableImage` if ``raw`` isn't a whole file of ``kind``; kinds without a rule pass."""
    if kind in RULES:
        RULES[kind](raw)


def fault_column():
    """A Pandas UDF from (format, content) to what is wrong with it; null if nothing is."""

    @F.pandas_udf("string")
    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for kinds, contents in parts:
            told = []
            for kind, content in zip(kinds, contents):
                try:
                    told.append(None if content is None else verify(bytes(content), kind))
                except UnreadableImage as error:
                    told.append(str(error))
            yield pd.Series(told, dtype=object)

    return of
