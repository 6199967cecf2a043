"""Format detection from leading bytes: magic numbers by SQL, structures by small parsers."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = 4096
#: Fixed values: (offset, bytes, format) of magic numbers, in the order of the test.
MAGIC = (
    (0, b"\x89PNG\r\n\x1a\n", "PNG"),
    (0, b"GIF87a", "GIF"),
    (0, b"GIF89a", "GIF"),
    (0, b"\xff\xd8\xff", "JPEG"),
    (8, b"WEBP", "WEBP"),
    (0, b"\xff\x0a", "JXL"),
    (0, b"\x00\x00\x00\x0cJXL \r\n\x87\n", "JXL"),
    (0, b"BM", "BMP"),
    (0, b"II*\x00", "TIFF"),
    (0, b"MM\x00*", "TIFF"),
    (0, b"8BPS", "PSD"),
    (0, b"qoif", "QOI"),
    (0, b"PK\x03\x04", "ZIP"),
    (0, b"PK\x05\x06", "ZIP"),
    (0, b"Rar!\x1a\x07", "RAR"),
    (0, b"7z\xbc\xaf\x27\x1c", "7Z"),
    (0, b"\x1f\x8b", "GZ"),
    (0, b"BZh", "BZ2"),
    (0, b"\xfd7zXZ\x00", "XZ"),
    (257, b"ustar", "TAR"),
)
#: TIFF compressions that lose nothing; a missing one too.
TIFF_LOSSLESS = (
    "group3", "group4", "lzma", "packbits", "tiff_adobe_deflate", "tiff_ccitt", "tiff_lzw", "tiff_raw_16",
    "tiff_sgilog", "tiff_sgilog24", "tiff_thunderscan", "zstd",
)


def starts_at(content: Column, offset: int, magic: bytes) -> Column:
    return F.hex(F.substring(content, offset + 1, len(magic))) == magic.hex().upper()


def magic_format(content: Column) -> Column:
    """The format that a magic number tells; PDF within the first 1024 bytes; else null."""
    out = F.lit(None).cast("string")
    pdf = F.instr(F.hex(F.substring(content, 1, 1024)), b"%PDF-".hex().upper())
    out = F.when((pdf > 0) & (pdf % 2 == 1), "PDF").otherwise(out)
    for offset, magic, name in reversed(MAGIC):
        out = F.when(starts_at(content, offset, magic), name).otherwise(out)
    return out


def png_bit_depth(content: Column) -> Column:
    """Byte 24 of a PNG; null where the file is cut off before it or is no PNG."""
    depth = F.conv(F.hex(F.substring(content, 25, 1)), 16, 10).cast("int")
    return F.when(starts_at(content, 0, MAGIC[0][1]) & (F.length(content) >= 25), depth)


def tiff_lossless(compression: Column) -> Column:
    return compression.isNull() | compression.isin(*TIFF_LOSSLESS)


def palette_rgb(index: Column) -> Column:
    """A palette index as red, green and blue: 3, 3 and 2 bits, each times 36."""
    return F.array(F.shiftright(index, 5).bitwiseAND(7) * 36, F.shiftright(index, 2).bitwiseAND(7) * 36, index.bitwiseAND(3) * 36)


def webp_lossless(raw: bytes | None) -> bool | None:
    """Whether the first image chunk is of the lossless kind; null if there is none."""
    if raw is None or raw[:4] != b"RIFF" or raw[8:12] != b"WEBP":
        return None
    at, end = 12, len(raw)
    while at + 8 <= end:
        kind, size = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
        if kind in (b"VP8L", b"VP8 "):
            return kind == b"VP8L"
        # a frame's image chunks follow its 16 bytes of parameters
        at += 8 + (16 if kind == b"ANMF" else size + size % 2)
    return None


class Bits:
    """Reads bits, the lowest of each byte first."""

    def __init__(self, raw: bytes):
        self.value, self.left = int.from_bytes(raw[:JXL_HEAD], "little"), 8 * min(JXL_HEAD, len(raw))

    def take(self, n: int) -> int:
        if n > self.left:
            raise ValueError("cut off")
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.left -= n
        return out

    def u32(self, *choices: tuple[int, int]) -> int:
        base, n = choices[self.take(2)]
        return base + self.take(n)


#: Fixed values of the format, each (base, bits) by a selector of two bits: sizes, previews by eights or not, ticks, loops,
#: depths of samples, numbers, shifts and names of extra channels, kinds, and filter arrays.
SIZE = ((1, 9), (1, 13), (1, 18), (1, 30))
PREVIEW = {1: ((16, 0), (32, 0), (1, 5), (33, 9)), 0: ((1, 6), (65, 8), (321, 10), (1345, 12))}
TICKS, PER, LOOPS = ((100, 0), (1000, 0), (1, 10), (1, 30)), ((1, 0), (1001, 0), (1, 8), (1, 10)), ((0, 0), (0, 3), (0, 16), (0, 32))
FLOAT_DEPTH, DEPTH = ((32, 0), (16, 0), (24, 0), (1, 6)), ((8, 0), (10, 0), (12, 0), (1, 6))
CHANNELS, KIND, SHIFT = ((0, 0), (1, 0), (2, 4), (1, 12)), ((0, 0), (1, 0), (2, 4), (18, 6)), ((0, 0), (3, 0), (4, 0), (1, 3))
NAME, FILTER = ((0, 0), (0, 4), (16, 5), (48, 10)), ((1, 0), (0, 2), (3, 4), (19, 8))
#: Kinds of extra channels with fields of their own, and the most that a picture has.
ALPHA, SPOT, FILTER_ARRAY, MOST_CHANNELS = 0, 2, 5, 256
#: Bytes of a codestream that are read; a header is some dozens.
JXL_HEAD = 1024


def _size(bits: Bits) -> None:
    small = bits.take(1)
    bits.take(5) if small else bits.u32(*SIZE)
    if not bits.take(3):  # no ratio that tells the width
        bits.take(5) if small else bits.u32(*SIZE)


def _preview(bits: Bits) -> None:
    told = PREVIEW[bits.take(1)]
    bits.u32(*told)
    if not bits.take(3):
        bits.u32(*told)


def _depth(bits: Bits) -> None:
    if bits.take(1):  # floating point samples
        bits.u32(*FLOAT_DEPTH)
        bits.take(4)
    else:
        bits.u32(*DEPTH)


def _channel(bits: Bits) -> None:
    if bits.take(1):  # a default alpha channel
        return
    kind = bits.u32(*KIND)
    _depth(bits)
    bits.u32(*SHIFT)
    bits.take(8 * bits.u32(*NAME))
    if kind == ALPHA:
        bits.take(1)
    elif kind == SPOT:
        bits.take(4 * 16)
    elif kind == FILTER_ARRAY:
        bits.u32(*FILTER)


def _codestream_lossless(raw: bytes) -> bool:
    """False if the header says that colours are in the perceptual space, which only lossy coding uses."""
    bits = Bits(raw[2:])
    _size(bits)
    if bits.take(1):  # all defaults: perceptual
        return False
    if bits.take(1):  # extra fields
        bits.take(3)
        if bits.take(1):  # intrinsic size
            _size(bits)
        if bits.take(1):
            _preview(bits)
        if bits.take(1):  # animation
            bits.u32(*TICKS)
            bits.u32(*PER)
            bits.u32(*LOOPS)
            bits.take(1)
    _depth(bits)
    bits.take(1)  # 16 bit buffers are enough
    n = bits.u32(*CHANNELS)
    if n > MOST_CHANNELS:
        return False
    for _ in range(n):
        _channel(bits)
    return not bits.take(1)


def jxl_lossless(raw: bytes | None) -> bool | None:
    """Whether a bare or boxed codestream is lossless; false for rebuilt JPEGs and whatever can't be read."""
    if raw is None:
        return None
    if raw[:2] == b"\xff\x0a":
        stream = raw
    elif raw[:12] == b"\x00\x00\x00\x0cJXL \r\n\x87\n":
        at, stream = 0, b""
        while at + 8 <= len(raw):
            size, kind, head = struct.unpack(">I", raw[at : at + 4])[0], raw[at + 4 : at + 8], 8
            if size == 1:
                if at + 16 > len(raw):
                    return False
                size, head = struct.unpack(">Q", raw[at + 8 : at + 16])[0], 16
            size = size or len(raw) - at
            if size < head:
                return False
            body = raw[at + head : at + size]
            if kind == b"jbrd" or kind == b"brob" and body[:4] == b"jbrd":
                return False
            if kind in (b"jxlc", b"jxlp") and len(stream) < JXL_HEAD:  # a codestream may be split
                stream += (body[4:] if kind == b"jxlp" else body)[:JXL_HEAD]
            at += size
    else:
        return None
    try:
        return stream[:2] == b"\xff\x0a" and _codestream_lossless(stream)
    except ValueError:
        return False


def bytes_column(rule: Callable[[bytes | None], object], kind: str):
    """A Pandas UDF that applies a parser to a binary column."""

    @F.pandas_udf(kind)
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([rule(None if x is None else bytes(x)) for x in part], dtype=object)

    return of


def cp437_repair(name: str | None) -> str | None:
    """A member name that was read as CP437, as UTF-8 if its bytes are that."""
    try:
        return None if name is None else name.encode("cp437").decode("utf-8")
    except UnicodeError:
        return name


def insert_xmp(raw: bytes, xmp: bytes) -> bytes:
    """A JPEG with an XMP segment right after its start; the length is big-endian."""
    body = b"http://ns.adobe.com/xap/1.0/\0" + xmp
    return raw[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + raw[2:] if raw[:2] == b"\xff\xd8" and len(body) + 2 < 1 << 16 else raw
