"""Readers of JPEG segments and of TIFF directories, in both byte orders."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from siltworks.functions.sniff import TIFF_LOSSLESS, insert_xmp

#: Bytes of a value by its type in a TIFF directory, and the compressions that a TIFF tells by number.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
COMPRESSION_TAG = 259
COMPRESSIONS = {
    1: "raw", 2: "tiff_ccitt", 3: "group3", 4: "group4", 5: "tiff_lzw", 6: "tiff_jpeg", 7: "jpeg", 8: "tiff_adobe_deflate",
    32771: "tiff_raw_16", 32773: "packbits", 32809: "tiff_thunderscan", 32946: "tiff_deflate", 34676: "tiff_sgilog",
    34677: "tiff_sgilog24", 34925: "lzma", 50000: "zstd", 50001: "webp",
}
#: The tag of the list of pictures in an MPO, the type of its primary one, and the heads of segments.
PICTURES_TAG, PRIMARY = 0xB002, 0x030000
MPF, EXIF, XMP = b"MPF\0", b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0"


def directory(raw: bytes, base: int = 0, at: int | None = None) -> dict[int, bytes]:
    """The values of one directory of a TIFF that begins at ``base``, by tag, in big-endian order; offsets are followed.

    What lies outside the bytes raises ValueError.
    """
    order = {b"II": "<", b"MM": ">"}.get(raw[base : base + 2])
    try:
        if order is None or struct.unpack_from(order + "H", raw, base + 2)[0] != 42:
            raise ValueError("no TIFF header")
        at = base + struct.unpack_from(order + "I", raw, base + 4)[0] if at is None else at
        out = {}
        for k in range(struct.unpack_from(order + "H", raw, at)[0]):
            tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
            size = SIZES.get(kind, 0) * n
            place = at + 10 + 12 * k
            if size > 4:
                place = base + struct.unpack_from(order + "I", raw, place)[0]
            value = raw[place : place + size]
            if len(value) < size:
                raise ValueError("a value lies outside")
            width = 1 if kind in (1, 2, 6, 7) else min(SIZES[kind], 4) if kind in (5, 10) else SIZES.get(kind, 1)
            if order == "<" and width > 1:
                value = b"".join(value[i : i + width][::-1] for i in range(0, size, width))
            out[tag] = value
    except struct.error:
        raise ValueError("cut off") from None
    return out


def tiff_compression(raw: bytes) -> str | None:
    """The name of a TIFF's compression; null where it tells none."""
    value = directory(raw).get(COMPRESSION_TAG)
    return None if value is None else COMPRESSIONS.get(int.from_bytes(value[:2], "big"), "unknown")


def tiff_is_lossless(raw: bytes | None) -> bool | None:
    """Whether a TIFF's compression loses nothing; false for what can't be read."""
    if raw is None or raw[:4] not in (b"II*\0", b"MM\0*"):
        return None
    try:
        told = tiff_compression(raw)
    except ValueError:
        return False
    return told is None or told == "raw" or told in TIFF_LOSSLESS


def segments(raw: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, place of the body, its length) of each segment before the image data, which comes last, without a length."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at = 2
    while True:
        while raw[at : at + 2] == b"\xff\xff":
            at += 1
        if raw[at : at + 1] != b"\xff" or at + 4 > len(raw):
            raise ValueError("cut off")
        marker, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        if size < 2 or at + 2 + size > len(raw):
            raise ValueError("cut off")
        if marker == 0xDA:
            yield marker, at + 4, 0
            return
        yield marker, at + 4, size - 2
        at += 2 + size


def _body(raw: bytes, marker: int, head: bytes) -> tuple[int, int] | None:
    """Place and length of the first segment of this kind."""
    return next(((at, n) for m, at, n in segments(raw) if m == marker and raw[at : at + len(head)] == head), None)


def pictures(raw: bytes) -> list[tuple[int, int, int]]:
    """(type, place, size) of the pictures of an MPO; none of a plain JPEG."""
    found = _body(raw, 0xE2, MPF)
    if found is None:
        return []
    base = found[0] + len(MPF)
    told = directory(raw, base).get(PICTURES_TAG, b"")
    order = "<" if raw[base : base + 2] == b"II" else ">"
    out = []
    for k in range(0, len(told) - 15, 16):
        kind, size, offset = struct.unpack_from(order + "III", told, k)
        out.append((kind & 0xFFFFFF, base + offset if offset else 0, size))
    return out


def is_mpo(raw: bytes | None) -> bool:
    """Whether a JPEG is an MPO of several pictures."""
    try:
        return raw is not None and raw[:2] == b"\xff\xd8" and len(pictures(raw)) > 1
    except ValueError:
        return False


def primary_picture(raw: bytes) -> bytes:
    """The primary picture of an MPO as a JPEG of its own, with the file's EXIF and XMP, and without the list of pictures.

    An MPO without a primary picture, or with one that is cut off, raises ValueError.
    """
    found = next(((at, size) for kind, at, size in pictures(raw) if kind == PRIMARY), None)
    if found is None:
        raise ValueError("an MPO without a primary picture")
    out = raw[found[0] : found[0] + found[1]]
    if len(out) < found[1] or out[:2] != b"\xff\xd8":
        raise ValueError("the primary picture is cut off")
    if listed := _body(out, 0xE2, MPF):
        out = out[: listed[0] - 4] + out[listed[0] + listed[1] :]
    if found[0]:  # its metadata stands in the first picture
        xmp, exif = _body(raw, 0xE1, XMP), _body(raw, 0xE1, EXIF)
        if xmp and not _body(out, 0xE1, XMP):
            out = insert_xmp(out, raw[xmp[0] + len(XMP) : xmp[0] + xmp[1]])
        if exif and not _body(out, 0xE1, EXIF):
            out = out[:2] + b"\xff\xe1" + struct.pack(">H", exif[1] + 2) + raw[exif[0] : exif[0] + exif[1]] + out[2:]
    return out
