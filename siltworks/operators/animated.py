"""Animated PNGs as containers of frames: each frame a PNG of its own, with its control data beside it.

Frames are numbered from 1; a picture that stands before the animation and is no
part of it is number 0. Where pictures are packed again, the shared chunks come
from the head, and frames must still fit it.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.frames import whole_ms

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Control fields of a frame in their order and their layout; chunks that every frame's picture needs.
CONTROL, LAYOUT = ("width", "height", "x", "y", "num", "den", "dispose", "blend"), ">IIIIHHBB"
SHARED = (b"PLTE", b"tRNS", b"gAMA", b"cHRM", b"sRGB", b"iCCP", b"sBIT")
HEAD, TAIL = "head", "tail"


def chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of each chunk up to the end; one that is cut off raises ValueError."""
    if raw[:8] != MAGIC:
        raise ValueError("no PNG")
    at = 8
    while at < len(raw):
        if at + 12 > len(raw):
            raise ValueError("cut off")
        size, kind = struct.unpack_from(">I4s", raw, at)
        if at + 12 + size > len(raw):
            raise ValueError("cut off")
        yield kind, raw[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IEND":
            return


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def duration(num: int, den: int) -> float:
    """Milliseconds; a denominator of 0 stands for 100."""
    return 1000 * num / (den or 100)


def apng_members(raw: bytes) -> Iterator[tuple]:
    """(header, name, kind, linkname, mtime, mode, compress_type, comment, content): the head, the frames and the tail.

    A frame's header is a JSON object of its number, control fields and duration;
    the head's has the number of plays. What has no animation raises ValueError.
    """
    head, tail, frames, own, plays = [], [], [], None, None
    for kind, body in chunks(raw):
        if kind == b"acTL":
            plays = struct.unpack(">II", body)[1]
        elif kind == b"fcTL":
            frames.append((dict(zip(CONTROL, struct.unpack_from(LAYOUT, body, 4))), []))
            own = frames[-1][1]
        elif kind in (b"IDAT", b"fdAT"):
            if own is None:  # a picture that is no frame
                frames.append((None, []))
                own = frames[-1][1]
            own.append(body if kind == b"IDAT" else body[4:])
        elif kind != b"IEND":
            (tail if any(data for _, data in frames) else head).append((kind, body))
    if plays is None or not head or head[0][0] != b"IHDR":
        raise ValueError("no animated PNG")
    header, shared = head[0][1], [c for c in head[1:] if c[0] in SHARED]
    yield json.dumps({"plays": plays}), HEAD, "meta", "", None, None, None, b"", b"".join(chunk(*c) for c in head)
    number = 0 if frames and frames[0][0] is None else 1
    for control, data in frames:
        size = struct.pack(">II", control["width"], control["height"]) if control else header[:8]
        picture = [(b"IHDR", size + header[8:]), *shared, (b"IDAT", b"".join(data)), (b"IEND", b"")]
        told = {"frame": number, "duration": duration(control["num"], control["den"]) if control else None} | (control or {})
        yield json.dumps(told), f"frame_#{number:03d}.img", "file", "", None, None, None, b"", MAGIC + b"".join(chunk(*c) for c in picture)
        number += 1
    yield None, TAIL, "meta", "", None, None, None, b"", b"".join(chunk(*c) for c in tail)


def pack_apng(members: Iterable) -> bytes:
    """An animated PNG of the head, the frames by number and the tail.

    A frame whose size, depth, colours or palette differ from the head's raises ValueError.
    """
    members = list(members)
    ends = {m.name: m for m in members if m.kind == "meta"}
    frames = sorted(((json.loads(m.header), bytes(m.content)) for m in members if m.kind == "file"), key=lambda f: f[0]["frame"])
    if HEAD not in ends or not any("width" in told for told, _ in frames):
        raise ValueError("no frames to pack")
    head = list(chunks(MAGIC + bytes(ends[HEAD].content)))
    shared = {k: body for k, body in head if k in (b"PLTE", b"tRNS")}
    out = [MAGIC, *(chunk(*c) for c in head)]
    control = struct.pack(">II", sum("width" in told for told, _ in frames), json.loads(ends[HEAD].header)["plays"])
    out.append(chunk(b"acTL", control))
    number, first = 0, True
    for told, picture in frames:
        parts = list(chunks(picture))
        size = (told["width"], told["height"]) if "width" in told else struct.unpack_from(">II", head[0][1])
        if parts[0][1] != struct.pack(">II", *size) + head[0][1][8:] or {k: b for k, b in parts if k in (b"PLTE", b"tRNS")} != shared:
            raise ValueError(f"frame {told['frame']} doesn't fit the others")
        if "width" in told:
            out.append(chunk(b"fcTL", struct.pack(">I", number) + struct.pack(LAYOUT, *(told[c] for c in CONTROL))))
            number += 1
        data = b"".join(body for kind, body in parts if kind == b"IDAT")
        if first:
            out.append(chunk(b"IDAT", data))
        else:
            out.append(chunk(b"fdAT", struct.pack(">I", number) + data))
            number += 1
        first = False
    out += [bytes(ends[TAIL].content) if TAIL in ends else b"", chunk(b"IEND", b"")]
    return b"".join(out)


def frames(members: DataFrame) -> DataFrame:
    """container_id, frame, duration (null where a frame tells none) and content of the frames among ``members``."""
    told = members.where("kind = 'file'")
    field = lambda name, kind: F.get_json_object("header", f"$.{name}").cast(kind).alias(name)
    return told.select("container_id", field("frame", "int"), field("duration", "double"), "content")


def frame_durations(told: DataFrame) -> DataFrame:
    """container_id, frame and ms for ``told`` (container_id, frame, duration).

    Durations go to frames by position: the k-th that is told to the k-th frame,
    and frames that are left over get the mean of the container's; null where a
    container tells none. ms are whole and at least 1.
    """
    order = Window.partitionBy("container_id").orderBy("frame")
    own = told.select("container_id", "frame", F.row_number().over(order).alias("place"))
    held = told.where("duration is not null").select("container_id", "duration", F.row_number().over(order).alias("place"))
    both = own.join(held, ["container_id", "place"], "full_outer")
    both = both.withColumn("mean", F.avg("duration").over(Window.partitionBy("container_id")))
    told = F.when(F.col("mean").isNotNull(), whole_ms(F.coalesce("duration", "mean")))
    return both.select("container_id", "frame", told.alias("ms")).where("frame is not null")
