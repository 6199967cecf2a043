"""Containers as tables of members: unpack by explosion, pack by runs of sorted rows."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import stat
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.batches import BATCH_BYTES
from siltworks.functions.paths import INCOMPRESSIBLE
from siltworks.functions.sniff import cp437_repair
from siltworks.operators.animated import apng_members, pack_apng

MEMBER = (
    "container_id string, archive_index int, header string, name string, kind string, linkname string, mtime double, "
    "mode int, compress_type int, comment binary, content binary, error string, settings string"
)
#: What packs each format.
TARS = {"TAR": None, "CBT": None, "TGZ": "gz", "TBZ": "bz2", "TXZ": "xz"}
ZIPS = ("ZIP", "CBZ", "EPUB")
#: The same for Arrow.
ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
MEMBERS = pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in MEMBER.split(", "))])
PACKED = pa.schema([("item_id", pa.string()), ("packed", pa.binary()), ("error", pa.string())])
#: Rows of a batch that is handed on.
BATCH_ROWS = 2000
#: The headers of a zip, a member's and the directory's, and its end; members and bytes that these can tell.
LOCAL, CENTRAL, LAST = struct.Struct("<4s2B4HL2L2H"), struct.Struct("<4s4B4HL2L5H2L"), struct.Struct("<4s4H2LH")
MOST_MEMBERS, MOST_BYTES = 65_534, 1 << 30
#: Fixed value: the first moment that a zip can tell.
FIRST_DAY = datetime(1980, 1, 1, tzinfo=timezone.utc).timestamp()
#: What a tar's header tells beside the columns of a member.
HEADER_FIELDS = ("uid", "gid", "uname", "gname", "devmajor", "devminor")


@dataclass(slots=True)
class Member:
    """A member that is to be packed; ``was`` is the name that it had."""

    archive_index: int | None
    header: str | None
    name: str
    kind: str
    linkname: str | None
    mtime: float | None
    mode: int | None
    compress_type: int | None
    comment: bytes | None
    content: bytes | None
    was: str


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """``rows`` as a batch; the list is emptied."""
    columns = list(zip(*rows)) or [()] * len(schema)
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def listed(column: pa.Array) -> list:
    """``column.to_pylist()``, by way of numpy where that means the same."""
    if column.null_count == len(column):
        return [None] * len(column)
    if column.null_count and pa.types.is_primitive(column.type):
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def told(value: float | None) -> bool:
    """Whether a number is one."""
    return value is not None and value == value


def day_of(date: int, time: int) -> float:
    """Seconds since the epoch of a member's time; the first moment if there is no such day, as in archives without dates."""
    try:
        return datetime((date >> 9) + 1980, date >> 5 & 15, date & 31, time >> 11, time >> 5 & 63, (time & 31) * 2, tzinfo=timezone.utc).timestamp()
    except ValueError:
        return FIRST_DAY


def plain_zip_members(raw: bytes) -> list[tuple] | None:
    """What :func:`zip_members` yields, of a zip as :func:`pack_plain_zip` makes it; null for any other, which is left to zipfile to read or to refuse.

    No comments, further fields, encryption or names of an older coding, all members
    stored or deflated one after another up to the directory, and both headers,
    sizes and sums agree.
    """
    last = len(raw) - LAST.size
    if last < 0:
        return None
    sign, disk, first, here, n, size, start, rest = LAST.unpack_from(raw, last)
    if sign != b"PK\5\6" or disk or first or here != n or n > MOST_MEMBERS or rest or start + size != last:
        return None
    out, at, place = [], start, 0
    for _ in range(n):
        if at + CENTRAL.size > last:
            return None
        sign, _, _, needs, _, flags, method, time, date, crc, packed, whole, length, extra, remark, disk, _, attributes, offset = CENTRAL.unpack_from(raw, at)
        name = raw[at + CENTRAL.size : at + CENTRAL.size + length]
        at += CENTRAL.size + length
        if sign != b"PK\1\2" or needs > 20 or flags & ~0x800 or method not in (0, 8) or extra or remark or disk or offset < place or offset + LOCAL.size > start:
            return None
        if len(name) < length or b"\0" in name or not (flags or name.isascii()):
            return None
        local = LOCAL.unpack_from(raw, offset)
        body = offset + LOCAL.size + length
        place = body + packed
        if local[0] != b"PK\3\4" or local[3] != flags or local[-2:] != (length, 0) or place > start or raw[offset + LOCAL.size : body] != name:
            return None
        try:
            name, data = name.decode(), raw[body:place]
            if method:
                data = zlib.decompress(data, -15) if whole or data != NOTHING else b""
        except (UnicodeDecodeError, zlib.error):
            return None
        if len(data) != whole or zlib.crc32(data) != crc:
            return None
        kind = ("dir", b"") if name.endswith("/") else ("file", data)
        out.append((name, kind[0], "", day_of(date, time), attributes >> 16, method, b"", kind[1]))
    return out if at == last else None


def zip_members(raw: bytes) -> Iterator[tuple]:
    """(name, kind, linkname, mtime, mode, compress_type, comment, content), read by position, not by name."""
    found = plain_zip_members(raw)
    if found is not None:
        yield from found
        return
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        for info in archive.infolist():
            name = info.filename if info.flag_bits & 0x800 else cp437_repair(info.filename)
            try:
                when = datetime(*info.date_time, tzinfo=timezone.utc).timestamp()
            except ValueError:  # no such day, as in archives without dates
                when = FIRST_DAY
            kind, data = ("dir", b"") if info.is_dir() else ("file", archive.read(info))
            yield name, kind, "", when, info.external_attr >> 16, info.compress_type, archive.comment, data


def tar_members(raw: bytes) -> Iterator[tuple]:
    """The same of a tar, compressed or not; links and devices have no bytes of their own."""
    return (member for _, *member in tar_entries(raw))


def tar_entries(raw: bytes) -> Iterator[tuple]:
    """The same after the header: a JSON object of the type, the owners and the device numbers."""
    kinds = {tarfile.DIRTYPE: "dir", tarfile.SYMTYPE: "symlink", tarfile.LNKTYPE: "hardlink"}
    with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as archive:
        for info in archive:
            kind = "file" if info.isreg() else kinds.get(info.type, "other")
            data = archive.extractfile(info).read() if kind == "file" else b""
            header = {"type": info.type.decode("latin-1")} | {f: getattr(info, f) for f in HEADER_FIELDS}
            yield json.dumps(header), info.name, kind, info.linkname, float(info.mtime), info.mode, None, b"", data


def members_of(raw: bytes, kind: str) -> Iterator[tuple]:
    """The members of a container of a format, each after its header."""
    if kind == "APNG":
        return apng_members(raw)
    return ((None, *m) for m in zip_members(raw)) if kind in ZIPS else tar_entries(raw)


def unpack(containers: DataFrame) -> DataFrame:
    """A row per member of ``containers`` (item_id, format, content, and settings if there are any); one row with the error if it can't be read."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out, size, contents = [], 0, part.column("content")
            for at, (item, kind, own) in enumerate(zip(*(listed(part.column(c)) for c in ("item_id", "format", "settings")))):
                try:
                    # one content at a time is taken out of the batch
                    rows = [(item, i, *m, None, own) for i, m in enumerate(members_of(bytes(contents[at].as_py()), kind))]
                except Exception as error:  # noqa: BLE001  a broken archive is a row, not the end of the job
                    rows = [(item, None, None, None, "error", None, None, None, None, None, None, str(error) or type(error).__name__, own)]
                out += rows
                size += sum(len(r[10] or b"") for r in rows)
                if size > BATCH_BYTES or len(out) > BATCH_ROWS:
                    yield batch_of(out, MEMBERS)
                    size = 0
            yield batch_of(out, MEMBERS)

    settings = "settings" if "settings" in containers.columns else F.lit(None).cast("string").alias("settings")
    return containers.select("item_id", "format", "content", settings).mapInArrow(explode, MEMBER)


def renamed(members: list[Member]) -> dict[str, str]:
    """The names that members have now by those that they had."""
    return {m.was: m.name for m in members}


def method(m: Member) -> int:
    """How a member is compressed: as it was, else by its name."""
    if told(m.compress_type):
        return int(m.compress_type)
    return zipfile.ZIP_STORED if m.name.lower().endswith(INCOMPRESSIBLE) else zipfile.ZIP_DEFLATED


def moment(m: Member) -> datetime:
    return datetime.fromtimestamp(max(m.mtime if told(m.mtime) else 0, FIRST_DAY), timezone.utc)


def deflated(data: bytes) -> bytes:
    packer = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush()


NOTHING = deflated(b"")


def plain(m: Member) -> bool:
    """Whether a member is a file that is stored or deflated, with a name as it is written."""
    return m.kind == "file" and m.compress_type in (None, zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) and "\0" not in m.name


def pack_plain_zip(members: list[Member], comment: bytes) -> bytes:
    """The zip that zipfile makes of plain members, byte by byte, in a fraction of its time for small ones."""
    out, directory, at = [], [], 0
    for m in members:
        kind, when, data = method(m), moment(m), bytes(m.content or b"")
        date, time = (when.year - 1980) << 9 | when.month << 5 | when.day, when.hour << 11 | when.minute << 5 | when.second // 2
        packed = (deflated(data) if data else NOTHING) if kind else data
        name = m.name.encode()
        flags, sums = (0 if m.name.isascii() else 0x800), (zlib.crc32(data), len(packed), len(data))
        mode = (int(m.mode) if told(m.mode) else 0o644) << 16 or 0o600 << 16
        out += LOCAL.pack(b"PK\3\4", 20, 0, flags, kind, time, date, *sums, len(name), 0), name, packed
        directory += CENTRAL.pack(b"PK\1\2", 20, 3, 20, 0, flags, kind, time, date, *sums, len(name), 0, 0, 0, 0, mode, at), name
        at += LOCAL.size + len(name) + len(packed)
    listed = b"".join(directory)
    return b"".join([*out, listed, LAST.pack(b"PK\5\6", 0, 0, len(members), len(members), len(listed), at, len(comment)), comment])


def pack_zip(members: list[Member]) -> bytes:
    """A zip of the members in their order; a hard link gets the bytes that it stands for.

    What a zip can't hold, a device or a link to nothing, is an error.
    """
    comment = bytes(members[0].comment) if members and isinstance(members[0].comment, (bytes, bytearray)) else b""
    if len(members) <= MOST_MEMBERS and len(comment) < 1 << 16 and all(map(plain, members)) and sum(len(m.content or b"") for m in members) <= MOST_BYTES:
        return pack_plain_zip(members, comment)
    out, whole, now = io.BytesIO(), {}, renamed(members)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as archive:
        for m in members:
            info = zipfile.ZipInfo(m.name, moment(m).timetuple()[:6])
            info.external_attr = (int(m.mode) if told(m.mode) else 0o644) << 16
            info.compress_type = method(m)
            if m.kind == "dir" and not info.filename.endswith("/"):
                info.filename += "/"
            data = bytes(m.content or b"")
            if m.kind == "symlink":
                info.external_attr, data = (stat.S_IFLNK | 0o777) << 16, m.linkname.encode()
            elif m.kind == "hardlink":
                data = whole[now.get(m.linkname, m.linkname)]
            elif m.kind == "other":
                raise ValueError(f"a zip can't hold {m.name}")
            whole[m.name] = data
            archive.writestr(info, data)
        archive.comment = comment
    return out.getvalue()


def pack_tar(members: list[Member], compression: str | None) -> bytes:
    out, now = io.BytesIO(), renamed(members)
    kinds = {"dir": tarfile.DIRTYPE, "symlink": tarfile.SYMTYPE, "hardlink": tarfile.LNKTYPE}
    with tarfile.open(fileobj=out, mode="w") as archive:
        for m in members:
            info = tarfile.TarInfo(m.name)
            info.mtime = int(m.mtime) if told(m.mtime) else 0
            info.mode = int(m.mode) if told(m.mode) else 0o644
            info.type, info.linkname = kinds.get(m.kind, tarfile.REGTYPE), now.get(m.linkname, m.linkname or "")
            if isinstance(m.header, str):
                header = json.loads(m.header)
                for field in HEADER_FIELDS:
                    setattr(info, field, header[field])
                if m.kind == "other":
                    info.type = header["type"].encode("latin-1")
            data = bytes(m.content or b"") if m.kind == "file" else b""
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    raw = out.getvalue()
    squeeze = {None: lambda x: x, "gz": lambda x: gzip.compress(x, 9, mtime=0), "bz2": lambda x: bz2.compress(x, 9), "xz": lambda x: lzma.compress(x, preset=9)}
    return squeeze[compression](raw)


def packed(members: list[Member], kind: str) -> bytes:
    """A container of a format from its members in their order."""
    if kind == "APNG":
        return pack_apng(members)
    return pack_zip(members) if kind in ZIPS else pack_tar(members, TARS[kind])


def pack(members: DataFrame, formats: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    """item_id, packed and error of the containers in ``formats`` (item_id, format), from their members in order.

    ``patches`` (container_id, archive_index, content, name) have new bytes (null:
    the old ones) and names of members. Formats, members and patches of a container
    meet in one exchange, a container's rows one after another, and one call packs
    many containers. A container is one value of the result, so it is what memory
    holds. An archive turned into a zip from another format gets its compression by
    content. A container that can't be packed has the error.
    """
    fields = [c.split()[0] for c in MEMBER.split(", ") if c.split()[0] not in ("container_id", "error", "settings")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kind, rows, out, size = None, None, [], [], 0

        def close() -> None:
            try:
                done = (own, packed(rows, kind), None)
            except Exception as failed:  # noqa: BLE001  the old bytes stay
                done = (own, None, str(failed) or type(failed).__name__)
            out.append(done)

        for part in batches:
            # contents last: one at a time is taken out of the batch
            columns = [listed(part.column(c)) for c in ("container_id", "part", "format", *fields[:-1])]
            for (container, step, form, *values), content in zip(zip(*columns), part.column("content")):
                if container != own:
                    if kind is not None:
                        close()
                        size += len(out[-1][1] or b"")
                    own, kind, rows = container, None, []
                    if size > BATCH_BYTES or len(out) > BATCH_ROWS:
                        yield batch_of(out, PACKED)
                        size = 0
                if step == 0:
                    kind = form
                elif kind is not None and step == 1:
                    rows.append(Member(*values, content.as_py(), values[2]))
                elif kind is not None and rows:
                    rows[-1].name = values[2]
                    if content.is_valid:
                        rows[-1].content = content.as_py()
        if kind is not None:
            close()
        yield batch_of(out, PACKED)

    last = F.lit((1 << 31) - 1)
    heads = formats.select(F.col("item_id").alias("container_id"), "format", F.lit(0).alias("part"), F.lit(-1).alias("place"))
    both = members.select("container_id", *fields, F.lit(1).alias("part"), F.coalesce(F.col("archive_index").cast("int"), last).alias("place"))
    both = heads.unionByName(both, allowMissingColumns=True)
    if patches is not None:
        new = patches.select("container_id", "content", "name", F.lit(2).alias("part"), F.col("archive_index").cast("int").alias("place"))
        both = both.unionByName(new, allowMissingColumns=True)
    rows = both.repartition("container_id").sortWithinPartitions("container_id", "place", "part")
    return rows.select("container_id", "part", "format", *fields).mapInArrow(run, "item_id string, packed binary, error string")
