import hashlib
import io
import os
import random
import struct
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from siltworks.functions.batches import BATCH_BYTES, by_bytes
from siltworks.operators import archives, tiers
from siltworks.operators.codecs import distinct_lines, redeflate_png, tools
from siltworks.plans.folder import optimize_folder
from siltworks.plans.optimize import optimize
from siltworks.plans.queries import gray_png, picture
from siltworks.sources import files
from siltworks.sources.replace import replace_files
from siltworks.sources.scan import scan
from siltworks.streaming.incremental import optimize_stream


def png(width=64, height=64, level=0, text=b"note"):
    rows = b"".join(b"\0" + bytes((x * y) % 7 for x in range(width)) for y in range(height))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = zlib.compress(rows, level)
    return (
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"tEXt", text)
        + chunk(b"IDAT", data[:99]) + chunk(b"IDAT", data[99:]) + chunk(b"IEND", b"")
    )


def pixels(raw):
    at, data = 8, b""
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        data += raw[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += size + 12
    return zlib.decompress(data)


def zipped(members, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
        z.comment = comment
    return out.getvalue()


def tarred(members, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "target"
        t.addfile(link)
    return out.getvalue()


def test_codecs():
    raw = png()
    small = redeflate_png(raw)
    assert len(small) < len(raw) and pixels(small) == pixels(raw) and b"note" in small
    assert b"note" not in redeflate_png(raw, keep_metadata=False) and redeflate_png(small) == small
    with pytest.raises(ValueError):
        redeflate_png(b"junk")
    assert distinct_lines(b"a\nb\na") == b"a\nb"


def test_tools_are_probed_where_tasks_run(spark):
    rows = {(r.handler, r.tool): r.available for r in tools(spark).collect()}
    assert rows["Zip", "zipfile"] and rows["Png", "redeflate"]


@pytest.mark.parametrize(("kind", "raw"), [("ZIP", zipped([("b", b"1"), ("a", b"2"), ("b", b"3")], b"hi")), ("TAR", tarred([("b", b"1"), ("a", b"22")])), ("TGZ", tarred([("x", b"1")], "w:gz")), ("TXZ", tarred([("x", b"1")], "w:xz")), ("TBZ", tarred([("x", b"1")], "w:bz2"))])
@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_archives_come_back(spark, kind, raw):
    members = archives.unpack(spark.createDataFrame([("c", kind, raw), ("broken", kind, b"no")], "item_id string, format string, content binary"))
    rows = [r for r in members.collect() if r.container_id == "c"]
    packed = archives.pack(members.where("kind <> 'error'"), spark.createDataFrame([("c", kind)], "item_id string, format string")).collect()
    read = archives.zip_members if kind == "ZIP" else archives.tar_members
    assert packed[0].error is None and [(m[0], m[1], m[2], m[7]) for m in read(packed[0].packed)] == [(m[0], m[1], m[2], m[7]) for m in read(raw)]
    assert [r.archive_index for r in rows] == list(range(len(rows)))
    assert members.where("container_id = 'broken'").first().kind == "error"


def test_tar_becomes_zip_with_compression_by_content(spark):
    raw = tarred([("a.png", b"x" * 500), ("b.txt", b"y" * 500)])
    members = archives.unpack(spark.createDataFrame([("c", "TAR", raw)], "item_id string, format string, content binary"))
    packed = archives.pack(members.where("kind = 'file'"), spark.createDataFrame([("c", "ZIP")], "item_id string, format string")).first().packed
    infos = zipfile.ZipFile(io.BytesIO(packed)).infolist()
    assert [i.compress_type for i in infos] == [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED] and all(i.date_time[0] >= 1980 for i in infos)


def test_scan(spark, tmp_path):
    files.register(spark)
    (tmp_path / "sub").mkdir()
    for name in ("b", "_a", ".c", "sub/d", "x.siltworks-tmp"):
        (tmp_path / name).write_bytes(name.encode() * 2000)
    os.symlink(tmp_path, tmp_path / "sub" / "loop")
    os.symlink(tmp_path / "b", tmp_path / "link")
    os.mkfifo(tmp_path / "pipe")
    load = lambda **o: spark.read.format("files").options(**o).load(str(tmp_path))
    rows = {os.path.relpath(r.path, tmp_path): r for r in load(batch="3000").collect()}
    assert sorted(rows) == [".c", "_a", "b", "link", "sub/d"] and rows["link"].is_symlink and len(rows["sub/d"].content) == 4096
    assert load(symlinks="false", recurse="false", content="none").where("content is null").count() == 3
    assert files.top_paths([str(tmp_path), str(tmp_path)]) == [str(tmp_path)]
    with pytest.raises(FileNotFoundError):
        files.top_paths([str(tmp_path / "none")])


def test_whole_run_with_nested_archives(spark):
    inner = zipped([("p.png", png()), ("t.txt", b"text")])
    outer = tarred([("inner.zip", inner), ("same.txt", b"x"), (".hidden.png", png())])
    bad = zipped([("broken.png", b"\x89PNG\r\n\x1a\nxx"), ("fine.png", png())])
    items = [("/r/a.png", png()), ("/r/o.tar", outer), ("/r/bad.cbz", bad), ("/r/idle.zip", zipped([("t.txt", b"t")])), ("/r/junk.zip", b"PK\x03\x04no"), ("/r/.skip.png", png()), ("/r/text", b"text")]
    rows = {r.path: r for r in optimize(spark.createDataFrame(items, "path string, content binary")).collect()}
    assert sorted(rows) == sorted(p for p, _ in items if ".skip" not in p)
    assert rows["/r/a.png"].kind == "saved" and pixels(bytes(rows["/r/a.png"].data)) == pixels(png())
    members = {m[0]: m[7] for m in archives.tar_members(bytes(rows["/r/o.tar"].data))}
    assert members[".hidden.png"] == png() and members["same.txt"] == b"x" and "link" in members
    deep = {m[0]: m[7] for m in archives.zip_members(members["inner.zip"])}
    assert deep["t.txt"] == b"text" and len(deep["p.png"]) < len(png()) and pixels(deep["p.png"]) == pixels(png())
    kept = {m[0]: m[7] for m in archives.zip_members(bytes(rows["/r/bad.cbz"].data))}
    assert rows["/r/bad.cbz"].kind == "error" and kept["broken.png"] == b"\x89PNG\r\n\x1a\nxx" and len(kept["fine.png"]) < len(png())
    assert not rows["/r/idle.zip"].changed and rows["/r/idle.zip"].kind == "lost"
    assert rows["/r/junk.zip"].kind == "error" and rows["/r/junk.zip"].data is None
    assert rows["/r/text"].kind == "lost"


def test_replacing_is_whole_and_can_run_twice(spark, tmp_path):
    old, new = b"old bytes", b"new"
    for name in ("a.gif", "b", "c"):
        (tmp_path / name).write_bytes(old)
    (tmp_path / "c").write_bytes(b"changed since")
    scanned = hashlib.sha256(old).hexdigest()
    rows = [(str(tmp_path / a), str(tmp_path / b), new, scanned) for a, b in (("a.gif", "a.png"), ("b", "b"), ("c", "c"))]
    df = spark.createDataFrame(rows, "path string, target string, data binary, scanned string")
    os.utime(tmp_path / "b", (5, 5))
    status = lambda: {os.path.basename(r.path): r.status for r in replace_files(df, preserve=True).collect()}
    assert status() == {"a.gif": "written", "b": "written", "c": "changed"}
    assert status() == {"a.gif": "done", "b": "done", "c": "changed"}
    assert sorted(os.listdir(tmp_path)) == ["a.png", "b", "c"] and (tmp_path / "b").read_bytes() == new and os.stat(tmp_path / "b").st_mtime == 5


def test_stream_takes_only_what_is_new(spark, tmp_path):
    root, state = tmp_path / "in", tmp_path / "state"
    root.mkdir()
    (root / "a.png").write_bytes(png())
    assert optimize_stream(spark, str(root), str(state), optimize).awaitTermination(60)
    (root / "b.png").write_bytes(png(32, 32))
    assert optimize_stream(spark, str(root), str(state), optimize).awaitTermination(60)
    seen = spark.read.parquet(f"{state}/reports").select("path", "batch", F.col("kind"))
    assert {(os.path.basename(r.path), r.batch, r.kind) for r in seen.collect()} == {("a.png", 0, "saved"), ("b.png", 1, "saved")}
    assert spark.read.parquet(f"{state}/stamps").count() == 2


def test_failed_files_get_no_stamp(spark, tmp_path):
    root, state = tmp_path / "in", tmp_path / "state"
    root.mkdir()
    (root / "a.png").write_bytes(png())
    (root / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    assert optimize_stream(spark, str(root), str(state), optimize).awaitTermination(60)
    assert [os.path.basename(r.path) for r in spark.read.parquet(f"{state}/stamps").collect()] == ["a.png"]


def test_a_zip_without_dates_is_read(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("a", b"x")
    raw = bytearray(out.getvalue())
    for mark, at in ((b"PK\x03\x04", 10), (b"PK\x01\x02", 12)):
        raw[raw.index(mark) + at : raw.index(mark) + at + 4] = bytes(4)
    [member] = archives.zip_members(bytes(raw))
    assert member[3] == archives.FIRST_DAY and member[7] == b"x"


def test_containers_are_opened_to_the_last(spark):
    data, name = png(), "p.png"
    for depth in range(6):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr(name, data)
        data, name = out.getvalue(), f"{depth}.zip"
    [row] = optimize(spark.createDataFrame([("/r/deep.zip", bytearray(data))], "path string, content binary")).collect()
    assert row.changed and row.error is None
    inner = bytes(row.data)
    for _ in range(6):
        [(_, *_, inner)] = archives.zip_members(inner)
    assert len(inner) < len(png()) and pixels(inner) == pixels(png())


def special_tar():
    out, big = io.BytesIO(), png(200, 200)
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, kind, link in (("p.png", tarfile.REGTYPE, ""), ("again.png", tarfile.LNKTYPE, "p.png"), ("pipe", tarfile.FIFOTYPE, ""), ("dev", tarfile.CHRTYPE, "")):
            info = tarfile.TarInfo(name)
            info.type, info.linkname, info.uid, info.gid, info.uname, info.devmajor = kind, link, 7, 8, "someone", 5 if name == "dev" else 0
            info.size = len(big) if name == "p.png" else 0
            t.addfile(info, io.BytesIO(big))
    return out.getvalue()


def test_devices_and_owners_of_a_tar_stay(spark):
    [row] = optimize(spark.createDataFrame([("/r/s.tar", bytearray(special_tar()))], "path string, content binary")).collect()
    assert row.changed and row.error is None and row.target == "/r/s.tar"
    told = lambda raw: [(i.name, i.type, i.linkname, i.uid, i.gid, i.uname, i.devmajor) for i in tarfile.open(fileobj=io.BytesIO(raw))]
    assert told(bytes(row.data)) == told(special_tar())


def test_containers_are_converted(spark):
    inner = tarred([("p.png", png()), ("t.txt", b"text")])
    hard = io.BytesIO()
    with tarfile.open(fileobj=hard, mode="w") as t:
        for name, kind in (("p.png", tarfile.REGTYPE), ("again.png", tarfile.LNKTYPE)):
            info = tarfile.TarInfo(name)
            info.type, info.linkname, info.size = kind, "" if kind == tarfile.REGTYPE else "p.png", len(png()) if kind == tarfile.REGTYPE else 0
            t.addfile(info, io.BytesIO(png()))
    items = [("/r/o.zip", zipped([("in.tar", inner), ("t", b"t")])), ("/r/book.cbt", inner), ("/r/s.tar", special_tar()), ("/r/h.tar", hard.getvalue()), ("/r/a.tar", tarred([("t", b"t")]))]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in items], "path string, content binary")
    rows = {r.path: r for r in optimize(df, convert_to=["ZIP", "CBZ"]).collect()}
    assert {p: r.target for p, r in rows.items()} == {"/r/o.zip": "/r/o.zip", "/r/book.cbt": "/r/book.cbz", "/r/s.tar": "/r/s.tar", "/r/h.tar": "/r/h.zip", "/r/a.tar": "/r/a.zip"}
    assert {p: r.kind for p, r in rows.items()} == {"/r/o.zip": "saved", "/r/book.cbt": "converted", "/r/s.tar": "error", "/r/h.tar": "converted", "/r/a.tar": "converted"}
    assert rows["/r/s.tar"].data is None and "pipe" in rows["/r/s.tar"].error
    members = {m[0]: m[7] for m in archives.zip_members(bytes(rows["/r/o.zip"].data))}
    assert sorted(members) == ["in.zip", "t"]
    deep = {m[0]: m[7] for m in archives.zip_members(members["in.zip"])}
    assert deep["t.txt"] == b"text" and pixels(deep["p.png"]) == pixels(png()) and deep["link"] == b"target"
    twice = {m[0]: m[7] for m in archives.zip_members(bytes(rows["/r/h.tar"].data))}
    assert twice["p.png"] == twice["again.png"] and pixels(twice["p.png"]) == pixels(png())
    dry = optimize(df, convert_to=["ZIP", "CBZ"], dry_run=True).collect()
    assert {r.kind for r in dry} == {"dry_run", "error"} and not any(r.changed or r.data for r in dry)
    assert {r.path: r.bytes_out for r in dry} == {p: r.bytes_out for p, r in rows.items()}


def test_lossy_files_of_formats_that_may_be_lossless_are_left_alone(spark):
    def webp(kind):
        body = b"WEBP" + kind + struct.pack("<I", 4) + b"data"
        return b"RIFF" + struct.pack("<I", len(body)) + body

    df = spark.createDataFrame([("/r/a.webp", bytearray(webp(b"VP8L"))), ("/r/b.webp", bytearray(webp(b"VP8 ")))], "path string, content binary")
    assert {r.path: r.kind for r in optimize(df, codecs={"WEBP": lambda raw: raw[:-2]}).collect()} == {"/r/a.webp": "saved", "/r/b.webp": "lost"}


def test_a_folder_run_twice_does_nothing_the_second_time(spark, tmp_path):
    root = tmp_path / "in"
    for folder in ("good", "bad", ".hidden", "text"):
        (root / folder).mkdir(parents=True)
        (root / folder / "a.png").write_bytes(png())
    (root / "bad" / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    (root / "good" / "c.tar").write_bytes(tarred([("t", b"t")]))
    layers = spark.createDataFrame([(str(root / "text"), "formats", "GIF, SVG")], "path string, option string, value string")
    run = lambda **k: optimize_folder(spark, str(root), layers=layers, convert_to=["ZIP"], **k)
    name = lambda p: os.path.relpath(p, root)
    told, stamps = run(dry_run=True)
    assert {r.kind for r in told.collect()} == {"dry_run", "error"} and stamps.isEmpty() and (root / "good" / "a.png").read_bytes() == png()
    told, stamps = run()
    assert {name(r.path): (r.kind, r.status) for r in told.collect()} == {
        "good/a.png": ("saved", "written"), "good/c.tar": ("converted", "written"), "bad/a.png": ("saved", "written"), "bad/broken.png": ("error", None)
    }
    assert {name(r.path) for r in stamps.collect()} == {"good", "bad/a.png"}
    assert sorted(os.listdir(root / "good")) == ["a.png", "c.zip"] and (root / ".hidden" / "a.png").read_bytes() == png() == (root / "text" / "a.png").read_bytes()
    told, stamps = run(known=stamps)
    assert [name(r.path) for r in told.collect()] == ["bad/broken.png"] and {name(r.path) for r in stamps.collect()} == {"good", "bad/a.png"}
    os.utime(root / "good" / "a.png", (4e9, 4e9))
    assert sorted(name(r.path) for r in run(known=stamps)[0].collect()) == ["bad/broken.png", "good/a.png"]


def test_another_file_with_the_targets_name_stays(spark, tmp_path):
    (tmp_path / "a.tar").write_bytes(b"old")
    (tmp_path / "a.zip").write_bytes(b"other")
    row = (str(tmp_path / "a.tar"), str(tmp_path / "a.zip"), b"new", hashlib.sha256(b"old").hexdigest())
    df = spark.createDataFrame([row], "path string, target string, data binary, scanned string")
    assert replace_files(df).first().status == "exists" and (tmp_path / "a.zip").read_bytes() == b"other" and (tmp_path / "a.tar").exists()


def test_what_cannot_be_read_is_told(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x")
    rows = {r.path: r for r in files.with_content(spark.createDataFrame([(str(tmp_path / n),) for n in "ab"], "path string")).collect()}
    assert rows[str(tmp_path / "a")].content == b"x" and rows[str(tmp_path / "a")].error is None
    assert rows[str(tmp_path / "b")].content is None and "No such file" in rows[str(tmp_path / "b")].error


def stamped_zip(stamps, members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, year in (("in/.siltworks_stamps.yaml", stamps, 2000), *members):
            z.writestr(zipfile.ZipInfo(name, (year, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def test_stamp_files_in_archives(spark):
    old = stamped_zip(b"config: {x: 1}\na.png: 1200000000\n'./sub/': 1300000000.5\n", [("in/a.png", png(), 2005), ("in/b.png", png(), 2005), ("in/sub/c.png", png(), 2005), ("in/sub/d.png", png(), 2015), ("a.png", png(), 2005)])
    idle = stamped_zip(b".: 1300000000\n", [("in/a.png", png(), 2005)])
    df = spark.createDataFrame([("/r/o.zip", bytearray(old)), ("/r/i.zip", bytearray(idle))], "path string, content binary")
    rows = {r.path: r for r in optimize(df).collect()}
    held = {m[0]: m[7] for m in archives.zip_members(bytes(rows["/r/o.zip"].data))}
    assert {n: d == png() for n, d in held.items()} == {"in/a.png": True, "in/b.png": False, "in/sub/c.png": True, "in/sub/d.png": False, "a.png": False}
    assert [m[0] for m in archives.zip_members(bytes(rows["/r/i.zip"].data))] == ["in/a.png"]


def test_failures_end_the_run_or_leave_the_outermost_container(spark):
    inner = zipped([("bad.png", b"\x89PNG\r\n\x1a\nxx"), ("good.png", png())])
    items = [("/r/o.zip", zipped([("in.zip", inner), ("p.png", png())])), ("/r/ok.zip", zipped([("p.png", png())])), ("/r/bad.png", b"\x89PNG\r\n\x1a\nxx")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in items], "path string, content binary")
    told = lambda **k: {r.path: (r.changed, r.kind) for r in optimize(df, **k).collect()}
    assert told() == {"/r/o.zip": (True, "error"), "/r/ok.zip": (True, "saved"), "/r/bad.png": (False, "error")}
    assert told(fail_fast_container=True) == {"/r/o.zip": (False, "error"), "/r/ok.zip": (True, "saved"), "/r/bad.png": (False, "error")}
    with pytest.raises(RuntimeError, match="/r/o.zip"):
        optimize(df, fail_fast=True)
    assert optimize(df.where("path != '/r/o.zip'"), fail_fast=True).count() == 2


def test_marker_files_stamp_their_folders(spark, tmp_path):
    root = tmp_path / "in"
    for folder in ("new", "old", ".hidden"):
        (root / folder).mkdir(parents=True)
        (root / folder / "a.png").write_bytes(png())
        os.utime(root / folder / "a.png", (1e9, 1e9))
    (root / "old" / ".siltworks_timestamp").write_bytes(b"")
    told, stamps = optimize_folder(spark, str(root))
    assert [os.path.relpath(r.path, root) for r in told.collect()] == ["new/a.png"]
    (root / "new" / "a.png").write_bytes(png())
    os.utime(root / "new" / "a.png", (1e9, 1e9))
    (tmp_path / ".siltworks_timestamp").write_bytes(b"")
    assert optimize_folder(spark, str(root))[0].isEmpty()


def test_plain_zips_are_those_of_zipfile(monkeypatch):
    rng = random.Random(3)
    for n in (*range(6), 40):
        members = [
            archives.Member(k, None, rng.choice(["a", "é", "x/y.png"]) + str(k), "file", "", rng.choice([None, 0.0, 1e9 + 7 * k]), rng.choice([None, 0, 0o755]), rng.choice([None, 0, 8]), None, rng.choice([None, b"", b"abc" * 99, rng.randbytes(50)]), "")
            for k in range(n)
        ]
        made = archives.pack_zip(members)
        assert archives.plain_zip_members(made) == list(archives.zip_members(made))
        with zipfile.ZipFile(io.BytesIO(made)) as held:
            assert [held.read(i) for i in held.infolist()] == [m.content or b"" for m in members]
        with monkeypatch.context() as m:
            m.setattr(archives, "plain", lambda member: False)
            assert not members or archives.pack_zip(members) == made
            m.setattr(archives, "plain_zip_members", lambda raw: None)
            slow = list(archives.zip_members(made))
        assert archives.plain_zip_members(made) == slow
        for _ in range(200):  # broken ones are zipfile's, or mean the same to both
            raw = bytearray(made)
            raw[rng.randrange(len(raw))] = rng.randrange(256)
            got = archives.plain_zip_members(bytes(raw))
            if got is not None:
                with monkeypatch.context() as m:
                    m.setattr(archives, "plain_zip_members", lambda raw: None)
                    assert got == list(archives.zip_members(bytes(raw)))


def test_many_small_archives_take_little_time_each():
    members = [archives.Member(k, None, str(k), "file", "", 0.0, None, None, None, b"", "") for k in range(100)]
    opened = []
    plain, zipfile.ZipFile.__init__ = zipfile.ZipFile.__init__, lambda *a, **k: opened.append(a)
    try:
        assert [m[0] for m in archives.zip_members(archives.pack_zip(members))] == [str(k) for k in range(100)]
    finally:
        zipfile.ZipFile.__init__ = plain
    assert not opened


def test_batches_are_bounded_by_bytes(spark):
    assert [list(s) for s in by_bytes([b"ab", None, b"c", b"def", b""], 3)] == [[b"ab", None, b"c"], [b"def"], [b""]]
    # a picture of a text is twenty times as large: 40 MB in one batch of Spark's
    rows = spark.range(400).select("id", F.repeat(F.lit("x"), 5000).alias("text")).coalesce(1)
    got = rows.select("id", picture("text", F.col("id") % 2 == 1).alias("content")).orderBy("id").collect()
    assert [bytes(r.content) for r in got[:2]] == [gray_png(b"x" * 5001), gray_png(b"x" * 5001, True)] and len(got) == 400
    assert {bytes(r.content) for r in got[::2]} == {bytes(got[0].content)} and {bytes(r.content) for r in got[1::2]} == {bytes(got[1].content)}


def test_results_of_tiers_come_in_bounded_batches(spark):
    of = tiers.of_codecs({"TXT": lambda raw: raw})
    sizes = []
    rows = spark.range(60).select(F.col("id").cast("string").alias("item_id"), F.lit("TXT").alias("format"), F.repeat(F.lit("x"), 500_000).cast("binary").alias("content"), F.lit(None).cast("string").alias("settings"))

    # what one function hands on is cut anew by Spark, so its own batches are looked at
    class Items:
        def where(self, *_):
            return self

        select = where

        def mapInPandas(self, run, _):
            part = rows.toPandas()
            sizes.extend(sum(map(len, b["optimized"])) for b in run(iter([part])))
            assert sum(sizes) == 60 * 500_000

    tiers.run_tiers(Items(), of)
    assert len(sizes) > 2 and max(sizes) <= BATCH_BYTES + 500_000


def test_a_batch_of_tiers_may_end_with_the_rows(spark):
    rows = spark.range(2).coalesce(1).select(F.col("id").cast("string").alias("item_id"), F.lit("TXT").alias("format"), F.repeat(F.lit("x"), BATCH_BYTES // 2).cast("binary").alias("content"), F.lit(None).cast("string").alias("settings"))
    got = tiers.run_tiers(rows, tiers.of_codecs({"TXT": lambda raw: raw})).select("item_id", "stages").collect()
    assert sorted((r.item_id, r.stages[0].bytes_out) for r in got) == [("0", BATCH_BYTES // 2), ("1", BATCH_BYTES // 2)]


def test_few_folders_are_listed_by_several_tasks_and_files_are_removed_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"{tmp_path}/r/f{k}/a", bytearray(b"x")) for k in range(8)], "path string, content binary")
    assert files.write_files(rows).count() == 8
    found = scan(spark, [f"{tmp_path}/r"])
    assert found.count() == 8
    # the root's round and that of its listing are a file each
    assert len(found.inputFiles()) > 3
    assert files.remove_files(rows).count() == 8 and files.remove_files(rows).count() == 8
    assert not [f for _, _, f in os.walk(tmp_path / "r") if f]
