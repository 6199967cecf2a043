"""JPEG segments, MPOs, TIFF directories, verification, programs and tiers, without Spark."""

import os
import struct
import subprocess
import sys
import time
import zlib

import pytest

from siltworks.functions.jpeg import directory, is_mpo, pictures, primary_picture, segments, tiff_compression, tiff_is_lossless
from siltworks.functions.verify import UnreadableImage, verify
from siltworks.operators import animated
from siltworks.operators.codecs import redeflate_png
from siltworks.operators.programs import ProgramError, run_program
from siltworks.operators.tiers import STAGES, MadeNothing, Stage, fold, pipelines, program
from siltworks.sources.files import case_sensitive
from tests.test_files import pixels, png

EXIF, XMP = b"Exif\0\0II*\0data", b"http://ns.adobe.com/xap/1.0/\0<x/>"


def segment(marker, body):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body


def jpeg(*more, data=b"scan"):
    frame = segment(0xC0, struct.pack(">BHHB", 8, 1, 1, 1) + b"\1\x11\0")
    return b"\xff\xd8" + b"".join(more) + frame + segment(0xDA, b"\1\1\0\0\x3f\0") + data + b"\xff\xd9"


def mpo(order=">", primary=0, kinds=(0x030000, 0x020002), cut=0):
    """Two pictures; ``primary`` says which is of the first kind."""
    second = jpeg(data=b"the second one")
    kinds = kinds if primary == 0 else kinds[::-1]

    def first(sizes, offset):
        entries = b"".join(struct.pack(order + "IIIHH", k, s, o, 0, 0) for k, s, o in zip(kinds, sizes, (0, offset)))
        mark = b"MM\0*" if order == ">" else b"II*\0"
        told = mark + struct.pack(order + "IHHHI4s", 8, 2, 0xB000, 7, 4, b"0100") + struct.pack(order + "HHII", 0xB002, 7, 32, 38) + struct.pack(order + "I", 0)
        return jpeg(segment(0xE1, EXIF), segment(0xE1, XMP), segment(0xE2, b"MPF\0" + told + entries))

    size = len(first((0, 0), 0))
    base = first((0, 0), 0).index(b"MPF\0") + 4
    whole = first((size, len(second)), size - base) + second
    return whole[: len(whole) - cut], second


@pytest.mark.parametrize("order", [">", "<"])
def test_the_primary_picture_of_an_mpo(order):
    raw, second = mpo(order)
    assert is_mpo(raw) and [s for *_, s in pictures(raw)][1] == len(second)
    out = primary_picture(raw)
    assert not is_mpo(out) and EXIF in out and XMP in out and b"the second one" not in out and b"MPF" not in out
    verify(out, "JPEG")
    raw, second = mpo(order, primary=1)
    out = primary_picture(raw)
    assert b"the second one" in out and EXIF in out and XMP in out and not is_mpo(out)
    assert [m for m, _, _ in segments(out)][:2] == [0xE1, 0xE1]


def test_mpos_that_are_not_whole():
    with pytest.raises(ValueError, match="cut off"):
        primary_picture(mpo(primary=1, cut=5)[0])
    with pytest.raises(ValueError, match="without a primary"):
        primary_picture(mpo(kinds=(0x020002, 0x020002))[0])
    assert not is_mpo(jpeg()) and pictures(jpeg()) == [] and not is_mpo(None) and not is_mpo(b"\xff\xd8\xff\xe2")


def tiff(order, compression, kind=3):
    value = struct.pack(order + ("HH" if kind == 3 else "I"), *((compression, 0) if kind == 3 else (compression,)))
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IH", 8, 2) + struct.pack(order + "HHII", 256, 4, 1, 7) + struct.pack(order + "HHI", 259, kind, 1) + value + bytes(4)


@pytest.mark.parametrize("order", [">", "<"])
def test_tiff_directories(order):
    assert {tiff_compression(tiff(order, c)): tiff_is_lossless(tiff(order, c)) for c in (1, 5, 7, 8, 32773, 9)} == {
        "raw": True, "tiff_lzw": True, "jpeg": False, "tiff_adobe_deflate": True, "packbits": True, "unknown": False
    }
    assert directory(tiff(order, 5))[256] == struct.pack(">I", 7)
    assert tiff_is_lossless(tiff(order, 5)[:20]) is False and tiff_is_lossless(b"GIF") is None and tiff_is_lossless(None) is None
    long = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IH", 8, 1) + struct.pack(order + "HHII", 1, 3, 3, 26) + bytes(4) + struct.pack(order + "HHH", 1, 2, 3)
    assert directory(long)[1] == struct.pack(">HHH", 1, 2, 3)
    with pytest.raises(ValueError, match="outside"):
        directory(long[:-1])


def gif(blocks=b"\x21\xf9\x04\0\0\0\0\0\x2c\0\0\0\0\1\0\1\0\0\2\2\x44\1\0"):
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + blocks + b"\x3b"


def bmp(depth=24, width=1, start=54):
    return b"BM" + struct.pack("<IHHI", 58, 0, 0, start) + struct.pack("<IiiHHIIIIII", 40, width, 1, 1, depth, 0, 4, 0, 0, 0, 0) + bytes(4)


def test_whole_pictures_pass_and_corrupt_ones_are_errors_of_their_kind():
    fine = {"PNG": png(), "GIF": gif(), "JPEG": jpeg(), "BMP": bmp()}
    for kind, raw in fine.items():
        verify(raw, kind)
    flipped = bytearray(png())
    flipped[60] ^= 1
    bad = [
        ("PNG", bytes(flipped)), ("PNG", png()[:-5]), ("PNG", png()[:-12]), ("PNG", png()[:33] + png()[-12:]), ("GIF", gif()[:-1]), ("GIF", gif(b"")),
        ("GIF", gif(b"\x55")), ("JPEG", jpeg()[:20]), ("JPEG", b"\xff\xd8" + segment(0xDA, b"x")), ("BMP", bmp(0)), ("BMP", bmp(width=0)), ("BMP", bmp()[:20]), ("BMP", bmp(start=900)),
        ("WEBP", b"RIFF\xff\0\0\0WEBPVP8L"),
    ]
    for kind, raw in bad:
        with pytest.raises(UnreadableImage, match=kind):
            verify(raw, kind)
    verify(b"anything", "SVG")
    verify(b"anything", None)


def stub(folder, name, body):
    path = folder / name
    path.write_text(f"#!{sys.executable}\nimport sys, os, time\n{body}\n")
    path.chmod(0o755)
    return str(path)


def leftovers():
    import glob
    import tempfile

    return set(glob.glob(f"{tempfile.gettempdir()}/program-*"))


def test_programs_get_bytes_and_leave_nothing(tmp_path):
    before = leftovers()
    turned = stub(tmp_path, "turned", "sys.stdout.buffer.write(sys.stdin.buffer.read()[::-1])")
    by_file = stub(tmp_path, "by_file", "open(sys.argv[2], 'wb').write(open(sys.argv[1], 'rb').read() * 2)")
    assert run_program((turned,), b"abc" * 100_000) == b"cba" * 100_000
    assert run_program((by_file, "{in}", "{out}"), b"abc") == b"abcabc"
    for bad in ((), (turned, ""), (turned, None)):
        with pytest.raises(ValueError, match="empty argument"):
            run_program(bad, b"")
    failing = stub(tmp_path, "failing", "print('said'); sys.stderr.write('went wrong'); sys.exit(3)")
    with pytest.raises(ProgramError) as told:
        run_program((failing, "--x", "{in}"), b"")
    assert told.value.code == 3 and "retcode: 3" in str(told.value) and "went wrong" in str(told.value) and "stdout: said" in str(told.value) and "--x" in str(told.value)
    silent = stub(tmp_path, "silent", "pass")
    with pytest.raises(ProgramError, match="no output file"):
        run_program((silent, "{out}"), b"")
    assert leftovers() == before


def test_a_program_that_hangs_is_ended_with_its_children(tmp_path):
    before = leftovers()
    mark = tmp_path / "child"
    hanging = stub(tmp_path, "hanging", f"import subprocess\np = subprocess.Popen(['sleep', '300'])\nopen({str(mark)!r}, 'w').write(str(p.pid))\nsys.stderr.write('begun'); sys.stderr.flush(); time.sleep(300)")
    began = time.time()
    with pytest.raises(ProgramError, match="stopped after 2 s") as told:
        run_program((hanging, "{in}"), b"", timeout=2)
    assert time.time() - began < 60 and told.value.code is None and "begun" in str(told.value) and leftovers() == before
    child = int(mark.read_text())
    for _ in range(50):
        state = subprocess.run(["ps", "-o", "stat=", "-p", str(child)], capture_output=True, text=True).stdout.strip()
        if not state or state.startswith("Z"):
            break
        time.sleep(0.1)
    assert not state or state.startswith("Z")


def test_a_fold_passes_the_smaller_on():
    half, twice = Stage(lambda raw, o: raw[: len(raw) // 2]), Stage(lambda raw, o: raw * 2)
    never = Stage(lambda raw, o: 1 / 0, takes=lambda raw: False)
    out, told = fold(b"x" * 80, [("twice", twice), ("half", half), ("never", never), ("half", half)], {})
    assert len(out) == 20 and told == [("twice", 80, 160), ("half", 80, 40), ("never", 40, 40), ("half", 40, 20)]
    with pytest.raises(ValueError, match="made nothing"):
        fold(b"x", [("none", Stage(lambda raw, o: b""))], {})


def test_nothing_stays_nothing_and_what_became_nothing_is_told():
    half, none = Stage(lambda raw, o: raw[: len(raw) // 2]), Stage(lambda raw, o: b"")
    assert fold(b"", [("half", half), ("none", none)], {}) == (b"", [("half", 0, 0), ("none", 0, 0)])
    with pytest.raises(MadeNothing) as told:
        fold(b"xxxx", [("half", half), ("none", none), ("half", half)], {})
    assert told.value.told == [("half", 4, 2), ("none", 2, 0)]


def test_programs_get_the_arguments_of_their_settings(tmp_path, monkeypatch):
    stub(tmp_path, "echo_args", "sys.stdout.write(' '.join(sys.argv[1:]))")
    monkeypatch.setenv("PATH", f"{tmp_path}{os.pathsep}{os.environ['PATH']}")
    stage = program("echo_args", "-o", meta=(("-k1",), ("-k0",)), more={"near_lossless": ("-n",)}, last=("end",))
    assert stage.run(b"", {}) == b"-o -k1 end" and stage.run(b"", {"keep_metadata": "false", "near_lossless": "True"}) == b"-o -k0 -n end"
    assert STAGES["pngout"].takes(png()) and not STAGES["pngout"].takes(png()[:24] + b"\x10" + png()[25:]) and not STAGES["pngout"].takes(b"GIF")


def test_pipelines_come_of_the_table_of_tools():
    row = lambda handler, tier, tool: {"handler": handler, "tier": tier, "tool": tool}
    got = pipelines([row("Png", 1, "pngout"), row("Png", 0, "redeflate"), row("Gif", 0, "PIL"), row("Svg", 0, "svgo")], ["Png", "Gif"])
    assert {k: [t for t, _ in v] for k, v in got.items()} == {"PNG": ["redeflate", "pngout"], "PNGFRAME": ["redeflate"]}


def apng(durations=((1, 10), (3, 100), (0, 0)), hidden=False, text=b"note"):
    rows = lambda n: zlib.compress(b"".join(b"\0" + bytes((x * y + n) % 7 for x in range(16)) for y in range(8)), 0)
    c, out, number = animated.chunk, [animated.MAGIC], 0
    out += [c(b"IHDR", struct.pack(">IIBBBBB", 16, 8, 8, 0, 0, 0, 0)), c(b"acTL", struct.pack(">II", len(durations), 5)), c(b"tEXt", text)]
    if hidden:
        out.append(c(b"IDAT", rows(99)))
    for n, (num, den) in enumerate(durations):
        out.append(c(b"fcTL", struct.pack(">IIIIIHHBB", number, 16, 8, 0, 0, num, den, n % 3, n % 2)))
        number += 1
        if n == 0 and not hidden:
            out += [c(b"IDAT", rows(n)[:40]), c(b"IDAT", rows(n)[40:])]
        else:
            out.append(c(b"fdAT", struct.pack(">I", number) + rows(n)))
            number += 1
    return b"".join([*out, c(b"tIME", bytes(7)), c(b"IEND", b"")])


class Member:
    def __init__(self, row):
        self.header, self.name, self.kind, *_, self.content = row


@pytest.mark.parametrize("hidden", [False, True])
def test_frames_come_back_with_pixels_and_timing(hidden):
    raw = apng(hidden=hidden)
    members = [Member(m) for m in animated.apng_members(raw)]
    for m in members:
        if m.kind == "file":
            verify(m.content, "PNGFRAME")
            m.content = redeflate_png(m.content)
    out = animated.pack_apng(reversed(members))
    verify(out, "APNG")
    assert len(out) < len(raw) and b"note" in out and b"tIME" in out
    back = [Member(m) for m in animated.apng_members(out)]
    assert [(a.header, a.name, a.kind) for a in back] == [(m.header, m.name, m.kind) for m in members]
    assert [pixels(a.content) for a in back if a.kind == "file"] == [pixels(m.content) for m in members if m.kind == "file"]
    assert animated.pack_apng(back) == out


def test_frames_that_do_not_fit_are_errors():
    members = [Member(m) for m in animated.apng_members(apng())]
    members[2].content = png(16, 8)[:24] + b"\4" + png(16, 8)[25:]
    with pytest.raises(ValueError, match="frame 2 doesn't fit"):
        animated.pack_apng(members)
    with pytest.raises(ValueError, match="no frames"):
        animated.pack_apng(members[:1])
    with pytest.raises(ValueError, match="no animated"):
        list(animated.apng_members(png()))
    with pytest.raises(ValueError, match="cut off"):
        list(animated.apng_members(apng()[:90]))


def test_case_is_told_by_the_folder_itself(tmp_path, monkeypatch):
    folder = tmp_path / "Folder"
    folder.mkdir()
    assert case_sensitive(str(folder)) and case_sensitive(f"{folder}/") and case_sensitive("/")
    (tmp_path / "fOLDER").mkdir()
    assert case_sensitive(str(folder))
    # a file system on which both names lead to one folder
    monkeypatch.setattr(os.path, "samefile", lambda a, b: True)
    assert not case_sensitive(str(folder)) and os.listdir(folder) == []


def test_wide_rows_are_staged_in_batches_bounded_by_bytes(spark):
    import pyarrow as pa

    from siltworks.sources.staging import MOST, stage

    def sizes(batches):
        for part in batches:
            yield pa.record_batch([[part.num_rows]], names=["n"])

    before = spark.conf.get(MOST)
    rows = [r.n for r in stage(spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 10000) AS x").mapInArrow(sizes, "n long")).collect()]
    assert sum(rows) == 3000 and max(rows) <= 900
    assert spark.conf.get(MOST) == before
