"""The scan by rounds, the stamp store, and runs over folders with both."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from siltworks.operators import animated, archives, routing
from siltworks.operators.animated import frame_durations
from siltworks.operators.stamps import NO_CONFIG, fingerprint, member_stamps
from siltworks.plans import folder as runs
from siltworks.plans.folder import optimize_folder
from siltworks.plans.optimize import optimize
from siltworks.sources import scan as scans
from siltworks.sources.folders import Folder
from siltworks.sources.scan import remove_stale, scan
from siltworks.sources.stamp_store import StampStore, configuration
from tests.test_files import png, tarred, zipped
from tests.test_pictures import apng, mpo, pixels, stub

LAYERS = "path string, option string, value string"


def tree(top, *names):
    for name in names:
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(name.encode())


def listed(df, top):
    return sorted(os.path.relpath(r.path, top) for r in df.where("kind = 'file'").collect())


def test_a_scan_by_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scans, "BATCH", 2)
    top = tmp_path / "in"
    tree(top, "a", "_b", ".c", "d/e", "d/f/g", "d/f/h/i", "no/j", "no/deep/k", "left.siltworks-tmp", "old.siltworks-tmp/x")
    os.symlink(top, top / "d" / "loop")
    os.symlink(top / "d", top / "z")
    os.symlink(top / "a", top / "link")
    os.symlink(top / "gone", top / "broken")
    os.mkfifo(top / "pipe")
    # nothing may be listed where the driver is
    monkeypatch.setattr(os, "scandir", lambda *a: 1 / 0)
    layers = spark.createDataFrame([(str(top / "no"), "recurse", "False"), (str(top / "no" / "deep"), "recurse", "true"), (str(top / "d" / "f"), "recurse", "odd")], LAYERS)
    found = scan(spark, [str(top)], layers)
    assert listed(found.where("not stale"), top) == [".c", "_b", "a", "d/e", "d/f/g", "d/f/h/i", "link"]
    assert sorted(r.name for r in found.where("stale").collect()) == ["left.siltworks-tmp", "old.siltworks-tmp"]
    told = {r.name: (r.kind, r.is_symlink) for r in found.collect()}
    assert told["pipe"] == ("other", False) and told["broken"] == ("error", True) and told["link"] == ("file", True)
    assert listed(scan(spark, [str(top)], layers, {"recurse": "true"}, ignore=r"^\.|/\.|^d$", symlinks=False).where("not stale"), top) == [".c", "_b", "a", "no/deep/k", "no/j"]
    assert listed(scan(spark, [str(top)], recurse=False), top) == []
    assert listed(scan(spark, [str(top), str(top / "d"), str(top / "a")], ignore="^no$").where("not stale"), top) == sorted([".c", "_b", "a", "a", "d/e", "d/f/g", "d/f/h/i", "link"])
    monkeypatch.undo()
    assert [r.error for r in remove_stale(found).collect()] == [None, None] and not (top / "old.siltworks-tmp").exists() and not (top / "left.siltworks-tmp").exists()
    assert remove_stale(scan(spark, [str(top)]), 1e9).isEmpty()


def stamps(spark, *rows):
    return spark.createDataFrame([(p, float(t)) for p, t in rows], "path string, ts double")


def held(df):
    return {r.path: r.ts for r in df.collect()}


def test_stamps_outlive_a_run_under_their_configuration(spark, tmp_path):
    store, config = StampStore(spark, str(tmp_path / "store")), configuration({"formats": ["PNG"]})
    assert held(store.load("/r", config)) == {} and store.roots() == []
    assert store.commit("/r", stamps(spark, ("/r/a", 1), ("/r/b/c", 2), ("/r/b", 3)), config) == 1
    assert store.commit("/r", stamps(spark, ("/r/a", 5), ("/r/d", 4)), config) == 2
    assert held(store.load("/r", config)) == {"/r/a": 5, "/r/b": 3, "/r/d": 4}
    # another order or type of a list is no change, an option that isn't recorded is at its default
    assert held(store.load("/r", configuration({"formats": {"PNG"}, "bigger": False}))) == {"/r/a": 5, "/r/b": 3, "/r/d": 4}
    for other in (configuration({"formats": ["GIF"]}), configuration({"formats": ["PNG"]}, "digest"), configuration({"formats": ["PNG"], "recurse": False})):
        assert held(store.load("/r", other)) == {}
    assert len(store.load("/r", None).collect()) == 3
    # a root's stamps count for roots above and below
    assert held(store.load("/r/b/x", config)) == {"/r/b": 3} and held(store.load("/", config))["/r/a"] == 5 and held(store.load("/rr", config)) == {}
    assert store.commit("/r", stamps(spark, ("/r/z", 9)), configuration({})) == 3 and held(store.load("/r", configuration({}))) == {"/r/z": 9}


def test_runs_at_once_never_mix_or_lose_stamps(spark, tmp_path, monkeypatch):
    """Another run commits between the time that one reads the store and the time that it commits."""
    store, config = StampStore(spark, str(tmp_path)), configuration({})
    store.commit("/r", stamps(spark, ("/r/old", 1)), config)
    other, put, seen = StampStore(spark, str(tmp_path)), Folder.put_new, []

    def slow(self, name, text):
        if name.startswith("manifest-") and not seen:
            seen.append(name)
            other.commit("/r", stamps(spark, ("/r/other", 2)), config)
        return put(self, name, text)

    monkeypatch.setattr(Folder, "put_new", slow)
    assert store.commit("/r", stamps(spark, ("/r/mine", 3)), config) == 3
    assert held(store.load("/r", config)) == {"/r/old": 1, "/r/other": 2, "/r/mine": 3}
    at = store._of("/r")
    assert not put(at, "manifest-000000000003.json", "{}") and not [n for n in at.names() if n.endswith(".tmp")]


def test_a_killed_run_leaves_the_old_version_and_its_journal(spark, tmp_path, monkeypatch):
    store, config = StampStore(spark, str(tmp_path)), configuration({})
    store.commit("/r", stamps(spark, ("/r/a", 1)), config)
    store.journal("/r", stamps(spark, ("/r/b", 2)), config)
    store.journal("/r", stamps(spark, ("/r/c", 2)), configuration({"bigger": True}))

    def killed(self, name, text):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(Folder, "put_new", killed)
        store.commit("/r", stamps(spark, ("/r/lost", 5)), config)
    # a manifest that was cut off counts as a number taken, not as a version
    (tmp_path / store._of("/r").path.rsplit("/", 1)[1] / "manifest-000000000002.json").write_text('{"root": "/r", "ver')
    assert held(store.load("/r", config)) == {"/r/a": 1, "/r/b": 2}
    assert store.commit("/r", stamps(spark, ("/r/d", 3)), config) == 3
    names = store._of("/r").names()
    assert held(store.load("/r", config)) == {"/r/a": 1, "/r/b": 2, "/r/d": 3} and sum(n.startswith("j-") for n in names) == 1
    assert held(store.load("/r", configuration({"bigger": True}))) == {"/r/c": 2}
    gone = store.vacuum("/r", keep=1, seconds=-10)
    assert len([n for n in gone if n.startswith("v-")]) == 2 and held(store.load("/r", config)) == {"/r/a": 1, "/r/b": 2, "/r/d": 3}


def test_fingerprints_are_ordered_and_leave_the_root_out(spark):
    def of(rows):
        got = fingerprint(spark.createDataFrame(rows, "root string, path string, text string"), ["root"], spark.createDataFrame([("r",), ("none",), (None,)], "root string"))
        return {r.root: r.fingerprint for r in got.collect()}

    some = [("r", "a/x", "1"), ("r", "b/x", None), (None, "c/x", "3")]
    told = of(some)
    assert told == of([*some[::-1], ("r", "x", "the root's own")]) and told["none"] == NO_CONFIG == hashlib.sha256(b"").hexdigest()
    assert told["r"] == of([("r", "a/x", "1"), ("r", "b/x", "")])["r"] and told[None] not in (NO_CONFIG, told["r"])
    for other in ([("r", "a/x", "1")], [("r", "a/x", ""), ("r", "b/x", "1")], [("r", "a/xb", "1"), ("r", "/x", "")]):
        assert of(other)["r"] not in (told["r"], NO_CONFIG)


def test_journals_inside_archives_are_read(spark):
    text = b"config: {}\na: 1\nwal:\n- b/c: 2.5\n- {d: 3}\n"
    df = spark.createDataFrame([("z", "file", ".siltworks_stamps.yaml", bytearray(text))], "container_id string, kind string, name string, content binary")
    assert {r.path: r.ts for r in member_stamps(df).collect()} == {"/a": 1, "/b/c": 2.5, "/d": 3}


def test_a_run_remembers_by_its_store(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "in", StampStore(spark, str(tmp_path / "store"))
    for name in ("a.png", "sub/b.png", "no/c.png", "sub/s.zip"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(png() if name.endswith("png") else zipped([("m.png", png()), ("n.svg", b"<svg/>")]))
    (root / "left.siltworks-tmp").write_bytes(b"")
    os.utime(root / "left.siltworks-tmp", (1, 1))
    rows = [(str(root / "no"), "recurse", "false"), (str(root / "sub"), "ignore", "b*,x"), (str(root / "sub"), "keep_metadata", "false")]
    layers = spark.createDataFrame(rows, LAYERS)
    name = lambda p: os.path.relpath(p, root)
    run = lambda layers=layers, **k: sorted(name(r.path) for r in optimize_folder(spark, str(root), layers=layers, store=store, **k)[0].collect())
    assert run() == ["a.png", "sub/s.zip"] and (root / "no" / "c.png").read_bytes() == png() and not (root / "left.siltworks-tmp").exists()
    # a member follows the settings of its container's folder
    member = {m[0]: m[7] for m in archives.zip_members((root / "sub" / "s.zip").read_bytes())}["m.png"]
    assert b"note" not in member and pixels(member) == pixels(png()) and b"note" in (root / "a.png").read_bytes()
    # what lies below has other settings now, so the stamps are void
    assert run(spark.createDataFrame([*rows[:1], (str(root / "sub"), "ignore", "x")], LAYERS), dry_run=True) == ["a.png", "sub/b.png", "sub/s.zip"]
    # a run that ends after it has replaced files has told the journal
    (root / "new.png").write_bytes(png())
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(StampStore, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError()))
        optimize_folder(spark, str(root), layers=layers, store=store)
    (root / "new.png").write_bytes(png())
    os.utime(root / "new.png", (1e9, 1e9))
    assert run() == []
    assert run(spark.createDataFrame([*rows, (str(root), "timestamps", "false")], LAYERS), dry_run=True) == ["a.png", "new.png", "sub/s.zip"]


def test_settings_of_folders_hold_for_members(spark):
    told = {"formats": "ZIP", "bigger": "true"}
    inner = zipped([("p.png", png()), ("t.tar", tarred([("x", b"y")]))])
    items = [("/r/a.zip", bytearray(inner), {"formats": "zip, png"}), ("/r/b.zip", bytearray(inner), told), ("/r/c.png", bytearray(png()), told), ("/r/d.tar", bytearray(tarred([("x", b"1")])), {"convert_to": "zip"}), ("/r/e.tar", bytearray(tarred([("x", b"1")])), {})]
    df = spark.createDataFrame(items, "path string, content binary, settings map<string,string>")
    rows = {r.path: r for r in optimize(df).collect()}
    assert {p: (r.target, r.changed) for p, r in rows.items()} == {"/r/a.zip": ("/r/a.zip", True), "/r/b.zip": ("/r/b.zip", False), "/r/d.tar": ("/r/d.zip", True), "/r/e.tar": ("/r/e.tar", False)}


def test_animated_pictures_are_containers_of_frames(spark):
    raw, broken = apng(), apng()[:-70]
    items = [("/r/a.png", bytearray(raw)), ("/r/z.zip", bytearray(zipped([("in.png", apng(hidden=True))]))), ("/r/cut.png", bytearray(broken))]
    rows = {r.path: r for r in optimize(spark.createDataFrame(items, "path string, content binary")).collect()}
    frames = lambda data: [(m[0], pixels(m[-1])) for m in animated.apng_members(data) if m[2] == "file"]
    assert rows["/r/a.png"].kind == "saved" and rows["/r/a.png"].format == "APNG" and frames(bytes(rows["/r/a.png"].data)) == frames(raw)
    inner = archives.zip_members(bytes(rows["/r/z.zip"].data))
    assert [frames(m[7]) for m in inner] == [frames(apng(hidden=True))]
    assert rows["/r/cut.png"].kind == "error" and rows["/r/cut.png"].data is None


def test_durations_go_to_frames_by_position(spark):
    rows = [("a", 1, None), ("a", 2, 100.0), ("a", 3, 300.0), ("b", 1, None), ("c", 1, 0.2), ("c", 2, 7.9)]
    got = frame_durations(spark.createDataFrame(rows, "container_id string, frame int, duration double"))
    assert sorted((r.container_id, r.frame, r.ms) for r in got.collect()) == [("a", 1, 100), ("a", 2, 300), ("a", 3, 200), ("b", 1, None), ("c", 1, 1), ("c", 2, 7)]
    told = archives.unpack(spark.createDataFrame([("p", "APNG", bytearray(apng(hidden=True)))], "item_id string, format string, content binary"))
    assert [(r.frame, r.duration) for r in animated.frames(told).orderBy("frame").collect()] == [(0, None), (1, 100), (2, 30), (3, 0)]


def test_tools_come_of_the_table(spark, tmp_path, monkeypatch):
    """Programs that stand in for the real ones: one that works, one that fails; which are at hand is asked anew."""
    from siltworks.operators import codecs

    stub(tmp_path, "gifsicle", "sys.stdout.buffer.write(sys.stdin.buffer.read()[:-1] + b';' if sys.argv[1] == '--optimize=3' else b'')")
    stub(tmp_path, "svgo", "sys.stderr.write('no good'); sys.exit(2)")
    monkeypatch.setenv("PATH", f"{tmp_path}{os.pathsep}{os.environ['PATH']}")
    rows = [(*t, codecs.probe(t[3], t[4])) for t in codecs.TOOLS]
    monkeypatch.setitem(codecs._found, spark.sparkContext.applicationId, rows)
    # workers take the driver's PATH when they begin; programs are named in full so that older ones find them too
    from siltworks.operators import tiers

    for tool in ("gifsicle", "svgo"):
        whole = tiers.STAGES[tool]
        monkeypatch.setitem(tiers.STAGES, tool, tiers.Stage(lambda raw, o, w=whole, t=tool: __import__("siltworks.operators.programs", fromlist=["x"]).run_program((str(tmp_path / t), "--optimize=3"), raw)))
    from tests.test_pictures import gif

    long = gif() + b"trailing"
    items = [("/r/a.gif", bytearray(long)), ("/r/b.svg", bytearray(b"<svg/>")), ("/r/c.png", bytearray(png())), ("/r/d.png", bytearray(png()[:-20]))]
    df = spark.createDataFrame(items, "path string, content binary")
    got = {r.path: r for r in optimize(df).collect()}
    assert got["/r/c.png"].kind == "saved" and [s.tool for s in got["/r/c.png"].stages] == ["redeflate"] and got["/r/c.png"].stages[0].bytes_in == len(png())
    assert got["/r/b.svg"].kind == "error" and "retcode: 2" in got["/r/b.svg"].error and "no good" in got["/r/b.svg"].error
    assert got["/r/d.png"].error.startswith("PNG: ") and got["/r/d.png"].stages == []
    assert [s.tool for s in got["/r/a.gif"].stages] == ["gifsicle"]
    off = {r.path: r for r in optimize(df, disabled=["redeflate", "svgo"]).collect()}
    assert off["/r/c.png"].kind == "lost" and off["/r/b.svg"].error is None
    text = df.limit(1).select(runs.error_text(F.lit("x"), F.lit("retcode: 2\n\tstderr: y")).alias("t")).first().t
    assert text == "x\n\n\tretcode: 2\n\tstderr: y"


def test_an_mpo_becomes_a_jpeg_where_that_is_asked_for(spark):
    raw, _ = mpo()
    df = spark.createDataFrame([("/r/a.mpo", bytearray(raw)), ("/r/z.zip", bytearray(zipped([("b.mpo", raw)])))], "path string, content binary")
    rows = {r.path: r for r in optimize(df, convert_to=["JPEG"]).collect()}
    assert rows["/r/a.mpo"].target == "/r/a.jpeg" and rows["/r/a.mpo"].kind == "converted" and b"Exif" in bytes(rows["/r/a.mpo"].data)
    assert [m[0] for m in archives.zip_members(bytes(rows["/r/z.zip"].data))] == ["b.jpeg"]
    assert {r.kind for r in optimize(df).collect()} == {"lost"}


def test_routes_merge_by_order(spark):
    plugins = {
        "one": [("NEW", True, False, False, "First", "native", 0, "NEW", False, None), ("NEW", True, False, False, "ToWEBP", "convert", 0, "WEBP", False, None), ("NEW", True, False, False, "ToPNG", "convert", 1, "PNG", False, None)],
        "two": [("NEW", True, False, False, "Last", "native", 0, "NEW", False, None), ("NEW", True, False, False, "ToPNG", "convert", 0, "PNG", False, None), ("NEW", True, False, False, "ToJXL", "convert", 1, "JXL", False, "use_jxl"), ("NEW", True, False, False, "ToGIF", "convert", 2, "GIF", False, None)],
    }
    of = lambda **k: [(r.handler, r.role, r.pos) for r in routing.routes(spark, plugins, **k).where("format = 'NEW'").orderBy("role", "pos").collect()]
    assert of() == [("ToWEBP", "convert", 0), ("ToPNG", "convert", 1), ("ToGIF", "convert", 2), ("Last", "native", 0)]
    assert of(enabled=["use_jxl"])[2:4] == [("ToJXL", "convert", 2), ("ToGIF", "convert", 3)]
    got = {r.out_format: r.sources for r in routing.convert_sources(routing.routes(spark, plugins), ["PNG", "ZIP", "CBZ"]).collect()}
    assert got["ZIP"] == ["7Z", "RAR", "TAR", "TBZ", "TGZ", "TXZ"] and got["CBZ"] == ["CB7", "CBR", "CBT"] and {"NEW", "GIF", "BMP"} <= set(got["PNG"]) and "PNG" not in got["PNG"]


def test_manifests_tell_all(spark, tmp_path):
    store, config = StampStore(spark, str(tmp_path)), configuration({})
    store.commit("/r", stamps(spark, ("/r/a", 1)), config)
    [name] = [n for n in store._of("/r").names() if n.startswith("manifest")]
    told = json.loads(store._of("/r").text(name))
    assert told["root"] == "/r" and told["config"] == config and told["merged"] == [] and store.roots() == ["/r"]
