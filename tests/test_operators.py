import random

from pyspark.sql import functions as F

from siltworks.operators import reports, routing, settings, skip, stamps


def test_routes_and_tools(spark):
    items = [("a", "GIF", True, True, False, True), ("b", "GIF", True, False, False, True), ("c", "WEBP", False, False, False, True), ("d", "RAR", True, False, True, True), ("e", "PNG", True, False, False, False), ("f", "TIFF", True, False, False, True)]
    df = spark.createDataFrame(items, "item_id string, format string, lossless boolean, animated boolean, archive boolean, convert boolean")
    pick = lambda **k: {r.item_id: (r.handler, r.role) for r in routing.pick_handlers(df, routing.routes(spark), ["PNG", "WEBP", "ZIP"], **k).collect()}
    assert pick() == {"a": ("ToPNG", "convert"), "b": ("ToPNG", "convert"), "d": ("Rar", "native"), "e": ("Png", "native"), "f": ("ToWEBP", "convert")}
    assert pick(repack=True) == {"d": ("ToZIP", "convert")}
    tools = spark.createDataFrame([("H", 0, 0, "x", True, False), ("H", 0, 1, "y", True, True), ("H", 1, 0, "z", False, False), ("G", 0, 0, "w", True, False)], "handler string, tier int, alt int, tool string, required boolean, available boolean")
    assert [r.tool for r in routing.pick_tools(tools).collect()] == ["y"] and routing.pick_tools(tools, ["y"]).count() == 0
    assert {r.handler: r.ready for r in routing.ready_handlers(tools).collect()} == {"H": True, "G": False}


def test_skips(spark):
    df = spark.createDataFrame([("x/a.png", False), ("x/.b", False), (".siltworks.yaml", False), ("x/c.siltworks-tmp", False), ("l", True)], "path string, is_symlink boolean")
    assert [r.path for r in skip.skip_items(df, r"/\.", symlinks=False).collect()] == ["x/a.png"]
    one = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (1.0, None)], "m double, s double")
    assert [r[0] for r in one.select(skip.changed(F.col("m"), F.col("s"))).collect()] == [False, True, True]
    assert [r[0] for r in one.select(skip.changed(F.col("m"), F.col("s"), after=1.5)).collect()] == [False, True, False]


def test_stamps_by_component(spark):
    rng = random.Random(1)
    paths = sorted({"/" + "/".join(rng.choice(["a", "ab", "b"]) for _ in range(rng.randint(1, 5))) for _ in range(60)})
    known = [(p, float(rng.randint(1, 9))) for p in paths[::3]]
    above = lambda p: ["/" + "/".join(p[1:].split("/")[:n]) for n in range(1, p.count("/") + 1)]
    items = spark.createDataFrame([(p, p) for p in paths], "item_id string, path string")
    table = spark.createDataFrame(known, "path string, ts double")
    got = {r.item_id: r.stamp for r in stamps.ancestor_stamp(items, table).collect()}
    ts = dict(known)
    assert got == {p: max((ts[a] for a in above(p) if a in ts), default=None) for p in paths}
    kept = {r.path for r in stamps.compact(table).collect()}
    assert kept == {p for p in ts if not any(ts.get(a, 0) >= ts[p] for a in above(p)[:-1])}
    failed = {p: rng.random() < 0.1 for p in paths}
    folders = {r.folder: (r.n_items, r.poisoned) for r in stamps.folder_status(spark.createDataFrame(list(failed.items()), "path string, failed boolean")).collect()}
    want = {}
    for p in paths:
        for a in above(p)[:-1]:
            n, bad = want.get(a, (0, False))
            want[a] = (n + 1, bad or failed[p])
    assert folders == want


def test_nearest_settings(spark):
    folders = spark.createDataFrame([("/a/b/c",), ("/ab",), ("/a",)], "folder string")
    layers = spark.createDataFrame([("/a", "x", "1"), ("/a/b", "x", "2"), ("/a", "y", "3")], "path string, option string, value string")
    got = {(r.folder, r.option): r.value for r in settings.folder_settings(folders, layers, {"y": "9"}).collect()}
    assert got == {("/a/b/c", "x"): "2", ("/a/b/c", "y"): "9", ("/a", "x"): "1", ("/a", "y"): "9"}


def test_reports(spark):
    rows = [("a", 100, 60, False, False), ("b", 100, 100, False, False), ("c", 100, 50, True, False), ("d", 100, 10, False, True), ("e", 0, 0, False, False)]
    df = spark.createDataFrame(rows, "name string, bytes_in long, bytes_out long, converted boolean, error boolean")
    df = df.withColumn("kind", reports.outcome(F.col("bytes_in"), F.col("bytes_out"), F.col("converted"), F.col("error"), F.lit(False)))
    assert [r.kind for r in df.collect()] == ["saved", "lost", "converted", "error", "lost"]
    sums = {r.kind: (r.n_items, r.bytes_in, r.bytes_out) for r in reports.summary(df).collect()}
    assert sums == {"saved": (1, 100, 60), "lost": (2, 100, 100), "converted": (1, 100, 50), "error": (1, 100, 10)}
    assert reports.total_text(reports.summary(df)).first().text == "Saved a total of 180 bytes or 45.00%"
    assert reports.total_text(reports.summary(df.where("false"))).first().text == "Didn't optimize any files."
    texts = [r[0] for r in df.select(reports.report_text(F.col("name"), F.col("bytes_in"), F.col("bytes_out"))).collect()]
    assert texts[0] == "a: 40.00% (40 bytes) saved" and texts[1] == "b: 0.00% (0 bytes), kept original"
    gate = lambda **k: [r[0] for r in df.select(reports.replaces(F.col("bytes_in"), F.col("bytes_out"), **k)).collect()]
    assert gate() == [True, False, True, True, False] and gate(bigger=True) == [True, True, True, True, False] and not any(gate(dry_run=True))


def test_roots_do_not_supersede_each_other(spark):
    rows = [("r1", "/a", 9.0), ("r1", "/a/b", 5.0), ("r2", "/a/b", 5.0)]
    left = stamps.compact(spark.createDataFrame(rows, "root string, path string, ts double"))
    assert sorted(map(tuple, left.collect())) == [("r1", "/a", 9.0), ("r2", "/a/b", 5.0)]


def test_fingerprints_tell_texts_and_paths_but_not_order(spark):
    rows = [("r", "/a", "x"), ("r", "/b", None), ("s", "/b", None), ("s", "/a", "x"), ("t", "/a", "y"), ("t", "/b", None), ("u", "/c", "x"), ("u", "/b", None)]
    told = {r.root: r.fingerprint for r in stamps.fingerprint(spark.createDataFrame(rows, "root string, path string, text string"), ["root"]).collect()}
    assert told["r"] == told["s"] and len(set(told.values())) == 3


def test_handlers_without_their_tools_are_passed_over(spark):
    df = spark.createDataFrame([("a", "JPEG", False, False, False, False), ("b", "PNG", True, False, False, True)], "item_id string, format string, lossless boolean, animated boolean, archive boolean, convert boolean")
    ready = spark.createDataFrame([("Jpeg", False), ("ToWEBP", False), ("Png", True)], "handler string, ready boolean")
    got = {r.item_id: r.handler for r in routing.pick_handlers(df, routing.routes(spark), ["WEBP"], ready=ready).collect()}
    assert got == {"b": "Png"}


def test_percentages_round_by_their_exact_value(spark):
    # the double of 12.475 lies below it, and eighths are ties
    rows = [(i, o) for i in (4000, 800, 1000, 200, 3) for o in range(0, i + 40, 1 + i // 200)]
    df = spark.createDataFrame(rows, "bytes_in long, bytes_out long")
    told = df.select("bytes_in", "bytes_out", reports.report_text(F.lit("a"), F.col("bytes_in"), F.col("bytes_out")).alias("text")).collect()
    wrong = [r for r in told if r.text.split()[1] != f"{0.0 if r.bytes_in <= 0 else 100.0 * (r.bytes_in - r.bytes_out) / r.bytes_in:.2f}%"]
    assert not wrong
    total = reports.total_text(spark.createDataFrame([(4000, 3501)], "bytes_in long, bytes_out long"))
    assert total.first().text == "Saved a total of 499 bytes or 12.47%"
