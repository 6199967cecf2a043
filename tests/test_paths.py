import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from siltworks.functions import paths
from siltworks.functions import settings as options

NAMES = ["/a/b.png", "/a/b.tar.gz", "/a/.tar.gz", "/a/.hidden", "/a/b", "/a.b/c", "/a/b.TAR.gz", "/a/x.y.z", "/a/b.tar.", "rel.tar.xz"]


def told(name):
    p = PurePosixPath(name)
    return "".join(p.suffixes[-2:]) if len(p.suffixes) > 1 and p.suffixes[-2] == ".tar" else p.suffix


def test_suffixes(spark):
    names = [n for n in NAMES if not n.endswith(".")]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", paths.suffix(F.col("p")).alias("s"))
    assert {r.p: r.s for r in rows.collect()} == {n: told(n) for n in names}


def test_derived_names(spark):
    row = spark.createDataFrame([("/a b/c.tar.gz", 3)], "p string, frame int").select(
        paths.final_path(F.col("p"), F.lit(".zip")).alias("final"),
        paths.output_suffix(F.col("p"), F.array(F.lit(".tar.gz")), F.lit(".tgz")).alias("kept"),
        paths.output_suffix(F.col("p"), F.array(F.lit(".zip")), F.lit(".zip")).alias("own"),
        paths.working_name(F.array(F.lit("x y.zip")), F.col("p")).alias("work"),
        paths.item_name(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("frame")).alias("frame"),
        paths.item_name(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int")).alias("none"),
        paths.ancestors(F.col("p")).alias("up"),
    )
    assert tuple(row.first()) == ("/a b/c.zip", ".tar.gz", ".zip", "x_y.zip___a_b_c.tar.gz", "frame_#003.img", "Unknown", ["/a b", "/a b/c.tar.gz"])


@pytest.mark.parametrize(("globs", "hit", "miss"), [(["*.png"], "x/a.png", "a.pngx"), (["a**b"], "acccb", "xab"), ([], "x/.git", "x/git"), (["a+b"], "a+b", "aab")])
def test_globs(globs, hit, miss):
    found = re.compile(paths.globs_to_regex(globs))
    assert found.search(hit) and not found.search(miss)
    assert not re.search(paths.globs_to_regex([], defaults=False), ".x")


def test_options():
    assert [options.memory_bytes(x) for x in ("512M", "1.5GB", 10, "2k", "x", None)] == [512 << 20, 3 << 29, 10, 2048, None, None]
    assert options.default_memory() > 0
    assert options.after_epoch("12.5") == 12.5 and options.after_epoch("2024-01-01T00:00:00+00:00") == 1704067200
    assert options.csv_set("b, a,,b") == ["a", "b"]
    assert options.version("tool v1.10.2 (x)") > (1, 2, 3) and options.version("none") == ()
    assert options.durations("No.: w h alpha x y dur\n 1: 9 9 no 0 0 70 none\n 2: 9 9 no 0 0") == [70, 100]


def test_dates_in_usual_forms():
    day = options.after_epoch("2024-01-05")
    assert [options.after_epoch(x) for x in ("Jan 5 2024", "5 January 2024", "January 5, 2024", "2024/01/05", "2024/01/05 00:00")] == [day] * 5
    assert options.after_epoch("2024/01/05 00:00:00 +0000") == 1704412800
    with pytest.raises(ValueError, match="not a date"):
        options.after_epoch("someday")
