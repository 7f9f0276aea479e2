"""The catalog source: shares of a folder, pushed filters, metadata in the scan, and previews of odd files."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from siftlight.sources import catalog, rawfiles, tiff


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("cards")
    for k in range(60):
        where = top / ("a" if k < 40 else "b")
        where.mkdir(exist_ok=True)
        exif = {tiff.EXPOSURE: 1 / 200, tiff.APERTURE: 2.8, tiff.ISO: 100 + k, tiff.FOCAL: 50.0, tiff.LENS: "L 50"} if k % 2 else {}
        (where / f"_DSC{k:04}.ARW").write_bytes(tiff.compose("CAM", exif, [(1600, b"s" * k), (6000, b"large" * k)]))
        os.utime(where / f"_DSC{k:04}.ARW", (1_700_000_000 + k, 1_700_000_000 + k))
    (top / "a/._DSC9000.ARW").write_bytes(b"")
    (top / "a/x.jpg").write_bytes(b"x")
    return str(top)


@pytest.mark.parametrize("tasks", [1, 5, 64])
def test_every_file_is_in_one_share(spark, folder, tasks):
    df = catalog.scan(spark, f"{folder}/a", f"{folder}/b", tasks=tasks)
    names = sorted(r.name for r in df.collect())
    assert names == [f"_DSC{k:04}.ARW" for k in range(60)]
    assert df.rdd.getNumPartitions() == 2 * -(-tasks // 2)


def test_filters_are_pushed_into_the_scan(spark, folder):
    df = catalog.scan(spark, f"{folder}/a", f"{folder}/b")
    at = lambda k: F.timestamp_seconds(F.lit(1_700_000_000 + k))
    cases = [
        (F.col("name").startswith("_DSC000"), "StringStartsWith(name", range(10)), (F.col("name").endswith("7.ARW"), "StringEndsWith(name", range(7, 60, 10)), (F.col("name").contains("004"), "StringContains(name", [4, *range(40, 50)]),
        (F.col("name") == "_DSC0005.ARW", "EqualTo(name", [5]), (F.col("name").isin("_DSC0005.ARW", "_DSC0050.ARW", "none"), "In(name", [5, 50]), (F.col("name") != "_DSC0005.ARW", "Not(EqualTo(name", [k for k in range(60) if k != 5]),
        (F.col("catalog") == f"{folder}/b/", "EqualTo(catalog", range(40, 60)), (F.col("name") > "_DSC0056.ARW", "GreaterThan(name", range(57, 60)), (F.col("modified") >= at(58), "GreaterThanOrEqual(modified", [58, 59]),
        (~F.col("name").startswith("_DSC00"), "Not(StringStartsWith(name", []), ((F.col("size") > 0) & (F.col("modified") < at(2)), "LessThan(modified", [0, 1]),
    ]
    for condition, pushed, want in cases:
        q = df.filter(condition)
        plan = q._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert pushed in plan, plan
        assert sorted(r.name for r in q.collect()) == [f"_DSC{k:04}.ARW" for k in want]
    # What the source can't compare stays with Spark.
    q = df.filter((F.length("name") == 12) & (F.col("file_key") == F.md5("path")) & (F.col("type") == catalog.RAW_TYPE))
    assert q.count() == 60


def test_scan_without_push_down_gives_the_same(spark, folder):
    before = spark.conf.get(catalog.PUSHDOWN)
    spark.conf.set(catalog.PUSHDOWN, "false")
    try:
        assert catalog.scan(spark, f"{folder}/a").filter("name < '_DSC0003'").count() == 3
    finally:
        spark.conf.set(catalog.PUSHDOWN, before)


def test_names_are_tested_before_files_are_touched(folder, monkeypatch):
    reader = catalog.PushingReader({"path": f"{folder}/a", "metadata": "true", "tasks": "1"})
    from pyspark.sql.datasource import EqualTo

    left = list(reader.pushFilters([EqualTo(("name",), "_DSC0007.ARW"), EqualTo(("camera",), "CAM"), EqualTo(("exif", "iso"), 1), EqualTo(("size",), None)]))
    assert [f.attribute for f in left] == [("camera",), ("exif", "iso"), ("size",)]
    opened, read = [], tiff.read
    monkeypatch.setattr(tiff, "read", lambda path: opened.append(path) or read(path))
    part, = reader.partitions()
    rows = [r for b in reader.read(part) for r in b.to_pylist()]
    assert [r["name"] for r in rows] == ["_DSC0007.ARW"] and opened == [f"{folder}/a/_DSC0007.ARW"] and rows[0]["iso"] == 107


def test_metadata_comes_with_the_scan(spark, folder):
    rows = {r.name: r for r in catalog.scan_with_metadata(spark, f"{folder}/a").collect()}
    e = rows["_DSC0003.ARW"].exif
    assert (e.shutterSpeed, e.focalLength, e.aperture, e.iso, e.camera, e.lensModel) == ("1/200", "50.0mm", "ƒ/2.8", "ISO 103", "CAM", "L 50")
    assert rows["_DSC0002.ARW"].exif is None and [p.width for p in rows["_DSC0002.ARW"].previews] == [1600, 6000]
    assert len(rows) == 40 and rows["_DSC0000.ARW"].previews == []


def test_previews_of_odd_files(spark, tmp_path):
    """A length that is missing, too large or beyond the file, and a file that goes: the others keep their previews."""
    good = tiff.compose("C", {}, [(100, b"jpeg-bytes")])
    length = struct.pack("<HHII", tiff.JPEG_SIZE, 4, 1, len(b"jpeg-bytes"))
    assert length in good
    (tmp_path / "good.ARW").write_bytes(good)
    (tmp_path / "none.ARW").write_bytes(good.replace(length, struct.pack("<HHII", 0x0999, 4, 1, 1)))
    (tmp_path / "beyond.ARW").write_bytes(good.replace(length, struct.pack("<HHII", tiff.JPEG_SIZE, 4, 1, 10**6)))
    (tmp_path / "zero.ARW").write_bytes(good.replace(length, struct.pack("<HHII", tiff.JPEG_SIZE, 4, 1, 0)))
    (tmp_path / "gone.ARW").write_bytes(good)
    (tmp_path / "two.ARW").write_bytes(tiff.compose("C", {}, [(300, b"first"), (300, b"second"), (20, b"small")]))
    raw = spark.createDataFrame(tiff.extract(catalog.scan(spark, str(tmp_path))).collect(), tiff.RAW)
    (tmp_path / "gone.ARW").unlink()
    got = {os.path.basename(r.path): r.jpeg and bytes(r.jpeg) for r in tiff.embedded_previews(raw).collect()}
    assert got == {"good.ARW": b"jpeg-bytes", "gone.ARW": None, "two.ARW": b"first"}
    assert tiff.piece(str(tmp_path / "good.ARW"), 0, tiff.MOST_PREVIEW + 1) is None and tiff.piece(str(tmp_path / "good.ARW"), len(good) - 2, 5) is None


def test_raw_files_written_twice_are_written_once(spark, tmp_path):
    rows = [(f"{tmp_path}/s{k % 2}", f"_DSC{k}.ARW", "CAM" if k else None, 0.5, None, 200, 35.0, None, [(160, b"p" * k), (99, None)]) for k in range(6)]
    frames = spark.createDataFrame(rows, rawfiles.FRAMES)
    for _ in range(2):
        assert rawfiles.write(frames).agg(F.sum("bytes")).first()[0] > 0
    got = {r.name: r for r in catalog.scan_with_metadata(spark, f"{tmp_path}/s0", f"{tmp_path}/s1").collect()}
    assert len(got) == 6 and all(len(os.listdir(f"{tmp_path}/s{k}")) == 3 for k in (0, 1))
    e = got["_DSC5.ARW"].exif
    assert (e.shutterSpeed, e.aperture, e.iso, e.focalLength, e.lensModel) == ("1/2", None, "ISO 200", "35.0mm", None)
    with pytest.raises(ValueError, match="mounted"):
        rawfiles.local_folder("hdfs://x/y")


def test_cache_is_listed_in_tasks(spark, tmp_path):
    names = [f"k{i}.jpg" for i in range(50)]
    for n in [*names, ".hidden.jpg", "other.txt"]:
        (tmp_path / n).write_bytes(n.encode())
    cached = catalog.disk_cache(spark, f"file://{tmp_path}", tasks=7)
    assert sorted((r.file_key + ".jpg", r.length, bytes(r.content).decode()) for r in cached.collect()) == sorted((n, len(n), n) for n in names)
    assert cached.rdd.getNumPartitions() == 7 and all(r.modified.year >= 2020 for r in cached.select("modified").collect())
    assert catalog.disk_cache(spark, str(tmp_path), content=False).columns == ["file_key", "length", "modified"]
    assert catalog.disk_cache(spark, f"{tmp_path}/none").count() == 0
