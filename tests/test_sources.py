"""Sources and sinks on small folders."""

import struct

from pyspark.sql import functions as F

from siftlight.sources import catalog, store, tiff


def test_scan_sees_underscored_names(spark, tmp_path):
    for n in ("_DSC1.ARW", "DSC2.ARW", "DSC3.arw", "._DSC4.ARW", "x.jpg", "sub/DSC5.ARW"):
        p = tmp_path / n
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x" * 10)
    rows = catalog.scan(spark, str(tmp_path)).collect()
    assert sorted(r.name for r in rows) == ["DSC2.ARW", "DSC3.arw", "_DSC1.ARW"]
    assert {r.size for r in rows} == {10}
    found = {r.path.rsplit("/", 1)[1] for r in catalog.discover(spark, str(tmp_path)).collect()}
    assert found == {"_DSC1.ARW", "DSC2.ARW", "DSC3.arw", "._DSC4.ARW", "DSC5.ARW"}
    assert catalog.scan(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "x.ARW").symlink_to(tmp_path / "nowhere")
    assert catalog.scan(spark, str(tmp_path)).count() == 3 and catalog.discover(spark, str(tmp_path)).count() == 6


def test_store_and_settings(spark, tmp_path):
    (tmp_path / "store.json").write_text('[{"catalog": "c", "filerecords": [{"fileName": "a", "rating": 4}, {"fileName": null}]}, {"catalog": "d"}]')
    s = store.read_store(spark, str(tmp_path / "store.json"), array=True)
    assert s.count() == 2 and [(r.name, r.rating) for r in store.flat_records(s).orderBy("position").collect()] == [("a", 4), (None, None)]
    (tmp_path / "settings.json").write_text('{"memoryCacheSizeMB": 700}')
    got = store.read_settings(spark, str(tmp_path / "settings.json")).first()
    assert (got.memoryCacheSizeMB, got.thumbnailSizePreview, got.useThumbnailAsZoomPreview) == (700, 1024, False)
    store.write_settings(spark.createDataFrame([got]), str(tmp_path / "out"))
    assert store.read_settings(spark, str(tmp_path / "out")).first() == got


def raw_file(jpeg_a: bytes, jpeg_b: bytes) -> bytes:
    """A little-endian TIFF: one directory with two previews chained, and capture metadata."""
    body = bytearray(b"II*\0" + struct.pack("<I", 8))
    values = bytearray()

    def fields(rows, after, at):
        out = struct.pack("<H", len(rows))
        for tag, kind, count, value in rows:
            out += struct.pack("<HHI", tag, kind, count) + (value if isinstance(value, bytes) else struct.pack("<I", value))
        return out + struct.pack("<I", after)

    base = 400
    ratio = lambda a, b: struct.pack("<II", a, b)
    place = {}
    for key, data in (("model", b"CAM-1\0"), ("shutter", ratio(1, 200)), ("f", ratio(28, 10)), ("focal", ratio(50, 1)), ("lens", b"L 50\0"), ("a", jpeg_a), ("b", jpeg_b)):
        place[key] = base + len(values)
        values += data
    exif = fields([(0x829A, 5, 1, place["shutter"]), (0x829D, 5, 1, place["f"]), (0x8827, 3, 1, struct.pack("<HH", 100, 0)), (0x920A, 5, 1, place["focal"]), (0xA434, 2, 5, place["lens"])], 0, 0)
    first = lambda exif_at, nxt: fields([(0x0100, 4, 1, 1600), (0x0110, 2, 6, place["model"]), (0x0201, 4, 1, place["a"]), (0x0202, 4, 1, len(jpeg_a)), (0x8769, 4, 1, exif_at)], nxt, 8)
    exif_at = 8 + len(first(0, 0))
    second_at = exif_at + len(exif)
    body += first(exif_at, second_at) + exif
    body += fields([(0x0100, 4, 1, 6000), (0x0103, 3, 1, struct.pack("<HH", 6, 0)), (0x0111, 4, 1, place["b"]), (0x0117, 4, 1, len(jpeg_b))], 0, 0)
    return bytes(body.ljust(base, b"\0") + values)


def test_raw_metadata_and_previews(spark, tmp_path):
    (tmp_path / "a.ARW").write_bytes(raw_file(b"small-jpeg", b"large-jpeg-bytes"))
    (tmp_path / "b.ARW").write_bytes(b"not a raw file")
    raw = tiff.extract(catalog.scan(spark, str(tmp_path)))
    texts = {r.path.rsplit("/", 1)[1]: r.exif for r in tiff.exif_texts(raw).collect()}
    assert texts["b.ARW"] is None
    e = texts["a.ARW"]
    assert (e.shutterSpeed, e.focalLength, e.aperture, e.iso, e.camera, e.lensModel) == ("1/200", "50.0mm", "ƒ/2.8", "ISO 100", "CAM-1", "L 50")
    best = tiff.embedded_previews(raw).collect()
    assert [(r.width, bytes(r.jpeg)) for r in best] == [(6000, b"large-jpeg-bytes")]
    whole = bytearray(raw_file(b"a", b"b"))
    huge = bytes(whole).replace(struct.pack("<HHI", 0x0110, 2, 6), struct.pack("<HHI", 0x0110, 3, 0xFFFFFFFF))
    text_sizes = bytes(whole).replace(struct.pack("<HHI", 0x0117, 4, 1), struct.pack("<HHI", 0x0117, 2, 1))
    for bad in (huge, text_sizes, bytes(whole[:60]), b"II*\0"):
        tiff.describe(bad)
    assert tiff.describe(huge)["camera"] is None
    missing = tiff.extract(spark.createDataFrame([("/no/such.ARW",)], "path string")).first()
    assert not missing.has_exif and missing.previews == []
    assert tiff.exif_texts(raw).filter(F.col("exif").isNull()).count() == 1
