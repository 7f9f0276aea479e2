"""JPEG: against the Java platform's own codec, error bounds, damaged files, tables of images, and the writer."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftlight.functions import jpeg
from siftlight.operators import images
from siftlight.sources import jpegs


def picture(h, w, seed=1):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    p = np.stack([127 + 100 * np.sin(x / 11 + seed), 127 + 90 * np.cos(y / 17), (x * 2 + y) % 256 * 0.5 + 60], 2)
    return np.clip(p + r.normal(size=p.shape) * 3, 0, 255).astype(np.uint8)


def java_decode(spark, data):
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    h, w = image.getHeight(), image.getWidth()
    if image.getRaster().getNumBands() == 1:  # getRGB would turn grey through another gamma
        return np.array([[image.getRaster().getSample(x, y, 0) for x in range(w)] for y in range(h)])
    rgb = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w)
    return np.stack([rgb >> 16 & 255, rgb >> 8 & 255, rgb & 255], 2).astype(np.uint8)


def java_encode(spark, p, kind):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(p.shape[1], p.shape[0], kind)
    for y in range(p.shape[0]):
        for x in range(p.shape[1]):
            image.setRGB(x, y, int(p[y, x, 0]) << 16 | int(p[y, x, 1]) << 8 | int(p[y, x, 2]))
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def test_the_platform_reads_what_is_written(spark):
    for shape, quality in (((16, 16), 1.0), ((23, 41), 0.7), ((9, 64), 0.3)):
        data = jpeg.encode(picture(*shape), quality)
        ours, theirs = jpeg.decode(data).astype(int), java_decode(spark, data).astype(int)
        assert ours.shape == theirs.shape and np.abs(ours - theirs).max() <= 3
    grey = picture(20, 30)[..., 0]
    theirs = java_decode(spark, jpeg.encode(grey, 1.0)).astype(int)
    assert np.abs(theirs - grey).max() <= 2


def test_what_the_platform_writes_is_read(spark):
    """Its writer halves the chroma both ways and uses the standard's Huffman tables."""
    p = picture(37, 50)
    for kind, most in ((1, 12), (10, 2)):  # colour (the platform smooths chroma when it doubles it), grey
        data = java_encode(spark, p, kind)
        ours, theirs = jpeg.decode(data).astype(int), java_decode(spark, data).astype(int)
        theirs = theirs if theirs.ndim == 3 else theirs[..., None]
        assert ours.shape == (37, 50, 3) and np.abs(ours - theirs).mean() <= 2 and np.percentile(np.abs(ours - theirs), 99) <= most


@pytest.mark.parametrize("quality", [1.0, 0.9, 0.7, 0.4])
def test_error_is_within_the_quantisation(quality):
    """Each coefficient is off by half a step at most; the transform keeps sums of squares."""
    p = picture(64, 80)[..., 0]
    step = jpeg.tables(quality)[0].astype(float)
    error = jpeg.decode(jpeg.encode(p, quality))[..., 0].astype(float) - p
    blocks = (error.reshape(8, 8, 10, 8).swapaxes(1, 2) ** 2).sum((2, 3))
    assert (np.sqrt(blocks) <= np.sqrt(((step / 2) ** 2).sum()) + 8 * 0.5).all()
    exact = np.kron(np.arange(0, 256, 16).reshape(4, 4), np.ones((8, 8), int)).astype(np.uint8)
    assert (jpeg.decode(jpeg.encode(exact, 1.0)) == exact[..., None]).all()


def test_noise_and_restarts_and_damage():
    noise = np.random.default_rng(3).integers(0, 256, (48, 48, 3)).astype(np.uint8)
    data = jpeg.encode(noise, 1.0)
    assert np.abs(jpeg.decode(data).astype(int) - noise).max() <= 4
    assert sorted(jpeg.ZIGZAG) == list(range(64)) and jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    for bad in (b"", b"no image", data[:200], data[:-400], data.replace(b"\xff\xc0", b"\xff\xc2", 1), data[:2] + data[3:]):
        assert jpeg.decode(bad) is None
    for at in range(2, len(data), 97):  # whatever is damaged, nothing is raised
        jpeg.decode(data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1:])


def test_tables_of_images(spark):
    shots = {"a": picture(40, 60, 1), "b": picture(90, 30, 2)}
    rows = [(k, jpeg.encode(p, 0.9)) for k, p in shots.items()] + [("none", None), ("bad", b"x")]
    df = spark.createDataFrame(rows, "image string, jpeg binary").repartition(2)
    px = jpegs.pixels(df).collect()
    assert {r.image for r in px} == {"a", "b"} and len(px) == 2400 + 2700
    for k, data in rows[:2]:
        mine = {(r.x, r.y): (r.r, r.g, r.b) for r in px if r.image == k}
        p = jpeg.decode(data)
        assert all(mine[x, y] == tuple(p[y, x]) for y in range(0, p.shape[0], 7) for x in range(0, p.shape[1], 5))
    # Counted in the task or over pixel rows: the same.
    h = {(r.image, r.bin): r.n for r in jpegs.histogram(df).collect()}
    again = {(r.image, r.bin): r.n for r in images.histogram(jpegs.pixels(df)).collect()}
    assert {k: v for k, v in h.items() if k[0] in "ab"} == again and len(h) == 4 * 256 and sum(v for k, v in h.items() if k[0] == "bad") == 0
    # A thumbnail's pixels are the means that the operator over pixel rows gives.
    small = {(r.image, r.x, r.y): (r.r, r.g, r.b) for r in jpegs.pixels(df, max_dimension=16).collect()}
    rows_of = images.thumbnail(jpegs.pixels(df), 16).collect()
    assert small == {(r.image, r.x, r.y): (r.r, r.g, r.b) for r in rows_of}
    t = {r.image: r for r in jpegs.thumbnails(df, 16).collect()}
    assert (t["a"].width, t["a"].height, t["b"].width, t["b"].height) == (16, 11, 6, 16) and set(t) == {"a", "b"}
    assert jpeg.decode(bytes(t["a"].thumbnail)).shape == (11, 16, 3)


def test_code_tables_are_as_large_as_their_longest_code():
    most, length, value = jpeg._lookup(bytes([0, 2, 3] + [0] * 13), bytes([5, 6, 7, 8, 9]))
    assert (most, length, value) == (3, [2, 2, 2, 2, 3, 3, 3, 0], [5, 5, 6, 6, 7, 8, 9, 0])


def test_counts_travel_as_one_row_an_image(spark):
    rows = [("a", jpeg.encode(picture(40, 60, 1), 0.9)), ("a", jpeg.encode(picture(20, 30, 2), 0.9)), ("bad", b"x"), ("none", None)]
    df = spark.createDataFrame(rows, "image string, jpeg binary").repartition(2)
    got, every = ({(r.image, r.bin): r.n for r in f(df).collect()} for f in (jpegs.counts, jpegs.histogram))
    assert got == {k: v for k, v in every.items() if v or k in (("bad", 0), ("none", 0))} and len(every) == 3 * 256
    assert sum(got.values()) == 40 * 60 + 20 * 30
    # Small images share a record batch: one came with each before.
    def batches(parts):
        yield from (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in parts)
    assert jpegs.pixels(df.filter("jpeg is not null").coalesce(1)).mapInArrow(batches, "n long").count() == 1


def test_files_appear_when_all_tasks_have_ended(spark, tmp_path):
    thumbs = spark.createDataFrame([(f"/p/{k}.ARW", jpeg.encode(picture(8, 8, k), 0.7)) for k in range(20)], "path string, thumbnail binary").repartition(4)
    jpegs.write_cache(thumbs.union(thumbs), str(tmp_path))
    names = sorted(os.listdir(tmp_path))
    assert names == sorted(r.n for r in thumbs.select(F.concat(F.md5("path"), F.lit(".jpg")).alias("n")).collect())
    broken = spark.range(40).select(F.concat(F.lit("x"), F.col("id").cast("string"), F.when(F.col("id") == 39, "/").otherwise(".jpg")).alias("name"), F.lit(b"j").alias("jpeg")).repartition(4)
    with pytest.raises(Exception, match="no file can be written"):
        jpegs._write(broken, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == names


def test_full_images_are_written_beside_raw_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    p = picture(24, 32)
    rows = [(f"{tmp_path}/a/_DSC1.ARW", jpeg.encode(p, 1.0)), (f"{tmp_path}/b/_DSC2.arw", jpeg.encode(p, 1.0)), (f"{tmp_path}/b/_DSC3.ARW", b"bad")]
    jpegs.write_beside(spark.createDataFrame(rows, "path string, jpeg binary"))
    assert os.listdir(tmp_path / "a") == ["_DSC1.jpg"] and os.listdir(tmp_path / "b") == ["_DSC2.jpg"]
    assert np.abs(jpeg.decode((tmp_path / "a/_DSC1.jpg").read_bytes()).astype(int) - p).max() <= 4
