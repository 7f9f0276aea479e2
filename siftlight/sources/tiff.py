"""Capture metadata and embedded previews from TIFF-based raw files, read where the data is (mapInPandas)."""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Sizes of TIFF field types and the tags that are read.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
WIDTH, COMPRESSION, MODEL, STRIP_OFFSETS, STRIP_SIZES, SUB_IFDS = 0x0100, 0x0103, 0x0110, 0x0111, 0x0117, 0x014A
JPEG_OFFSET, JPEG_SIZE, EXIF_IFD = 0x0201, 0x0202, 0x8769
EXPOSURE, APERTURE, ISO, FOCAL, LENS = 0x829A, 0x829D, 0x8827, 0x920A, 0xA434

METADATA = "has_exif boolean, shutter double, aperture double, iso double, focal double, camera string, lens string, previews array<struct<idx: int, width: long, jpeg: boolean, start: long, size: long>>"
METADATA_COLUMNS = ("has_exif", "shutter", "aperture", "iso", "focal", "camera", "lens", "previews")
METADATA_ARROW = [
    ("has_exif", pa.bool_()), *[(c, pa.float64()) for c in ("shutter", "aperture", "iso", "focal")], ("camera", pa.string()), ("lens", pa.string()),
    ("previews", pa.list_(pa.struct([("idx", pa.int32()), ("width", pa.int64()), ("jpeg", pa.bool_()), ("start", pa.int64()), ("size", pa.int64())])))]
RAW = f"path string, {METADATA}"
#: Bytes of a preview that are read at most: a length in a file is not to be trusted.
MOST_PREVIEW = 64 << 20


def directory(data: bytes, order: str, at: int) -> tuple[dict[int, list], int]:
    """The fields of a directory and the place of the next one."""
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        size = TYPE_SIZE.get(kind, 1) * count
        if size > len(data):
            raise IndexError("more values than the file has room for")
        where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        if kind == 2:
            fields[tag] = [data[where:where + count].split(b"\0")[0].decode("utf-8", "replace")]
        elif kind in (5, 10):
            v = struct.unpack_from(order + ("II" if kind == 5 else "ii") * count, data, where)
            fields[tag] = [a / b if b else None for a, b in zip(v[::2], v[1::2], strict=True)]
        elif kind in (3, 4, 9):
            fields[tag] = list(struct.unpack_from(order + {3: "H", 4: "I", 9: "i"}[kind] * count, data, where))
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def describe(data: bytes) -> dict:
    """Metadata and preview candidates; a file that is no TIFF has neither."""
    out = {"has_exif": False, "previews": []} | dict.fromkeys(("shutter", "aperture", "iso", "focal", "camera", "lens"))
    try:
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        todo, exif, seen, idx = [struct.unpack_from(order + "I", data, 4)[0]], None, set(), 0
        while todo:
            at = todo.pop(0)
            if not at or at in seen:
                continue
            seen.add(at)
            f, after = directory(data, order, at)
            todo += [*f.get(SUB_IFDS, []), after]
            one = lambda tag, f=f: (f.get(tag) or [None])[0]
            out["camera"] = out["camera"] or one(MODEL)
            if one(EXIF_IFD):
                exif, _ = directory(data, order, one(EXIF_IFD))
            start, size = (one(JPEG_OFFSET), one(JPEG_SIZE)) if one(JPEG_OFFSET) else (one(STRIP_OFFSETS), sum(f.get(STRIP_SIZES, [])))
            # A candidate without a length, or one that the file has no room for, is none.
            if start and size and start + size <= len(data):
                out["previews"].append({"idx": idx, "width": one(WIDTH) or 0, "jpeg": bool(one(JPEG_OFFSET)) or one(COMPRESSION) == 6, "start": start, "size": size})
            idx += bool(start)
        if exif is not None:
            get = lambda tag: (exif.get(tag) or [None])[0]
            out |= {"has_exif": True, "shutter": get(EXPOSURE), "aperture": get(APERTURE), "iso": get(ISO), "focal": get(FOCAL), "lens": get(LENS)}
    except (KeyError, struct.error, IndexError, TypeError, ValueError, OverflowError):  # malformed: what was found so far
        return out
    return out


def read(path: str) -> dict:
    """``describe`` of a file; one that is missing, empty or unreadable has no metadata."""
    try:
        with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            return describe(data)  # only the pages with directories are read
    except (OSError, ValueError):
        return describe(b"")


def extract(files: DataFrame) -> DataFrame:
    """Raw values per path (see ``RAW``); unreadable files give a row without metadata."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([{"path": path} | read(path) for path in part["path"]], columns=["path", *METADATA_COLUMNS])

    return files.select("path").mapInPandas(run, RAW)


def exif_text() -> Column:
    """The formatted metadata struct over the columns of ``METADATA``, null without capture metadata."""
    c = F.col
    exif = F.struct(text.shutter_text(c("shutter")).alias("shutterSpeed"), text.focal_text(c("focal")).alias("focalLength"), text.aperture_text(c("aperture")).alias("aperture"), text.iso_text(c("iso")).alias("iso"), c("camera"), c("lens").alias("lensModel"))
    return F.when(c("has_exif"), exif)


def exif_texts(raw: DataFrame) -> DataFrame:
    """path and ``exif_text`` for each row of ``extract``."""
    return raw.select("path", exif_text().alias("exif"))


def embedded_previews(raw: DataFrame) -> DataFrame:
    """path, idx, width, jpeg bytes of the widest JPEG inside each file; files without one are absent.

    The bytes are null where the file is gone, cut short, or the preview is longer than ``MOST_PREVIEW``.
    """
    # Chosen inside the row, as ``images.largest_preview`` does over rows: the widest, of equal ones the first.
    known = F.filter("previews", lambda p: p["jpeg"] & (p["width"] > 0))
    best = F.array_max(F.transform(known, lambda p: F.struct(p["width"].alias("width"), (-p["idx"]).alias("minus"), p["start"].alias("start"), p["size"].alias("size"))))
    chosen = raw.select("path", best.alias("b")).filter("b IS NOT NULL").select("path", (-F.col("b.minus")).alias("idx"), "b.width", "b.start", "b.size")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            data = [piece(path, int(start), int(size)) for path, start, size in zip(part["path"], part["start"], part["size"], strict=True)]
            yield pd.DataFrame({"path": part["path"], "idx": part["idx"], "width": part["width"], "jpeg": data})

    return chosen.mapInPandas(run, "path string, idx int, width long, jpeg binary")


def piece(path: str, start: int, size: int) -> bytes | None:
    """``size`` bytes of a file from ``start`` on, if they are all there."""
    if size > MOST_PREVIEW:
        return None
    try:
        with open(path, "rb") as f:
            f.seek(start)
            data = f.read(size)
    except OSError:
        return None
    return data if len(data) == size else None


def compose(camera: str, exif: dict[int, object], previews: list[tuple[int, bytes]]) -> bytes:
    """A raw file's frame: a chain of directories with a preview each (width, bytes), the first with the camera and the
    capture settings (by tag: a number as a fraction of 1,000,000, an ISO as a whole number, a lens as text)."""
    out = bytearray(b"II*\0\0\0\0\0")

    def put(data: bytes) -> int:
        out.extend(b"\0" * (len(out) % 2))
        at = len(out)
        out.extend(data)
        return at

    def text_field(value: str) -> tuple[int, int, int]:
        raw = value.encode() + b"\0"
        return 2, len(raw), put(raw) if len(raw) > 4 else int.from_bytes(raw, "little")

    def directory_of(fields: dict[int, tuple[int, int, int]]) -> int:
        rows = b"".join(struct.pack("<HHII", tag, *fields[tag]) for tag in sorted(fields))
        return put(struct.pack("<H", len(fields)) + rows + b"\0\0\0\0")

    settings = {}
    for tag, value in exif.items():
        if isinstance(value, str):
            settings[tag] = text_field(value)
        elif tag == ISO:
            settings[tag] = (4, 1, int(value))
        else:
            settings[tag] = (5, 1, put(struct.pack("<II", round(value * 1_000_000), 1_000_000)))
    last = 4  # where the place of the next directory is written
    for k, (width, data) in enumerate(previews or [(0, b"")]):
        fields = {WIDTH: (4, 1, width)}
        if data:
            fields |= {JPEG_OFFSET: (4, 1, put(data)), JPEG_SIZE: (4, 1, len(data))}
        if not k:
            fields |= {MODEL: text_field(camera)} | ({EXIF_IFD: (4, 1, directory_of(settings))} if settings else {})
        at = directory_of(fields)
        out[last:last + 4] = struct.pack("<I", at)
        last = at + 2 + 12 * len(fields)
    return bytes(out)
