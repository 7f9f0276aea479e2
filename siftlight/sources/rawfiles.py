"""Raw files written from a table, for catalogs that are produced rather than photographed."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import tiff

#: folder, name; camera and capture settings (null: none); previews in order.
FRAMES = "folder string, name string, camera string, shutter double, aperture double, iso long, focal double, lens string, previews array<struct<width: long, data: binary>>"


def local_folder(url: str) -> str:
    """The path under which every machine has a shared folder mounted."""
    if "://" in url and not url.startswith("file://"):
        raise ValueError(f"raw files are read and written where a folder is mounted; {url} is not")
    return url.removeprefix("file://").removeprefix("file:").rstrip("/")


def write(frames: DataFrame) -> DataFrame:
    """(path, bytes) of the raw files written from ``FRAMES``; a file appears whole or not at all, so tasks may be repeated."""
    settings = {"shutter": tiff.EXPOSURE, "aperture": tiff.APERTURE, "iso": tiff.ISO, "focal": tiff.FOCAL, "lens": tiff.LENS}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.to_dict("records"):
                exif = {tag: r[c] for c, tag in settings.items() if not pd.isna(r[c])}
                data = tiff.compose(r["camera"] or "", exif, [(p["width"], bytes(p["data"] or b"")) for p in r["previews"]])
                path = f"{r['folder']}/{r['name']}"
                os.makedirs(r["folder"], exist_ok=True)
                draft = f"{r['folder']}/.{uuid.uuid4().hex}"
                with open(draft, "wb") as f:
                    f.write(data)
                os.replace(draft, path)
                rows.append((path, len(data)))
            yield pd.DataFrame(rows, columns=["path", "bytes"])

    return frames.mapInPandas(run, "path string, bytes long")
