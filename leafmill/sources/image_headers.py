"""Sizes and resolutions of image files, read from their headers: PNG, JPEG, TIFF and JPEG 2000.

Files come through the binaryFile source, so any store that Spark reads will do; a row
for every image in a file, damaged files as one row with an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, page int, format string, width int, height int, dpi_x double, dpi_y double, rotation int, error string"


def png(data: bytes) -> Iterator[tuple]:
    width, height = struct.unpack(">II", data[16:24])
    at, dpi = 8, (0.0, 0.0)
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"pHYs" and data[at + 16] == 1:
            dpi = tuple(round(v * 0.0254, 2) for v in struct.unpack(">II", data[at + 8 : at + 16]))
        if kind in (b"IDAT", b"IEND"):
            break
        at += 12 + size
    yield 0, "png", width, height, *dpi, 0


def tiff(data: bytes) -> Iterator[tuple]:
    order = "<" if data[:2] == b"II" else ">"
    at, page, seen = struct.unpack(order + "I", data[4:8])[0], 0, set()
    sizes = {1: "B", 3: "H", 4: "I"}
    while at and at not in seen and at + 2 <= len(data):
        seen.add(at)
        tags = {}
        for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
            tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
            raw = data[at + 10 + 12 * i : at + 14 + 12 * i]
            if kind in sizes and count == 1:
                tags[tag] = struct.unpack(order + sizes[kind], raw[: struct.calcsize(sizes[kind])])[0]
            elif kind == 5:
                where = struct.unpack(order + "I", raw)[0]
                top, bottom = struct.unpack(order + "II", data[where : where + 8])
                tags[tag] = top / bottom if bottom else 0.0
        scale = {2: 1.0, 3: 2.54}.get(tags.get(296, 2), 0.0)
        turn = {3: 180, 6: 90, 8: 270}.get(tags.get(274, 1), 0)
        yield page, "tiff", tags.get(256, 0), tags.get(257, 0), tags.get(282, 0.0) * scale, tags.get(283, 0.0) * scale, turn
        at = struct.unpack(order + "I", data[at + 2 + 12 * struct.unpack(order + "H", data[at : at + 2])[0] :][:4])[0]
        page += 1


def jpeg(data: bytes) -> Iterator[tuple]:
    at, dpi, turn = 2, (0.0, 0.0), 0
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        if kind == 0xE0 and body[:5] == b"JFIF\0":
            scale = {1: 1.0, 2: 2.54}.get(body[7], 0.0)
            dpi = tuple(v * scale for v in struct.unpack(">HH", body[8:12]))
        if kind == 0xE1 and body[:6] == b"Exif\0\0":
            for _, _, _, _, x, y, t in tiff(body[6:]):
                turn, dpi = t, dpi if dpi[0] > 1 else (x, y)
                break
        if kind in (0xC0, 0xC1, 0xC2, 0xC3):
            height, width = struct.unpack(">HH", body[1:5])
            yield 0, "jpeg", width, height, *dpi, turn
            return
        at += 2 + size
    raise ValueError("no frame header")


def jp2(data: bytes) -> Iterator[tuple]:
    at = data.index(b"ihdr")
    height, width = struct.unpack(">II", data[at + 4 : at + 12])
    dpi = (0.0, 0.0)
    if (res := data.find(b"resd")) < 0:
        res = data.find(b"resc")
    if res >= 0:
        yn, yd, xn, xd, ye, xe = struct.unpack(">HHHHbb", data[res + 4 : res + 14])
        dpi = (xn / xd * 10.0**xe * 0.0254, yn / yd * 10.0**ye * 0.0254)
    yield 0, "jp2", width, height, *dpi, 0


def headers(data: bytes) -> list[tuple]:
    """Images of a file, by what its first bytes are."""
    for start, read in ((b"\x89PNG\r\n\x1a\n", png), (b"II*\0", tiff), (b"MM\0*", tiff), (b"\xff\xd8", jpeg), (b"\0\0\0\x0cjP", jp2)):
        if data.startswith(start):
            return list(read(data))
    raise ValueError("unknown format")


def read_headers(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(parts):
        for part in parts:
            rows = []
            for name, data in zip(part["path"], part["content"], strict=True):
                try:
                    rows += [(name, *image, None) for image in headers(data)]
                except (ValueError, struct.error, IndexError, ZeroDivisionError) as e:  # a damaged file
                    rows.append((name, None, None, None, None, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "page", "format", "width", "height", "dpi_x", "dpi_y", "rotation", "error"]).astype({"page": "Int32", "width": "Int32", "height": "Int32", "rotation": "Int32"})

    return files.mapInPandas(run, SCHEMA)
