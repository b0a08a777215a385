"""Sizes of images from their headers; nothing is decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that hold the header of every format but two: a JPEG's frame comes after segments of any length, a TIFF's directory anywhere.
HEAD = 64


def png(data: bytes) -> tuple[int, int]:
    return struct.unpack_from(">II", data, 16)


def bmp(data: bytes) -> tuple[int, int]:
    if struct.unpack_from("<I", data, 14)[0] == 12:
        return struct.unpack_from("<HH", data, 18)
    width, height = struct.unpack_from("<ii", data, 18)  # rows from the top down have a negative height
    return abs(width), abs(height)


def webp(data: bytes) -> tuple[int, int]:
    kind = data[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if kind == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 ":
        width, height = struct.unpack_from("<HH", data, 26)
        return width & 0x3FFF, height & 0x3FFF
    raise ValueError("unknown WebP chunk")


def jpeg(data: bytes) -> tuple[int, int]:
    at = 2
    while True:
        if data[at] != 0xFF:
            raise ValueError("no JPEG segment where one should begin")
        marker = data[at + 1]
        if marker == 0xFF:  # filled up
            at += 1
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:  # without a length
            at += 2
        else:
            at += 2 + struct.unpack_from(">H", data, at + 2)[0]


def tiff(data: bytes) -> tuple[int, int]:
    end = "<" if data[:2] == b"II" else ">"
    big = struct.unpack_from(f"{end}H", data, 2)[0] == 43
    at = struct.unpack_from(f"{end}Q", data, 8)[0] if big else struct.unpack_from(f"{end}I", data, 4)[0]
    count, first, step, value = (struct.unpack_from(f"{end}Q", data, at)[0], at + 8, 20, 12) if big else (struct.unpack_from(f"{end}H", data, at)[0], at + 2, 12, 8)
    found = {}
    for k in range(count):
        tag, kind = struct.unpack_from(f"{end}HH", data, first + step * k)
        if tag in (256, 257):
            found[tag] = struct.unpack_from(end + {3: "H", 4: "I", 16: "Q"}[kind], data, first + step * k + value)[0]
    return found[256], found[257]


def size_of(data: bytes) -> tuple[int, int]:
    """(width, height) of a PNG, JPEG, TIFF, BMP or WebP image; anything else is an error."""
    for magic, read in ((b"\x89PNG\r\n\x1a\n", png), (b"\xff\xd8", jpeg), (b"II*\0", tiff), (b"MM\0*", tiff), (b"II+\0", tiff), (b"MM\0+", tiff), (b"BM", bmp)):
        if data.startswith(magic):
            return read(data)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return webp(data)
    raise ValueError("not an image of a known format")


def sizes(images: DataFrame) -> DataFrame:
    """(page_key, path, image_width, image_height) of images (page_key, path, content); one that cannot be read is an error that names it.

    Only JPEG and TIFF images go whole to Python, of the others the first bytes.
    """
    long_ = F.hex(F.substring("content", 1, 2)).isin("FFD8", "4949", "4D4D")
    head = F.when(long_, F.col("content")).otherwise(F.substring("content", 1, HEAD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, data in zip(batch.column(1), batch.column(2), strict=True):
                try:
                    found.append(size_of(data.as_py()))
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    raise ValueError(f"no image size in {path}: {e}") from e
            width, height = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(width, pa.int32()), pa.array(height, pa.int32())], names=["page_key", "path", "image_width", "image_height"])

    return images.select("page_key", "path", head.alias("head")).mapInArrow(run, "page_key string, path string, image_width int, image_height int")
