"""Baseline TIFF stacks: strips of 8, 16 or 32 bits, uncompressed or PackBits-free deflate, one page per frame."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8}
_FORM = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def pages(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of every page: number -> values."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no classic TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    while at:
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, tuple] = {-1: (order,)}
        for i in range(n):
            tag, kind, count, _ = struct.unpack_from(order + "HHII", data, at + 2 + 12 * i)
            size = _SIZE.get(kind, 1) * count
            place = at + 2 + 12 * i + 8 if size <= 4 else struct.unpack_from(order + "I", data, at + 2 + 12 * i + 8)[0]
            raw = data[place : place + size]
            if kind == 2:
                tags[tag] = (raw.rstrip(b"\0").decode("utf-8", "replace"),)
            elif kind == 5:
                pairs = struct.unpack(order + "I" * 2 * count, raw)
                tags[tag] = tuple(a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True))
            elif kind in _FORM:
                tags[tag] = struct.unpack(order + _FORM[kind] * count, raw)
        yield tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def pixels(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """One page's pixels as float32, height by width; other layouts are refused."""
    width, height, bits, packing = tags[256][0], tags[257][0], tags.get(258, (1,))[0], tags.get(259, (1,))[0]
    if tags.get(277, (1,))[0] != 1 or packing not in (1, 8, 32946) or bits not in (8, 16, 32):
        raise ValueError(f"a page of {tags.get(277, (1,))[0]} samples, {bits} bits and compression {packing} is not read here")
    strips = [data[o : o + n] for o, n in zip(tags[273], tags[279], strict=True)]
    raw = b"".join(zlib.decompress(s) if packing != 1 else s for s in strips)
    form = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]]
    return np.frombuffer(raw, dtype=f"{tags[-1][0]}{form}{bits // 8}")[: width * height].reshape(height, width).astype(np.float32)


def metadata(tags: dict[int, tuple]) -> dict[str, float | str | None]:
    """Pixel size and frame interval of an ImageJ file's first page, where its tags give them."""
    text = tags.get(270, ("",))[0]
    found = dict(re.findall(r"^(\w+)=(.*?)\s*$", text, re.M))
    resolution = tags.get(282, (0.0,))[0]
    return {"unit": found.get("unit"), "pixel_size": 1 / resolution if resolution else None, "interval": float(found["finterval"]) if "finterval" in found else None, "interval_unit": found.get("tunit", "sec"), "description": text}


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            data = content.as_py()
            for frame, tags in enumerate(pages(data)):
                image = pixels(data, tags)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([frame], pa.int32()), pa.array([image.shape[0]], pa.int32()), pa.array([image.shape[1]], pa.int32()), pa.array([image.tobytes()], pa.binary())], names=["path", "frame", "height", "width", "pixels"])


def read_stacks(spark: SparkSession, path: str) -> DataFrame:
    """Stacks as one row per frame: path, frame, height, width, pixels (float32, row by row)."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_decode, "path string, frame int, height int, width int, pixels binary")
