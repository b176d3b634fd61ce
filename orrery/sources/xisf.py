"""XISF images: header, attached blocks with compression, byte shuffling and checksums, and a writer."""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"XISF0100"
_TYPES = {"UInt8": "u1", "UInt16": "<u2", "UInt32": "<u4", "Float32": "<f4", "Float64": "<f8"}


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def document(data: bytes) -> ET.Element:
    if data[:8] != MAGIC:
        raise ValueError("not a monolithic XISF file")
    n = int.from_bytes(data[8:12], "little")
    return ET.fromstring(data[16 : 16 + n].rstrip(b"\0 "))


def images(data: bytes) -> list[dict]:
    """What the header says of each image: id, geometry, sample format, bounds, location, keywords."""
    out = []
    for e in document(data).iter():
        if _tag(e) != "Image":
            continue
        cards = [(k.get("name", ""), k.get("value", "").strip().strip("'").strip()) for k in e if _tag(k) == "FITSKeyword"]
        out.append({"id": e.get("id", ""), "geometry": tuple(map(int, e.get("geometry", "0:0:0").split(":"))), "format": e.get("sampleFormat"), "bounds": e.get("bounds"), "location": e.get("location"), "compression": e.get("compression"), "checksum": e.get("checksum"), "cards": cards})
    return out


def unshuffle(data: bytes, size: int) -> bytes:
    """Undoes byte shuffling: the first bytes of all items, then the second ones, and so on; a tail stays as it is."""
    n = len(data) // size
    head = np.frombuffer(data, np.uint8, n * size).reshape(size, n).T.tobytes()
    return head + data[n * size :]


def shuffle(data: bytes, size: int) -> bytes:
    n = len(data) // size
    return np.frombuffer(data, np.uint8, n * size).reshape(n, size).T.tobytes() + data[n * size :]


def block(data: bytes, image: dict) -> bytes:
    """The image's bytes: located, checked, decompressed."""
    kind, *where = (image["location"] or "").split(":")
    if kind != "attachment":
        raise ValueError("only attached blocks are supported")
    start, size = map(int, where)
    raw = data[start : start + size]
    if len(raw) != size:
        raise ValueError("the block is cut short")
    if image["checksum"]:
        name, want = image["checksum"].split(":")
        if hashlib.new(name.replace("-", "").replace("sha3", "sha3_"), raw).hexdigest() != want.lower():
            raise ValueError("the checksum differs")
    if image["compression"]:
        codec, full, *item = image["compression"].split(":")
        base = codec.removesuffix("+sh")
        if base == "zlib":
            raw = zlib.decompress(raw)
        elif base in ("lz4", "lz4hc"):
            raw = pa.Codec("lz4_raw").decompress(raw, int(full)).to_pybytes()
        elif base == "zstd":
            raw = pa.Codec("zstd").decompress(raw, int(full)).to_pybytes()
        else:
            raise ValueError(f"unknown codec {codec}")
        if len(raw) != int(full):
            raise ValueError("the block's size differs")
        if codec.endswith("+sh"):
            raw = unshuffle(raw, int(item[0]))
    return raw


def decode(data: bytes, index: int = 0, image_id: str | None = None) -> dict:
    """One image, by position or id: width, height, channels, float samples (planar, as stored), bounds, cards."""
    found = images(data)
    image = next((i for i in found if i["id"] == image_id), None) if image_id is not None else found[index] if index < len(found) else None
    if image is None:
        raise ValueError("no such image")
    width, height, channels = (*image["geometry"], 1)[:3]
    a = np.frombuffer(block(data, image), _TYPES[image["format"]], width * height * channels)
    bounds = tuple(map(float, image["bounds"].split(":"))) if image["bounds"] else None
    return {"width": width, "height": height, "channels": channels, "data": a.astype(np.float32), "bounds": bounds, "cards": image["cards"]}


def rescale(data: np.ndarray, bounds: tuple[float, float] | None, top: float) -> np.ndarray:
    """Samples declared within unit bounds, brought to 0 .. ``top``; others stay."""
    return data * np.float32(top) if bounds == (0.0, 1.0) else data


def encode(data: np.ndarray, cards: list[tuple[str, str]] = (), compression: str | None = None, image_id: str = "image") -> bytes:
    """A float image (height by width, or channels first), optionally compressed (zlib, zstd or lz4, with ``+sh`` shuffled)."""
    a = np.asarray(data, np.float32)
    raw = a.astype("<f4").tobytes()
    full, note = len(raw), ""
    if compression:
        body = shuffle(raw, 4) if compression.endswith("+sh") else raw
        base = compression.removesuffix("+sh")
        raw = zlib.compress(body) if base == "zlib" else pa.Codec("lz4_raw" if base == "lz4" else base).compress(body).to_pybytes()
        note = f' compression="{compression}:{full}' + (":4" if compression.endswith("+sh") else "") + '"'
    height, width = a.shape[-2:]
    channels = a.shape[0] if a.ndim == 3 else 1
    quote = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    keys = "".join(f'<FITSKeyword name="{quote(k)}" value="{quote(v)}" comment=""/>' for k, v in cards)
    digest = hashlib.sha1(raw).hexdigest()
    start = 0
    for _ in range(3):  # the header's length depends on the position that it names
        xml = f'<?xml version="1.0" encoding="UTF-8"?><xisf version="1.0" xmlns="http://www.pixinsight.com/xisf"><Image id="{image_id}" geometry="{width}:{height}:{channels}" sampleFormat="Float32" bounds="0:1" colorSpace="{"RGB" if channels == 3 else "Gray"}" location="attachment:{start}:{len(raw)}"{note} checksum="sha-1:{digest}">{keys}</Image></xisf>'.encode()
        start = -(-(16 + len(xml)) // 4096) * 4096
    return (MAGIC + len(xml).to_bytes(4, "little") + bytes(4) + xml).ljust(start, b"\0") + raw


def read(spark: SparkSession, path: str, index: int = 0) -> DataFrame:
    """All XISF files under a path: path, width, height, channels, data; files that are none go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    i = decode(data, index)
                except (ValueError, KeyError, ET.ParseError):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([i["width"]], pa.int32()), pa.array([i["height"]], pa.int32()), pa.array([i["channels"]], pa.int32()), pa.array([i["data"]], pa.list_(pa.float32()))], names=["path", "width", "height", "channels", "data"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xisf").load(path).select("path", "content").mapInArrow(run, "path string, width int, height int, channels int, data array<float>")
