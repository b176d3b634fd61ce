"""FITS images as rows: a data source with a header-only mode, pixel decoding, and a writer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CARD, BLOCK = 80, 2880
SCHEMA = "path string, width int, height int, channels int, bitpix int, headers array<struct<keyword:string,kind:string,value:string>>, data array<float>"
_TYPES = {8: ">u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}


def parse_value(raw: str) -> tuple[str, str]:
    """Kind and text of a card's value: quoted strings with doubled quotes, T and F, whole numbers, numbers with D exponents."""
    text = raw.strip()
    if text.startswith("'"):
        out, i = [], 1
        while i < len(text):
            if text[i] == "'":
                if text[i + 1 : i + 2] != "'":
                    break
                i += 1
            out.append(text[i])
            i += 1
        return "string", "".join(out).rstrip()
    text = text.split("/", 1)[0].strip()
    if text in ("T", "F"):
        return "bool", "true" if text == "T" else "false"
    try:
        return "int", str(int(text))
    except ValueError:
        pass
    try:
        return "float", repr(float(text.upper().replace("D", "E")))
    except ValueError:
        return ("string", text) if text else ("empty", "")


def header(data: bytes) -> tuple[list[tuple[str, str, str]], int]:
    """Cards (keyword, kind, value) in order, and where the data begins."""
    cards = []
    for at in range(0, len(data) - CARD + 1, CARD):
        card = data[at : at + CARD].decode("ascii", "replace")
        keyword = card[:8].strip()
        if keyword == "END":
            return cards, -(-(at + CARD) // BLOCK) * BLOCK
        if card[8:10] == "= ":
            cards.append((keyword, *parse_value(card[10:])))
        elif keyword in ("COMMENT", "HISTORY"):
            cards.append((keyword, "string", card[8:].strip()))
    raise ValueError("no END card")


def first(cards: list[tuple[str, str, str]], keyword: str, default: float | None = None) -> float | None:
    """The first card of a keyword as a number."""
    for k, _, v in cards:
        if k == keyword:
            try:
                return float(v)
            except ValueError:
                return default
    return default


def decode(data: bytes, pixels: bool = True) -> dict:
    """One image: size, cards and physical samples (BZERO and BSCALE applied), channel by channel as stored."""
    cards, start = header(data)
    if first(cards, "NAXIS", 0) not in (2, 3):
        raise ValueError("not an image of two or three axes")
    width, height, channels = int(first(cards, "NAXIS1")), int(first(cards, "NAXIS2")), int(first(cards, "NAXIS3", 1))
    bitpix = int(first(cards, "BITPIX"))
    if bitpix not in _TYPES or channels > 3:
        raise ValueError("unsupported image")
    out = {"width": width, "height": height, "channels": channels, "bitpix": bitpix, "cards": cards}
    if pixels:
        n = width * height * channels
        if len(data) < start + n * abs(bitpix) // 8:
            raise ValueError("the image data is cut short")
        v = np.frombuffer(data, _TYPES[bitpix], n, start).astype(np.float64) * first(cards, "BSCALE", 1.0) + first(cards, "BZERO", 0.0)
        out["data"] = v.astype(np.float32)
    return out


def encode(data: np.ndarray, cards: list[tuple[str, object]] = ()) -> bytes:
    """A 32-bit float image (height by width, or channels first) with extra cards."""
    a = np.asarray(data, np.float32)
    axes = a.shape[::-1]
    lines = [("SIMPLE", True), ("BITPIX", -32), ("NAXIS", a.ndim), *[(f"NAXIS{i + 1}", n) for i, n in enumerate(axes)], *cards]

    def card(k: str, v: object) -> str:
        if isinstance(v, bool):
            text = "T" if v else "F"
        elif isinstance(v, str):
            text = "'" + v.replace("'", "''").ljust(8) + "'"
        else:
            text = repr(float(v)).upper() if isinstance(v, float) else str(v)
        text = text.ljust(20) if isinstance(v, str) else text.rjust(20)
        return f"{k[:8]:<8}= {text}"[:CARD].ljust(CARD)

    head = "".join(card(k, v) for k, v in lines) + "END".ljust(CARD)
    head = head.ljust(-(-len(head) // BLOCK) * BLOCK).encode("ascii", "replace")
    body = a.astype(">f4").tobytes()
    return head + body + bytes(-len(body) % BLOCK)


def read(spark: SparkSession, path: str, pixels: bool = True) -> DataFrame:
    """All FITS files under a path, one row each; files that are none go. Without ``pixels`` the samples are not decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("bitpix", pa.int32()), ("headers", pa.list_(pa.struct([("keyword", pa.string()), ("kind", pa.string()), ("value", pa.string())]))), ("data", pa.list_(pa.float32()))])
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    image = decode(data, pixels)
                except ValueError:
                    continue
                cards = [{"keyword": k, "kind": t, "value": v} for k, t, v in image["cards"]]
                yield pa.RecordBatch.from_pydict({"path": [where], "width": [image["width"]], "height": [image["height"]], "channels": [image["channels"]], "bitpix": [image["bitpix"]], "headers": [cards], "data": [image.get("data")]}, schema=kind)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.fit*").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def write(images: DataFrame, folder: str) -> DataFrame:
    """Writes rows (name, width, height, channels, data) as float images into a folder all executors share, each under a
    temporary name first; gives name and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, w, h, c, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                shape = (h, w) if c == 1 else (c, h, w)
                blob = encode(np.array(data, np.float32).reshape(shape))
                own = f"{folder}/.{name}.{os.getpid()}.{os.urandom(4).hex()}"
                with open(own, "wb") as f:
                    f.write(blob)
                os.replace(own, f"{folder}/{name}.fits")
                yield pa.RecordBatch.from_pydict({"name": [name], "bytes": [len(blob)]})

    return images.select("name", "width", "height", "channels", "data").mapInArrow(run, "name string, bytes long")


def card_value(headers: str, keys: list[str]) -> F.Column:
    """The first card, by order of ``keys``, without regard to case."""
    def named(key: str) -> F.Column:
        return F.get(F.filter(headers, lambda c: F.upper(c["keyword"]) == key.upper()), F.lit(0))["value"]

    found = [named(k) for k in keys]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def metadata(images: DataFrame, headers: str = "headers") -> DataFrame:
    """The acquisition columns of frames, from the header keys in common use (fixed values)."""
    from ..functions.astro import iso_to_unix
    from ..functions.names import frame_role

    num = lambda keys, kind="double": card_value(headers, keys).try_cast(kind)
    return images.withColumns({
        "camera": card_value(headers, ["INSTRUME", "CAMERA"]), "telescope": card_value(headers, ["TELESCOP"]), "filt": card_value(headers, ["FILTER"]), "exposure": num(["EXPTIME", "EXPOSURE"]), "gain": num(["GAIN"], "bigint"),
        "offset": num(["OFFSET", "BLKLEVEL"], "bigint"), "binning": num(["XBINNING"], "bigint"), "temp": num(["CCD-TEMP", "SET-TEMP"]), "focal": num(["FOCALLEN"]), "rotation": num(["ROTATOR", "ROTATANG", "OBJCTROT"]), "bayer": card_value(headers, ["BAYERPAT"]),
        "captured": iso_to_unix(card_value(headers, ["DATE-OBS"])), "role": frame_role(card_value(headers, ["IMAGETYP", "FRAME"])),
    })


def star_table(data: bytes) -> list[tuple[float, float, float]]:
    """x, y, flux of the first binary table of detected stars (columns X, Y and FLUX, 32 or 64 bit)."""
    _, at = header(data)
    cards, start = header(data[at:])
    rows, width = int(first(cards, "NAXIS2", 0)), int(first(cards, "NAXIS1", 0))
    text = {k: v for k, _, v in cards}
    fields, offset = {}, 0
    for i in range(1, int(first(cards, "TFIELDS", 0)) + 1):
        form = text[f"TFORM{i}"].strip()
        count, code = int(form[:-1] or 1), form[-1]
        fields[text.get(f"TTYPE{i}", "").strip().upper()] = (offset, {"E": ">f4", "D": ">f8", "J": ">i4", "I": ">i2"}.get(code))
        offset += count * {"E": 4, "D": 8, "J": 4, "I": 2, "A": 1, "L": 1, "B": 1, "K": 8}[code]
    raw = np.frombuffer(data, np.uint8, rows * width, at + start).reshape(rows, width)
    column = lambda n: np.ascontiguousarray(raw[:, fields[n][0] : fields[n][0] + np.dtype(fields[n][1]).itemsize]).view(fields[n][1]).ravel().astype(float)
    flux = column("FLUX") if "FLUX" in fields else np.zeros(rows)
    return list(zip(column("X").tolist(), column("Y").tolist(), flux.tolist()))
