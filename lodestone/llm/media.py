"""Media columns: Netpbm and BMP bytes to numpy arrays, area resize by integral images, NPY tiles, difference hashes.

Defined results: a null text is stored as the empty payload, padded to 64 zero bytes; equal bytes give
equal values; images of one row or column resize like any other; undecodable media give null.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_columns, slices, table, text_bytes

ROW = 64


def encode_pnm(image: np.ndarray) -> bytes:
    """P5 for two dimensions, P6 for three; 8-bit samples."""
    kind = b"P5" if image.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, image.shape[1], image.shape[0]) + np.ascontiguousarray(image).tobytes()


def decode_pnm(data: bytes) -> np.ndarray:
    """P2, P3, P5 and P6 with comments, up to 16 bits; samples of other maxima are kept as they are."""
    kind, at, fields = data[:2], 2, []
    if kind not in (b"P2", b"P3", b"P5", b"P6"):
        raise ValueError("not a PGM or PPM file")
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken header")
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    if not (width and height and 0 < most < 65536):
        raise ValueError("no samples")
    bands = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P2", b"P3"):
        samples = np.array(data[at:].split(), np.uint16 if most > 255 else np.uint8)
    else:
        samples = np.frombuffer(data, ">u2" if most > 255 else np.uint8, width * height * bands, at + 1)
    return samples.reshape((height, width, 3) if bands == 3 else (height, width))


def encode_bmp(image: np.ndarray) -> bytes:
    """Grey 8-bit with a palette, or 24-bit colour; rows stored from the bottom and padded to 4 bytes."""
    height, width = image.shape[:2]
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if image.ndim == 2 else b""
    rows = image[::-1] if image.ndim == 2 else image[::-1, :, ::-1]
    rows = np.ascontiguousarray(rows).reshape(height, -1)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    at = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", at + rows.size, 0, 0, at)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if image.ndim == 2 else 24, 0, rows.size, 2835, 2835, len(palette) // 4, 0)
    return head + info + palette + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit palette and 24-bit files, stored from the bottom or the top."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    at, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if width <= 0 or not height:
        raise ValueError("no samples")
    if packing or bits not in (8, 24):
        raise ValueError("this kind of BMP isn't supported")
    line = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), at).reshape(abs(height), line)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 24:
        return rows.reshape(abs(height), width, 3)[:, :, ::-1]
    colours = struct.unpack_from("<I", data, 46)[0] or 256
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    if (palette[:, :1] == palette).all():
        return palette[rows, 0]
    return palette[rows]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_pnm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, with fractional edges, from an integral image."""
    grey = image.astype(np.float64) if image.ndim == 2 else image.astype(np.float64).mean(axis=2)
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(np.cumsum(grey, axis=0), axis=1, out=total[1:, 1:])

    def along(t: np.ndarray, size: int) -> np.ndarray:
        edges = np.linspace(0, t.shape[0] - 1, size + 1)
        low = np.minimum(edges.astype(int), t.shape[0] - 2)
        part = (edges - low).reshape(-1, *[1] * (t.ndim - 1))
        return t[low] * (1 - part) + t[low + 1] * part

    at = along(along(total, height).T, width).T
    sums = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    return sums * (height * width / (grey.shape[0] * grey.shape[1]))


def difference_hash(image: np.ndarray) -> str:
    small = np.rint(area_resize(image, 8, 9) * 256)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = 16) -> bytes:
    """Samples of the image's own depth, 8 or 16 bits."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, side, side)), 0, np.iinfo(image.dtype).max).astype(image.dtype.newbyteorder("=")))
    return out.getvalue()


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("tile", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
_SCHEMA = "doc_id long, n_bytes long, media binary, tile binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """Each text as an image of 64 columns: its stored bytes, its NPY tile, and digests of what is read back.

    form: pgm, or bmp (rows of 64 need no padding there).
    """
    encode = {"pgm": encode_pnm, "bmp": encode_bmp}[form]

    def render(batches):
        for batch in slices(batches):
            data, off, _ = text_bytes(batch.column("text"))
            rows = []
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                raw = data[off[i] : off[i + 1]]
                image = np.zeros((max(1, -(-len(raw) // ROW)), ROW), np.uint8)
                image.ravel()[: len(raw)] = raw
                media = encode(image)
                back = decode(media)
                payload = np.ascontiguousarray(back).tobytes()
                rows.append((doc, len(raw), media, npy_tile(back), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(back)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    return doc_columns(docs).mapInArrow(render, _SCHEMA)


def decode_media(media: DataFrame, column: str = "media") -> DataFrame:
    """Files in a binary column: height, width, bands, NPY tile and difference hash; null where undecodable."""
    schema = "height int, width int, bands int, tile binary, dhash string"
    types = pa.schema([("height", pa.int32()), ("width", pa.int32()), ("bands", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string())])

    @F.pandas_udf(schema)
    def read(files):
        import pandas as pd

        rows = []
        for data in files:
            try:
                image = decode(bytes(data))
                rows.append((*image.shape[:2], image.shape[2] if image.ndim == 3 else 1, npy_tile(image), difference_hash(image)))
            except (ValueError, TypeError, struct.error, IndexError, OverflowError, MemoryError):
                rows.append((None,) * 5)
        return pd.DataFrame(rows, columns=types.names).astype({k: "Int32" for k in types.names[:3]})

    return media.withColumn("decoded", read(F.col(column)))


def write_tiles(rendered: DataFrame, path: str) -> None:
    """NPY tiles with their hashes, as Parquet."""
    rendered.select("doc_id", "tile", F.col("feature").alias("dhash")).write.mode("overwrite").parquet(path)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents")).drop("media", "tile")
