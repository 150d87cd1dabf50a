"""Media columns: payloads stored losslessly as grey WebP images, read back as pixel arrays.

A payload is a row's UTF-8 bytes, filled with bytes 0 to a positive multiple of 64; its samples are the pixels of an
image 64 wide. Payloads over 16,384 rows of pixels go on in further images: the stored form is the WebP files one
after the other. Equal payloads have equal stored bytes.

Defined results: null and empty texts are 64 bytes 0; long texts are stored whole; repeated rows stay; an empty table
gives no rows; other columns take no part. Damaged files raise an error that names the fault.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, webp
from .tokens import slices

WIDTH = 64
MEDIA = "n_bytes bigint, media binary"


def payload(raw: bytes) -> np.ndarray:
    size = max(WIDTH, -(-len(raw) // WIDTH) * WIDTH)
    return np.frombuffer(raw.ljust(size, b"\0"), np.uint8)


def encode(raw: bytes) -> bytes:
    samples = payload(raw).reshape(-1, WIDTH)
    return b"".join(webp.encode_grey(samples[i : i + webp.MOST_SIDE]) for i in range(0, len(samples), webp.MOST_SIDE))


def decode(media: bytes) -> np.ndarray:
    """Pixels (rows, 64)."""
    return np.concatenate(webp.decode_grey(media))


def feature(pixels: np.ndarray) -> str:
    """Mean, deviation, mean step between neighbours in a row, and entropy in bits of the pixels."""
    counts = np.bincount(pixels.ravel(), minlength=256)
    n, levels = int(counts.sum()), np.arange(256)
    mean = float((counts * levels).sum()) / n
    spread = (float((counts * levels * levels).sum()) / n - mean * mean) ** 0.5
    share = counts[counts > 0] / n
    wide = pixels.astype(np.int16)
    edge = int(np.abs(wide[:, 1:] - wide[:, :-1]).sum(dtype=np.int64)) / max(n - len(pixels), 1)
    return f"mean={mean:.4f};std={spread:.4f};edge={edge:.4f};entropy={max(float(-(share * np.log2(share)).sum()), 0.0):.4f}"


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), 2 << 20):
                raw = [(t or "").encode("utf-8") for t in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(map(len, raw), pa.int64()), pa.array(map(encode, raw), pa.binary())], names=[id_col, "n_bytes", "media"])

    return common.arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, {MEDIA}")


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lengths, hashes and feature of each stored row, all from the decoded pixels and the stored bytes."""
    kind = media.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def of(data: bytes) -> tuple:
        pixels = decode(data)
        raw = pixels.tobytes()
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(pixels)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = [of(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    schema = f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return common.arrow(media.select(id_col, "n_bytes", "media"), run, schema)


def pixels(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, height, width, pixels binary) of each stored row: the decoded samples row by row, 8 bits each."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                images = [decode(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) for i in images], pa.int32()), pa.array([WIDTH] * len(images), pa.int32()), pa.array([i.tobytes() for i in images], pa.binary())], names=[id_col, "height", "width", "pixels"])

    return common.arrow(media.select(id_col, "media"), run, f"`{id_col}` {kind}, height int, width int, pixels binary")


def write_pixels(media: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Pixel arrays of the stored rows as Parquet."""
    pixels(media, id_col).write.parquet(path)


def round_trip(docs: DataFrame) -> DataFrame:
    """Store every text, read the stored bytes back and give its digests."""
    path = common.scratch(docs.sparkSession, "media")
    stored(docs).write.option("compression", "none").parquet(path)
    return digests(docs.sparkSession.read.parquet(path).select(F.col("doc_id"), "n_bytes", "media"))
