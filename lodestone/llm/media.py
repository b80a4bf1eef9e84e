"""Media columns: payloads kept as PNG images, read back and hashed by their low frequencies.

Writing: bytes become an 8-bit grey image ``WIDTH`` samples wide, each row filtered against
the one above (or not, whichever gives the smaller sum), deflated, and wrapped in the PNG
chunks IHDR, IDAT, IEND with their checksums.

Reading: chunks are walked, every checksum tested, IDAT inflated, and rows unfiltered with
numpy (None, Sub and Up as running sums; Average and Paeth byte by byte).  Anything that
doesn't hold raises ``ValueError``.

Media live in a binary column of a Parquet table; features are taken from the table read back.

Feature: the image, as given back, averaged to 32 x 32, its two-dimensional cosine
transform, and one bit for each of 64 low frequencies, set where above their median.

Defined results.  Null text is empty; an empty payload is one row of padding.  Equal
payloads give equal images and features; repeated rows keep their rows.  A very long text is one image of so many
rows.  An empty table gives an empty table.  Other columns are not read, so their names may clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, by_value, materialize

WIDTH, PAD, TAIL = 576, 255, 32
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 6


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``width``."""
    return data + bytes([PAD]) * (max(width, -(-len(data) // width) * width) - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    up = rows.copy()
    up[1:] -= rows[:-1]
    cost = lambda a: np.minimum(a, 256 - a.astype(np.int16)).sum(axis=1)
    use_up = cost(up) < cost(rows)
    scan = np.empty((len(rows), width + 1), np.uint8)
    scan[:, 0] = np.where(use_up, 2, 0)
    scan[:, 1:] = np.where(use_up[:, None], up, rows)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(scan.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of every chunk, its checksum tested."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("a chunk is cut off")
        (n,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if at + 12 + n > len(png) or struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("no IEND chunk")


def _unfilter(scan: np.ndarray) -> np.ndarray:
    """Rows of 8-bit grey samples from filtered scan lines (the first byte of each names its filter)."""
    kinds, out = scan[:, 0], scan[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown filter")
    y = 0
    while y < len(out):
        kind = kinds[y]
        if kind == 2:  # a run of Up rows is a running sum down the columns
            end = y
            while end < len(out) and kinds[end] == 2:
                end += 1
            run = out[y - 1 if y else 0 : end]
            np.cumsum(run, axis=0, dtype=np.uint8, out=run)
            y = end
            continue
        if kind == 1:
            np.cumsum(out[y], dtype=np.uint8, out=out[y])
        elif kind in (3, 4):
            above = out[y - 1].astype(int) if y else np.zeros(out.shape[1], int)
            left = upper_left = 0
            for x, v in enumerate(out[y].tolist()):
                b = int(above[x])
                if kind == 3:
                    guess = (left + b) // 2
                else:
                    p = left + b - upper_left
                    pa, pb, pc = abs(p - left), abs(p - b), abs(p - upper_left)
                    guess = left if pa <= pb and pa <= pc else b if pb <= pc else upper_left
                left, upper_left = (v + guess) & 255, b
                out[y, x] = left
        y += 1
    return out


def decode_png(png: bytes) -> np.ndarray:
    """Samples (height, width) of an 8-bit grey PNG."""
    head, data = None, []
    for kind, body in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image without interlace")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError("IDAT does not inflate") from e
    if len(raw) != height * (width + 1):
        raise ValueError("the image has another size than it says")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


_K = np.arange(32)
COSINES = np.cos(np.pi * (2 * _K[None, :] + 1) * _K[:, None] / 64)[:9]


def _averaged(a: np.ndarray, n: int = 32) -> np.ndarray:
    """Rows averaged (or repeated) to ``n``."""
    edges = np.arange(n + 1) * len(a) // n
    if len(a) < n:
        return a[np.arange(n) * len(a) // n].astype(float)
    return np.add.reduceat(a.astype(np.int64), edges[:-1], axis=0) / np.diff(edges)[:, None]


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: the signs, about their median, of 64 low frequencies (the constant one left out)."""
    small = _averaged(_averaged(image).T).T
    low = (COSINES @ small @ COSINES.T)[:8, :9].ravel()
    low = np.round(np.delete(low, 0)[:64], 6)
    return np.packbits(low > np.median(low)).tobytes().hex()


COLUMNS = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(n_bytes: int, png: bytes) -> tuple:
    """What the stored bytes give back."""
    image = decode_png(png)
    back = image.tobytes()
    return n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(image)


def media_column(text: Column, spark) -> Column:
    """Binary column: the text's bytes as a PNG."""
    bound_batches(spark)

    def encoded(texts: pd.Series) -> pd.Series:
        return pd.Series([encode_png(padded((t or "").encode("utf-8", "replace"))) for t in texts], dtype=object)

    return F.pandas_udf(encoded, "binary").asNondeterministic()(text)


def feature_column(png: Column, n_bytes: Column, spark) -> Column:
    """Struct of what a PNG column gives back (see ``SCHEMA``)."""
    bound_batches(spark)

    def described(images: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([describe(int(n), bytes(p)) for p, n in zip(images, sizes, strict=True)], columns=COLUMNS)

    return F.pandas_udf(described, SCHEMA).asNondeterministic()(png, n_bytes)


def media_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as an image in a binary column of a Parquet table, read the table, and describe what it holds."""
    spark = docs.sparkSession
    n = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    stored = materialize(docs.select(F.col(id_col), n.alias("_n"), media_column(F.col(text_col), spark).alias("_png")), "media")
    return stored.select(id_col, feature_column(F.col("_png"), F.col("_n"), spark).alias("_d")).select(id_col, "_d.*")


by_value(__name__)
