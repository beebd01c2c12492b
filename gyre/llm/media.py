"""Media columns: payloads as Netpbm or BMP images, area-resized tiles in NPY form, difference hashes.

``images`` makes bytes into 24-bit pixels, 64 to a row (192 bytes), so any payload
of a multiple of 192 bytes is a whole image.  ``features`` decodes images (P1 to P6,
or uncompressed 8- and 24-bit BMP), resizes them by area through an integral image,
and gives an NPY tile and a 64-bit difference hash.  ``stored`` writes both as tables,
images and then tiles, and gives what is read back from each.

Defined cases: a null text is an empty one, its payload 192 blanks; equal texts
have equal values in every column but doc_id; an empty table gives no rows; other
columns are not read; an image that is null, cut short, of no pixel or of no known
form gives null features and the reason in ``error`` (``decode`` itself raises ValueError).
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

WIDTH, ROW = 64, 192
#: Luma weights of ITU-R BT.601, in thousandths (fixed values).
LUMA = np.array([299, 587, 114], np.float64) / 1000
HEADER = re.compile(rb"P([1-6])((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)(\d+)")


def to_ppm(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if pixels.ndim == 3 else 5, w, h) + pixels.tobytes()


def to_bmp(pixels: np.ndarray) -> bytes:
    """24-bit, bottom row first, blue first, rows filled up to four bytes."""
    h, w = pixels.shape[:2]
    pad = -w * 3 % 4
    rows = np.zeros((h, w * 3 + pad), np.uint8)
    rows[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, -1)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_netpbm(raw: bytes) -> np.ndarray:
    m = HEADER.match(raw)
    if not m:
        raise ValueError("not a Netpbm image")
    kind, w, h, at = int(m[1]), int(m[3]), int(m[5]), m.end()
    most = 1
    if kind not in (1, 4):
        v = re.compile(rb"(?:\s+|#[^\n]*\n)+(\d+)").match(raw, at)
        if not v:
            raise ValueError("no maximum value")
        most, at = int(v[1]), v.end()
    if not 0 < most < 65536:
        raise ValueError("bad maximum value")
    shape = (h, w, 3) if kind in (3, 6) else (h, w)
    n = int(np.prod(shape))
    if kind <= 3:
        body = re.sub(rb"#[^\n]*", b"", raw[at:])
        flat = np.frombuffer(re.sub(rb"\s+", b"", body), np.uint8) - 48 if kind == 1 else np.array(body.split(), np.int64)
    elif len(raw) <= at + (h * -(-w // 8) if kind == 4 else n * (2 if most > 255 else 1)):
        raise ValueError("the image ends early")
    elif kind == 4:
        bits = np.frombuffer(raw, np.uint8, h * (-(-w // 8)), at + 1).reshape(h, -1)
        flat = np.unpackbits(bits, axis=1)[:, :w].reshape(-1)
    else:
        flat = np.frombuffer(raw, ">u2" if most > 255 else np.uint8, n, at + 1)
    if len(flat) < n:
        raise ValueError("the image ends early")
    px = flat[:n].reshape(shape)
    if kind in (1, 4):
        return ((1 - px) * 255).astype(np.uint8)
    return px.astype(np.uint8) if most == 255 else ((px.astype(np.int64) * 255 + most // 2) // most).astype(np.uint8)


def decode_bmp(raw: bytes) -> np.ndarray:
    if raw[:2] != b"BM" or len(raw) < 54:
        raise ValueError("not a BMP image")
    at, head, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", raw, 10)
    if packed or bits not in (8, 24):
        raise ValueError("only uncompressed 8- or 24-bit BMP")
    stride = -(-w * bits // 32) * 4
    if w < 1 or len(raw) < at + abs(h) * stride:
        raise ValueError("the image ends early")
    rows = np.frombuffer(raw, np.uint8, abs(h) * stride, at).reshape(abs(h), stride)
    if h > 0:
        rows = rows[::-1]
    if bits == 24:
        return np.ascontiguousarray(rows[:, : w * 3].reshape(abs(h), w, 3)[:, :, ::-1])
    if head < 40 or at < 14 + head or (at - 14 - head) % 4:
        raise ValueError("bad colour table")
    colours = np.frombuffer(raw, np.uint8, at - 14 - head, 14 + head).reshape(-1, 4)[:, 2::-1]
    if rows[:, :w].max(initial=0) >= len(colours):
        raise ValueError("a colour is not in the table")
    return colours[rows[:, :w]]


def decode(raw: bytes) -> np.ndarray:
    px = decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)
    if not px.size:
        raise ValueError("the image has no pixel")
    return px


def along(sums: np.ndarray, n: int) -> np.ndarray:
    """Differences of the running sums along axis 0 at n + 1 even, fractional edges."""
    size = len(sums) - 1
    edge = np.arange(n + 1) * (size / n)
    low = np.minimum(edge.astype(np.int64), size - 1)
    part = (edge - low).reshape(-1, *[1] * (sums.ndim - 1))
    return np.diff(sums[low] * (1 - part) + sums[low + 1] * part, axis=0)


def resized(grey: np.ndarray, h: int, w: int) -> np.ndarray:
    """Area means; the integral image is taken one axis after the other, so it never needs more than one column sum of the original."""
    wide = along(np.concatenate([np.zeros((1, grey.shape[0])), np.cumsum(grey.T, axis=0, dtype=np.float64)]), w)
    tall = along(np.concatenate([np.zeros((1, w)), np.cumsum(wide.T, axis=0)]), h)
    return tall * (h * w / grey.size)


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def difference_hash(grey: np.ndarray) -> str:
    small = np.round(resized(grey, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def grey_of(pixels: np.ndarray) -> np.ndarray:
    return pixels @ LUMA if pixels.ndim == 3 else pixels.astype(np.float64)


IMAGE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])


def images(docs: DataFrame, form: str = "ppm") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled up with blanks, as an image of 64 pixels a row."""
    store = {"ppm": to_ppm, "bmp": to_bmp}[form]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            media, size = [], []
            for t in texts:
                raw = t.encode()
                size.append(len(raw))
                rows = max(1, -(-len(raw) // ROW))
                media.append(store(np.frombuffer(raw.ljust(rows * ROW), np.uint8).reshape(rows, WIDTH, 3)))
            for a in range(0, len(media), 1000):
                yield pa.record_batch([ids.slice(a, 1000), pa.array(size[a : a + 1000], pa.int64()), pa.array(media[a : a + 1000], pa.binary())], schema=IMAGE)

    at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return at.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame, tile: tuple[int, int] = (16, 16)) -> DataFrame:
    """Decodes ``media`` and adds payload (the samples as bytes), tile (NPY, uint8), dhash (16 hexadecimal digits) and error (why they are null)."""

    def one(raw: bytes | None):
        try:
            if raw is None:
                raise ValueError("no image")
            px = decode(raw)
        except ValueError as e:
            return None, None, None, str(e)
        grey = grey_of(px)
        return px.tobytes(), npy(np.clip(np.floor(resized(grey, *tile) + 0.5), 0, 255).astype(np.uint8)), difference_hash(grey), None

    def run(batches):
        for batch in batches:
            raws = batch.column(2).to_pylist()
            for a in range(0, len(raws), 500):
                made = zip(*map(one, raws[a : a + 500]))
                yield pa.record_batch([*(batch.column(i).slice(a, 500) for i in range(3)), *(pa.array(x, t.type) for x, t in zip(made, list(FEATURES)[3:]))], schema=FEATURES)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, tile binary, dhash string, error string")


def stored(docs: DataFrame, form: str = "ppm") -> DataFrame:
    """doc_id, n_bytes, the digests of the payload and of the image as read back, tile, dhash and error, as read back.

    Two tables in the shared folder: the images, then what was made of them as read.
    """
    held = written(images(docs, form), "media-images", compression="zstd")
    digests = features(held).select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "tile", "dhash", "error",
    )
    return written(digests, "media-tiles", compression="zstd")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored image and what is read back from it; feature is the hash and the tile's sha-256."""
    return stored(documents(spark, sf_dir)).withColumn("feature", F.concat_ws(":", "dhash", F.sha2("tile", 256))).drop("tile", "dhash", "error")


def brute(text: str | None) -> dict:
    """The digest of one text, for tests."""
    raw = (text or "").encode()
    payload = raw.ljust(max(1, -(-len(raw) // ROW)) * ROW)
    return {"n_bytes": len(raw), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:])}
