"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized, tiled as NPY, hashed by differences."""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts_of

#: Bytes of a row of the stored image: 64 pixels of three samples.
ROW = 192
TILE = 32


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """``count`` decimal fields after the two-byte mark, comments skipped, and the place of the byte after them."""
    at, fields = 2, []
    while len(fields) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            if data[at] == 35:
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            else:
                at += 1
        start = at
        while at < len(data) and data[at : at + 1].isdigit():
            at += 1
        if start == at:
            raise ValueError("header cut short")
        fields.append(int(data[start:at]))
    return fields, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array of height x width x channels, uint8 (uint16 for larger maxima)."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    bitmap, channels = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    fields, at = _header(data, 2 if bitmap else 3)
    width, height, most = fields[0], fields[1], 1 if bitmap else fields[2]
    dtype = np.dtype(np.uint8) if most < 256 else np.dtype(">u2")
    n = width * height * channels
    # A sample of text takes a byte at least, one of a bitmap an eighth: what the header promises can't be more than there is.
    if n > 8 * len(data):
        raise ValueError("image cut short")
    if kind == b"P4":
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=at + 1, count=height * -(-width // 8)).reshape(height, -1), axis=1)[:, :width]
        return (1 - bits)[:, :, None]
    if kind in (b"P5", b"P6"):
        flat = np.frombuffer(data, dtype, offset=at + 1, count=n)
    elif kind == b"P1":
        flat = 1 - np.array([c - 48 for c in data[at:] if c in b"01"][:n], np.uint8)
    else:
        flat = np.array(data[at:].split()[:n], dtype=np.int64).astype(dtype)
    return flat.reshape(height, width, channels).astype(dtype.newbyteorder("="), copy=False)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits as height x width x 3, uint8, in the order red, green, blue."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    word = lambda at, n=4, signed=False: int.from_bytes(data[at : at + n], "little", signed=signed)
    offset, head, width, height, bits, packing = word(10), word(14), word(18, 4, True), word(22, 4, True), word(28, 2), word(30)
    if packing != 0 or bits not in (8, 24, 32):
        raise ValueError("BMP of a kind that isn't read")
    stride = -(-width * bits // 32) * 4
    if width <= 0 or stride * abs(height) > len(data):
        raise ValueError("image cut short")
    rows = np.frombuffer(data, np.uint8, offset=offset, count=stride * abs(height)).reshape(abs(height), stride)
    if height > 0:
        rows = rows[::-1]
    if bits == 8:
        colours = word(46) or 256
        palette = np.frombuffer(data, np.uint8, offset=14 + head, count=4 * colours).reshape(-1, 4)
        return palette[rows[:, :width]][:, :, 2::-1]
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_ppm(pixels: np.ndarray) -> bytes:
    """An array of height x width x 3, uint8, as P6."""
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def integral_image(pixels: np.ndarray) -> np.ndarray:
    """Sums over all rows above and columns to the left, with a row and a column of zeros in front."""
    out = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1, pixels.shape[2]), np.float64)
    np.cumsum(np.cumsum(pixels, axis=0, dtype=np.float64), axis=1, out=out[1:, 1:])
    return out


def area_resize(integral: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each cell of a grid of height x width; cells may cut pixels, which then count by their share."""

    def along(a: np.ndarray, cells: int) -> np.ndarray:
        n = a.shape[0] - 1
        at = np.arange(cells + 1) * (n / cells)
        low = np.minimum(at.astype(np.int64), n - 1)
        part = (at - low).reshape(-1, *[1] * (a.ndim - 1))
        edges = a[low] + (a[low + 1] - a[low]) * part
        return np.diff(edges, axis=0) / (n / cells)

    rows = along(integral, height)
    return along(rows.transpose(1, 0, 2), width).transpose(1, 0, 2)


def difference_hash(integral: np.ndarray) -> str:
    """64 bits: whether each of 8 x 9 cells is brighter than its right neighbour, as 16 hex digits."""
    grey = area_resize(integral, 8, 9).mean(axis=2)
    return np.packbits(grey[:, :-1] > grey[:, 1:] + 1e-9).tobytes().hex()


def npy_tile(integral: np.ndarray, side: int = TILE) -> bytes:
    """The image at side x side, rounded to uint8, in the NPY format."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.floor(area_resize(integral, side, side) + 0.5).clip(0, 255).astype(np.uint8), version=(1, 0))
    return out.getvalue()


def media_columns(images: DataFrame, media_col: str = "media", side: int = TILE) -> DataFrame:
    """Append ``height, width, difference_hash, tile`` (NPY) and ``error`` to rows with an encoded image.

    Null or unreadable images keep their row: the first four are null, ``error`` says why. Columns of these names
    are replaced; repeated rows stay; an empty table gives no rows.
    """
    names = ["height", "width", "difference_hash", "tile", "error"]
    base = images.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch[media_col].to_pylist():
                try:
                    if data is None:
                        raise ValueError("null")
                    pixels = decode(bytes(data))
                    if not pixels.size:
                        raise ValueError("no pixels")
                    whole = integral_image(pixels)
                    rows.append((pixels.shape[0], pixels.shape[1], difference_hash(whole), npy_tile(whole, side), None))
                except (ValueError, IndexError, OverflowError, MemoryError) as e:
                    rows.append((None, None, None, None, str(e)))
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]
            new = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns + new, batch.schema.names + names)

    extra = "height int, width int, difference_hash string, tile binary, error string"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{schema}, {extra}")


def store_text(text: str) -> tuple[bytes, int]:
    """A text as an image: its bytes, padded by spaces to whole rows, are the samples. Also the unpadded length."""
    data = text.encode()
    payload = data.ljust(max(1, -(-len(data) // ROW)) * ROW, b" ")
    return encode_ppm(np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)), len(data)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each whole text as an image, read it back and return digests and features.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (the difference
    hash), tile_sha256. A null text counts as empty: one row of spaces. Equal texts give equal values; ids may
    be null or repeat; an empty table gives no rows; other columns are left out.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts_of(batch["text"]):
                media, n = store_text(text)
                pixels = decode(media)
                payload = pixels.tobytes()
                whole = integral_image(pixels)
                rows.append((n, len(payload), sha(payload), zlib.crc32(payload[-16:]), len(media), sha(media), difference_hash(whole), sha(npy_tile(whole))))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(x, k) for x, k in zip(cols, kinds, strict=True)]], names)

    from pyspark.sql import functions as F

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
