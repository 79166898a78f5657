"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, and
written as NPY tiles with difference hashes.

``decode`` reads PBM, PGM, PPM (plain and raw, 8 or 16 bits) and uncompressed BMP (8, 24, 32 bits a
pixel) into ``uint8``/``uint16`` arrays. ``media_columns`` works on a binary column; ``text_media``
stores texts as raw PGM, reads them back and derives the same columns.

Null or undecodable media give null features; a null text is the empty text. Equal bytes give equal
values, and repeated or null ids keep one row each.
"""

from __future__ import annotations

import hashlib
import io
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc, map_rows

#: Samples in a row of a stored text.
ROW = 64
#: Size of the NPY tile, and of the grid that the difference hash compares (one column more).
TILE, HASH_GRID = (16, 16), (8, 9)


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """The first numbers of a Netpbm header after the magic, comments skipped, and where data starts."""
    at, found = 2, []
    while len(found) < count:
        if at >= len(data):
            raise ValueError("short Netpbm header")
        c = data[at : at + 1]
        if c == b"#":
            while at < len(data) and data[at : at + 1] not in (b"\n", b"\r"):
                at += 1
        elif c.isspace():
            at += 1
        else:
            end = at
            while end < len(data) and data[end : end + 1].isdigit():
                end += 1
            if end == at:
                raise ValueError("bad Netpbm header")
            found.append(int(data[at:end]))
            at = end
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6. Gray and bitmap: height x width; pixmap: height x width x 3. Bitmaps: 1 is black, 0 here."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    bitmap, plain, channels = kind in (b"P1", b"P4"), kind in (b"P1", b"P2", b"P3"), 3 if kind in (b"P3", b"P6") else 1
    head, at = _header(data, 2 if bitmap else 3)
    width, height, top = head[0], head[1], 1 if bitmap else head[2]
    if not 0 < top < 65536:
        raise ValueError("bad maximum")
    count = width * height * channels
    if plain:
        body = b"\n".join(line.split(b"#")[0] for line in data[at - 1 :].splitlines())
        numbers = [int(chr(x)) for x in body if x in b"01"] if bitmap else list(map(int, body.split()))
        pixels = np.array(numbers[:count], np.uint16 if top > 255 else np.uint8)
    elif bitmap:
        stride = (width + 7) // 8
        rows = np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride)
        pixels = np.unpackbits(rows, axis=1)[:, :width].reshape(-1)
    else:
        pixels = np.frombuffer(data, ">u2" if top > 255 else np.uint8, count, at)
        pixels = pixels.astype(np.uint16) if top > 255 else pixels
    if len(pixels) != count:
        raise ValueError("short Netpbm data")
    if bitmap:
        pixels = (1 - pixels) * np.uint8(255)
    return pixels.reshape((height, width, 3) if channels == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits: height x width x 3, in order red, green, blue."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    (start,) = struct.unpack_from("<I", data, 10)
    head, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if packing != 0 or bits not in (8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("BMP kind not supported")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 3), np.uint8)
        palette[:colours] = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        return palette[rows[:, :width]]
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(payload: bytes, width: int = ROW) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP of a height x width x 3 array."""
    height, width, _ = pixels.shape
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def gray(pixels: np.ndarray) -> np.ndarray:
    """Luma by the BT.601 integer weights, as float64."""
    if pixels.ndim == 2:
        return pixels.astype(np.float64)
    return (pixels.astype(np.uint32) @ np.array([299, 587, 114], np.uint32)) / 1000.0


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target pixel, fractions of pixels included.

    The integral image is sampled at the fractional cell edges, where it is linear within a pixel.
    """
    integral = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    np.cumsum(np.cumsum(pixels, axis=0, dtype=np.float64), axis=1, out=integral[1:, 1:])

    def sample(table: np.ndarray, count: int) -> np.ndarray:
        edges = np.linspace(0, table.shape[0] - 1, count + 1)
        low = np.minimum(edges.astype(np.int64), table.shape[0] - 2)
        part = (edges - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    corners = sample(sample(integral, height).T, width).T
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums * (height * width / (pixels.shape[0] * pixels.shape[1]))


def tile(pixels: np.ndarray) -> tuple[bytes, str]:
    """The NPY file of the resized tile, and the 64-bit difference hash in hex."""
    level = gray(pixels)
    small = np.clip(np.rint(area_resize(level, *TILE)), 0, 65535 if pixels.dtype == np.uint16 else 255)
    out = io.BytesIO()
    np.save(out, small.astype(pixels.dtype), allow_pickle=False)
    grid = area_resize(level, *HASH_GRID)
    bits = grid[:, 1:] > grid[:, :-1] + 1e-9
    return out.getvalue(), np.packbits(bits).tobytes().hex()


def media_columns(df: DataFrame, media_col: str, id_col: str) -> DataFrame:
    """(id, height int, width int, channels int, tile binary: an NPY file, dhash string) of a binary column.

    Media that are null or can't be decoded have nulls there.
    """

    def start():
        def make(media):
            rows = []
            for data in media:
                try:
                    pixels = decode(data) if data else None
                    if pixels is None or not pixels.size:
                        raise ValueError("empty")
                    rows.append((*pixels.shape[:2], pixels.shape[2] if pixels.ndim == 3 else 1, *tile(pixels)))
                except (ValueError, struct.error):
                    rows.append((None,) * 5)
            return list(zip(*rows, strict=True)) if rows else [[]] * 5

        return make

    return _map_binary(df, [id_col], media_col, "height int, width int, channels int, tile binary, dhash string", start)


def _map_binary(df, keep, col, schema, start):
    from .common import _ddl, arrow_schema, slices, spread
    import pyarrow as pa

    given = df.select(*[F.col(c) for c in keep], F.col(col).cast("binary").alias("__media"))
    out = given.drop("__media").schema
    for field in _ddl(schema):
        out = out.add(field)
    arrow = arrow_schema(out)

    def run(batches):
        make = start()
        for part in slices(batches, 64):
            made = make(part.column(part.num_columns - 1).to_pylist())
            columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(x, arrow.field(len(keep) + i).type) for i, x in enumerate(made)], schema=arrow)

    return spread(given).mapInArrow(run, out)


def payload_of(text: str) -> tuple[int, bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return len(data), data + bytes(-len(data) % ROW or (ROW if not data else 0))


def text_media(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Store every text as an 8-bit PGM of 64 samples a row, read the stored bytes back, and compute
    features from what was read.

    (id, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,
    media_sha256 string, feature string, tile binary). feature: the difference hash and, after a
    colon, the SHA-256 of the NPY tile.
    """

    def start():
        def make(texts):
            rows = []
            for text in texts:
                n, payload = payload_of(text)
                stored = encode_pgm(payload)
                pixels = decode(stored)
                read = pixels.tobytes()
                npy, dhash = tile(pixels)
                rows.append((n, len(read), hashlib.sha256(read).hexdigest(), crc(read[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{dhash}:{hashlib.sha256(npy).hexdigest()}", npy))
            return list(zip(*rows, strict=True)) if rows else [[]] * 8

        return make

    return map_rows(df, [id_col], text_col, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary", start)
