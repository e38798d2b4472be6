"""Media columns: bytes kept as Netpbm or BMP images, decoded to numpy, area-resized, written as NPY tiles.

``encode_ppm``/``encode_bmp`` store a payload of whole 192-byte rows (64 RGB pixels) losslessly, and
``decode`` reads P1 to P6 and P7 (8 or 16 bits a sample, as stored: the largest value stays the header's) and uncompressed BMP of 1 to 32 bits,
bit fields included. ``area_resize`` averages each output pixel's
area exactly, fractional borders included, by integral images; strips of ``STRIP`` rows bound the memory. ``difference_hash`` is
the 64-bit hash of brightness steps along rows of a 9 x 8 reduction.

Defined cases: a null text is an empty payload, which is padded like any other; repeated rows give
repeated results; an empty table gives no rows; extra columns are ignored. Broken images raise
``ValueError`` in ``decode``; ``media_tiles`` gives null tile and hash for them and for null images.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.common import as_bytes, map_batches, small_batches

ROW_PIXELS = 64
ROW_BYTES = 3 * ROW_PIXELS
#: Image rows held as integral image at once.
STRIP = 4096
HASH_SHAPE = (8, 9)
TILE_SHAPE = (16, 16)
#: Digits of a sample in plain Netpbm, leading zeros included.
MOST_DIGITS = 64

_COMMENT = re.compile(rb"#[^\r\n]*")


def padded(data: bytes) -> bytes:
    """``data`` with blanks appended up to a positive multiple of a row."""
    return data + b" " * (max(1, -(-len(data) // ROW_BYTES)) * ROW_BYTES - len(data))


def encode_ppm(payload: bytes) -> bytes:
    """Binary 8-bit RGB Netpbm, rows of 64 pixels."""
    return b"P6\n%d %d\n255\n" % (ROW_PIXELS, len(payload) // ROW_BYTES) + payload


def encode_bmp(payload: bytes) -> bytes:
    """Uncompressed 24-bit bottom-up BMP; the payload's bytes are taken as R, G, B."""
    height = len(payload) // ROW_BYTES
    pixels = np.frombuffer(payload, np.uint8).reshape(height, ROW_PIXELS, 3)[::-1, :, ::-1].tobytes()
    head = struct.pack("<2sIHHI", b"BM", 54 + len(pixels), 0, 0, 54)
    info = struct.pack("<IiiHHIIiiII", 40, ROW_PIXELS, height, 1, 24, 0, len(pixels), 2835, 2835, 0, 0)
    return head + info + pixels


def _netpbm_head(data: bytes, fields: int) -> tuple[list[int], int]:
    """The header's numbers after the magic, and where samples begin; comments run from # to the line's end."""
    numbers, at = [], 2
    while len(numbers) < fields:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            if data[at : at + 1] == b"#":
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        start = at
        while data[at : at + 1].isdigit():
            at += 1
        if start == at:
            raise ValueError("Netpbm header ends early")
        numbers.append(int(data[start:at]))
    return numbers, at + 1


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    channels = 3 if kind in (3, 6) else 1
    (width, height, most), at = _netpbm_head(data, 3)
    if not (width and height and 0 < most < 65536):
        raise ValueError("Netpbm header is out of range")
    count = width * height * channels
    if kind in (2, 3):
        words = _COMMENT.sub(b" ", data[at - 1 :]).split()[:count]
        if not all(x.isdigit() and len(x) <= MOST_DIGITS and int(x) <= most for x in words):
            raise ValueError("Netpbm sample is no number of the header's range")
        samples = np.array([int(x) for x in words], dtype=np.uint8 if most < 256 else np.uint16)
    else:
        width_of = np.dtype(np.uint8 if most < 256 else ">u2")
        samples = np.frombuffer(data, width_of, min(count, (len(data) - at) // width_of.itemsize), at)
    if samples.size != count:
        raise ValueError("Netpbm samples end early")
    return samples.reshape((height, width, channels) if channels == 3 else (height, width))


def _decode_bitmap(data: bytes) -> np.ndarray:
    """P1 and P4: black (1) as 0, white as 255."""
    (width, height), at = _netpbm_head(data, 2)
    if not (width and height):
        raise ValueError("Netpbm header is out of range")
    if data[1:2] == b"1":
        body = b"".join(line.partition(b"#")[0] for line in data[at - 1 :].splitlines(keepends=True))
        bits = np.frombuffer(bytes(c for c in body if c in b"01")[: width * height], np.uint8) - 48
    else:
        step = -(-width // 8)
        rows = np.frombuffer(data, np.uint8, min(step * height, max(0, len(data) - at)), at) if at < len(data) else np.empty(0, np.uint8)
        bits = np.unpackbits(rows.reshape(-1, step), axis=1)[:, :width].ravel() if rows.size == step * height else rows
    if bits.size != width * height:
        raise ValueError("Netpbm samples end early")
    return (255 * (1 - bits)).astype(np.uint8).reshape(height, width)


def _decode_pam(data: bytes) -> np.ndarray:
    """P7 of depth 1 to 4; a second or fourth channel is opacity and goes."""
    head, mark, body = data.partition(b"ENDHDR\n")
    fields = dict(line.split(None, 1) for line in head.splitlines()[1:] if len(line.split(None, 1)) == 2 and not line.startswith(b"#"))
    try:
        width, height, depth, most = (int(fields[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
    except (KeyError, ValueError) as bad:
        raise ValueError("PAM header ends early") from bad
    if not mark or not (width > 0 and height > 0 and 1 <= depth <= 4 and 0 < most < 65536):
        raise ValueError("PAM header is out of range")
    kind = np.dtype(np.uint8 if most < 256 else ">u2")
    count = width * height * depth
    samples = np.frombuffer(body, kind, min(count, len(body) // kind.itemsize))
    if samples.size != count:
        raise ValueError("PAM samples end early")
    image = samples.reshape(height, width, depth)
    return image[:, :, 0] if depth < 3 else image[:, :, :3]


def _field(values: np.ndarray, mask: int) -> np.ndarray:
    """The bits of ``mask`` in each value, scaled to 0 to 255."""
    if not mask:
        return np.zeros(values.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    return ((((values & mask) >> low).astype(np.int64) * 255 + most // 2) // most).astype(np.uint8)


def _decode_bmp(data: bytes) -> np.ndarray:
    try:
        start, size, width, height, _, bits, packed, _, _, _, used = struct.unpack_from("<I I i i H H I I i i I", data, 10)
    except struct.error as short:
        raise ValueError("BMP header ends early") from short
    fields = packed == 3 and bits in (16, 32)
    if size < 40 or (packed and not fields) or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        raise ValueError("BMP kind is not supported")
    step = -(-width * bits // 32) * 4
    if len(data) < start + step * abs(height):
        raise ValueError("BMP samples end early")
    rows = np.frombuffer(data, np.uint8, step * abs(height), start).reshape(abs(height), step)
    rows = rows[::-1] if height > 0 else rows
    if bits <= 8:
        if bits < 8:
            spread = np.unpackbits(rows, axis=1).reshape(abs(height), -1, bits)
            rows = (spread * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2, dtype=np.uint8)
        rows = rows[:, :width]
        palette = np.frombuffer(data, np.uint8, 4 * (used or 1 << bits), 14 + size).reshape(-1, 4)[:, 2::-1]
        if rows.size and rows.max() >= len(palette):
            raise ValueError("BMP palette is too short")
        return palette[rows]
    if bits == 16 or fields:
        try:
            masks = struct.unpack_from("<III", data, 54) if fields else (0x7C00, 0x03E0, 0x001F)
        except struct.error as short:
            raise ValueError("BMP masks end early") from short
        values = np.ascontiguousarray(rows).view("<u2" if bits == 16 else "<u4")[:, :width]
        return np.stack([_field(values, m) for m in masks], axis=2)
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """Samples as (height, width) or (height, width, 3)."""
    if data[:2] in (b"P1", b"P4"):
        return _decode_bitmap(data)
    if data[:2] in (b"P2", b"P3", b"P5", b"P6"):
        return _decode_netpbm(data)
    if data[:3] == b"P7\n":
        return _decode_pam(data)
    if data[:2] == b"BM":
        return _decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _edges(length: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Area borders as whole index and fraction."""
    at = np.arange(parts + 1, dtype=np.float64) * length / parts
    whole = np.minimum(at.astype(np.int64), length - 1)
    return whole, at - whole


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each output pixel's area of a grey image, by integral images over strips of rows."""
    rows, columns = image.shape
    whole, part = _edges(rows, height)
    down = np.zeros((height + 1, columns))  # sums of all rows above each border
    above = np.zeros(columns, dtype=np.int64)
    for top in range(0, rows, STRIP):
        strip = image[top : top + STRIP].astype(np.int64)
        integral = np.vstack([above, above + np.cumsum(strip, axis=0)])
        here = np.flatnonzero((whole >= top) & (whole < top + len(strip)))
        down[here] = integral[whole[here] - top] + part[here, None] * strip[whole[here] - top]
        above = integral[-1]
    bands = np.diff(down, axis=0)
    across = np.concatenate([np.zeros((height, 1)), np.cumsum(bands, axis=1)], axis=1)
    whole, part = _edges(columns, width)
    borders = across[:, whole] + part * bands[:, whole]
    return np.diff(borders, axis=1) / (rows / height * columns / width)


def grey(image: np.ndarray) -> np.ndarray:
    """The sum of an RGB image's channels; grey images as they are."""
    return image if image.ndim == 2 else image.sum(axis=2, dtype=np.uint32)


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether a cell is darker than its right neighbour, rows from the top, first bit highest."""
    small = area_resize(grey(image), *HASH_SHAPE)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return sum(1 << (63 - int(i)) for i in np.flatnonzero(bits))


def npy_tile(image: np.ndarray, shape: tuple[int, int] = TILE_SHAPE) -> bytes:
    """An area-resized grey tile as the bytes of an NPY file (float32)."""
    out = io.BytesIO()
    np.save(out, area_resize(grey(image), *shape).astype(np.float32), allow_pickle=False)
    return out.getvalue()


def media_tiles(frame: DataFrame, key: str, column: str, shape: tuple[int, int] = TILE_SHAPE) -> DataFrame:
    """(key, width, height, tile, dhash) of an image column."""
    small_batches(frame.sparkSession)
    kind = frame.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch):
        found: dict[str, list] = {"width": [], "height": [], "tile": [], "dhash": []}
        for data in batch.column(1).to_pylist():
            try:
                image = decode(data or b"")
                row = (image.shape[1], image.shape[0], npy_tile(image, shape), f"{difference_hash(image):016x}")
            except (ValueError, OverflowError):  # sizes of a broken header may be beyond numpy's integers
                row = (None, None, None, None)
            for name, value in zip(found, row, strict=True):
                found[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found["width"], pa.int32()), pa.array(found["height"], pa.int32()), pa.array(found["tile"], pa.binary()), pa.array(found["dhash"], pa.string())],
            names=["key", *found],
        )

    return map_batches(frame.select(frame[key], frame[column]), work, f"key {kind}, width int, height int, tile binary, dhash string")


def text_media(docs: DataFrame, encode=encode_ppm) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a stored image."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch):
        texts = [t or b"" for t in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(padded(t)) for t in texts], pa.binary())],
            names=["doc_id", "n_bytes", "media"],
        )

    return map_batches(docs.select(docs["doc_id"], docs["text"]), work, f"doc_id {kind}, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads stored images of ``text_media`` back: payload and file digests and the tile's feature."""
    small_batches(media.sparkSession)
    kind = media.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch):
        rows = []
        for data in batch.column(2).to_pylist():
            image = decode(data)
            payload = image.tobytes()
            rows.append(
                (
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-16:]),
                    len(data),
                    hashlib.sha256(data).hexdigest(),
                    f"{difference_hash(image):016x}:{hashlib.sha256(npy_tile(image)).hexdigest()[:16]}",
                )
            )
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(media, work, schema)
