"""Decoding of every kind of Netpbm and BMP against the samples that were written."""

import struct

import numpy as np
import pytest

from sparkloom.llm import media

rng = np.random.default_rng(2)


def test_bitmaps():
    bits = rng.integers(0, 2, size=(5, 11))
    white = (255 * (1 - bits)).astype(np.uint8)
    text = b"P1\n# c\n11 5\n" + b"\n".join("".join(map(str, r)).encode() for r in bits)
    assert np.array_equal(media.decode(text), white)
    assert np.array_equal(media.decode(b"P4\n11 5\n" + np.packbits(bits.astype(np.uint8), axis=1).tobytes()), white)
    for bad in (b"P1\n2 2\n101", b"P4\n9 2\n\x00\x00"):
        with pytest.raises(ValueError):
            media.decode(bad)


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_pam(depth):
    for most, kind in ((255, np.uint8), (1000, ">u2")):
        samples = rng.integers(0, most + 1, size=(3, 4, depth)).astype(kind)
        head = f"P7\nWIDTH 4\nHEIGHT 3\nDEPTH {depth}\nMAXVAL {most}\nTUPLTYPE X\nENDHDR\n".encode()
        expected = samples[:, :, 0] if depth < 3 else samples[:, :, :3]
        assert np.array_equal(media.decode(head + samples.tobytes()), expected)
    with pytest.raises(ValueError):
        media.decode(b"P7\nWIDTH 4\nENDHDR\n")


def bmp(bits, width, height, rows, extra=b"", packed=0, used=0):
    start = 54 + len(extra)
    return struct.pack("<2sIHHI", b"BM", start + len(rows), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, packed, len(rows), 0, 0, used, 0) + extra + rows


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_palettes(bits):
    width, height = 13, 3
    index = rng.integers(0, 1 << bits, size=(height, width)).astype(np.uint8)
    palette = rng.integers(0, 256, size=(1 << bits, 4)).astype(np.uint8)
    step = -(-width * bits // 32) * 4
    rows = b""
    for line in index[::-1]:
        code = "".join(f"{v:0{bits}b}" for v in line).ljust(8 * step, "0")
        rows += int(code, 2).to_bytes(step, "big")
    assert np.array_equal(media.decode(bmp(bits, width, height, rows, palette.tobytes())), palette[:, 2::-1][index])


def test_fields():
    values = rng.integers(0, 1 << 15, size=(2, 4)).astype("<u2")
    expected = np.stack([((values >> s & 31).astype(int) * 255 + 15) // 31 for s in (10, 5, 0)], axis=2)
    assert np.array_equal(media.decode(bmp(16, 4, -2, values.tobytes())), expected)
    wide = rng.integers(0, 1 << 32, size=(2, 3), dtype=np.uint64).astype("<u4")
    masks = (0xFF000000, 0x00FF0000, 0x0000FF00)
    expected = np.stack([(wide >> s & 255) for s in (24, 16, 8)], axis=2)
    assert np.array_equal(media.decode(bmp(32, 3, -2, wide.tobytes(), struct.pack("<III", *masks), 3)), expected)
    with pytest.raises(ValueError):
        media.decode(bmp(24, 3, 2, b"", packed=1))


def test_plain_samples():
    assert media.decode(b"P2 # one\n2 1 # two\n255\n7 # of 9\n 0255").tolist() == [[7, 255]]
    assert media.decode(b"P3 1 1 9\n1 2 # 3\n9").tolist() == [[[1, 2, 9]]]
    for samples in (b"99999999999999999999999", b"-1", b"256", b"x", b"1.5", b"9" * 5_000, b""):
        with pytest.raises(ValueError):
            media.decode(b"P2 1 1 255 " + samples)


def test_broken_images_give_nulls(spark):
    broken = [b"P2 1 1 255 " + b"9" * 23, b"P2 1 1 255 -1", b"P5 " + b"9" * 30 + b" " + b"9" * 30 + b" 255 x", b"P1 " + b"9" * 25 + b" 2 1", b"BM", b"BM" + b"\xff" * 80, b"", None]
    rows = [(i, x) for i, x in enumerate(broken)] + [(99, b"P2 1 1 255 7")]
    found = {r["key"]: r for r in media.media_tiles(spark.createDataFrame(rows, "id long, image binary"), "id", "image").collect()}
    assert len(found) == len(rows) and found[99]["tile"] is not None
    assert all(found[i]["tile"] is None and found[i]["dhash"] is None for i in range(len(broken)))
