import struct
import zlib

import numpy as np
import pytest

from gyrolith.sources import png


def encode(a, colour, filters=(0,), palette=None, depth=8):
    """A PNG file of samples (height, width, channels), with the filters in turn."""
    h, w, step = a.shape  # of 16-bit samples, their bytes
    flat, raw = a.reshape(h, w * step).astype(int), b""
    for y in range(h):
        kind = filters[y % len(filters)]
        row = [kind]
        for k in range(w * step):
            left = flat[y, k - step] if k >= step else 0
            up = flat[y - 1, k] if y else 0
            corner = flat[y - 1, k - step] if y and k >= step else 0
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            row.append(int(flat[y, k] - (0, left, up, (left + up) // 2, paeth)[kind]) & 255)
        raw += bytes(row)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0))]
    if palette is not None:
        parts.append(chunk(b"PLTE", palette.astype(np.uint8).tobytes()))
    body = zlib.compress(raw)
    return png.SIGNATURE + b"".join([*parts, chunk(b"IDAT", body[:9]), chunk(b"IDAT", body[9:]), chunk(b"IEND", b"")])


@pytest.mark.parametrize("colour, step", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_round_trip(colour, step):
    a = np.random.default_rng(step).integers(0, 256, (11, 7, step))
    got = png.decode(encode(a, colour, (0, 1, 2, 3, 4)))
    assert np.array_equal(got, a[:, :, : 1 if step < 3 else 3])


@pytest.mark.parametrize("colour, channels", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_samples_of_16_bits(spark, tmp_path, colour, channels):
    a = np.random.default_rng(channels).integers(0, 1 << 16, (9, 5, channels))
    content = encode(a.astype(">u2").view(np.uint8), colour, (4, 0, 1, 2, 3), depth=16)
    assert np.array_equal(png.decode(content), a[:, :, : 1 if channels < 3 else 3])
    if colour == 0:
        (tmp_path / "deep.png").write_bytes(content)
        assert {(r.y, r.x): r.v for r in png.read_pictures(spark, str(tmp_path)).collect()} == {(y, x): float(a[y, x, 0]) for y in range(9) for x in range(5)}


def test_palette_and_errors():
    palette = np.array([[0, 0, 0], [255, 0, 9]])
    a = np.array([[[0], [1]], [[1], [0]]])
    assert np.array_equal(png.decode(encode(a, 3, palette=palette)), palette[a[:, :, 0]])
    with pytest.raises(ValueError):
        png.decode(b"GIF89a")


def test_scans(spark, tmp_path):
    grey = np.array([[[0], [100], [127]], [[128], [200], [255]]])
    (tmp_path / "m.png").write_bytes(encode(grey, 0))
    (tmp_path / "c.PNG").write_bytes(encode(np.tile([10, 20, 30], (2, 3, 1)), 2, (4,)))
    rows = {(r.image, r.y, r.x): r.v for r in png.read_pictures(spark, str(tmp_path), 127).collect()}
    assert [rows["m.png", y, x] for y in range(2) for x in range(3)] == [0, 0, 0, 1, 1, 1]
    assert {r.v for r in png.read_pictures(spark, str(tmp_path)).where("image = 'c.PNG'").collect()} == {18.0}
    colours = {(r.image, r.b, r.g, r.r) for r in png.read_colours(spark, str(tmp_path)).collect()}
    assert ("c.PNG", 30, 20, 10) in colours and ("m.png", 200, 200, 200) in colours
