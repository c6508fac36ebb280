"""Pictures in PNG files as rows: 8-bit samples, grey or colour, not interlaced. Files are decoded where Spark reads them."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from gyrolith.sources.tables import PIXELS, array_rows, encoded, files_of

# Fixed values of the format: its signature, and samples of a pixel by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _plain_row(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """The row's samples before filtering: each filter predicts a sample from those left, above, and above left."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), 0, np.uint8).reshape(-1)
    if kind == 2:
        return row + above
    out, up, raw = [0] * step, [0] * step + above.tolist(), row.tolist()
    for k, x in enumerate(raw):
        a, b, c = out[k], up[k + step], up[k]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out.append((x + guess) & 255)
    return np.array(out[step:], np.uint8)


def decode(content: bytes) -> np.ndarray:
    """Samples (height, width, channels) of one file; a palette is looked up and transparency dropped."""
    if not content.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    at, data, palette, head = len(SIGNATURE), [], None, b""
    while at < len(content):
        size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    depth, colour, interlaced = head[8], head[9], head[12]
    if depth not in (8, 16) or interlaced:
        raise ValueError("only samples of 8 or 16 bits without interlacing can be read")
    step = SAMPLES[colour] * depth // 8
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width * step + 1)
    out, above = np.empty((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for y in range(height):
        out[y] = above = _plain_row(int(rows[y, 0]), rows[y, 1:], above, step)
    out = out.reshape(height, width, step) if depth == 8 else out.view(">u2").astype(np.uint16).reshape(height, width, step // 2)
    step = out.shape[2]
    if colour == 3:
        return palette[out[:, :, 0]]
    return out[:, :, :1] if step in (1, 2) else out[:, :, :3]


def encode(a: np.ndarray) -> bytes:
    """A grey picture (height, width) or one of three channels, of 8-bit samples, as a file."""
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    height, width = a.shape[:2]
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes((8, 2 if a.ndim == 3 else 0, 0, 0, 0))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), a.astype(np.uint8).reshape(height, -1)], axis=1)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def as_pictures(labels: DataFrame) -> DataFrame:
    """(file, content) of grey pictures for dense label maps (image, y, x, v), named <image>_mask.png: labels stretched so that the largest is 255."""
    return encoded(labels, lambda a: encode(a * 255 // a.max() if a.max() > 0 else a), "_mask.png")


def _files(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    return files_of(spark, path, "*.[pP][nN][gG]", recursive)


def grey_rows(name: str, content: bytes, above: float | None) -> pd.DataFrame:
    a = decode(content).astype(float)
    v = np.floor(a @ (0.299, 0.587, 0.114) + 0.5) if a.shape[2] == 3 else a[:, :, 0]
    y, x = np.indices(v.shape)
    return pd.DataFrame({"image": name.rsplit("/", 1)[-1], "y": y.ravel(), "x": x.ravel(), "v": v.ravel() if above is None else (v.ravel() > above).astype(float)})


def read_predictions(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(image, y, x, v) of every file below the path by its ending: arrays where they are above 0, pictures above 127; other endings are an error."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                if name.endswith(".npy"):
                    yield array_rows(name, content, 0.0, True)
                elif name.lower().endswith(".png"):
                    yield grey_rows(name, content, 127.0)
                else:
                    raise ValueError(f"unsupported file format: {name}")

    return files_of(spark, path, "*", recursive).mapInPandas(run, PIXELS)


def read_colours(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(image, y, x, b, g, r) of every PNG file; grey pictures have three equal channels."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                a = decode(content)
                a = np.repeat(a, 3, 2) if a.shape[2] == 1 else a
                y, x = np.indices(a.shape[:2])
                channels = {c: a[:, :, k].ravel().astype(np.int32) for c, k in (("b", 2), ("g", 1), ("r", 0))}
                yield pd.DataFrame({"image": name.rsplit("/", 1)[-1], "y": y.ravel(), "x": x.ravel(), **channels})

    return _files(spark, path, recursive).mapInPandas(run, "image string, y int, x int, b int, g int, r int")


def read_pictures(spark: SparkSession, path: str, above: float | None = None, recursive: bool = False) -> DataFrame:
    """(image, y, x, v) of every PNG file: grey values, or 1 where they are above a threshold (127 for masks) and else 0."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                yield grey_rows(name, content, above)

    return _files(spark, path, recursive).mapInPandas(run, PIXELS)
