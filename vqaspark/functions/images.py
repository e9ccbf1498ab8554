"""Images as pixels: the three ways to bring them to one size, on Arrow batches.

Pixels are float64 arrays of (height, width, 3) within 0..1.  A decoder turns a file's bytes into such an array; those of plain
formats (binary PPM, NPY) are here, others can be given.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Mean and deviation of the three colours (fixed values).
MEAN, DEVIATION = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)


def decoded(data: bytes) -> np.ndarray:
    """Pixels of a binary PPM or of an NPY file of (height, width, 3)."""
    if data[:2] == b"P6":
        words, at = [], 2
        while len(words) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while not data[end : end + 1].isspace():
                end += 1
            words.append(int(data[at:end]))
            at = end
        width, height, most = words
        kind = np.dtype(">u2" if most > 255 else "u1")
        return np.frombuffer(data, kind, width * height * 3, at + 1).reshape(height, width, 3) / most
    if data[:6] == b"\x93NUMPY":
        x = np.load(io.BytesIO(data))
        return x / 255 if x.dtype == np.uint8 else x.astype(float)
    raise ValueError("no decoder for this image")


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


def _weights(size: int, new: int) -> np.ndarray:
    """A row for each new pixel: the shares of the old ones, by the cubic kernel, widened where the image shrinks."""
    scale = size / new
    wide = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale
    w = _cubic((np.arange(size) + 0.5 - centre[:, None]) / wide)
    return w / w.sum(1, keepdims=True)


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Cubic interpolation along both axes, kept within 0..1."""
    if x.shape[:2] == (height, width):
        return x
    return np.clip(np.einsum("ih,hwc,jw->ijc", _weights(x.shape[0], height), x, _weights(x.shape[1], width), optimize=True), 0, 1)


def normalised(x: np.ndarray) -> np.ndarray:
    return (x - np.array(MEAN)) / np.array(DEVIATION)


def padded_resize(x: np.ndarray, size: int, key: str = "") -> np.ndarray:
    """Padded with the mean colour to a square, the image in its middle, then resized."""
    h, w, _ = x.shape
    side = max(h, w)
    square = np.empty((side, side, 3))
    square[:] = np.array(MEAN)
    top, left = (side - h) // 2, (side - w) // 2
    square[top : top + h, left : left + w] = x
    return resized(square, size, size)


def resized_center_crop(x: np.ndarray, size: int, key: str = "") -> np.ndarray:
    """The shorter side resized, then the middle square."""
    h, w, _ = x.shape
    new_h, new_w = (size, max(size, int(size * w / h))) if h <= w else (max(size, int(size * h / w)), size)
    x = resized(x, new_h, new_w)
    top, left = int(round((new_h - size) / 2)), int(round((new_w - size) / 2))
    return x[top : top + size, left : left + size]


def random_resized_crop(x: np.ndarray, size: int, key: str = "") -> np.ndarray:
    """A part of nine tenths of the area or more and of a shape between 3:4 and 4:3, resized; drawn by the key's MD5, the middle if ten draws do not fit."""
    h, w, _ = x.shape
    for draw in range(10):
        a, b, c, d = (int(md5(f"{key}:{draw}:{i}".encode()).hexdigest()[:8], 16) / 2**32 for i in range(4))
        area, shape = h * w * (0.9 + 0.1 * a), np.exp(np.log(0.75) + b * (np.log(4 / 3) - np.log(0.75)))
        cut_w, cut_h = int(round(np.sqrt(area * shape))), int(round(np.sqrt(area / shape)))
        if 0 < cut_w <= w and 0 < cut_h <= h:
            top, left = int(c * (h - cut_h + 1)), int(d * (w - cut_w + 1))
            return resized(x[top : top + cut_h, left : left + cut_w], size, size)
    side = min(h, w)
    top, left = (h - side) // 2, (w - side) // 2
    return resized(x[top : top + side, left : left + side], size, size)


#: Transforms by name.
TRANSFORMS: dict[str, Callable[[np.ndarray, int, str], np.ndarray]] = {"random_resized_crop": random_resized_crop, "resized_center_crop": resized_center_crop, "padded_resize": padded_resize}


def transformed(df: DataFrame, kind: str, size: int = 224, path: str = "path", content: str = "content", decode: Callable[[bytes], np.ndarray] = decoded) -> DataFrame:
    """(path, pixels): the image at each path as size * size * 3 normalised floats, row by row, colours last.

    A null content gives null pixels; an image that the decoder does not know stops the job.  One image at a time is in memory.
    """
    if kind not in TRANSFORMS:
        raise ValueError(f"unknown transform {kind!r}")
    work = TRANSFORMS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 16):
                part = b.iloc[at : at + 16]
                out = [None if c is None else normalised(work(decode(bytes(c)), size, p or "")).astype(np.float32).ravel() for p, c in zip(part[path], part[content], strict=True)]
                yield pd.DataFrame({"path": part[path].to_numpy(), "pixels": out})

    return df.select(path, content).mapInPandas(run, "path string, pixels array<float>")
