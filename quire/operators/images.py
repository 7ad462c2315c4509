"""Greyscale images as bytes: PNG written and read, checks of decoded pixels, and the degradations of the robustness set.

Everything is numpy over one image at a time, in an Arrow pass. There is no imaging library and no font: a line is drawn
as a code that the stub adapter can read back (`drawn`), not as letters.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"
PAPER, INK = 249, 22
BITS, CELL, MARGIN = 21, 2, 20  # rows of a character's column; pixels of a bit; pixels around the line


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit greyscale PNG."""
    height, width = image.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.astype(np.uint8)], axis=1)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 9)) + _chunk(b"IEND", b"")


CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # by colour type; palettes and 16 bits aren't read


def decode_png(data: bytes) -> np.ndarray | None:
    """The grey values of an 8-bit PNG without interlacing, by the usual luminance weights; None for anything else."""
    if data[:8] != SIGNATURE:
        return None
    at, head, body = 8, None, b""
    while at + 12 <= len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if len(part) < n or zlib.crc32(name + part) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            return None
        head = struct.unpack(">IIBBBBB", part) if name == b"IHDR" else head
        body += part if name == b"IDAT" else b""
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        return None
    width, height, channels = head[0], head[1], CHANNELS[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width * channels + 1)
    except (zlib.error, ValueError):
        return None
    out = _unfiltered(raw, channels).reshape(height, width, channels).astype(float)
    grey = out[..., 0] if channels < 3 else out[..., :3] @ np.array([0.299, 0.587, 0.114])
    return np.rint(grey).astype(np.uint8)


def _unfiltered(raw: np.ndarray, channels: int) -> np.ndarray:
    """The bytes of each row before the filter (none, left, up, mean, Paeth) that its first byte names."""
    out = np.zeros((raw.shape[0], raw.shape[1] - 1), np.uint8)
    above = np.zeros(raw.shape[1] - 1, np.int64)
    for y, row in enumerate(raw):
        kind, own = int(row[0]), row[1:].astype(np.int64)
        if kind == 2:
            own = (own + above) & 255
        elif kind == 1:
            for c in range(channels):
                own[c::channels] = np.cumsum(own[c::channels]) & 255
        elif kind in (3, 4):
            for x in range(len(own)):
                left, corner = (own[x - channels], above[x - channels]) if x >= channels else (0, 0)
                if kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner))[2]
                own[x] = (own[x] + guess) & 255
        out[y], above = own, own
    return out


def drawn(text: str, least_width: int = 360) -> np.ndarray:
    """A line as a picture: a column of cells a character, ink where a bit of its code point is set. Blank lines are paper."""
    codes = np.array([ord(c) for c in text], np.int64)
    bits = (codes[None, :] >> np.arange(BITS)[:, None] & 1).astype(np.uint8)
    cells = np.kron(bits, np.ones((CELL, CELL), np.uint8))
    image = np.full((BITS * CELL + 2 * MARGIN, max(least_width, cells.shape[1] + 2 * MARGIN)), PAPER, np.uint8)
    image[MARGIN : MARGIN + cells.shape[0], MARGIN : MARGIN + cells.shape[1]][cells == 1] = INK
    return image


def read_back(image: np.ndarray) -> str:
    """The text of a drawn line, from the mean of each cell; it ends at the first column without ink."""
    inner = image[MARGIN : MARGIN + BITS * CELL, MARGIN : image.shape[1] - MARGIN].astype(float)
    n = inner.shape[1] // CELL
    cells = inner[:, : n * CELL].reshape(BITS, CELL, n, CELL).mean(axis=(1, 3)) < (PAPER + INK) / 2
    codes = (cells * (1 << np.arange(BITS))[:, None]).sum(0)
    end = int(np.argmin(codes > 0)) if (codes == 0).any() else len(codes)
    return "".join(chr(c) if c < 0x110000 and not 0xD800 <= c < 0xE000 else "�" for c in codes[:end].tolist())


def specks(width: int = 640, height: int = 120, n: int = 24, seed: int = 20260714, paper: int = 236) -> np.ndarray:
    """An image without text: paper with seeded specks, a little blurred."""
    rng = np.random.default_rng(seed)
    image = np.full((height, width), paper, float)
    ys, xs = np.mgrid[:height, :width]
    for _ in range(n):
        x, y, radius, shade = rng.integers(width), rng.integers(height), rng.choice((1, 1, 2)), rng.integers(205, 231)
        image[(xs - x) ** 2 + (ys - y) ** 2 <= radius * radius] = shade
    return np.rint(gaussian(image, 0.35)).astype(np.uint8)


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Blur by a separable kernel; edges repeat."""
    r = max(1, int(3 * sigma + 0.5))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    return _convolved(_convolved(image.astype(float), kernel, 0), kernel, 1)


def _convolved(image: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    r = len(kernel) // 2
    padded = np.pad(image, [(r, r) if k == axis else (0, 0) for k in range(2)], mode="edge")
    n = image.shape[axis]
    return sum(w * np.take(padded, np.arange(k, k + n), axis) for k, w in enumerate(kernel))


def affine(image: np.ndarray, matrix: np.ndarray, shape: tuple[int, int], fill: float = PAPER) -> np.ndarray:
    """Bilinear resampling: matrix (2 x 3) takes a pixel (x, y) of the result to one of the image."""
    ys, xs = np.mgrid[: shape[0], : shape[1]]
    x, y = (m[0] * xs + m[1] * ys + m[2] for m in matrix)
    inside = (x >= 0) & (y >= 0) & (x <= image.shape[1] - 1) & (y <= image.shape[0] - 1)
    x, y = np.clip(x, 0, image.shape[1] - 1.001), np.clip(y, 0, image.shape[0] - 1.001)
    i, j = y.astype(int), x.astype(int)
    fy, fx = y - i, x - j
    src = image.astype(float)
    i1, j1 = np.minimum(i + 1, image.shape[0] - 1), np.minimum(j + 1, image.shape[1] - 1)
    out = (1 - fy) * ((1 - fx) * src[i, j] + fx * src[i, j1]) + fy * ((1 - fx) * src[i1, j] + fx * src[i1, j1])
    return np.where(inside, out, fill)


def sheared(image: np.ndarray, shear: float, fill: float = PAPER) -> np.ndarray:
    extra = int(abs(shear) * image.shape[0]) + 8
    return affine(image, np.array([[1, shear, -extra if shear > 0 else 0], [0, 1, 0]], float), (image.shape[0], image.shape[1] + extra), fill)


def rotated(image: np.ndarray, degrees: float, fill: float = PAPER) -> np.ndarray:
    """Turned about its centre, on a canvas that holds all of it."""
    t = np.deg2rad(degrees)
    c, s = np.cos(t), np.sin(t)
    h, w = image.shape
    shape = (int(np.ceil(abs(h * c) + abs(w * s))), int(np.ceil(abs(w * c) + abs(h * s))))
    cx, cy, ox, oy = (w - 1) / 2, (h - 1) / 2, (shape[1] - 1) / 2, (shape[0] - 1) / 2
    return affine(image, np.array([[c, -s, cx - c * ox + s * oy], [s, c, cy - s * ox - c * oy]]), shape, fill)


def downsampled(image: np.ndarray, factor: int) -> np.ndarray:
    """Means of factor x factor pixels, spread over them again."""
    h, w = (n // factor * factor for n in image.shape)
    small = image[:h, :w].astype(float).reshape(h // factor, factor, w // factor, factor).mean(axis=(1, 3))
    out = image.astype(float)
    out[:h, :w] = np.kron(small, np.ones((factor, factor)))
    return out


def jpeg_like(image: np.ndarray, step: float) -> np.ndarray:
    """What compression loses: cosine coefficients of 8 x 8 blocks, rounded to steps that grow with the frequency."""
    k = np.arange(8)
    basis = np.sqrt(2 / 8) * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    basis[0] /= np.sqrt(2)
    h, w = image.shape
    padded = np.pad(image.astype(float), ((0, -h % 8), (0, -w % 8)), mode="edge")
    blocks = padded.reshape(padded.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3) - 128
    quantum = step * (1 + k[:, None] + k[None, :])
    rounded = np.rint(basis @ blocks @ basis.T / quantum) * quantum
    return (basis.T @ rounded @ basis + 128).transpose(0, 2, 1, 3).reshape(padded.shape)[:h, :w]


def shadowed(image: np.ndarray, strength: float, shadow: float = 105) -> np.ndarray:
    """Blended with a shadow that deepens from left to right, and with less contrast."""
    share = strength * np.linspace(0.1, 0.4, image.shape[1])[None, :]
    return (1 - share) * image + share * shadow


def ghosted(image: np.ndarray, share: float = 0.08, sigma: float = 1.2) -> np.ndarray:
    """Bleed-through: blended with its own blurred mirror image."""
    return (1 - share) * image + share * gaussian(image[:, ::-1], sigma)


def cropped(image: np.ndarray, box: tuple[int, int, int, int], contrast: float = 1.0) -> np.ndarray:
    """The part (left, top, right, bottom), its contrast raised about its mean."""
    part = image[box[1] : box[3], box[0] : box[2]].astype(float)
    return np.clip(part.mean() + contrast * (part - part.mean()), 0, 255)


def motion(image: np.ndarray, length: int) -> np.ndarray:
    return _convolved(image.astype(float), np.full(length, 1 / length), 1)


def noisy(image: np.ndarray, sigma: float, seed: int) -> np.ndarray:
    return image + np.random.default_rng(seed).normal(0, sigma, image.shape)


#: The seven families, by severity 1 to 3 and the seed of the derived sample.
FAMILIES: dict[str, Callable[[np.ndarray, int, int], np.ndarray]] = {
    "gaussian_blur": lambda x, s, _: gaussian(x, (0.6, 1.0, 1.6)[s - 1]),
    "motion_blur": lambda x, s, _: motion(x, (3, 5, 9)[s - 1]),
    "jpeg_compression": lambda x, s, _: jpeg_like(x, (4, 10, 20)[s - 1]),
    "downsampling": lambda x, s, _: downsampled(x, (2, 3, 4)[s - 1]),
    "noise": lambda x, s, seed: noisy(x, (8, 20, 40)[s - 1], seed),
    "rotation_skew": lambda x, s, _: rotated(x, (0.5, 1.2, 2.5)[s - 1]),
    "shadow_contrast": lambda x, s, _: shadowed(x, (0.5, 1.0, 1.8)[s - 1]),
}


def degrade(image: np.ndarray, family: str, severity: int, seed: int) -> np.ndarray:
    return np.clip(np.rint(FAMILIES[family](image, severity, seed)), 0, 255).astype(np.uint8)


def rendered(samples: DataFrame) -> DataFrame:
    """samples (sample_id, reference_raw, and for derived ones corruption, severity, seed) as sample_id, content: PNG bytes."""
    degraded = {"corruption", "severity", "seed"} <= set(samples.columns)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            images = [drawn(r["reference_raw"]) if r["reference_raw"] else specks() for r in rows]
            images = [degrade(x, r["corruption"], r["severity"], r["seed"]) if degraded and r["corruption"] else x for x, r in zip(images, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), pa.array([encode_png(x) for x in images], pa.binary())], ["sample_id", "content"])

    return samples.select("sample_id", "reference_raw", *(["corruption", "severity", "seed"] if degraded else [])).mapInArrow(draw, "sample_id string, content binary")


def decoded(files: DataFrame, key: str = "sample_id") -> DataFrame:
    """Key, format (null: not a PNG that can be read), width, height, low, high of files with `content`."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [decode_png(x) if x is not None else None for x in batch.column("content").to_pylist()]
            pick = lambda f: [None if x is None or not x.size else f(x) for x in images]  # noqa: E731, B023
            columns = [pa.array(pick(lambda x: "PNG"), pa.string()), *(pa.array(pick(f), pa.int32()) for f in (lambda x: x.shape[1], lambda x: x.shape[0], lambda x: int(x.min()), lambda x: int(x.max())))]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], [key, "format", "width", "height", "low", "high"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "content").mapInArrow(look, f"`{key}` {kind}, format string, width int, height int, low int, high int")
