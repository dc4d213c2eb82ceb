"""Small numpy kernels on stacks of equal-shaped images: arrays of shape (images, height, width, channels).

They run inside Arrow UDFs; Spark decides which images meet in a batch.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Grey weights, the picture-hash grid, and the unsharp mask settings.
GREY_WEIGHTS = (0.299, 0.587, 0.114)
HASH_COLUMNS, HASH_ROWS = 9, 8
SHARPEN_RADIUS, SHARPEN_PERCENT, SHARPEN_THRESHOLD = 2.0, 150, 3


def mean_grey(a: np.ndarray) -> np.ndarray:
    return a[..., :3].astype(np.float64).mean(axis=-1)


def weighted_grey(a: np.ndarray) -> np.ndarray:
    if a.shape[-1] < 3:
        a = np.repeat(a[..., :1], 3, axis=-1)
    f = a.astype(np.float64)
    return GREY_WEIGHTS[0] * f[..., 0] + GREY_WEIGHTS[1] * f[..., 1] + GREY_WEIGHTS[2] * f[..., 2]


def blur_score(grey: np.ndarray) -> np.ndarray:
    """Variance of the 4-neighbour Laplacian over interior pixels; 0 for images without an interior."""
    if min(grey.shape[1:]) < 3:
        return np.zeros(len(grey))
    sides = grey[:, :-2, 1:-1] + grey[:, 2:, 1:-1] + grey[:, 1:-1, :-2] + grey[:, 1:-1, 2:]
    return (sides - 4 * grey[:, 1:-1, 1:-1]).var(axis=(1, 2))


def _cells(size: int, count: int) -> list[slice]:
    """Borders of the hash grid along one side, sampled with a step of an eighth of the cell."""
    starts = [i * size // count for i in range(count + 1)]
    out = []
    for lo, hi in zip(starts[:-1], starts[1:]):
        hi = max(lo + 1, hi)
        out.append(slice(lo, hi, max(1, (hi - lo) // 8)))
    return out


def difference_hash(a: np.ndarray) -> np.ndarray:
    """64 bits per image: is a grid cell brighter than its right neighbour, row by row, highest bit first."""
    grey = weighted_grey(a)
    rows, cols = _cells(a.shape[1], HASH_ROWS), _cells(a.shape[2], HASH_COLUMNS)
    grid = np.stack([np.stack([grey[:, r, c].mean(axis=(1, 2)) for c in cols], axis=1) for r in rows], axis=1)
    bits = (grid[:, :, :-1] > grid[:, :, 1:]).reshape(len(a), 64)
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64).ravel()


def to_rgb(a: np.ndarray) -> np.ndarray:
    return np.repeat(a, 3, axis=-1) if a.shape[-1] == 1 else a[..., :3]


def to_grey(a: np.ndarray) -> np.ndarray:
    return a if a.shape[-1] == 1 else weighted_grey(a).astype(np.uint8)[..., None]


def to_bgr(a: np.ndarray) -> np.ndarray:
    return to_rgb(a)[..., ::-1]


def brighten(a: np.ndarray, factor: float, rounding: str = "truncate") -> np.ndarray:
    out = a.astype(np.float64)
    colours = min(3, a.shape[-1])
    out[..., :colours] *= factor
    out = np.clip(out, 0, 255)
    return (np.rint(out) if rounding == "nearest" else out).astype(np.uint8)


def _along(f: np.ndarray, axis: int, weights: np.ndarray) -> np.ndarray:
    return np.moveaxis(np.tensordot(f, weights, axes=([axis], [1])), -1, axis)


def gaussian_weights(size: int, sigma: float) -> np.ndarray:
    """Square matrix of a Gaussian blur along one side; values beyond the border repeat the edge."""
    reach = int(np.ceil(sigma * 3))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    w = np.zeros((size, size))
    at = np.clip(np.arange(size)[:, None] + np.arange(-reach, reach + 1)[None, :], 0, size - 1)
    np.add.at(w, (np.arange(size)[:, None], at), kernel / kernel.sum())
    return w


def sharpen(a: np.ndarray) -> np.ndarray:
    """Unsharp mask; alpha is left alone."""
    f = a.astype(np.float64)
    soft = _along(_along(f, 1, gaussian_weights(a.shape[1], SHARPEN_RADIUS)), 2, gaussian_weights(a.shape[2], SHARPEN_RADIUS))
    diff = f - soft
    crisp = np.where(np.abs(diff) > SHARPEN_THRESHOLD, f + diff * SHARPEN_PERCENT / 100, f)
    if a.shape[-1] == 4:
        crisp[..., 3] = f[..., 3]
    return np.clip(np.rint(crisp), 0, 255).astype(np.uint8)


def lanczos_weights(size: int, new: int) -> np.ndarray:
    """Resampling matrix (new, size) of the Lanczos-3 filter, widened when shrinking."""
    scale = size / new
    wide = max(1.0, scale)
    x = (np.arange(size)[None, :] + 0.5 - (np.arange(new)[:, None] + 0.5) * scale) / wide
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(a: np.ndarray, width: int, height: int) -> np.ndarray:
    out = _along(_along(a.astype(np.float64), 1, lanczos_weights(a.shape[1], height)), 2, lanczos_weights(a.shape[2], width))
    return np.clip(np.rint(np.round(out, 9)), 0, 255).astype(np.uint8)


def bmp_bytes(a: np.ndarray) -> bytes:
    """One image as a 24-bit BMP: rows from the bottom, padded to 4 bytes."""
    h, w = a.shape[:2]
    body = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    body[:, : w * 3] = to_bgr(a)[::-1].reshape(h, w * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + body.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def png_bytes(a: np.ndarray) -> bytes:
    """One image as a PNG with its own channels."""
    h, w, c = a.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(a).reshape(h, w * c)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def tiff_bytes(a: np.ndarray) -> bytes:
    """One image as an uncompressed TIFF with one strip."""
    h, w, c = a.shape
    tags = [
        (256, 4, 1, w), (257, 4, 1, h), (258, 3, c, 8), (259, 3, 1, 1), (262, 3, 1, 2 if c >= 3 else 1), (273, 4, 1, 0),
        (277, 3, 1, c), (278, 4, 1, h), (279, 4, 1, a.size),
    ] + ([(338, 3, 1, 2)] if c == 4 else [])
    depths = 8 + 2 + 12 * len(tags) + 4
    pixels = depths + 2 * c
    out = struct.pack("<2sHIH", b"II", 42, 8, len(tags))
    for tag, kind, count, value in tags:
        if tag == 273:
            value = pixels
        elif tag == 258 and c > 2:
            value = depths
        out += struct.pack("<HHII", tag, kind, count, value)
    return out + struct.pack("<I", 0) + struct.pack(f"<{c}H", *[8] * c) + np.ascontiguousarray(a).tobytes()


ENCODERS = {".bmp": bmp_bytes, ".png": png_bytes, ".tif": tiff_bytes, ".tiff": tiff_bytes}
