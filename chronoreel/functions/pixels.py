"""Kernels over one picture's raw bytes: colours from planes, nearest and mean scaling, crops, histograms."""

from __future__ import annotations

import numpy as np

# Bins of a channel, the side of a picture whose histogram is taken, and bytes of a pixel by format.
BINS, SIDE = 16, 64
PIXEL_BYTES = {"RGB": 3, "RGBA": 4, "BGRA": 4}


def planes_to_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Colours by whole-number BT.601 from a plane and two of half its size; the last row or column of an odd size takes
    the half planes' last."""
    rows = np.minimum(np.arange(y.shape[0]) // 2, u.shape[0] - 1)
    columns = np.minimum(np.arange(y.shape[1]) // 2, u.shape[1] - 1)
    luma = 298 * (y.astype(np.int32) - 16) + 128
    blue, red = (x.astype(np.int32)[np.ix_(rows, columns)] - 128 for x in (u, v))
    colours = np.stack([luma + 409 * red, luma - 100 * blue - 208 * red, luma + 516 * blue], axis=2)
    return np.clip(colours >> 8, 0, 255).astype(np.uint8)


def picture(data: bytes | None, width: int | None, height: int | None, kind: str | None) -> np.ndarray | None:
    """(height, width, 3) bytes of red, green and blue; None for what is no picture: no or too few bytes, sizes not above 0, an
    unknown format, or planes of less than two rows or columns.  Bytes behind the picture don't count."""
    if data is None or not width or not height or width < 0 or height < 0:
        return None
    raw, size = np.frombuffer(data, dtype=np.uint8), width * height
    if n := PIXEL_BYTES.get(kind or ""):
        if len(raw) < n * size:
            return None
        pixels = raw[: n * size].reshape(height, width, n)
        return pixels[:, :, 2::-1] if kind == "BGRA" else pixels[:, :, :3]
    half_w, half_h = width // 2, height // 2
    half = half_w * half_h
    if kind not in ("YUV420P", "NV12") or not half or len(raw) < size + 2 * half:
        return None
    y, rest = raw[:size].reshape(height, width), raw[size : size + 2 * half]
    if kind == "NV12":
        u, v = rest.reshape(half_h, half_w, 2).transpose(2, 0, 1)
    else:
        u, v = rest.reshape(2, half_h, half_w)
    return planes_to_rgb(y, u, v)


def nearest(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixel (i, j) is that at (i h / height, j w / width), rounded down."""
    h, w = pixels.shape[:2]
    return pixels[np.ix_(np.arange(height) * h // height, np.arange(width) * w // width)]


def mean_scaled(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each pixel is the rounded mean of those it covers, of one at least."""
    h, w = pixels.shape[:2]
    top, left = np.arange(height) * h // height, np.arange(width) * w // width
    bottom, right = np.maximum(top + 1, np.arange(1, height + 1) * h // height), np.maximum(left + 1, np.arange(1, width + 1) * w // width)
    sums = np.zeros((h + 1, w + 1, pixels.shape[2]), dtype=np.int64)
    sums[1:, 1:] = pixels.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    at = lambda r, c: sums[np.ix_(r, c)]
    total = at(bottom, right) - at(top, right) - at(bottom, left) + at(top, left)
    n = ((bottom - top)[:, None] * (right - left)[None, :])[:, :, None]
    return ((2 * total + n) // (2 * n)).astype(np.uint8)


def fitted(width: int, height: int, most_width: int, most_height: int) -> tuple[int, int]:
    """The largest size of the same shape within bounds; a side is one pixel at least."""
    wide = most_height * width // height
    return (max(1, wide), most_height) if wide <= most_width else (most_width, max(1, most_width * height // width))


def scaled_to_fit(pixels: np.ndarray, most_width: int, most_height: int) -> np.ndarray:
    """Scaled to ``fitted``; bounds not above 0 leave the picture as it is."""
    if most_width <= 0 or most_height <= 0:
        return pixels
    h, w = pixels.shape[:2]
    return mean_scaled(pixels, *fitted(w, h, most_width, most_height))


def cropped(pixels: np.ndarray, x: float, y: float, width: float, height: float) -> np.ndarray | None:
    """The part that a box in shares of the sides cuts out, each of its numbers rounded towards 0; None if nothing is left."""
    h, w = pixels.shape[:2]
    left, top, wide, high = int(x * w), int(y * h), int(width * w), int(height * h)
    part = pixels[max(0, top) : max(0, min(h, top + high)), max(0, left) : max(0, min(w, left + wide))]
    return part if part.size else None


def histogram(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Shares of each channel's bins, red's first, of the picture at ``side`` times ``side`` pixels."""
    small = nearest(pixels, side, side) // (256 // BINS)
    counts = [np.bincount(small[:, :, c].reshape(-1), minlength=BINS) for c in range(3)]
    return np.concatenate(counts) / (side * side)
