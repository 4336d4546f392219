"""Per-pixel and neighborhood operators on 8-bit gray images (height x width arrays)."""

from __future__ import annotations

import numpy as np

MAX_TAPS = 17
TILE = 4
UNKNOWN, WHITE = 127, 255


def decimate(img: np.ndarray, factor: float) -> np.ndarray:
    """Every f-th pixel of every f-th row, f the whole part of factor; partial blocks at the far edges go."""
    f = int(factor)
    if f <= 1:
        return img
    h, w = img.shape
    return img[: h // f * f : f, : w // f * f : f]


def blur_taps(sigma: float) -> np.ndarray | None:
    """The Gaussian kernel in 1/32768, or None where it has one tap only."""
    sigma = np.float32(abs(sigma))
    taps = int(np.float32(4) * sigma)
    taps += taps % 2 == 0
    if taps <= 1:
        return None
    if taps > MAX_TAPS:
        raise ValueError(f"sigma {sigma} takes {taps} taps; at most {MAX_TAPS} are allowed")
    x = np.arange(taps, dtype=np.float32) - np.float32(taps // 2)
    raw = np.exp(-x * x / (np.float32(2) * sigma * sigma)).astype(np.float32)
    total = np.float32(0)
    for v in raw:
        total += v
    return (raw / total * np.float32(32768) + np.float32(0.5)).astype(np.int64)


def blur(img: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Rows, then columns; edges repeat, and bytes are rounded in between."""
    half = len(taps) // 2
    for axis in (1, 0):
        wide = np.pad(img.astype(np.int64), [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = img.shape[axis]
        img = (sum(int(k) * np.take(wide, range(i, i + n), axis) for i, k in enumerate(taps)) + (1 << 14) >> 15).astype(np.uint8)
    return img


def smooth(img: np.ndarray, sigma: float) -> np.ndarray:
    """Blurred for a positive sigma, sharpened for a negative one."""
    taps = blur_taps(sigma) if sigma else None
    if taps is None:
        return img
    soft = blur(img, taps)
    return soft if sigma > 0 else np.clip(2 * img.astype(np.int16) - soft, 0, 255).astype(np.uint8)


def around(a: np.ndarray, pick, fill: int) -> np.ndarray:
    """pick (a minimum or maximum) over each cell's 3 x 3 neighborhood."""
    wide = np.pad(a, 1, constant_values=fill)
    h, w = a.shape
    rows = pick.reduce([wide[i : i + h] for i in range(3)])
    return pick.reduce([rows[:, i : i + w] for i in range(3)])


def binarize(img: np.ndarray, min_diff: int = 5, deglitch: bool = False) -> np.ndarray:
    """0, 255, or 127 where the neighborhood of 3 x 3 tiles has too little contrast."""
    h, w = img.shape
    th, tw = h // TILE, w // TILE
    if not (th and tw):
        return np.zeros_like(img)
    tiles = img[: th * TILE, : tw * TILE].reshape(th, TILE, tw, TILE)
    low = around(tiles.min((1, 3)), np.minimum, 255)
    high = around(tiles.max((1, 3)), np.maximum, 0)
    y, x = np.minimum(np.arange(h) // TILE, th - 1), np.minimum(np.arange(w) // TILE, tw - 1)
    middle = (low + (high - low) // 2)[y][:, x]
    flat = (high - low < min_diff)[y][:, x]
    out = np.where(flat, UNKNOWN, np.where(img > middle, WHITE, 0)).astype(np.uint8)
    return close(out) if deglitch else out


def close(img: np.ndarray) -> np.ndarray:
    """Dilation, then erosion; beyond the edge there is nothing."""
    return around(around(img, np.maximum, 0), np.minimum, 255)


def sample(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples; pixel centers lie at halves, and edges repeat."""
    h, w = img.shape
    x, y = x - 0.5, y - 0.5
    x0, y0 = np.floor(x), np.floor(y)
    fx, fy = x - x0, y - y0
    x0, y0 = x0.astype(np.int64), y0.astype(np.int64)
    xa, xb = np.clip(x0, 0, w - 1), np.clip(x0 + 1, 0, w - 1)
    ya, yb = np.clip(y0, 0, h - 1), np.clip(y0 + 1, 0, h - 1)
    return (img[ya, xa] * (1 - fx) + img[ya, xb] * fx) * (1 - fy) + (img[yb, xa] * (1 - fx) + img[yb, xb] * fx) * fy


def luma_rgba(raw: bytes, width: int, height: int) -> np.ndarray:
    """Gray from RGBA bytes, as (77 R + 150 G + 29 B) / 256."""
    p = np.frombuffer(raw, np.uint8).reshape(height, width, 4).astype(np.uint32)
    return (77 * p[..., 0] + 150 * p[..., 1] + 29 * p[..., 2] >> 8).astype(np.uint8)
