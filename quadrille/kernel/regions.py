"""Connected regions of a ternary image, and the edge points between them."""

from __future__ import annotations

import numpy as np

from .pixels import UNKNOWN, WHITE

MIN_REGION = 25
#: Neighbors across which edge points are looked for.
OFFSETS = ((1, 0), (0, 1), (-1, 1), (1, 1))
POINT = np.dtype([("key", np.int64), ("x", np.int32), ("y", np.int32), ("gx", np.int16), ("gy", np.int16)])


def settle(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node that edges (u, v) join to each of n nodes."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter
    return label


def label(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's region (its first pixel's number), and the regions' sizes at those numbers. Pixels of one value
    are joined to the four next to them, white ones to diagonal ones too, and unknown ones to none."""
    h, w = img.shape
    starts = np.ones((h, w), bool)
    starts[:, 1:] = (img[:, 1:] != img[:, :-1]) | (img[:, 1:] == UNKNOWN)
    run = np.cumsum(starts.ravel()).reshape(h, w) - 1
    first = np.flatnonzero(starts.ravel())
    pairs = []
    known, white = img != UNKNOWN, img == WHITE
    same = known[1:] & (img[1:] == img[:-1])
    pairs.append((run[1:][same], run[:-1][same]))
    for a, b in (((slice(1, None), slice(1, None)), (slice(None, -1), slice(None, -1))), ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None)))):
        both = white[a] & white[b]
        pairs.append((run[a][both], run[b][both]))
    edges = np.unique(np.concatenate([u * len(first) + v for u, v in pairs]))
    region = first[settle(len(first), edges // len(first), edges % len(first))][run]
    return region, np.bincount(region.ravel(), minlength=h * w)


def edge_points(img: np.ndarray, region: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Midpoints of black and white neighbors in regions of MIN_REGION pixels or more, in doubled coordinates, with
    the direction to white, keyed by the pair of regions. Of two crossing diagonals only the first counts."""
    h, w = img.shape
    if h < 3 or w < 3:
        return np.empty(0, POINT)
    big = size[region] >= MIN_REGION
    inner = (slice(1, h - 1), slice(1, w - 1))
    here, mine, ok = img[inner].astype(np.int16), region[inner], big[inner] & (img[inner] != UNKNOWN)
    ys, xs = np.mgrid[1 : h - 1, 1 : w - 1]
    out, hits = [], {}
    for dx, dy in OFFSETS:
        there = (slice(1 + dy, h - 1 + dy), slice(1 + dx, w - 1 + dx))
        hits[dx, dy] = ok & (here + img[there] == 255) & big[there]
    hits[-1, 1][:, 1:] &= ~hits[1, 1][:, :-1]
    n = img.size
    for dx, dy in OFFSETS:
        hit = hits[dx, dy]
        there = (slice(1 + dy, h - 1 + dy), slice(1 + dx, w - 1 + dx))
        a, b = mine[hit], region[there][hit]
        p = np.empty(len(a), POINT)
        p["key"] = np.minimum(a, b) * n + np.maximum(a, b)
        p["x"], p["y"] = 2 * xs[hit] + dx, 2 * ys[hit] + dy
        step = img[there][hit].astype(np.int16) - here[hit]
        p["gx"], p["gy"] = dx * step, dy * step
        out.append(p)
    return np.concatenate(out)


def clusters(points: np.ndarray, least: int) -> list[np.ndarray]:
    """The points of each pair of regions that has at least so many, largest first."""
    points = points[np.argsort(points["key"], kind="stable")]
    if not len(points):
        return []
    cuts = np.flatnonzero(np.diff(points["key"])) + 1
    groups = [g for g in np.split(points, cuts) if len(g) >= least]
    return sorted(groups, key=len, reverse=True)
