"""Quads from clusters of edge points: order by angle, find corners by line-fit errors, fit four lines."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

WEIGHTS = np.array([[1.0, 256.0], [256.0, np.sqrt(2 * 255.0**2) + 1]])


def direction(p: np.ndarray) -> float:
    """Positive where gradients point away from the cluster's center."""
    x, y = p["x"].astype(float), p["y"].astype(float)
    return float((x - x.mean()) @ p["gx"] + (y - y.mean()) @ p["gy"])


def slope(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """A key in [0, 4) that rises with the angle, in single precision."""
    ax, ay = np.abs(dx), np.abs(dy)
    with np.errstate(invalid="ignore"):
        up, across = ay / (ax + ay), ax / (ax + ay)
    key = np.where(dy > 0, np.where(dx > 0, up, 1 + across), np.where(dx < 0, 2 + up, 3 + across))
    return key.astype(np.float32)


def by_angle(p: np.ndarray) -> np.ndarray:
    cx = (int(p["x"].min()) + int(p["x"].max())) / 2 + 0.05118
    cy = (int(p["y"].min()) + int(p["y"].max())) / 2 - 0.028581
    key = slope(p["x"] - cx, p["y"] - cy)
    return p[np.lexsort((p["gy"], p["gx"], p["x"], p["y"], key))]


def prefix_moments(p: np.ndarray) -> np.ndarray:
    """Running sums of w x, w y, w xx, w xy, w yy, w, with a row of zeros first."""
    x, y = p["x"] * 0.5 + 0.5, p["y"] * 0.5 + 0.5
    w = WEIGHTS[(p["gx"] != 0).astype(int), (p["gy"] != 0).astype(int)]
    rows = np.stack([w * x, w * y, w * x * x, w * x * y, w * y * y, w], 1)
    return np.concatenate([np.zeros((1, 6)), np.cumsum(rows, 0)])


def moments(sums: np.ndarray, i0: np.ndarray, i1: np.ndarray) -> np.ndarray:
    """Sums over i0 to i1, both included, around the end where i0 is greater."""
    return sums[i1 + 1] - sums[i0] + np.where((i0 > i1)[..., None], sums[-1], 0.0)


def fit_lines(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines (point, normal), their mean squared error, and which could be fitted."""
    w = m[..., 5]
    with np.errstate(all="ignore"):
        ex, ey = m[..., 0] / w, m[..., 1] / w
        xx, xy, yy = m[..., 2] / w - ex * ex, m[..., 3] / w - ex * ey, m[..., 4] / w - ey * ey
        spread = np.sqrt((xx - yy) ** 2 + 4 * xy * xy)
        small, large = 0.5 * (xx + yy - spread), 0.5 * (xx + yy + spread)
        nx, ny = xy, small - xx
        flat = ~(np.hypot(nx, ny) > 1e-10)
        nx = np.where(flat, np.where(xx > yy, 0.0, 1.0), nx)
        ny = np.where(flat, np.where(xx > yy, 1.0, 0.0), ny)
        long = np.sqrt(nx * nx + ny * ny)
        lines = np.stack([ex, ey, nx / long, ny / long], -1)
    return lines, np.maximum(small, 0.0), (w >= 1e-10) & (large >= 1e-10)


@cache
def fours(n: int) -> np.ndarray:
    return np.array(list(combinations(range(n), 4)), np.int64).reshape(-1, 4)


def corners(sums: np.ndarray, max_maxima: int, cos_limit: float, max_mse: float) -> np.ndarray | None:
    """Where four lines fit the ordered points best."""
    n = len(sums) - 1
    reach = max(1, min(20, n // 12))
    i = np.arange(n)
    _, err, ok = fit_lines(moments(sums, (i - reach) % n, (i + reach) % n))
    err = np.where(ok, err, 0.0)
    if n >= 3:
        err = 0.1665 * np.roll(err, 1) + 0.6670 * err + 0.1665 * np.roll(err, -1)
    peaks = np.flatnonzero((err >= np.roll(err, 1)) & (err > np.roll(err, -1)))
    if len(peaks) < 4:
        return None
    if len(peaks) > max_maxima:
        peaks = np.sort(peaks[np.argsort(-err[peaks], kind="stable")[:max_maxima]])
        if len(peaks) < 4:
            return None
    four = peaks[fours(len(peaks))]
    lines, mse, ok = fit_lines(moments(sums, four, np.roll(four, -1, 1)))
    along = np.abs((lines[..., 2:] * np.roll(lines[..., 2:], -1, 1)).sum(-1))
    good = ok.all(1) & (mse <= max_mse).all(1) & ~(along > cos_limit).any(1)
    if not good.any():
        return None
    return four[np.argmin(np.where(good, mse.sum(1), np.inf))]


def cross(l0: np.ndarray, l1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lines meet, and whether they do."""
    det = l0[..., 3] * l1[..., 2] - l0[..., 2] * l1[..., 3]
    bx, by = l1[..., 0] - l0[..., 0], l1[..., 1] - l0[..., 1]
    with np.errstate(all="ignore"):
        t = (l1[..., 2] * bx + l1[..., 3] * by) / det
    return np.stack([l0[..., 0] + t * l0[..., 3], l0[..., 1] - t * l0[..., 2]], -1), np.abs(det) >= 0.001


def is_convex(q: np.ndarray) -> bool:
    """Whether corners turn one way only, around a positive area."""
    a, b = np.roll(q, -1, 0) - q, np.roll(q, -2, 0) - np.roll(q, -1, 0)
    area = (q[:, 0] * np.roll(q[:, 1], -1) - np.roll(q[:, 0], -1) * q[:, 1]).sum() / 2
    return bool(area >= 0 and (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0] >= 0).all())


def fit(p: np.ndarray, max_maxima: int, cos_limit: float, max_mse: float) -> np.ndarray | None:
    """A cluster's quad: its four corners, or None."""
    sums = prefix_moments(by_angle(p))
    at = corners(sums, max_maxima, cos_limit, max_mse)
    if at is None:
        return None
    lines, _, ok = fit_lines(moments(sums, at, np.roll(at, -1)))
    q, meet = cross(lines, np.roll(lines, -1, 0))
    return q if ok.all() and meet.all() and is_convex(q) else None


def refine(img: np.ndarray, q: np.ndarray, reversed_border: bool, decimation: float, sample) -> np.ndarray:
    """Corners moved to the strongest edges near the quad's sides in the full image."""
    reach = decimation + 1.0
    steps = int(2 * reach * 4)
    lines = np.zeros((4, 4))
    for e in range(4):
        a, b = q[e], q[(e + 1) % 4]
        d = b - a
        long = np.hypot(*d)
        if not long > 0:
            return q
        normal = np.array([d[1], -d[0]]) / long * (-1 if reversed_border else 1)
        n = max(16, int(long / 8))
        t = (np.arange(1, n + 1) / (n + 1))[:, None]
        base = t * b + (1 - t) * a
        off = -reach - 1 + 0.25 * np.arange(steps + 9)
        at = base[:, None, :] + off[None, :, None] * normal
        v = sample(img, at[..., 0], at[..., 1])
        inner, outer = v[:, : steps + 1], v[:, 8 : steps + 9]
        weight = np.where(outer < inner, 0.0, (inner - outer) ** 2)
        total = weight.sum(1)
        some = total >= 1e-10
        shift = (weight @ (-reach + 0.25 * np.arange(steps + 1)))[some] / total[some]
        best = base[some] + shift[:, None] * normal
        if len(best) < 2:
            lines[e] = [*((a + b) / 2), *normal]
            continue
        mid = best.mean(0)
        xx, xy, yy = (best[:, 0] ** 2).mean() - mid[0] ** 2, (best[:, 0] * best[:, 1]).mean() - mid[0] * mid[1], (best[:, 1] ** 2).mean() - mid[1] ** 2
        theta = 0.5 * np.arctan2(-2 * xy, yy - xx)
        lines[e] = [*mid, np.cos(theta), np.sin(theta)]
    found, meet = cross(lines, np.roll(lines, -1, 0))
    out = q.copy()
    for e in range(4):
        if meet[e]:
            out[(e + 1) % 4] = found[e]
    return out
