"""Codes from quads: homography, gray models of the border, bit samples, table lookup."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cmp_to_key

import numpy as np

from ..families import Family, rotate90
from .pixels import sample

TAG_CORNERS = np.array([[-1.0, -1.0], [1.0, -1.0], [1.0, 1.0], [-1.0, 1.0]])


def homography(corners: np.ndarray) -> np.ndarray | None:
    """The projective map from the tag square to the corners, with a last element of 1."""
    a, b = np.zeros((8, 8)), corners.reshape(8)
    for i, ((tx, ty), (px, py)) in enumerate(zip(TAG_CORNERS, corners, strict=True)):
        a[2 * i] = [tx, ty, 1, 0, 0, 0, -tx * px, -ty * px]
        a[2 * i + 1] = [0, 0, 0, tx, ty, 1, -tx * py, -ty * py]
    if not np.isfinite(a).all():
        return None
    try:
        h = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return None
    return np.append(h, 1.0).reshape(3, 3) if np.isfinite(h).all() else None


def project(h: np.ndarray, x, y) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(all="ignore"):
        z = h[2, 0] * x + h[2, 1] * y + h[2, 2]
        return (h[0, 0] * x + h[0, 1] * y + h[0, 2]) / z, (h[1, 0] * x + h[1, 1] * y + h[1, 2]) / z


@dataclass
class Match:
    id: int
    hamming: int
    rotation: int


class CodeTable:
    """Codes by each quarter of their bits: a code within three errors shares a quarter with its own."""

    def __init__(self, family: Family, max_hamming: int):
        self.codes, self.nbits, self.most = family.codes, family.layout.nbits, max_hamming
        self.width = -(-self.nbits // 4)
        mask = (1 << self.width) - 1
        self.parts: list[dict[int, np.ndarray]] = []
        for j in range(4):
            val = (self.codes >> np.uint64(j * self.width)) & np.uint64(mask)
            order = np.argsort(val, kind="stable")
            keys, first = np.unique(val[order], return_index=True)
            self.parts.append({int(k): ids for k, ids in zip(keys, np.split(order, first[1:]), strict=True)} if len(keys) else {})

    def find(self, code: int) -> Match | None:
        """The first hit by rotation, quarter and id."""
        for rotation in range(4):
            for j, part in enumerate(self.parts):
                ids = part.get((code >> (j * self.width)) & ((1 << self.width) - 1))
                if ids is not None:
                    far = np.bitwise_count(self.codes[ids] ^ np.uint64(code))
                    hit = np.flatnonzero(far <= self.most)
                    if len(hit):
                        return Match(int(ids[hit[0]]), int(far[hit[0]]), rotation)
            code = int(rotate90(code, self.nbits))
        return None


def gray_plane(x: np.ndarray, y: np.ndarray, gray: np.ndarray) -> np.ndarray:
    """Least squares for gray = a x + b y + c; zeros where the samples leave it open."""
    j = np.stack([x, y, np.ones_like(x)], 1)
    a = j.T @ j
    if len(x) < 3 or abs(np.linalg.det(a)) < 1e-12:
        return np.zeros(3)
    return np.linalg.solve(a, j.T @ gray)


class Reader:
    """Reads the codes of one family."""

    def __init__(self, family: Family, max_hamming: int = 2):
        lay = family.layout
        self.family, self.table = family, CodeTable(family, max_hamming)
        w = self.width = lay.border_width
        k = np.arange(w) + 0.5
        outer, inner = [(-0.5, True), (w + 0.5, True)], [(0.5, False), (w - 0.5, False)]
        lines = [(np.full(w, c), k, white) for c, white in outer + inner] + [(k, np.full(w, c), white) for c, white in outer + inner]
        self.bx, self.by = (2 * (np.concatenate([ln[i] for ln in lines]) / w - 0.5) for i in (0, 1))
        self.white = np.concatenate([np.full(w, ln[2]) for ln in lines])
        bits = np.array(lay.bits())
        self.tx, self.ty = (2 * ((bits[:, i] + 0.5) / w - 0.5) for i in (0, 1))
        self.gx, self.gy = bits[:, 0] + lay.border_start, bits[:, 1] + lay.border_start
        self.inside = (self.gx >= 1) & (self.gx + 1 < lay.size) & (self.gy >= 1) & (self.gy + 1 < lay.size)

    def planes(self, img: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gray planes of the border's white and black sides, over the marker's square."""
        height, width = img.shape
        px, py = project(h, self.bx, self.by)
        on = (px >= 0) & (py >= 0) & (px < width - 1) & (py < height - 1)
        gray = sample(img, px[on], py[on])
        light, dark = (gray_plane(self.bx[on][m], self.by[on][m], gray[m]) for m in (self.white[on], ~self.white[on]))
        return light, dark

    def samples(self, img: np.ndarray, h: np.ndarray, planes: tuple[np.ndarray, np.ndarray], sharpening: float) -> np.ndarray | None:
        """Each bit's gray value beyond the middle of the planes, sharpened; None where some bit lies nowhere."""
        lay = self.family.layout
        px, py = project(h, self.tx, self.ty)
        if not (np.isfinite(px).all() and np.isfinite(py).all() and max(np.abs(px).max(), np.abs(py).max()) < 1e9):
            return None
        middle = (planes[0] + planes[1]) / 2
        v = sample(img, px, py) - (middle[0] * self.tx + middle[1] * self.ty + middle[2])
        if sharpening > 0 and lay.size >= 3:
            grid = np.zeros((lay.size, lay.size))
            grid[self.gy, self.gx] = v
            x, y = self.gx[self.inside], self.gy[self.inside]
            v = v.copy()
            v[self.inside] += sharpening * (4 * grid[y, x] - grid[y - 1, x] - grid[y + 1, x] - grid[y, x - 1] - grid[y, x + 1])
        return v

    def read(self, img: np.ndarray, h: np.ndarray, sharpening: float) -> tuple[Match, float] | None:
        planes = self.planes(img, h)
        light, dark = planes[0][2], planes[1][2]
        if not (light < dark if self.family.layout.reversed_border else light > dark):
            return None
        v = self.samples(img, h, planes, sharpening)
        if v is None:
            return None
        code, margin = code_of(v)
        found = self.table.find(code)
        return (found, margin) if found else None


def code_of(v: np.ndarray) -> tuple[int, float]:
    """The code of bit samples, the first the highest bit, and the decision margin."""
    up, down = v[v > 0], -v[v <= 0]
    return int("".join("01"[b] for b in (v > 0).astype(int)), 2), float(np.float32(min(up.sum() / (len(up) + 1), down.sum() / (len(down) + 1))))


def overlap(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two convex quads touch: no side's normal separates them."""
    for poly in (p, q):
        edge = np.roll(poly, -1, 0) - poly
        normal = np.stack([-edge[:, 1], edge[:, 0]])
        a, b = p @ normal, q @ normal
        if ((a.max(0) < b.min(0)) | (b.max(0) < a.min(0))).any():
            return False
    return True


def better(a: dict, b: dict) -> bool:
    if a["hamming"] != b["hamming"]:
        return a["hamming"] < b["hamming"]
    if abs(a["decision_margin"] - b["decision_margin"]) > 1e-6:
        return a["decision_margin"] > b["decision_margin"]
    for x, y in zip(np.ravel(a["corners"]), np.ravel(b["corners"]), strict=True):
        if abs(x - y) > 1e-10:
            return bool(x < y)
    return False


def deduplicate(found: list[dict]) -> list[dict]:
    """Of detections of one marker that touch, the better stays: each in turn takes in what is left of the others."""
    rest, out = list(found), []
    while rest:
        best = rest.pop(0)
        keep = []
        for other in rest:
            if (other["family"], other["id"]) == (best["family"], best["id"]) and overlap(best["corners"], other["corners"]):
                if better(other, best):
                    best = other
            else:
                keep.append(other)
        rest = keep
        out.append(best)
    return out


def apart(found: list[dict]) -> list[dict]:
    """Of detections that touch, of whatever markers, the best stays: a worse one is a misread part of its marker, or its
    square misread by another family."""
    kept: list[dict] = []
    for d in sorted(found, key=cmp_to_key(lambda a, b: -1 if better(a, b) else int(better(b, a)))):
        if not any(overlap(d["corners"], k["corners"]) for k in kept):
            kept.append(d)
    return kept
