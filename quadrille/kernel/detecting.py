"""From a gray image to its markers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..families import CANDIDATES, Family, as_family
from . import decoding, pixels, quads, regions


@dataclass(frozen=True)
class Config:
    """families: names or, with codes that no name gives, Family objects; max_candidates is for families by name.
    apart: markers don't touch, so of touching detections only the best is one; else this holds for each marker alone."""

    families: tuple[str | Family, ...] = ("tag36h11",)
    quad_decimate: float = 2.0
    quad_sigma: float = 0.0
    refine_edges: bool = True
    decode_sharpening: float = 0.25
    max_hamming: int = 2
    min_cluster_pixels: int = 5
    max_nmaxima: int = 10
    cos_critical_rad: float = float(np.cos(np.float32(np.radians(10.0))))
    max_line_fit_mse: float = 10.0
    min_white_black_diff: int = 5
    deglitch: bool = False
    max_candidates: int | None = CANDIDATES
    apart: bool = False


class Detector:
    def __init__(self, config: Config = Config()):
        self.config = config
        self.readers = [decoding.Reader(as_family(f, config.max_candidates), config.max_hamming) for f in config.families]
        self.borders = {r.family.layout.reversed_border for r in self.readers}

    def quads(self, img: np.ndarray) -> list[tuple[np.ndarray, bool]]:
        """Corners, in the image's own coordinates, and whether the border is white on black."""
        c = self.config
        small = pixels.smooth(pixels.decimate(img, c.quad_decimate), c.quad_sigma)
        ternary = pixels.binarize(small, c.min_white_black_diff, c.deglitch)
        points = regions.edge_points(ternary, *regions.label(ternary))
        h, w = small.shape
        out = []
        for p in regions.clusters(points, max(24, c.min_cluster_pixels)):
            if len(p) > 4 * (w + h):
                continue
            turn = quads.direction(p)
            if abs(turn) < np.finfo(float).eps or (turn < 0) not in self.borders:
                continue
            q = quads.fit(p, c.max_nmaxima, c.cos_critical_rad, c.max_line_fit_mse)
            if q is not None:
                out.append((q * max(1, int(c.quad_decimate)), turn < 0))
        return out

    def detect(self, img: np.ndarray) -> list[dict]:
        c, out = self.config, []
        for q, reversed_border in self.quads(img):
            if c.refine_edges:
                q = quads.refine(img, q, reversed_border, c.quad_decimate, pixels.sample)
            h = decoding.homography(q)
            if h is None:
                continue
            for r in self.readers:
                if r.family.layout.reversed_border == reversed_border and (found := r.read(img, h, c.decode_sharpening)):
                    match, margin = found
                    turned = np.roll(decoding.TAG_CORNERS, -match.rotation, 0)
                    corners = np.stack(decoding.project(h, turned[:, 0], turned[:, 1]), 1)
                    center = [float(v) for v in decoding.project(h, 0.0, 0.0)]
                    out.append({"family": r.family.name, "id": match.id, "hamming": match.hamming, "decision_margin": margin, "center": center, "corners": corners})
        out = decoding.deduplicate(out)
        return decoding.apart(out) if c.apart else out
