"""Pose of a marker from its corners: a start from the homography, then orthogonal iteration."""

from __future__ import annotations

import numpy as np

from .decoding import homography

STEPS = 50


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    """The rotations nearest to matrices."""
    u, _, vt = np.linalg.svd(m)
    flip = np.sign(np.linalg.det(u @ vt))
    u = u.copy()
    u[..., :, 2] *= flip[..., None]
    return u @ vt


def start(h: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Rotations and translations that homographies suggest. p: camera numbers, or arrays of them."""
    c = h.copy()
    c[:, 0] = (h[:, 0] - p["cx"][:, None] * h[:, 2]) / p["fx"][:, None]
    c[:, 1] = (h[:, 1] - p["cy"][:, None] * h[:, 2]) / p["fy"][:, None]
    c /= ((np.linalg.norm(c[:, :, 0], axis=1) + np.linalg.norm(c[:, :, 1], axis=1)) / 2)[:, None, None]
    a, b = c[:, :, 0], -c[:, :, 1]
    return nearest_rotation(np.stack([a, b, np.cross(a, b)], 2)), c[:, :, 2] * p["tagsize"][:, None] / 2


def iterate(rays: np.ndarray, points: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotations, translations and object-space errors after STEPS steps, for many markers at once: rays and points are
    (markers, 4, 3)."""
    f = rays[..., :, None] * rays[..., None, :] / (rays**2).sum(-1)[..., None, None]
    gap = np.eye(3) - f.mean(1)
    good = np.abs(np.linalg.det(gap)) > 1e-300
    inverse = np.linalg.inv(np.where(good[:, None, None], gap, np.eye(3)))
    center = points - points.mean(1, keepdims=True)
    seen = lambda v: np.einsum("mnij,mnj->mni", f, v)
    t = np.zeros((len(r), 3))
    for _ in range(STEPS):
        turned = points @ r.transpose(0, 2, 1)
        t = np.einsum("mij,mj->mi", inverse, (seen(turned) - turned).mean(1))
        q = seen(turned + t[:, None])
        r = nearest_rotation((q - q.mean(1, keepdims=True)).transpose(0, 2, 1) @ center)
    at = points @ r.transpose(0, 2, 1) + t[:, None]
    return r, t, ((at - seen(at)) ** 2).sum((1, 2))


def estimate_all(corners: np.ndarray, p: dict) -> list[dict]:
    """For each marker (corners: markers, 4, 2; p: arrays of camera numbers) the better pose and the other local minimum:
    rotation, translation, error, and the same with alt_. Corners without a homography have the error of the largest
    number."""
    most = float(np.finfo(float).max)
    found = [homography(c) for c in corners]
    out = [{"rotation": np.eye(3), "translation": np.array([0.0, 0.0, 1.0]), "error": most, "alt_rotation": None, "alt_translation": None, "alt_error": most} for _ in corners]
    at = np.array([i for i, h in enumerate(found) if h is not None and all(np.isfinite(v[i]) and v[i] != 0 for v in (p["fx"], p["fy"]))], int)
    if not len(at):
        return out
    own = {k: np.asarray(v, float)[at] for k, v in p.items()}
    s = own["tagsize"] / 2
    points = np.array([[-1, 1, 0], [1, 1, 0], [1, -1, 0], [-1, -1, 0.0]])[None] * s[:, None, None]
    rays = np.concatenate([(corners[at] - np.stack([own["cx"], own["cy"]], 1)[:, None]) / np.stack([own["fx"], own["fy"]], 1)[:, None], np.ones((len(at), 4, 1))], 2)
    one = iterate(rays, points, start(np.stack([found[i] for i in at]), own)[0])
    far = np.linalg.norm(one[1], axis=1)
    n = one[1] / np.maximum(far, 1e-10)[:, None]
    two = iterate(rays, points, (2 * n[:, :, None] * n[:, None, :] - np.eye(3)) @ one[0])
    for k, i in enumerate(at.tolist()):
        a, b = ({"rotation": x[0][k], "translation": x[1][k], "error": float(x[2][k])} for x in (one, two))
        if far[k] < 1e-10:
            b = {"rotation": None, "translation": None, "error": most}
        elif b["error"] < a["error"]:
            a, b = b, a
        out[i] = a | {f"alt_{x}": v for x, v in b.items()}
    return out


def estimate(corners: np.ndarray, p: dict) -> dict:
    """estimate_all() for one marker."""
    return estimate_all(np.asarray(corners, float)[None], {k: np.array([float(v)]) for k, v in p.items()})[0]
