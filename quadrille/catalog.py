"""The scenario catalog and the sweep grid: scenes with what a detector should find in them."""

from __future__ import annotations

import math
from itertools import product

FIRST = "tag36h11"
SECOND = "tagStandard52h13"


def tag(cx: float, cy: float, scale: float = 0.0, id: int = 0, family: str = FIRST, **kw) -> dict:
    return {"family": family, "id": id, "kind": "similarity", "cx": cx, "cy": cy, "scale": scale, **kw}


def posed(cx: float, cy: float, size: float, roll: float = 0.0, tilt_x: float = 0.0, tilt_y: float = 0.0, **kw) -> dict:
    r = math.radians
    return {"family": FIRST, "id": 0, "kind": "pose", "cx": cx, "cy": cy, "size": size, "roll": r(roll), "tilt_x": r(tilt_x), "tilt_y": r(tilt_y), **kw}


def scenario(category: str, name: str, tags: list[dict], rmse: float, size: tuple[int, int] = (300, 300), distortions: list[dict] | None = None, decimate: float | None = None) -> dict:
    return {"name": name, "category": category, "width": size[0], "height": size[1], "tags": tags, "distortions": distortions or [], "max_corner_rmse": rmse, "max_rotation_error_deg": None, "quad_decimate": decimate}


def scenarios(category: str | None = None, name: str | None = None) -> list[dict]:
    """All scenarios, or those of a category and with name in theirs."""
    middle = tag(150, 150, 50)
    pct = lambda v: f"{100 * v:.0f}pct"
    alone = lambda cat, label, d, rmse: scenario(cat, label, [middle], rmse, distortions=[d])
    tilted = lambda label, rmse, **kw: scenario("perspective", f"perspective-{label}", [posed(250, 250, 100, **kw)], rmse, (500, 500))
    out = [scenario("baseline", f"baseline-{f}", [tag(150, 150, 50, family=f)], 2) for f in (FIRST, "tag16h5", "tag25h9")]
    out += [scenario("rotation", f"rotation-{d}deg", [tag(250, 250, 80, theta=math.radians(d))], 3, (500, 500)) for d in (0, 10, 15, 20, 25, 30, 45, 60, 70, 75, 80, 90)]
    out += [tilted(f"tilt-{d}deg", 5, tilt_x=d) for d in (10, 20, 30)]
    out += [tilted(f"yaw-{d}deg", 5 if d <= 40 else 8, tilt_x=d) for d in range(0, 61, 10)]
    out += [tilted(f"combined-{x}x-{y}y", 5, tilt_x=x, tilt_y=y) for x, y in ((20, 20), (30, 15))]
    for px in (16, 32, 64, 128, 200):
        side = max(3 * px, 200)
        out.append(scenario("scale", f"scale-{px}px", [tag(side / 2, side / 2, px / 2)], 3, (side, side), decimate=1.0 if px <= 32 else None))
    out += [alone("noise", f"noise-sigma{s}", {"kind": "noise", "sigma": float(s), "seed": 42}, 5) for s in (5, 10, 20, 40)]
    out += [alone("noise", f"noise-saltpepper-{pct(d)}", {"kind": "salt_pepper", "density": d, "seed": 42}, 5) for d in (0.05, 0.10)]
    out += [alone("contrast", f"contrast-{pct(f)}", {"kind": "contrast", "factor": f}, 3) for f in (0.5, 0.25, 0.1)]
    out += [
        alone("lighting", "lighting-gradient-lr", {"kind": "gradient", "direction": 0.0, "min_factor": 0.5, "max_factor": 1.5}, 3),
        alone("lighting", "lighting-vignette", {"kind": "vignette", "strength": 0.8}, 3),
        alone("lighting", "lighting-bright+60", {"kind": "brightness", "offset": 60}, 3),
        alone("lighting", "lighting-bright-80", {"kind": "brightness", "offset": -80}, 3),
    ]
    out += [alone("blur", f"blur-sigma{s}", {"kind": "blur", "sigma": float(s)}, 5) for s in (1, 2, 4)]
    five = [(100, 100), (300, 100), (500, 100), (200, 250), (400, 250)]
    ten = [(x, y) for y in (150, 500) for x in (150, 400, 650, 900, 1050)]
    turns = [0.0, 0.2, -0.15, 0.3, -0.1, 0.1, -0.25, 0.15, -0.05, 0.2]
    out += [
        scenario("multi-tag", "multi-2tags", [tag(125, 150, 40, 0), tag(375, 150, 40, 1)], 3, (500, 300)),
        scenario("multi-tag", "multi-5tags", [tag(x, y, 30, i) for i, (x, y) in enumerate(five)], 3, (600, 350)),
        scenario("multi-tag", "multi-family-2tags", [tag(150, 200, 50), tag(450, 200, 50, family=SECOND)], 3, (600, 400)),
        scenario("multi-tag", "multi-family-grid", [tag(x, y, 40, i // 2, SECOND if i % 2 else FIRST, theta=turns[i]) for i, (x, y) in enumerate(ten)], 5, (1200, 800)),
    ]
    out.append(alone("occlusion", "occlusion-10pct", {"kind": "occlude", "rect": [100, 100, 200, 115]}, 5))
    out += [scenario("decimation", f"decimation-{d:.0f}x", [tag(200, 200, 60)], 5 if d >= 4 else 3, (400, 400), decimate=d) for d in (1.0, 2.0, 4.0)]
    return [s for s in out if (category is None or s["category"] == category) and (name is None or name in s["name"])]


def grid(n: int, width: int, height: int, scale: float) -> list[tuple[float, float]]:
    """Places for n markers in rows."""
    if n == 1:
        return [(width / 2, height / 2)]
    cols = math.ceil(math.sqrt(n))
    rows = -(-n // cols)
    margin = 1.2 * scale
    step = lambda length, k: (length - 2 * margin) / (k - 1) if k > 1 else 0.0
    return [(margin + i % cols * step(width, cols), margin + i // cols * step(height, rows)) for i in range(n)]


SIZES = [(1, 500, 500, 80.0), (5, 800, 600, 50.0), (10, 1000, 800, 45.0), (25, 1280, 960, 35.0), (25, 2000, 1500, 50.0), (50, 4000, 3000, 45.0), (70, 6000, 4000, 40.0)]
NOISE = {"kind": "noise", "seed": 42}
CONDITIONS = {
    "clean": (0.0, 0.0, []),
    "rotation-30": (30.0, 0.0, []),
    "tilt-20": (0.0, 20.0, []),
    "noise-20": (0.0, 0.0, [NOISE | {"sigma": 20.0}]),
    "blur-2": (0.0, 0.0, [{"kind": "blur", "sigma": 2.0}]),
    "contrast-25": (0.0, 0.0, [{"kind": "contrast", "factor": 0.25}]),
    "combined": (15.0, 15.0, [NOISE | {"sigma": 10.0}, {"kind": "blur", "sigma": 1.0}]),
}


def sweep(full: bool = False) -> list[dict]:
    """Scenes over image sizes, families, decimation and conditions: 294 in full, else 24."""
    sizes = SIZES if full else [SIZES[i] for i in (0, 4, 6)]
    conditions = CONDITIONS if full else {k: CONDITIONS[k] for k in ("clean", "combined")}
    out = []
    for (n, width, height, scale), mode, (label, (roll, tilt, chain)), decimate in product(sizes, ("single", "mixed"), conditions.items(), (1.0, 2.0, 4.0) if full else (1.0, 2.0)):
        tags = []
        for i, (x, y) in enumerate(grid(n, width, height, scale)):
            kind = SECOND if mode == "mixed" and i % 2 else FIRST
            tags.append(posed(x, y, scale, roll, tilt, family=kind, id=i) if tilt else tag(x, y, scale / 2, i, kind, theta=math.radians(roll)))
        out.append(scenario(label, f"{n}tags-{mode}-{label}-dec{decimate:.0f}", tags, 5, (width, height), chain, decimate))
    return out
