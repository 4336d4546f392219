"""The image kernels on hand-made cases, and the scenario catalog."""

import numpy as np
import pytest

from quadrille import catalog
from quadrille.kernel import decoding, pixels, pose, quads, regions, scenes
from quadrille.kernel.detecting import Config, Detector


def test_decimate():
    a = np.arange(35, dtype=np.uint8).reshape(5, 7)
    assert pixels.decimate(a, 2).tolist() == [[0, 2, 4], [14, 16, 18]]
    assert pixels.decimate(a, 1.5) is a


def test_smooth():
    a = np.random.default_rng(0).integers(0, 256, (20, 30)).astype(np.uint8)
    assert (pixels.smooth(a, 0) == a).all() and (pixels.smooth(a, 0.2) == a).all()
    assert (pixels.smooth(np.full((9, 9), 77, np.uint8), 0.8) == 77).all()
    assert pixels.smooth(a, 1.0).std() < a.std() < pixels.smooth(a, -1.0).std()
    with pytest.raises(ValueError):
        pixels.smooth(a, 5)


def test_binarize():
    a = np.full((8, 8), 100, np.uint8)
    assert (pixels.binarize(a) == 127).all()
    a[:, 4:] = 200
    assert (pixels.binarize(a)[:, :4] == 0).all() and (pixels.binarize(a)[:, 4:] == 255).all()
    assert (pixels.binarize(np.full((3, 9), 9, np.uint8)) == 0).all()
    dot = np.full((9, 9), 255, np.uint8)
    dot[4, 4] = 0
    assert (pixels.close(dot) == 255).all()


def flood(img):
    """Regions by a plain search."""
    h, w = img.shape
    out = -np.ones((h, w), int)
    for s in range(h * w):
        if out.flat[s] >= 0:
            continue
        todo = [divmod(s, w)]
        out.flat[s] = s
        while todo:
            y, x = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    ny, nx = y + dy, x + dx
                    if 0 <= ny < h and 0 <= nx < w and out[ny, nx] < 0 and img[y, x] == img[ny, nx] != 127 and (abs(dx) + abs(dy) == 1 or img[y, x] == 255):
                        out[ny, nx] = s
                        todo.append((ny, nx))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_regions_against_search(seed):
    img = np.random.default_rng(seed).choice([0, 127, 255], (13, 17), p=[0.45, 0.1, 0.45]).astype(np.uint8)
    region, size = regions.label(img)
    want = flood(img)
    assert (region == want).all()
    assert size[region].tolist() == np.bincount(want.ravel(), minlength=img.size)[want].tolist()


def test_edge_points():
    img = np.zeros((20, 20), np.uint8)
    img[:, 10:] = 255
    p = regions.edge_points(img, *regions.label(img))
    assert set(p["x"]) == {19} and len(p) == 18 * 2 - 0 and (p["gx"] == 255).all()


def test_line_fit_and_slope():
    p = np.zeros(5, regions.POINT)
    p["x"], p["y"], p["gx"] = np.arange(5) * 2, 8, 1
    lines, mse, ok = quads.fit_lines(quads.moments(quads.prefix_moments(p), np.array([3]), np.array([1])))
    assert ok[0] and mse[0] < 1e-9 and abs(abs(lines[0, 3]) - 1) < 1e-9
    t = np.linspace(0.01, 2 * np.pi - 0.01, 300)
    key = quads.slope(np.cos(t), np.sin(t))
    assert (np.diff(key) > 0).all() and key.min() >= 0 and key.max() < 4
    assert np.isnan(quads.slope(np.zeros(1), np.zeros(1))).all()


def test_homography_round_trip():
    q = np.array([[10, 12], [90, 20], [80, 95], [5, 70.0]])
    h = decoding.homography(q)
    x, y = decoding.project(h, decoding.TAG_CORNERS[:, 0], decoding.TAG_CORNERS[:, 1])
    assert np.allclose(np.stack([x, y], 1), q)
    assert decoding.homography(np.zeros((4, 2))) is None


def test_code_table_against_scan():
    from quadrille.families import family, rotate90

    f = family("tag25h9")
    table = decoding.CodeTable(f, 3)
    rng = np.random.default_rng(1)
    for _ in range(200):
        i, turns = rng.integers(len(f.codes)), rng.integers(4)
        code = int(f.codes[i])
        for b in rng.choice(25, rng.integers(0, 5), replace=False):
            code ^= 1 << int(b)
        for _ in range(turns):
            code = int(rotate90(code, 25))
        got = table.find(code)
        near, seen = None, code
        for r in range(4):
            d = np.bitwise_count(f.codes ^ np.uint64(seen))
            if d.min() <= 3:
                near = (int(d.argmin()), int(d.min()), r)
                break
            seen = int(rotate90(seen, 25))
        assert (got and (got.id, got.hamming, got.rotation)) == near


def test_overlap_and_dedup():
    box = lambda x, y, ham, m: {"family": "f", "id": 1, "hamming": ham, "decision_margin": m, "corners": np.array([[x, y], [x + 10, y], [x + 10, y + 10], [x, y + 10.0]])}
    assert decoding.overlap(box(0, 0, 0, 1)["corners"], box(10, 0, 0, 1)["corners"])
    assert not decoding.overlap(box(0, 0, 0, 1)["corners"], box(10.1, 0, 0, 1)["corners"])
    kept = decoding.deduplicate([box(0, 0, 1, 5), box(5, 5, 0, 1), box(40, 0, 0, 1)])
    assert [(d["hamming"], d["corners"][0, 0]) for d in kept] == [(0, 5.0), (0, 40.0)]
    assert decoding.deduplicate([]) == []


def test_uniform_against_loop():
    state, want = 43, []
    for _ in range(20):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        want.append((state >> 11) / (1 << 53))
    assert scenes.uniform(20, 42).tolist() == want


def test_counts():
    assert len(catalog.scenarios()) == 56 and len(catalog.sweep()) == 24 and len(catalog.sweep(True)) == 294
    assert len(catalog.scenarios("noise")) == 6 and len(catalog.scenarios(name="yaw")) == 7


def nearest(found, place, truth):
    mine = [d["corners"] for d in found if (d["family"], d["id"]) == (place["family"], place["id"])]
    return min((np.sqrt(((np.roll(c, -k, 0) - truth["corners"]) ** 2).sum(1).mean()) for c in mine for k in range(4)), default=np.inf)


@pytest.mark.parametrize("scenario", catalog.scenarios(), ids=lambda s: s["name"])
def test_catalog(scenario):
    names = tuple(dict.fromkeys(t["family"] for t in scenario["tags"]))
    found = Detector(Config(families=names, quad_decimate=scenario["quad_decimate"] or 2.0)).detect(scenes.build(scenario))
    for place in scenario["tags"]:
        assert nearest(found, place, scenes.truth(place)) <= scenario["max_corner_rmse"]


@pytest.mark.parametrize("name", ["tagCircle21h7", "tagCircle49h12", "tagCustom48h12", "tagStandard41h12", "tag16h5"])
def test_every_family_is_read_in_every_turn(name):
    for turn in range(4):
        place = catalog.tag(150, 150, 60, 2, name, theta=np.pi / 2 * turn + 0.05)
        found = Detector(Config(families=(name,))).detect(scenes.build({"width": 300, "height": 300, "tags": [place]}))
        assert [d["id"] for d in found] == [2]
        assert np.abs(found[0]["corners"] - scenes.truth(place)["corners"]).max() < 2


def test_blank_and_tiny_images():
    for img in (np.zeros((1, 1), np.uint8), np.zeros((0, 0), np.uint8), np.full((50, 50), 9, np.uint8)):
        assert Detector().detect(img) == []


def test_pose_of_a_camera():
    p = {"tagsize": 0.2, "fx": 600.0, "fy": 610.0, "cx": 320.0, "cy": 240.0}
    r = scenes.rotation(0.3, 0.4, -0.2) @ np.diag([1, -1, -1.0])
    t = np.array([0.05, -0.1, 1.5])
    s = 0.1
    at = np.array([[-s, s, 0], [s, s, 0], [s, -s, 0], [-s, -s, 0]]) @ r.T + t
    corners = at[:, :2] / at[:, 2:] * [600, 610] + [320, 240]
    found = pose.estimate(corners, p)
    assert np.allclose(found["rotation"], r, atol=1e-6) and np.allclose(found["translation"], t, atol=1e-6)
    assert found["error"] < 1e-12 <= found["alt_error"]
    assert pose.estimate(np.zeros((4, 2)), p)["alt_rotation"] is None
