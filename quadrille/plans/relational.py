"""The detector's steps as relational queries over pixels, points, codes and results.

Pixels come from the embeddings table: 64 rows of 64 values are an image. Points and their clusters come from line
items, codes from orders, quads from parts. Windows and joins are always within an image, a cluster or a code, so no
step gathers a whole table in one task; tables of a family's cells, bits or codes are small and of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable

from ..families import family
from ..kernel.pixels import blur_taps


def pixels(d) -> str:
    value = "CAST(CAST(floor(abs(CAST(e AS DOUBLE)) * 1000) AS BIGINT) % 256 AS INT)"
    return f"px AS (SELECT CAST({d.div('vec_id', '64')} AS INT) AS img, CAST(vec_id % 64 AS INT) AS y, CAST(pos AS INT) AS x, {value} AS v FROM ({d.PIXELS}) s)"


def tiles(d) -> str:
    return f"tile AS (SELECT img, {d.div('y', '4')} AS ty, {d.div('x', '4')} AS tx, min(v) AS lo, max(v) AS hi FROM px GROUP BY img, {d.div('y', '4')}, {d.div('x', '4')})"


def spread(table: str, y: str, x: str, values: dict[str, str], name: str) -> str:
    """The table with a minimum or maximum over each cell's 3 x 3 neighborhood: along rows, then along columns, as both
    are separable. Beyond the edge there is nothing."""
    over = lambda along, across: f"OVER (PARTITION BY img, {across} ORDER BY {along} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
    step = lambda along, across: ", ".join(f"{f}({v}) {over(along, across)} AS {v}" for v, f in values.items())
    return f"{name}_row AS (SELECT img, {y}, {x}, {step(x, y)} FROM {table}), {name} AS (SELECT img, {y}, {x}, {step(y, x)} FROM {name}_row)"


def wide(d) -> str:
    return tiles(d) + ", " + spread("tile", "ty", "tx", {"lo": "min", "hi": "max"}, "wide")


def ternary(d) -> str:
    return wide(d) + f""", tern AS (SELECT p.img, p.y, p.x, CASE WHEN hi - lo < 5 THEN 127 WHEN v > lo + {d.div('hi - lo', '2')} THEN 255 ELSE 0 END AS v
        FROM px p JOIN wide w ON p.img = w.img AND w.ty = {d.div('p.y', '4')} AND w.tx = {d.div('p.x', '4')})"""


def blurred(d) -> str:
    a, b, _ = (int(k) for k in blur_taps(0.8))
    w = lambda by, order: f"(PARTITION BY img, {by} ORDER BY {order})"
    one = lambda src, by, order: f"SELECT img, y, x, ({a} * coalesce(lag(v) OVER {w(by, order)}, v) + {b} * v + {a} * coalesce(lead(v) OVER {w(by, order)}, v) + 16384) >> 15 AS v FROM {src}"
    return f"bh AS ({one('px', 'y', 'x')}), bl AS ({one('bh', 'x', 'y')})"


def points(d) -> str:
    """Clusters of points with gradients, numbered in a total order."""
    return f"""pt AS (SELECT l_suppkey AS c, CAST(l_partkey % 400 AS INT) AS x, CAST(l_orderkey % 300 AS INT) AS y, CASE WHEN l_linenumber % 2 = 0 THEN 255 ELSE 0 END AS gx, CASE WHEN l_quantity > 25 THEN 255 ELSE -255 END AS gy,
        CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS i FROM lineitem)"""


def weights(d) -> str:
    return points(d) + ", wp AS (SELECT c, i, CAST(x AS DOUBLE) * 0.5 + 0.5 AS px, CAST(y AS DOUBLE) * 0.5 + 0.5 AS py, CAST(CASE WHEN gx <> 0 THEN 361.62445840513925 ELSE 256.0 END AS DOUBLE) AS w FROM pt)"


def prefix(d) -> str:
    run = "OVER (PARTITION BY c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return weights(d) + f""", pre AS (SELECT c, i, CAST(sum(CAST(w AS DOUBLE)) {run} AS DOUBLE) AS w, sum(CAST(w * px AS DOUBLE)) {run} AS mx, sum(CAST(w * py AS DOUBLE)) {run} AS my,
        sum(CAST(w * px AS DOUBLE) * CAST(px AS DOUBLE)) {run} AS mxx, sum(CAST(w * px AS DOUBLE) * CAST(py AS DOUBLE)) {run} AS mxy, sum(CAST(w * py AS DOUBLE) * CAST(py AS DOUBLE)) {run} AS myy FROM wp)"""


def errors(d) -> str:
    """Whole numbers in the place of line-fit errors, so that ties and sums are exact."""
    return points(d) + ", er AS (SELECT c, i, (x * 7 + y * 13) % 1000 AS e, count(*) OVER (PARTITION BY c) AS n FROM pt)"


def peaks(d) -> str:
    o = "(PARTITION BY c ORDER BY i)"
    ends = "(PARTITION BY c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return errors(d) + f""", nb AS (SELECT c, i, e, coalesce(lag(e) OVER {o}, last_value(e) OVER {ends}) AS pe, coalesce(lead(e) OVER {o}, first_value(e) OVER {ends}) AS ne FROM er),
        mx AS (SELECT c, i, e FROM nb WHERE e >= pe AND e > ne)"""


def top(d, k: int) -> str:
    return peaks(d) + f", tk AS (SELECT c, i, e FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY e DESC, i) AS r FROM mx) s WHERE r <= {k})"


def quad(d) -> str:
    """A quad for each part."""
    k = lambda m, o: f"CAST(p_partkey * {m} % 40 AS DOUBLE) + {o}"
    return f"q AS (SELECT p_partkey AS k, {k(7, 0)} AS x0, {k(11, 0)} AS y0, {k(13, 100)} AS x1, {k(17, 0)} AS y1, {k(19, 100)} AS x2, {k(23, 100)} AS y2, {k(29, 0)} AS x3, {k(31, 100)} AS y3 FROM part)"


def codes(d, name: str = "tag16h5") -> str:
    rows = ", ".join(f"({i}, {int(c)})" for i, c in enumerate(family(name).codes))
    return f"code AS (SELECT CAST(id AS INT) AS id, CAST(code AS BIGINT) AS code FROM (VALUES {rows}) t(id, code))"


def rotated(d, v: str, bits: int = 16) -> str:
    q = bits // 4
    return f"((({v}) << {q}) & {(1 << bits) - 1} | (({v}) >> {3 * q}))"


def seen(d) -> str:
    v = "CAST(o_orderkey * 40503 % 65536 AS BIGINT)"
    one, two = rotated(d, "r0"), rotated(d, "r1")
    return f"""s0 AS (SELECT o_orderkey AS k, {v} AS r0 FROM orders), s1 AS (SELECT *, {one} AS r1 FROM s0), s2 AS (SELECT *, {two} AS r2 FROM s1), s3 AS (SELECT *, {rotated(d, 'r2')} AS r3 FROM s2),
        seen AS (SELECT k, 0 AS rot, r0 AS r FROM s3 UNION ALL SELECT k, 1, r1 FROM s3 UNION ALL SELECT k, 2, r2 FROM s3 UNION ALL SELECT k, 3, r3 FROM s3)"""


def classic_cells(d, n: int = 8) -> str:
    ring = f"least(least(x, {n - 1} - x), least(y, {n - 1} - y))"
    return f"cell AS (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CASE {ring} WHEN 0 THEN 'w' WHEN 1 THEN 'b' ELSE 'd' END AS cell FROM {d.numbers(0, n - 1, 'x')} cx CROSS JOIN {d.numbers(0, n - 1, 'y')} cy)"


def bit_cells(d, n: int = 8) -> str:
    """The data cells of the top quadrant in reading order, turned to the other three."""
    return classic_cells(d, n) + f""", quarter AS (SELECT x, y, CAST(row_number() OVER (ORDER BY y, x) - 1 AS INT) AS b FROM cell WHERE cell = 'd' AND y < {n // 2} AND x >= y AND x < {n - 1} - y),
        nq AS (SELECT CAST(count(*) AS INT) AS n FROM quarter),
        bits AS (SELECT b, x, y FROM quarter UNION ALL SELECT b + n, {n - 1} - y, x FROM quarter CROSS JOIN nq UNION ALL SELECT b + 2 * n, {n - 1} - x, {n - 1} - y FROM quarter CROSS JOIN nq UNION ALL SELECT b + 3 * n, y, {n - 1} - x FROM quarter CROSS JOIN nq)"""


def found(d) -> str:
    """Truth and detections of scenes: events of a user are an image's markers. Faint ones (by value) aren't detected, and
    bright ones are twice."""
    return """ev AS (SELECT user_id AS img, event_type AS fam, event_id AS k, value AS x FROM events),
        truth AS (SELECT *, row_number() OVER (PARTITION BY img, fam ORDER BY k) AS n FROM ev),
        det AS (SELECT *, row_number() OVER (PARTITION BY img, fam ORDER BY k, x) AS n FROM (SELECT img, fam, k, x + 1 AS x FROM ev WHERE x >= 20 UNION ALL SELECT img, fam, k, x + 2 FROM ev WHERE x >= 70) t),
        pair AS (SELECT t.img, t.fam, t.n, t.k AS tk, dt.k AS dk, (dt.x - t.x) * (dt.x - t.x) + CAST(t.k % 5 AS DOUBLE) AS sq FROM truth t LEFT JOIN det dt ON t.img = dt.img AND t.fam = dt.fam AND t.n = dt.n)"""


def reports(d) -> str:
    return found(d) + """, rep AS (SELECT img, CASE WHEN img % 3 = 0 THEN 'noise' WHEN img % 3 = 1 THEN 'blur' ELSE 'clean' END AS category, CASE WHEN img % 2 = 0 THEN 'single' ELSE 'mixed' END AS mode,
        count(*) AS expected, count(dk) AS detected, coalesce(sqrt(avg(CASE WHEN dk IS NOT NULL THEN sq END)), 0.0) AS rmse FROM pair GROUP BY img)"""


def boxes(d) -> str:
    """Detections as boxes, several of each marker in an image."""
    return f"box AS (SELECT c_custkey AS k, {d.div('c_custkey', '100')} AS img, c_custkey % 3 AS id, CAST(c_custkey * 37 % 200 AS INT) AS x, CAST(c_custkey * 91 % 200 AS INT) AS y, 40 AS w, CAST(c_custkey % 5 AS INT) AS ham FROM customer)"


def touching(d) -> str:
    """Pairs of quads of an image whose boxes meet, and on the normal of each side of either, where both lie."""
    corner = lambda q, i, c: f"{q}.{c}{i % 4}"
    low, high = (lambda q, c: f"least(least({q}.{c}0, {q}.{c}1), least({q}.{c}2, {q}.{c}3))"), (lambda q, c: f"greatest(greatest({q}.{c}0, {q}.{c}1), greatest({q}.{c}2, {q}.{c}3))")
    meet = " AND ".join(f"a.{c}l <= b.{c}h AND b.{c}l <= a.{c}h" for c in "xy")
    sides = " UNION ALL ".join(f"SELECT *, {corner(q, i, 'y')} - {corner(q, i + 1, 'y')} AS nx, {corner(q, i + 1, 'x')} - {corner(q, i, 'x')} AS ny FROM pr" for q in ("a", "b") for i in range(4)).replace("a.", "a_").replace("b.", "b_")
    at = lambda q, i: f"({q}_x{i} * nx + {q}_y{i} * ny)"
    ends = ", ".join(f"{f}({f}({at(q, 0)}, {at(q, 1)}), {f}({at(q, 2)}, {at(q, 3)})) AS {q}{n}" for q in "ab" for n, f in ((0, "least"), (1, "greatest")))
    moved = ", ".join(f"x{i} + (k % 9) * 30 AS x{i}, y{i} + (k % 7) * 25 AS y{i}" for i in range(4))
    return f"""{quad(d)}, mv AS (SELECT k, {d.div("k", "40")} AS img, {moved} FROM q),
        bx AS (SELECT *, {", ".join(f"{low('mv', c)} AS {c}l, {high('mv', c)} AS {c}h" for c in "xy")} FROM mv),
        pr AS (SELECT a.k AS a, b.k AS b, {", ".join(f"{q}.{c}{i} AS {q}_{c}{i}" for q in "ab" for c in "xy" for i in range(4))} FROM bx a JOIN bx b ON a.img = b.img AND a.k < b.k AND {meet}),
        ax AS ({sides}), apart AS (SELECT a, b, {ends} FROM ax)"""


def ring(d) -> str:
    """48 points around each part's quad, the error of the line through every one's neighborhood, around the end, and
    that smoothed."""
    sides = " UNION ALL ".join(f"SELECT k, {12 * s} + j AS i, round(x{s} + (x{(s + 1) % 4} - x{s}) * j / CAST(12 AS DOUBLE)) * 0.5 + 0.5 AS x, round(y{s} + (y{(s + 1) % 4} - y{s}) * j / CAST(12 AS DOUBLE)) * 0.5 + 0.5 AS y, CAST({361.62445840513925 if s % 2 else 256.0} AS DOUBLE) AS w FROM q CROSS JOIN {d.numbers(0, 11, 'j')} js" for s in range(4))
    sums = {"sw": "w", "sx": "w * x", "sy": "w * y", "sxx": "w * x * x", "sxy": "w * x * y", "syy": "w * y * y"}
    near = ", ".join(f"sum({e}) OVER w AS {m}" for m, e in sums.items())
    ends = "(PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    beside = f"coalesce(lag(e) OVER o, last_value(e) OVER {ends}) AS pe, coalesce(lead(e) OVER o, first_value(e) OVER {ends}) AS ne"
    return f"""{quad(d)}, rp AS (SELECT k, CAST(i AS INT) AS i, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, w FROM ({sides}) s),
        trip AS (SELECT k, i + 48 * t AS i, x, y, w FROM rp CROSS JOIN {d.numbers(-1, 1, "t")} ts),
        wm AS (SELECT k, i, {near} FROM trip WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
        er AS (SELECT k, i, round(mse, 6) AS e FROM {fitted("wm", "k, i")} we WHERE i BETWEEN 0 AND 47),
        nb AS (SELECT k, i, e, {beside} FROM er WINDOW o AS (PARTITION BY k ORDER BY i)),
        sm AS (SELECT k, i, round(CAST(0.1665 * pe + 0.667 * e + 0.1665 * ne AS DOUBLE), 10) AS e FROM nb)"""


def fitted(source: str, keys: str) -> str:
    """Mean squared error and normal of the line through weighted points, from their moments, a step at a time."""
    one = f"SELECT {keys}, sx / sw AS ex, sy / sw AS ey, sxx / sw AS mxx, sxy / sw AS mxy, syy / sw AS myy FROM {source}"
    two = f"SELECT {keys}, mxx - ex * ex AS xx, mxy - ex * ey AS xy, myy - ey * ey AS yy FROM ({one}) f1"
    three = f"SELECT *, sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) AS wide FROM ({two}) f2"
    four = f"SELECT *, 0.5 * (xx + yy - wide) AS small FROM ({three}) f3"
    return f"(SELECT *, greatest(CAST(0 AS DOUBLE), small) AS mse, xy AS vx, small - xx AS vy, sqrt(xy * xy + (small - xx) * (small - xx)) AS long FROM ({four}) f4)"


def segments(d) -> str:
    """The ten largest errors that no neighbor exceeds, and the line through the points from each to each other one,
    around the end where it lies before. Lines are grouped by their ends, of which each pair has one: conditions on
    errors, pushed below, would repeat the whole fit for each of its uses."""
    sums = {"sw": "w", "sx": "w * x", "sy": "w * y", "sxx": "w * x * x", "sxy": "w * x * y", "syy": "w * y * y"}
    run = ", ".join(f"sum({e}) OVER w AS {m}, {e} AS o{m}, sum({e}) OVER (PARTITION BY k) AS t{m}" for m, e in sums.items())
    ends = "(PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    beside = f"coalesce(lag(e) OVER o, last_value(e) OVER {ends}) AS pe, coalesce(lead(e) OVER o, first_value(e) OVER {ends}) AS ne"
    parts = ", ".join(f"q.{m} - p.{m} + p.o{m} + CASE WHEN a.i > b.i THEN p.t{m} ELSE CAST(0 AS DOUBLE) END AS {m}" for m in sums)
    return ring(d) + f""", pk AS (SELECT k, i, e FROM (SELECT k, i, e, {beside} FROM sm WINDOW o AS (PARTITION BY k ORDER BY i)) s WHERE e >= pe AND e > ne),
        tk AS (SELECT k, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY e DESC, i) AS r FROM pk) s WHERE r <= 10),
        pm AS (SELECT k, i, {run} FROM rp WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        mo AS (SELECT a.k, a.i AS a, b.i AS b, {parts} FROM tk a JOIN tk b ON a.k = b.k AND a.i <> b.i JOIN pm p ON p.k = a.k AND p.i = a.i JOIN pm q ON q.k = b.k AND q.i = b.i),
        fl AS (SELECT k, a, b, max(mse) AS mse, max(xx) AS xx, max(yy) AS yy, max(vx) AS vx, max(vy) AS vy, max(long) AS long FROM {fitted("mo", "k, a, b")} ft GROUP BY k, a, b),
        sg AS (SELECT k, a, b, mse, CASE WHEN long > 1e-10 THEN vx / long WHEN xx > yy THEN 0.0 ELSE 1.0 END AS nx, CASE WHEN long > 1e-10 THEN vy / long WHEN xx > yy THEN 1.0 ELSE 0.0 END AS ny FROM fl)"""


def combinations(d) -> str:
    """Four corners each whose sides are straight and turn enough, and their errors' sum."""
    turn = lambda s, t: f"abs({s}.nx * {t}.nx + {s}.ny * {t}.ny) <= 0.984807753012208"
    return segments(d) + f""", cb AS (SELECT s.k, s.a AS i0, t.a AS i1, u.a AS i2, v.a AS i3, s.mse + t.mse + u.mse + v.mse AS err
        FROM sg s JOIN sg t ON t.k = s.k AND t.a = s.b AND s.b > s.a JOIN sg u ON u.k = t.k AND u.a = t.b AND t.b > t.a JOIN sg v ON v.k = u.k AND v.a = u.b AND u.b > u.a AND v.b = s.a
        WHERE s.mse <= 10 AND t.mse <= 10 AND u.mse <= 10 AND v.mse <= 10 AND {turn("s", "t")} AND {turn("t", "u")} AND {turn("u", "v")} AND {turn("v", "s")})"""


OVERLAP = "a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.w AND b.y <= a.y + a.w"
HALF_UP = "CAST(least(255.0, greatest(0.0, floor({} + 0.5))) AS INT)"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


TEMPLATES: dict[str, Callable] = {
    "decimate_f2": lambda d: with_(pixels(d)) + f"SELECT img, {d.div('y', '2')} AS y, {d.div('x', '2')} AS x, v FROM px WHERE y % 2 = 0 AND x % 2 = 0",
    "blur_q15": lambda d: with_(pixels(d), blurred(d)) + "SELECT img, y, x, CAST(v AS INT) AS v FROM bl",
    "unsharp": lambda d: with_(pixels(d), blurred(d)) + "SELECT p.img, p.y, p.x, CAST(least(255, greatest(0, 2 * p.v - b.v)) AS INT) AS v FROM px p JOIN bl b ON p.img = b.img AND p.y = b.y AND p.x = b.x",
    "tile_minmax": lambda d: with_(pixels(d), tiles(d)) + "SELECT img, ty, tx, lo, hi FROM tile",
    "tile_dilate": lambda d: with_(pixels(d), wide(d)) + "SELECT img, ty, tx, lo, hi FROM wide",
    "binarize": lambda d: with_(pixels(d), ternary(d)) + "SELECT img, y, x, v FROM tern",
    "deglitch": lambda d: with_(pixels(d), ternary(d), spread("tern", "y", "x", {"v": "max"}, "dil"), spread("dil", "y", "x", {"v": "min"}, "ero")) + "SELECT img, y, x, v FROM ero",
    "edge_points": lambda d: with_(pixels(d), ternary(d), "under AS (SELECT img, y, x, v, lead(v) OVER (PARTITION BY img, x ORDER BY y) AS s FROM tern)",
        "near AS (SELECT *, lag(v) OVER w AS lv, lead(v) OVER w AS r, lag(s) OVER w AS sl, lead(s) OVER w AS sr FROM under WINDOW w AS (PARTITION BY img, y ORDER BY x))",
        "off AS (SELECT dx, dy FROM (VALUES (1, 0), (0, 1), (-1, 1), (1, 1)) t(dx, dy))",
        "nb AS (SELECT img, y, x, dx, dy, v, CASE WHEN dy = 0 THEN r WHEN dx = 0 THEN s WHEN dx = 1 THEN sr ELSE sl END AS o, dx = -1 AND x >= 2 AND lv + s = 255 AS crossed FROM near CROSS JOIN off WHERE x BETWEEN 1 AND 62 AND y BETWEEN 1 AND 62)")
    + "SELECT img, 2 * x + dx AS px, 2 * y + dy AS py, dx * (o - v) AS gx, dy * (o - v) AS gy FROM nb WHERE v + o = 255 AND NOT crossed",
    "clusters_having": lambda d: with_(pixels(d), ternary(d)) + f"SELECT img, {d.div('y', '8')} AS cy, {d.div('x', '8')} AS cx, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy FROM tern WHERE v = 255 GROUP BY img, {d.div('y', '8')}, {d.div('x', '8')} HAVING count(*) >= 24",
    "border_direction": lambda d: with_(points(d)) + "SELECT c, n, round(sxg - sx * sg / n + syg - sy * sh / n, 3) AS dot FROM (SELECT c, count(*) AS n, CAST(sum(x) AS DOUBLE) AS sx, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(gx) AS DOUBLE) AS sg, CAST(sum(gy) AS DOUBLE) AS sh, CAST(sum(x * gx) AS DOUBLE) AS sxg, CAST(sum(y * gy) AS DOUBLE) AS syg FROM pt GROUP BY c) s WHERE n >= 24",
    "angular_rank": lambda d: with_(points(d), "ct AS (SELECT c, (min(x) + max(x)) / 2.0 + 0.05118 AS cx, (min(y) + max(y)) / 2.0 - 0.028581 AS cy FROM pt GROUP BY c)",
        "dl AS (SELECT p.c, p.i, CAST(p.x AS DOUBLE) - CAST(cx AS DOUBLE) AS dx, CAST(p.y AS DOUBLE) - CAST(cy AS DOUBLE) AS dy FROM pt p JOIN ct ON p.c = ct.c)",
        "sl AS (SELECT c, i, CASE WHEN dy > 0 THEN CASE WHEN dx > 0 THEN abs(dy) / (abs(dx) + abs(dy)) ELSE 1 + abs(dx) / (abs(dx) + abs(dy)) END WHEN dx < 0 THEN 2 + abs(dy) / (abs(dx) + abs(dy)) ELSE 3 + abs(dx) / (abs(dx) + abs(dy)) END AS s FROM dl)")
    + "SELECT c, i, CAST(row_number() OVER (PARTITION BY c ORDER BY round(s, 9), i) AS BIGINT) AS rank FROM sl",
    "prefix_moments": lambda d: with_(prefix(d)) + "SELECT c, i, round(w, 3) AS w, round(mx, 2) AS mx, round(my, 2) AS my FROM pre",
    "range_line_fit": lambda d: with_(prefix(d), "rg AS (SELECT c, i, " + ", ".join(f"{m} - lag({m}, 8) OVER w AS {m}" for m in ("w", "mx", "my", "mxx", "mxy", "myy")) + " FROM pre WINDOW w AS (PARTITION BY c ORDER BY i))",
        "cv AS (SELECT c, i, mx / w AS ex, my / w AS ey, mxx / w - mx / w * mx / w AS xx, mxy / w - mx / w * my / w AS xy, myy / w - my / w * my / w AS yy FROM rg)")
    + "SELECT c, i, round(ex, 4) AS ex, round(ey, 4) AS ey, round(greatest(0.0, 0.5 * (xx + yy - sqrt((xx - yy) * (xx - yy) + 4 * xy * xy))), 3) AS mse FROM cv WHERE ex IS NOT NULL",
    "smooth_errors": lambda d: with_(peaks(d)) + "SELECT c, i, round(CAST(0.1665 * pe + 0.667 * e + 0.1665 * ne AS DOUBLE), 6) AS e FROM nb",
    "local_maxima": lambda d: with_(peaks(d)) + "SELECT c, i, e FROM mx",
    "topk_maxima": lambda d: with_(top(d, 10)) + "SELECT c, i, e FROM tk",
    "combo4": lambda d: with_(combinations(d)) + "SELECT k, i0, i1, i2, i3, round(err, 4) AS err FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(err, 6), i0, i1, i2, i3) AS r FROM cb) s WHERE r = 1",
    "window_errors": lambda d: with_(ring(d)) + "SELECT k, i, e FROM sm",
    "segment_fits": lambda d: with_(segments(d)) + "SELECT k, a, b, round(mse, 5) AS mse, round(abs(nx), 5) AS nx, round(abs(ny), 5) AS ny FROM sg",
    "homography_project": lambda d: with_(quad(d), "sd AS (SELECT *, x1 - x2 AS dx1, x3 - x2 AS dx2, x0 - x1 + x2 - x3 AS sx, y1 - y2 AS dy1, y3 - y2 AS dy2, y0 - y1 + y2 - y3 AS sy FROM q)",
        "gh AS (SELECT *, (sx * dy2 - sy * dx2) / (dx1 * dy2 - dy1 * dx2) AS g, (dx1 * sy - dy1 * sx) / (dx1 * dy2 - dy1 * dx2) AS h FROM sd)",
        "uv AS (SELECT k, u, v, x1 - x0 + g * x1 AS a, x3 - x0 + h * x3 AS b, x0 AS c0, y1 - y0 + g * y1 AS dd, y3 - y0 + h * y3 AS ee, y0 AS f, g, h FROM gh CROSS JOIN (SELECT CAST(u AS DOUBLE) AS u, CAST(v AS DOUBLE) AS v FROM (VALUES (0.5, 0.5), (0.25, 0.75)) t(u, v)) uv)")
    + "SELECT k, u, v, round((a * u + b * v + c0) / (g * u + h * v + 1), 6) AS px, round((dd * u + ee * v + f) / (g * u + h * v + 1), 6) AS py FROM uv",
    "line_intersections": lambda d: with_(quad(d), "ln AS (SELECT k, x0, y0, x2 - x0 AS ax, y2 - y0 AS ay, x1, y1, x3 - x1 AS bx, y3 - y1 AS by_ FROM q)", "dt AS (SELECT *, ax * by_ - ay * bx AS det FROM ln)")
    + "SELECT k, round(x0 + ax * ((x1 - x0) * by_ - (y1 - y0) * bx) / det, 6) AS cx, round(y0 + ay * ((x1 - x0) * by_ - (y1 - y0) * bx) / det, 6) AS cy FROM dt WHERE abs(det) >= 0.001",
    "quad_validate": lambda d: with_(quad(d)) + "SELECT k, (x0 * y1 - x1 * y0 + x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y0 - x0 * y3) / 2 AS area FROM q WHERE (x1 - x0) * (y2 - y1) - (y1 - y0) * (x2 - x1) >= 0 AND (x2 - x1) * (y3 - y2) - (y2 - y1) * (x3 - x2) >= 0 AND (x3 - x2) * (y0 - y3) - (y3 - y2) * (x0 - x3) >= 0 AND (x0 - x3) * (y1 - y0) - (y0 - y3) * (x1 - x0) >= 0",
    "rotate90": lambda d: with_(seen(d)) + "SELECT k, rot, r FROM seen",
    "hamming_pairs": lambda d: with_(codes(d)) + f"SELECT a.id AS a, b.id AS b, CAST(bit_count({d.xor('a.code', 'b.code')}) AS INT) AS distance FROM code a JOIN code b ON a.id < b.id",
    "quick_decode_join": lambda d: with_(codes(d), seen(d), f"part AS (SELECT id, code, j, (code >> CAST(4 * j AS INT)) & 15 AS val FROM code CROSS JOIN {d.numbers(0, 3, 'j')} js)", f"look AS (SELECT k, rot, r, j, (r >> CAST(4 * j AS INT)) & 15 AS val FROM seen CROSS JOIN {d.numbers(0, 3, 'j')} js)",
        f"hits AS (SELECT k, rot, l.j, p.id, CAST(bit_count({d.xor('p.code', 'l.r')}) AS INT) AS hamming FROM look l JOIN part p ON l.j = p.j AND l.val = p.val WHERE bit_count({d.xor('p.code', 'l.r')}) <= 2)")
    + "SELECT k, rot, id, hamming FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rot, j, id) AS n FROM hits) s WHERE n = 1",
    "layout_cells": lambda d: with_(classic_cells(d, 10)) + "SELECT x, y, cell FROM cell",
    "layout_symmetry": lambda d: with_(classic_cells(d, 10)) + "SELECT count(*) AS cells, count(CASE WHEN a.cell <> b.cell THEN 1 END) AS broken FROM cell a JOIN cell b ON b.x = 9 - a.y AND b.y = a.x",
    "bit_locations": lambda d: with_(bit_cells(d, 10)) + "SELECT b, x - 1 AS x, y - 1 AS y FROM bits",
    "render_cells": lambda d: with_(codes(d), bit_cells(d)) + "SELECT id, c.x, c.y, CASE cell WHEN 'w' THEN 255 WHEN 'b' THEN 0 ELSE CAST(255 * ((code >> (15 - b)) & 1) AS INT) END AS v FROM code CROSS JOIN cell c LEFT JOIN bits ON bits.x = c.x AND bits.y = c.y",
    "decode_margin": lambda d: with_("sm AS (SELECT vec_id AS k, CAST(pos AS INT) % 16 AS pos, " + d.div('CAST(pos AS INT)', '16') + " AS part, CAST(e AS DOUBLE) AS v FROM (" + d.PIXELS + ") s)")
    + "SELECT k, part, CAST(sum(CASE WHEN v > 0 THEN 1 << CAST(15 - pos AS INT) ELSE 0 END) AS BIGINT) AS code, round(least(coalesce(sum(CASE WHEN v > 0 THEN v END), 0) / (1 + count(CASE WHEN v > 0 THEN 1 END)), coalesce(-sum(CASE WHEN v <= 0 THEN v END), 0) / (1 + count(CASE WHEN v <= 0 THEN 1 END))), 6) AS margin FROM sm GROUP BY k, part",
    "top_margins": lambda d: with_("sm AS (SELECT vec_id AS k, CAST(e AS DOUBLE) AS v FROM (" + d.PIXELS + ") s)", "mg AS (SELECT k, round(least(sum(CASE WHEN v > 0 THEN v ELSE 0.0 END), -sum(CASE WHEN v <= 0 THEN v ELSE 0.0 END)), 9) AS margin FROM sm GROUP BY k)") + "SELECT k, margin FROM mg ORDER BY margin DESC, k LIMIT 100",
    "overlap_sat": lambda d: with_(touching(d)) + "SELECT a, b FROM apart GROUP BY a, b HAVING count(CASE WHEN a1 < b0 OR b1 < a0 THEN 1 END) = 0",
    "overlap_boxes": lambda d: with_(boxes(d)) + f"SELECT a.k AS a, b.k AS b FROM box a JOIN box b ON a.img = b.img AND a.id = b.id AND a.k < b.k AND {OVERLAP}",
    "dedup_best": lambda d: with_(boxes(d)) + f"SELECT k, img, id, ham FROM box a WHERE NOT EXISTS (SELECT 1 FROM box b WHERE a.img = b.img AND a.id = b.id AND a.k <> b.k AND {OVERLAP} AND (b.ham < a.ham OR (b.ham = a.ham AND b.k < a.k)))",
    "match_truth": lambda d: with_(found(d)) + "SELECT img, fam, CAST(n AS BIGINT) AS n, tk, dk FROM pair",
    "false_positives": lambda d: with_(found(d)) + "SELECT img, fam, k FROM det WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.img = det.img AND t.fam = det.fam AND t.n = det.n)",
    "rmse_by_category": lambda d: with_(reports(d)) + "SELECT category, count(*) AS images, round(avg(rmse), 6) AS rmse, round(max(rmse), 6) AS worst FROM rep GROUP BY category",
    "distinct_markers": lambda d: with_(found(d)) + "SELECT DISTINCT img, fam FROM det",
    "report_totals": lambda d: with_(reports(d)) + "SELECT count(*) AS total, count(CASE WHEN detected >= expected AND rmse <= 5 THEN 1 END) AS passed, count(CASE WHEN NOT (detected >= expected AND rmse <= 5) THEN 1 END) AS failed FROM rep",
    "subtotals": lambda d: with_(reports(d)) + "SELECT category, mode, count(*) AS images, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(detected) AS BIGINT) AS detected FROM rep GROUP BY GROUPING SETS ((category, mode), (category), (mode), ())",
    "distort_contrast": lambda d: with_(pixels(d)) + f"SELECT img, y, x, {HALF_UP.format('m + 0.25 * (v - m)')} AS v FROM (SELECT *, round(avg(v) OVER (PARTITION BY img), 6) AS m FROM px) s",
    "distort_vignette": lambda d: with_(pixels(d)) + f"SELECT img, y, x, {HALF_UP.format('v * (1 - 0.8 * ((x - 31.5) * (x - 31.5) + (y - 31.5) * (y - 31.5)) / 2048.0)')} AS v FROM px",
    "distort_gradient": lambda d: with_(pixels(d)) + f"SELECT img, y, x, {HALF_UP.format('v * (0.5 + ((x - 31.5) / 32.0 + 1) * 0.5)')} AS v FROM px",
    "distort_occlude": lambda d: with_(pixels(d)) + "SELECT img, y, x, CASE WHEN x BETWEEN 10 AND 19 AND y BETWEEN 20 AND 24 THEN 0 ELSE v END AS v FROM px",
    "distort_brightness": lambda d: with_(pixels(d)) + "SELECT img, y, x, least(255, greatest(0, v + 60)) AS v FROM px",
    "luma_rgba": lambda d: with_(pixels(d)) + f"SELECT a.img, a.y, {d.div('a.x', '4')} AS x, CAST((77 * a.v + 150 * b.v + 29 * g.v) >> 8 AS INT) AS v FROM px a JOIN px b ON a.img = b.img AND a.y = b.y AND b.x = a.x + 1 JOIN px g ON a.img = g.img AND a.y = g.y AND g.x = a.x + 2 WHERE a.x % 4 = 0",
}
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
