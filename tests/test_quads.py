"""Scoring of slanted text against a plain evaluator whose areas come from integration over strips, and convex pieces against the same."""

import math
import random

import numpy as np
import pytest

from pagelake.functions import clipping as C
from pagelake.operators import detection as D
from pagelake.operators import quads as Q

QUAD = ", ".join(f"{axis}{k} double" for k in range(1, 5) for axis in "xy")
GT, DET = f"image_id long, word_idx long, text string, {QUAD}", f"image_id long, det_idx long, {QUAD}"


def spans(ring, x):
    """Where a vertical line meets a simple polygon, as sorted pairs."""
    ys = sorted(y0 + (y1 - y0) * (x - x0) / (x1 - x0) for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]) if (x0 < x) != (x1 < x))
    return list(zip(ys[::2], ys[1::2]))


def covered(plus, minus, inside):
    """Area and moments of points in every ring of ``inside``, in some ring of ``plus`` and in none of ``minus``.

    Between two neighbouring corners or crossings the covered height is linear in x, so two Gauss points are exact.
    """
    rings = [*plus, *minus, *inside]
    edges = [(a, b) for r in rings for a, b in zip(r, r[1:] + r[:1])]
    cuts = {p[0] for r in rings for p in r}
    for i, ((ax, ay), (bx, by)) in enumerate(edges):
        for (cx, cy), (dx, dy) in edges[:i]:
            det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if det:
                t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det
                if 0 <= t <= 1:
                    cuts.add(ax + t * (bx - ax))
    area = mx = my = 0.0
    cuts = sorted(cuts)
    for x0, x1 in zip(cuts[:-1], cuts[1:]):
        if x1 - x0 < 1e-10:
            continue
        for x in ((x0 + x1) / 2 - (x1 - x0) / math.sqrt(12), (x0 + x1) / 2 + (x1 - x0) / math.sqrt(12)):
            own = {k: [spans(r, x) for r in v] for k, v in (("p", plus), ("m", minus), ("i", inside))}
            ys = sorted({y for v in own.values() for r in v for s in r for y in s})
            for y0, y1 in zip(ys[:-1], ys[1:]):
                at = lambda r: any(a <= (y0 + y1) / 2 <= b for a, b in r)  # noqa: E731, B023
                if any(map(at, own["p"])) and not any(map(at, own["m"])) and all(map(at, own["i"])):
                    h = (x1 - x0) / 2 * (y1 - y0)
                    area, mx, my = area + h, mx + h * x, my + h * (y0 + y1) / 2
    return area, mx, my


def ring(q):
    return [(float(q[k]), float(q[k + 1])) for k in range(0, 8, 2)]


def centre(r):
    a, mx, my = covered([r], [], [])
    return (mx / a, my / a) if a > 1e-9 else (sum(p[0] for p in r) / 4, sum(p[1] for p in r) / 4)


def within(x, y, r):
    side = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(r, r[1:] + r[:1])]
    return min(side) >= -1e-9 or max(side) <= 1e-9


def bent(pivots):
    for i, (mid, own) in enumerate(pivots):
        for k, (_, other) in enumerate(pivots):
            if i != k:
                u, v = ((p[0] - other[0], p[1] - other[1]) for p in (mid, own))
                u, v = (w if w != (0.0, 0.0) else (1.0, 0.0) for w in (u, v))
                if abs(u[0] * v[1] - u[1] * v[0]) >= abs(u[0] * v[0] + u[1] * v[1]):
                    return True
    return False


def plain(gts, dets, r=0.4, p=0.4):
    care = [(t, ring(q)) for t, q in gts if t != "###"]
    dcs = [ring(q) for t, q in gts if t == "###"]
    words, boxes = [q for _, q in care], [ring(q) for q in dets]
    area = lambda q: covered([q], [], [])[0]
    dc_area = [covered([q], words, [])[0] for q in dcs]
    held = [[covered([q], words, [b])[0] for q in dcs] for b in boxes]
    lost = [covered(dcs, words, [b]) for b in boxes]
    det_dc = []
    for b, h in zip(boxes, held):
        whole = area(b)
        share = lambda v: v / whole if whole > 1e-9 else 0  # noqa: E731, B023
        det_dc.append(bool(sum(h)) and (share(sum(x for x, d in zip(h, dc_area) if d > 1e-9 and x / d > r)) >= p or share(max(h)) > p))
    left = [area(b) - x[0] for b, x in zip(boxes, lost)]
    inter = [[covered([w], [], [b])[0] for b in boxes] for w in words]
    rec = [[v / area(w) if area(w) > 1e-9 else 0 for v in row] for w, row in zip(words, inter)]
    pre = [[v / x if x > 1e-9 else 0 for v, x in zip(row, left)] for row in inter]
    n, m = len(words), len(boxes)
    hit = [[rec[i][j] >= r and pre[i][j] >= p for j in range(m)] for i in range(n)]
    pivot = lambda q: (((q[0][0] + q[3][0]) / 2, (q[0][1] + q[3][1]) / 2), centre(q))
    diagonal = lambda q: (math.dist(q[0], q[2]) + math.dist(q[1], q[3])) / 2
    pairs = set()
    for j in range(m):
        own = [i for i in range(n) if rec[i][j] >= r]
        if not det_dc[j] and len(own) > 1 and sum(pre[i][j] for i in own) >= p and not bent([pivot(words[i]) for i in own]):
            pairs |= {(i, j) for i in own}
    for i in range(n):
        own = [j for j in range(m) if pre[i][j] >= p and not det_dc[j]]
        if len(own) > 1 and sum(rec[i][j] for j in own) >= r and not bent([pivot(boxes[j]) for j in own]):
            pairs |= {(i, j) for j in own}
        for j in range(m):
            if hit[i][j] and not det_dc[j] and sum(hit[i]) == 1 and sum(h[j] for h in hit) == 1:
                c, x = centre(boxes[j]), lost[j]
                if x[0] > 1e-9:
                    c = tuple((v * area(boxes[j]) - x[k + 1]) / left[j] for k, v in enumerate(c))
                if 2 * math.dist(centre(words[i]), c) / (diagonal(words[i]) + diagonal(boxes[j])) < 1:
                    pairs.add((i, j))
    recall = precision = 0.0
    inside = {}
    for i, (text, q) in enumerate(care):
        xs, ys = [v[0] for v in q], [v[1] for v in q]
        q = [q[3], *q[:3]] if max(ys) - min(ys) > 1.5 * (max(xs) - min(xs)) else q
        a, b = (((q[k][0] + q[o][0]) / 2, (q[k][1] + q[o][1]) / 2) for k, o in ((0, 3), (1, 2)))
        for c in range(len(text)):
            s = (c + 0.5) / len(text)
            inside[i, c] = {j for k, j in pairs if k == i and within(a[0] + (b[0] - a[0]) * s, a[1] + (b[1] - a[1]) * s, boxes[j])}
        recall += sum(len(inside[i, c]) == 1 for c in range(len(text))) / len(text)
    for j in range(m):
        own = [i for i, k in pairs if k == j]
        if own:
            precision += sum(j in inside[i, c] for i in own for c in range(len(care[i][0]))) / sum(len(care[i][0]) for i in own)
    return pairs, recall, precision, n, sum(not d for d in det_dc)


def slanted(rng, x, y, w, h):
    """A box turned by some angle, in whole numbers."""
    t = rng.uniform(0, math.pi / 2)
    corners = ((0, 0), (w, 0), (w, h), (0, h))
    return [round(v) for a, b in corners for v in (x + a * math.cos(t) - b * math.sin(t), y + a * math.sin(t) + b * math.cos(t))]


def page(rng):
    gts = [("###" if rng.random() < 0.35 else "w" * rng.randint(1, 7), slanted(rng, rng.randint(-20, 120), rng.randint(-20, 100), rng.randint(5, 60), rng.randint(5, 25))) for _ in range(rng.randint(0, 6))]
    dets = [slanted(rng, rng.randint(-20, 120), rng.randint(-20, 100), rng.randint(5, 60), rng.randint(5, 25)) for _ in range(rng.randint(0, 3))]
    for _, q in gts:
        if rng.random() < 0.8:
            shift = rng.randint(-3, 3)
            moved = [v + shift for v in q]
            mid = [round((moved[k] + moved[k + 2]) / 2) for k in (0, 1)] + [round((moved[4 + k] + moved[6 + k]) / 2) for k in (0, 1)]
            if rng.random() < 0.4:
                dets += [[*moved[:2], *mid, *moved[6:]], [*mid[:2], *moved[2:6], *mid[2:]]]
            else:
                dets.append(moved[::1])
    return gts, dets


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(31)
    return {i: page(rng) for i in range(60)}


def tables(spark, pages):
    gt = [(i, k, t, *map(float, q)) for i, (gts, _) in pages.items() for k, (t, q) in enumerate(gts)]
    det = [(i, k, *map(float, q)) for i, (_, dets) in pages.items() for k, q in enumerate(dets)]
    return spark.createDataFrame(gt, GT), spark.createDataFrame(det, DET)


@pytest.mark.parametrize("cell", [16, 256])
def test_scoring(spark, pages, cell):
    """Many cells a quad, and one cell a page."""
    gt, det = tables(spark, pages)
    got = {r.image_id: r for r in Q.detection_eval_quads_per_image(gt, det, empty="zero", cell=cell).collect()}
    some = 0
    for i, (gts, dets) in pages.items():
        if gts or dets:
            pairs, recall, precision, n, m = plain(gts, dets)
            some += len(pairs)
            assert (got[i].n_gt, got[i].n_det) == (n, m), i
            assert (got[i].recall_sum, got[i].precision_sum) == pytest.approx((recall, precision), abs=1e-9), i
    assert some > 60


def test_dont_care(spark, pages):
    gt, det = tables(spark, pages)
    pairs, lost = Q.subtract_dont_care_quads(gt, det, cell=40)
    pairs, lost = {(r.image_id, r.det_idx, r.word_idx): r for r in pairs.collect()}, {(r.image_id, r.det_idx): r for r in lost.collect()}
    for i, (gts, dets) in pages.items():
        words, dcs = [ring(q) for t, q in gts if t != "###"], {k: ring(q) for k, (t, q) in enumerate(gts) if t == "###"}
        for j, q in enumerate(dets):
            want = covered(list(dcs.values()), words, [ring(q)])
            row = lost.pop((i, j), None)
            assert ((row.area, row.mx, row.my) if row else (0, 0, 0)) == pytest.approx(want, abs=0.01)
            for k, region in dcs.items():
                row = pairs.pop((i, j, k), None)
                assert (row.inter if row else 0) == pytest.approx(covered([region], words, [ring(q)])[0], abs=1e-3)
                assert not row or row.dc_area == pytest.approx(covered([region], words, [])[0], abs=1e-3)
    assert not pairs and not lost


def test_upright_boxes_as_before(spark):
    """On upright boxes the pieces give the areas of the strip sweep."""
    rng = random.Random(3)
    box = lambda: (lambda x, y: (x, y, x + rng.randint(1, 30), y + rng.randint(1, 20)))(rng.randint(0, 60), rng.randint(0, 40))
    gt = [(i, k, rng.choice(["###", "ab", "abcd"]), *box()) for i in range(40) for k in range(5)]
    det = [(i, k, *box()) for i in range(40) for k in range(5)]
    axis = [spark.createDataFrame(rows, shape) for rows, shape in ((gt, "image_id long, word_idx long, text string, xmin int, ymin int, xmax int, ymax int"), (det, "image_id long, det_idx long, xmin int, ymin int, xmax int, ymax int"))]
    corner = ["xmin AS x1", "ymin AS y1", "xmax AS x2", "ymin AS y2", "xmax AS x3", "ymax AS y3", "xmin AS x4", "ymax AS y4"]
    quads = [axis[0].selectExpr("image_id", "word_idx", "text", *corner), axis[1].selectExpr("image_id", "det_idx", *corner)]
    a = sorted(map(tuple, D.subtract_dont_care(*axis)[1].selectExpr("image_id", "det_idx", "double(area)", "twice_mx / 2.0", "twice_my / 2.0").collect()))
    b = sorted(map(tuple, Q.subtract_dont_care_quads(*quads, cell=8)[1].collect()))
    assert a and a == b
    assert sorted(map(tuple, D.detection_eval_per_image(*axis, det_pivot="left").collect())) == sorted(map(tuple, Q.detection_eval_quads_per_image(*quads, cell=16).collect()))


def test_crowded_region(spark):
    """A page-wide don't-care region over 20000 words and as many detections: work stays with the cells."""
    n, side = 20_000, 5_000
    rng = np.random.default_rng(1)
    at = rng.integers(0, side, (n, 2))
    quads = (at[:, None, :] + np.array([[0, 0], [24, 6], [20, 18], [-4, 12]])).reshape(n, 8).astype(float)
    region = [-100.0, -100.0, side + 200.0, -100.0, side + 200.0, side + 200.0, -100.0, side + 200.0]
    gt = spark.createDataFrame([(1, k, "word", *q) for k, q in enumerate(quads.tolist())] + [(1, n, "###", *region)], GT)
    det = spark.createDataFrame([(1, k, *q) for k, q in enumerate(quads.tolist())], DET)
    row = Q.detection_eval_quads_per_image(gt, det, cell=128).first()
    assert row.n_gt == n and row.n_det == n and 0.3 < row.recall <= 1


def test_edge_cases(spark):
    """Flat quads, null texts, a page of one kind, a reflex corner, string ids, empty tables."""
    square, arrow, flat = (list(map(float, q)) for q in ([0, 0, 10, 0, 10, 10, 0, 10], [0, 0, 20, 0, 5, 5, 0, 20], [0, 0, 5, 5, 10, 10, 5, 5]))
    gt = spark.createDataFrame([(1, 0, None, *square), (2, 0, "a", *flat), (3, 0, "ab", *arrow), (4, 0, "###", *square)], GT)
    det = spark.createDataFrame([(1, 0, *square), (3, 0, *arrow), (4, 0, *square), (5, 0, *square)], DET)
    out = {r.image_id: r for r in Q.detection_eval_quads_per_image(gt, det).collect()}
    assert {i: (r.n_gt, r.n_det) for i, r in out.items()} == {1: (1, 1), 2: (1, 0), 3: (1, 1), 4: (0, 0), 5: (0, 1)}
    assert out[3].recall > 0 and out[2].recall == 0 and out[4].recall == 1 == out[4].precision
    named = Q.detection_eval_quads_per_image(gt.withColumn("image_id", gt.image_id.cast("string")), det.withColumn("image_id", det.image_id.cast("string")))
    assert {r.image_id: r.hmean for r in named.collect()} == {str(i): r.hmean for i, r in out.items()}
    assert Q.detection_eval_quads_per_image(gt.limit(0), det.limit(0)).count() == 0


def test_pieces():
    """Differences of random convex pieces keep their area, and pieces do not overlap."""
    rng = random.Random(6)
    for _ in range(40):
        rings = [slanted(rng, rng.randint(0, 40), rng.randint(0, 40), rng.randint(3, 50), rng.randint(3, 50)) for _ in range(5)]
        pieces, owner = C.convex_parts(np.array(rings, float).reshape(-1, 4, 2))
        if len(owner) != 5:
            continue
        left, whose = C.subtract(C.take(pieces, np.arange(1)), np.zeros(1, int), C.take(pieces, np.arange(1, 5)), np.array([0]), np.array([4]))
        want = covered([ring(rings[0])], [ring(q) for q in rings[1:]], [])
        assert [v.sum() for v in C.measures(left)] == pytest.approx(list(want), abs=1e-6)
        shared = C.measures(C.overlap(C.take(pieces, np.zeros(4, int)), C.take(pieces, np.arange(1, 5))))[0]
        assert shared.tolist() == pytest.approx([covered([ring(rings[0])], [], [ring(q)])[0] for q in rings[1:]], abs=1e-6)


def test_centroid_is_worked_out_once(spark):
    """Scaled polygons: the centre is read by every coordinate and computed once; rings without area or with nulls move down."""
    from pagelake.functions import geometry as G

    data = [(0.0, 0.0, 4.0, 0.0, 4.0, 2.0, 0.0, 2.0), (0.0, 0.0, 5.0, 1.0, 7.0, 6.0, 1.0, 3.0), (1.0, 1.0, 2.0, 2.0, 3.0, 3.0, 4.0, 4.0), (None, 0.0, 4.0, 0.0, 4.0, 2.0, 0.0, 2.0)]
    quads = spark.createDataFrame(data, ", ".join(f"{c} double" for c in G.QUAD))
    scaled = quads.select(*G.QUAD, G.scale_polygon(G.polygon_of(), 3.0).alias("p"))
    assert scaled._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    for *c, p in scaled.collect():
        points, centre = list(zip(c[::2], c[1::2])), (None, None)
        if None not in c:
            cross = [a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1])]
            if sum(cross):
                centre = [sum((a[i] + b[i]) * w for a, b, w in zip(points, points[1:] + points[:1], cross)) / (3 * sum(cross)) for i in (0, 1)]
        for corner, moved in zip(points, p):
            for v, m, got in zip(corner, centre, moved):
                assert got == (None if v is None else v + 3 if m is not None and v > m else v - 3)


def test_small_pages_are_one_cell(spark, monkeypatch):
    """A quad of a page of usual size is dealt once, however large; crowded pages go to cells and give the same areas."""
    rng = random.Random(11)
    quads = lambda n, image: [(image, i, *map(float, slanted(rng, rng.randint(0, 300), rng.randint(0, 300), rng.randint(20, 300), rng.randint(10, 90)))) for i in range(n)]
    words = spark.createDataFrame([(*q[:2], q[1] % 3 == 0, *q[2:]) for i in (1, 2) for q in quads(14, i)], f"image_id long, word_idx long, dc boolean, {QUAD}")
    boxes = spark.createDataFrame([q for i in (1, 2) for q in quads(14, i)], DET)

    def measured():
        return {tuple(r)[:4]: tuple(r)[4:] for r in Q.region_measures(words, boxes, cell=64).collect()}

    sides = boxes.select("image_id", *QUAD.replace(" double", "").split(", "), *Q.quad_bounds())
    assert Q._dealt(sides, 64).count() == 28
    whole = measured()
    monkeypatch.setattr(Q, "CROWD", 10)
    assert Q._dealt(sides, 64).count() > 100
    cells = measured()
    assert {k[1] for k in whole} == {0, 1, 2, 3} and whole.keys() == cells.keys()
    lone = {tuple(r)[:4]: tuple(r)[4:] for r in Q.region_measures(words, boxes, cell=64, shared=False).collect()}
    assert lone == {k: v for k, v in cells.items() if k[1] != 3}
    for key, values in whole.items():
        assert [v / C.SCALE for v in cells[key]] == pytest.approx([v / C.SCALE for v in values], rel=1e-9, abs=0.2)


def test_places_in_blocks(monkeypatch):
    """Places of a batch are told some rows at a time; words without characters and rows without a quad have none."""
    import pyarrow as pa

    n = [4, 0, 3, None, 7, 1, 2]
    line = [[0.0] * 7, [4.0] * 7, [80.0] * 7, [4.0] * 7]
    box = [[0.0] * 6 + [None], [0.0] * 7, [20.0] * 6 + [None], [0.0] * 7, [20.0] * 7, [4.0] * 7, [0.0] * 7, [4.0] * 7]
    want = [[0, 1], [], [0, 1], [], [0, 1, 2, 3], [0], []]
    for most in (1, 5, 1000):
        monkeypatch.setattr(Q, "_PLACES", most)
        assert Q._places_inside.func(pa.array(n, pa.int32()), *(pa.array(v, pa.float64()) for v in line + box)).to_pylist() == want


def test_quads_of_usual_pages_meet_by_image(spark):
    """Pages of few quads meet by image, crowded ones in grid cells: the same pairs, and those of integration over strips."""
    from pagelake.functions.polygons import quad_overlap_pairs

    rnd = random.Random(5)

    def quad(far):
        x, y, w, h, a = rnd.uniform(-far, far), rnd.uniform(-far, far), rnd.uniform(5, 60), rnd.uniform(5, 60), rnd.uniform(0, 3)
        return [c for u, v in ((0, 0), (w, 0), (w, h), (0, h)) for c in (x + u * math.cos(a) - v * math.sin(a), y + u * math.sin(a) + v * math.cos(a))]

    def table(name, many):
        made = [(page, k, *quad(60)) for page in (1, 2, None) for k in range(12)] + [(9, k, *quad(600)) for k in range(many)]
        made.append((1, 77, *made[0][2:9], None))
        return spark.createDataFrame(made, f"image_id long, {name} long, {QUAD}"), made

    (few_gt, raw_gt), (few_det, raw_det) = table("word_idx", 0), table("det_idx", 0)
    near = quad_overlap_pairs(few_gt, few_det, truncate=False)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "cell_x" not in plan
    got = {(r.image_id, r.word_idx, r.det_idx): r.inter for r in near.collect()}
    ring = lambda v: list(zip(v[::2], v[1::2]))
    for g in raw_gt:
        for d in raw_det:
            if g[0] == d[0] and g[0] is not None and None not in g + d:
                area = covered([ring(g[2:])], [], [ring(d[2:])])[0]
                assert got.pop((g[0], g[1], d[1]), 0.0) == pytest.approx(area, abs=1e-6)
    assert not got
    (gt, _), (det, _) = table("word_idx", 300), table("det_idx", 40)
    both = quad_overlap_pairs(gt, det, truncate=False, cell=64)
    assert "cell_x" in both._jdf.queryExecution().executedPlan().toString()
    alone = quad_overlap_pairs(gt.where("image_id = 9 AND word_idx < 200"), det.where("image_id = 9"), truncate=False)
    pairs = lambda df: sorted(map(tuple, df.where("image_id = 9 AND word_idx < 200").collect()))
    assert pairs(both) == pairs(alone) and pairs(alone)
    assert {r.image_id for r in both.collect()} == {1, 2, 9}


def test_whole_images_are_dealt_once(spark, monkeypatch):
    """Images that are no crowds, crowds, and both in one table give the same matches; whole ones are shuffled by image alone."""
    rng = random.Random(23)
    spot = lambda: [float(v) for v in slanted(rng, rng.randint(0, 160), rng.randint(0, 160), rng.randint(20, 120), rng.randint(10, 60))]
    words = [(i, k, "###" if k % 4 == 0 else "abcd", *spot()) for i, n in ((1, 16), (2, 5), (3, 6), (None, 2)) for k in range(n)]
    dets = [(i, k, *([v + 2 for v in w[3:]] if k % 3 else spot())) for k, w in enumerate(words) for i in [w[0]]] + [(4, 0, *spot())]
    gt, det = spark.createDataFrame(words, GT), spark.createDataFrame(dets, DET)

    def found():
        matches, boxes = Q.detection_matches_quads(gt, det, cell=64)
        key = lambda r: str(tuple(r))
        sides = [f"{s}{a}{k}" for s in ("l_", "r_") for k in range(1, 5) for a in "xy"]
        assert matches.columns == ["image_id", "word_idx", "det_idx", "n_chars", "one_to_one", "one_to_many", "many_to_one", "inside", *sides]
        return sorted(map(tuple, matches.collect())), sorted(map(tuple, boxes.select("image_id", "det_idx", "det_dc").collect()), key=key)

    whole = found()
    assert len(whole[0]) > 5 and {m[0] for m in whole[0]} == {1, 2, 3} and len(whole[1]) == len(dets)
    for crowd in (0, 20):
        monkeypatch.setattr(Q, "CROWD", crowd)
        assert found() == whole
    monkeypatch.setattr(Q, "CROWD", 256)
    plans, write = {}, Q.materialise

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        return write(df, name)

    monkeypatch.setattr(Q, "materialise", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        Q.detection_matches_quads(gt, det)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = [line for line in plans["judged"].splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not [line for line in exchanges if "_idx" in line]
