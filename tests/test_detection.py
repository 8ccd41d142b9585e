"""Detection scoring against a pixel-set evaluator and hand-made cases."""

import math
import random

import pytest
from conftest import rows

from pagelake.operators import detection as D

GT = "image_id long, word_idx long, text string, xmin int, ymin int, xmax int, ymax int"
DET = "image_id long, det_idx long, xmin int, ymin int, xmax int, ymax int"


def pixels(box):
    return {(x, y) for x in range(box[0], box[2]) for y in range(box[1], box[3])}


def bent(pivots):
    def toward(p, q):
        x, y = q[0] - p[0], q[1] - p[1]
        return (1.0, 0.0) if x == 0 and y == 0 else (x, y)

    for i, (mid, centre) in enumerate(pivots):
        for k, (_, other) in enumerate(pivots):
            if i == k:
                continue
            u, v = toward(other, mid), toward(other, centre)
            if abs(u[0] * v[1] - u[1] * v[0]) >= abs(u[0] * v[0] + u[1] * v[1]):
                return True
    return False


def by_pixels(gts, dets, r=0.4, p=0.4):
    """Score one image from sets of unit squares."""
    care = [(t, b) for t, b in gts if t != "###"]
    care_px = [pixels(b) for _, b in care]
    taken = set().union(*care_px) if care_px else set()
    dcs = [pixels(b) - taken for t, b in gts if t == "###"]
    det_dc, left = [], []
    for box in dets:
        px = pixels(box)
        shares = [(len(px & dc) / len(dc) if dc else 0, len(px & dc) / len(px)) for dc in dcs]
        many = sum(len(px & dc) for dc, (rec, _) in zip(dcs, shares) if rec > r) / len(px)
        det_dc.append(bool(dcs) and (many >= p or any(pr > p for _, pr in shares)))
        left.append(px.difference(*dcs) if dcs else px)
    n, m = len(care), len(dets)
    inter = [[len(care_px[i] & left[j]) for j in range(m)] for i in range(n)]
    rec = [[inter[i][j] / len(care_px[i]) for j in range(m)] for i in range(n)]
    pre = [[inter[i][j] / len(left[j]) if left[j] else 0 for j in range(m)] for i in range(n)]
    hit = [[rec[i][j] >= r and pre[i][j] >= p for j in range(m)] for i in range(n)]
    mid = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    pairs = set()
    for j in range(m):
        group = [i for i in range(n) if rec[i][j] >= r]
        if not det_dc[j] and len(group) >= 2 and sum(inter[i][j] for i in group) / len(left[j]) >= p:
            if not bent([((care[i][1][0], mid(care[i][1])[1]), mid(care[i][1])) for i in group]):
                pairs |= {(i, j) for i in group}
    for i in range(n):
        for j in range(m):
            if hit[i][j] and not det_dc[j] and sum(hit[i]) == 1 and sum(h[j] for h in hit) == 1:
                cx = sum(x + 0.5 for x, _ in left[j]) / len(left[j])
                cy = sum(y + 0.5 for _, y in left[j]) / len(left[j])
                g, d = care[i][1], dets[j]
                diag = math.hypot(g[2] - g[0], g[3] - g[1]) + math.hypot(d[2] - d[0], d[3] - d[1])
                if 2 * math.hypot(mid(g)[0] - cx, mid(g)[1] - cy) / diag < 1:
                    pairs.add((i, j))
    for i in range(n):
        group = [j for j in range(m) if pre[i][j] >= p and not det_dc[j]]
        if len(group) >= 2 and sum(inter[i][j] for j in group) / len(care_px[i]) >= r:
            if not bent([((mid(dets[j])[0], dets[j][3]), mid(dets[j])) for j in group]):
                pairs |= {(i, j) for j in group}
    recall_sum = precision_sum = 0.0
    held = {}
    for i, (text, b) in enumerate(care):
        for c in range(len(text)):
            share = (c + 0.5) / len(text)
            tall = b[3] - b[1] > 1.5 * (b[2] - b[0])
            x = mid(b)[0] if tall else b[0] + (b[2] - b[0]) * share
            y = b[3] - (b[3] - b[1]) * share if tall else mid(b)[1]
            held[i, c] = {j for k, j in pairs if k == i and dets[j][0] <= x <= dets[j][2] and dets[j][1] <= y <= dets[j][3]}
        recall_sum += sum(len(held[i, c]) == 1 for c in range(len(text))) / len(text)
    for j in range(m):
        mine = [i for i, k in pairs if k == j]
        if mine:
            total = sum(len(care[i][0]) for i in mine)
            precision_sum += sum(j in held[i, c] for i in mine for c in range(len(care[i][0]))) / total
    return recall_sum, precision_sum, n, sum(not d for d in det_dc), pairs


def random_page(rng):
    def box(size):
        x, y = rng.randint(0, 40), rng.randint(0, 30)
        return (x, y, x + rng.randint(1, size), y + rng.randint(1, size))

    gts = [("###" if rng.random() < 0.3 else "w" * rng.randint(1, 6), box(18)) for _ in range(rng.randint(0, 6))]
    dets = [box(20) for _ in range(rng.randint(0, 6))]
    for _, b in gts:
        if rng.random() < 0.7:
            d = rng.randint(-2, 2)
            cut = (b[0] + b[2]) // 2
            if rng.random() < 0.4 and cut > b[0]:
                dets += [(b[0], b[1], cut, b[3]), (cut, b[1], b[2], b[3])]
            else:
                dets.append((b[0] + d, b[1] + d, b[2] + d, b[3] + d))
    return gts, dets


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(12)
    return {i: random_page(rng) for i in range(150)}


def tables(spark, pages):
    gt = [(i, k, t, *b) for i, (gts, _) in pages.items() for k, (t, b) in enumerate(gts)]
    det = [(i, k, *b) for i, (_, dets) in pages.items() for k, b in enumerate(dets)]
    return spark.createDataFrame(gt, GT), spark.createDataFrame(det, DET)


@pytest.mark.parametrize("limit, cell", [(64, 256), (1, 8)])
def test_random_pages(spark, pages, monkeypatch, limit, cell):
    """The second run sends every group through the large-group path and cuts pages into small cells."""
    monkeypatch.setattr(D.bent_groups, "__defaults__", (limit,))
    gt, det = tables(spark, pages)
    got = {r["image_id"]: r for r in D.detection_eval_per_image(gt, det, empty="zero", cell=cell).collect()}
    for i, (gts, dets) in pages.items():
        recall_sum, precision_sum, n, m, _ = by_pixels(gts, dets)
        if not gts and not dets:
            continue
        row = got[i]
        assert (row["n_gt"], row["n_det"]) == (n, m), i
        assert row["recall_sum"] == pytest.approx(recall_sum), i
        assert row["precision_sum"] == pytest.approx(precision_sum), i


def test_pages_matched_whole_and_crowded_pages(spark, pages, monkeypatch):
    """Pages above the limit go through the grid, the others are dealt by image without it; rows without an image meet nothing."""
    gt, det = tables(spark, pages)
    nobody = spark.createDataFrame([(None, 0, "word", 0, 0, 40, 10)], GT), spark.createDataFrame([(None, 0, 0, 0, 40, 10)], DET)
    gt, det = gt.unionByName(nobody[0]), det.unionByName(nobody[1])
    results = []
    for limit in (256, 4):
        monkeypatch.setattr(D, "PAGE_BOXES", limit)
        matches, dets = D.detection_matches(gt, det, cell=8)
        pairs = matches.drop("n_chars").where("one_to_one or one_to_many or many_to_one")
        plan = matches._jdf.queryExecution().executedPlan().toString()
        assert ("cell_x" in plan) == (limit == 4)
        results.append((rows(pairs), sorted(map(tuple, dets.select("image_id", "det_idx", "det_area", "det_dc", "left_area", "left_cx", "left_cy").collect()), key=str)))
    assert results[0] == results[1] and len(results[0][0]) > 50
    got = {i: set() for i in pages}
    for row in results[0][0]:
        got[row[0]].add((row[1], row[2]))
    for i, (gts, dets) in pages.items():
        care = [k for k, (text, _) in enumerate(gts) if text != "###"]
        assert got[i] == {(care[a], b) for a, b in by_pixels(gts, dets)[4]}, i


def test_single_boxes_need_no_strips(spark):
    rows_in = [(1, 0, 0, 4, 3, True), (2, 0, 0, 4, 3, False), (3, 0, 5, 4, 3, True), (4, 2, 0, 2, 3, True), (5, 0, 0, 4, 4, True), (5, 2, 1, 9, 3, False)]
    boxes = spark.createDataFrame(rows_in, "k long, xmin long, ymin long, xmax long, ymax long, plus boolean")
    assert rows(D.covered_measures(boxes, ["k"])) == [(1, 12, 48, 36), (2, 0, 0, 0), (3, 0, 0, 0), (5, 12, 40, 48)]


def test_places_inside_are_those_of_a_test_of_each_centre(spark):
    rng = random.Random(5)
    sides = [f"{s}_{c}" for s in "lr" for c in ("xmin", "ymin", "xmax", "ymax")]
    data = []
    for i in range(1500):
        x, y, dx, dy = rng.randint(-50, 50), rng.randint(-50, 50), rng.randint(-10, 10), rng.randint(-10, 10)
        w, h = rng.randint(1, 40), rng.randint(1, 80)
        if i % 50 == 0:
            w = -w
        data.append((rng.choice((None, 0, 1, 2, 7, 30)), x, y, x + w, y + h, x + dx, y + dy, x + dx + rng.randint(1, 40), y + dy + rng.randint(1, 80)))
    table = spark.createDataFrame(data, "n_chars int, " + ", ".join(f"{c} long" for c in sides))
    for r in D.chars_in_detections(table).collect():
        n, w, h = r.n_chars or 0, r.l_xmax - r.l_xmin, r.l_ymax - r.l_ymin
        want = []
        for c in range(n):
            share, tall = (c + 0.5) / n, h > 1.5 * w
            px = (r.l_xmin + r.l_xmax) / 2.0 if tall else r.l_xmin + w * share
            py = r.l_ymax - h * share if tall else (r.l_ymin + r.l_ymax) / 2.0
            if r.r_xmin <= px <= r.r_xmax and r.r_ymin <= py <= r.r_ymax:
                want.append(c)
        assert r.inside == want, r


def test_kinds_of_matches(spark):
    gt = [(1, 0, "wide", 0, 0, 40, 10), (2, 0, "ab", 0, 0, 20, 10), (2, 1, "cd", 20, 0, 40, 10), (3, 0, "solo", 0, 0, 40, 10)]
    det = [(1, 0, 0, 0, 20, 10), (1, 1, 20, 0, 40, 10), (2, 0, 0, 0, 40, 10), (3, 0, 1, 1, 41, 11)]
    matches, _ = D.detection_matches(spark.createDataFrame(gt, GT), spark.createDataFrame(det, DET))
    got = rows(matches.select("image_id", "word_idx", "det_idx", "one_to_one", "one_to_many", "many_to_one"))
    assert got == [
        (1, 0, 0, False, True, False), (1, 0, 1, False, True, False), (2, 0, 0, False, False, True),
        (2, 1, 0, False, False, True), (3, 0, 0, True, False, False),
    ]


def test_character_counts_only_once(spark):
    """Two detections over the whole word: every character is seen twice, so recall is 0."""
    gt = spark.createDataFrame([(1, 0, "word", 0, 0, 40, 10)], GT)
    det = spark.createDataFrame([(1, 0, 0, 0, 40, 9), (1, 1, 0, 1, 40, 10)], DET)
    matches, _ = D.detection_matches(gt, det, det_pivot="left")
    row = D.detection_eval_per_image(gt, det, det_pivot="left").first()
    assert row["recall"] == 0.0 and matches.count() in (0, 2)


def test_empty_rules(spark):
    gt = spark.createDataFrame([(1, 0, "###", 0, 0, 10, 10), (2, 0, "###", 0, 0, 10, 10)], GT)
    det = spark.createDataFrame([(1, 0, 50, 50, 60, 60), (2, 0, 0, 0, 10, 10)], DET)
    one = {r["image_id"]: (r["recall"], r["precision"]) for r in D.detection_eval_per_image(gt, det).collect()}
    zero = {r["image_id"]: (r["recall"], r["precision"]) for r in D.detection_eval_per_image(gt, det, empty="zero").collect()}
    assert one == {1: (1.0, 0.0), 2: (1.0, 1.0)} and zero == {1: (0.0, 0.0), 2: (0.0, 0.0)}


def test_macro_equals_micro_for_single_boxes(spark):
    gt = spark.createDataFrame([(i, 0, "word", 0, 0, 40, 10) for i in range(6)], GT)
    det = spark.createDataFrame([(i, 0, i * 3, 0, 40, 10) for i in range(6)], DET)
    per = D.detection_eval_per_image(gt, det)
    macro, micro = D.detection_eval_macro(per).first(), D.detection_eval_micro(per).first()
    assert macro["recall"] == pytest.approx(micro["recall"]) and macro["precision"] == pytest.approx(micro["precision"])


def test_average_precision(spark):
    det = spark.createDataFrame([(1, 0.9, True), (2, 0.8, False), (3, 0.7, True), (4, 0.6, False)], "id int, conf double, match boolean")
    n_gt = spark.createDataFrame([(4,)], "n_gt long")
    want = (1 / 1 + 2 / 3) / 4
    for points in (None, [(-0.85, 1), (-0.65, 3)]):
        assert D.average_precision(det, n_gt, ["id"], points=points).first()[0] == pytest.approx(want)


def test_rotated_quads_share_what_upright_boxes_share():
    import numpy as np

    from pagelake.functions.polygons import convex_overlap

    rng = np.random.default_rng(2)
    a, b = (np.sort(rng.integers(0, 9, (400, 2, 2)), axis=1).astype(float) for _ in range(2))  # [low, high] corners
    want = np.prod(np.clip(np.minimum(a[:, 1], b[:, 1]) - np.maximum(a[:, 0], b[:, 0]), 0, None), axis=1)

    def ring(box):
        (x0, y0), (x1, y1) = box[:, 0].T, box[:, 1].T
        return np.stack([np.stack(c, axis=1) for c in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))], axis=1)

    for angle in (0.0, 0.3, 1.2, 1.6):
        spin = np.array([[np.cos(angle), np.sin(angle)], [-np.sin(angle), np.cos(angle)]])
        assert np.allclose(convex_overlap(ring(a * 150) @ spin, ring(b * 150)[:, ::-1] @ spin), want * 150**2, atol=1e-3)
    diamond = np.array([[[0.0, -1], [1, 0], [0, 1], [-1, 0]]])
    square = np.array([[[0.0, 0], [2, 0], [2, 2], [0, 2]]])
    assert np.allclose(convex_overlap(diamond, square), [0.5])
