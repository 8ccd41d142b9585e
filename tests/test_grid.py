"""Score maps, pages and tiles."""

import itertools
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from pagelake.operators import grid as H
from pagelake.operators import pages as L


def flood(cells):
    """Components of a set of (x, y) by flood fill, keyed by their first cell in row order."""
    out, left = {}, set(cells)
    while left:
        root = min(left, key=lambda c: (c[1], c[0]))
        queue, seen = [root], {root}
        while queue:
            x, y = queue.pop()
            for near in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if near in left and near not in seen:
                    seen.add(near)
                    queue.append(near)
        out[root] = seen
        left -= seen
    return out


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_components(spark, batch):
    """With batches of 7 edges most components are torn and go through the iterative rounds."""
    rng = random.Random(3)
    pages = {i: {(x, y) for x in range(12) for y in range(12) if rng.random() < 0.55} for i in range(4)}
    pages[9] = {(x, y) for y in range(12) for x in range(12) if y % 2 == 0 or x == (0 if y % 4 == 1 else 11)}  # one long snake
    data = [(i, y, x, 1.0, 0.0) for i, cells in pages.items() for x, y in cells]
    grid = spark.createDataFrame(data, "image_id long, y int, x int, text float, link float")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = H.grid_components(grid)[1].collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    mine = {(r["image_id"], r["label"] % 2**31, r["label"] // 2**31): (r["area"], r["x"], r["y"], r["w"], r["h"]) for r in got}
    want = {}
    for i, cells in pages.items():
        for (x, y), part in flood(cells).items():
            xs, ys = [c[0] for c in part], [c[1] for c in part]
            want[i, x, y] = (len(part), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1)
    assert mine == want


def test_one_box(spark):
    data = [(1, y, x, 0.9, 0.0) for y in range(10, 14) for x in range(10, 40)] + [(1, 11, x, 0.1, 0.9) for x in range(40, 46)]
    grid = spark.createDataFrame(data, "image_id long, y int, x int, text float, link float")
    sizes = spark.createDataFrame([(1, 100, 100)], "image_id long, width int, height int")
    # 126 pixels in a 36 x 4 box: grown by int(sqrt(126 * 4 / 144) * 2) = 3, two to the far sides and one to the near.
    for axis_only in (True, False):
        box = H.component_boxes(grid, sizes, axis_only=axis_only).first()
        assert [round(box[c], 6) for c in ("x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4")] == [9, 9, 41, 9, 41, 15, 9, 15]
    weak = grid.withColumn("text", F.col("text") * 0.7)
    assert H.component_boxes(weak, sizes).count() == 0


def test_height_runs(spark):
    def runs(*heights):
        df = spark.createDataFrame([([(h,) for h in heights],)], "e array<struct<h:int>>")
        return df.select(H.height_runs(F.col("e"))).first()[0]

    assert runs(20) == [0]
    assert runs(20, 20, 40, 40) == [0, 0, 1, 1]
    assert runs(20, 40, 40, 40) == [0, 0, 1, 1]  # one element is no run yet
    assert runs(40, 40, 20, 20, 20) == [0, 0, 1, 1, 1]
    assert runs(40, 40, 20, 40, 40) == [0, 0, 0, 0, 0]  # a single small one
    assert runs(4, 14, 5, 14, 4) == [0, 0, 0, 0, 0]  # all small
    assert runs(20, 20, 90) == [0, 0, 0]  # the last always joins


def test_runs_of_rows_are_runs_of_lists(spark):
    rng = np.random.default_rng(8)
    shape = "image_id long, label string, element long, x int, y int, w int, h int, run string, pos string"
    data = []
    for page in range(40):
        top = 20 if page % 2 else 60
        for e in range(int(rng.integers(1, 60))):
            data.append((page % 20 if page < 39 else None, str(page % 4), e + 100 * page, int(rng.integers(0, 30)), 0, 3, None if rng.random() < 0.03 else int(rng.integers(3, top)), "r", "p"))
    table = spark.createDataFrame(data + data[:3], shape).repartition(7)
    listed = table.groupBy("image_id", "label").agg(F.array_sort(F.collect_list(F.struct("x", "y", "element", "w", "h"))).alias("e"))
    zipped = listed.select("image_id", "label", F.posexplode(F.arrays_zip("e", H.height_runs(F.col("e")).alias("run"))).alias("pos", "z"))
    want = zipped.select("image_id", "label", "pos", F.col("z.e.element").alias("element"), F.col("z.run").alias("run"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = H.number_runs(table)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        assert H.split_elements(table.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_component_is_linear(spark):
    line = spark.range(200_000).selectExpr("1L AS image_id", "1L AS label", "id AS element", "id AS x", "0 AS y", "1 AS w", "IF(id div 100 % 2 = 0, 20, 60) AS h")
    got = H.split_elements(line).groupBy("run").count().collect()
    assert len(got) == 2000 and {r["count"] for r in got} == {100}


def test_min_area_rectangle():
    rng = np.random.default_rng(5)
    for _ in range(20):
        turn = rng.uniform(0, np.pi)
        w, h = rng.uniform(2, 9, 2)
        inside = rng.uniform(-0.5, 0.5, (30, 2)) * (w, h)
        corners = np.array(list(itertools.product((-w / 2, w / 2), (-h / 2, h / 2))))
        spin = np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
        box = H.min_area_rectangle(np.concatenate([inside, corners]) @ spin.T)
        sides = sorted(np.linalg.norm(box[i] - box[(i + 1) % 4]) for i in (0, 1))
        assert np.allclose(sides, sorted((w, h)))


def test_gaps_lose_their_middle(spark):
    ink = [500] * 3 + [0] * 30 + [500] * 2 + [0] * 40
    df = spark.createDataFrame([(1, x, v) for x, v in enumerate(ink)], "image_id int, x int, ink int")
    out = H.compact_gaps(df)
    assert out.where("not keep").agg(F.min("x"), F.max("x"), F.count("x")).first() == (13, 22, 10)
    assert out.where("x = 33").first()["new_x"] == 23


def test_reading_order(spark):
    boxes = [(1, 0, 50, 0, 90, 10), (1, 1, 0, 3, 40, 12), (1, 2, 0, 20, 40, 30), (1, 3, 60, 11, 90, 19)]
    df = spark.createDataFrame(boxes, "image_id long, box_idx long, xmin int, ymin int, xmax int, ymax int")
    assert rows(L.reading_order(df).select("position", "box_idx", "line")) == [(0, 1, 0), (1, 0, 0), (2, 3, 0), (3, 2, 1)]
    keys = ["image_id", "ymin", "xmin", "box_idx"]
    forced = L.reading_order(df, points=[(1, 3, 0, 1), (1, 11, 60, 3)])
    assert rows(forced.select("position", "box_idx", "line")) == rows(L.reading_order(df).select("position", "box_idx", "line")), keys


def test_tiles_cover_the_page(spark):
    pages = spark.createDataFrame([(i, 700 + 137 * i, 500 + 91 * i) for i in range(40)], "image_id int, width int, height int")
    ends = L.plan_tiles(pages, cover=True).groupBy("image_id", "width", "height").agg(
        F.max(F.col("x_off") + F.col("w")).alias("r"), F.max(F.col("y_off") + F.col("h")).alias("b")
    )
    assert ends.where("r < width or b < height").count() == 0
    plain = L.plan_tiles(spark.createDataFrame([(1, 2511, 800)], "image_id int, width int, height int"))
    assert rows(plain.select("i", "j", "x_off", "w")) == [(0, 0, 0, 1280), (0, 1, 1230, 1280), (0, 2, 2460, 51), (1, 0, 0, 1280), (1, 1, 1230, 1280), (1, 2, 2460, 51)]


def test_components_of_winding_graphs(spark):
    """A U, a comb and a path: no limit on rounds, and few of them."""
    u = [(i, i + 2) for i in range(0, 436, 2)] + [(i, i + 2) for i in range(1, 437, 2)] + [(438, 439), (436, 438), (437, 439)]
    comb = [(1000 + 20 * t + i, 1000 + 20 * t + i + 1) for t in range(12) for i in range(15)] + [(1000 + 20 * t + 15, 1000 + 20 * (t + 1) + 15) for t in range(11)]
    edges = spark.createDataFrame([(1, *e) for e in u] + [(2, *e) for e in comb] + [(3, 5, 5), (3, 7, 8), (3, 8, 7)], "image_id long, u long, v long")
    got = H.propagate_labels(edges)
    least = {(1, n): 0 for e in u for n in e} | {(2, n): 1000 for e in comb for n in e} | {(3, 5): 5, (3, 7): 7, (3, 8): 7}
    assert {(r.image_id, r.node): r.label for r in got.collect()} == least


def test_tile_detections_stay_with_their_page(spark):
    """Whole grids, grids with gaps, tiles that come twice, and nulls, against a plain join; nothing dealt by page is dealt again."""
    grids = {1: [(i, j) for i in range(3) for j in range(4)], 2: [(0, 0), (0, 2), (2, 1), (1, 1)], 3: [(0, 0), (0, 0), (1, 0), (0, 1), (0, 1)], 4: [(None, 0), (0, None), (-1, 0), (0, 0)], None: [(0, 0)]}
    tiles = spark.createDataFrame(
        [(p, i, j, 100 * k, 7 * k + (p or 0)) for p, grid in grids.items() for k, (i, j) in enumerate(grid)], "image_id long, i int, j int, x_off int, y_off int")
    spots = [(i, j) for i in (-1, 0, 1, 2, 3, None) for j in (-1, 0, 1, 2, 3, 4, None)]
    dets = spark.createDataFrame(
        [(k, p, i, j, k % 5, 1, 2, 3, None if k % 7 == 0 else 4) for p in (1, 2, 3, 4, 5, None) for k, (i, j) in enumerate(spots)],
        "det_idx long, image_id long, i int, j int, n long, xmin long, ymin long, xmax long, ymax long")
    plain = dets.join(tiles, ["image_id", "i", "j"]).selectExpr("image_id", "i", "j", "det_idx", "n", "xmin + x_off AS xmin", "ymin + y_off AS ymin", "xmax + x_off AS xmax", "ymax + y_off AS ymax")
    got = L.untile_detections(dets, tiles)
    assert got.columns == plain.columns and got.schema["i"] == plain.schema["i"]
    key = lambda r: str(tuple(r))
    assert sorted(got.collect(), key=key) == sorted(plain.collect(), key=key) and got.count() == 12 + 4 + 5 + 2
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = L.untile_detections(dets.repartition(4, "image_id"), tiles.repartition(4, "image_id"))
        plan = dealt._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hash") == 2
