"""Near-duplicate vectors against brute force: groups of copies, tight and loose groups, tiles, unusable vectors."""

import math

import numpy as np
import pytest

from pagelake.llm import vectors

SHAPE = "vec_id long, embedding array<float>, label int, node string, links string, component_id string"


def table():
    rng = np.random.default_rng(4)
    rows = []

    def add(v, label):
        rows.append((len(rows), None if v is None else [None if x is None else float(x) for x in v], label, "n", "l", "c"))

    for label in (1, 2):
        for _ in range(40):
            add(rng.standard_normal(16), label)
        # A tight group, one that is too wide for its mean alone, and a chain whose ends are far apart.
        for spread, n in ((0.02, 90), (0.075, 90)):
            centre = rng.standard_normal(16)
            centre /= np.linalg.norm(centre)
            for _ in range(n):
                add(centre + spread * rng.standard_normal(16), label)
        for k in range(60):
            add([math.cos(k / 20), math.sin(k / 20), *[0] * 14], label)
    copy = rng.standard_normal(16)
    for k in range(30):
        add(copy * (1 if k % 3 else 2), 3)
    add(copy, 4)  # another label
    add(copy, None)
    add(copy[:8], 3)  # another length
    for v in (None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1e38] * 16, [1e38] * 16, [1e-40] * 16, [-0.0, 1.0], [0.0, 1.0]):
        add(v, 3)
    rows += [rows[0], rows[0], (None, *rows[200][1:]), (None, rows[0][1], 9, None, None, None)]
    return rows


def brute(rows, cosine):
    unit = []
    for _, v, label, *_ in rows:
        fine = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(np.array(v, np.float32), np.float64) if fine else None
        unit.append(x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if fine and x.any() else None)
    near = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(len(rows))]
    component = [None] * len(rows)
    for i in range(len(rows)):
        if component[i] is None:
            seen, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
            for j in seen:
                component[j] = (least,)
    return [(r[0], len(near[i]), component[i][0], r[0] == component[i][0]) for i, r in enumerate(rows)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


@pytest.mark.parametrize("tile,block,parts", [(1024, 8192, 3), (32, 200, 3), (16, 128, 40)])
def test_near_duplicates(spark, monkeypatch, tile, block, parts):
    """Whole components and tiles, streamed blocks, and partitions smaller than a window; many passes make the search whole."""
    monkeypatch.setattr(vectors, "_TILE", tile)
    monkeypatch.setattr(vectors, "_BLOCK", block)
    monkeypatch.setattr(vectors, "_PASSES_AT_ONCE", 24)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = table()
        out = vectors.near_duplicates(spark.createDataFrame(rows, SHAPE).repartition(6), passes=24)
        assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
        assert ordered(map(tuple, out.collect())) == ordered(brute(rows, vectors.COSINE))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_vectors(spark):
    none = spark.createDataFrame([], SHAPE)
    assert vectors.near_duplicates(none).count() == 0
    alone = spark.createDataFrame([(5, None, 1, "", "", ""), (6, [1.0], None, "", "", "")], SHAPE)
    assert sorted(map(tuple, vectors.near_duplicates(alone).collect())) == [(5, 0, 5, True), (6, 0, 6, True)]


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold among many random vectors are found by the default number of passes."""
    rng = np.random.default_rng(8)
    n, dim, angle = 4000, 24, math.acos(0.935)
    base = rng.standard_normal((n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((400, dim))
    side -= (side * base[:400]).sum(axis=1, keepdims=True) * base[:400]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = math.cos(angle) * base[:400] + math.sin(angle) * side
    rows = [(i, v.tolist(), 1, "", "", "") for i, v in enumerate(np.concatenate([base, near]))]
    out = {r.vec_id: r.component_id for r in vectors.near_duplicates(spark.createDataFrame(rows, SHAPE)).collect()}
    found = sum(out[n + i] == out[i] for i in range(400))
    assert found >= 0.97 * 400
    wrong = [r for r in out if r != out[r] and not (r >= n and out[r] == r - n) and r < n]
    assert all(max(abs(base[r] @ base[o]) for o in range(n) if o != r and out[o] == out[r]) > 0.9 for r in wrong)


def test_passes():
    few, many = vectors.passes_for(1000), vectors.passes_for(10**9)
    assert 2 <= vectors.passes_for(0) <= few < many < 300
