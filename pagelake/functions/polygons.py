"""Areas shared by convex quads of any rotation, over Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pagelake.functions.geometry import QUAD, polygon_area, polygon_of, quad_bounds
from pagelake.operators.detection import meeting, page_parts
from pagelake.operators.joins import CELL


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def _inside(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """(n, p) flags: point p of row n lies in the convex ring of row n, border included."""
    side = np.roll(ring, -1, axis=1) - ring
    turn = _cross(side[:, None, :, :], points[:, :, None, :] - ring[:, None, :, :])
    tiny = 1e-9 * (1 + np.abs(turn).max(axis=(1, 2), keepdims=True))
    return (turn >= -tiny).all(axis=2) | (turn <= tiny).all(axis=2)


def convex_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared area of convex quads, row by row; ``a`` and ``b`` have shape (n, 4, 2).

    Corners of the shared region are corners of one quad inside the other and crossings of sides.
    """
    da, db = np.roll(a, -1, axis=1) - a, np.roll(b, -1, axis=1) - b
    gap = b[:, None, :, :] - a[:, :, None, :]
    det = _cross(da[:, :, None, :], db[:, None, :, :])
    # Relative to the side lengths: rounding must not turn sides on one line into a crossing.
    parallel = np.abs(det) <= 1e-9 * np.linalg.norm(da, axis=2)[:, :, None] * np.linalg.norm(db, axis=2)[:, None, :]
    safe = np.where(parallel, 1.0, det)
    t, u = _cross(gap, db[:, None, :, :]) / safe, _cross(gap, da[:, :, None, :]) / safe
    meets = ~parallel & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    crossing = a[:, :, None, :] + t[..., None] * da[:, :, None, :]
    n = len(a)
    points = np.concatenate([a, b, crossing.reshape(n, 16, 2)], axis=1)
    real = np.concatenate([_inside(a, b), _inside(b, a), meets.reshape(n, 16)], axis=1)
    count = real.sum(axis=1)
    centre = (points * real[..., None]).sum(axis=1) / np.maximum(count, 1)[:, None]
    rel = np.where(real[..., None], points - centre[:, None, :], 0.0)
    # Points that do not count move onto the first real one, where they add no area.
    first = rel[np.arange(n), real.argmax(axis=1)]
    rel = np.where(real[..., None], rel, first[:, None, :])
    order = np.argsort(np.arctan2(rel[..., 1], rel[..., 0]), axis=1)
    ring = np.take_along_axis(rel, order[..., None], axis=1)
    area = np.abs(_cross(ring, np.roll(ring, -1, axis=1)).sum(axis=1)) / 2
    flat = np.minimum(*(np.abs(_cross(q, np.roll(q, -1, axis=1)).sum(axis=1)) for q in (a, b))) < 1e-9
    return np.where((count >= 3) & ~flat, area, 0.0)


@F.pandas_udf(DoubleType())
def _overlap(*coords: pd.Series) -> pd.Series:
    flat = np.stack([c.to_numpy(dtype=float) for c in coords], axis=1)
    if not len(flat):
        return pd.Series([], dtype=float)
    return pd.Series(convex_overlap(flat[:, :8].reshape(-1, 4, 2), flat[:, 8:].reshape(-1, 4, 2)))


def quad_intersection_area(a: Sequence[str], b: Sequence[str], truncate: bool = True) -> Column:
    """Shared area of two convex quads given as eight columns each, in either winding."""
    cols = [F.col(c) for c in (*a, *b)]
    return _overlap(*[(c.cast("long") if truncate else c).cast("double") for c in cols])


def quad_overlap_pairs(
    gt: DataFrame, det: DataFrame, left_ids: Sequence[str] = ("word_idx",), right_ids: Sequence[str] = ("det_idx",),
    truncate: bool = True, cell: int = CELL,
) -> DataFrame:
    """Pairs of quads with shared area, recall and precision.

    Candidates come from the bounding boxes, of crowded images in grid cells, of others by image; only they reach the Arrow function.
    """

    def side(df: DataFrame, ids: Sequence[str], prefix: str) -> DataFrame:
        coords = [(F.col(c).cast("long") if truncate else F.col(c)).cast("double").alias(c) for c in QUAD]
        whole = df.select("image_id", *ids, *coords)
        x0, y0, x1, y1 = quad_bounds()
        # One pixel wider on the far sides, as bounds are whole numbers.
        bounds = [x0 - 1, y0 - 1, x1 + 1, y1 + 1]
        area = F.abs(polygon_area(polygon_of()))
        return whole.select(
            "image_id", *ids, *[F.col(c).alias(prefix + c) for c in QUAD], area.alias(prefix + "area"),
            *[v.alias(n) for v, n in zip(bounds, ("xmin", "ymin", "xmax", "ymax"))],
        )

    def found(left: DataFrame, right: DataFrame, size: int | None) -> DataFrame:
        area = quad_intersection_area([f"g_{c}" for c in QUAD], [f"d_{c}" for c in QUAD], truncate=False)
        return meeting(left, right, size).withColumn("inter", area).where("inter > 0").select(
            "image_id", *left_ids, *right_ids, "inter",
            F.coalesce(F.try_divide("inter", "g_area"), F.lit(0.0)).alias("recall"),
            F.coalesce(F.try_divide("inter", "d_area"), F.lit(0.0)).alias("precision"),
        )

    parts = page_parts(side(gt, left_ids, "g_"), side(det, right_ids, "d_"), cell)
    return reduce(DataFrame.unionByName, [found(*part) for part in parts])
