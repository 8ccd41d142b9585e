"""Detection scoring against ground truth with pseudo characters, on quads of any rotation.

Inputs: ``gt(image_id, word_idx, text, x1..y4)`` and ``det(image_id, det_idx, x1..y4)``; coordinates are truncated to whole numbers.
All areas come from one pass: regions are cut up into convex pieces, and areas and moments are added up as whole numbers, so no result
depends on the order of rows. An image of up to ``CROWD`` quads is worked on as a whole; a crowded one is dealt to the cells of a grid, and
whatever touches a cell is cut to it. A quad may have one reflex corner. ``detection.py`` has the same scoring for axis boxes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from pagelake.functions import clipping as C
from pagelake.functions.geometry import QUAD, dist, mean_diagonal, orient_vertical, quad_area, quad_bounds, quad_centroid
from pagelake.functions.text import DONT_CARE
from pagelake.operators.detection import AREA_PRECISION, AREA_RECALL, CENTRE_LIMIT, bent_groups, rates_per_image
from pagelake.operators.joins import CELL, in_cells
from pagelake.session import materialise

_IMAGE, _GT, _DET = ["image_id"], ["image_id", "word_idx"], ["image_id", "det_idx"]
_CARE, _DONT_CARE, _DETECTED = 0, 1, 2
# Kinds of measured areas: a don't-care region, a detection in one, a detection in any, a detection in a care word.
_REGION, _HELD, _LOST, _SHARED = 0, 1, 2, 3
_PAIRS = 1_000_000
_PLACES = 1_000_000
CROWD = 256  # quads up to which an image is one cell
_LINE = ["from_x", "from_y", "to_x", "to_y"]


def _whole(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long").cast("double") for c in QUAD})


def _words_of(gt: DataFrame) -> DataFrame:
    return _whole(gt).select(*_GT, F.coalesce(F.col("text") == DONT_CARE, F.lit(False)).alias("dc"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), *QUAD)


def _scaled_area(prefix: str = "") -> Column:
    return F.rint(F.abs(quad_area([prefix + c for c in QUAD])) * C.SCALE).cast("long")


def _centre(prefix: str = "") -> tuple[Column, Column]:
    """The centre of gravity: of a parallelogram the mean of two corners, which is exact."""
    x, y = ([F.col(f"{prefix}{axis}{k}") for k in range(1, 5)] for axis in "xy")
    even = (x[0] + x[2] == x[1] + x[3]) & (y[0] + y[2] == y[1] + y[3])
    middle = [sum(v[1:], v[0]) / 4.0 for v in (x, y)]
    heavy = quad_centroid([F.col(prefix + c) for c in QUAD])
    return tuple(F.when(even, m).otherwise(F.coalesce(h, m)) for m, h in zip(middle, heavy))


# ---- areas, cell by cell ---------------------------------------------------------------------


def _near(group: np.ndarray, box: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group whose boxes share some area, some at a time."""
    base = box[:, 0].min(initial=0.0)
    span = box[:, 2].max(initial=0.0) - base + 1
    order = np.lexsort((box[:, 0], group))
    keys = group[order] * span + (box[order, 0] - base)
    until = np.searchsorted(keys, group[order] * span + (box[order, 2] - base))
    many = np.maximum(until - np.arange(len(order)) - 1, 0)
    ends = np.cumsum(many)
    start = 0
    while start < len(order):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _PAIRS)))
        n = many[start:stop]
        first = np.repeat(np.arange(start, stop), n)
        second = first + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = order[first], order[second]
        fits = (box[i, 1] < box[j, 3]) & (box[j, 1] < box[i, 3])
        yield i[fits], j[fits]
        start = stop


def _lists(owner: np.ndarray, item: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Items by owner, and where each owner's begin."""
    order = np.lexsort((item, owner))
    return item[order], np.searchsorted(owner[order], np.arange(n + 1))


def cell_measures(group: np.ndarray, cell: np.ndarray, kind: np.ndarray, idx: np.ndarray, quads: np.ndarray, shared: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]]:
    """(kind of area, group, word, detection, (area, x moment, y moment)) of what meets in each group's cell (n, 4), which may be endless."""
    pieces, of = C.convex_parts(quads)
    box = C.bounds(pieces)
    out = ((box[:, :2] < cell[of, :2]) | (box[:, 2:] > cell[of, 2:])).any(axis=1)
    if out.any():
        corners = cell[of[out]][:, [0, 1, 2, 1, 2, 3, 0, 3]].reshape(-1, 4, 2)
        pieces = C.join([C.take(pieces, ~out), C.overlap(C.take(pieces, out), (corners, np.full(out.sum(), 4)))])
        of = np.concatenate([of[~out], of[out]])
    solid = C.measures(pieces)[0] > 0
    pieces, of = C.take(pieces, solid), of[solid]
    group, kind, idx, n = group[of], kind[of], idx[of], len(of)
    box = C.bounds(pieces)
    region = {"care": ([], []), "earlier": ([], []), "held": ([], [])}
    for i, j in _near(group, box):
        swap = (kind[i] > kind[j]) | ((kind[i] == kind[j]) & ((idx[i] > idx[j]) | ((idx[i] == idx[j]) & (i > j))))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        for name, a, b in (("care", _CARE, _DONT_CARE), ("earlier", _DONT_CARE, _DONT_CARE), ("held", _DONT_CARE, _DETECTED)):
            own = (kind[i] == a) & (kind[j] == b)
            region[name][0].append(i[own])
            region[name][1].append(j[own])
        if shared:
            own = (kind[i] == _CARE) & (kind[j] == _DETECTED)
            i, j = i[own], j[own]
            yield _SHARED, group[i], idx[i], idx[j], C.measures(C.overlap(C.take(pieces, i), C.take(pieces, j)))
    found = {k: tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in v) for k, v in region.items()}
    care, care_at = _lists(found["care"][1], found["care"][0], n)
    earlier, earlier_at = _lists(found["earlier"][1], found["earlier"][0], n)

    dc = np.flatnonzero(kind == _DONT_CARE)
    left, owner = C.subtract(C.take(pieces, dc), np.arange(len(dc)), C.take(pieces, care), care_at[dc], care_at[dc + 1])
    yield _REGION, group[dc][owner], idx[dc][owner], np.full(len(owner), -1), C.measures(left)

    where, who = found["held"]
    both = C.overlap(C.take(pieces, where), C.take(pieces, who))
    solid = C.measures(both)[0] > 0
    both, where, who = C.take(both, solid), where[solid], who[solid]
    held, owner = C.subtract(both, np.arange(len(where)), C.take(pieces, care), care_at[where], care_at[where + 1])
    yield _HELD, group[where][owner], idx[where][owner], idx[who][owner], C.measures(held)

    # Every point counts once: what an earlier region holds is taken away.
    lost, owner = C.subtract(held, owner, C.take(pieces, earlier), earlier_at[where], earlier_at[where + 1])
    yield _LOST, group[where][owner], np.full(len(owner), -1), idx[who][owner], C.measures(lost)


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole cells, from rows in order of their cells."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        starts = np.flatnonzero(_changes(table))
        if starts[-1]:
            yield table.slice(0, int(starts[-1]))
        held = table.slice(int(starts[-1]))
    if held is not None:
        yield held


def _changes(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in ("image_id", "cell_x", "cell_y"):
        values = table[key].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return new


def _crowds(quads: DataFrame) -> DataFrame:
    """Images of more than ``CROWD`` quads, with a flag ``crowded``."""
    counts = quads.groupBy(*_IMAGE).agg(F.count(F.lit(1)).alias("n"))
    return materialise(counts.where((F.col("n") > CROWD) & F.col("image_id").isNotNull()).select(*_IMAGE, F.lit(True).alias("crowded")), "crowds")


def _dealt(sides: DataFrame, cell: int, crowds: DataFrame | None = None) -> DataFrame:
    """One row per quad of an image of at most ``CROWD`` quads, else one per quad and grid cell, as ``crowded``, cell_x, cell_y."""
    crowds = _crowds(sides) if crowds is None else crowds
    known = sides.join(crowds, _IMAGE, "left").withColumn("crowded", F.col("crowded").isNotNull())

    # Corners may lie on the far border of a cell; a cell that holds a border alone gives no area.
    return in_cells(known, cell, where="crowded")


def region_measures(words: DataFrame, boxes: DataFrame, cell: int = CELL, shared: bool = True, crowds: DataFrame | None = None) -> DataFrame:
    """Rows (image_id, kind, word_idx, det_idx, area, mx, my), scaled whole numbers, of all regions with some area.

    First moments are those of what detections lose, and 0 of other kinds, where nothing reads them.
    Without ``shared`` the areas that detections share with care words are not worked out. ``crowds`` are those of ``_crowds``, if known.
    """
    shape = [*_IMAGE, "kind", "idx", *QUAD]
    sides = words.select("image_id", F.when(F.col("dc"), _DONT_CARE).otherwise(_CARE).alias("kind"), F.col("word_idx").cast("long").alias("idx"), *QUAD)
    sides = sides.unionByName(boxes.select("image_id", F.lit(_DETECTED).alias("kind"), F.col("det_idx").cast("long").alias("idx"), *QUAD))
    dealt = _dealt(sides.select(*shape, *quad_bounds()), cell, crowds).select(*shape, "crowded", "cell_x", "cell_y")
    id_type = words.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            group = np.cumsum(_changes(table)) - 1
            firsts = np.flatnonzero(_changes(table))
            corner = np.stack([table["cell_x"].to_numpy(), table["cell_y"].to_numpy()], axis=1) * float(cell)
            crowded = table["crowded"].to_numpy()[:, None]
            bounds = np.concatenate([np.where(crowded, corner, -np.inf), np.where(crowded, corner + cell, np.inf)], axis=1)
            quads = np.stack([table[c].to_numpy() for c in QUAD], axis=1).reshape(-1, 4, 2)
            image = table["image_id"].combine_chunks()
            for kind, at, word, det, (area, mx, my) in cell_measures(group, bounds, table["kind"].to_numpy(), table["idx"].to_numpy(), quads, shared):
                some = area > 0
                mx, my = (v if kind == _LOST else np.zeros_like(v) for v in (mx, my))
                yield pa.RecordBatch.from_arrays(
                    [image.take(pa.array(firsts[at[some]])), pa.array(np.full(some.sum(), kind, np.int32)), pa.array(word[some]), pa.array(det[some]), *(pa.array(C.scaled(v[some])) for v in (area, mx, my))],
                    ["image_id", "kind", "word_idx", "det_idx", "area", "mx", "my"],
                )

    cells = dealt.repartition("image_id", "cell_x", "cell_y").sortWithinPartitions("image_id", "cell_x", "cell_y")
    parts = cells.mapInArrow(run, f"image_id {id_type}, kind int, word_idx long, det_idx long, area long, mx long, my long")
    return parts.groupBy("image_id", "kind", "word_idx", "det_idx").agg(*(F.sum(c).alias(c) for c in ("area", "mx", "my"))).where("area > 0")


def subtract_dont_care_quads(gt: DataFrame, det: DataFrame, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """What is left of don't-care regions and of the detections that touch them.

    Don't-care regions lose their overlap with care words; detections lose their overlap with the reduced regions. Returns
    ``pairs(image_id, det_idx, word_idx, inter, dc_area)`` and ``lost(image_id, det_idx, area, mx, my)``, the area and first moments
    of what a detection loses.
    """
    measured = materialise(region_measures(_words_of(gt), _whole(det), cell, shared=False), "measured")
    px = lambda c: (F.col(c) / C.SCALE).alias(c)
    regions = measured.where(F.col("kind") == _REGION).select(*_GT, (F.col("area") / C.SCALE).alias("dc_area"))
    pairs = measured.where(F.col("kind") == _HELD).select(*_DET, "word_idx", (F.col("area") / C.SCALE).alias("inter")).join(regions, _GT)
    return pairs, measured.where(F.col("kind") == _LOST).select(*_DET, px("area"), px("mx"), px("my"))


# ---- matching --------------------------------------------------------------------------------


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], whole: bool, how: str = "inner") -> DataFrame:
    """A join on an image and a box of it. Of ``whole`` images, which are no crowds, both sides are dealt by image alone.

    So steps by word, by detection and by image follow each other without a shuffle in between.
    """
    if not whole:
        return left.join(right, keys, how)
    image, idx = keys
    other = right.withColumnsRenamed({image: "__image", idx: "__idx"})
    # Not an equality, which would be a key of the shuffle.
    same = (F.col(idx) <= F.col("__idx")) & (F.col(idx) >= F.col("__idx"))
    return left.join(other, (F.col(image) == F.col("__image")) & same, how).drop("__image", "__idx")


def _detections(boxes: DataFrame, measured: DataFrame, r: float, p: float, whole: bool) -> DataFrame:
    """Detections with ``det_dc``, and the area and centre of what is left of them."""
    regions = measured.where(F.col("kind") == _REGION).select(*_GT, F.col("area").alias("dc_area"))
    held = _joined(measured.where(F.col("kind") == _HELD).select(*_DET, "word_idx", "area"), regions, _GT, whole)
    seen = held.groupBy(*_DET).agg(F.sum(F.when(F.col("area") / F.col("dc_area") > r, F.col("area")).otherwise(0)).alias("many"), F.max("area").alias("best"))
    lost = measured.where(F.col("kind") == _LOST).select(*_DET, F.col("area").alias("lost"), "mx", "my")
    x, y = _centre()
    sized = _joined(_joined(boxes, seen, _DET, whole, "left"), lost, _DET, whole, "left").withColumns({"det_area": _scaled_area(), "whole_cx": x, "whole_cy": y})
    flag = (_share(F.col("many"), F.col("det_area")) >= p) | (_share(F.col("best"), F.col("det_area")) > p)
    left = F.col("det_area") - F.coalesce("lost", F.lit(0))

    def centre(whole: Column, moment: str) -> Column:
        return F.when(F.col("lost").isNull(), whole).otherwise(F.coalesce(F.try_divide(whole * F.col("det_area") - F.col(moment), left), whole))

    return sized.select(*_DET, *QUAD, F.coalesce(flag & F.col("many").isNotNull(), F.lit(False)).alias("det_dc"), left.alias("left_area"), centre(F.col("whole_cx"), "mx").alias("left_cx"), centre(F.col("whole_cy"), "my").alias("left_cy"))


def _reading_line(prefix: str) -> dict[str, Column]:
    """Twice the middles of a word's left and right side; words much taller than wide are read upwards."""
    turned = dict(zip(QUAD, orient_vertical([prefix + c for c in QUAD])))
    return {f"{name}_{axis}": turned[f"{axis}{a}"] + turned[f"{axis}{b}"] for name, a, b in (("from", 1, 4), ("to", 2, 3)) for axis in "xy"}


def _judged(words: DataFrame, dets: DataFrame, measured: DataFrame, r: float, p: float, centre: float, whole: bool) -> DataFrame:
    """Pairs that may match, before the test of bends: flags one_to_one, om, mo, and both quads as l_ and r_ columns."""
    side = lambda df, prefix: df.withColumnsRenamed({c: prefix + c for c in QUAD})
    care = side(words.where("NOT dc"), "l_").drop("dc")
    pairs = measured.where(F.col("kind") == _SHARED).select(*_IMAGE, "word_idx", "det_idx", F.col("area").alias("inter"))
    pairs = _joined(_joined(pairs, care, _GT, whole), side(dets, "r_"), _DET, whole).withColumn("gt_area", _scaled_area("l_"))
    pairs = pairs.withColumns({"hit_r": _share(F.col("inter"), F.col("gt_area")) >= r, "hit_p": _share(F.col("inter"), F.col("left_area")) >= p}).where("hit_r OR hit_p")
    of_gt, of_det = Window.partitionBy(*_GT), Window.partitionBy(*_DET)
    many_det, many_gt = F.col("hit_p") & ~F.col("det_dc"), F.col("hit_r") & ~F.col("det_dc")

    def stats(over, many: Column, name: str) -> dict[str, Column]:
        return {
            f"{name}_hits": F.count_if(F.col("hit_r") & F.col("hit_p")).over(over), f"{name}_many": F.count_if(many).over(over),
            f"{name}_inter": F.sum(F.when(many, F.col("inter"))).over(over),
        }

    pairs = pairs.withColumns(stats(of_gt, many_det, "gt")).withColumns(stats(of_det, many_gt, "det"))
    cx, cy = _centre("l_")
    pairs = pairs.withColumns({"l_cx": cx, "l_cy": cy})
    gap = dist("l_cx", "l_cy", "left_cx", "left_cy")
    diagonals = mean_diagonal([f"l_{c}" for c in QUAD]) + mean_diagonal([f"r_{c}" for c in QUAD])
    judged = pairs.withColumns(
        {
            "one_to_one": F.col("hit_r") & F.col("hit_p") & ~F.col("det_dc") & (F.col("gt_hits") == 1) & (F.col("det_hits") == 1)
            & (F.coalesce(F.try_divide(gap * 2.0, diagonals), F.lit(0.0)) < centre),
            "om": many_det & (F.col("gt_many") >= 2) & (_share(F.col("gt_inter"), F.col("gt_area")) >= r),
            "mo": many_gt & (F.col("det_many") >= 2) & (_share(F.col("det_inter"), F.col("left_area")) >= p),
        }
    ).where("one_to_one OR om OR mo")
    return chars_in_quads(judged.withColumns(_reading_line("l_")))


@F.arrow_udf(ArrayType(IntegerType()))
def _places_inside(n: pa.Array, *lines: pa.Array) -> pa.Array:
    """Places of the n characters between two points (four columns) that lie in a quad (eight columns), some rows at a time."""
    n = np.maximum(n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 0)
    values = [v.to_numpy(zero_copy_only=False).astype(np.float64) for v in lines]
    ends = np.cumsum(n)
    found, many, start = [], [], 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _PLACES, side="right")))
        row = np.repeat(np.arange(start, stop), n[start:stop])
        place = np.arange(len(row)) - np.repeat(ends[start:stop] - n[start:stop] - ends[start] + n[start], n[start:stop])
        kept = _inside(n[row], place, [v[row] for v in values])
        found.append(place[kept])
        many.append(np.bincount(row[kept] - start, minlength=stop - start))
        start = stop
    offsets = np.concatenate([np.zeros(1, np.int64), *many]).cumsum()
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found]), pa.int32()))


def _inside(n: np.ndarray, place: np.ndarray, lines: list[np.ndarray]) -> np.ndarray:
    """Whether a quad contains the centre of a character, border included."""
    # Four n times the centre of a character is a whole number, so centres on a border are told without rounding.
    (from_x, from_y, to_x, to_y), corners = lines[:4], lines[4:]
    x, y = (a * (2 * n) + (b - a) * (2 * place + 1) for a, b in ((from_x, to_x), (from_y, to_y)))
    border, odd, unknown = (np.zeros(len(n), bool) for _ in range(3))
    for k in range(4):
        a_x, a_y, b_x, b_y = (corners[(2 * k + i) % 8] for i in range(4))
        x0, y0, x1, y1 = (v * (4 * n) for v in (a_x, a_y, b_x, b_y))
        turn = (b_x - a_x) * (y - y0) - (b_y - a_y) * (x - x0)
        along = (x >= np.minimum(x0, x1)) & (x <= np.maximum(x0, x1)) & (y >= np.minimum(y0, y1)) & (y <= np.maximum(y0, y1))
        border |= (turn == 0) & along
        # Whether a ray to the right of the point meets this side; an odd number of sides means inside, for reflex corners, too.
        meets = (y0 > y) != (y1 > y)
        odd ^= meets & ((turn > 0) == (y1 > y0))
        unknown |= np.isnan(y0) | np.isnan(y1) | (meets & np.isnan(turn))  # a missing corner
    return border | (odd & ~unknown)


def chars_in_quads(pairs: DataFrame) -> DataFrame:
    """Add ``inside``: places of the word's pseudo characters whose centre the detection contains, border included.

    ``pairs``: n_chars, from_x, from_y, to_x, to_y (``_reading_line``) and the detection as r_x1..r_y4. Centres are evenly spaced along the line.
    """
    columns = [F.coalesce(F.col("n_chars"), F.lit(0)).cast("int"), *(F.col(c).cast("double") for c in (*_LINE, *(f"r_{c}" for c in QUAD)))]
    return pairs.withColumn("inside", _places_inside(*columns)).drop(*_LINE)


def detection_matches_quads(
    gt: DataFrame, det: DataFrame, r: float = AREA_RECALL, p: float = AREA_PRECISION, centre: float = CENTRE_LIMIT, cell: int = CELL
) -> tuple[DataFrame, DataFrame]:
    """(matches, detections), as ``detection.detection_matches`` has them, with quads in columns l_x1..l_y4 and r_x1..r_y4, and ``inside``.

    A quad's pivot, from which bends are measured, is the middle between its first and its last corner.
    """
    words, boxes = _words_of(gt), _whole(det).select(*_DET, *QUAD)
    crowds = _crowds(words.select(*_IMAGE).unionByName(boxes.select(*_IMAGE)))
    measured = materialise(region_measures(words, boxes, cell, crowds=crowds), "measured")
    parts = [(words, boxes, measured, True)]
    if not crowds.isEmpty():
        parts = [(*(df.join(crowds.select(*_IMAGE), _IMAGE, how) for df in (words, boxes, measured)), how == "left_anti") for how in ("left_anti", "left_semi")]
    found = [_detections(b, m, r, p, whole) for _, b, m, whole in parts]
    dets = reduce(DataFrame.unionByName, found)
    judged = materialise(reduce(DataFrame.unionByName, [_judged(w, d, m, r, p, centre, whole) for (w, _, m, whole), d in zip(parts, found)]), "judged")

    def members(flag: str, keys: list[str], member: str, count: str, prefix: str) -> DataFrame:
        cx, cy = _centre(prefix)
        px, py = ((F.col(f"{prefix}{axis}1") + F.col(f"{prefix}{axis}4")) / 2.0 for axis in "xy")
        return judged.where(flag).select(*keys, F.col(member).alias("id"), F.col(count).alias("n"), px.alias("px"), py.alias("py"), cx.alias("cx"), cy.alias("cy"))

    bent_gt = bent_groups(members("om", _GT, "det_idx", "gt_many", "r_"), _GT).withColumn("bent_gt", F.lit(True))
    bent_det = bent_groups(members("mo", _DET, "word_idx", "det_many", "l_"), _DET).withColumn("bent_det", F.lit(True))
    matches = judged.join(bent_gt, _GT, "left").join(bent_det, _DET, "left").withColumns(
        {"one_to_many": F.col("om") & F.col("bent_gt").isNull(), "many_to_one": F.col("mo") & F.col("bent_det").isNull()}
    ).where("one_to_one OR one_to_many OR many_to_one")
    return matches.select(*_IMAGE, "word_idx", "det_idx", "n_chars", "one_to_one", "one_to_many", "many_to_one", "inside", *[s + c for s in ("l_", "r_") for c in QUAD]), dets


def detection_eval_quads_per_image(
    gt: DataFrame, det: DataFrame, r: float = AREA_RECALL, p: float = AREA_PRECISION, centre: float = CENTRE_LIMIT, empty: str = "one", cell: int = CELL
) -> DataFrame:
    """Recall, precision and harmonic mean of every image of either table, as ``detection.detection_eval_per_image`` on axis boxes.

    ``cell`` is the side of a grid cell; any value gives the same result, one of a few text heights keeps cells small.
    """
    matches, dets = detection_matches_quads(gt, det, r, p, centre, cell)
    inside = materialise(matches.select(*_IMAGE, "word_idx", "det_idx", "n_chars", "inside"), "chars")
    counts = (
        _words_of(gt).select("image_id", (~F.col("dc")).cast("long").alias("g"), F.lit(0).alias("d"))
        .unionByName(dets.select("image_id", F.lit(0).cast("long").alias("g"), (~F.col("det_dc")).cast("int").alias("d")))
        .groupBy(*_IMAGE).agg(F.sum("g").alias("n_gt"), F.sum("d").alias("n_det"))
    )
    return rates_per_image(inside, counts, empty)
