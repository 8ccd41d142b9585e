"""Detection scoring against ground truth with pseudo characters, on axis boxes.

Inputs: ``gt(image_id, word_idx, text, xmin, ymin, xmax, ymax)`` and
``det(image_id, det_idx, xmin, ymin, xmax, ymax)``. Images of up to ``PAGE_BOXES`` words and as
many detections are matched whole, dealt by image. In larger ones every step is keyed by a box or
by an (image, grid cell), never by the image alone, so one crowded image spreads over the cluster.
Thresholds compare one division of exact whole-number areas, so results do not depend on
the order in which Spark adds rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions.geometry import BOX
from pagelake.functions.text import DONT_CARE
from pagelake.operators.joins import CELL, overlap_area, overlapping, overlapping_in_pages
from pagelake.operators.ordered import number_rows, running, split_points
from pagelake.session import materialise

AREA_RECALL = 0.4
AREA_PRECISION = 0.4
CENTRE_LIMIT = 1.0
BEND_LIMIT_ROWS = 64
PAGE_BOXES = 256

_IMAGE, _GT, _DET = ["image_id"], ["image_id", "word_idx"], ["image_id", "det_idx"]


def _ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(F.col(part) if isinstance(part, str) else part,
                                   F.col(whole) if isinstance(whole, str) else whole), F.lit(0.0))


def _whole(df: DataFrame) -> DataFrame:
    """Coordinates truncated to whole numbers."""
    return df.withColumns({c: F.col(c).cast("long") for c in BOX})


def _area() -> Column:
    return (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))


def overlap_pairs(gt: DataFrame, det: DataFrame, cell: int = CELL) -> DataFrame:
    """Overlapping (truth, detection) boxes with shared area, recall and precision.

    Boxes without shared area have recall and precision 0 and are left out.
    """
    left = _whole(gt).select(*_GT, *BOX)
    right = _whole(det).select(*_DET, *BOX)
    pairs = overlapping(left, right, _IMAGE, cell).withColumns(
        {
            "inter": overlap_area(),
            "gt_area": (F.col("l_xmax") - F.col("l_xmin")) * (F.col("l_ymax") - F.col("l_ymin")),
            "det_area": (F.col("r_xmax") - F.col("r_xmin")) * (F.col("r_ymax") - F.col("r_ymin")),
        }
    )
    return pairs.select(
        *_IMAGE, "word_idx", "det_idx", "inter", "gt_area", "det_area",
        _ratio("inter", "gt_area").alias("recall"), _ratio("inter", "det_area").alias("precision"),
    )


# ---- regions covered by some boxes and not by others ---------------------------------------


def covered_measures(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area and first moments, per key, of the points in some plus box and in no minus box.

    ``boxes`` holds whole-number boxes and ``plus`` (true or false). Each key's x breakpoints cut
    its boxes into strips; inside a strip a running count over the y breakpoints tells what is
    covered. Breakpoints are pixel columns and rows, so lists and frames are bounded by the page
    size however many boxes there are. A key of one box needs no strips. ``boxes`` is read more than once.
    """
    sized = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.every("plus").alias("plus"), *[F.max(c).alias(c) for c in BOX])
    own = F.when(F.col("plus") & (F.col("ymin") < F.col("ymax")), _area()).otherwise(F.lit(0))
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    alone = sized.where((F.col("__n") == 1) & (F.col("xmin") < F.col("xmax")) & known).withColumn("area", own).select(
        *keys, "area",
        F.coalesce(F.col("area") * (F.col("xmin") + F.col("xmax")), F.lit(0)).alias("twice_mx"),
        F.coalesce(F.col("area") * (F.col("ymin") + F.col("ymax")), F.lit(0)).alias("twice_my"),
    )
    boxes = boxes.join(sized.where("__n > 1").select(*keys), list(keys), "left_semi")
    cuts = boxes.groupBy(*keys).agg(
        F.array_sort(F.array_union(F.collect_set("xmin"), F.collect_set("xmax"))).alias("__cuts")
    )
    cut = boxes.join(cuts, list(keys)).withColumn(
        "__strip",
        F.explode(
            F.filter(
                F.transform(
                    F.slice("__cuts", 1, F.size("__cuts") - 1),
                    lambda x, i: F.struct(x.alias("a"), F.get("__cuts", i + 1).alias("b")),
                ),
                lambda s: (s["a"] >= F.col("xmin")) & (s["b"] <= F.col("xmax")),
            )
        ),
    )
    step = F.when(F.col("plus"), F.struct(F.lit(1).alias("p"), F.lit(0).alias("m"))).otherwise(
        F.struct(F.lit(0).alias("p"), F.lit(1).alias("m"))
    )
    marks = cut.select(
        *keys,
        "__strip",
        F.explode(
            F.array(
                F.struct(F.col("ymin").alias("y"), step["p"].alias("p"), step["m"].alias("m")),
                F.struct(F.col("ymax").alias("y"), (-step["p"]).alias("p"), (-step["m"]).alias("m")),
            )
        ).alias("e"),
    )
    levels = marks.groupBy(*keys, "__strip", F.col("e.y").alias("y")).agg(
        F.sum("e.p").alias("p"), F.sum("e.m").alias("m")
    )
    down = Window.partitionBy(*keys, "__strip").orderBy("y")
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = levels.select(
        *keys,
        "__strip",
        "y",
        F.lead("y").over(down).alias("y2"),
        ((F.sum("p").over(upto) > 0) & (F.sum("m").over(upto) == 0)).alias("covered"),
    )
    area = F.when(F.col("covered"), (F.col("__strip.b") - F.col("__strip.a")) * (F.col("y2") - F.col("y")))
    swept = spans.groupBy(*keys).agg(
        F.coalesce(F.sum(area), F.lit(0)).alias("area"),
        F.coalesce(F.sum(area * (F.col("__strip.a") + F.col("__strip.b"))), F.lit(0)).alias("twice_mx"),
        F.coalesce(F.sum(area * (F.col("y") + F.col("y2"))), F.lit(0)).alias("twice_my"),
    )
    return swept.unionByName(alone)


def _clipped(plus: bool) -> list[Column]:
    return [
        F.greatest("l_xmin", "r_xmin").alias("xmin"),
        F.greatest("l_ymin", "r_ymin").alias("ymin"),
        F.least("l_xmax", "r_xmax").alias("xmax"),
        F.least("l_ymax", "r_ymax").alias("ymax"),
        F.lit(plus).alias("plus"),
    ]


def subtract_dont_care(gt: DataFrame, det: DataFrame, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """What is left of don't-care regions and of the detections that touch them.

    Don't-care regions lose their overlap with care words; detections lose their overlap with the
    reduced regions. Returns

    * ``pairs(image_id, det_idx, word_idx, inter, dc_area)``: detection x reduced region, and
    * ``lost(image_id, det_idx, area, twice_mx, twice_my)``: what each detection loses.
    """
    return _subtract(*_sides(gt, det), cell)


def _sides(gt: DataFrame, det: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _words_of(gt), materialise(_whole(det).select(*_DET, *BOX), "det")


def page_parts(words: DataFrame, boxes: DataFrame, cell: int) -> list[tuple[DataFrame, DataFrame, int | None]]:
    """(words, detections, cell) of the images that are matched whole (no cell), and of the crowded ones if there are any."""
    ones = words.select(*_IMAGE, F.lit(1).alias("g"), F.lit(0).alias("d")).unionByName(boxes.select(*_IMAGE, F.lit(0).alias("g"), F.lit(1).alias("d")))
    counts = ones.groupBy(*_IMAGE).agg(F.sum("g").alias("g"), F.sum("d").alias("d"))
    crowded = materialise(counts.where((F.greatest("g", "d") > PAGE_BOXES) & F.col("image_id").isNotNull()).select(*_IMAGE), "crowded")
    if crowded.isEmpty():
        return [(words, boxes, None)]
    parts = [("left_anti", None), ("left_semi", cell)]
    return [(words.join(crowded, _IMAGE, how), boxes.join(crowded, _IMAGE, how), size) for how, size in parts]


def meeting(left: DataFrame, right: DataFrame, cell: int | None) -> DataFrame:
    return overlapping_in_pages(left, right, _IMAGE) if cell is None else overlapping(left, right, _IMAGE, cell)


def _words_of(gt: DataFrame) -> DataFrame:
    """The narrow truth table that every scoring step reads, written once."""
    words = _whole(gt).select(*_GT, F.coalesce(F.col("text") == DONT_CARE, F.lit(False)).alias("dc"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), *BOX)
    return materialise(words, "gt")


def _subtract(words: DataFrame, boxes: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    return _subtract_parts(page_parts(words.drop("n_chars"), boxes, cell))


def _subtract_parts(parts: list[tuple[DataFrame, DataFrame, int | None]]) -> tuple[DataFrame, DataFrame]:
    def care_of(words: DataFrame) -> DataFrame:
        return words.where("not dc").select("image_id", F.col("word_idx").alias("care_idx"), *BOX)

    dcs = [(words.where("dc").select(*_GT, *BOX), words, boxes, size) for words, boxes, size in parts]
    dc = reduce(DataFrame.unionByName, [d for d, *_ in dcs])
    hit_boxes = reduce(DataFrame.unionByName, [meeting(d, boxes, size).select(*_DET, "word_idx", *_clipped(True)) for d, _, boxes, size in dcs])
    dc_care = reduce(DataFrame.unionByName, [meeting(d, care_of(words), size).select(*_GT, "care_idx", *_clipped(False)) for d, words, _, size in dcs])
    hit_boxes, dc_care = materialise(hit_boxes, "hits"), materialise(dc_care, "dc_care")  # small beside the tables, and read twice
    # Care words inside the part of a detection that a don't-care region covers.
    held = (
        hit_boxes.alias("h")
        .join(dc_care.alias("c"), _GT)
        .select(
            "image_id", "det_idx", "word_idx",
            F.greatest("h.xmin", "c.xmin").alias("xmin"), F.greatest("h.ymin", "c.ymin").alias("ymin"),
            F.least("h.xmax", "c.xmax").alias("xmax"), F.least("h.ymax", "c.ymax").alias("ymax"),
            F.lit(False).alias("plus"),
        )
        .where((F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax")))
    )
    none = F.lit(-1).cast("long")
    word_key, det_key = F.col("word_idx").cast("long"), F.col("det_idx").cast("long")
    box_cols = [*BOX, "plus"]

    def region(df: DataFrame, a: Column, b: Column) -> DataFrame:
        return df.select("image_id", a.alias("a"), b.alias("b"), *box_cols)

    single = dc.withColumn("plus", F.lit(True))
    both = hit_boxes.unionByName(held)
    # Each covered part of a detection counts for its own region and for all regions together.
    keyed = region(single.unionByName(dc_care.drop("care_idx")), none, word_key).unionByName(
        region(both, det_key, F.explode(F.array(word_key, none)))
    )
    measured = materialise(covered_measures(materialise(keyed, "regions"), ["image_id", "a", "b"]), "measured")
    dc_area = measured.where("a = -1").select("image_id", F.col("b").alias("word_idx"), F.col("area").alias("dc_area"))
    pairs = (
        measured.where("a >= 0 and b >= 0 and area > 0")
        .select("image_id", F.col("a").alias("det_idx"), F.col("b").alias("word_idx"), F.col("area").alias("inter"))
        .join(dc_area, _GT)
    )
    lost = measured.where("a >= 0 and b = -1 and area > 0").select(
        "image_id", F.col("a").alias("det_idx"), "area", "twice_mx", "twice_my"
    )
    return pairs, lost


def mark_det_dont_care(
    det: DataFrame, dc_pairs: DataFrame, r: float = AREA_RECALL, p: float = AREA_PRECISION
) -> DataFrame:
    """Add ``det_dc``: the detection mostly covers don't-care regions, or one covers most of it.

    Regions covered by more than ``r`` of their area count together; shared areas are summed
    before the one division by the detection's area.
    """
    sized = _whole(det).withColumn("det_area", _area())
    return _flagged(sized.join(_det_sums(dc_pairs, r), _DET, "left"), p)


def _det_sums(dc_pairs: DataFrame, r: float) -> DataFrame:
    return dc_pairs.groupBy(*_DET).agg(
        F.sum(F.when(_ratio("inter", "dc_area") > r, F.col("inter")).otherwise(0)).alias("__many"),
        F.max("inter").alias("__best"),
    )


def _flagged(dets: DataFrame, p: float) -> DataFrame:
    flag = (_ratio("__many", "det_area") >= p) | (_ratio("__best", "det_area") > p)
    return dets.withColumn("det_dc", F.coalesce(flag & F.col("__many").isNotNull(), F.lit(False))).drop("__many", "__best")


# ---- matching ------------------------------------------------------------------------------


def _bends(i: Column, k: Column) -> Column:
    """The angle at centre k between pivot i and centre i is within 45..135 degrees.

    Folded angle >= 45 means |cross| >= |dot|; a vector of length zero counts as pointing along x.
    """
    ux, uy = i["px"] - k["cx"], i["py"] - k["cy"]
    vx, vy = i["cx"] - k["cx"], i["cy"] - k["cy"]
    ux, vx = (F.when((x == 0) & (y == 0), F.lit(1.0)).otherwise(x) for x, y in ((ux, uy), (vx, vy)))
    return F.abs(ux * vy - uy * vx) >= F.abs(ux * vx + uy * vy)


def bent_groups(members: DataFrame, keys: Sequence[str], limit: int = BEND_LIMIT_ROWS) -> DataFrame:
    """Keys of groups in which some ordered pair of members bends by 45 degrees or more.

    ``members`` has keys, ``id``, ``n`` (group size), pivot px, py, centre cx, cy. Groups up to
    ``limit`` rows are tested as one array. Larger groups use a semi join, which keeps at most one
    row per member. A pair can only bend when the two centres are close to the pivot arm, so the
    partner is looked up in grid cells about as large as the arm, one grid per power of two.
    """
    point = F.struct("id", "px", "py", "cx", "cy")
    small = (
        members.where(F.col("n") <= limit)
        .groupBy(*keys)
        .agg(F.collect_list(point).alias("m"))
        .where(F.exists("m", lambda i: F.exists("m", lambda k: (i["id"] != k["id"]) & _bends(i, k))))
        .select(*keys)
    )
    big = members.where(F.col("n") > limit).select(*keys, point.alias("m"))
    arm = F.abs(F.col("m.px") - F.col("m.cx")) + F.abs(F.col("m.py") - F.col("m.cy"))
    level = F.greatest(F.ceil(F.log2(F.greatest(arm * 1.5, F.lit(1.0)))), F.lit(0)).cast("int")
    levels = range(0, 32)

    def at(value: Column, lvl: Column) -> Column:
        return F.floor(value / F.pow(F.lit(2.0), lvl))

    seek = big.withColumn("level", level)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    seek = (
        seek.withColumn("dx", F.explode(around))
        .withColumn("dy", F.explode(around))
        .withColumn("cell_x", at(F.col("m.cx"), F.col("level")) + F.col("dx"))
        .withColumn("cell_y", at(F.col("m.cy"), F.col("level")) + F.col("dy"))
    )
    used = big.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    used = used.select(
        *[F.col(k).alias(f"k_{k}") for k in keys],
        F.col("level").alias("k_level"),
        at(F.col("m.cx"), F.col("level")).alias("k_x"),
        at(F.col("m.cy"), F.col("level")).alias("k_y"),
        F.col("m").alias("k_m"),
    )
    condition = (
        (F.col("level") == F.col("k_level"))
        & (F.col("cell_x") == F.col("k_x"))
        & (F.col("cell_y") == F.col("k_y"))
        & (F.col("m.id") != F.col("k_m.id"))
        & _bends(F.col("m"), F.col("k_m"))
    )
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"k_{k}"))
    return small.unionByName(seek.join(used, condition, "left_semi").select(*keys)).distinct()


def detection_matches(
    gt: DataFrame,
    det: DataFrame,
    r: float = AREA_RECALL,
    p: float = AREA_PRECISION,
    centre: float = CENTRE_LIMIT,
    det_pivot: str = "bottom",
    cell: int = CELL,
) -> tuple[DataFrame, DataFrame]:
    """(matches, detections).

    ``matches`` has one row per matched pair with flags ``one_to_one``, ``one_to_many``,
    ``many_to_one`` and both boxes; ``detections`` is ``det`` with ``det_dc`` and what is left of
    its area. ``det_pivot`` is the side that carries the pivot of a detection: "bottom" for
    corners listed from the bottom left, "left" for corners listed from the top left.
    """
    return _matches(*_sides(gt, det), r, p, centre, det_pivot, cell)


def _matches(
    words: DataFrame, boxes: DataFrame, r: float, p: float, centre: float, det_pivot: str, cell: int
) -> tuple[DataFrame, DataFrame]:
    parts = page_parts(words, boxes, cell)
    dc_pairs, lost = _subtract_parts(parts)
    matched = [_part_matches(*part, dc_pairs, lost, r, p, centre, det_pivot) for part in parts]
    matches, dets = zip(*matched)
    return reduce(DataFrame.unionByName, matches), reduce(DataFrame.unionByName, dets)


def _part_matches(
    words: DataFrame, boxes: DataFrame, cell: int | None, dc_pairs: DataFrame, lost: DataFrame,
    r: float, p: float, centre: float, det_pivot: str,
) -> tuple[DataFrame, DataFrame]:
    """Matches and detections of images that are matched whole, or (with ``cell``) of crowded ones."""
    whole = cell is None
    left_area = F.col("det_area") - F.coalesce("lost_area", F.lit(0))

    def centre_of(low: str, high: str, moment: str) -> Column:
        full = F.col("det_area") * (F.col(low) + F.col(high)) - F.coalesce(moment, F.lit(0))
        return F.coalesce(F.try_divide(full, left_area * 2), (F.col(low) + F.col(high)) / 2)

    lost = lost.withColumnRenamed("area", "lost_area")
    if whole:
        # One small table for each image's touched detections, met by image: the detections stay dealt by image.
        seen = _det_sums(dc_pairs, r).join(lost, _DET, "full").withColumnsRenamed({"image_id": "__image", "det_idx": "__det"})
        same = (F.col("image_id") == F.col("__image")) & (F.col("det_idx") - F.col("__det") == 0)
        dets = _flagged(_whole(boxes).withColumn("det_area", _area()).join(seen, same, "left"), p).drop("__image", "__det")
    else:
        dets = mark_det_dont_care(boxes, dc_pairs, r, p).join(lost, _DET, "left")
    dets = (
        dets.withColumn("left_area", left_area)
        .withColumn("left_cx", centre_of("xmin", "xmax", "twice_mx"))
        .withColumn("left_cy", centre_of("ymin", "ymax", "twice_my"))
        .drop("lost_area", "twice_mx", "twice_my")
    )
    dets = dets if whole else materialise(dets, "dets")
    care = words.where("not dc").drop("dc")
    pairs = meeting(care, dets, cell).withColumns(
        {"inter": overlap_area(), "gt_area": (F.col("l_xmax") - F.col("l_xmin")) * (F.col("l_ymax") - F.col("l_ymin"))}
    )
    over_r, over_p = _ratio("inter", "gt_area") >= r, _ratio("inter", "left_area") >= p
    pairs = pairs.withColumns({"hit_r": over_r, "hit_p": over_p}).where("hit_r or hit_p")
    pairs = pairs.where("word_idx IS NOT NULL AND det_idx IS NOT NULL") if whole else materialise(pairs, "pairs")

    def sums(side: Column, name: str) -> dict[str, Column]:
        return {
            f"{name}_hits": F.count_if(F.col("hit_r") & F.col("hit_p")),
            f"{name}_many": F.count_if(side),
            f"{name}_inter": F.sum(F.when(side, F.col("inter"))),
        }

    def with_stats(df: DataFrame, keys: list[str], side: Column, name: str) -> DataFrame:
        if whole:
            return df.withColumns({n: c.over(Window.partitionBy(*keys)) for n, c in sums(side, name).items()})
        return df.join(pairs.groupBy(*keys).agg(*[c.alias(n) for n, c in sums(side, name).items()]), keys)

    many_det, many_gt = F.col("hit_p") & ~F.col("det_dc"), F.col("hit_r") & ~F.col("det_dc")
    judged = with_stats(with_stats(pairs, _GT, many_det, "gt"), _DET, many_gt, "det")
    mid_x, mid_y = (F.col("l_xmin") + F.col("l_xmax")) / 2, (F.col("l_ymin") + F.col("l_ymax")) / 2
    gap = F.sqrt(F.pow(mid_x - F.col("left_cx"), F.lit(2)) + F.pow(mid_y - F.col("left_cy"), F.lit(2)))

    def diagonal(side: str) -> Column:
        w, h = F.col(f"{side}_xmax") - F.col(f"{side}_xmin"), F.col(f"{side}_ymax") - F.col(f"{side}_ymin")
        return F.sqrt((w * w + h * h).cast("double"))

    judged = judged.withColumns(
        {
            "one_to_one": F.col("hit_r") & F.col("hit_p") & ~F.col("det_dc")
            & (F.col("gt_hits") == 1) & (F.col("det_hits") == 1)
            & (F.coalesce(F.try_divide(gap * 2.0, diagonal("l") + diagonal("r")), F.lit(0.0)) < centre),
            "om": many_det & (F.col("gt_many") >= 2) & (_ratio("gt_inter", "gt_area") >= r),
            "mo": many_gt & (F.col("det_many") >= 2) & (_ratio("det_inter", "left_area") >= p),
        }
    ).where("one_to_one or om or mo")

    def points(member: str, side: str, pivot: str) -> dict[str, Column]:
        cx = (F.col(f"{side}_xmin") + F.col(f"{side}_xmax")) / 2.0
        cy = (F.col(f"{side}_ymin") + F.col(f"{side}_ymax")) / 2.0
        px, py = (cx, F.col(f"{side}_ymax").cast("double")) if pivot == "bottom" else (
            F.col(f"{side}_xmin").cast("double"), cy)
        return {"id": F.col(member), "px": px, "py": py, "cx": cx, "cy": cy}

    kinds = [
        ("mo", "bent_det", _DET, "det_many", points("word_idx", "l", "left")),
        ("om", "bent_gt", _GT, "gt_many", points("det_idx", "r", det_pivot)),
    ]
    if whole:
        matches = judged
        for flag, name, keys, _, point in kinds:
            group, own = Window.partitionBy(*keys), F.struct(*[c.alias(n) for n, c in point.items()])
            matches = matches.withColumn("__own", F.when(F.col(flag), own))
            matches = matches.withColumn("__all", F.collect_list("__own").over(group))
            bends = F.exists("__all", lambda k: (F.col("__own.id") != k["id"]) & _bends(F.col("__own"), k))
            matches = matches.withColumn(name, F.when(F.col(flag), bends)).drop("__own", "__all")
            matches = matches.withColumn(name, F.coalesce(F.max(name).over(group), F.lit(False)))
    else:
        judged = matches = materialise(judged, "judged")
        for flag, name, keys, count, point in kinds:
            members = judged.where(flag).select(*keys, F.col(count).alias("n"), *[c.alias(n) for n, c in point.items()])
            matches = matches.join(bent_groups(members, keys).withColumn(name, F.lit(True)), keys, "left").fillna(False, [name])
    matches = (
        matches.withColumn("one_to_many", F.col("om") & ~F.col("bent_gt"))
        .withColumn("many_to_one", F.col("mo") & ~F.col("bent_det"))
        .where("one_to_one or one_to_many or many_to_one")
    )
    sides = [f"{s}_{c}" for s in "lr" for c in BOX]
    return matches.select(*_IMAGE, "word_idx", "det_idx", "n_chars", "one_to_one", "one_to_many", "many_to_one", *sides), dets


def chars_in_detections(matches: DataFrame) -> DataFrame:
    """Add ``inside``: places of the word's pseudo characters whose centre the detection contains.

    Centres are evenly spaced on the middle line, along the long side of tall words (over 1.5).
    """
    w, h = F.col("l_xmax") - F.col("l_xmin"), F.col("l_ymax") - F.col("l_ymin")
    tall = h > w * 1.5
    n = F.col("n_chars").cast("int")

    def inside(i: Column) -> Column:
        share = (i.cast("double") + 0.5) / n
        x = F.when(tall, (F.col("l_xmin") + F.col("l_xmax")) / 2.0).otherwise(F.col("l_xmin") + w * share)
        y = F.when(tall, F.col("l_ymax") - h * share).otherwise((F.col("l_ymin") + F.col("l_ymax")) / 2.0)
        return (
            (x >= F.col("r_xmin")) & (x <= F.col("r_xmax")) & (y >= F.col("r_ymin")) & (y <= F.col("r_ymax"))
        )

    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    # Centres are in order along their line, so those inside follow one another. The first and the last one are worked out
    # and checked with their neighbours, which is exact where rounding is far below the distance of two centres.
    # Going down a tall word, values are compared with their signs turned.
    sign, lead, size, near, far = (F.col(f"__{c}") for c in ("sign", "lead", "size", "near", "far"))
    line = matches.withColumns({
        "__sign": F.when(tall, F.lit(-1.0)).otherwise(F.lit(1.0)),
        "__lead": F.when(tall, F.col("l_ymax")).otherwise(F.col("l_xmin")),
        "__size": F.when(tall, -h).otherwise(w).cast("double"),
        "__near": F.when(tall, F.col("r_ymax")).otherwise(F.col("r_xmin")),
        "__far": F.when(tall, F.col("r_ymin")).otherwise(F.col("r_xmax")),
        "__mid": F.when(tall, F.col("l_xmin") + F.col("l_xmax")).otherwise(F.col("l_ymin") + F.col("l_ymax")) / 2.0,
        "__low": F.when(tall, F.col("r_xmin")).otherwise(F.col("r_ymin")),
        "__high": F.when(tall, F.col("r_xmax")).otherwise(F.col("r_ymax")),
        "__reach": F.greatest(*[F.abs(F.col(f"{side}_{c}").cast("double")) for side in "lr" for c in BOX]),
    })

    def ahead(i: Column, edge: Column) -> Column:
        """How far centre i lies behind the edge, along the line; as exact as its place."""
        return (lead + size * ((i.cast("double") + 0.5) / n)) * sign - edge * sign

    def guess(edge: Column, up: bool) -> Column:
        at = F.try_divide(edge - lead, size) * n - 0.5
        return F.greatest(F.least(F.ceil(at) if up else F.floor(at), n), F.lit(-1)).cast("int")

    plain = (F.col("__reach") <= 2**31) & (w > 0) & (h > 0) & n.between(1, 10_000)
    run = line.withColumns({"__first": F.when(plain, guess(near, True)), "__last": F.when(plain, guess(far, False))})
    f, e = F.col("__first"), F.col("__last")
    first = F.when(ahead(f - 1, near) >= 0, f - 1).when(ahead(f, near) >= 0, f).otherwise(f + 1)
    last = F.when(ahead(e + 1, far) <= 0, e + 1).when(ahead(e, far) <= 0, e).otherwise(e - 1)
    run = run.withColumns({"__first": F.greatest(first, F.lit(0)), "__last": F.least(last, n - 1)})
    some = F.col("__mid").between(F.col("__low"), F.col("__high")) & (f <= e)
    found = F.when(some, F.sequence(f, e)).otherwise(F.array().cast("array<int>"))
    found = F.when(plain, found).otherwise(F.filter(every, inside))
    names = [c for c in run.columns if c.startswith("__") and c not in matches.columns]
    return run.withColumn("inside", found).drop(*names)


def _safe_hmean(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))


def detection_eval_per_image(
    gt: DataFrame,
    det: DataFrame,
    r: float = AREA_RECALL,
    p: float = AREA_PRECISION,
    centre: float = CENTRE_LIMIT,
    empty: str = "one",
    det_pivot: str = "bottom",
    cell: int = CELL,
) -> DataFrame:
    """Recall, precision and harmonic mean of every image of either table.

    A word scores the share of its characters that exactly one matched detection contains; a
    detection scores the share it contains of the characters of its words. ``empty="one"`` gives
    an image without care words recall 1 and precision 1 or 0; ``"zero"`` gives the plain ratio.
    """
    words, boxes = _sides(gt, det)
    matches, dets = _matches(words, boxes, r, p, centre, det_pivot, cell)
    inside = materialise(
        chars_in_detections(matches).select(*_IMAGE, "word_idx", "det_idx", "n_chars", "inside"), "chars"
    )
    counts = (
        words.select("image_id", (~F.col("dc")).cast("long").alias("g"), F.lit(0).alias("d"))
        .unionByName(dets.select("image_id", F.lit(0).cast("long").alias("g"), (~F.col("det_dc")).cast("int").alias("d")))
        .groupBy(*_IMAGE).agg(F.sum("g").alias("n_gt"), F.sum("d").alias("n_det"))
    )
    return rates_per_image(inside, counts, empty)


def rates_per_image(inside: DataFrame, counts: DataFrame, empty: str) -> DataFrame:
    """Rates from matched pairs (image_id, word_idx, det_idx, n_chars, inside) and counts (image_id, n_gt, n_det)."""
    if empty not in ("one", "zero"):
        raise ValueError(f"unknown rule {empty}")
    # The places of a word with one match are counted at once; those of other words one by one.
    alone = F.count(F.lit(1)).over(Window.partitionBy(*_GT, "n_chars")) == 1
    places = F.when(F.col("alone"), F.array(F.lit(-1))).otherwise(F.col("inside"))
    once = (
        inside.withColumn("alone", alone).select(*_GT, "n_chars", F.when(F.col("alone"), F.size("inside")).alias("own"), F.explode(places).alias("c"))
        .groupBy(*_GT, "n_chars", "c").agg(F.count(F.lit(1)).alias("k"), F.max("own").alias("own"))
        .groupBy(*_GT, "n_chars").agg(F.sum(F.when(F.col("own").isNotNull(), F.col("own")).otherwise((F.col("k") == 1).cast("int"))).alias("once"))
        .groupBy(*_IMAGE).agg(F.sum(_ratio("once", "n_chars")).alias("recall_sum"))
    )
    held = (
        inside.groupBy(*_DET)
        .agg(F.sum(F.size("inside")).alias("held"), F.sum("n_chars").alias("total"))
        .groupBy(*_IMAGE).agg(F.sum(_ratio("held", "total")).alias("precision_sum"))
    )
    per = counts.join(once, _IMAGE, "left").join(held, _IMAGE, "left").fillna(0.0, ["recall_sum", "precision_sum"])
    recall, precision = _ratio("recall_sum", "n_gt"), _ratio("precision_sum", "n_det")
    if empty == "one":
        bare = F.col("n_gt") == 0
        recall = F.when(bare, F.lit(1.0)).otherwise(recall)
        precision = F.when(bare, F.when(F.col("n_det") > 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(precision)
    return (
        per.withColumn("recall", recall)
        .withColumn("precision", precision)
        .withColumn("hmean", _safe_hmean(F.col("precision"), F.col("recall")))
    )


def detection_eval_macro(per_image: DataFrame) -> DataFrame:
    return per_image.agg(
        F.count(F.lit(1)).alias("images"),
        F.avg("recall").alias("recall"),
        F.avg("precision").alias("precision"),
        F.avg("hmean").alias("hmean"),
    )


def detection_eval_micro(per_image: DataFrame) -> DataFrame:
    """Sums over all images; a zero denominator gives 0."""
    sums = per_image.agg(
        F.sum("recall_sum").alias("rs"), F.sum("n_gt").alias("g"),
        F.sum("precision_sum").alias("ps"), F.sum("n_det").alias("d"),
    )
    both = sums.select(_ratio("rs", "g").alias("recall"), _ratio("ps", "d").alias("precision"))
    return both.withColumn("hmean", _safe_hmean(F.col("precision"), F.col("recall")))


# ---- ranking -------------------------------------------------------------------------------


def rank_detections(
    df: DataFrame, ids: Sequence[str], conf: str = "conf", by: Sequence[str] = (), points=None
) -> DataFrame:
    """Add ``rank``, from the highest confidence down; ties go by id."""
    keyed = df.withColumn("__neg", -F.col(conf))
    return number_rows(keyed, ["__neg", *ids], by, name="rank", points=points).drop("__neg")


def average_precision(
    df: DataFrame, n_gt: DataFrame, ids: Sequence[str], conf: str = "conf", match: str = "match", points=None
) -> DataFrame:
    """One row: at each match in confidence order add correct/rank; divide by the truth count.

    ``n_gt`` is a one-row table with column ``n_gt``.
    """
    keys = ["__neg", *ids]
    # Numbering and running totals in slices read their table several times, so it is written once before each.
    keyed = materialise(df.select(*ids, (-F.col(conf)).alias("__neg"), match), "keyed")
    points = split_points(keyed, keys) if points is None else points
    ranked = number_rows(keyed, keys, name="rank", points=points)
    ranked = materialise(ranked, "ranked") if points else ranked
    hits = running(ranked, keys, {"correct": ("sum", F.col(match).cast("int"))}, points=points)
    total = hits.agg(F.sum(F.when(F.col(match), F.col("correct") / F.col("rank"))).alias("s"))
    joined = total.withColumn("one", F.lit(1)).join(F.broadcast(n_gt.withColumn("one", F.lit(1))), "one")
    share = F.when(F.col("n_gt") > 0, F.col("s") / F.col("n_gt")).otherwise(F.col("s"))
    return joined.select(F.coalesce(share, F.lit(0.0)).alias("average_precision"))
