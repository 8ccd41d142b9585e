"""Pages: reading order, tiles, and box values from score maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions.geometry import BOX, QUAD, affinity_quad, dist
from pagelake.operators.joins import CELL, in_cells
from pagelake.operators.ordered import number_rows, running, split_points
from pagelake.session import materialise

WINDOW, BUFFER = (1280, 800), (50, 20)  # fixed defaults of the sliding window


def reading_order(boxes: DataFrame, id_col: str = "box_idx", points=None) -> DataFrame:
    """Add ``line`` and ``position``: lines are chains of boxes that overlap in y, read left to right.

    The chain is a running maximum of the lower edges, and both numbers are distributed, so a page
    may hold any number of boxes. This is a total order.
    """
    keys = ["ymin", "xmin", id_col]
    if points is None:
        points = split_points(boxes, ["image_id", *keys], by=["image_id"])
    # Work in slices reads a table twice, so each step's rows are written once.
    once = materialise if points else lambda df, name: df
    boxes = once(boxes, "boxes")
    below = running(boxes, keys, {"__floor": ("max", F.col("ymax"))}, ["image_id"], exclusive=True, points=points)
    below = once(below, "below")
    fresh = (F.col("__floor").isNull() | (F.col("__floor") <= F.col("ymin"))).cast("int")
    lined = running(below.withColumn("__new", fresh), keys, {"line": ("sum", F.col("__new"))}, ["image_id"], points=points)
    lined = once(lined.drop("__floor", "__new").withColumn("line", F.col("line") - 1), "lined")
    order = ["line", "xmin", "ymin", "xmax", "ymax", id_col]
    lined_points = None if points else []
    return number_rows(lined, order, ["image_id"], name="position", start=0, points=lined_points)


def plan_tiles(
    images: DataFrame, window: tuple[int, int] = WINDOW, buf: tuple[int, int] = BUFFER, cover: bool = False
) -> DataFrame:
    """Tiles (i, j) of each page with offset and size, clipped at the page edge.

    The count uses half the buffer while the step uses the whole one, so a page can miss its far
    edge; ``cover=True`` adds the missing tiles.
    """

    def count(size: str, w: int, b: int) -> Column:
        plain = (F.floor(F.col(size) / F.lit(w - b / 2)) + 1).cast("int")
        if not cover:
            return plain
        return F.greatest(plain, F.ceil((F.col(size) - b) / F.lit(float(w - b))).cast("int"))

    grown = (
        images.withColumn("n_x", count("width", window[0], buf[0]))
        .withColumn("n_y", count("height", window[1], buf[1]))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_y") - 1)))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_x") - 1)))
    )
    x, y = F.col("j") * (window[0] - buf[0]), F.col("i") * (window[1] - buf[1])
    zero = F.lit(0)
    return grown.withColumns(
        {
            "x_off": x, "y_off": y,
            "w": F.greatest(F.least(F.lit(window[0]), F.col("width") - x), zero),
            "h": F.greatest(F.least(F.lit(window[1]), F.col("height") - y), zero),
        }
    )


def keep_owned(
    dets: DataFrame, window: tuple[int, int] = WINDOW, buf: tuple[int, int] = BUFFER, faithful: bool = False
) -> DataFrame:
    """Drop tile detections whose centre cx, cy lies in a half-buffer border shared with a neighbour.

    ``dets`` carries its tile's i, j, n_x, n_y. Borders on the page's outer edge are kept. With
    ``faithful`` the right edge is not rescued.
    """
    hx, hy = buf[0] / 2, buf[1] / 2
    left, right = F.col("cx") < hx, F.col("cx") > window[0] - hx
    top, bottom = F.col("cy") < hy, F.col("cy") > window[1] - hy
    first_x, last_x = F.col("j") == 0, F.col("j") == F.col("n_x") - 1
    first_y, last_y = F.col("i") == 0, F.col("i") == F.col("n_y") - 1
    if faithful:
        border = left | right | top | bottom
        return dets.where(~border | (first_y & top) | (last_y & bottom) | (first_x & left))
    shared = (left & ~first_x) | (right & ~last_x) | (top & ~first_y) | (bottom & ~last_y)
    return dets.where(~shared)


def untile_detections(dets: DataFrame, tiles: DataFrame, boxes=BOX) -> DataFrame:
    """Tile coordinates to page coordinates.

    Detections meet the list of their page's tiles, so those that come dealt by page stay where they are. The place of a tile in a
    whole grid gives its entry at once; where another tile stands there, or the same one twice, the list is searched.
    """
    entry = F.struct(*[F.col(c).alias(f"t_{c}") for c in ("i", "j", "x_off", "y_off")])
    lists = tiles.groupBy("image_id").agg(F.array_sort(F.collect_list(entry)).alias("__tiles"), (F.max("j") + 1).alias("__wide"))
    place = (F.col("i") * F.col("__wide") + F.col("j")).cast("int")

    def own(t: Column) -> Column:
        return (t["t_i"] == F.col("i")) & (t["t_j"] == F.col("j"))

    def taken(k: int) -> Column:
        return F.coalesce(own(F.get("__tiles", place + k)), F.lit(False))

    near = F.when(taken(0) & ~taken(-1) & ~taken(1), F.array(F.get("__tiles", place))).otherwise(F.col("__tiles"))
    placed = dets.join(lists, "image_id").withColumn("__tile", F.explode(near)).where(own(F.col("__tile")))
    shift = {c: F.col(c) + F.col("__tile.t_x_off" if c.startswith("x") else "__tile.t_y_off") for c in boxes}
    return placed.withColumns(shift).select("image_id", "i", "j", *[c for c in dets.columns if c not in ("image_id", "i", "j")])


def box_heat(dets: DataFrame, grid: DataFrame, id_col: str = "det_idx", cell: int = CELL) -> DataFrame:
    """Number, mean and maximum of the text scores under each box (far edges excluded).

    Boxes and pixels meet in grid cells, and pixels are added up per box before the last shuffle.
    """
    boxes = in_cells(dets.select("image_id", id_col, *[F.col(c).cast("int").alias(c) for c in BOX]), cell)
    pixels = grid.withColumn("cell_x", F.floor(F.col("x") / cell)).withColumn("cell_y", F.floor(F.col("y") / cell))
    under = boxes.join(pixels.select("image_id", "cell_x", "cell_y", "x", "y", "text"), ["image_id", "cell_x", "cell_y"])
    under = under.where("x >= xmin and x < xmax and y >= ymin and y < ymax")
    return under.groupBy("image_id", id_col).agg(
        F.count(F.lit(1)).alias("pixels"), F.avg("text").alias("mean_text"), F.max("text").alias("max_text")
    )


def bounding_boxes(chars: DataFrame, by=("image_id", "word_idx")) -> DataFrame:
    """Box around all character quads of a word."""
    xs, ys = ("x1", "x2", "x3", "x4"), ("y1", "y2", "y3", "y4")
    return chars.groupBy(*by).agg(
        F.min(F.least(*xs)).alias("xmin"), F.min(F.least(*ys)).alias("ymin"),
        F.max(F.greatest(*xs)).alias("xmax"), F.max(F.greatest(*ys)).alias("ymax"),
    )


def training_window_plan(
    images: DataFrame, words: DataFrame, size: int, draw, share: float = 0.4
) -> DataFrame:
    """Training window (top, left, crop_w, crop_h) of each page.

    With probability ``share`` a page with words gets a window around a random word, else the
    whole page and one pixel beyond. A window around a word may start anywhere between the last
    offset that still shows the word's far edge and the first that cuts its near edge. ``draw(name, k)`` is a uniform Column in [0, 1) for the row with ids in ``name``
    ("image" or "word"). The word is the one of smallest draw, found without listing the page.
    """
    place = F.struct(draw("word", 0).alias("r"), F.col("word_idx").alias("word_idx"), *[F.col(c).cast("long").alias(c) for c in BOX])
    page = images.join(words.groupBy("image_id").agg(F.min(place).alias("word")), "image_id", "left")
    around = F.col("word").isNotNull() & (draw("image", 3) > 1 - share)
    page = page.withColumn("__around", around)
    # On each axis: the side of the page, the near and the far edge of the word.
    axes = {"top": ("height", "ymin", "ymax"), "left": ("width", "xmin", "xmax")}
    legal = {}
    for axis, (side, near, far) in axes.items():
        first = F.greatest(F.col("word")[far] - size, F.lit(0))
        last = F.least(F.col("word")[near], F.col(side).cast("long") - size)
        legal[axis] = F.struct(first.alias("first"), last.alias("last"))
    # A word that no window of this size can hold inside the page leaves any offset on the page legal, on both axes.
    held = F.forall(F.array(*legal.values()), lambda span: span["first"] <= span["last"])
    for k, (axis, (side, near, far)) in enumerate(axes.items(), 1):
        anywhere = F.struct(F.lit(0).cast("long").alias("first"), F.greatest(F.col(side).cast("long") - size, F.lit(0)).alias("last"))
        page = page.withColumn(f"__{axis}", F.when(held, legal[axis]).otherwise(anywhere))
        span = F.col(f"__{axis}")
        drawn = span["first"] + F.floor(draw("image", k) * (span["last"] - span["first"] + 1))
        page = page.withColumn(axis, F.when(F.col("__around"), drawn).otherwise(0).cast("long"))
    whole = (F.col("width") == size) & (F.col("height") == size)
    lengths = []
    for axis, (side, near, far) in axes.items():
        reach = F.when(F.col("word")[far] - F.col(axis) > size, F.col("word")[far]).otherwise(size)
        lengths.append(F.when(F.col("__around"), reach).otherwise(F.col(side) + 1))
    crop_h, crop_w = (F.when(whole, size).otherwise(length).cast("long") for length in lengths)
    offsets = [F.when(whole, 0).otherwise(F.col(axis)).cast("long").alias(axis) for axis in axes]
    return page.select("image_id", *offsets, crop_w.alias("crop_w"), crop_h.alias("crop_h"))


def affinity_quads(chars: DataFrame) -> DataFrame:
    """Quads between neighbouring characters of each word; a word is bounded by its text."""




    word = Window.partitionBy("image_id", "word_idx").orderBy("char_idx")
    ahead = chars.withColumns({f"n_{c}": F.lead(c).over(word) for c in QUAD})
    rows = ahead.where(F.col("n_x1").isNotNull())
    return rows.select("image_id", "word_idx", "char_idx", *affinity_quad(QUAD, [f"n_{c}" for c in QUAD]))


def neighbour_chars(chars: DataFrame, ch: str = "ch") -> DataFrame:
    """Consecutive characters of each word."""


    word = Window.partitionBy("image_id", "word_idx").orderBy("char_idx")
    return chars.withColumn("next_ch", F.lead(ch).over(word)).where(F.col("next_ch").isNotNull())


def crop_plan(words: DataFrame) -> DataFrame:
    """Add crop_w, crop_h: truncated lengths of the quad's first and last side."""


    return words.withColumn("crop_w", dist("x1", "y1", "x2", "y2").cast("long")).withColumn(
        "crop_h", dist("x1", "y1", "x4", "y4").cast("long")
    )
