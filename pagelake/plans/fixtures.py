"""Annotation, score and metric tables derived from the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators.ordered import ROWS_PER_SLICE, largest_group, number_rows, split_points

# Total order of lineitem rows inside an order; the two keys alone are not unique.
LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_shipdate", "l_returnflag", "l_linestatus",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gt_words(spark: SparkSession, sf_dir: str, points: list[tuple] | None = None) -> DataFrame:
    """Words of images: one image per order, one word per line. ``points`` are those of ``number_rows``."""
    lineitem, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    if points is None:
        points = split_points(lineitem, ["l_orderkey", *LINE_ORDER], rows_per_slice=ROWS_PER_SLICE, by=["l_orderkey"])  # short texts only
    rows = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = number_rows(rows, LINE_ORDER, ["l_orderkey"], name="word_idx", start=0, points=points)
    pk, sk, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("long")
    boxes = rows.select(
        F.col("l_orderkey").alias("image_id"),
        "word_idx",
        F.col("p_brand").alias("grp"),
        F.when(pk % 7 == 0, F.lit("###")).otherwise(F.col("p_name")).alias("text"),
        ((pk * 37 + sk * 11) % 1100).alias("xmin"),
        ((pk * 53 + F.col("l_linenumber") * 97) % 700).alias("ymin"),
        (q * 4 + 20).alias("w"),
        (sk % 30 + 12).alias("h"),
    )
    return boxes.select(
        "image_id", "word_idx", "grp", "text", "xmin", "ymin",
        (F.col("xmin") + F.col("w")).alias("xmax"), (F.col("ymin") + F.col("h")).alias("ymax"),
    )


def scoring_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(truth, detections). A line gives at most three detections, so its count bounds theirs, in an image, too."""
    lines = table(spark, sf_dir, "lineitem")
    total = 3 * lines.count()
    plain = total > ROWS_PER_SLICE and 3 * largest_group(lines, ["l_orderkey"]) <= ROWS_PER_SLICE
    words = gt_words(spark, sf_dir, points=[] if plain else None)
    return gt_eval(words), det_boxes(words, total, points=[] if plain else None)


def gt_eval(words: DataFrame) -> DataFrame:
    """Truth boxes; some words come as two halves. One pass: each row becomes one or two."""
    half = F.floor((F.col("xmin") + F.col("xmax")) / 2)
    split = (F.col("image_id") + F.col("word_idx")) % 11 == 4
    first = F.struct(
        (F.col("word_idx") * 2).alias("word_idx"), F.col("xmin").alias("xmin"),
        F.when(split, half).otherwise(F.col("xmax")).alias("xmax"),
    )
    second = F.struct(
        (F.col("word_idx") * 2 + 1).alias("word_idx"), half.alias("xmin"), F.col("xmax").alias("xmax")
    )
    rows = words.withColumn("b", F.explode(F.when(split, F.array(first, second)).otherwise(F.array(first))))
    return rows.select(
        "image_id", "b.word_idx", "grp", "text", F.col("b.xmin").alias("xmin"), "ymin",
        F.col("b.xmax").alias("xmax"), "ymax",
    )


def det_boxes(words: DataFrame, total: int | None = None, points: list[tuple] | None = None) -> DataFrame:
    """Simulated detections: shifted boxes, halves, misses and false positives, one pass.

    ``total`` bounds the number of detections where the caller knows it; ``points`` are those of ``number_rows``.
    """
    k = (F.col("image_id") + F.col("word_idx")) % 11
    d = (F.col("image_id") + F.col("word_idx") * 7) % 9 - 4
    half = F.floor((F.col("xmin") + F.col("xmax")) / 2)

    def box(order, piece, x0, y0, x1, y1):
        values = zip(("ord", "piece", "xmin", "ymin", "xmax", "ymax"), (order, piece, x0, y0, x1, y1))
        return F.struct(*[(v if not isinstance(v, int) else F.lit(v)).cast("long").alias(n) for n, v in values])

    i, x0, y0, x1, y1 = (F.col(c) for c in ("word_idx", "xmin", "ymin", "xmax", "ymax"))
    shifted = F.array(box(i, 0, x0 + d, y0 + d, x1 + d, y1 + d))
    halves = F.array(box(i, 0, x0, y0, half, y1), box(i, 1, half, y0, x1, y1))
    own = F.when(k.isin(1, 2), halves).when(k != 0, shifted)
    empty = F.array().cast("array<struct<ord:bigint,piece:bigint,xmin:bigint,ymin:bigint,xmax:bigint,ymax:bigint>>")
    false_hit = F.when((i == 0) & (F.col("image_id") % 13 == 0), F.array(box(9999, 2, 5, 5, 90, 30)))
    pieces = words.select(
        "image_id", F.explode(F.concat(F.coalesce(own, empty), F.coalesce(false_hit, empty))).alias("b")
    ).select("image_id", "b.*")
    numbered = number_rows(pieces, ["ord", "piece"], ["image_id"], name="det_idx", start=0, total=total, points=points)
    conf = ((F.col("image_id") * 31 + F.col("ord") * 17 + F.col("piece")) % 1000).cast("double") / 1000
    return numbered.select("image_id", "det_idx", "xmin", "ymin", "xmax", "ymax", conf.alias("conf"))


def recog_pairs(words: DataFrame) -> DataFrame:
    text, m = F.col("text"), (F.col("image_id") + F.col("word_idx")) % 6
    pred = (
        F.when(m == 0, text)
        .when(m == 1, F.replace(text, F.lit("i"), F.lit("l")))
        .when(m == 2, F.upper(text))
        .when(m == 3, F.substring(text, F.lit(1), F.length(text) - 1))
        .when(m == 4, F.lit(""))
        .otherwise(F.concat(text, F.lit("?")))
    )
    return words.where(text != "###").select(
        (F.col("image_id") * 100 + F.col("word_idx")).alias("sample_id"), "grp", text.alias("gt"), pred.alias("pred")
    )


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric log: one metric per event type, iterations in event order."""
    events = table(spark, sf_dir, "events")
    rows = number_rows(events, ["ts", "event_id"], ["event_type"], name="iteration", start=0)
    return rows.select(
        F.col("event_type").alias("name"), "iteration", "value",
        (F.col("event_type") != "error").alias("smooth"), "ts",
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 8).alias("seq_id"), (F.col("vec_id") % 8).alias("step"),
        F.col("embedding").alias("scores"),
    )


def ckpt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.when(key % 700 == 0, F.lit("best_accuracy.pth")).otherwise(
        F.concat(F.lit("iter_"), F.lpad(key.cast("string"), 7, "0"), F.lit(".pth"))
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("exp"), name.alias("file_name"))


def imgs(words: DataFrame) -> DataFrame:
    i = F.col("image_id")
    split = F.when(i % 10 == 0, "val").when(i % 10 == 1, "test").otherwise("train")
    return words.select(i).distinct().select(
        i, F.concat(F.lit("img_"), i.cast("string"), F.lit(".jpg")).alias("file_name"),
        F.lit(1280).alias("width"), F.lit(800).alias("height"), split.alias("split"),
    )


def anns(words: DataFrame) -> DataFrame:
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    odd3, odd2 = F.col("word_idx") % 3 == 0, F.col("word_idx") % 2 == 0
    return words.select(
        (F.col("image_id") * 100 + F.col("word_idx")).alias("ann_id"), "image_id",
        F.col("xmin").alias("bx"), F.col("ymin").alias("byy"), w.alias("bw"), h.alias("bh"), (w * h).alias("area"),
        F.when(odd3, "illegible").otherwise("legible").alias("legibility"),
        F.when(odd2, "machine printed").otherwise("handwritten").alias("class"),
        F.when(~odd3, F.col("text")).alias("utf8_string"),
    )


def icdar15_lines(words: DataFrame) -> DataFrame:
    corners = ("xmin", "ymin", "xmax", "ymin", "xmax", "ymax", "xmin", "ymax")
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in corners], "text")
    return words.select("image_id", "word_idx", line.alias("line"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition samples: the whole text of each document is a label."""
    docs = table(spark, sf_dir, "documents")
    rows = number_rows(docs, ["doc_id"], ["source"], name="sample_id", points=split_points(docs, ["source", "doc_id"]))
    return rows.select(F.col("source").alias("dataset"), "sample_id", "doc_id", F.col("text").alias("label"))


def score_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two score planes per image, 8 by 8 cells."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return cells.select(
        F.col("vec_id").alias("image_id"), F.floor(F.col("pos") / 8).cast("int").alias("y"),
        (F.col("pos") % 8).alias("x"), F.col("v").alias("text"), (F.col("v") / 2).cast("float").alias("link"),
    )


def word_chars(words: DataFrame) -> DataFrame:
    """Characters of each word with equal shares of its box as quads."""
    n = F.length("text")
    each = words.withColumn("n", n.cast("long")).withColumn("char_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    width = F.col("xmax") - F.col("xmin")
    x0 = F.col("xmin") + F.floor(width * F.col("char_idx") / F.col("n"))
    x1 = F.col("xmin") + F.floor(width * (F.col("char_idx") + 1) / F.col("n"))
    y0, y1 = F.col("ymin"), F.col("ymax")
    corners = zip(("x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4"), (x0, y0, x1, y0, x1, y1, x0, y1))
    ch = F.substring("text", (F.col("char_idx") + 1).cast("int"), F.lit(1))
    return each.select("image_id", "word_idx", "char_idx", ch.alias("ch"), *[v.alias(k) for k, v in corners])


def char_lm(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lambda, bigram, unigram) tables from the benchmark texts, as relative frequencies."""
    texts = table(spark, sf_dir, "benchmark").select("text")
    ones = texts.select(F.explode(F.sequence(F.lit(1), F.length("text"))).alias("i"), "text").select(
        F.substring("text", F.col("i"), F.lit(1)).alias("ch")
    )
    pairs = texts.where(F.length("text") > 1).select(
        F.explode(F.sequence(F.lit(1), F.length("text") - 1)).alias("i"), "text"
    ).select(F.substring("text", F.col("i"), F.lit(2)).alias("pair"))
    n = F.count(F.lit(1)).cast("double")
    uni_n = ones.groupBy("ch").agg(n.alias("n"))
    pair_n = pairs.groupBy("pair", F.substring("pair", 1, 1).alias("ch")).agg(n.alias("n"))
    total = uni_n.agg(F.sum("n").alias("total")).withColumn("one", F.lit(1))
    unigram = uni_n.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("ch", (F.col("n") / F.col("total")).alias("p"))
    starts = pair_n.groupBy("ch").agg(F.sum("n").alias("total"))
    bigram = pair_n.join(starts, "ch").select("pair", (F.col("n") / F.col("total")).alias("p"))
    return starts.select("ch", F.lit(0.9).alias("weight")), bigram, unigram
