"""Queries on annotation tables, sample stores and checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagelake.functions import geometry as G
from pagelake.functions import text as X
from pagelake.operators import feed as E
from pagelake.operators import filters as P
from pagelake.operators import joins as J
from pagelake.operators import metrics as M
from pagelake.operators import ordered as O
from pagelake.plans import fixtures as fx
from pagelake.plans.registry import query
from pagelake.session import ensure_checkpoint_dir, materialise
from pagelake.sources import annotations as A
from pagelake.sources import files as S
from pagelake.sources import store


def _scratch(spark, name: str) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/pagelake-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _words(spark, sf_dir):
    return fx.gt_words(spark, sf_dir)


def _anns(spark, sf_dir):
    return fx.anns(_words(spark, sf_dir))


# ---- filters ---------------------------------------------------------------------------------


@query("filter_valid_quads", ("det_boxes",), """
  SELECT image_id, det_idx, xmin, ymin, xmax, ymax FROM det_boxes WHERE least(xmin, ymin, xmax, ymax) >= 0""")
def filter_valid_quads(spark, sf_dir):
    det = fx.scoring_sides(spark, sf_dir)[1].drop("conf")
    return P.filter_valid_quads(det, G.BOX)


@query("filter_by_charset", ("gt_words",), """
  SELECT image_id, word_idx, text FROM gt_words WHERE regexp_matches(text, '[kz]')""")
def filter_by_charset(spark, sf_dir):
    return P.filter_by_charset(_words(spark, sf_dir), "kz").select("image_id", "word_idx", "text")


@query("filter_legible", ("anns",), "SELECT ann_id, image_id, utf8_string FROM anns WHERE utf8_string IS NOT NULL")
def filter_legible(spark, sf_dir):
    return P.filter_legible(_anns(spark, sf_dir)).select("ann_id", "image_id", "utf8_string")


@query("filter_anns", ("anns", "imgs"), """
  SELECT ann_id, image_id, area FROM anns WHERE legibility = 'legible' AND class = 'handwritten'
    AND area > 1000 AND area < 4000 AND image_id IN (SELECT image_id FROM imgs WHERE split = 'train')""")
def filter_anns(spark, sf_dir):
    words = _words(spark, sf_dir)
    ids = fx.imgs(words).where("split = 'train'")
    out = P.filter_anns(fx.anns(words), ids, {"legibility": "legible", "class": "handwritten"}, (1000, 4000))
    return out.select("ann_id", "image_id", "area")


@query("filter_imgs", ("anns", "imgs"), """
  SELECT image_id, file_name FROM imgs WHERE split = 'val' AND image_id IN (
    SELECT image_id FROM anns WHERE class = 'handwritten' AND legibility = 'illegible')""")
def filter_imgs(spark, sf_dir):
    words = _words(spark, sf_dir)
    imgs = fx.imgs(words)
    out = P.filter_imgs(imgs, fx.anns(words), imgs.where("split = 'val'"), {"class": "handwritten", "legibility": "illegible"})
    return out.select("image_id", "file_name")


@query("filter_label_length", ("samples",), "SELECT dataset, sample_id FROM samples WHERE length(label) <= 2000")
def filter_label_length(spark, sf_dir):
    return P.filter_label_length(fx.samples(spark, sf_dir), 2000).select("dataset", "sample_id")


@query("drop_empty_text", ("recog_pairs",), "SELECT sample_id, pred FROM recog_pairs WHERE length(pred) > 0")
def drop_empty_text(spark, sf_dir):
    return P.drop_empty_text(fx.recog_pairs(_words(spark, sf_dir)), "pred").select("sample_id", "pred")


@query("cap_samples", ("imgs",), """
  SELECT image_id, split FROM imgs ORDER BY (image_id * 7919) % 10007, image_id LIMIT 200""")
def cap_samples(spark, sf_dir):
    imgs = fx.imgs(_words(spark, sf_dir))
    return P.cap_samples(imgs, 200, ["image_id"], key=F.col("image_id") * 7919 % 10007).select("image_id", "split")


_JSON_FIELDS = ("text", "x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4")


@query("validate_words", ("gt_words",), "SELECT image_id, word_idx, word_idx % 4 < 2 AS valid FROM gt_words")
def validate_words(spark, sf_dir):
    x0, y0, x1, y1 = (F.col(c) for c in G.BOX)
    base = [v.alias(n) for n, v in zip(_JSON_FIELDS, (F.col("text"), x0, y0, x1, y0, x1, y1, x0, y1))]
    none = F.array().cast("array<string>")
    kinds = (
        F.to_json(F.struct(*base, none.alias("chars"))),
        F.to_json(F.struct(*base, F.lit("None").alias("type"), none.alias("chars"))),
        F.to_json(F.struct(*base, none.alias("char"))),
    )
    k = F.col("word_idx") % 4
    raw = _words(spark, sf_dir).withColumn("word_json", F.when(k == 0, kinds[0]).when(k == 1, kinds[1]).otherwise(kinds[2]))
    return P.validate_words(raw).select("image_id", "word_idx", "valid")


@query("nest_flatten_words", ("gt_words",), """
  SELECT image_id, word_idx, text, 'None' AS type, CAST(xmin AS DOUBLE) AS x1, CAST(ymax AS DOUBLE) AS y3 FROM gt_words""")
def nest_flatten_words(spark, sf_dir):
    """Words to one drifted annotation per image, back through the one-shape rule, and flat again."""
    words = _words(spark, sf_dir).select("image_id", "word_idx", "text", *G.ltrb_to_quad(*G.BOX))
    drifted = words.withColumn("char", F.array().cast("array<struct<text:string,%s>>" % ",".join(f"{c}:double" for c in G.QUAD)))
    nested = A.nest_words(drifted, ("image_id",))
    return P.flatten_words(P.normalise_words(nested), ("image_id",)).select(
        "image_id", F.col("word_idx").cast("long").alias("word_idx"), "text", "type", "x1", "y3"
    )


@query("normalise_mean_variance", (), """
  SELECT vec_id, round(list_sum(list_transform(range(0, 64), lambda i:
    (CAST(embedding[i + 1] AS DOUBLE) * 255 - [0.485, 0.456, 0.406][i % 3 + 1]::DOUBLE * 255)
    / ([0.229, 0.224, 0.225][i % 3 + 1]::DOUBLE * 255))), 6) AS total FROM embeddings""")
def normalise_mean_variance(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 255).alias("pixels"))
    out = P.normalise_mean_variance(rows)
    return out.select("vec_id", F.round(F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("denormalise_mean_variance", (), """
  SELECT vec_id, array_to_string(list_transform(range(0, 64), lambda i: CAST(trunc(least(greatest((CAST(embedding[i + 1] AS DOUBLE) * 5
    * [0.229, 0.224, 0.225][i % 3 + 1]::DOUBLE + [0.485, 0.456, 0.406][i % 3 + 1]::DOUBLE) * 255.0, 0), 255)) AS SMALLINT)), ',') AS pixels
  FROM embeddings""")
def denormalise_mean_variance(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 5).alias("pixels"))
    out = P.denormalise_mean_variance(rows)
    return out.select("vec_id", F.array_join(F.col("pixels").cast("array<string>"), ",").alias("pixels"))


# ---- joins -----------------------------------------------------------------------------------


@query("join_image_annotation", ("imgs", "gt_words"), """
  SELECT i.image_id, count(*) AS words FROM imgs i JOIN gt_words w
    ON concat('img_', CAST(w.image_id AS VARCHAR)) = regexp_replace(i.file_name, '\\.jpg$', '')
  WHERE w.word_idx > 0 GROUP BY i.image_id""")
def join_image_annotation(spark, sf_dir):
    words = _words(spark, sf_dir)
    images = fx.imgs(words).select("image_id", J.file_stem(F.col("file_name")).alias("stem"))
    notes = words.where("word_idx > 0").groupBy(F.concat(F.lit("img_"), F.col("image_id").cast("string")).alias("stem")).agg(
        F.count(F.lit(1)).alias("words")
    )
    return J.join_image_annotation(images, notes).select("image_id", "words")


@query("missing_annotations", ("gt_words",), """
  SELECT image_id FROM gt_words GROUP BY image_id HAVING max(word_idx) = 0""")
def missing_annotations(spark, sf_dir):
    words = _words(spark, sf_dir)
    return J.missing_side(fx.imgs(words).select("image_id"), words.where("word_idx > 0"), "image_id")


@query("anns_of_images", ("imgs", "anns"), """
  SELECT i.image_id, split, ann_id, area FROM imgs i JOIN anns a ON i.image_id = a.image_id WHERE split = 'test'""")
def anns_of_images(spark, sf_dir):
    words = _words(spark, sf_dir)
    out = J.anns_of_images(fx.imgs(words).where("split = 'test'"), fx.anns(words))
    return out.select("image_id", "split", "ann_id", "area")


@query("ids_semi", ("imgs", "anns"), """
  SELECT ann_id FROM anns WHERE image_id IN (SELECT image_id FROM imgs WHERE split = 'val')""")
def ids_semi(spark, sf_dir):
    words = _words(spark, sf_dir)
    return J.ids_semi(fx.anns(words), fx.imgs(words).where("split = 'val'")).select("ann_id")


@query("ids_minus", ("imgs", "anns"), """
  SELECT ann_id FROM anns WHERE image_id NOT IN (SELECT image_id FROM imgs WHERE split = 'train')""")
def ids_minus(spark, sf_dir):
    words = _words(spark, sf_dir)
    return J.ids_minus(fx.anns(words), fx.imgs(words).where("split = 'train'")).select("ann_id")


@query("load_results", ("det_boxes", "imgs"), """
  SELECT image_id, det_idx AS id, (xmax - xmin) * (ymax - ymin) AS area FROM det_boxes
  WHERE image_id IN (SELECT image_id FROM imgs WHERE split <> 'test')""")
def load_results(spark, sf_dir):
    det = fx.scoring_sides(spark, sf_dir)[1]
    known = fx.imgs(_words(spark, sf_dir)).where("split <> 'test'")
    res = det.select("image_id", F.col("det_idx").alias("id"), (F.col("xmax") - F.col("xmin")).alias("bw"), (F.col("ymax") - F.col("ymin")).alias("bh"))
    return J.load_results(res, known).select("image_id", "id", "area")


@query("count_skipped_images", ("det_boxes", "imgs"), """
  SELECT count(DISTINCT image_id) AS skipped_images FROM det_boxes
  WHERE image_id NOT IN (SELECT image_id FROM imgs WHERE split <> 'test')""")
def count_skipped_images(spark, sf_dir):
    det = fx.scoring_sides(spark, sf_dir)[1]
    return J.count_skipped_images(det, fx.imgs(_words(spark, sf_dir)).where("split <> 'test'"))


@query("vocab_lookup", ("word_chars", "lm_ones"), """
  SELECT image_id, word_idx, char_idx, v.idx FROM word_chars w
  LEFT JOIN (SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS idx FROM lm_ones) v ON w.ch = v.ch""")
def vocab_lookup(spark, sf_dir):
    ones = fx.char_lm(spark, sf_dir)[2].select("ch")
    vocab = O.number_rows(ones, ["ch"], name="idx", start=0)
    chars = fx.word_chars(_words(spark, sf_dir)).select("image_id", "word_idx", "char_idx", "ch")
    return J.vocab_lookup(chars, vocab).select("image_id", "word_idx", "char_idx", "idx")


@query("oov_report", ("samples", "lm_ones"), """
  SELECT ch, count(*) AS uses FROM (SELECT unnest(string_split(label, '')) AS ch FROM samples)
  WHERE ch NOT IN (SELECT ch FROM lm_ones) GROUP BY ch""")
def oov_report(spark, sf_dir):
    chars = fx.samples(spark, sf_dir).select(F.explode(X.chars("label")).alias("ch"))
    return J.oov_report(chars, fx.char_lm(spark, sf_dir)[2])


@query("attach_chars", ("word_chars",), """
  SELECT image_id, word_idx, string_agg(ch, '' ORDER BY char_idx) AS joined, CAST(sum(cx0) AS BIGINT) AS x_sum
  FROM word_chars GROUP BY image_id, word_idx""")
def attach_chars(spark, sf_dir):
    words = _words(spark, sf_dir)
    chars = fx.word_chars(words).select("image_id", "word_idx", "char_idx", "ch", "x1")
    out = J.attach_chars(words.select("image_id", "word_idx", "text"), chars, ("image_id", "word_idx"))
    return out.select(
        "image_id", "word_idx", F.array_join(F.transform("chars", lambda c: c["ch"]), "").alias("joined"),
        F.aggregate("chars", F.lit(0).cast("long"), lambda a, c: a + c["x1"]).alias("x_sum"),
    )


@query("bounding_boxes", ("word_chars",), """
  SELECT image_id, word_idx, min(cx0) AS xmin, min(cy0) AS ymin, max(cx1) AS xmax, max(cy1) AS ymax
  FROM word_chars GROUP BY image_id, word_idx""")
def bounding_boxes(spark, sf_dir):
    from pagelake.operators.pages import bounding_boxes as boxes

    return boxes(fx.word_chars(_words(spark, sf_dir)))


@query("affinity_quads", ("word_chars",), """
  SELECT image_id, word_idx, char_idx, round((cx0 + cx1 + (cx0 + cx1) / 2.0) / 3.0, 6) AS x1, round((cy0 + cy0 + (cy0 + cy1) / 2.0) / 3.0, 6) AS y1,
         round((nx0 + nx1 + (nx0 + nx1) / 2.0) / 3.0, 6) AS x2, round((ny0 + ny0 + (ny0 + ny1) / 2.0) / 3.0, 6) AS y2,
         round((nx0 + nx1 + (nx0 + nx1) / 2.0) / 3.0, 6) AS x3, round((ny1 + ny1 + (ny0 + ny1) / 2.0) / 3.0, 6) AS y3,
         round((cx0 + cx1 + (cx0 + cx1) / 2.0) / 3.0, 6) AS x4, round((cy1 + cy1 + (cy0 + cy1) / 2.0) / 3.0, 6) AS y4
  FROM (SELECT *, lead(cx0) OVER w AS nx0, lead(cx1) OVER w AS nx1, lead(cy0) OVER w AS ny0, lead(cy1) OVER w AS ny1 FROM word_chars
        WINDOW w AS (PARTITION BY image_id, word_idx ORDER BY char_idx)) WHERE nx0 IS NOT NULL""")
def affinity_quads(spark, sf_dir):
    from pagelake.operators.pages import affinity_quads as quads

    out = quads(fx.word_chars(_words(spark, sf_dir)))
    return out.select("image_id", "word_idx", "char_idx", *[F.round(c, 6).alias(c) for c in G.QUAD])


@query("neighbour_chars", ("word_chars",), """
  SELECT ch, next_ch, count(*) AS n FROM (SELECT ch, lead(ch) OVER (PARTITION BY image_id, word_idx ORDER BY char_idx) AS next_ch
    FROM word_chars) WHERE next_ch IS NOT NULL GROUP BY ch, next_ch""")
def neighbour_chars(spark, sf_dir):
    from pagelake.operators.pages import neighbour_chars as neighbours

    chars = fx.word_chars(_words(spark, sf_dir)).select("image_id", "word_idx", "char_idx", "ch")
    return neighbours(chars).groupBy("ch", "next_ch").agg(F.count(F.lit(1)).alias("n"))


# ---- layouts ---------------------------------------------------------------------------------


@query("read_icdar15", ("gt_words",), """
  SELECT image_id, word_idx, text, xmin AS x1, ymin AS y1, xmax AS x3, ymax AS y3 FROM gt_words""")
def read_icdar15(spark, sf_dir):
    lines = fx.icdar15_lines(_words(spark, sf_dir))
    return A.read_icdar15(lines).select("image_id", "word_idx", "text", "x1", "y1", "x3", "y3")


@query("read_icdar13", ("gt_words",), """
  SELECT image_id, word_idx, string_split(text, ' ')[1] AS text, xmin AS x1, ymin AS y2, xmax AS x3, ymax AS y4 FROM gt_words""")
def read_icdar13(spark, sf_dir):
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in G.BOX], F.concat(F.lit('"'), "text", F.lit('"')))
    lines = _words(spark, sf_dir).select("image_id", "word_idx", line.alias("line"))
    return A.read_icdar13(lines, "train").select("image_id", "word_idx", "text", "x1", "y2", "x3", "y4")


@query("coco_words", ("anns", "imgs"), """
  SELECT a.image_id, ann_id, utf8_string AS text, split, CAST(bx AS DOUBLE) AS x1, CAST(byy AS DOUBLE) AS y1,
         CAST(bx + bw AS DOUBLE) AS x3, CAST(byy + bh AS DOUBLE) AS y3
  FROM anns a JOIN imgs i ON a.image_id = i.image_id WHERE utf8_string IS NOT NULL""")
def coco_words(spark, sf_dir):
    words = _words(spark, sf_dir)
    anns = fx.anns(words).withColumn("bbox", F.array(*[F.col(c).cast("double") for c in ("bx", "byy", "bw", "bh")]))
    return A.coco_words(fx.imgs(words), anns).select("image_id", "ann_id", "text", "split", "x1", "y1", "x3", "y3")


@query("explode_synth_words", ("gt_words",), """
  SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY word_idx, part) - 1 AS BIGINT) AS word_idx, text,
         CAST(x AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS y1, length(text) AS n_chars
  FROM (SELECT image_id, word_idx, xmin AS x, ymin AS y, unnest(string_split(text, ' ')) AS text,
               generate_subscripts(string_split(text, ' '), 1) AS part FROM gt_words)""")
def explode_synth_words(spark, sf_dir):
    """Each image's words as the nested arrays of the synthetic layout, then exploded again."""
    words = _words(spark, sf_dir)
    parts = F.size(F.split("text", " "))
    listed = words.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("word_idx", "text", *G.BOX, parts.alias("n")))).alias("w")
    )

    def _field(array, name):
        return F.transform(array, lambda e: e[name].cast("double"))

    boxes = F.flatten(F.transform("w", lambda e: F.array_repeat(e, e["n"])))
    per_char = F.flatten(F.transform("w", lambda e: F.array_repeat(e, F.length(F.replace(e["text"], F.lit(" "))))))

    def planes(array):
        xs = F.array(*[_field(array, k) for k in ("xmin", "xmax", "xmax", "xmin")])
        ys = F.array(*[_field(array, k) for k in ("ymin", "ymin", "ymax", "ymax")])
        return F.array(xs, ys)

    nested = listed.select(
        F.concat(F.lit("x/"), F.col("image_id").cast("string")).alias("imname"),
        F.transform("w", lambda e: e["text"]).alias("txt"), planes(boxes).alias("wordBB"), planes(per_char).alias("charBB"),
    )
    out = A.explode_synth_words(nested)
    return out.select(
        F.col("file").cast("long").alias("image_id"), F.col("word_idx").cast("long").alias("word_idx"), "text", "x1", "y1",
        F.size("chars").cast("long").alias("n_chars"),
    )


@query("number_words", ("gt_words",), """
  SELECT CAST(image_id AS VARCHAR) AS file, word_idx, CAST(unnest(range(0, length(text))) AS INTEGER) AS char_idx FROM gt_words""")
def number_words(spark, sf_dir):
    """Character lines of each image's words, blank line between words, numbered again."""
    words = _words(spark, sf_dir)
    size = F.length("text")
    rows = words.select(
        F.col("image_id").cast("string").alias("file"), "word_idx", size.alias("n"), F.explode(F.sequence(F.lit(0), size)).alias("i")
    )
    lines = rows.select(
        "file", (F.col("word_idx") * 1000 + F.col("i")).alias("line_no"),
        F.when(F.col("i") == F.col("n"), F.lit("")).otherwise(F.lit('0 0 0 0 0 1 2 3 4 "c"')).alias("line"),
    )
    return A.number_words(lines).select("file", "word_idx", F.col("char_idx").alias("char_idx"))


WORDS_PER_TASK = 250_000


@query("read_icdar13_chars", ("gt_words",), """
  SELECT CAST(image_id AS VARCHAR) AS file, word_idx, CAST(i AS INTEGER) AS char_idx, CASE WHEN c IN (' ', '"') THEN '' ELSE c END AS text,
         CAST(xmin + 10 * i AS DOUBLE) AS x1, CAST(ymin AS DOUBLE) AS y1, CAST(xmin + 10 * i + 9 AS DOUBLE) AS x2, CAST(ymin AS DOUBLE) AS y2,
         CAST(xmin + 10 * i + 9 AS DOUBLE) AS x3, CAST(ymax AS DOUBLE) AS y3, CAST(xmin + 10 * i AS DOUBLE) AS x4, CAST(ymax AS DOUBLE) AS y4
  FROM (SELECT image_id, word_idx, xmin, ymin, ymax, unnest(string_split(text, '')) AS c, unnest(range(0, length(text))) AS i FROM gt_words)""")
def read_icdar13_chars(spark, sf_dir):
    """Every character of every word as a line with colour, centre, box and quoted character, a blank line behind each word."""
    words = _words(spark, sf_dir).select(F.col("image_id").cast("string").alias("file"), "word_idx", "text", *G.BOX)
    # Lines are read in order inside a file: its words go there once, not each of their lines, and no task sorts the lines of very many words.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-fx.table(spark, sf_dir, "lineitem").count() // WORDS_PER_TASK))
    rows = words.repartition(tasks, "file").select("file", "word_idx", "text", *G.BOX, F.explode(F.sequence(F.lit(0), F.length("text"))).alias("i"))
    left = F.col("xmin") + 10 * F.col("i")
    quoted = F.concat(F.lit('"'), F.substring("text", F.col("i") + 1, F.lit(1)), F.lit('"'))
    line = F.concat_ws(" ", F.lit("0 0 0"), left + 4, "ymin", left, "ymin", left + 9, "ymax", quoted)
    lines = rows.select(
        "file", (F.col("word_idx") * 1000 + F.col("i")).alias("line_no"),
        F.when(F.col("i") == F.length("text"), F.lit("")).otherwise(line).alias("line"),
    )
    return A.read_icdar13_chars(lines)


@query("split_counts", ("imgs",), "SELECT split, count(*) AS n FROM imgs GROUP BY split")
def split_counts(spark, sf_dir):
    return A.split_counts(fx.imgs(_words(spark, sf_dir)))


@query("write_annotations", ("gt_words", "imgs"), """
  SELECT i.split, i.image_id, count(*) AS n_words, string_agg(text, '|' ORDER BY word_idx) AS texts
  FROM gt_words w JOIN imgs i ON w.image_id = i.image_id GROUP BY i.split, i.image_id""")
def write_annotations(spark, sf_dir):
    """JSON annotations written by split and read back."""
    words = _words(spark, sf_dir)
    rows = words.join(fx.imgs(words).select("image_id", "split"), "image_id").select("image_id", "split", "word_idx", "text")
    path = _scratch(spark, "annotations")
    A.write_annotations(A.nest_words(rows, ("image_id", "split")), path)
    back = spark.read.schema("image_id long, words array<struct<text: string>>, split string").json(path)
    return back.select(
        "split", "image_id", F.size("words").cast("long").alias("n_words"),
        F.array_join(F.transform("words", lambda w: w["text"]), "|").alias("texts"),
    )


# ---- stores ----------------------------------------------------------------------------------


@query("assign_shard", ("gt_words",), """
  SELECT image_id, word_idx, (row_number() OVER (ORDER BY image_id, word_idx) - 1) // 10000 + 1 AS shard FROM gt_words""")
def assign_shard(spark, sf_dir):
    words = materialise(_words(spark, sf_dir).select("image_id", "word_idx"), "words")  # read by count, sample and slices
    return E.assign_shard(words, ["image_id", "word_idx"], 10_000)


@query("count_samples", ("samples",), "SELECT dataset, count(*) AS num_samples FROM samples GROUP BY dataset")
def count_samples(spark, sf_dir):
    return E.count_samples(fx.table(spark, sf_dir, "documents").select(F.col("source").alias("dataset")))


@query("length_totals", ("samples",), "SELECT CAST(count(*) AS BIGINT) AS length FROM samples")
def length_totals(spark, sf_dir):
    return E.length_totals(E.count_samples(fx.table(spark, sf_dir, "documents"), "source"))


@query("sample_store", (), """
  SELECT source AS dataset, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS sample_id,
         printf('image-%09d', row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS image_key, text AS label
  FROM documents WHERE source IN ('src1', 'src3')""")
def sample_store(spark, sf_dir):
    """Write the store, then read two of its datasets back."""
    return _stored(spark, sf_dir, ["src1", "src3"])


@query("sample_store_whole", (), """
  SELECT source AS dataset, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS sample_id,
         printf('image-%09d', row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS image_key, text AS label
  FROM documents""")
def sample_store_whole(spark, sf_dir):
    """Write the store, then read all of it back."""
    return _stored(spark, sf_dir, None)


def _stored(spark, sf_dir, selected):
    docs = fx.table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), "doc_id", F.col("text").alias("label"))
    path = _scratch(spark, "store")
    store.write_samples(docs, path, ["doc_id"])
    return store.read_samples(spark, path, selected).select("dataset", "doc_id", "sample_id", "image_key", "label")


@query("merge_stores", ("samples",), """
  SELECT dataset, sample_id, n AS new_id, concat('image-', lpad(CAST(n AS VARCHAR), CAST(length(CAST(total AS VARCHAR)) AS INTEGER), '0')) AS key
  FROM (SELECT dataset, sample_id, row_number() OVER (ORDER BY CASE dataset WHEN 'src2' THEN 0 WHEN 'src0' THEN 1 ELSE 2 END,
          dataset, sample_id) - 1 AS n, count(*) OVER () AS total FROM samples)""")
def merge_stores(spark, sf_dir):
    rows = fx.samples(spark, sf_dir).select("dataset", "sample_id")
    parts = [rows.where("dataset = 'src2'"), rows.where("dataset = 'src0'"), rows.where("dataset not in ('src0', 'src2')")]
    return E.merge_stores(parts, ["dataset", "sample_id"]).select("dataset", "sample_id", "new_id", "key")


@query("split_store_capped", ("samples",), """
  SELECT dataset, sample_id, printf('all_%04d', n // 70) AS shard, printf('image-%02d', n % 70) AS key
  FROM (SELECT dataset, sample_id, row_number() OVER (ORDER BY dataset, sample_id) - 1 AS n, count(*) OVER () AS total FROM samples)
  WHERE n // 70 < 10 AND (n // 70 + 1) * 70 <= total""")
def split_store_capped(spark, sf_dir):
    rows = fx.samples(spark, sf_dir).select("dataset", "sample_id")
    out = E.split_store(rows, ["dataset", "sample_id"], 70, max_shards=10, drop_partial=True, name="all")
    return out.select("dataset", "sample_id", "shard", "key")


@query("split_store", ("samples",), """
  SELECT dataset, sample_id, printf('all_%04d', n // 70) AS shard, printf('image-%02d', n % 70) AS key
  FROM (SELECT dataset, sample_id, row_number() OVER (ORDER BY dataset, sample_id) - 1 AS n FROM samples)""")
def split_store(spark, sf_dir):
    rows = fx.samples(spark, sf_dir).select("dataset", "sample_id")
    return E.split_store(rows, ["dataset", "sample_id"], 70, name="all").select("dataset", "sample_id", "shard", "key")


@query("split_store_whole", ("samples",), """
  SELECT shard, count(*) AS n FROM (SELECT printf('all_%04d', (row_number() OVER (ORDER BY dataset, sample_id) - 1) // 70) AS shard
  FROM samples) GROUP BY shard""")
def split_store_whole(spark, sf_dir):
    rows = fx.samples(spark, sf_dir).select("dataset", "sample_id")
    out = E.split_store(rows, ["dataset", "sample_id"], 70, name="all")
    return out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query("split_layout", ("imgs",), """
  SELECT dataset, split, count(*) AS n FROM (SELECT 'synth' AS dataset, CASE WHEN shard = 9 THEN 'test' ELSE 'train' END AS split
    FROM (SELECT (row_number() OVER (ORDER BY image_id) - 1) // 1500 + 1 AS shard FROM imgs)) GROUP BY ALL""")
def split_layout(spark, sf_dir):
    """The written layout, counted from its folders."""
    images = materialise(fx.imgs(_words(spark, sf_dir)).select("image_id", "file_name"), "images")  # read by count, sample and slices
    shards = E.assign_shard(images, ["image_id"], 1500)
    path = _scratch(spark, "layout")
    E.export_split_layout(shards.withColumn("dataset", F.lit("synth")), path)
    return spark.read.parquet(path).groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n"))


@query("select_checkpoint", ("ckpt_files",), """
  SELECT exp, CASE WHEN max_iter IS NULL THEN NULL WHEN has_best THEN 'best_accuracy.pth'
         ELSE concat('iter_', CAST(max_iter AS VARCHAR), '.pth') END AS checkpoint, coalesce(max_iter, 0) AS max_iter
  FROM (SELECT exp, max(TRY_CAST(regexp_extract(file_name, '^iter_([0-9]+)\\.pth$', 1) AS BIGINT)) AS max_iter,
               bool_or(file_name = 'best_accuracy.pth') AS has_best FROM ckpt_files GROUP BY exp)""")
def select_checkpoint(spark, sf_dir):
    return M.select_checkpoint(fx.ckpt_files(spark, sf_dir))


@query("latest_checkpoint", ("ckpt_files",), """
  SELECT exp, concat('iter_', CAST(max(TRY_CAST(regexp_extract(file_name, '^iter_([0-9]+)\\.pth$', 1) AS BIGINT)) AS VARCHAR), '.pth')
    AS checkpoint, max(TRY_CAST(regexp_extract(file_name, '^iter_([0-9]+)\\.pth$', 1) AS BIGINT)) AS max_iter
  FROM ckpt_files GROUP BY exp""")
def latest_checkpoint(spark, sf_dir):
    return M.select_checkpoint(fx.ckpt_files(spark, sf_dir), kind="last")


@query("newest_by_digits", ("ckpt_files",), """
  SELECT exp, max_by(file_name, coalesce(TRY_CAST(regexp_replace(file_name, '[^0-9]', '', 'g') AS BIGINT), 0)) AS checkpoint
  FROM ckpt_files GROUP BY exp""")
def newest_by_digits(spark, sf_dir):
    return M.newest_by_digits(fx.ckpt_files(spark, sf_dir))


@query("collect_charset", ("samples",), "SELECT DISTINCT unnest(string_split(label, '')) AS ch FROM samples")
def collect_charset(spark, sf_dir):
    return E.collect_charset(fx.samples(spark, sf_dir))


@query("build_charset", ("lm_ones",), """
  SELECT ch, n AS idx, n + 1 AS ctc_idx, n + 2 AS attn_idx FROM (
    SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS n FROM (SELECT ch FROM lm_ones UNION ALL SELECT '?'))""")
def build_charset(spark, sf_dir):
    return S.build_charset(fx.char_lm(spark, sf_dir)[2])


@query("build_vocabulary", (), """
  WITH seen AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS token,
           generate_subscripts(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]'), 1) AS pos FROM documents)
  SELECT row_number() OVER (ORDER BY first_at) - 1 AS idx, token, n
  FROM (SELECT token, count(*) AS n, min((doc_id, pos)) AS first_at FROM seen GROUP BY token)""")
def build_vocabulary(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return E.build_vocabulary(docs, X.word_tokenize("text"), "doc_id")


@query("unite_datasets", ("imgs", "anns"), """
  SELECT kind, count(*) AS n FROM (SELECT 'image' AS kind FROM imgs UNION ALL SELECT 'annotation' FROM anns) GROUP BY kind""")
def unite_datasets(spark, sf_dir):
    words = _words(spark, sf_dir)
    images = fx.imgs(words).select(F.lit("image").alias("kind"), F.col("image_id").alias("id"))
    notes = fx.anns(words).select(F.lit("annotation").alias("kind"), F.col("ann_id").alias("id"))
    return images.unionByName(notes).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("intersect_ids", ("imgs", "det_boxes"), """
  SELECT image_id FROM imgs WHERE split = 'train' INTERSECT SELECT image_id FROM det_boxes WHERE conf > 0.9""")
def intersect_ids(spark, sf_dir):
    det = fx.scoring_sides(spark, sf_dir)[1]
    train = fx.imgs(_words(spark, sf_dir)).where("split = 'train'").select("image_id")
    return train.intersect(det.where("conf > 0.9").select("image_id"))


# ---- files written from the tables and read back ------------------------------------------------


@query("read_corpus", (), """
  SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line""")
def read_corpus(spark, sf_dir):
    path = _scratch(spark, "corpus")
    fx.table(spark, sf_dir, "documents").select("text").write.text(path)
    return S.read_corpus(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("read_vocab", ("lm_ones",), """
  SELECT CAST(row_number() OVER (ORDER BY ch) - 1 AS INTEGER) AS idx, ch FROM lm_ones WHERE regexp_matches(ch, '[A-Za-z]')""")
def read_vocab(spark, sf_dir):
    """The letters in use, written as one vocabulary file."""
    path = _scratch(spark, "vocab")
    letters = fx.char_lm(spark, sf_dir)[2].where(F.col("ch").rlike("[A-Za-z]"))
    letters.agg(F.array_join(F.array_sort(F.collect_list("ch")), "\n").alias("value")).write.text(path)
    return S.read_vocab(spark, path)


def _vocab_sql(used: str) -> str:
    return f"""
  WITH used AS ({used})
  SELECT CAST(row_number() OVER (ORDER BY CASE WHEN ch IN (' ', chr(9)) THEN 1 WHEN ch = (SELECT min(ch) FROM used WHERE ch NOT IN (' ', chr(9))) THEN 0 ELSE 2 END, ch) - 1
         AS INTEGER) AS idx, ch FROM used"""


def _through_vocab_file(spark, used):
    """Characters written as one vocabulary file and read back.

    The reader strips the ends of a file, so blanks follow the first other character. A line break is written as backslash and letter;
    all other lines are single characters.
    """
    path = _scratch(spark, "vocab")
    listed = used.agg(F.array_sort(F.collect_list("ch")).alias("all"))
    blank = lambda c: c.isin(" ", "\t")
    inked, blanks = F.filter("all", lambda c: ~blank(c)), F.filter("all", blank)
    lines = F.concat(F.slice(inked, 1, 1), blanks, F.slice(inked, 2, F.greatest(F.size(inked), F.lit(1))))
    written = F.transform(lines, lambda c: F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")))
    listed.select(F.array_join(written, "\n").alias("value")).write.text(path)
    ch = F.when(F.col("ch") == "\\n", "\n").when(F.col("ch") == "\\r", "\r").otherwise(F.col("ch"))
    return S.read_vocab(spark, path).select("idx", ch.alias("ch"))


@query("read_vocab_whole", ("lm_ones",), _vocab_sql("SELECT ch FROM lm_ones"))
def read_vocab_whole(spark, sf_dir):
    """All characters of the character model."""
    return _through_vocab_file(spark, fx.char_lm(spark, sf_dir)[2])


@query("read_vocab_documents", ("samples",), _vocab_sql("SELECT DISTINCT unnest(string_split(label, '')) AS ch FROM samples"))
def read_vocab_documents(spark, sf_dir):
    """All characters of the documents."""
    return _through_vocab_file(spark, E.collect_charset(fx.table(spark, sf_dir, "documents"), "text"))


@query("read_vocab_groups", ("samples",), """
  WITH used AS (SELECT DISTINCT unnest(string_split(label, '')) AS ch FROM samples),
  each AS (SELECT 0 AS level, "right"(hex(ch), 1) AS digit, ch FROM used UNION ALL SELECT 1, "left"(hex(ch), 1), ch FROM used WHERE ch BETWEEN 'a' AND 'z' AND length(hex(ch)) = 2),
  listed AS (SELECT *, string_agg(ch, '' ORDER BY ch) OVER (PARTITION BY level, digit ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS members FROM each)
  SELECT ch, max_by(members, level) AS members FROM listed GROUP BY ch""")
def read_vocab_groups(spark, sf_dir):
    """Characters of the documents grouped by their last hexadecimal digit, small letters once more by their first, as one JSON file."""
    used = E.collect_charset(fx.table(spark, sf_dir, "documents"), "text").withColumn("code", F.hex(F.col("ch").cast("binary")))
    small = used.where("ch >= 'a' AND ch <= 'z' AND length(code) = 2")
    each = used.select(F.lit(0).alias("level"), F.substring("code", -1, 1).alias("digit"), "ch").unionByName(
        small.select(F.lit(1).alias("level"), F.substring("code", 1, 1).alias("digit"), "ch")
    )
    lists = each.groupBy("level", "digit").agg(F.array_sort(F.collect_list("ch")).alias("members"))
    whole = lists.agg(F.array_sort(F.collect_list(F.struct("level", "digit", "members"))).alias("g"))
    path = _scratch(spark, "groups")
    whole.select(F.to_json(F.transform("g", lambda g: g["members"])).alias("value")).write.text(path)
    return S.read_vocab_groups(spark, path).select("ch", F.array_join("members", "").alias("members"))


@query("read_char_lm", ("lm_bigram", "lm_unigram", "lm_lambda"), """
  SELECT 'bigram' AS kind, pair AS item, round(p, 9) AS p FROM lm_bigram UNION ALL SELECT 'unigram', ch, round(p, 9) FROM lm_unigram
  UNION ALL SELECT 'lambda', ch, weight FROM lm_lambda""")
def read_char_lm(spark, sf_dir):
    """The model as one JSON document; its maps are bounded by the pairs of characters in use."""
    weights, bigram, unigram = fx.char_lm(spark, sf_dir)
    parts = [("lambda", weights, "ch", "weight"), ("bigram", bigram, "pair", "p"), ("unigram", unigram, "ch", "p")]
    rows = None
    for kind, df, key, value in parts:
        part = df.select(F.lit(kind).alias("kind"), F.col(key).alias("item"), F.col(value).alias("p"))
        rows = part if rows is None else rows.unionByName(part)
    maps = [
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("item", "p")))).alias(kind) for kind, *_ in parts
    ]
    path = _scratch(spark, "model")
    rows.agg(*maps).select(F.to_json(F.struct(*[kind for kind, *_ in parts])).alias("value")).write.text(path)
    w, b, u = S.read_char_lm(spark, path)
    back = None
    for kind, df, key, value in (("lambda", w, "ch", "weight"), ("bigram", b, "pair", "p"), ("unigram", u, "ch", "p")):
        part = df.select(F.lit(kind).alias("kind"), F.col(key).alias("item"), F.round(value, 9).alias("p"))
        back = part if back is None else back.unionByName(part)
    return back


IMAGES_PER_FILE = 4000


def annotation_files(spark, sf_dir, shift: int, copies: bool = False) -> str:
    """JSON files of many images each. With ``copies`` each image of even number stands in two files; ``shift`` is taken off every x."""
    words = _words(spark, sf_dir).select(
        "image_id", "word_idx", "text", *G.ltrb_to_quad(F.col("xmin") - shift, "ymin", F.col("xmax") - shift, "ymax"), F.array().cast("array<string>").alias("char")
    )
    nested = A.nest_words(words, ("image_id",)).withColumn("file", F.concat(F.lit("img_"), F.col("image_id").cast("string"), F.lit(".jpg")))
    shard = F.floor(F.col("image_id") / IMAGES_PER_FILE)
    shards = F.array(shard, -1 - shard) if copies else F.array(shard)
    # An image is written out before it is dealt to its files: once for both copies, and by all tasks.
    written = nested.select("image_id", F.to_json(F.struct("file", "words")).alias("image"))
    placed = written.select("image", F.explode(F.when(F.col("image_id") % 2 == 0, shards).otherwise(F.array(shard))).alias("shard"))
    docs = placed.groupBy("shard").agg(F.concat(F.lit("["), F.array_join(F.collect_list("image"), ","), F.lit("]")).alias("value"))
    path = _scratch(spark, "annotation-files")
    docs.repartition("shard").write.partitionBy("shard").option("compression", "none").text(path)
    return path


@query("read_annotations", ("gt_words",), """
  SELECT concat('img_', CAST(image_id AS VARCHAR), '.jpg') AS file, CAST(word_idx AS INTEGER) AS word_idx, text, 'None' AS type,
         CAST(xmin AS DOUBLE) AS x1, CAST(ymax AS DOUBLE) AS y3 FROM gt_words""")
def read_annotations(spark, sf_dir):
    """Annotations in the drifted spelling, many images per JSON file."""
    good, _ = A.read_annotations(spark, annotation_files(spark, sf_dir, shift=0), suffix="*.txt")
    return P.flatten_words(good).select("file", "word_idx", "text", "type", "x1", "y3")


@query("read_coco_text", ("imgs", "anns"), """
  SELECT a.image_id, ann_id, split, area, legibility, utf8_string FROM anns a JOIN imgs i ON a.image_id = i.image_id""")
def read_coco_text(spark, sf_dir):
    """Catalogue documents with id-keyed maps, a fixed span of images each."""
    words = _words(spark, sf_dir)
    shard = F.floor(F.col("image_id") / IMAGES_PER_FILE)
    imgs = fx.imgs(words).select(
        shard.alias("shard"), F.struct(F.col("image_id").cast("string"), F.struct("file_name", "width", "height", F.col("split").alias("set"))).alias("e")
    ).groupBy("shard").agg(F.map_from_entries(F.collect_list("e")).alias("imgs"))
    fields = F.struct(
        "image_id", F.array("bx", "byy", "bw", "bh").alias("bbox"), F.col("area").cast("double").alias("area"), "utf8_string", "legibility", "class"
    )
    anns = fx.anns(words).select(shard.alias("shard"), F.struct(F.col("ann_id").cast("string"), fields).alias("e"))
    anns = anns.groupBy("shard").agg(F.map_from_entries(F.collect_list("e")).alias("anns"))
    path = _scratch(spark, "catalogue")
    docs = imgs.join(anns, "shard").select("shard", F.to_json(F.struct("imgs", "anns")).alias("value"))
    docs.repartition("shard").write.partitionBy("shard").text(path)
    tables = A.read_coco_text(spark, path)
    out = tables["anns"].join(tables["imgs"].select("image_id", "split"), "image_id")
    return out.select("image_id", "ann_id", "split", F.col("area").cast("long").alias("area"), "legibility", "utf8_string")
