"""Readers of image folders, text lines, vocabularies and language models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions.text import strip_bom
from pagelake.operators.joins import file_stem
from pagelake.operators.ordered import number_rows
from pagelake.schemas import CHAR_LM

# Fixed list of image kinds.
IMAGE_KINDS = ("jpg", "bmp", "png", "jpeg", "rgb", "tif", "tiff", "gif")


def read_images(spark: SparkSession, path: str, kinds: Sequence[str] = IMAGE_KINDS, required: bool = True) -> DataFrame:
    """Image files below a folder as (path, length, content, stem, folder). Content is read only if used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    found = files.where(kind.isin(*kinds)).select(
        "path", "length", "content", file_stem(F.col("path")).alias("stem"), F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder")
    )
    if required and found.select("path").isEmpty():
        raise FileNotFoundError(f"no image file in {path}")
    return found


def probe_images(spark: SparkSession, path: str) -> DataFrame:
    """Size and channels of every image file, with a status; decoding runs in the JVM image source."""
    raw = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    size = raw.select("image.origin", "image.width", "image.height", "image.nChannels")
    status = F.when((F.col("width") < 0) | F.col("width").isNull(), "unreadable").when(
        F.col("width") * F.col("height") == 0, "empty"
    ).otherwise("ok")
    return size.select(
        F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), status.alias("status"),
        file_stem(F.col("origin")).alias("stem"),
    )


def split_bad_images(probed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable images, quarantine)."""
    return probed.where(F.col("status") == "ok"), probed.where(F.col("status") != "ok")


def discover_datasets(spark: SparkSession, root: str) -> DataFrame:
    """Sub-folders that hold both images and annotations; only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    parts = files.select(
        F.regexp_extract("path", r"^(.*)/(images|annotations)/[^/]+$", 1).alias("folder"),
        F.regexp_extract("path", r"/(images|annotations)/[^/]+$", 1).alias("kind"),
    ).where(F.col("kind") != "")
    found = parts.groupBy("folder").agg(
        F.bool_or(F.col("kind") == "images").alias("i"), F.bool_or(F.col("kind") == "annotations").alias("a")
    )
    name = F.replace(F.regexp_extract("folder", r"([^/]+)$", 1), F.lit("ST_"), F.lit(""))
    return found.where("i and a").select("folder", name.alias("dataset"))


def read_lines(spark: SparkSession, path: str, suffix: str = "*.txt") -> DataFrame:
    """(file, line_no, line) of small text files; line numbers come from the file itself."""
    files = spark.read.option("pathGlobFilter", suffix).option("recursiveFileLookup", True).text(path, wholetext=True)
    named = files.select(file_stem(F.col("_metadata.file_path")).alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    rows = named.withColumn("line", F.regexp_replace("line", "\r$", ""))
    return rows


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """One character per line, in order, as (idx, ch)."""
    text = spark.read.text(path, wholetext=True).select(F.btrim(strip_bom("value"), F.lit(" \t\r\n")).alias("value"))
    return text.select(F.posexplode(F.split("value", "\r?\n")).alias("idx", "ch"))


def build_charset(vocab: DataFrame, unknown: str | None = "?") -> DataFrame:
    """Sorted charset with its class numbers for both label codings.

    The unknown character is appended even if it is listed already, as in the label tables.
    """
    ch = vocab.select("ch")
    if unknown:
        ch = ch.unionByName(vocab.sparkSession.createDataFrame([(unknown,)], "ch string"))
    out = number_rows(ch, ["ch"], name="idx", start=0)
    return out.select("ch", "idx", (F.col("idx") + 1).alias("ctc_idx"), (F.col("idx") + 2).alias("attn_idx"))


def read_vocab_groups(spark: SparkSession, path: str) -> DataFrame:
    """(ch, members) from a JSON list of lists; a character in several lists takes the last."""
    text = spark.read.text(path, wholetext=True).select(F.from_json(strip_bom("value"), "array<array<string>>").alias("g"))
    lists = text.select(F.posexplode("g").alias("pos", "members"))
    each = lists.select("pos", "members", F.explode("members").alias("ch")).where(F.col("ch") != "")
    return each.groupBy("ch").agg(F.max_by("members", "pos").alias("members"))


def read_char_lm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weights, bigram, unigram) tables of a JSON character model."""
    text = spark.read.text(path, wholetext=True).select(F.from_json(strip_bom("value"), CHAR_LM).alias("m"))

    def table(field: str, key: str, value: str) -> DataFrame:
        return text.select(F.explode(f"m.{field}").alias(key, value))

    return table("lambda", "ch", "weight"), table("bigram", "pair", "p"), table("unigram", "ch", "p")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One sentence per line."""
    return spark.read.text(path).select(strip_bom("value").alias("line"))
