"""Readers and writers on small files in the public layouts."""

import json
import struct
import zlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pagelake.operators import feed, filters, joins
from pagelake.plans.catalogue import QUERIES
from pagelake.sources import annotations as A
from pagelake.sources import files as S
from pagelake.sources import store

CORNERS = {f"{a}{i}": i * 10 + (a == "y") for i in range(1, 5) for a in "xy"}


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)


def png(width, height):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    data = zlib.compress(b"".join(b"\0" + bytes(width) for _ in range(height)))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(7, 3))
    (tmp_path / "b.png").write_bytes(b"not an image")
    (tmp_path / "c.txt").write_text("x")
    assert rows(S.read_images(spark, str(tmp_path)).select("stem")) == [("a",), ("b",)]
    good, bad = S.split_bad_images(S.probe_images(spark, str(tmp_path)).where("stem <> 'c'"))
    assert rows(good.select("stem", "width", "height", "channels")) == [("a", 7, 3, 1)]
    assert rows(bad.select("stem", "status")) == [("b", "unreadable")]


def test_annotations(spark, tmp_path):
    word = {"text": "hi", "type": "None", **CORNERS, "chars": [{"text": "h", **CORNERS}]}
    drift = {"text": "yo", **CORNERS, "char": []}
    write(tmp_path / "a.json", json.dumps({"file": "a.jpg", "width": 5, "height": 4, "depth": 3, "words": [word]}), "utf-8-sig")
    write(tmp_path / "b.json", json.dumps({"file": "b.jpg", "words": [drift]}, indent=4))
    write(tmp_path / "c.json", "{broken")
    good, bad = A.read_annotations(spark, str(tmp_path))
    assert rows(filters.flatten_words(good).select("file", "word_idx", "text", "type", "x1", "y4")) == [
        ("a.jpg", 0, "hi", "None", 10.0, 41.0), ("b.jpg", 0, "yo", "None", 10.0, 41.0),
    ]
    assert rows(filters.flatten_chars(good).select("file", "char_idx", "text")) == [("a.jpg", 0, "h")]
    assert rows(bad.select("stem")) == [("c",)]
    raw = spark.createDataFrame([(json.dumps(w),) for w in (word, drift)], "word_json string")
    assert sorted(r["valid"] for r in filters.validate_words(raw).collect()) == [False, True]


def test_coco_text(spark, tmp_path):
    doc = {
        "imgs": {"7": {"file_name": "p.jpg", "width": 10, "height": 20, "set": "train"}, "8": {"file_name": "q.jpg", "width": 1, "height": 1, "set": "val"}},
        "anns": {"70": {"image_id": 7, "bbox": [1.25, 2.0, 3.5, 4.0], "area": 14.0, "utf8_string": "hey", "class": "machine printed"},
                 "71": {"image_id": 7, "bbox": [0, 0, 1, 1], "area": 1.0, "class": "others"}},
        "imgToAnns": {"7": [70, 71], "8": []}, "cats": {"legibility": ["legible", "illegible"]}, "info": {"version": "1"},
    }
    write(tmp_path / "coco.json", json.dumps(doc))
    t = A.read_coco_text(spark, str(tmp_path))
    assert rows(t["imgs"].select("image_id", "split")) == [(7, "train"), (8, "val")]
    assert rows(t["img_anns"]) == [(7, 70), (7, 71)]
    assert rows(t["cats"]) == [("legibility", "illegible"), ("legibility", "legible")]
    assert rows(A.coco_words(t["imgs"], t["anns"]).select("text", "x1", "x3", "y3")) == [("hey", 1.2, 4.8, 6.0)]
    assert rows(A.split_counts(t["imgs"])) == [("train", 1), ("val", 1)]
    assert rows(filters.filter_anns(t["anns"], cats={"class": "others"}, area=(0, 1)).select("ann_id")) == []


def test_results(spark, tmp_path):
    write(tmp_path / "res.json", json.dumps([{"image_id": 7, "bbox": [0, 0, 2, 3]}, {"image_id": 9, "bbox": [0, 0, 1, 1]}]))
    found = A.read_results(spark, str(tmp_path))
    imgs = spark.createDataFrame([(7,)], "image_id long")
    assert rows(joins.load_results(found, imgs).select("id", "area")) == [(0, 6.0)]
    assert joins.count_skipped_images(found, imgs).first()[0] == 1


def test_icdar_lines(spark, tmp_path):
    write(tmp_path / "gt_img_1.txt", '38, 43, 920, 215, "Tire, d"\n', "utf-8-sig")
    write(tmp_path / "five" / "gt_img_2.txt", "1,2,3,4,5,6,7,8,a,b\r\n9,2,3,4,5,6,7,8,###\r\n", "utf-8-sig")
    test = S.read_lines(spark, str(tmp_path / "gt_img_1.txt"))
    assert rows(A.read_icdar13(test, "test").select("text", "x1", "y3")) == [("Tire", 38, 215)]
    five = S.read_lines(spark, str(tmp_path / "five"))
    assert rows(A.read_icdar15(five).select("line_no", "text", "x1", "y4")) == [(0, "a", 1, 8), (1, "###", 9, 8)]
    assert rows(A.read_icdar15(five, keep_commas=True).select("text")) == [("###",), ("a,b",)]


def test_icdar13_characters(spark):
    char = '0 0 0 0 0 {0} 2 {1} 4 "{2}"'.format
    chars = ["# note", char(1, 2, "a"), char(2, 3, "b"), "", "# note", "", char(5, 6, "c"), char(6, 7, "x")]
    lines = spark.createDataFrame([("f", i, s) for i, s in enumerate(chars)], "file string, line_no int, line string")
    numbered = rows(A.number_words(lines).select("line_no", "word_idx", "char_idx"))
    assert numbered == [(1, -1, 0), (2, -1, 1), (6, 0, 0), (7, 0, 1)]
    words = spark.createDataFrame([("f", 0, '5 2 7 4 "c"')], "file string, line_no long, line string")
    out = A.icdar13_train(words, lines).first()
    assert out["text"] == "c" and [(c["text"], c["x1"]) for c in out["chars"]] == [("c", 5)]


def test_character_lines_are_sorted_once(spark):
    char = '0 0 0 0 0 1 2 3 4 "{0}"'.format
    texts = {"f": [char("a"), char("b"), "", "# x", char("c"), None, "", "", char("d")], "g": ["", char("e"), char("f")], None: [char("g")]}
    data = [(f, i, line) for f, lines in texts.items() for i, line in enumerate(lines)]
    lines = spark.createDataFrame(data, "file string, line_no long, line string")
    numbered = A.number_words(lines.repartition(3, "file"))
    assert numbered.schema["char_idx"].dataType.simpleString() == "int"
    # After a blank line a note takes the word break back.
    want = [("f", 0, 0, 0), ("f", 1, 0, 1), ("f", 4, 0, 0), ("f", 8, 2, 0), ("g", 1, 1, 0), ("g", 2, 1, 1), (None, 0, 0, 0)]
    assert sorted(map(tuple, numbered.select("file", "line_no", "word_idx", "char_idx").collect()), key=str) == sorted(want, key=str)
    plan = numbered._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Sort [") == 1 and plan.count("Exchange hash") == 1


def test_words_go_to_their_file_before_their_lines_are_made(spark, tmp_path):
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    rest = "l_shipdate timestamp, l_returnflag string, l_linestatus string"
    data = [(o, 1, 2, n, 3.0, 4.0, 0.0, 0.0, None, "A", "F") for o in (1, 2) for n in (1, 2)]
    spark.createDataFrame(data, f"{line}, {rest}").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "ab", "x")], "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    chars = QUERIES["read_icdar13_chars"](spark, str(tmp_path))
    plan = chars._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Exchange" not in plan[:plan.index("Generate")] and "Exchange" in plan
    got = rows(chars.select("file", "word_idx", "char_idx", "text"))
    assert got == [(str(o), w, c, "ab"[c]) for o in (1, 2) for w in (0, 1) for c in (0, 1)]


def test_synthetic_layout(spark):
    flat = lambda n: [[[float(10 * k + i) for i in range(n)] for k in range(4)] for _ in range(2)]
    data = [("d/a.jpg", ["Lines:\nI lost", " of "], flat(4), flat(13)), ("d/b.jpg", ["one two"], flat(1), flat(6))]
    df = spark.createDataFrame(data, "imname string, txt array<string>, wordBB array<array<array<double>>>, charBB array<array<array<double>>>")
    out = A.explode_synth_words(df).orderBy("word_idx").collect()
    assert [(r["file"], r["text"], r["x2"]) for r in out] == [("a.jpg", w, 10.0 + i) for i, w in enumerate(["Lines:", "I", "lost", "of"])]
    assert [c["text"] for c in out[2]["chars"]] == list("lost") and out[2]["chars"][0]["x1"] == 7.0


def test_vocab_groups_and_model(spark, tmp_path):
    write(tmp_path / "vocab.txt", "b\na\n c\n", "utf-8-sig")
    vocab = S.read_vocab(spark, str(tmp_path / "vocab.txt"))
    assert rows(vocab) == [(0, "b"), (1, "a"), (2, " c")]
    assert rows(S.build_charset(vocab.where("idx < 2")).select("ch", "idx", "ctc_idx", "attn_idx"), "idx") == [
        ("?", 0, 1, 2), ("a", 1, 2, 3), ("b", 2, 3, 4),
    ]
    write(tmp_path / "groups.json", json.dumps([["a", "@", ""], ["a", "4"]]))
    assert rows(S.read_vocab_groups(spark, str(tmp_path / "groups.json"))) == [("4", ["a", "4"]), ("@", ["a", "@", ""]), ("a", ["a", "4"])]
    write(tmp_path / "lm.json", json.dumps({"lambda": {"a": 0.5}, "bigram": {"ab": 0.1}, "unigram": {"b": 0.2}}), "utf-8-sig")
    weights, bigram, unigram = S.read_char_lm(spark, str(tmp_path / "lm.json"))
    assert rows(weights) == [("a", 0.5)] and rows(bigram) == [("ab", 0.1)] and rows(unigram) == [("b", 0.2)]
    write(tmp_path / "corpus.txt", "first\nsecond\n", "utf-8-sig")
    assert rows(S.read_corpus(spark, str(tmp_path / "corpus.txt"))) == [("first",), ("second",)]


def test_discovery(spark, tmp_path):
    for folder in ("ST_one/images", "ST_one/annotations", "two/images"):
        write(tmp_path / folder / "x.json", "{}")
    assert rows(S.discover_datasets(spark, str(tmp_path)).select("dataset")) == [("one",)]


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z")], "dataset string, id int, label string")
    store.write_samples(df, str(tmp_path / "s"), ["id"])
    got = store.read_samples(spark, str(tmp_path / "s"), ["a"])
    assert rows(got.select("dataset", "sample_id", "image_key", "label"), "sample_id") == [
        ("a", 1, "image-000000001", "y"), ("a", 2, "image-000000002", "x"),
    ]
    assert rows(feed.count_samples(df)) == [("a", 2), ("b", 1)]


def test_written_annotations(spark, tmp_path):
    words = spark.createDataFrame([("f", "train", 1, "b"), ("f", "train", 0, "a")], "file string, split string, word_idx int, text string")
    A.write_annotations(A.nest_words(words), str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.select("split", F.transform("words", lambda w: w["text"]).alias("t")).first() == ("train", ["a", "b"])


def test_store_reports_unreadable_files(spark, tmp_path):
    docs = spark.createDataFrame([(d, i, "t") for d in ("a", "b") for i in range(3)], "dataset string, doc_id long, label string")
    store.write_samples(docs, str(tmp_path / "s"), ["doc_id"])
    assert store.read_samples(spark, str(tmp_path / "s")).count() == 6
    (tmp_path / "s" / "dataset=b" / "part-bad.parquet").write_bytes(b"not a table")
    assert store.read_samples(spark, str(tmp_path / "s"), ["a"]).count() == 3
    with pytest.raises(Exception, match="part-bad"):
        store.read_samples(spark, str(tmp_path / "s")).agg({"label": "max"}).collect()
