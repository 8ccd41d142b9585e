"""Metric logs, training feeds and their streaming twins."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pagelake.operators import feed as E
from pagelake.operators import metrics as M
from pagelake.plans import streams
from pagelake.plans.catalogue import QUERIES
from pagelake.streaming import ingest
from pagelake.streaming import metrics as R


@pytest.fixture(scope="module")
def log():
    rng = random.Random(8)
    return [(n, i, float(rng.randint(0, 99)), n != "lr") for i in range(60) for n in ("loss", "acc", "lr")]


SCHEMA = "name string, iteration long, value double, smooth boolean"


@pytest.fixture(scope="module")
def stream(spark, log, tmp_path_factory):
    """The log as six micro-batches, rows unsorted inside a batch."""
    folder = tmp_path_factory.mktemp("log")
    for k in range(6):
        part = [r for r in log if r[1] // 10 == k]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.json(str(folder / f"b{k}"))
    return lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / "*"))


def run(stream_df, tmp_path, mode="append"):
    name = "out_" + str(abs(hash(str(tmp_path))))
    started = stream_df.writeStream.format("memory").queryName(name).outputMode(mode)
    started.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return stream_df.sparkSession.table(name)


def test_smoothing_as_a_stream(spark, log, stream, tmp_path):
    batch = M.smooth_metrics(spark.createDataFrame(log, SCHEMA), 7).select("name", "iteration", "smoothed")
    got = run(R.stream_smooth(stream(), 7, lateness=30), tmp_path)
    # Files may arrive in any order; with enough lateness only rows that came early differ.
    final = got.where("error is null").groupBy("name", "iteration").agg(F.last("smoothed").alias("smoothed"))
    assert final.count() == batch.count()
    lr = lambda df: rows(df.where("name = 'lr'").select("iteration", "smoothed"))
    assert lr(final) == lr(batch)


def test_changed_hint_is_an_error_row(spark, tmp_path):
    spark.createDataFrame([("a", 0, 1.0, True), ("a", 1, 2.0, False)], SCHEMA).write.json(str(tmp_path / "in"))
    got = run(R.stream_smooth(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))), tmp_path)
    assert rows(got.select("iteration", "smoothed", "error")) == [(0, 1.0, None), (1, None, "smoothing hint changed")]


def test_latest_as_a_stream(spark, log, stream, tmp_path):
    batch = M.latest_metrics(spark.createDataFrame(log, SCHEMA))
    assert rows(run(R.stream_latest(stream()), tmp_path, "complete")) == rows(batch)


def test_early_stop_as_a_stream(spark, tmp_path):
    values = [1, 3, 2, 3, 2, 1, 5, 4, 4, 4, 4]
    data = [("e", i, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "exp string, step long, value double")
    for points in (None, [("e", 2), ("e", 6)]):
        batch = rows(M.early_stop(df, 3, points=points).where("stop").select("exp", "step", "best"))
        assert batch == [("e", 5, 3.0)]
    df.write.json(str(tmp_path / "in"))
    got = run(R.stream_early_stop(spark.readStream.schema(df.schema).json(str(tmp_path / "in")), 3), tmp_path)
    assert rows(got) == batch


def test_metric_lines(spark, tmp_path):
    df = spark.createDataFrame([("loss", 19, 1.5), ("lr", 19, 0.01), ("loss", 39, 1.0), ("acc", 39, 2.0)], "name string, iteration long, value double")
    M.write_metrics_jsonl(df, str(tmp_path / "m"), last_write=19)
    assert [r[0] for r in spark.read.text(str(tmp_path / "m")).collect()] == ['{"acc": 2.0, "iteration": 39, "loss": 1.0}']


def test_histogram_edges(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 10.0), ("c", 5.0), ("c", 5.0)], "k string, v double")
    got = {r["k"]: r for r in M.fixed_histogram(df, "v", ["k"], 10).collect()}
    assert got["a"]["bucket_counts"] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 1] and got["a"]["bucket_limits"][-1] == 10.0
    assert sum(got["c"]["bucket_counts"]) == 2 and got["c"]["bucket_counts"][5] == 2


def test_hard_negatives(spark):
    data = [(1, 0, 0.5, 1.0)] + [(1, i, float(i), 0.0) for i in range(1, 6)] + [(2, i, float(i), 0.0) for i in range(4)] + [(3, 0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "image_id int, cell int, loss double, label double")
    assert rows(M.hard_negative_mean(df, without=2)) == [(1, 1, 4.5), (2, 0, 2.5), (3, 1, None)]


def test_checkpoints(spark):
    files = [("a", "best_accuracy.pth"), ("a", "iter_0000100.pth"), ("a", "iter_0000020.pth"), ("b", "best_accuracy.pth"), ("c", "7.pth"), ("c", "notes.txt")]
    df = spark.createDataFrame(files, "exp string, file_name string")
    assert rows(M.select_checkpoint(df)) == [("a", "best_accuracy.pth", 100), ("b", None, 0), ("c", "iter_7.pth", 7)]
    assert rows(M.select_checkpoint(df, "last")) == [("a", "iter_100.pth", 100), ("b", None, 0), ("c", "iter_7.pth", 7)]


def test_mix_restarts_short_datasets(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "dataset string, id int")
    out = E.mix_datasets(df, {"a": 2, "b": 1, "none": 4}, ["id"])
    assert rows(out.select("position", "dataset", "id")) == [
        (0, "a", 0), (1, "a", 1), (2, "b", 0), (3, "a", 2), (4, "a", 3), (5, "b", 0), (6, "a", 4), (7, "a", 0), (8, "b", 0),
    ]


def test_mix_repeats_one_row_next_to_many(spark, monkeypatch):
    monkeypatch.setattr(E, "MOST_COPIES", 8)
    df = spark.createDataFrame([("a", i) for i in range(1000)] + [("b", 0)] + [("c", i) for i in range(7)], "dataset string, id int")
    got = E.mix_datasets(df, {"a": 1, "b": 2, "c": 1}, ["id"])
    want = sorted([(4 * i, "a", i) for i in range(1000)] + [(4 * i + 1 + k, "b", 0) for i in range(1000) for k in (0, 1)] + [(4 * i + 3, "c", i % 7) for i in range(1000)])
    assert rows(got.select("position", "dataset", "id")) == want
    assert E.mix_datasets(df.limit(0), {"a": 1}, ["id"]).count() == 0


def test_whole_mix_takes_every_dataset(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"src{i % 7}", "t") for i in range(30)], "doc_id long, source string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["mix_datasets_whole"](spark, str(tmp_path)).collect()
    assert {r.dataset for r in got} == {f"src{i}" for i in range(7)} and len({(r.dataset, r.sample_id) for r in got}) == 30
    assert sorted(r.position for r in got) == list(range(len(got)))


def test_whole_vocabulary_has_every_character(spark, tmp_path):
    spark.createDataFrame([(1, "b a\té7#"), (2, "Z\\\n\rß")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [r.ch for r in QUERIES["read_vocab_whole"](spark, str(tmp_path)).orderBy("idx").collect()]
    assert got == ["\n", "\t", " ", "\r", "#", "7", "Z", "\\", "a", "b", "ß", "é"]


def test_split_store(spark):
    df = spark.range(25).toDF("id")
    kept = E.split_store(df, ["id"], 10, max_shards=10, drop_partial=True, name="s")
    assert rows(kept.groupBy("shard").count()) == [("s_0000", 10), ("s_0001", 10)]
    assert E.split_store(df, ["id"], 10).count() == 25
    assert E.split_store(df, ["id"], 1, max_shards=10).count() == 10


def test_sampled_texts(spark):
    corpus = spark.createDataFrame([(0, "a long line of words here"), (1, "   "), (2, "shorty")], "n int, line string")
    got = E.sample_text(spark, corpus, 300, ["n"], min_len=3, max_len=10, seed=1)
    texts = [r["text"] for r in got.collect()]
    assert len(texts) == 300 and all(3 <= len(t) <= 10 and t.strip() for t in texts) and len(set(texts)) > 20
    assert rows(got) == rows(E.sample_text(spark, corpus.repartition(3), 300, ["n"], min_len=3, max_len=10, seed=1))
    numbers = E.sample_numbers(spark, 500, -3, 4, 0.5, 1, seed=2)
    assert numbers.where("value < -3 or value >= 4").count() == 0 and numbers.where("value <> floor(value)").count() > 100


def test_sampled_texts_of_blank_runs(spark):
    for line in ("x" + " " * 5000 + "yz", " " * 5000 + "x", "x" + " " * 5000):
        corpus = spark.createDataFrame([(0, line)], "n int, line string")
        texts = [r["text"] for r in E.sample_text(spark, corpus, 200, ["n"], min_len=3, max_len=10, seed=1).collect()]
        assert len(texts) == 200 and all(3 <= len(t) <= 10 and t.strip() and t in line for t in texts)


def test_sampled_texts_of_all_languages(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{lang} line", lang) for i, lang in enumerate(["en", "de", "fr", None] * 10)], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [r["text"] for r in QUERIES["sample_text"](spark, str(tmp_path)).collect()]
    assert len(got) == 40 and {t.split()[0] for t in got} == {"en", "de", "fr", "None"}


def test_ingest_stream(spark, tmp_path):
    corner = ", ".join(f'"{a}{i}": {i}' for i in range(1, 5) for a in "xy")
    for name, x in (("a", ""), ("b", '"x1": -1, ')):
        text = f'{{"file": "{name}.jpg", "words": [{{"text": "w", {x}{corner if not x else corner.replace(chr(34) + "x1" + chr(34) + ": 1, ", "")}}}]}}'
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "c.json").write_text("{oops")
    words = run(ingest.stream_ingest(ingest.stream_annotations(spark, str(tmp_path / "*.json"))), tmp_path)
    assert rows(words.select("file", "text")) == [("a.jpg", "w")]


def test_ingest_keeps_state_in_as_many_parts_as_cores(spark, tmp_path, monkeypatch):
    corner = ", ".join(f'"{a}{i}": {i}' for i in range(1, 5) for a in "xy")
    (tmp_path / "in").mkdir()
    for k, names in enumerate((["a"], ["a", "b"], ["c"], ["d"], ["b", "e"], ["f"])):
        images = (f'{{"file": "{n}.jpg", "words": [{{"text": "{n}", {corner}}}]}}' for n in names)
        (tmp_path / "in" / f"{k}.json").write_text(f"[{', '.join(images)}]")
    monkeypatch.setattr(streams, "annotation_files", lambda *_, **__: str(tmp_path / "in"))
    monkeypatch.setattr(streams, "_paths", lambda _: (str(tmp_path / "out"), str(tmp_path / "state")))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = rows(QUERIES["stream_ingest"](spark, "").select("file", "text"))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "11"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert got == [(f"{n}.jpg", n) for n in "abcdef"]
    assert len([p for p in (tmp_path / "state" / "state" / "0").iterdir() if p.name.isdigit()]) == spark.sparkContext.defaultParallelism


def test_ingest_commits_each_file_once(spark, tmp_path, monkeypatch):
    corner = ", ".join(f'"{a}{i}": {i}' for i in range(1, 5) for a in "xy")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text(f'{{"file": "a.jpg", "words": [{{"text": "a", {corner}}}]}}')
    monkeypatch.setattr(streams, "annotation_files", lambda *_, **__: str(tmp_path / "in"))
    monkeypatch.setattr(streams, "_paths", lambda _: (str(tmp_path / "out"), str(tmp_path / "state")))
    manager, append, seen = "spark.sql.streaming.checkpointFileManagerClass", streams._run_append, []
    monkeypatch.setattr(streams, "_run_append", lambda *a: seen.append(spark.conf.get(manager, None)) or append(*a))
    assert rows(QUERIES["stream_ingest"](spark, "").select("file", "text")) == [("a.jpg", "a")]
    # A local folder: no process is started for each file, and no file of the state has a second checksum.
    assert seen == [streams.LOCAL_MANAGER] and spark.conf.get(manager, None) is None
    assert not [p.name for p in (tmp_path / "state").rglob("*.crc.crc")]
