"""Queries on label coding, decoding and language-model scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions import decode as D
from pagelake.functions import text as X
from pagelake.operators import sequences as Q
from pagelake.plans import fixtures as fx
from pagelake.plans.oracle import cte
from pagelake.plans.registry import query

LETTERS = "abcdefghijklmnopqrstuvwxyz"
CLASSES = "".join(chr(c) for c in range(33, 33 + 62))  # 62 characters: with two marks, one class per score


def _joined(array):
    return F.array_join(array.cast("array<string>"), ",")


def _pairs(spark, sf_dir):
    return fx.recog_pairs(fx.gt_words(spark, sf_dir))


@query("ctc_encode", ("recog_pairs",), """
  SELECT sample_id, array_to_string(list_transform(string_split(replace(gt, ' ', ''), ''), lambda c: instr('abcdefghijklmnopqrstuvwxyz', c)::INTEGER), ',') AS indices
  FROM recog_pairs""")
def ctc_encode(spark, sf_dir):
    codes = D.ctc_encode(F.replace("gt", F.lit(" ")), LETTERS)
    return _pairs(spark, sf_dir).select("sample_id", _joined(codes).alias("indices"))


@query("ctc_decode", ("recog_pairs",), """
  SELECT sample_id, regexp_replace(replace(gt, ' ', ''), '([a-z])', '\\1', 'g') AS text, replace(gt, ' ', '') AS wide FROM recog_pairs
""".replace("regexp_replace(replace(gt, ' ', ''), '([a-z])', '\\1', 'g')", "array_to_string(list_transform(list_filter(range(1, length(replace(gt, ' ', '')) + 1), lambda i: i = 1 OR substr(replace(gt, ' ', ''), CAST(i AS BIGINT), 1) <> substr(replace(gt, ' ', ''), CAST(i - 1 AS BIGINT), 1)), lambda i: substr(replace(gt, ' ', ''), CAST(i AS BIGINT), 1)), '')"))
def ctc_decode(spark, sf_dir):
    """Repeats collapse; a blank between the characters keeps them apart."""
    codes = D.ctc_encode(F.replace("gt", F.lit(" ")), LETTERS)
    wide = F.flatten(F.transform(codes, lambda c: F.array(c, F.lit(0))))
    return _pairs(spark, sf_dir).select(
        "sample_id", D.ctc_decode(codes, LETTERS).alias("text"), D.ctc_decode(wide, LETTERS).alias("wide")
    )


@query("attn_encode", ("recog_pairs",), """
  SELECT sample_id, length(gt) + 1 AS length, array_to_string(list_resize(list_concat([0], list_transform(string_split(replace(gt, ' ', ''), ''),
    lambda c: instr('abcdefghijklmnopqrstuvwxyz', c)::INTEGER + 1), [1]), 27, 0)::INTEGER[], ',') AS indices FROM recog_pairs""")
def attn_encode(spark, sf_dir):
    coded = D.attn_encode("gt", LETTERS)
    return _pairs(spark, sf_dir).select(
        "sample_id", coded["length"].cast("long").alias("length"), _joined(coded["indices"]).alias("indices")
    )


@query("attn_decode", ("recog_pairs",), """
  SELECT sample_id, replace(gt, ' ', '') AS pruned FROM recog_pairs""")
def attn_decode(spark, sf_dir):
    """Encode, drop the start mark, decode and cut at the end mark."""
    codes = D.attn_encode("gt", LETTERS)["indices"]
    text = D.attn_decode(F.slice(codes, 2, 26), LETTERS)
    return _pairs(spark, sf_dir).select("sample_id", D.prune_eos(text).alias("pruned"))


@query("prune_eos", ("recog_pairs",), """
  SELECT sample_id, CASE WHEN p = 0 THEN substr(pred, 1, greatest(length(pred) - 1, 0)) ELSE substr(pred, 1, p - 1) END AS strict,
         CASE WHEN p = 0 THEN pred ELSE substr(pred, 1, p - 1) END AS plain
  FROM (SELECT sample_id, pred, instr(pred, '[s]') AS p FROM (
    SELECT sample_id, CASE WHEN sample_id % 2 = 0 THEN concat(pred, '[s]', gt) ELSE pred END AS pred FROM recog_pairs))""")
def prune_eos(spark, sf_dir):
    text = F.when(F.col("sample_id") % 2 == 0, F.concat("pred", F.lit("[s]"), "gt")).otherwise(F.col("pred"))
    return _pairs(spark, sf_dir).select(
        "sample_id", D.prune_eos(text).alias("strict"), D.prune_eos(text, strict=False).alias("plain")
    )


@query("oov_chars", ("recog_pairs",), """
  SELECT sample_id, array_to_string(list_sort(list_distinct(list_filter(string_split(pred, ''), lambda c: instr('abcdefghijklmnopqrstuvwxyz', c) = 0))), ',') AS oov
  FROM recog_pairs WHERE pred <> ''""")
def oov_chars(spark, sf_dir):
    rows = _pairs(spark, sf_dir).where("pred <> ''")
    return rows.select("sample_id", _joined(F.array_sort(D.oov_chars("pred", LETTERS))).alias("oov"))


@query("argmax_decode", (), """
  SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS idx,
         round(1.0 / list_sum(list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE)))), 6) AS p
  FROM embeddings""")
def argmax_decode(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", D.argmax("embedding").alias("idx"), F.round(D.max_prob("embedding"), 6).alias("p"))


@query("softmax", (), """
  SELECT vec_id, CAST(unnest(range(0, 64)) AS INTEGER) AS class, unnest(list_transform(e, lambda v: round(v / list_sum(e), 6))) AS prob FROM (
    SELECT vec_id, list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE))) AS e FROM embeddings)""")
def softmax(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings")
    classes = rows.select("vec_id", F.posexplode(D.softmax("embedding")).alias("class", "prob"))
    return classes.withColumn("prob", F.round("prob", 6))


cte("steps", """
  SELECT vec_id // 8 AS seq_id, vec_id % 8 AS step, list_position(embedding, list_max(embedding)) - 1 AS idx,
         1.0 / list_sum(list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE)))) AS p
  FROM embeddings""")


@query("ctc_greedy_text", ("steps",), """
  SELECT seq_id, coalesce(string_agg(chr(CAST(32 + idx AS INTEGER)), '' ORDER BY step) FILTER (keep), '') AS text FROM (
    SELECT *, idx <> 0 AND idx <> coalesce(lag(idx) OVER (PARTITION BY seq_id ORDER BY step), -1) AS keep FROM steps) GROUP BY seq_id""")
def ctc_greedy_text(spark, sf_dir):
    charset = CLASSES + chr(33 + 62)
    steps = Q.decode_steps(fx.logits(spark, sf_dir))
    return steps.select("seq_id", D.ctc_decode("indices", charset).alias("text"))


@query("sequence_confidence", ("steps",), """
  SELECT seq_id, round(coalesce(exp(sum(ln(p)) FILTER (step < seq_id % 9)), 0), 9) AS confidence FROM steps GROUP BY seq_id""")
def sequence_confidence(spark, sf_dir):
    """Product over the first seq_id % 9 steps."""
    steps = Q.decode_steps(fx.logits(spark, sf_dir))
    return steps.select("seq_id", F.round(D.sequence_confidence("probs", F.col("seq_id") % 9), 9).alias("confidence"))


@query("restrict_vocab", ("logits",), """
  SELECT l.seq_id, step, CAST(unnest(range(0, 64)) AS INTEGER) AS class, unnest(list_transform(range(0, 64),
    lambda i: CASE WHEN i IN (1, 5, 9, 17, 33) THEN round(CAST(scores[i + 1] AS DOUBLE) - low, 6) ELSE 0.0 END)) AS score
  FROM logits l JOIN (SELECT seq_id, CAST(min(list_min(scores)) AS DOUBLE) AS low FROM logits GROUP BY seq_id) m ON l.seq_id = m.seq_id""")
def restrict_vocab(spark, sf_dir):
    out = Q.restrict_vocab(fx.logits(spark, sf_dir), [1, 5, 9, 17, 33])
    classes = out.select("seq_id", "step", F.posexplode("scores").alias("class", "score"))
    return classes.withColumn("score", F.round("score", 6))


@query("char_lm", ("lm_bigram", "lm_unigram"), """
  SELECT 'bigram' AS kind, pair AS item, round(p, 9) AS p FROM lm_bigram UNION ALL SELECT 'unigram', ch, round(p, 9) FROM lm_unigram""")
def char_lm(spark, sf_dir):
    _, bigram, unigram = fx.char_lm(spark, sf_dir)
    one = bigram.select(F.lit("bigram").alias("kind"), F.col("pair").alias("item"), F.round("p", 9).alias("p"))
    return one.unionByName(unigram.select(F.lit("unigram").alias("kind"), F.col("ch").alias("item"), F.round("p", 9).alias("p")))


cte("lm_scored", """
  SELECT id, sum(CASE WHEN q > 0 THEN n * ln(q) ELSE CAST('-infinity' AS DOUBLE) END) AS score FROM (
    SELECT t.id, t.n, coalesce(w.weight, 0) * coalesce(b.p, 0) + (1 - coalesce(w.weight, 0)) * coalesce(u.p, 0) AS q
    FROM (SELECT id, substr(text, CAST(i AS BIGINT), 2) AS pair, count(*) AS n FROM (
            SELECT sample_id AS id, pred AS text, unnest(range(1, length(pred))) AS i FROM recog_pairs) GROUP BY ALL) t
    LEFT JOIN lm_lambda w ON w.ch = substr(t.pair, 1, 1) LEFT JOIN lm_bigram b ON b.pair = t.pair
    LEFT JOIN lm_unigram u ON u.ch = substr(t.pair, 2, 1)) GROUP BY id""", ("recog_pairs", "lm_lambda", "lm_bigram", "lm_unigram"))


@query("bigram_score", ("lm_scored", "recog_pairs"), """
  SELECT sample_id AS id, isinf(coalesce(score, 0)) AS impossible, CASE WHEN isinf(coalesce(score, 0)) THEN NULL ELSE round(coalesce(score, 0), 6) END AS score
  FROM recog_pairs LEFT JOIN lm_scored ON sample_id = id""")
def bigram_score(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select(F.col("sample_id").alias("id"), F.col("pred").alias("text"))
    out = Q.bigram_score(rows, *fx.char_lm(spark, sf_dir))
    never = F.col("score") == float("-inf")
    return out.select("id", never.alias("impossible"), F.when(~never, F.round("score", 6)).alias("score"))


@query("beam_rerank", ("recog_pairs",), """
  WITH b AS (SELECT sample_id // 1000 AS seq_id, sample_id AS beam, concat(pred, '[s]') AS text,
      -1.0 * (sample_id % 13) AS lm, -0.5 * (sample_id % 7) AS bm FROM recog_pairs),
  s AS (SELECT *, exp(lm) / sum(exp(lm)) OVER w + exp(bm) / sum(exp(bm)) OVER w AS mix FROM b WINDOW w AS (PARTITION BY seq_id))
  SELECT seq_id, substr(t, 1, instr(t, '[s]') - 1) AS text, round(exp(m) / total, 6) AS confidence FROM (
    SELECT seq_id, first(text ORDER BY round(mix, 9) DESC, beam) AS t, max(mix) AS m, sum(exp(mix)) AS total FROM s GROUP BY seq_id)""")
def beam_rerank(spark, sf_dir):
    beams = _pairs(spark, sf_dir).select(
        F.floor(F.col("sample_id") / 1000).alias("seq_id"), F.col("sample_id").alias("beam"), F.concat("pred", F.lit("[s]")).alias("text"),
        (F.col("sample_id") % 13 * -1.0).alias("lm_score"), (F.col("sample_id") % 7 * -0.5).alias("beam_score"),
    )
    out = Q.beam_rerank(beams)
    return out.select("seq_id", "text", F.round("confidence", 6).alias("confidence"))


@query("beam_topk", ("steps",), """
  SELECT seq_id, round(sum(ln(p + 1e-9)), 6) AS score, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY step) AS seq FROM steps GROUP BY seq_id""")
def beam_topk(spark, sf_dir):
    """Best of three beams per sequence: with independent steps it is the greedy path."""
    steps = fx.logits(spark, sf_dir).groupBy("seq_id").agg(
        F.array_sort(F.collect_list(F.struct("step", D.softmax("scores").alias("p")))).alias("s")
    )
    best = F.get(D.beam_topk(F.transform("s", lambda s: s["p"]), 3), 0)
    rows = steps.select("seq_id", best.alias("b"))
    return rows.select("seq_id", F.round("b.score", 6).alias("score"), F.array_join(F.col("b.seq").cast("array<string>"), ",").alias("seq"))


@query("word_tokenize", (), """
  SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS tokens,
         regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')[-1] AS last_token,
         sha256(array_to_string(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]'), chr(10))) AS tokens_sha256 FROM documents""")
def word_tokenize(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", X.word_tokenize("text").alias("t"))
    listed = F.sha2(F.array_join("t", "\n").cast("binary"), 256).alias("tokens_sha256")
    return rows.select("doc_id", F.size("t").cast("long").alias("tokens"), F.get("t", F.size("t") - 1).alias("last_token"), listed)


@query("sentence_split", (), """
  SELECT doc_id, len(list_filter(s, lambda p: length(p) > 0)) AS sentences, list_filter(s, lambda p: length(p) > 0)[1] AS first_sentence,
         sha256(array_to_string(list_filter(s, lambda p: length(p) > 0), chr(10))) AS sentences_sha256 FROM (
    SELECT doc_id, flatten(list_transform(string_split(replace(text, '. ', '。'), chr(10)),
      lambda l: string_split(replace(regexp_replace(l, '[ \\t\\r]+$', ''), '。', '。' || chr(10)), chr(10)))) AS s FROM documents)""")
def sentence_split(spark, sf_dir):
    """Latin full stops become ideographic ones; then one sentence per stop or line."""
    rows = fx.table(spark, sf_dir, "documents").select(
        "doc_id", X.sentence_split_ja(F.replace("text", F.lit(". "), F.lit("。"))).alias("s")
    )
    listed = F.sha2(F.array_join("s", "\n").cast("binary"), 256).alias("sentences_sha256")
    return rows.select("doc_id", F.size("s").cast("long").alias("sentences"), F.get("s", 0).alias("first_sentence"), listed)


@query("clean_field", ("gt_words",), "SELECT image_id, word_idx, text AS cleaned FROM gt_words")
def clean_field(spark, sf_dir):
    dirty = F.concat(F.lit('\ufeff "'), "text", F.lit('"\r\n'))
    return fx.gt_words(spark, sf_dir).select("image_id", "word_idx", X.clean_field(dirty).alias("cleaned"))


@query("swap_group_chars", ("recog_pairs",), """
  SELECT sample_id, array_to_string(list_transform(range(0, length(gt)), lambda i: CASE substr(gt, CAST(i + 1 AS BIGINT), 1)
    WHEN 'o' THEN ['o', '0'][(sample_id + i) % 2 + 1] WHEN 'l' THEN ['l', '1', 'I'][(sample_id + i) % 3 + 1]
    ELSE substr(gt, CAST(i + 1 AS BIGINT), 1) END), '') AS text FROM recog_pairs""")
def swap_group_chars(spark, sf_dir):
    groups = {"o": ["o", "0"], "l": ["l", "1", "I"]}
    swapped = X.swap_group_chars("gt", groups, lambda i, n: (F.col("sample_id") + i) % n)
    return _pairs(spark, sf_dir).select("sample_id", swapped.alias("text"))


@query("json_label", ("gt_words",), "SELECT image_id, word_idx, text, xmin + ymin AS corner FROM gt_words")
def json_label(spark, sf_dir):
    made = F.to_json(F.struct("text", "xmin", "ymin"))
    parsed = fx.gt_words(spark, sf_dir).select("image_id", "word_idx", X.json_label(made, "text string, xmin long, ymin long").alias("j"))
    return parsed.select("image_id", "word_idx", "j.text", (F.col("j.xmin") + F.col("j.ymin")).alias("corner"))


@query("format_key", (), """
  SELECT doc_id, printf('image-%09d', doc_id) AS image_key, printf('label-%09d', doc_id) AS label_key FROM documents""")
def format_key(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents")
    return rows.select("doc_id", X.format_key("doc_id").alias("image_key"), X.format_key("doc_id", "label").alias("label_key"))


@query("hook_labels", ("recog_pairs",), "SELECT sample_id, upper(pred) AS label FROM recog_pairs WHERE length(pred) BETWEEN 1 AND 8")
def hook_labels(spark, sf_dir):
    from pagelake.operators.hooks import handle_labels

    rows = _pairs(spark, sf_dir).select("sample_id", F.col("pred").alias("label"))
    return handle_labels(rows, lambda c: F.when(F.length(c).between(1, 8), F.upper(c)))


@query("hook_tokenizer", (), "SELECT doc_id, len(regexp_extract_all(text, '[^ \\n\\t\\r]+')) AS tokens FROM documents")
def hook_tokenizer(spark, sf_dir):
    from pagelake.operators.hooks import tokenizer

    split = tokenizer(lambda t: [p for p in t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if p])
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.size(split(F.col("text"))).cast("long").alias("tokens"))


@query("hook_recogniser", ("gt_words",), """
  SELECT image_id, word_idx, CASE WHEN text = '###' THEN '' ELSE upper(text) END AS text,
         CASE WHEN text = '###' THEN -1.0 ELSE CAST(length(text) AS DOUBLE) END AS score FROM gt_words""")
def hook_recogniser(spark, sf_dir):
    from pagelake.operators.hooks import apply_recogniser

    def load():
        def read(crop):
            if crop["text"] == "###":
                raise ValueError("unreadable")
            return crop["text"].upper(), len(crop["text"])

        return read

    rows = fx.gt_words(spark, sf_dir).select("image_id", "word_idx", "text")
    return apply_recogniser(rows, load, ("image_id", "word_idx"))


@query("hook_detector", ("imgs",), """
  SELECT image_id, i AS det_idx, i * 10 AS xmin, i * 10 + width // 4 AS xmax FROM imgs, range(0, 2) r(i)""")
def hook_detector(spark, sf_dir):
    from pagelake.operators.hooks import apply_detector

    def load():
        def find(pages):
            import pandas as pd

            return pd.concat(
                [pd.DataFrame({"image_id": pages["image_id"], "det_idx": i, "xmin": i * 10, "xmax": i * 10 + pages["width"] // 4}) for i in (0, 1)]
            )

        return find

    pages = fx.imgs(fx.gt_words(spark, sf_dir)).select("image_id", "width")
    return apply_detector(pages, load, "image_id long, det_idx long, xmin long, xmax long")
