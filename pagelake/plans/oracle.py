"""The derived tables as SQL common table expressions, for checking results in another engine."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    CTES[name] = (needs, sql)


cte("gt_words", """
  SELECT image_id, word_idx, grp, text, xmin, ymin, xmin + w AS xmax, ymin + h AS ymax FROM (
    SELECT l_orderkey AS image_id,
           CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
             l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS BIGINT) AS word_idx,
           p_brand AS grp, CASE WHEN l_partkey % 7 = 0 THEN '###' ELSE p_name END AS text,
           (l_partkey * 37 + l_suppkey * 11) % 1100 AS xmin, (l_partkey * 53 + l_linenumber * 97) % 700 AS ymin,
           20 + 4 * CAST(l_quantity AS BIGINT) AS w, 12 + l_suppkey % 30 AS h
    FROM lineitem JOIN part ON l_partkey = p_partkey)""")
cte("gt_eval", """
  SELECT image_id, 2 * word_idx AS word_idx, grp, text, xmin, ymin,
         CASE WHEN (image_id + word_idx) % 11 = 4 THEN (xmin + xmax) // 2 ELSE xmax END AS xmax, ymax FROM gt_words
  UNION ALL
  SELECT image_id, 2 * word_idx + 1, grp, text, (xmin + xmax) // 2, ymin, xmax, ymax
  FROM gt_words WHERE (image_id + word_idx) % 11 = 4""", ("gt_words",))
cte("det_boxes", """
  SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY word_idx, piece) - 1 AS BIGINT) AS det_idx,
         xmin, ymin, xmax, ymax, CAST((image_id * 31 + word_idx * 17 + piece) % 1000 AS DOUBLE) / 1000 AS conf
  FROM (
    SELECT image_id, word_idx, 0 AS piece, xmin + d AS xmin, ymin + d AS ymin, xmax + d AS xmax, ymax + d AS ymax
      FROM (SELECT *, (image_id + 7 * word_idx) % 9 - 4 AS d FROM gt_words)
      WHERE (image_id + word_idx) % 11 NOT IN (0, 1, 2)
    UNION ALL SELECT image_id, word_idx, 0, xmin, ymin, (xmin + xmax) // 2, ymax FROM gt_words
      WHERE (image_id + word_idx) % 11 IN (1, 2)
    UNION ALL SELECT image_id, word_idx, 1, (xmin + xmax) // 2, ymin, xmax, ymax FROM gt_words
      WHERE (image_id + word_idx) % 11 IN (1, 2)
    UNION ALL SELECT image_id, 9999, 2, 5, 5, 90, 30 FROM gt_words WHERE word_idx = 0 AND image_id % 13 = 0)""",
    ("gt_words",))
cte("recog_pairs", """
  SELECT image_id * 100 + word_idx AS sample_id, grp, text AS gt,
         CASE (image_id + word_idx) % 6 WHEN 0 THEN text WHEN 1 THEN replace(text, 'i', 'l') WHEN 2 THEN upper(text)
           WHEN 3 THEN substr(text, 1, length(text) - 1) WHEN 4 THEN '' ELSE concat(text, '?') END AS pred
  FROM gt_words WHERE text <> '###'""", ("gt_words",))
cte("metric_events", """
  SELECT event_type AS name,
         CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS iteration,
         value, event_type <> 'error' AS smooth, ts FROM events""")
cte("logits", """
  SELECT vec_id // 8 AS seq_id, vec_id % 8 AS step, embedding AS scores FROM embeddings""")
cte("ckpt_files", """
  SELECT o_orderpriority AS exp, CASE WHEN o_orderkey % 700 = 0 THEN 'best_accuracy.pth'
         ELSE concat('iter_', lpad(CAST(o_orderkey AS VARCHAR), 7, '0'), '.pth') END AS file_name FROM orders""")
cte("imgs", """
  SELECT DISTINCT image_id, concat('img_', CAST(image_id AS VARCHAR), '.jpg') AS file_name, 1280 AS width,
         800 AS height, CASE WHEN image_id % 10 = 0 THEN 'val' WHEN image_id % 10 = 1 THEN 'test' ELSE 'train' END
         AS split FROM gt_words""", ("gt_words",))
cte("anns", """
  SELECT image_id * 100 + word_idx AS ann_id, image_id, xmin AS bx, ymin AS byy, xmax - xmin AS bw, ymax - ymin AS bh,
         (xmax - xmin) * (ymax - ymin) AS area,
         CASE WHEN word_idx % 3 = 0 THEN 'illegible' ELSE 'legible' END AS legibility,
         CASE WHEN word_idx % 2 = 0 THEN 'machine printed' ELSE 'handwritten' END AS class,
         CASE WHEN word_idx % 3 = 0 THEN NULL ELSE text END AS utf8_string FROM gt_words""", ("gt_words",))
cte("icdar15_lines", """
  SELECT image_id, word_idx, concat_ws(',', xmin::VARCHAR, ymin::VARCHAR, xmax::VARCHAR, ymin::VARCHAR,
         xmax::VARCHAR, ymax::VARCHAR, xmin::VARCHAR, ymax::VARCHAR, text) AS line FROM gt_words""", ("gt_words",))
cte("samples", """
  SELECT source AS dataset, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS sample_id,
         doc_id, text AS label FROM documents""")
cte("score_grid", """
  SELECT vec_id AS image_id, CAST(pos // 8 AS INTEGER) AS y, CAST(pos % 8 AS INTEGER) AS x, v AS text,
         CAST(v / 2 AS FLOAT) AS link
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)""")
cte("lm_ones", """
  SELECT ch, CAST(count(*) AS DOUBLE) AS n FROM (
    SELECT substr(text, CAST(i AS BIGINT), 1) AS ch
    FROM (SELECT text, unnest(range(1, length(text) + 1)) AS i FROM benchmark)) GROUP BY ch""")
cte("lm_pairs", """
  SELECT pair, substr(pair, 1, 1) AS ch, CAST(count(*) AS DOUBLE) AS n FROM (
    SELECT substr(text, CAST(i AS BIGINT), 2) AS pair
    FROM (SELECT text, unnest(range(1, length(text))) AS i FROM benchmark)) GROUP BY pair""")
cte("lm_unigram", "SELECT ch, n / (SELECT sum(n) FROM lm_ones) AS p FROM lm_ones", ("lm_ones",))
cte("lm_bigram", "SELECT pair, n / sum(n) OVER (PARTITION BY ch) AS p FROM lm_pairs", ("lm_pairs",))
cte("lm_lambda", "SELECT DISTINCT ch, CAST(0.9 AS DOUBLE) AS weight FROM lm_pairs", ("lm_pairs",))
cte("word_chars", """
  SELECT image_id, word_idx, i AS char_idx, substr(text, CAST(i + 1 AS BIGINT), 1) AS ch,
         xmin + (xmax - xmin) * i // n AS cx0, ymin AS cy0, xmin + (xmax - xmin) * (i + 1) // n AS cx1, ymax AS cy1
  FROM (SELECT *, length(text) AS n, unnest(range(0, length(text))) AS i FROM gt_words)""", ("gt_words",))


def with_ctes(names: tuple[str, ...] | list[str], body: str, recursive: bool = False) -> str:
    """``body`` preceded by the named expressions and all they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order]
    text = body.strip()
    word = "WITH RECURSIVE " if recursive else "WITH "
    if text.upper().startswith("WITH "):
        return word + ",\n".join(parts) + ",\n" + text[5:]
    return word + ",\n".join(parts) + "\n" + text
