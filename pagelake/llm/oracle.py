"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op3_rule_ledger"] = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
pos AS (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM w),
win AS (SELECT r, i, i + 7 <= len(words) AND count(*) OVER (PARTITION BY r, i + 7 <= len(words), list_slice(words, i, i + 7)) > 1 AS twice FROM pos),
cov AS (SELECT r, max(CAST(twice AS INTEGER)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM win),
rep AS (SELECT r, CAST(sum(hit) AS BIGINT) AS n FROM cov GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w),
own AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
         length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouts
  FROM w LEFT JOIN rep USING (r) LEFT JOIN own USING (r)),
bits AS (
  SELECT *, CAST(
    CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_words > 0 AND 5 * n_shouts > 2 * n_words THEN 64 ELSE 0 END
    + CASE WHEN n_letters > 0 AND 100 * n_upper > 60 * n_letters THEN 128 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM bits
"""

ORACLES["op4_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (SELECT DISTINCT r, hash(list_slice(words, i, i + 4)) AS s FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
meets AS (SELECT a.r AS x, b.r AS y, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
links AS (SELECT x, y FROM meets JOIN n na ON na.r = x JOIN n nb ON nb.r = y WHERE 100 * common >= 80 * (na.n + nb.n - common)),
reach AS (SELECT r AS x, r AS y FROM w UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least.component_id
FROM w LEFT JOIN n USING (r) JOIN (SELECT reach.x AS r, min(o.doc_id) AS component_id FROM reach JOIN w o ON o.r = reach.y GROUP BY reach.x) least USING (r)
"""

ORACLES["op7_warc_round_trip"] = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
held AS (SELECT payload_digest, max(page_id) AS last, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN n > 1 AND page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p LEFT JOIN held USING (payload_digest)
"""

ORACLES["op9_chat_events"] = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(16 + length(role) + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

ORACLES["op10_decontamination"] = r"""
WITH lower_docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(13, len(words)) AS size, list_slice(words, i, i + least(13, len(words)) - 1) AS win
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 11, 2))) AS i FROM items WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
spots AS (SELECT r, size, i, list_slice(words, i, i + size - 1) AS win FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM lower_docs, sizes)),
hits AS (SELECT r, spots.size, i, item FROM spots JOIN windows ON spots.win = windows.win),
hit_words AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + size)) AS place FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, list_sort(list(DISTINCT item)) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(words) AS contaminated
FROM lower_docs LEFT JOIN hit_words USING (r) LEFT JOIN found USING (r)
"""

# The inverse of a schedule's area, in the order of operations that the engine uses.
ORACLES["op8_curriculum_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('8:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS ord FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM sized GROUP BY source),
ranked AS (
  SELECT *, [5.0, 2.0, 1.0][kind + 1]::DOUBLE AS weight, 2 * source_size AS cap, 2 * source_size / [5.0, 2.0, 1.0][kind + 1]::DOUBLE AS ratio,
         (SELECT sum(source_size) FROM totals) * 3 / 2 AS demand, (SELECT sum([5.0, 2.0, 1.0][kind + 1]::DOUBLE) FROM totals) AS weights FROM totals),
levels AS (
  SELECT *, (demand - coalesce(sum(cap) OVER before, 0)) / (weights - coalesce(sum(weight) OVER before, 0)) AS own
  FROM ranked WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT *, least(CAST(cap AS DOUBLE), coalesce((SELECT own FROM levels WHERE own <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) * weight, cap)) AS target FROM levels),
placed AS (
  SELECT sized.*, source_size, target, kind,
         CAST(coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
passes AS (
  SELECT *, 2 * before + size <= 2 * target AND 0 < target AS first, 2 * source_size + 2 * before + size <= 2 * target AND source_size < target AS second FROM placed),
demands AS (
  SELECT *, CASE WHEN first THEN (before + size / 2) / target END AS y1, CASE WHEN second THEN (source_size + before + size / 2) / target END AS y2 FROM passes),
spots AS (
  SELECT *, CASE kind WHEN 0 THEN y1 * 10.0 / (7.5 + sqrt(7.5 * 7.5 - 5.0 * (y1 * 10.0))) WHEN 1 THEN y1
                 ELSE CASE WHEN y1 <= 0.375 THEN 0.5 * (y1 / 0.375 * 1.5 / (0.5 + sqrt(0.25 + 0.5 * (y1 / 0.375 * 1.5))))
                           ELSE 0.5 + 0.5 * ((y1 - 0.375) / 0.625 * 2.5 / (1.0 + sqrt(1.0 + 0.5 * ((y1 - 0.375) / 0.625 * 2.5)))) END END AS p1,
            CASE kind WHEN 0 THEN y2 * 10.0 / (7.5 + sqrt(7.5 * 7.5 - 5.0 * (y2 * 10.0))) WHEN 1 THEN y2
                 ELSE CASE WHEN y2 <= 0.375 THEN 0.5 * (y2 / 0.375 * 1.5 / (0.5 + sqrt(0.25 + 0.5 * (y2 / 0.375 * 1.5))))
                           ELSE 0.5 + 0.5 * ((y2 - 0.375) / 0.625 * 2.5 / (1.0 + sqrt(1.0 + 0.5 * ((y2 - 0.375) / 0.625 * 2.5)))) END END AS p2 FROM demands)
SELECT doc_id, size, source_size, target, size * (CAST(first AS INTEGER) + CAST(second AS INTEGER)) AS taken,
       round(CASE WHEN first THEN least(1.0, greatest(0.0, p1)) END, 9) AS first_position, round(CASE WHEN second THEN least(1.0, greatest(0.0, p2)) END, 9) AS second_position
FROM spots
"""

ORACLES["op12_phrase_collocations"] = r"""
WITH w AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM w),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
places AS (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM p, range(1, 6) s(size)),
f AS (SELECT lang, list_slice(words, i, i + size - 1) AS g, any_value(size) AS size, count(*) AS f FROM places GROUP BY lang, g),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
often AS (SELECT * FROM f WHERE f >= 100),
inner_parts AS (
  SELECT lang, list_slice(g, 1, size - 1) AS g, f FROM often WHERE size > 2 UNION ALL SELECT lang, list_slice(g, 2, size) AS g, f FROM often WHERE size > 2),
covered AS (SELECT lang, g, max(f) AS covering FROM inner_parts GROUP BY ALL),
c AS (SELECT often.* FROM often LEFT JOIN covered USING (lang, g) WHERE size > 1 AND (covering IS NULL OR 100 * covering < 100 * f)),
cuts AS (SELECT lang, g, size, f AS a, unnest(range(1, size)) AS k FROM c),
scored AS (
  SELECT c.lang, c.g, c.a, x.f AS l, y.f AS r, n.n, c.k, (c.a::HUGEINT * n.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, c.k) JOIN often y ON y.lang = c.lang AND y.g = list_slice(c.g, c.k + 1, c.size)
  JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

ORACLES["op13_embedding_near_dedup"] = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (
  SELECT r, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS x, b.r AS y FROM fine a JOIN fine b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT r AS x, r AS y FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
least AS (SELECT reach.x AS r, min(o.vec_id) AS component_id FROM reach JOIN v o ON o.r = reach.y GROUP BY reach.x),
n AS (SELECT x AS r, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least.component_id, v.vec_id IS NOT DISTINCT FROM least.component_id AS kept
FROM v LEFT JOIN n USING (r) JOIN least USING (r)
"""
