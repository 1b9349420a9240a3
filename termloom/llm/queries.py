"""One query per operator, over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.llm import (
    conversation_trie,
    decontaminate,
    language_id,
    language_model,
    mixing,
    near_duplicates,
    packing,
    pii,
    quality_classifier,
    rules,
    substring_dedup,
    toxicity,
    vector_codes,
)
from termloom.llm.registry import query, read

_STOP = ", ".join(f"'{w}'" for s in sorted(set(rules.STOP_WORDS)) for w in (s, s.capitalize()))

RULES_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), tok AS (
  SELECT doc_id, pos, w,
         w || chr(1) || lead(w, 1) OVER o || chr(1) || lead(w, 2) OVER o || chr(1) ||
         lead(w, 3) OVER o || chr(1) || lead(w, 4) OVER o AS win
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS pos FROM d)
  WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), rep AS (
  SELECT doc_id, pos, win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 AS again
  FROM tok
), cov AS (
  SELECT doc_id, max(again::INT) OVER (PARTITION BY doc_id ORDER BY pos
                                      ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit
  FROM rep
), r AS (SELECT doc_id, sum(hit) AS n FROM cov GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), s AS (
  SELECT doc_id, count(*) AS n_stop FROM tok WHERE w IN ({_STOP}) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(n_stop, 0) AS n_stop
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    concat_ws(',',
      CASE WHEN n_words < 10 THEN 'length' END,
      CASE WHEN n_repeat_words > 0.2::DOUBLE * greatest(n_words, 1) THEN 'repeats' END,
      CASE WHEN word_chars < 2 * greatest(n_words, 1) OR word_chars > 15 * greatest(n_words, 1)
           THEN 'word_length' END,
      CASE WHEN n_symbols::DOUBLE / greatest(word_chars, 1) > 0.25::DOUBLE THEN 'symbols' END,
      CASE WHEN n_dup_lines::DOUBLE / greatest(n_lines, 1) > 0.5::DOUBLE THEN 'lines' END,
      CASE WHEN n_words >= 100 AND n_stop::DOUBLE / n_words < 0.02::DOUBLE THEN 'stop_words' END) AS failed_rules
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM f
"""


@query("op10_quality_rules", RULES_SQL)
def _op10(spark, folder):
    return rules.apply_rules(read(spark, folder, "documents"))


LEAKS_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), starts AS (
  SELECT item_id, ws, least(10, len(ws)) AS size,
         unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i
  FROM b WHERE len(ws) > 0
), win AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS key
  FROM starts
), sizes AS (SELECT DISTINCT size FROM win
), tok AS (
  SELECT doc_id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS pos FROM d
), grown AS (
  SELECT doc_id, pos, size,
         CASE WHEN count(*) OVER o = size THEN string_agg(w, ' ') OVER o END AS key
  FROM tok CROSS JOIN (SELECT 10 AS size)
  WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)
), small AS (
  SELECT d.doc_id, s.size, unnest(generate_series(1, len(ws) - s.size + 1)) AS pos, ws
  FROM d, sizes s WHERE s.size < 10 AND len(ws) >= s.size
), cand AS (
  SELECT doc_id, pos, size, key FROM grown WHERE key IS NOT NULL
  UNION ALL
  SELECT doc_id, pos, size, array_to_string(list_slice(ws, pos, pos + size - 1), ' ') FROM small
), hits AS (
  SELECT c.doc_id, c.pos, c.size, w.item_id FROM cand c JOIN win w ON c.key = w.key AND c.size = w.size
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(pos, pos + size - 1)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op5_decontaminate", LEAKS_SQL)
def _op5(spark, folder):
    return decontaminate.contamination(
        read(spark, folder, "documents"), read(spark, folder, "benchmark")
    )


NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, least(i + 4, len(ws))), ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM d WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS node FROM d
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON r.node = e.a
), least_node AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least_node USING (doc_id)
"""


@query("op9_near_duplicates", NEAR_SQL)
def _op9(spark, folder):
    return near_duplicates.near_duplicates(read(spark, folder, "documents"))


@query("op1_language_id")
def _op1(spark, folder):
    docs = read(spark, folder, "documents")
    model = language_id.fit(docs.filter(language_id.fold("doc_id", 4) != 2))
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        F.col("row.doc_id").alias("doc_id"),
        (language_id.fold("row.doc_id", 4) == 2).alias("held_out"),
        "lang_pred", "score", "cross_entropy", "rejected",
    )


_LEADS = " || ' ' || ".join(f"lead(w, {i}) OVER o" for i in range(1, 13))

REPEATS_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), tok AS (
  SELECT doc_id, pos, w, w || ' ' || {_LEADS} AS win
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS pos FROM d)
  WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), own AS (
  SELECT win, min(doc_id) AS least FROM tok WHERE win IS NOT NULL
  GROUP BY win HAVING min(doc_id) < max(doc_id)
), marked AS (
  SELECT tok.doc_id, pos, w, coalesce(least < tok.doc_id, FALSE)::INT AS gone
  FROM tok LEFT JOIN own ON tok.win = own.win
), cut AS (
  SELECT doc_id, pos, w, max(gone) OVER (PARTITION BY doc_id ORDER BY pos
                                         ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS cut
  FROM marked
), kept AS (
  SELECT doc_id, sum(cut) AS n_removed, string_agg(w, ' ' ORDER BY pos) FILTER (WHERE cut = 0) AS t
  FROM cut GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op4_substring_dedup", REPEATS_SQL)
def _op4(spark, folder):
    return substring_dedup.remove_repeats(read(spark, folder, "documents"))


@query("op2_language_model")
def _op2(spark, folder):
    docs = read(spark, folder, "documents")
    held = language_id.fold("doc_id", 7) == 2
    return language_model.score_documents(docs.select("doc_id", "text", held.alias("held_out")))


def _judged(operator, spark, folder, label, held, limit):
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    model = operator.fit(docs.filter(~held("doc_id")), labels.filter(~held("doc_id")), label)
    return operator.score(docs, model).select(
        "doc_id",
        held("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
    )


@query("op3_quality_classifier")
def _op3(spark, folder):
    held = lambda id: language_id.fold(id, 4) == 2
    return _judged(quality_classifier, spark, folder, "quality", held, 0.7)


@query("op6_toxicity")
def _op6(spark, folder):
    held = lambda id: language_id.fold(id, 5) == 0
    return _judged(toxicity, spark, folder, "toxic", held, 0.5)


@query("op8_personal_data")
def _op8(spark, folder):
    docs = read(spark, folder, "documents")
    return pii.find(docs, *pii.fit(docs))


@query("op7_best_fit_packing")
def _op7(spark, folder):
    return packing.pack(read(spark, folder, "documents"))


def _codes_sql(rounds: int) -> str:
    """Lloyd rounds written out one after the other."""
    far = "list_sum(list_transform(list_zip(p.part, c.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        r"""
v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT vec_id, label, j, list_slice(e, j * len(e) // 16 + 1, (j + 1) * len(e) // 16) AS part
  FROM v, (SELECT unnest(range(16)) AS j)
), c0 AS (
  SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS k, part
  FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)
)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS (
  SELECT vec_id, any_value(label) AS label, p.j, min({far} * 64 + c.k) AS best
  FROM p JOIN c{r} c ON p.j = c.j GROUP BY vec_id, p.j
)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT j, k, list(x ORDER BY i) AS part FROM (
    SELECT j, k, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x
    FROM (SELECT p.j, a.best % 64 AS k, unnest(p.part) AS x, unnest(range(1, len(p.part) + 1)) AS i
          FROM p JOIN a{r} a ON p.vec_id = a.vec_id AND p.j = a.j)
    GROUP BY j, k, i)
  GROUP BY j, k
), c{r + 1} AS (
  SELECT c.j, c.k, coalesce(m.part, c.part) AS part
  FROM c{r} c LEFT JOIN m{r} m ON c.j = m.j AND c.k = m.k
)""")
    return f"""
WITH {",".join(steps)}, books AS (
  SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY j, k)) AS sha FROM c{rounds}
), coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', best % 64), '' ORDER BY j) AS code,
         sum(best // 64)::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha FROM books) AS codebooks_sha256
FROM coded
"""


@query("op11_vector_codes", _codes_sql(vector_codes.ROUNDS))
def _op11(spark, folder):
    return vector_codes.compress(read(spark, folder, "embeddings"))


@query("op12_mix_sources")
def _op12(spark, folder):
    return mixing.mix(read(spark, folder, "documents"))


TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS of,
         xor(4294967295, list_reduce(
           list_prepend(4294967295, flatten(list_transform(
             string_split(conv_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda acc, x: CASE WHEN xor(acc, x) & 1 = 1 THEN xor(xor(acc, x) >> 1, 3988292384)
                               ELSE xor(acc, x) >> 1 END)) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, role, text, row_number() OVER (PARTITION BY c.conv_id ORDER BY own, pos) AS depth
  FROM (
    SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.of AND t.pos <= c.h
    UNION ALL
    SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
  ) x JOIN c ON x.conv_id = c.conv_id
), p AS (
  SELECT conv_id, depth, strlen(text) AS bytes,
         md5(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER o) AS key
  FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY depth)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), l AS (SELECT conv_id, max(depth) AS len FROM p GROUP BY conv_id
), n AS (
  SELECT key, any_value(depth) AS depth, any_value(bytes) AS bytes, min(p.conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE depth = len) AS ends
  FROM p JOIN l ON p.conv_id = l.conv_id GROUP BY key
), up AS (
  SELECT DISTINCT a.key, b.key AS parent FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.depth = a.depth - 1
), kids AS (SELECT parent AS key, count(*) AS n_children FROM up GROUP BY parent
), below AS (SELECT DISTINCT b.key AS top, a.key FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth >= b.depth
), sums AS (
  SELECT top, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM below JOIN n ON below.key = n.key LEFT JOIN kids ON kids.key = n.key GROUP BY top
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs,
       coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved::BIGINT AS saved_tokens,
       sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN sums ON sums.top = n.key LEFT JOIN kids ON kids.key = n.key
LEFT JOIN up ON up.key = n.key LEFT JOIN n u ON u.key = up.parent
"""


@query("op13_prefix_trie", TRIE_SQL)
def _op13(spark, folder):
    own = conversation_trie.paths(read(spark, folder, "conversations"))
    trie = conversation_trie.prefix_trie(conversation_trie.with_common_heads(own))
    return conversation_trie.with_digest(*trie)
