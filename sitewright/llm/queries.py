"""The queries of the training-text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, chunks, codes, langid, lines, mixing, neardup, ngramjoin, packing, quality, secrets, tokenstore, trie
from .common import documents

NEAR_WIDTH, NEAR_PERCENT = 3, 85
JOIN_WIDTH, JOIN_PERCENT = 3, 90


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(documents(spark, sf_dir))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), NEAR_WIDTH, NEAR_PERCENT)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(documents(spark, sf_dir))


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digest(documents(spark, sf_dir))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(documents(spark, sf_dir))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(documents(spark, sf_dir))


def op8_chunk_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeats(documents(spark, sf_dir))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.digest(documents(spark, sf_dir))


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_groups(documents(spark, sf_dir), JOIN_WIDTH, JOIN_PERCENT)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_secret_scan, op2_minhash_near_dedup, op3_quality_rules, op4_language_id, op5_mpeg_audio, op6_fuzzy_lines,
        op7_mix_sources, op8_chunk_repeats, op9_token_store, op10_pattern_packing, op11_prefix_trie, op12_ngram_join,
        op13_vector_codes,
    )
    return {f.__name__: f for f in every}


def _quality_sql() -> str:
    return r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows
), gaps AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM twice WHERE n > 1
), reps AS (
  SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS n FROM gaps GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
  FROM w LEFT JOIN reps USING (doc_id)
), f AS (
  SELECT *, CAST(
      (CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END) AS BIGINT) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed
FROM f
"""


def _trie_sql() -> str:
    return """
WITH RECURSIVE ids AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS t FROM conversations WHERE conv_id IS NOT NULL
), crc AS (  -- a bit a step
  SELECT conv_id, t, 0 AS step, CAST(4294967295 AS BIGINT) AS c FROM ids
  UNION ALL
  SELECT conv_id, t, step + 1,
         CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END
  FROM (SELECT conv_id, t, step,
               CASE WHEN step % 8 = 0 THEN xor(c, CAST(ascii(substr(t, step // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x
        FROM crc WHERE step < 8 * length(t)) s
), shared AS (
  SELECT conv_id, xor(c, CAST(4294967295 AS BIGINT)) % 9 AS h, conv_id - conv_id % 5 AS base FROM crc WHERE step = 8 * length(t)
), own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST,
                       sha256(concat(CAST(strlen(coalesce(role, '')) AS VARCHAR), ':', coalesce(role, ''), coalesce(text, '')))) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), whole AS (
  SELECT s.conv_id, list_concat(CASE WHEN b.ts IS NULL OR h = 0 THEN [] ELSE b.ts[1:h] END, o.ts[h + 1:]) AS ts
  FROM shared s JOIN own o ON o.conv_id = s.conv_id LEFT JOIN own b ON b.conv_id = s.base
), prefixes AS (
  SELECT conv_id, d, CASE WHEN d = 0 THEN [] ELSE ts[1:d] END AS p, d = len(ts) AS last
  FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM whole)
), nodes AS (
  SELECT d, p, count(*) AS n_convs, min(conv_id) AS conv_id,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM prefixes GROUP BY d, p
), parents AS (
  SELECT d - 1 AS d, CASE WHEN d = 1 THEN [] ELSE p[1:d - 1] END AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2
), sized AS (
  SELECT nodes.d, nodes.p, nodes.conv_id, n_convs, ends_sha256, coalesce(parents.n, 0) AS n_children,
         CASE WHEN parents.n IS NULL THEN 1 ELSE 0 END AS leaf,
         CASE WHEN nodes.d = 0 THEN 0 ELSE (n_convs - 1) * strlen(nodes.p[nodes.d].text) END AS saved
  FROM nodes LEFT JOIN parents ON nodes.d = parents.d AND nodes.p = parents.p
), sums AS (
  SELECT i AS d, CASE WHEN i = 0 THEN [] ELSE p[1:i] END AS p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT p, leaf, saved, unnest(range(0, d + 1)) AS i FROM sized) GROUP BY 1, 2
)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(a.n_convs AS BIGINT) AS n_convs,
       CAST(a.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM sized a JOIN sums ON a.d = sums.d AND a.p = sums.p
LEFT JOIN nodes up ON a.d > 0 AND up.d = a.d - 1 AND up.p = CASE WHEN a.d = 1 THEN [] ELSE a.p[1:a.d - 1] END
"""


def _join_sql() -> str:
    return r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS i FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT s.doc_id, s.g FROM s JOIN (SELECT g FROM s GROUP BY g HAVING count(*) > 1) USING (g)
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shared a JOIN shared b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), linked AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)
), reach AS (
  SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(least_b, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS least_b FROM reach GROUP BY a) r ON r.a = w.doc_id
"""


def _codes_sql() -> str:
    distance = "list_sum(list_transform(range(1, len(xs) + 1), lambda i: (xs[i] - ys[i]) * (xs[i] - ys[i])))"

    def nearest(book: str) -> str:
        return f"""(SELECT vec_id, part, entry, d FROM (
    SELECT p.vec_id, p.part, entry, {distance} AS d, row_number() OVER (PARTITION BY p.vec_id, p.part ORDER BY {distance}, entry) AS r
    FROM parts p JOIN {book} b ON p.part = b.part) WHERE r = 1)"""

    steps = []
    for r in range(codes.ROUNDS):
        steps.append(f"""a{r} AS MATERIALIZED {nearest(f"c{r}")}, m{r} AS MATERIALIZED (
  SELECT part, entry, i, CAST(floor_div AS BIGINT) AS y FROM (
    SELECT part, entry, i, (t - ((t % n) + n) % n) // n AS floor_div FROM (
      SELECT a.part, a.entry, i, sum(xs[i]) AS t, count(*) AS n
      FROM a{r} a JOIN (SELECT vec_id, part, xs, unnest(range(1, len(xs) + 1)) AS i FROM parts) p ON a.vec_id = p.vec_id AND a.part = p.part
      GROUP BY 1, 2, 3))
), c{r + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(u.ys, c.ys) AS ys
  FROM c{r} c LEFT JOIN (SELECT part, entry, list(y ORDER BY i) AS ys FROM m{r} GROUP BY 1, 2) u ON c.part = u.part AND c.entry = u.entry
)""")
    last = f"c{codes.ROUNDS}"
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {codes.SCALE}) AS BIGINT)) AS xs
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, k AS part, xs[k * (len(xs) // {codes.PARTS}) + 1:(k + 1) * (len(xs) // {codes.PARTS})] AS xs
  FROM (SELECT vec_id, xs, unnest(range(0, {codes.PARTS})) AS k FROM v)
), c0 AS MATERIALIZED (
  SELECT part, entry, xs AS ys FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v) USING (vec_id) WHERE entry < {codes.ENTRIES}
), {", ".join(steps)}, final AS MATERIALIZED {nearest(last)}, rows_of AS (
  SELECT vec_id, string_agg(lpad(printf('%x', entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM final GROUP BY vec_id
), book AS (
  SELECT sha256(string_agg(array_to_string(ys, ','), ',' ORDER BY part, entry)) AS h FROM {last}
)
SELECT r.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM rows_of r JOIN v ON r.vec_id = v.vec_id, book
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": _quality_sql(), "op11_prefix_trie": _trie_sql(), "op12_ngram_join": _join_sql(), "op13_vector_codes": _codes_sql()}
