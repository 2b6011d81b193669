"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

OP2 = """
WITH vectors AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
cells AS (SELECT own, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors),
scores AS (
  SELECT q.own AS q_own, c.own AS c_own, q.vec_id AS query_id, c.vec_id AS vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM cells q JOIN cells c ON q.i = c.i AND q.own <> c.own
  WHERE q.vec_id % 50 = 0
  GROUP BY ALL),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY q_own ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP7 = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')), 1, 15))::BIGINT AS h
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
turn AS (
  SELECT source, source_size, 2 * source_size AS cap,
         [3, 1, 2][((row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM per),
levels AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE
              - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free
  FROM turn),
targets AS (
  SELECT source, source_size, greatest(least(cap::DOUBLE, max(remaining::DOUBLE / free) OVER () * w), 0.0) AS target FROM levels),
based AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base
  FROM targets),
sums AS (
  SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS cum, sum(size) AS words
  FROM sized GROUP BY source, h)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (d.size * (b.base + CASE
          WHEN s.cum <= b.target - b.base * b.source_size THEN 1
          WHEN s.cum - s.words <= b.target - b.base * b.source_size
               AND 2 * (b.target - b.base * b.source_size - (s.cum - s.words)) >= s.words THEN 1
          ELSE 0 END))::BIGINT AS taken
FROM sized d
JOIN based b ON d.source IS NOT DISTINCT FROM b.source
JOIN sums s ON d.source IS NOT DISTINCT FROM s.source AND d.h = s.h
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_bitsliced_topk": OP2, "op7_mix_sources": OP7}
