"""Registered queries of this package and, where SQL can express one, its DuckDB counterpart."""

from __future__ import annotations

from returnlens.llm import (
    chat,
    fingerprints,
    language,
    lines,
    mixing,
    near,
    neighbours,
    packing,
    quality,
    recurrent,
    variants,
    whitening,
    wrappers,
)

OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, 2.0 * source_size AS full_size, 2.0 * source_size / w AS ratio, row_number() OVER (ORDER BY 2.0 * source_size / w, source) AS i
  FROM sources),
levels AS (
  SELECT i, ratio, (1.5 * sum(source_size) OVER () - coalesce(sum(full_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ordered),
chosen AS (SELECT level FROM levels WHERE level <= ratio ORDER BY i LIMIT 1),
targets AS (
  SELECT source, source_size, least(w * (SELECT level FROM chosen), full_size) AS target,
         ('0x' || substr(md5('mix' || coalesce(':' || source, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM ordered),
placed AS (
  SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY sized.source ORDER BY size DESC, doc_id NULLS LAST) AS place
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       ((floor(place * rate + u) - floor((place - 1) * rate + u)) * size)::BIGINT AS taken
FROM placed
"""

QUERIES = {
    "op1_fingerprint_documents": fingerprints.op1_fingerprint_documents,
    "op9_score_language_model": recurrent.op9_score_language_model,
    "op10_near_duplicates": near.op10_near_duplicates,
    "op2_pack_sequences": packing.op2_pack_sequences,
    "op3_score_quality": quality.op3_score_quality,
    "op4_identify_language": language.op4_identify_language,
    "op5_rotate_perspectives": chat.op5_rotate_perspectives,
    "op6_nearest_neighbours": neighbours.op6_nearest_neighbours,
    "op7_dedup_lines": lines.op7_dedup_lines,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op11_whiten_embeddings": whitening.op11_whiten_embeddings,
    "op12_extract_pages": wrappers.op12_extract_pages,
    "op13_group_spellings": variants.op13_group_spellings,
}
ORACLE_SQL = {"op5_rotate_perspectives": chat.OP5_SQL, "op1_fingerprint_documents": fingerprints.OP1_SQL, "op8_mix_sources": OP8_SQL}
