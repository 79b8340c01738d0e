"""DuckDB SQL that the registered queries must equal."""

CONTENT_SORT = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

SOURCE_SCHEDULE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS goal,
    row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k,
    coalesce(sum(2 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
    sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM s
), level AS (
  SELECT (goal - capped) / free AS level FROM r WHERE w * ((goal - capped) / free) <= 2 * source_size ORDER BY k LIMIT 1
), g AS (
  SELECT source, source_size, least(w * level, (2 * source_size)::DOUBLE) AS target,
    least(2 * source_size, CAST(floor(least(w * level, (2 * source_size)::DOUBLE) + 0.5) AS BIGINT)) AS words
  FROM s, level
), e AS (
  SELECT d.doc_id, d.size, g.source, g.words, epoch, sum(d.size) OVER (PARTITION BY g.source ORDER BY epoch, md5(epoch || '-' || coalesce(CAST(d.doc_id AS VARCHAR), 'null'))
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source, (VALUES (0), (1)) AS x(epoch)
), t AS (
  SELECT doc_id, CAST(sum(greatest(0, least(upto, words) - (upto - size))) AS BIGINT) AS taken FROM e GROUP BY doc_id
)
SELECT d.doc_id, d.size, g.source_size, g.target, t.taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN t ON t.doc_id IS NOT DISTINCT FROM d.doc_id
"""

LINE_HASH_INDEX = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (
  SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, coalesce(often.owner <> doc_id, false) AS gone FROM keyed LEFT JOIN often ON keyed.k = often.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
