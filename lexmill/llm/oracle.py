"""The subpackage's queries in DuckDB's SQL, where it can express them."""

from __future__ import annotations

#: The term bags: ``bag`` (doc_id, term, tf) and ``total`` (n).
BAG = """
valid AS (SELECT doc_id, term, max(coalesce(tf, 1)) AS tf FROM postings
          WHERE term IS NOT NULL AND doc_id IS NOT NULL AND length(term) > 2 AND NOT regexp_full_match(term, '[0-9]+')
          GROUP BY doc_id, term),
newest AS (SELECT doc_id, arg_max(processed_words, coalesce(ingested_at, TIMESTAMP '1970-01-01')) AS words FROM articles
           WHERE processed_words IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM valid) GROUP BY doc_id),
spread AS (SELECT doc_id, unnest(words) AS term FROM newest),
other AS (SELECT doc_id, term, count(*) AS tf FROM spread
          WHERE length(term) > 2 AND NOT regexp_full_match(term, '[0-9]+') GROUP BY doc_id, term),
bag AS (SELECT * FROM valid UNION ALL SELECT * FROM other),
total AS (SELECT count(DISTINCT doc_id) AS n FROM bag),
stats AS (SELECT term, sum(tf) AS occurrences, count(*) AS records FROM bag GROUP BY term)
"""

SQL: dict[str, str] = {
    "p1_found": """
WITH v AS (SELECT doc_id, term, max(CASE WHEN isnan(normalized_weight) THEN 0 ELSE coalesce(normalized_weight, 0) END)::DOUBLE AS w,
           max(CASE WHEN isnan(normalized_count) THEN 0 ELSE coalesce(normalized_count, 0) END)::DOUBLE AS c
           FROM term_document_info WHERE term IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id, term),
f AS (SELECT 'normalized_weight' AS field, doc_id, term, w AS x FROM v WHERE w <> 0
      UNION ALL SELECT 'normalized_count', doc_id, term, c FROM v WHERE c <> 0),
norms AS (SELECT field, doc_id, sum(x * x) AS m FROM f GROUP BY field, doc_id),
dots AS (SELECT a.field, a.doc_id AS d, b.doc_id AS o, sum(a.x * b.x) AS s
         FROM f a JOIN f b ON a.field = b.field AND a.term = b.term AND a.doc_id <> b.doc_id GROUP BY 1, 2, 3),
sims AS (SELECT dots.field, d, o, round(s / sqrt(p.m * q.m), 6) AS sim FROM dots
         JOIN norms p ON p.field = dots.field AND p.doc_id = d JOIN norms q ON q.field = dots.field AND q.doc_id = o),
ranked AS (SELECT *, row_number() OVER (PARTITION BY field, d ORDER BY sim DESC, o) AS r FROM sims WHERE sim >= 0.9)
SELECT DISTINCT field, least(d, o) AS doc_a, greatest(d, o) AS doc_b FROM ranked WHERE r <= 5""",
    "p2_found": f"""
WITH {BAG},
sizes AS (SELECT doc_id, count(*) AS n FROM bag GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c FROM bag a JOIN bag b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT doc_a, doc_b FROM pairs JOIN sizes p ON p.doc_id = doc_a JOIN sizes q ON q.doc_id = doc_b WHERE 10 * c >= 7 * (p.n + q.n - c)""",
    "p3_found": f"""
WITH {BAG},
scored AS (SELECT doc_id, term, round(tf * log10(n::DOUBLE / records), 9) AS score FROM bag JOIN stats USING (term), total),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS r FROM scored)
SELECT doc_id, term FROM ranked WHERE r <= 3""",
    "p3_divergence": f"""
WITH {BAG},
sizes AS (SELECT doc_id, sum(tf) AS size FROM bag GROUP BY doc_id),
normed AS (SELECT doc_id, term, tf * log2(1 + (SELECT avg(size) FROM sizes) / size) AS f, occurrences / n::DOUBLE AS l
           FROM bag JOIN stats USING (term) JOIN sizes USING (doc_id), total),
scored AS (SELECT doc_id, term, round((log2(1 + l) - f * log2(l / (1 + l))) / (f + 1), 6) AS score FROM normed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS r FROM scored)
SELECT doc_id, term, score FROM ranked WHERE r <= 10""",
    "p6_found": f"""
WITH {BAG},
marked AS (SELECT term, CASE WHEN records <= 2 THEN 'rare' WHEN records * 5 >= n THEN 'common' END AS mark FROM stats, total)
SELECT term, mark FROM marked WHERE mark IS NOT NULL""",
    "p6_frequencies": f"""
WITH {BAG}
SELECT term, occurrences::BIGINT AS occurrences, records,
       CASE WHEN records <= 2 THEN 'rare' WHEN records * 5 >= n THEN 'common' END AS mark FROM stats, total""",
    "p9_found": """
WITH cut AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
seen AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
a AS (SELECT DISTINCT id AS item_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 11)) AS i FROM cut)),
b AS (SELECT DISTINCT id AS doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 11)) AS i FROM seen))
SELECT DISTINCT doc_id, item_id FROM b JOIN a USING (g)""",
}
