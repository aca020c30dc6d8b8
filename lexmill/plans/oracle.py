"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from lexmill.functions.codec import fibonacci_numbers
from lexmill.functions.text import LOWER, SPACED, UPPER
from lexmill.operators.index import keywords
from lexmill.plans.queries import STEMMED_QUERY

NORMALIZED = (
    f"regexp_replace(translate(text, '{UPPER}{SPACED}' || chr(10), '{LOWER}{' ' * (len(SPACED) + 1)}'), '[^a-z0-9 ]', '', 'g')"
)
TERM = "length({0}) > 2 AND NOT regexp_full_match({0}, '[0-9]+')"
WORDS = f"""words AS (SELECT doc_id, word FROM (SELECT doc_id, unnest(string_split({NORMALIZED}, ' ')) AS word
          FROM documents WHERE text IS NOT NULL) WHERE word <> '')"""
POSTINGS = f"{WORDS}, postings_ AS (SELECT DISTINCT doc_id, word AS term FROM words WHERE {TERM.format('word')})"
MODEL = f"""{POSTINGS}, total AS (SELECT count(*)::DOUBLE AS n FROM documents),
stats AS (SELECT term, count(*) AS df, log10((SELECT n FROM total) / count(*)) AS idf FROM postings_ GROUP BY term),
weighed AS (SELECT doc_id, term, idf AS weight FROM postings_ JOIN stats USING (term)),
sums AS (SELECT doc_id, count(*)::DOUBLE AS tf2, sum(weight * weight) AS w2 FROM weighed GROUP BY doc_id),
model AS (SELECT doc_id, term, weight, 1 / tf2 AS norm_tf, weight / nullif(w2, 0) AS norm_weight FROM weighed JOIN sums USING (doc_id))"""
PAIRS = f"""{MODEL}, pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.norm_tf * b.norm_tf) AS tf_sim,
sum(a.norm_weight * b.norm_weight) AS tfidf_sim FROM model a JOIN model b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2)"""
KMEANS = f"""{POSTINGS}, sizes AS (SELECT doc_id, 1.0::DOUBLE / count(*) AS v FROM postings_ GROUP BY doc_id),
vectors AS (SELECT doc_id, term, v FROM postings_ JOIN sizes USING (doc_id)),
seeds AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS cluster FROM documents ORDER BY doc_id LIMIT 5),
met AS (SELECT v.doc_id, s.cluster, round(sum(v.v * c.v), 12) AS sim FROM vectors v JOIN vectors c USING (term)
        JOIN seeds s ON s.doc_id = c.doc_id GROUP BY 1, 2),
best AS (SELECT doc_id, cluster, sim FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, cluster) AS r FROM met) WHERE r = 1),
assigned AS (SELECT doc_id, coalesce(cluster, 0)::INTEGER AS cluster FROM documents LEFT JOIN best USING (doc_id)),
members AS (SELECT cluster, count(*) AS size FROM assigned GROUP BY cluster),
means AS (SELECT cluster, term, sum(v) / any_value(size) AS c FROM vectors JOIN assigned USING (doc_id) JOIN members USING (cluster) GROUP BY cluster, term)"""
STEMMED = "'" + "', '".join(sorted(set(keywords(STEMMED_QUERY)))) + "'"
ARTICLES = f"""newest AS (SELECT doc_id, arg_max(processed_words, coalesce(ingested_at, TIMESTAMP '1970-01-01')) AS w FROM articles
                WHERE processed_words IS NOT NULL GROUP BY doc_id),
spread AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM newest), postings_ AS (SELECT * FROM spread WHERE {TERM.format('term')}),
docs AS (SELECT DISTINCT doc_id FROM articles WHERE doc_id IS NOT NULL), total AS (SELECT count(*)::DOUBLE AS n FROM docs),
stats AS (SELECT term, log10((SELECT n FROM total) / count(*)) AS idf FROM postings_ GROUP BY term),
weighed AS (SELECT doc_id, term, idf AS weight FROM postings_ JOIN stats USING (term)),
sums AS (SELECT doc_id, sum(weight * weight) AS w2 FROM weighed GROUP BY doc_id),
hits AS (SELECT doc_id, sum(weight / w2 / sqrt({len(keywords(STEMMED_QUERY))}::DOUBLE)) AS score FROM weighed JOIN sums USING (doc_id)
         WHERE term IN ({STEMMED}) AND w2 > 0 GROUP BY doc_id)"""
NESTED = f"{POSTINGS}, nested AS (SELECT term, list_sort(list(doc_id)) AS ids FROM postings_ GROUP BY term)"
SGML = """latest AS (SELECT path, line_no, arg_max(line, ingested_at) AS line FROM sgml_lines GROUP BY path, line_no),
numbered AS (SELECT *, coalesce(sum(CASE WHEN starts_with(line, '</REUTERS>') THEN 1 ELSE 0 END)
             OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS article FROM latest),
spans AS (SELECT path, article, max(line_no) FILTER (WHERE starts_with(line, '<REUTERS ')) AS a,
          max(line_no) FILTER (WHERE starts_with(line, '</REUTERS>')) AS b FROM numbered GROUP BY path, article),
rows_ AS (SELECT n.* FROM numbered n JOIN spans s ON n.path = s.path AND n.article = s.article AND line_no BETWEEN a AND b)"""


_numbers = ", ".join(f"{x}::BIGINT" for x in reversed(fibonacci_numbers()))
ENCODED = f"""RECURSIVE numbers AS (SELECT [{_numbers}] AS f),
fold AS (SELECT doc_id, 1 AS i, (doc_id + 1)::BIGINT AS rest, '' AS bits FROM documents UNION ALL
SELECT doc_id, i + 1, CASE WHEN rest >= f[i] THEN rest - f[i] ELSE rest END,
CASE WHEN rest >= f[i] THEN '1' || bits WHEN bits = '' THEN '' ELSE '0' || bits END FROM fold, numbers WHERE i <= 50)"""

SQL: dict[str, str] = {
    "normalize_text": f"SELECT doc_id, {NORMALIZED} AS normalized FROM documents",
    "tokenize_terms": f"""
WITH split AS (SELECT doc_id, list_filter(string_split({NORMALIZED}, ' '), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(len(list_filter(w, lambda t: {TERM.format('t')})), 0) AS n_terms FROM split""",
    "stopword_filter": f"WITH {WORDS} SELECT word, count(*) AS n FROM words WHERE word NOT IN (SELECT word FROM stop_words) GROUP BY word",
    "process_articles_stored": """
SELECT doc_id, any_value(processed_text) AS processed FROM articles
WHERE text_lines IS NOT NULL AND processed_text IS NOT NULL GROUP BY doc_id""",
    "processed_words": """
SELECT doc_id, array_to_string(any_value(processed_words), ' ') AS words FROM articles WHERE processed_text IS NOT NULL GROUP BY doc_id""",
    "term_frequency": f"WITH {WORDS} SELECT doc_id, word AS term, count(*) AS tf FROM words WHERE {TERM.format('word')} GROUP BY doc_id, word",
    "inverted_index": f"WITH {NESTED} SELECT term, term || ':' || array_to_string(ids, ',') || ',' AS line FROM nested",
    "document_frequency_idf": f"WITH {MODEL} SELECT term, df, round(idf, 9) AS idf FROM stats",
    "vector_model": f"""
WITH {MODEL} SELECT doc_id, term, round(weight, 9) AS weight, round(norm_tf, 9) AS norm_tf, round(norm_weight, 9) AS norm_weight FROM model""",
    "boolean_and_query": f"""
WITH {POSTINGS} SELECT doc_id FROM postings_ WHERE term IN ('market', 'october') GROUP BY doc_id HAVING count(*) = 2""",
    "ranked_query_top10": f"""
WITH {MODEL}, hits AS (SELECT doc_id, sum(norm_weight / sqrt(3::DOUBLE)) AS score FROM model WHERE term IN ('market', 'october', 'wheat') GROUP BY doc_id),
scored AS (SELECT doc_id, round(coalesce(score, 0), 9) AS score FROM documents LEFT JOIN hits USING (doc_id))
SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 10""",
    "most_similar_document": f"""
WITH {PAIRS}, both_ AS (SELECT a, b, round(tf_sim, 12) AS t, round(tfidf_sim, 12) AS w FROM pairs
UNION ALL SELECT b, a, round(tf_sim, 12), round(tfidf_sim, 12) FROM pairs),
t1 AS (SELECT a, b, t FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY t DESC, b) AS r FROM both_ WHERE t > 0) WHERE r = 1),
w1 AS (SELECT a, b, w FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS r FROM both_ WHERE w > 0) WHERE r = 1)
SELECT doc_id, coalesce(t1.b, -1) AS tf_doc, coalesce(t, 0) AS tf_sim, coalesce(w1.b, -1) AS tfidf_doc, coalesce(w, 0) AS tfidf_sim
FROM documents LEFT JOIN t1 ON t1.a = doc_id LEFT JOIN w1 ON w1.a = doc_id""",
    "article_boolean_query": f"""
WITH {ARTICLES} SELECT doc_id FROM postings_ WHERE term IN ({STEMMED}) GROUP BY doc_id HAVING count(*) = {len(set(keywords(STEMMED_QUERY)))}""",
    "article_ranked_query": f"""
WITH {ARTICLES}, scored AS (SELECT doc_id, round(coalesce(score, 0), 9) AS score FROM docs LEFT JOIN hits USING (doc_id))
SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 10""",
    "text_index_round_trip": f"WITH {POSTINGS} SELECT doc_id, term, 1::BIGINT AS tf FROM postings_",
    "similarity_matrix": f"""
WITH {PAIRS} SELECT a, b, round(tf_sim, 12) AS sim FROM pairs UNION ALL SELECT b, a, round(tf_sim, 12) FROM pairs""",
    "common_documents": f"""
WITH {POSTINGS} SELECT doc_id FROM postings_ WHERE term IN ('market', 'october') GROUP BY doc_id HAVING count(*) = 2""",
    "similarity_pairs": f"WITH {PAIRS} SELECT a, b, round(tf_sim, 12) AS tf_sim, round(tfidf_sim, 6) AS tfidf_sim FROM pairs",
    "kmeans_assign_iter1": f"WITH {KMEANS} SELECT doc_id, cluster FROM assigned",
    "kmeans_centroids_iter1": f"WITH {KMEANS} SELECT cluster, term, round(c, 9) AS c FROM means",
    "kmeans_quality_iter1": f"""
WITH {KMEANS}, own AS (SELECT cluster, sum(v * c) AS s FROM vectors JOIN assigned USING (doc_id) JOIN means USING (cluster, term) GROUP BY cluster)
SELECT round(sum(coalesce(s, 0) / size) / 5, 9) AS quality FROM members LEFT JOIN own USING (cluster)""",
    "delta_encode": f"""
WITH {NESTED} SELECT term, array_to_string(list_transform(range(1, len(ids) + 1), lambda i: ids[i] - coalesce(ids[i - 1], 0)), ',') AS deltas FROM nested""",
    "delta_decode": f"WITH {NESTED} SELECT term, array_to_string(ids, ',') AS ids FROM nested",
    "fibonacci_encode": f"WITH {ENCODED} SELECT doc_id, bits || '1' AS code FROM fold WHERE i = 51",
    "fibonacci_decode": "SELECT doc_id, doc_id * 1009 + 1 AS value FROM documents",
    "compressed_index": f"""
WITH {NESTED} SELECT term, len(ids)::INTEGER AS n, array_to_string(list_transform(ids, lambda x: x + 1), ',') AS ids FROM nested""",
    "find_all_occurrences": """
WITH found AS (SELECT doc_id, list_filter(range(0, length(text) - 2), lambda i: substr(text, i + 1, 3) = 'ana') AS p FROM documents WHERE contains(text, 'ana'))
SELECT doc_id, array_to_string(p, ',') AS places FROM found""",
    "count_occurrences": """
SELECT doc_id, len(list_filter(range(0, length(text) - 2), lambda i: substr(text, i + 1, 3) = 'ana'))::INTEGER AS n FROM documents WHERE text IS NOT NULL""",
    "approximate_match": f"""
WITH {POSTINGS}, d AS (SELECT DISTINCT term, levenshtein('market', term) AS e FROM postings_)
SELECT term, e <= 2 AS accepted, (CASE WHEN e <= 2 THEN e ELSE -1 END)::INTEGER AS errors FROM d""",
    "regex_match": f"WITH {POSTINGS} SELECT DISTINCT term FROM postings_ WHERE regexp_full_match(term, 'oil|gas*|coffee')",
    "embedding_distance": """
WITH f AS (SELECT embedding::DOUBLE[] AS o FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], o), 6) AS dot, round(list_distance(embedding::DOUBLE[], o), 6) AS distance FROM embeddings, f""",
    "sgml_articles": f"""
WITH {SGML} SELECT path, article, min(line_no) AS first_line, max(line_no) AS last_line FROM rows_ GROUP BY path, article""",
    "sgml_text_lines": f"""
WITH {SGML}, marks AS (SELECT *, CASE WHEN starts_with(line, '<REUTERS ') THEN 0 WHEN starts_with(line, '<TEXT') THEN 1
WHEN contains(line, '</TEXT>') THEN 0 END AS m FROM rows_),
flags AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY path, article ORDER BY line_no) AS state FROM marks)
SELECT path, article, line_no, line FROM flags WHERE state = 1 AND m IS NULL""",
    "sgml_document_ids": f"""
WITH {SGML}, closed AS (SELECT path, article FROM rows_ WHERE starts_with(line, '</REUTERS>')),
counts AS (SELECT path, max(article) + 1 AS n FROM closed GROUP BY path),
offsets AS (SELECT path, coalesce(sum(n) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM counts)
SELECT path, article, (article + o + 1)::BIGINT AS doc_id FROM closed JOIN offsets USING (path)""",
}
