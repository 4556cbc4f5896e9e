"""DuckDB SQL for the catalogue's queries, assembled from common table expressions that mirror the engine's stages."""

from __future__ import annotations

MARKS = "。，、；：？！“”‘’（）《》〈〉【】〔〕「」『』…—–·￥～〜"
CLASS = r"\s!-/:-@\[-`{-~\x{FE30}-\x{FE4F}" + MARKS


def normal(column: str) -> str:
    """N1 for text that NFKC leaves alone."""
    return f"lower(regexp_replace({column}, '[{CLASS}]', '', 'g'))"


def trim(column: str) -> str:
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


LINES = f"""
lines AS (
  SELECT doc_id, line_no, {trim("line")} AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
  WHERE {trim("line")} != ''),
celled AS (
  SELECT *, list_transform(string_split(regexp_replace(line, '^\\|+|\\|+$', '', 'g'), '|'), lambda c: {trim("c")}) AS cells FROM lines),
ruled AS (
  SELECT doc_id, line_no, line,
         CASE WHEN contains(line, '|') AND len(list_filter(cells, lambda c: c != '')) >= 2 THEN
           CASE WHEN len(list_filter(cells, lambda c: c != '' AND NOT regexp_full_match(c, '[-:]*'))) = 0 THEN '' ELSE array_to_string(cells, ' | ') END
         END AS row_text
  FROM celled)"""

CHUNKS = f"""{LINES},
chunks AS (
  SELECT doc_id, doc_id // 10 AS job_id, chunk_type, text, order_index, doc_id * 1000000 + order_index AS cid, length(text) AS char_count
  FROM (
    SELECT doc_id, chunk_type, text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS order_index
    FROM (SELECT doc_id, line_no, coalesce(row_text, line) AS text,
                 CASE WHEN row_text IS NOT NULL THEN 'table_row'
                      WHEN regexp_matches(line, '^([-*•·]\\s|[（(][0-9]{{1,3}}[)）]|[0-9]{{1,3}}[.、)）]([^0-9]|$))') THEN 'list_item' ELSE 'paragraph' END AS chunk_type
          FROM ruled WHERE row_text IS NULL OR row_text != '')
    WHERE length(text) >= 10))"""

FEATURES = f"""{CHUNKS},
feats AS MATERIALIZED (
  SELECT *, {normal("text")} AS normalized, list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2) AS tokens,
         CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN order_index / (count(*) OVER (PARTITION BY doc_id) - 1) ELSE 0.0 END AS rel_pos
  FROM chunks),
comp AS MATERIALIZED (SELECT *, sha256(normalized) AS normalized_hash FROM feats WHERE len(tokens) > 0)"""

GRAMS = f"""{FEATURES},
grams AS MATERIALIZED (
  SELECT DISTINCT job_id, doc_id, cid, gram FROM (
    SELECT job_id, doc_id, cid, unnest(list_concat(
      list_transform(range(1, greatest(length(normalized), 1)::BIGINT), lambda i: substring(normalized, i, 2)),
      list_transform(range(1, greatest(length(normalized) - 1, 1)::BIGINT), lambda i: substring(normalized, i, 3)))) AS gram
    FROM comp)),
sizes AS (SELECT job_id, cid, count(*) AS size FROM grams GROUP BY ALL),
counts AS (SELECT job_id, count(*) AS n FROM comp GROUP BY ALL),
stops AS (SELECT job_id, gram FROM (SELECT job_id, gram, count(*) AS df FROM grams GROUP BY ALL) JOIN counts USING (job_id) WHERE df > greatest(n // 10, 256)),
common AS MATERIALIZED (
  SELECT a.job_id, a.cid AS a, b.cid AS b, count(*) AS inter, count(*) FILTER (WHERE s.gram IS NULL) AS shared
  FROM grams a JOIN grams b ON a.job_id = b.job_id AND a.gram = b.gram AND a.cid < b.cid AND a.doc_id != b.doc_id
  LEFT JOIN stops s ON s.job_id = a.job_id AND s.gram = a.gram GROUP BY ALL),
overlap AS MATERIALIZED (
  SELECT c.*, inter / (sa.size + sb.size - inter) AS char_ngram
  FROM common c JOIN sizes sa ON sa.job_id = c.job_id AND sa.cid = c.a JOIN sizes sb ON sb.job_id = c.job_id AND sb.cid = c.b),
by_ngram AS (
  SELECT job_id, a, b FROM overlap WHERE shared >= 3
  QUALIFY row_number() OVER (PARTITION BY job_id, a ORDER BY round(char_ngram, 9) DESC, b) <= 100)"""

IDF = f"""{FEATURES},
jobs AS (SELECT job_id, count(*) AS n FROM comp GROUP BY ALL),
terms AS MATERIALIZED (SELECT job_id, cid, doc_id, token, count(*) AS tf FROM (SELECT job_id, cid, doc_id, unnest(tokens) AS token FROM comp) GROUP BY ALL),
idf AS (SELECT job_id, token, count(*) AS df, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM terms JOIN jobs USING (job_id) GROUP BY ALL),
raw AS (SELECT job_id, cid, doc_id, token, tf * idf AS w FROM terms JOIN idf USING (job_id, token)),
tfidf AS MATERIALIZED (SELECT job_id, cid, doc_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY job_id, cid)) AS w FROM raw)"""

_TFIDF_REST = """,
dots AS MATERIALIZED (
  SELECT a.job_id, a.cid AS a, b.cid AS b, sum(a.w * b.w) AS lexical
  FROM tfidf a JOIN tfidf b ON a.job_id = b.job_id AND a.token = b.token AND a.cid < b.cid AND a.doc_id != b.doc_id GROUP BY ALL),
by_tfidf AS (
  SELECT job_id, a, b FROM dots WHERE round(lexical, 9) >= 0.25
  QUALIFY row_number() OVER (PARTITION BY job_id, a ORDER BY round(lexical, 9) DESC, b) <= 100)"""

HASHED = """,
by_hash AS (
  SELECT a.job_id, a.cid AS a, b.cid AS b
  FROM comp a JOIN comp b ON a.job_id = b.job_id AND a.normalized_hash = b.normalized_hash AND a.cid < b.cid AND a.doc_id != b.doc_id)"""

RECALL = (
    GRAMS + IDF[len(FEATURES):] + _TFIDF_REST + HASHED
    + """,
candidates AS (SELECT job_id, a, b FROM by_hash UNION SELECT job_id, a, b FROM by_ngram UNION SELECT job_id, a, b FROM by_tfidf)"""
)
TFIDF = IDF + _TFIDF_REST

SCORED = (
    RECALL
    + """,
dims AS (
  SELECT c.job_id, c.a, c.b, least(greatest(coalesce(d.lexical, 0), 0), 1) AS lexical, coalesce(o.char_ngram, 0) AS char_ngram,
         1 - abs(x.rel_pos - y.rel_pos) AS order_score, x.char_count AS chars_a, y.char_count AS chars_b, x.doc_id AS doc_a, y.doc_id AS doc_b,
         x.chunk_type = 'table_row' AND y.chunk_type = 'table_row' AS both_rows
  FROM candidates c JOIN comp x ON x.job_id = c.job_id AND x.cid = c.a JOIN comp y ON y.job_id = c.job_id AND y.cid = c.b
  LEFT JOIN dots d ON d.job_id = c.job_id AND d.a = c.a AND d.b = c.b LEFT JOIN overlap o ON o.job_id = c.job_id AND o.a = c.a AND o.b = c.b),
scored AS MATERIALIZED (
  SELECT *, least(greatest((0.40 * lexical + 0.30 * char_ngram + 0.05 * order_score) / 0.75, 0), 1) AS final_score,
         CASE WHEN least(chars_a, chars_b) < 30 THEN 0.78 ELSE 0.7 END AS threshold
  FROM dims),
edges AS MATERIALIZED (SELECT * FROM scored WHERE final_score >= threshold),
best AS (SELECT job_id, cid, max(final_score) AS best FROM (
  SELECT job_id, a AS cid, final_score FROM scored UNION ALL SELECT job_id, b, final_score FROM scored) GROUP BY ALL)"""
)

COMPONENTS = "RECURSIVE" + SCORED + """,
links AS (SELECT job_id, a AS x, b AS y FROM edges UNION SELECT job_id, b, a FROM edges),
reach AS (SELECT DISTINCT job_id, x AS cid, x AS root FROM links UNION SELECT r.job_id, l.y, r.root FROM reach r JOIN links l ON l.job_id = r.job_id AND l.x = r.cid),
roots AS MATERIALIZED (SELECT job_id, cid, min(root) AS root FROM reach GROUP BY ALL),
strength AS (
  SELECT job_id, cid, sum(final_score) AS strength, max(final_score) AS score
  FROM (SELECT job_id, a AS cid, final_score FROM edges UNION ALL SELECT job_id, b, final_score FROM edges) GROUP BY ALL),
member AS MATERIALIZED (
  SELECT r.job_id, r.root, r.cid, c.doc_id, c.normalized_hash, c.rel_pos, c.text, c.char_count, s.score,
         CASE WHEN row_number() OVER (PARTITION BY r.job_id, r.root, c.doc_id ORDER BY s.strength DESC, r.cid) = 1 THEN 'primary' ELSE 'duplicate_candidate' END AS role
  FROM roots r JOIN comp c USING (job_id, cid) JOIN strength s USING (job_id, cid)),
cluster AS MATERIALIZED (
  SELECT r.job_id, r.root, avg(final_score) AS avg_score, max(final_score) AS peak, min(final_score) AS min_pair, avg(lexical) AS lex_avg
  FROM edges e JOIN roots r ON r.job_id = e.job_id AND r.cid = e.a GROUP BY ALL),
described AS MATERIALIZED (
  SELECT c.*, m.n_docs, m.n_members, CASE WHEN same_hash OR min_pair >= 0.95 THEN 'same' WHEN avg_score >= 0.85 THEN 'minor_change' WHEN avg_score >= 0.70 THEN 'changed' ELSE 'uncertain' END AS cluster_type,
         CASE WHEN same_hash OR min_pair >= 0.95 THEN 'low' WHEN avg_score >= 0.85 THEN 'low' WHEN avg_score >= 0.70 THEN 'medium' ELSE 'review' END AS severity
  FROM cluster c JOIN (SELECT job_id, root, count(DISTINCT doc_id) AS n_docs, count(*) AS n_members, count(DISTINCT normalized_hash) = 1 AS same_hash FROM member GROUP BY ALL) m USING (job_id, root)),
primary_member AS (SELECT * FROM member WHERE role = 'primary'),
doc_pairs AS (
  SELECT p.job_id, p.doc_id AS doc_a, q.doc_id AS doc_b,
         sum(coalesce(s.final_score, (0.40 * least(coalesce(d.lexical, 0), 1) + 0.30 * coalesce(o.char_ngram, 0) + 0.05 * (1 - abs(p.rel_pos - q.rel_pos))) / 0.75) * least(p.char_count, q.char_count)) AS common
  FROM primary_member p JOIN primary_member q ON p.job_id = q.job_id AND p.root = q.root AND p.doc_id < q.doc_id
  LEFT JOIN scored s ON s.job_id = p.job_id AND s.a = p.cid AND s.b = q.cid
  LEFT JOIN dots d ON d.job_id = p.job_id AND d.a = p.cid AND d.b = q.cid
  LEFT JOIN overlap o ON o.job_id = p.job_id AND o.a = p.cid AND o.b = q.cid
  GROUP BY ALL),
totals AS (SELECT job_id, doc_id, sum(char_count) AS total FROM comp GROUP BY ALL),
matrix AS MATERIALIZED (
  SELECT p.job_id, doc_a, doc_b, least(common / greatest(least(ta.total, tb.total), 1), 1.0) AS sim
  FROM doc_pairs p JOIN totals ta ON ta.job_id = p.job_id AND ta.doc_id = doc_a JOIN totals tb ON tb.job_id = p.job_id AND tb.doc_id = doc_b
  UNION ALL SELECT job_id, doc_id, doc_id, 1.0 FROM totals),
peaks AS (SELECT job_id, coalesce(max(sim) FILTER (WHERE doc_a != doc_b), 0) AS peak FROM matrix GROUP BY ALL),
shared AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n_docs DESC, length(term) DESC, term) AS rank
    FROM (SELECT job_id, term, count(DISTINCT doc_id) AS n_docs FROM (SELECT job_id, doc_id, unnest(tokens) AS term FROM comp) WHERE length(term) >= 4 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2))
  WHERE rank <= 30),
collusion AS (
  SELECT j.job_id, coalesce(peak, 0) AS peak,
         round(least(CASE WHEN coalesce(peak, 0) >= 0.6 THEN 0.4 * least((peak - 0.6) / 0.4, 1.0) ELSE 0 END
          + CASE WHEN coalesce(multi, 0) > 0 THEN 0.1 + 0.3 * least(multi / 5, 1.0) WHEN coalesce(clusters, 0) > 0 THEN 0.1 ELSE 0 END
          + CASE WHEN coalesce(flagged, 0) >= 2 THEN 0.25 ELSE 0 END + CASE WHEN coalesce(terms, 0) >= 5 THEN 0.1 ELSE 0 END, 1.0), 9) AS score
  FROM (SELECT DISTINCT job_id FROM comp) j LEFT JOIN peaks USING (job_id)
  LEFT JOIN (SELECT job_id, count(*) FILTER (WHERE n_docs >= 3) AS multi, count(*) AS clusters FROM described GROUP BY ALL) USING (job_id)
  LEFT JOIN (SELECT job_id, count(*) AS terms FROM shared GROUP BY ALL) USING (job_id)
  LEFT JOIN (SELECT job_id, count(*) AS flagged FROM (
    SELECT doc_id // 10 AS job_id, count(*) OVER (PARTITION BY doc_id // 10, trim(lang)) AS n FROM documents WHERE trim(lang) != '') WHERE n >= 2 GROUP BY ALL) USING (job_id))"""
