"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_WORD = r"'[0-9a-z\x{80}-\x{10FFFF}]+'"

ORACLE_SQL = {
    "op2_substrings": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
      win AS (SELECT doc_id, j, array_to_string(w[j:j + 19], ' ') AS k FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS j)),
      gone AS (SELECT doc_id, j FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, j) > 1),
      cover AS (SELECT DISTINCT doc_id, unnest(range(j, j + 20)) AS p FROM gone),
      pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
      kept AS (SELECT pos.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos.p) AS t FROM pos LEFT JOIN cover ON cover.doc_id = pos.doc_id AND cover.p = pos.p WHERE cover.p IS NULL GROUP BY 1)
      SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_decontaminate": f"""WITH b AS (SELECT item_id, regexp_extract_all({_AZ}, {_WORD}) AS w FROM benchmark),
      win AS (SELECT CAST(item_id AS VARCHAR) AS item, i, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) WHERE len(w) > 0),
      d AS (SELECT doc_id, regexp_extract_all({_AZ}, {_WORD}) AS w FROM documents),
      spot AS (SELECT doc_id, j, k, array_to_string(w[j:j + k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM win), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS j)),
      hit AS (SELECT doc_id, j, i, spot.k, item FROM spot JOIN win ON spot.k = win.k AND spot.g = win.g),
      runs AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, k + count(*) - 1 AS n FROM (SELECT *, j - i AS diagonal, j - row_number() OVER (PARTITION BY doc_id, item, k, j - i ORDER BY j) AS r FROM hit) GROUP BY doc_id, item, k, diagonal, r) GROUP BY 1),
      cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM hit) GROUP BY 1),
      items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
      SELECT d.doc_id, len(w) AS n_words, coalesce(cover.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, cover.n IS NOT NULL AS contaminated, coalesce(runs.n, 0) AS longest
      FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_jaccard": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_AZ}, {_SPACED}) AS w FROM documents),
      s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) END AS s FROM d),
      t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
      pair AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
      reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a)
      SELECT s.doc_id, len(s) AS n_shingles, least_id AS component_id FROM s JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY 1) USING (doc_id)""",
}
