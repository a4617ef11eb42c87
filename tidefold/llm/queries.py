"""Registry of the training-data queries and their SQL."""

from __future__ import annotations

from tidefold.llm.edit_embedding import op6_edit_fingerprint
from tidefold.llm.jaccard import op5_jaccard_join
from tidefold.llm.lines import op9_line_dedup
from tidefold.llm.mixing import op10_source_mix
from tidefold.llm.neighbours import op8_nearest_neighbours
from tidefold.llm.packing import op4_best_fit_packing
from tidefold.llm.ppm import op2_ppm_score
from tidefold.llm.secrets import op1_secret_scan
from tidefold.llm.suffixes import op7_repeated_passages
from tidefold.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_edit_fingerprint": op6_edit_fingerprint,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_line_dedup": op9_line_dedup,
    "op10_source_mix": op10_source_mix,
    "op2_ppm_score": op2_ppm_score,
    "op3_toxicity": op3_toxicity,
    "op4_best_fit_packing": op4_best_fit_packing,
}

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: SQL for the queries that it can express as a whole; the others hold a learned model, a tokenizer, seeded hashes or floating-point sums and are tested against brute force or held-out rows.
ORACLE: dict[str, str] = {
    "op5_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, md5(unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g FROM d),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
 edge AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
 reach AS (SELECT DISTINCT x AS doc_id, x AS other FROM edge UNION SELECT r.doc_id, b.y FROM reach r JOIN edge b ON b.x = r.other),
 low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.component_id, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)""",
    "op7_repeated_passages": f"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h, {_WORDS.format("coalesce(text, '')")} AS v FROM documents),
 sized AS (SELECT *, length(h) // 2 AS n FROM t),
 w AS MATERIALIZED (SELECT r, i, md5(b[i + 1:i + 400]::VARCHAR) AS k FROM (SELECT r, b, unnest(range(0, n - 399)) AS i FROM sized)),
 hit AS (SELECT r, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
 isle AS (SELECT r, i, sum(CASE WHEN i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM hit)),
 span AS (SELECT r, min(i) AS low, max(i) + 400 AS high FROM isle GROUP BY r, g),
 piece AS (SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS before FROM span),
 cut AS (SELECT r, sum(high - low) AS n_removed, count(*) AS n_spans, max(high) AS last, string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS head FROM piece JOIN sized USING (r) GROUP BY r),
 pw AS MATERIALIZED (SELECT r, i, md5(array_to_string(v[i:i + 49], ' ')) AS k FROM (SELECT r, v, unnest(range(1, len(v) - 48)) AS i FROM sized)),
 shared AS (SELECT r, i FROM pw JOIN (SELECT k FROM pw GROUP BY k HAVING count(DISTINCT r) > 1) USING (k)),
 covered AS (SELECT r, count(DISTINCT j) AS n_shared_words FROM (SELECT r, unnest(range(i, i + 50)) AS j FROM shared) GROUP BY r)
 SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
 sha256(CASE WHEN last IS NULL THEN b ELSE unhex(head || substr(h, 2 * last + 1)) END) AS kept_sha256, coalesce(n_shared_words, 0)::BIGINT AS n_shared_words
 FROM sized LEFT JOIN cut USING (r) LEFT JOIN covered USING (r)""",
}
