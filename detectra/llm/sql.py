"""The same results in DuckDB SQL, for tables that one machine holds."""

from __future__ import annotations

UPPER, LOWER, BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ALNUM, SPACED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"


def lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


EXACT = f"""
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, {lowered("text")} AS t FROM documents) WINDOW w AS (PARTITION BY t)"""

DECONTAMINATE = f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({lowered("text")}, '{ALNUM}') AS w FROM documents),
    i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({lowered("text")}, '{ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL),
    starts AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0),
    iw AS (SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS t FROM starts),
    dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
    hit AS (SELECT doc_id, dw.n, s, item FROM dw JOIN iw ON dw.n = iw.n AND dw.t = iw.t),
    h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, n, s FROM hit)) GROUP BY doc_id),
    g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN g ON d.doc_id = g.doc_id"""

SUBSTRING = f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
    x AS (SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
    f AS (SELECT t, min(doc_id) AS first FROM x GROUP BY t HAVING count(*) > 1),
    c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM x JOIN f ON x.t = f.t WHERE first < doc_id),
    g AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id),
    v AS (SELECT u.doc_id, u.p, w[u.p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) u ANTI JOIN c ON c.doc_id = u.doc_id AND c.p = u.p),
    j AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM v GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN j ON d.doc_id = j.doc_id"""

NEAR = f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lowered("text")}, '{SPACED}') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    z AS (SELECT s.doc_id, t, n FROM s JOIN n ON s.doc_id = n.doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS n, count(*) AS c FROM z a JOIN z b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL),
    l AS (SELECT x, y FROM p WHERE 100 * c >= 80 * (n - c)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.y, root FROM r JOIN e ON r.doc_id = e.x)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM d JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) m ON d.doc_id = m.doc_id LEFT JOIN n ON d.doc_id = n.doc_id"""

#: A SHA-1's 40 hexadecimal digits are eight fives, each of four base-32 digits.
WARC = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
    b AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS best, list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)) AS parts FROM p)
    SELECT page_id, payload_bytes, array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('{BASE32}', CAST((v >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
           CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM b"""


def clustering_sql(rounds: int = 5, k: int = 40, dim: int = 64) -> str:
    """Lloyd's rounds, unrolled, with lists as vectors; for small tables."""
    apart = f"list_sum(list_transform(range(1, {dim + 1}), lambda j: (e.x[j] - c.x[j]) * (e.x[j] - c.x[j])))"
    parts = [
        f"e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM e ORDER BY h, x LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT e.r, min([CAST({apart} AS BIGINT), c.k]) AS b FROM e, c{i} c GROUP BY e.r)")
        if i < rounds:
            mean = f"SELECT b[2] AS k, j, CAST(floor(CAST(sum(x[j]) AS DOUBLE) / count(*)) AS BIGINT) AS f FROM a{i} JOIN e USING (r), (SELECT range AS j FROM range(1, {dim + 1})) GROUP BY b[2], j"
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(s.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT k, list(f ORDER BY j) AS x FROM ({mean}) GROUP BY k) s ON c.k = s.k)")
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(b[2] AS INTEGER) AS cluster, b[1] AS distance, CAST(sum(b[1]) OVER (PARTITION BY b[2]) AS BIGINT) AS cluster_inertia,
        CAST(sum(b[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN e USING (r) JOIN c{rounds} c ON c.k = b[2]"""
