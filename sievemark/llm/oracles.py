"""SQL for the operators whose results SQL can express."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower(e: str) -> str:
    return f"translate(coalesce({e}, ''), '{UPPER}', '{UPPER.lower()}')"


BENCHMARK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"



def finite(vector: str) -> str:
    """Condition: the vector is there and all its components are finite."""
    return f"{vector} IS NOT NULL AND len(list_filter({vector}, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def floored(vector: str, scale: int) -> str:
    return f"list_transform({vector}, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"


def mean_rounds(rounds: int) -> str:
    """Tables a0 .. a<rounds> (r, k, c, d): the nearest entry c of part k of row r at
    distance d, from v (r, k, i, x) and b0 (k, c, i, x), entries averaged in between."""
    steps = []
    for n in range(rounds + 1):
        if n:
            steps.append(f"""s{n} AS MATERIALIZED (
  SELECT k, c, i, sum(x)::HUGEINT AS s, count(*) AS n FROM v JOIN a{n - 1} USING (r, k) GROUP BY k, c, i),
b{n} AS MATERIALIZED (
  SELECT k, c, i, CASE WHEN n IS NULL THEN x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x
  FROM b{n - 1} LEFT JOIN s{n} USING (k, c, i))""")
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, k, c, d FROM (
    SELECT v.r, v.k, b.c, CAST(sum((v.x - b.x) * (v.x - b.x)) AS BIGINT) AS d
    FROM v JOIN b{n} AS b USING (k, i) GROUP BY v.r, v.k, b.c)
  QUALIFY row_number() OVER (PARTITION BY r, k ORDER BY d, c) = 1)""")
    return ",\n".join(steps)


ORACLES: dict[str, str] = {
    "op4_decontamination": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all({lower("text")}, '{BENCHMARK_WORD}') AS w
  FROM documents),
b AS (SELECT item_id, regexp_extract_all({lower("text")}, '{BENCHMARK_WORD}') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bs AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p FROM bs),
ds AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
       FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p FROM ds),
hit AS (SELECT r, n, i, item_id FROM dw JOIN bw USING (n, p)),
covered AS (SELECT r, count(DISTINCT k) AS n_hit
            FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
""",
    "op9_warc_writer": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM g
""",
    "op6_near_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({lower("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh
      FROM w),
s AS (SELECT DISTINCT doc_id, sh FROM u),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
      FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b
      WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
""",
    "op11_vector_codes": f"""
WITH p AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, {floored("embedding", 4096)} AS p
  FROM embeddings WHERE {finite("embedding")}),
e AS (SELECT r, p, unnest(range(len(p))) AS j FROM p),
v AS MATERIALIZED (SELECT r, j // (len(p) // 8) AS k, j % (len(p) // 8) AS i, p[j + 1] AS x FROM e),
b0 AS (SELECT k, r - 1 AS c, i, x FROM v WHERE r <= 16),
{mean_rounds(6)},
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY k, c, i)) AS codebooks_sha256 FROM b6),
f AS (SELECT r, string_agg(printf('%02x', CAST(c AS INTEGER)), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error
      FROM a6 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM f JOIN p USING (r), h
""",
    "op13_centroid_clusters": f"""
WITH p AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) AS r, vec_id, {floored("embedding", 1024)} AS p
  FROM embeddings WHERE {finite("embedding")} AND len(embedding) = 64),
v AS MATERIALIZED (SELECT r, 0 AS k, unnest(range(64)) AS i, unnest(p) AS x FROM p),
b0 AS (SELECT k, r - 1 AS c, i, x FROM v WHERE r <= 8),
{mean_rounds(10)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM b10 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance,
       CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a10 JOIN p USING (r) JOIN h USING (c)
""",
}
