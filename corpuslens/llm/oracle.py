"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations


def _centroid_clustering(k: int = 16, rounds: int = 3) -> str:
    """Every vector with every centroid; one common table a round."""
    steps = ["""
        v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
              FROM embeddings
              WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= 2097152)) = 0)""", f"""
        c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS INTEGER) AS c, q
               FROM v QUALIFY c < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
        n{i} AS (SELECT r, min({{'d': d, 'c': c}}) AS b FROM (
                   SELECT v.r, m.c, CAST(list_sum(list_transform(list_zip(v.q, m.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
                   FROM v CROSS JOIN c{i} m) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
        c{i + 1} AS (SELECT m.c, coalesce(u.q, m.q) AS q FROM c{i} m LEFT JOIN (
                   SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS q FROM (
                     SELECT c, j, sum(q[j]) AS s, count(*) AS n FROM (
                       SELECT b.c AS c, q, unnest(generate_series(1, 64)) AS j FROM n{i} JOIN v USING (r)) GROUP BY c, j) GROUP BY c) u USING (c))""")
    return f"""
        WITH {','.join(steps)}
        SELECT v.vec_id, b.c AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.q, ',')) AS centroid_sha256
        FROM n{rounds} JOIN v USING (r) JOIN c{rounds} m ON m.c = b.c
    """


SQL = {
    "op4_exact_dedup": """
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(coalesce(d.text, '')) AS text_sha256
        FROM documents d
        JOIN (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) g
          ON coalesce(d.text, '') = g.t
    """,
    "op13_centroid_clustering": _centroid_clustering(),
}
