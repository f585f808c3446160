"""Check SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"



def _lloyd(clusters: int = 40, rounds: int = 5) -> str:
    """Rounds of exact integer clustering, written out one after the other."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
        assigned{n} AS MATERIALIZED (
            SELECT rid, cluster, CAST(sum((v - m) * (v - m)) AS BIGINT) AS distance
            FROM components JOIN centroids{n} USING (dim) GROUP BY rid, cluster
            QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1
        )""")
        if n < rounds:
            steps.append(f"""
        centroids{n + 1} AS MATERIALIZED (
            SELECT c.cluster, c.dim, coalesce((s - ((s % n) + n) % n) // n, c.m) AS m
            FROM centroids{n} c LEFT JOIN (
                SELECT cluster, dim, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
                FROM assigned{n} JOIN components USING (rid) GROUP BY cluster, dim
            ) moved USING (cluster, dim)
        )""")
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, row_number() OVER () AS rid,
                   list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE len(embedding) = 64
              AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(CAST(e AS DOUBLE)))) = 0
        ), components AS MATERIALIZED (
            SELECT rid, unnest(x) AS v, unnest(range(64)) AS dim FROM kept
        ), firsts AS (
            SELECT x, row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS cluster FROM kept
            WHERE vec_id IS NOT NULL
        ), centroids0 AS MATERIALIZED (
            SELECT CAST(cluster AS INTEGER) AS cluster, unnest(x) AS m, unnest(range(64)) AS dim
            FROM firsts WHERE cluster < {clusters}
        ), {", ".join(steps)}, digests AS (
            SELECT cluster, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256
            FROM centroids{rounds} GROUP BY cluster
        )
        SELECT vec_id, cluster, distance,
               CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM assigned{rounds} JOIN kept USING (rid) JOIN digests USING (cluster)
    """


#: CRC-32 of a text's UTF-8 bytes, by the reflected polynomial's eight steps for each byte.
_CRC_STEP = "lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC = f"""
    xor(4294967295, list_reduce(
        list_transform(range(octet_length(encode(feature))), lambda i: CAST('0x' || substr(hex(encode(feature)), 2 * i + 1, 2) AS BIGINT)),
        lambda crc, byte: xor(crc >> 8, crcs[(xor(crc, byte) & 255) + 1]), 4294967295))
"""
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_FEATURES = "list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"

_RESAMPLING = f"""
    WITH docs AS MATERIALIZED (
        SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS words FROM documents
    ), source AS MATERIALIZED (
        SELECT rid, unnest({_FEATURES}) AS feature FROM docs
    ), target AS MATERIALIZED (
        SELECT unnest({_FEATURES}) AS feature FROM (SELECT {_WORDS} AS words FROM benchmark)
    ), crc AS MATERIALIZED (
        SELECT list(list_reduce(range(8), {_CRC_STEP}, CAST(i AS BIGINT)) ORDER BY i) AS crcs FROM range(256) t(i)
    ), buckets AS MATERIALIZED (
        SELECT feature, {_CRC} % 10000 AS bucket
        FROM (SELECT feature FROM source UNION SELECT feature FROM target), crc
    ), s AS (
        SELECT bucket, count(*) AS s FROM source JOIN buckets USING (feature) GROUP BY bucket
    ), t AS (
        SELECT bucket, count(*) AS t FROM target JOIN buckets USING (feature) GROUP BY bucket
    ), gains AS MATERIALIZED (
        SELECT b.bucket, CAST(floor(1000 * ln(
            CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM source) + 10000 AS DOUBLE)
            / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM target) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
        FROM (SELECT DISTINCT bucket FROM buckets) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
    ), sums AS (
        SELECT rid, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total
        FROM source JOIN buckets USING (feature) JOIN gains USING (bucket) GROUP BY rid
    ), hashed AS (
        SELECT rid, doc_id, len(words) AS n_words, coalesce(n, 0) AS n_features,
               coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
               CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
        FROM docs LEFT JOIN sums USING (rid)
    ), scored AS (
        SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM hashed
    ), ordered AS (
        SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank
        FROM scored WHERE n_words >= 20
    )
    SELECT doc_id, n_features, weight, score,
           CASE WHEN rank <= 25 * (SELECT count(*) FROM ordered) // 100 THEN rank END AS rank
    FROM scored LEFT JOIN ordered USING (rid)
"""

ORACLES = {
    "op4_exact_dedup": f"""
        WITH texts AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS body FROM documents
        ), grouped AS (
            SELECT doc_id, sha256(body) AS text_sha256,
                   min(doc_id) OVER (PARTITION BY body) AS keep_id,
                   count(*) OVER (PARTITION BY body) AS group_size
            FROM texts
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped
    """,
    "op7_warc": """
        WITH payloads AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), measured AS (
            SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM payloads
        ), first AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM measured
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
        FROM first
    """,
    "op11_centroid_clustering": _lloyd(),
    "op13_importance_resampling": _RESAMPLING,
}
