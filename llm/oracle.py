"""SQL for the queries that SQL can express."""

SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages
        ), m AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND first > page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND first > page_id THEN first END AS refers_to
        FROM m
    """,
    "op13_ranked": """
        WITH d AS (
            SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS word FROM documents
        ), dw AS (
            SELECT doc_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
        ), q AS (
            SELECT item_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark
        ), qw AS (
            SELECT item_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS times
            FROM q GROUP BY ALL
        ), lengths AS (SELECT doc_id, count(*) AS n FROM dw GROUP BY doc_id),
        totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
        tfs AS (SELECT doc_id, term, count(*) AS tf FROM dw GROUP BY ALL),
        weights AS (
            SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
            FROM tfs, totals GROUP BY term, docs
        ), scored AS (
            SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
            FROM qw JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id), totals
            GROUP BY item_id, doc_id
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0
        QUALIFY rank <= 10
    """,
}
