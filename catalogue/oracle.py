"""SQL for the registered queries, written for DuckDB over the same tables.

Each text starts from the raw tables: the common table expressions below
derive the observability tables anew, then the query states the semantics in
the plainest way (lateral top-1, literal joins), not in the way Spark runs it.
"""

from __future__ import annotations

from catalogue.queries import COMPARE_AT, OFFSET_DRAW, READ_SINCE, READ_UNTIL, SAMPLE_SEED


def hx(e: str) -> str:
    return f"lpad(lower(to_hex(CAST({e} AS BIGINT))), 16, '0')"


def tid(e: str) -> str:
    return f"reverse({hx(e)})"


ZERO = "0" * 16
K = "CAST(props->>'$.k' AS BIGINT)"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, *needs: str):
    def add(sql: str) -> None:
        CTES[name] = (needs, sql)

    return add


cte("ev")(f"""
  SELECT event_id, ts, user_id, event_type, {K} AS k, CAST(round(value * 100) AS BIGINT) AS cents,
    CASE WHEN user_id % 10 = 9 THEN '$ internal-job' ELSE 'app' || (user_id % 3) END AS app_name,
    {hx('256 + user_id % 16')} AS tfp, {hx(f'4096 + (user_id % 16) * 4 + {K} % 4')} AS sfp,
    CASE WHEN {K} % 20 = 3 THEN 'other' ELSE 'schedules' END AS database_name
  FROM events""")
cte("latest")("SELECT max(ts) AS ts FROM events")
cte("clock", "latest")("SELECT ts - INTERVAL 12 HOUR AS now FROM latest")


def contention(b: int, w: int) -> str:
    return f"""
  SELECT ts AS collection_ts, {tid('event_id + 1')} AS blocking_txn_id,
    CASE WHEN event_id % {b} = 0 THEN '{ZERO}' ELSE {hx('256 + k % 16')} END AS blocking_txn_fingerprint_id,
    {tid('event_id')} AS waiting_txn_id,
    CASE WHEN event_id % {w} = 0 THEN '{ZERO}' ELSE tfp END AS waiting_txn_fingerprint_id,
    cents * 1000 AS contention_duration,
    lower(hex('/k/' || (k % 5))) AS contending_key,
    '/Table/' || (100 + k % 5) || '/1/"' || user_id || '"/0' AS contending_pretty_key,
    {hx('event_id')} AS waiting_stmt_id, sfp AS waiting_stmt_fingerprint_id, database_name,
    CASE WHEN k % 4 = 3 THEN 'archive' ELSE 'public' END AS schema_name, 't' || (k % 4) AS table_name,
    CASE WHEN k % 3 = 0 THEN NULL ELSE 'idx_' || (k % 3) END AS index_name,
    CASE WHEN k % 2 = 0 THEN 'LOCK_WAIT' ELSE 'SERIALIZATION_CONFLICT' END AS contention_type
  FROM ev WHERE event_type IN ('error', 'click')"""


cte("contention", "ev")(contention(10, 15))
cte("contention_later", "ev")(contention(20, 30))
cte("insights", "ev")(f"""
  SELECT 's' || user_id AS session_id, {tid('event_id')} AS txn_id, tfp AS txn_fingerprint_id,
    {hx('event_id')} AS stmt_id, sfp AS stmt_fingerprint_id,
    CASE WHEN event_type = 'error' THEN 'FailedExecution' ELSE 'SlowExecution' END AS problem,
    CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'HighContention' ELSE 'HighContention|HighRetryCount' END AS causes,
    CASE WHEN k % 25 = 0 THEN 'SELECT _' WHEN k % 25 = 1 THEN 'SHOW _' ELSE 'UPDATE t' || (k % 4) || ' SET a = _' END AS query,
    CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Completed' END AS status, ts AS start_time,
    ts + INTERVAL 1500 MILLISECOND AS end_time, 'u' || (user_id % 5) AS user_name, 'g' || (k % 9) AS plan_gist,
    CASE WHEN k % 2 = 0 THEN 'normal' ELSE 'high' END AS priority, (k % 3) || '|' || (k % 5) AS exec_node_ids, (k % 2) || '' AS kv_node_ids,
    CASE WHEN k % 5 = 1 THEN 'creation : CREATE INDEX ON t1 (a)' ELSE '' END AS index_recommendations, k % 2 = 0 AS implicit_txn,
    CASE WHEN k % 9 > 0 THEN k * 1000 END AS cpu_sql_nanos, CASE WHEN k % 8 = 0 THEN 'tag=' || (k % 3) END AS query_tags,
    k % 5 = 0 AS full_scan, app_name, database_name, k AS rows_read, k % 7 AS rows_written, k % 4 AS retries,
    CASE WHEN k % 4 > 0 THEN 'retry' END AS last_retry_reason,
    CASE WHEN k % 6 > 0 THEN cents * 1000 END AS contention,
    CASE WHEN event_type = 'error' THEN '40001' END AS error_code,
    CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'WriteTooOldError: x' ELSE 'TransactionRetryError: x' END END
      AS last_error_redactable
  FROM ev WHERE event_type IN ('error', 'purchase', 'view')""")


def stmt_stats(half: bool) -> str:
    where = "WHERE minute(ts) < 30" if half else ""
    return f"""
  SELECT aggregated_ts, {hx('4096 + t * 4 + q')} AS fingerprint_id, {hx('256 + t')} AS transaction_fingerprint_id,
    {hx('p')} AS plan_hash, app_name,
    '{{"db": "' || CASE WHEN t = 15 THEN 'system' ELSE 'schedules' END || '", "fullScan": ' ||
      CASE WHEN fs THEN 'true' ELSE 'false' END || ', "query": "' || query || '", "querySummary": "stmt on t' || q || '"}}' AS metadata,
    '{{"execution_statistics": {{"cnt": ' || cnt * 30 || ', "contentionTime": {{"mean": ' || rw // cnt ||
      '}}}}, "statistics": {{"cnt": ' || cnt || ', "failureCount": ' || fails || ', "runLat": {{"mean": ' || lat // cnt ||
      '}}, "svcLat": {{"mean": ' || (2 * lat) // cnt || '}}, "rowsRead": {{"mean": ' || rr // cnt ||
      '}}, "rowsWritten": {{"mean": ' || rw // cnt || '}}}}}}' AS statistics,
    CASE WHEN p = 1 THEN '{{"Name": "scan", "rows": ' || cnt || '}}' END AS sampled_plan, CAST({1800000000 if half else 3600000000} AS BIGINT) AS aggregation_interval,
    CASE q WHEN 0 THEN ['creation : CREATE INDEX ON schedules.public.t0 (a)', 'creation : CREATE INDEX ON public.t0 (b)']
      WHEN 1 THEN ['creation : CREATE INDEX ON t1 (a)'] WHEN 2 THEN ['no target named'] ELSE CAST([] AS VARCHAR[]) END AS recs,
    query, CASE WHEN t = 15 THEN 'system' ELSE 'schedules' END AS db, fs AS full_scan, cnt, cnt * 30 AS sampled, fails,
    lat // cnt AS run_mean, (2 * lat) // cnt AS svc_mean, rr // cnt AS read_mean, rw // cnt AS written_mean
  FROM (SELECT *, CASE q WHEN 0 THEN 'SELECT a FROM t0' WHEN 1 THEN 'UPDATE t1 SET a = _'
          WHEN 2 THEN 'INSERT INTO public.t2 VALUES (_)' ELSE 'DELETE FROM schedules.public.t3' END AS query
        FROM (SELECT date_trunc('hour', ts) AS aggregated_ts, user_id % 16 AS t, k % 4 AS q, k % 2 AS p, app_name,
                count(*) AS cnt, CAST(sum(cents) AS BIGINT) AS lat, CAST(sum(k) AS BIGINT) AS rr,
                CAST(sum(k % 7) AS BIGINT) AS rw, count(*) FILTER (event_type = 'error') AS fails, bool_or(k % 5 = 0) AS fs
              FROM ev {where} GROUP BY 1, 2, 3, 4, 5))"""


def txn_stats(half: bool) -> str:
    where = "WHERE minute(ts) < 30" if half else ""
    ids = " || '\", \"' || ".join(hx(f"4096 + t * 4 + {i}") for i in range(3))
    return f"""
  SELECT aggregated_ts, {hx('256 + t')} AS fingerprint_id, app_name,
    '{{"stmtFingerprintIDs": ["' || {ids} || '"]}}' AS metadata, '{{"statistics": {{"cnt": ' || cnt || '}}}}' AS statistics,
    CAST({1800000000 if half else 3600000000} AS BIGINT) AS aggregation_interval, cnt
  FROM (SELECT date_trunc('hour', ts) AS aggregated_ts, user_id % 16 AS t, app_name, count(*) AS cnt
        FROM ev {where} GROUP BY 1, 2, 3)"""


cte("stmt_stats", "ev")(stmt_stats(False))
cte("stmt_half", "ev")(stmt_stats(True))
cte("txn_stats", "ev")(txn_stats(False))
cte("txn_half", "ev")(txn_stats(True))
cte("runs")("""
  SELECT 'run_' || strftime(d, '%Y%m%d') AS test_run, CASE WHEN day(d) % 10 = 0 THEN 'other' ELSE 'schedules' END AS database_name,
    d + INTERVAL 30 MINUTE AS start_time, d + INTERVAL 23 HOUR AS end_time, CAST(4200000000 AS BIGINT) AS agg_grace_interval,
    d + INTERVAL 23 HOUR + INTERVAL 70 MINUTE AS closes
  FROM (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS d FROM events)""")
cte("state")("""
  SELECT 'run_' || strftime(d, '%Y%m%d') AS test_run, stream,
    CASE WHEN day(d) % 3 = 0 THEN d + INTERVAL 1 DAY + INTERVAL 10 MINUTE ELSE max(ts) END AS watermark_ts,
    max(ts) + INTERVAL 5 SECOND AS updated_at
  FROM (SELECT ts, date_trunc('day', ts)::TIMESTAMP AS d, event_type FROM events) e
  JOIN (VALUES ('contention'), ('insights'), ('stmt_stats'), ('txn_stats')) s(stream)
    ON CASE stream WHEN 'contention' THEN event_type IN ('error', 'click')
                   WHEN 'insights' THEN event_type IN ('error', 'purchase', 'view') ELSE true END
  WHERE day(d) % 5 <> 1 GROUP BY d, stream""")
cte("streams")("SELECT * FROM (VALUES ('contention'), ('insights'), ('stmt_stats'), ('txn_stats')) s(stream)")
cte("due", "runs", "state", "clock", "streams")("""
  SELECT * FROM (
    SELECT r.test_run, x.stream, r.database_name, coalesce(s.watermark_ts, r.start_time) AS from_ts,
      least(coalesce(s.watermark_ts, r.start_time) + INTERVAL 30 SECOND, now - INTERVAL 5 SECOND,
            CASE WHEN x.stream IN ('stmt_stats', 'txn_stats') THEN closes ELSE end_time END) AS to_ts,
      least(now - INTERVAL 5 SECOND,
            CASE WHEN x.stream IN ('stmt_stats', 'txn_stats') THEN closes ELSE end_time END) AS all_ts
    FROM runs r CROSS JOIN streams x CROSS JOIN clock LEFT JOIN state s ON s.test_run = r.test_run AND s.stream = x.stream)""")

# the tables after ingesting whole runs
cte("p_contention", "contention", "runs")("""
  SELECT r.test_run, c.* FROM contention c JOIN runs r
    ON c.database_name = r.database_name AND c.collection_ts >= r.start_time AND c.collection_ts < r.end_time""")
cte("t_insights", "insights", "runs")("""
  SELECT r.test_run, i.* FROM insights i JOIN runs r
    ON i.database_name = r.database_name AND i.start_time >= r.start_time AND i.start_time < r.end_time
  WHERE i.query <> 'SELECT _'""")
cte("p_insights", "t_insights")("""
  SELECT * FROM t_insights QUALIFY row_number() OVER (
    PARTITION BY test_run, txn_fingerprint_id, stmt_fingerprint_id, status, app_name, coalesce(last_error_redactable, '<<NULL>>')
    ORDER BY start_time, stmt_id, txn_id) = 1""")
cte("p_map", "t_insights")("""
  SELECT test_run, txn_id, min(txn_fingerprint_id) AS txn_fingerprint_id FROM t_insights GROUP BY 1, 2""")
for _name, _src in (("p_stmt", "stmt_stats"), ("p_stmt_half", "stmt_half"), ("p_txn", "txn_stats"), ("p_txn_half", "txn_half")):
    cte(_name, _src, "runs")(f"""
  SELECT r.test_run, s.* FROM {_src} s JOIN runs r ON s.aggregated_ts >= r.start_time AND s.aggregated_ts < r.closes""")

CONTENTION = (
    "collection_ts, blocking_txn_id, blocking_txn_fingerprint_id, waiting_txn_id, waiting_txn_fingerprint_id, "
    "contention_duration, contending_pretty_key, waiting_stmt_id, waiting_stmt_fingerprint_id, database_name, "
    "schema_name, table_name, index_name, contention_type"
)
STMT = (
    "aggregated_ts, fingerprint_id, transaction_fingerprint_id, plan_hash, app_name, metadata, statistics, "
    "sampled_plan, aggregation_interval, array_to_string(recs, '|') AS index_recommendations"
)

# root cause
_prefix = f"substring({tid('event_id')}, 1, 8)"
cte("exceptions", "ev")(f"""
  SELECT event_id AS exception_id,
    'Error occurred: restart transaction: TransactionRetryWithProtoRefreshError: ' ||
    CASE WHEN event_id % 7 = 0 THEN 'ReadWithinUncertaintyIntervalError' WHEN k % 2 = 0 THEN 'WriteTooOldError' ELSE 'TransactionRetryError' END ||
    ': write for key too old' ||
    CASE WHEN event_id % 2 = 0 THEN ' conflicting txn: meta={{id=' || {_prefix} || ' key=/Table/' || (100 + k % 5) || '/1/\\"' || user_id ||
      '\\"/0 iso=Serializable ts=' || CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) || '.000000000,1 seq=1}}' ELSE '' END ||
    ': "sql txn" meta={{id=' || {_prefix} || ' seq=1}} lock=true' AS exception_str,
    'run_' || strftime(ts, '%Y%m%d') AS test_run, CASE WHEN event_id % 4 < 3 THEN NULL ELSE app_name END AS in_app,
    CASE WHEN event_id % 5 = 0 THEN 'public' END AS in_schema,
    CASE event_id % 3 WHEN 0 THEN 'same_app' WHEN 1 THEN 'diff_app' ELSE 'any_app' END AS option
  FROM ev WHERE event_type = 'error'""")
cte("parsed", "exceptions")(r"""
  SELECT *, nullif(regexp_extract(exception_str, 'TransactionRetryWithProtoRefreshError:\s*([A-Za-z_()]+):', 1), '') AS retry_error_type,
    regexp_replace(nullif(regexp_extract(exception_str, 'conflicting txn: meta=\{[^}]*key=([^ ]+)', 1), ''), '\\(["\\])', '\1', 'g') AS contention_key,
    make_timestamp(CAST(CAST(nullif(regexp_extract(exception_str, 'conflicting txn: meta=\{[^}]*ts=([0-9]+\.[0-9]+)', 1), '') AS DECIMAL(20,6)) * 1000000 AS BIGINT)) AS conflict_ts,
    lower(nullif(regexp_extract(exception_str, '(?:"|\\")sql txn(?:"|\\") meta=\{id=([0-9A-Fa-f]+)', 1), '')) AS txn_id_prefix
  FROM exceptions""")
cte("stage1", "parsed", "p_contention", "p_insights")("""
  SELECT x.exception_id, c.collection_ts, c.blocking_txn_fingerprint_id, c.waiting_txn_fingerprint_id, c.database_name,
    coalesce(i.app_name, x.in_app) AS app_name, c.schema_name, c.table_name, c.index_name, c.contention_type,
    coalesce(i.stmt_fingerprint_id, c.waiting_stmt_fingerprint_id) AS stmt_fingerprint_id
  FROM parsed x JOIN p_contention c
    ON c.test_run = x.test_run AND c.contending_pretty_key = x.contention_key AND starts_with(c.waiting_txn_id, x.txn_id_prefix)
   AND c.collection_ts BETWEEN x.conflict_ts AND x.conflict_ts + INTERVAL 60 SECOND
   AND (x.in_schema IS NULL OR c.schema_name = x.in_schema)
  LEFT JOIN p_insights i ON i.test_run = c.test_run AND i.txn_fingerprint_id = c.waiting_txn_fingerprint_id
   AND i.stmt_fingerprint_id = c.waiting_stmt_fingerprint_id
  QUALIFY row_number() OVER (PARTITION BY x.exception_id ORDER BY c.collection_ts, c.waiting_txn_id, c.blocking_txn_id,
    i.start_time, i.stmt_id, i.app_name) = 1""")
_by_map = """
  SELECT x.exception_id, i.start_time AS collection_ts, CAST(NULL AS VARCHAR) AS blocking_txn_fingerprint_id,
    i.txn_fingerprint_id AS waiting_txn_fingerprint_id, i.database_name, i.app_name, x.in_schema AS schema_name,
    CAST(NULL AS VARCHAR) AS table_name, CAST(NULL AS VARCHAR) AS index_name, CAST(NULL AS VARCHAR) AS contention_type,
    i.stmt_fingerprint_id
  FROM parsed x JOIN p_map m ON m.test_run = x.test_run AND starts_with(m.txn_id, x.txn_id_prefix)
  JOIN p_insights i ON i.test_run = m.test_run AND i.txn_fingerprint_id = m.txn_fingerprint_id
  WHERE {where} AND (x.in_app IS NULL OR i.app_name = x.in_app)
  QUALIFY row_number() OVER (PARTITION BY x.exception_id ORDER BY i.start_time {dir}, i.txn_fingerprint_id,
    i.stmt_fingerprint_id, i.app_name, i.database_name) = 1"""
cte("stage2", "parsed", "p_map", "p_insights")(
    _by_map.format(where="i.status = 'Failed' AND i.last_error_redactable LIKE '%' || x.retry_error_type || '%'", dir="ASC")
)
cte("stage3", "parsed", "p_map", "p_insights")(_by_map.format(where="i.query NOT LIKE 'SHOW%'", dir="DESC"))
cte("failed", "stage1", "stage2", "stage3")("""
  SELECT *, 1 AS stage FROM stage1
  UNION ALL SELECT *, 2 FROM stage2 WHERE exception_id NOT IN (SELECT exception_id FROM stage1)
  UNION ALL SELECT *, 3 FROM stage3 WHERE exception_id NOT IN (SELECT exception_id FROM stage1)
    AND exception_id NOT IN (SELECT exception_id FROM stage2)""")
cte("picked", "failed", "exceptions", "p_txn")("""
  SELECT * FROM (
    SELECT f.exception_id, x.test_run AS in_test_run, t.test_run, t.fingerprint_id, t.app_name, t.aggregated_ts, t.metadata, t.statistics,
      CASE WHEN f.blocking_txn_fingerprint_id = f.waiting_txn_fingerprint_id THEN 'both'
           WHEN t.fingerprint_id = f.blocking_txn_fingerprint_id THEN 'blocking' ELSE 'waiting' END AS role
    FROM failed f JOIN exceptions x ON x.exception_id = f.exception_id
    JOIN (SELECT exception_id, blocking_txn_fingerprint_id AS fp FROM failed UNION SELECT exception_id, waiting_txn_fingerprint_id FROM failed) u
      ON u.exception_id = f.exception_id
    JOIN p_txn t ON t.fingerprint_id = u.fp AND t.aggregated_ts <= f.collection_ts + INTERVAL 2 HOUR
    WHERE (t.fingerprint_id = f.blocking_txn_fingerprint_id AND ((x.option = 'same_app' AND t.app_name = f.app_name)
             OR (x.option = 'diff_app' AND t.app_name <> f.app_name) OR x.option = 'any_app'))
       OR ((t.fingerprint_id <> f.blocking_txn_fingerprint_id OR f.blocking_txn_fingerprint_id IS NULL) AND t.app_name = f.app_name)
    QUALIFY row_number() OVER (PARTITION BY f.exception_id, role ORDER BY t.aggregated_ts DESC, t.test_run = x.test_run DESC, t.app_name) = 1)
  WHERE test_run = in_test_run""")
cte("ordered", "picked")("""
  SELECT DISTINCT test_run, fingerprint_id, app_name, aggregated_ts, ord, stmts[ord] AS stmt_fingerprint_id
  FROM (SELECT *, CAST(metadata->'$.stmtFingerprintIDs' AS VARCHAR[]) AS stmts, unnest(range(1, len(CAST(metadata->'$.stmtFingerprintIDs' AS VARCHAR[])) + 1)) AS ord
        FROM (SELECT DISTINCT test_run, fingerprint_id, app_name, aggregated_ts, metadata FROM picked))""")
cte("versions", "ordered", "p_stmt")("""
  SELECT o.*, s.aggregated_ts AS stmt_ts, s.plan_hash, s.metadata AS stmt_metadata, s.statistics AS stmt_statistics,
    s.sampled_plan, s.aggregation_interval, s.recs, s.query, s.full_scan
  FROM ordered o JOIN p_stmt s ON s.test_run = o.test_run AND s.transaction_fingerprint_id = o.fingerprint_id
   AND s.fingerprint_id = o.stmt_fingerprint_id AND s.app_name = o.app_name AND s.aggregated_ts <= o.aggregated_ts
  QUALIFY row_number() OVER (PARTITION BY o.test_run, o.fingerprint_id, o.app_name, o.aggregated_ts, o.ord
    ORDER BY s.aggregated_ts DESC, s.plan_hash) = 1""")
cte("result", "picked", "failed", "versions")("""
  SELECT p.exception_id, p.test_run, v.ord, p.role, CASE WHEN hit THEN 'failed' END AS status,
    CASE WHEN hit THEN f.collection_ts END AS collection_ts, p.aggregated_ts, p.app_name,
    CASE WHEN hit THEN f.database_name END AS database_name, CASE WHEN hit THEN f.schema_name END AS schema_name,
    CASE WHEN hit THEN f.table_name END AS table_name, CASE WHEN hit THEN f.index_name END AS index_name,
    p.metadata AS txn_metadata, p.statistics AS txn_statistics, CASE WHEN hit THEN f.contention_type END AS contention_type,
    coalesce(f.table_name IS NOT NULL AND v.stmt_metadata->>'$.querySummary' LIKE '%' || f.table_name || '%', false) AS contention,
    v.stmt_fingerprint_id AS fingerprint_id, p.fingerprint_id AS transaction_fingerprint_id, v.plan_hash, v.stmt_metadata,
    v.stmt_statistics, v.sampled_plan, v.aggregation_interval, array_to_string(v.recs, '|') AS index_recommendations,
    v.query, v.full_scan
  FROM (SELECT picked.*, exception_id AS xid FROM picked) p JOIN failed f ON f.exception_id = p.exception_id
  JOIN versions v ON v.test_run = p.test_run AND v.fingerprint_id = p.fingerprint_id AND v.app_name = p.app_name AND v.aggregated_ts = p.aggregated_ts
  , LATERAL (SELECT coalesce(p.fingerprint_id = f.waiting_txn_fingerprint_id AND v.stmt_fingerprint_id = f.stmt_fingerprint_id, false) AS hit) h""")

# statement reports
_USER = "app_name NOT LIKE '$ internal%' AND db NOT IN ('system', 'crdb_internal')"
_TIE = "query, app_name, aggregated_ts, fingerprint_id, plan_hash"
cte("recs", "stmt_stats")("""
  SELECT * FROM (
    SELECT fingerprint_id, app_name, query, full_scan, sampled AS execution_count, CAST(svc_mean AS DOUBLE) AS avg_latency_sec,
      CAST(written_mean AS DOUBLE) AS avg_contention_sec, CAST(read_mean AS DOUBLE) AS avg_rows_read,
      CAST(written_mean AS DOUBLE) AS avg_rows_written, index_recommendation,
      nullif(regexp_extract(index_recommendation, '(?i)ON\\s+([a-zA-Z0-9_\\.]+)', 1), '') AS full_path
    FROM (SELECT *, unnest(recs) AS index_recommendation FROM stmt_stats WHERE sampled >= 50))
  WHERE full_path IS NOT NULL""")
cte("scored", "recs")("""
  SELECT *, CASE WHEN n >= 3 THEN parts[n - 2] END AS database_name, CASE WHEN n >= 2 THEN parts[n - 1] END AS schema_name,
    parts[n] AS table_name, 
    execution_count * avg_latency_sec AS total_latency_sec, execution_count * avg_contention_sec AS total_contention_sec,
    execution_count * avg_rows_read AS total_rows_read, execution_count * avg_rows_written AS total_rows_written
  FROM (SELECT *, string_split(full_path, '.') AS parts, len(string_split(full_path, '.')) AS n FROM recs)""")
cte("rec_totals", "scored")("""
  SELECT database_name, schema_name, table_name, full_path, index_recommendation, CAST(sum(execution_count) AS DOUBLE) AS total_executions,
    sum(total_latency_sec) AS total_latency_sec, sum(total_contention_sec) AS total_contention_sec,
    sum(total_rows_read) AS total_rows_read, sum(total_rows_written) AS total_rows_written, bool_or(full_scan) AS involves_full_scan,
    array_to_string(list_sort(list(DISTINCT fingerprint_id)), '|') AS related_fingerprints,
    array_to_string(list_sort(list(DISTINCT app_name)), '|') AS related_applications,
    array_to_string(list_sort(list(DISTINCT substring(query, 1, 200))), '|') AS sample_queries,
    sum(total_latency_sec) / nullif(CAST(sum(execution_count) AS DOUBLE), 0) AS weighted_avg_latency_sec,
    sum(total_contention_sec) / nullif(CAST(sum(execution_count) AS DOUBLE), 0) AS weighted_avg_contention_sec
  FROM scored GROUP BY 1, 2, 3, 4, 5""")
cte("reads", "ev")("SELECT k % 4 AS t, k % 3 AS i, count(*) AS n, max(ts) AS last_read FROM ev GROUP BY 1, 2")
cte("existing", "reads")("""
  SELECT 'schedules' AS database_name, 'public' AS schema_name, 't' || t AS table_name, 'idx_' || i AS index_name, i + 1 AS index_id,
    CASE WHEN i <> 2 THEN n END AS total_reads, CASE WHEN i <> 2 THEN last_read END AS last_read FROM reads
  UNION ALL SELECT 'schedules', 'archive', 't' || t, 'idx_0', 1, NULL, NULL FROM reads WHERE i = 0""")
cte("usage_doc", "existing")("""
  SELECT database_name, schema_name, table_name,
    '[' || string_agg('{"index_name":"' || index_name || '","index_id":' || index_id || ',"total_reads":' || coalesce(total_reads, 0) ||
      ',"last_read":' || coalesce('"' || strftime(last_read, '%Y-%m-%d %H:%M:%S.%f') || '"', 'null') || '}', ',' ORDER BY coalesce(total_reads, 0) DESC, index_name) || ']' AS existing_index_usage
  FROM existing GROUP BY 1, 2, 3""")
cte("metrics", "ev")("""
  SELECT ts, CASE WHEN event_type IN ('error', 'click') THEN 'contention' WHEN event_type = 'view' THEN 'insights'
      WHEN event_type = 'purchase' THEN 'stmt_stats' ELSE 'txn_stats' END AS stream, 'run_' || (user_id % 4) AS test_run,
    CASE WHEN k % 3 = 0 THEN 0 ELSE k END AS rows, CASE WHEN k % 10 = 7 THEN 1 ELSE 0 END AS errors, cents AS duration_ms,
    CAST(k * 3 AS DOUBLE) AS lag_seconds, CASE WHEN event_type = 'click' AND event_id % 10 = 0 THEN 1 ELSE 0 END AS backfilled,
    CAST(ceil(epoch_us(ts) / 60000000) AS BIGINT) AS step FROM ev
  WHERE NOT (event_type NOT IN ('error', 'click', 'view', 'purchase') AND day(ts) > 20 OR user_id % 4 = 3 AND day(ts) > 10)""")


def alert(name: str, severity: str, series: str, value: str, gauge: bool, cond: str, in_range: int, held: int, to_end: bool = False) -> str:
    """Every minute: look back over the range, then over the held time."""
    keys = [s.strip() for s in series.split(",")]
    on = " AND ".join(f"g.{k} = m.{k}" for k in keys)
    measured = f"arg_max({value}, ts)" if gauge else f"sum({value})"
    looked = (
        f"last_value(v IGNORE NULLS) OVER (PARTITION BY {series} ORDER BY step ROWS BETWEEN {in_range - 1} PRECEDING AND CURRENT ROW)"
        if gauge
        else f"coalesce(sum(v) OVER (PARTITION BY {series} ORDER BY step ROWS BETWEEN {in_range - 1} PRECEDING AND CURRENT ROW), 0)"
    )
    end = "(SELECT max(step) FROM metrics)" if to_end else "max(step)"
    w = f"OVER (PARTITION BY {series} ORDER BY step ROWS BETWEEN {held} PRECEDING AND CURRENT ROW)"
    return f"""
  , m AS (SELECT {series}, step, {measured} AS v FROM metrics GROUP BY ALL),
  g AS (SELECT {series}, unnest(range(min(step), {end} + 1)) AS step FROM m GROUP BY {series}),
  l AS (SELECT g.*, v FROM g LEFT JOIN m ON {on} AND g.step = m.step),
  h AS (SELECT {series}, step, coalesce({looked} {cond}, false) AS holds FROM l),
  f AS (SELECT *, bool_and(holds) {w} AND count(*) {w} = {held + 1} AS firing FROM h),
  b AS (SELECT *, coalesce(lag(firing) OVER (PARTITION BY {series} ORDER BY step), false) AS before FROM f)
  SELECT '{name}' AS alert, '{severity}' AS severity, {series}, make_timestamp(step * 60000000) AS fired_at FROM b WHERE firing AND NOT before"""


def u(n: int, seed: int = 11, key: str = "o_orderkey") -> str:
    return f"(CAST(('0x' || substring(md5('{seed}/{n}/' || {key}), 1, 12)) AS BIGINT) / {float(16**12)})"


QUERIES: dict[str, tuple[tuple[str, ...], str]] = {
    "i02_active_runs": (("runs", "state", "clock"), """
  SELECT test_run, database_name, start_time, end_time, agg_grace_interval, min_watermark
  FROM runs CROSS JOIN clock LEFT JOIN (SELECT test_run, min(watermark_ts) AS min_watermark FROM state GROUP BY 1) USING (test_run)
  WHERE now >= start_time AND (now <= closes OR min_watermark IS NULL OR min_watermark < closes)"""),
    "i03_watermarks": (("runs", "state", "streams"), """
  SELECT r.test_run, x.stream, s.watermark_ts FROM runs r CROSS JOIN streams x LEFT JOIN state s ON s.test_run = r.test_run AND s.stream = x.stream"""),
    "i04_set_watermarks": (("state", "due", "clock"), """
  SELECT test_run, stream, watermark_ts, updated_at FROM state WHERE NOT EXISTS
    (SELECT 1 FROM due d WHERE d.test_run = state.test_run AND d.stream = state.stream AND to_ts > from_ts)
  UNION ALL SELECT test_run, stream, to_ts, now FROM due CROSS JOIN clock WHERE to_ts > from_ts"""),
    "i05_live_slices": (("due",), """
  SELECT test_run, stream, database_name, from_ts, to_ts FROM due WHERE stream IN ('contention', 'insights') AND to_ts > from_ts"""),
    "i06_agg_slices": (("due",), """
  SELECT test_run, stream, database_name, from_ts, to_ts FROM due WHERE stream IN ('stmt_stats', 'txn_stats') AND to_ts > from_ts"""),
    "i07_contention": (("p_contention",), "SELECT * FROM p_contention"),
    "i08_insights_dedupe": (("p_insights",), "SELECT * FROM p_insights"),
    "i09_txn_id_map": (("p_map",), "SELECT * FROM p_map"),
    "i10_stmt_upsert": (("p_stmt", "p_stmt_half"), """
  SELECT test_run, aggregated_ts, fingerprint_id, transaction_fingerprint_id, plan_hash, app_name, n.metadata, n.statistics, n.sampled_plan,
    coalesce(o.aggregation_interval, n.aggregation_interval) AS aggregation_interval, array_to_string(n.recs, '|') AS index_recommendations
  FROM p_stmt n LEFT JOIN p_stmt_half o USING (test_run, aggregated_ts, fingerprint_id, transaction_fingerprint_id, plan_hash, app_name)"""),
    "i11_txn_upsert": (("p_txn", "p_txn_half"), """
  SELECT test_run, aggregated_ts, fingerprint_id, app_name, n.metadata, n.statistics,
    coalesce(o.aggregation_interval, n.aggregation_interval) AS aggregation_interval
  FROM p_txn n LEFT JOIN p_txn_half o USING (test_run, aggregated_ts, fingerprint_id, app_name)"""),
    "i15_backfill_candidates": (("contention",), f"""
  SELECT collection_ts, blocking_txn_id, waiting_txn_id, blocking_txn_fingerprint_id, waiting_txn_fingerprint_id FROM contention
  WHERE blocking_txn_fingerprint_id <> '{ZERO}' OR waiting_txn_fingerprint_id <> '{ZERO}'"""),
    "i16_backfill_per_column": (("p_contention", "contention_later"), f"""
  SELECT t.* REPLACE (CASE WHEN fb THEN s.blocking_txn_fingerprint_id ELSE t.blocking_txn_fingerprint_id END AS blocking_txn_fingerprint_id,
    CASE WHEN fw THEN s.waiting_txn_fingerprint_id ELSE t.waiting_txn_fingerprint_id END AS waiting_txn_fingerprint_id),
    coalesce(fb OR fw, false) AS changed
  FROM p_contention t LEFT JOIN contention_later s USING (collection_ts, blocking_txn_id, waiting_txn_id)
  , LATERAL (SELECT t.blocking_txn_fingerprint_id = '{ZERO}' AND s.blocking_txn_fingerprint_id <> '{ZERO}' AS fb,
                    t.waiting_txn_fingerprint_id = '{ZERO}' AND s.waiting_txn_fingerprint_id <> '{ZERO}' AS fw) x"""),
    "i17_backfill_both": (("p_contention", "contention_later"), f"""
  SELECT t.* REPLACE (CASE WHEN hit THEN s.blocking_txn_fingerprint_id ELSE t.blocking_txn_fingerprint_id END AS blocking_txn_fingerprint_id,
    CASE WHEN hit THEN s.waiting_txn_fingerprint_id ELSE t.waiting_txn_fingerprint_id END AS waiting_txn_fingerprint_id),
    coalesce(hit, false) AS changed
  FROM p_contention t LEFT JOIN contention_later s USING (collection_ts, blocking_txn_id, waiting_txn_id)
  , LATERAL (SELECT (t.blocking_txn_fingerprint_id = '{ZERO}' AND s.blocking_txn_fingerprint_id <> '{ZERO}')
                 OR (t.waiting_txn_fingerprint_id = '{ZERO}' AND s.waiting_txn_fingerprint_id <> '{ZERO}') AS hit) x"""),
    "i20_older_active_runs": (("older", "clock"), """
  SELECT test_run, last_copy_time, last_agg_copy_time FROM older CROSS JOIN clock WHERE now >= start_time
    AND (last_copy_time IS NULL OR last_copy_time < end_time OR last_agg_copy_time IS NULL OR last_agg_copy_time < end_time)"""),
    "i22_hour_window": (("older", "clock", "txn_stats"), """
  SELECT test_run, database_name, from_ts, CASE WHEN from_ts < date_trunc('hour', to_raw) THEN date_trunc('hour', to_raw) ELSE to_raw END AS to_ts
  FROM (SELECT *, coalesce(last_agg_copy_time, start_time) AS from_raw, date_trunc('hour', coalesce(last_agg_copy_time, start_time)) AS from_ts,
          least(now - INTERVAL 10 SECOND, end_time + INTERVAL 10 MINUTE) AS to_raw FROM older CROSS JOIN clock)
  WHERE from_raw < to_raw AND epoch_us(now) - epoch_us(from_ts) >= (SELECT max(aggregation_interval) FROM txn_stats) * 7 / 6"""),
    "i24_load_counts": (("counts",), "SELECT * FROM counts"),
    "i25_load_summary": (("summary",), "SELECT * FROM summary"),
    "s10_summary_json": (("summary",), """
  SELECT '{"test_run":"' || test_run || '","contention":' || contention || ',"insights":' || insights || ',"statements":' || statements ||
    ',"transactions":' || transactions || '}' AS result FROM summary"""),
    "i26_normalise_recs": (("stmt_stats",), """
  SELECT aggregated_ts, fingerprint_id, plan_hash, app_name, array_to_string(recs, '|') AS recs, CAST(cnt AS VARCHAR) AS one,
    array_to_string(list_transform(recs, lambda r: '{"rec":"' || r || '"}'), '|') AS docs FROM stmt_stats"""),
    "r01_expire": (("contention", "latest"), """
  SELECT contention.* FROM contention CROSS JOIN latest WHERE collection_ts > ts + INTERVAL 75 DAY - INTERVAL 90 DAY"""),
    "r01b_expire_all": (("runs", "state", "latest", "p_contention", "p_insights", "p_map", "p_stmt", "p_txn"), """
  SELECT table_name, CAST(sum(CASE WHEN stamp IS NULL OR stamp > ts + INTERVAL 75 DAY - INTERVAL 90 DAY THEN 1 ELSE 0 END) AS BIGINT) AS rows FROM (
    SELECT 'runs' AS table_name, end_time AS stamp FROM runs UNION ALL SELECT 'ingest_state', updated_at FROM state
    UNION ALL SELECT 'contention', collection_ts FROM p_contention UNION ALL SELECT 'insights', start_time FROM p_insights
    UNION ALL SELECT 'txn_id_map', NULL FROM p_map UNION ALL SELECT 'stmt_stats', aggregated_ts FROM p_stmt
    UNION ALL SELECT 'txn_stats', aggregated_ts FROM p_txn) CROSS JOIN latest GROUP BY 1"""),
    "r02_cascade": (("runs", "state", "p_contention", "p_insights", "p_map", "p_stmt", "p_txn"), """
  SELECT table_name, test_run, count(*) AS rows FROM (
    SELECT 'runs' AS table_name, test_run FROM runs UNION ALL SELECT 'contention', test_run FROM p_contention
    UNION ALL SELECT 'insights', test_run FROM p_insights UNION ALL SELECT 'txn_id_map', test_run FROM p_map
    UNION ALL SELECT 'stmt_stats', test_run FROM p_stmt UNION ALL SELECT 'txn_stats', test_run FROM p_txn)
  WHERE test_run IN (SELECT test_run FROM runs WHERE database_name <> 'other') GROUP BY 1, 2
  UNION ALL SELECT 'ingest_state', test_run, count(*) FROM state GROUP BY 1, 2"""),
    "r03_orphans": (("contention", "runs"), """
  SELECT * FROM (SELECT 'run_' || strftime(collection_ts, '%Y%m%d') AS test_run, * FROM contention) c
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.test_run = c.test_run AND r.database_name = 'schedules')"""),
    "r04_duplicates": (("t_insights",), """
  SELECT test_run, txn_fingerprint_id, stmt_fingerprint_id, status, app_name, coalesce(last_error_redactable, '<<NULL>>') AS last_error_redactable,
    count(*) AS rows FROM t_insights GROUP BY ALL HAVING count(*) > 1"""),
    "r05_nulls": (("insights",), """
  UNPIVOT (SELECT """ + ", ".join(
        f"count(*) - count({c}) AS {c}"
        for c in (
            "end_time", "user_name", "plan_gist", "priority", "exec_node_ids", "kv_node_ids", "index_recommendations", "implicit_txn",
            "cpu_sql_nanos", "query_tags", "session_id", "txn_id", "txn_fingerprint_id", "stmt_id", "stmt_fingerprint_id", "problem", "causes", "query", "status",
            "start_time", "full_scan", "app_name", "database_name", "rows_read", "rows_written", "retries", "last_retry_reason",
            "contention", "error_code", "last_error_redactable",
        )
    ) + " FROM insights) ON COLUMNS(*) INTO NAME column_name VALUE nulls"),
    "e01_parse": (("parsed",), "SELECT exception_id, retry_error_type, contention_key, conflict_ts, txn_id_prefix FROM parsed"),
    "e05_stage1": (("stage1",), "SELECT * FROM stage1"),
    "e07_stage2": (("stage2",), "SELECT * FROM stage2"),
    "e08_stage3": (("stage3",), "SELECT * FROM stage3"),
    "e09_failed_statement": (("failed",), "SELECT * REPLACE (CAST(stage AS BIGINT) AS stage) FROM failed"),
    "e12_txn_pick": (("picked",), "SELECT exception_id, role, test_run, fingerprint_id, app_name, aggregated_ts FROM picked"),
    "e13_stmt_order": (("ordered",), "SELECT * FROM ordered"),
    "e14_asof_stmt": (("versions",), """
  SELECT test_run, fingerprint_id, stmt_fingerprint_id, app_name, stmt_ts, aggregated_ts, ord, plan_hash FROM versions"""),
    "e17_root_cause": (("result",), "SELECT * EXCLUDE (query, full_scan) FROM result"),
    "s11_report": (("result",), """
  SELECT exception_id, test_run, collection_ts, database_name, schema_name, table_name, index_name, contention_type, app_name,
    transaction_fingerprint_id AS txn_fingerprint_id, role AS tnx_type, contention, fingerprint_id AS stmt_fingerprint_id,
    full_scan AS fullscan, index_recommendations, ord AS stmt_order, status, query AS sql_statement FROM result"""),
    "a00_horizon": (("horizon",), "SELECT * FROM horizon"),
    "a00b_capacity": (("horizon",), """
  SELECT source, rows, capacity, rows / CAST(capacity AS DOUBLE) AS used, rows / CAST(capacity AS DOUBLE) >= 0.95 AS evicting
  FROM horizon JOIN (VALUES ('cluster_statement_statistics', 3000::BIGINT), ('cluster_transaction_statistics', 3000),
    ('cluster_execution_insights', 1000), ('transaction_contention_events', 100000)) c(source, capacity) USING (source)"""),
    "a01_slow_mean": (("stmt_stats",), f"""
  SELECT query, app_name, cnt AS execs, round(CAST(run_mean AS DOUBLE) * 1000, 2) AS mean_run_ms, round(CAST(svc_mean AS DOUBLE) * 1000, 2) AS mean_svc_ms,
    round(CAST(written_mean AS DOUBLE) * 1000, 2) AS mean_contention_ms, round(CAST(read_mean AS DOUBLE), 1) AS mean_rows_read, full_scan
  FROM stmt_stats WHERE {_USER} ORDER BY mean_run_ms DESC, {_TIE} LIMIT 20"""),
    "a02_slow_total": (("stmt_stats",), f"""
  SELECT query, app_name, cnt AS execs, round(CAST(svc_mean AS DOUBLE) * 1000, 2) AS mean_svc_ms, round(CAST(cnt AS DOUBLE) * svc_mean, 2) AS total_svc_sec
  FROM stmt_stats WHERE {_USER} ORDER BY total_svc_sec DESC, {_TIE} LIMIT 20"""),
    "a03_full_scans": (("stmt_stats",), f"""
  SELECT query, app_name, cnt AS execs, round(CAST(read_mean AS DOUBLE), 1) AS mean_rows_read, round(CAST(cnt AS DOUBLE) * read_mean, 0) AS total_rows_read,
    round(CAST(run_mean AS DOUBLE) * 1000, 2) AS mean_run_ms, array_to_string(recs, '|') AS index_recommendations
  FROM stmt_stats WHERE {_USER} AND full_scan ORDER BY total_rows_read DESC, {_TIE} LIMIT 20"""),
    "a04_insights": (("insights",), """
  SELECT problem, causes, query, app_name, count(*) AS occurrences, CAST(sum(contention) AS DOUBLE) / 1000 AS total_contention_ms,
    CAST(sum(rows_read) AS BIGINT) AS rows_read, max(retries) AS max_retries, bool_or(full_scan) AS any_full_scan
  FROM insights WHERE app_name NOT LIKE '$ internal%' GROUP BY 1, 2, 3, 4
  ORDER BY occurrences DESC, total_contention_ms DESC NULLS LAST, problem, query, app_name, causes LIMIT 25"""),
    "a05_failed": (("insights",), """
  SELECT start_time, app_name, query, status, error_code, last_retry_reason, retries FROM insights
  WHERE status = 'Failed' AND app_name NOT LIKE '$ internal%' ORDER BY start_time DESC, app_name, query, stmt_id LIMIT 25"""),
    "a08_index_scored": (("scored",), """
  SELECT fingerprint_id, app_name, query, full_scan, execution_count, avg_latency_sec, avg_contention_sec, avg_rows_read, avg_rows_written,
    index_recommendation, full_path, database_name, schema_name, table_name, total_latency_sec, total_contention_sec,
    total_rows_read, total_rows_written FROM scored"""),
    "a09_index_agg": (("rec_totals",), "SELECT * FROM rec_totals"),
    "a10_existing_indexes": (("existing",), "SELECT * FROM existing"),
    "a11_index_usage": (("usage_doc",), "SELECT * FROM usage_doc"),
    "a14_index_report": (("rec_totals", "usage_doc"), """
  SELECT a.*, CASE WHEN total_rows_written > total_rows_read THEN 'WRITE_HEAVY' WHEN total_rows_read > total_rows_written THEN 'READ_HEAVY'
      ELSE 'BALANCED' END AS workload_profile, ip.existing_index_usage,
    CAST(CAST(total_latency_sec AS DECIMAL(20,6)) * 0.5 + CAST(total_contention_sec AS DECIMAL(20,6)) * 0.3
      + CAST(total_rows_read / 1000000 AS DECIMAL(20,9)) * 0.1 + CAST(total_contention_sec * 0.5 AS DECIMAL(20,6)) * 0.1 AS DOUBLE) AS impact_score
  FROM rec_totals a LEFT JOIN usage_doc ip ON a.table_name = ip.table_name AND (a.schema_name IS NULL OR a.schema_name = ip.schema_name)
    AND (a.database_name IS NULL OR a.database_name = ip.database_name)"""),
    "a15_hot_objects": (("contention",), """
  SELECT database_name, schema_name, table_name, coalesce(index_name, '(primary or n/a)') AS index_name, contention_type, count(*) AS events,
    CAST(sum(contention_duration) AS DOUBLE) / 1000 AS total_contention_ms, CAST(max(contention_duration) AS DOUBLE) / 1000 AS max_contention_ms
  FROM contention GROUP BY 1, 2, 3, contention.index_name, 5
  ORDER BY total_contention_ms DESC, database_name, schema_name, table_name, 4, contention_type LIMIT 20"""),
    "a16_waiting": (("contention", "stmt_stats"), """
  SELECT waiting_stmt_fingerprint_id AS waiting_stmt_fp, count(*) AS wait_events, CAST(sum(contention_duration) AS DOUBLE) / 1000 AS total_wait_ms,
    min(query) AS sample_query
  FROM contention LEFT JOIN stmt_stats ON fingerprint_id = waiting_stmt_fingerprint_id
  GROUP BY 1 ORDER BY total_wait_ms DESC, waiting_stmt_fp LIMIT 20"""),
    "a17_blocking": (("contention",), """
  SELECT blocking_txn_fingerprint_id AS blocking_txn_fp, count(*) AS times_blocking, CAST(sum(contention_duration) AS DOUBLE) / 1000 AS total_blocking_ms,
    count(DISTINCT waiting_txn_fingerprint_id) AS distinct_victims
  FROM contention GROUP BY 1 ORDER BY total_blocking_ms DESC, blocking_txn_fp LIMIT 20"""),
    "a18_failed_txns": (("txn_stats", "stmt_stats"), f"""
  SELECT t.fingerprint_id AS txn_fingerprint_id, CAST(json_array_length(t.metadata->'$.stmtFingerprintIDs') AS BIGINT) AS num_stmt, t.app_name,
    t.cnt AS tx_execs, stmt_execs, failed_stmt_execs,
    CASE WHEN failed_stmt_execs = 0 THEN 'NEVER' WHEN failed_stmt_execs / t.cnt < 1 THEN 'SOMETIMES' ELSE 'ALWAYS' END AS failure_rate,
    round(failed_stmt_execs / t.cnt, 6) AS failed_txn_ratio
  FROM txn_stats t JOIN (SELECT app_name, transaction_fingerprint_id, CAST(sum(cnt) AS BIGINT) AS stmt_execs, CAST(sum(fails) AS BIGINT) AS failed_stmt_execs
    FROM stmt_stats WHERE {_USER} GROUP BY 1, 2) x ON t.app_name = x.app_name AND t.fingerprint_id = x.transaction_fingerprint_id
  WHERE t.app_name NOT LIKE '$ internal%'"""),
    "a19_write_hotspots": (("stmt_stats",), f"""
  SELECT fq AS table_identifier, list_extract(string_split(replace(fq, '"', ''), '.'), -1) AS table_name, CAST(sum(approx) AS BIGINT) AS approx_rows_written
  FROM (SELECT cnt * written_mean AS approx, coalesce(
      lower(nullif(regexp_extract(query, '(?is)\\binsert\\s+into\\s+((?:"[^"]+"|\\w+)(?:\\.(?:"[^"]+"|\\w+)){{0,2}})', 1), '')),
      lower(nullif(regexp_extract(query, '(?is)\\bupsert\\s+into\\s+((?:"[^"]+"|\\w+)(?:\\.(?:"[^"]+"|\\w+)){{0,2}})', 1), '')),
      lower(nullif(regexp_extract(query, '(?is)\\bmerge\\s+into\\s+((?:"[^"]+"|\\w+)(?:\\.(?:"[^"]+"|\\w+)){{0,2}})', 1), '')),
      lower(nullif(regexp_extract(query, '(?is)\\bupdate\\s+((?:"[^"]+"|\\w+)(?:\\.(?:"[^"]+"|\\w+)){{0,2}})', 1), '')),
      lower(nullif(regexp_extract(query, '(?is)\\bdelete\\s+from\\s+((?:"[^"]+"|\\w+)(?:\\.(?:"[^"]+"|\\w+)){{0,2}})', 1), ''))) AS fq
    FROM stmt_stats WHERE {_USER} AND written_mean > 0)
  WHERE fq IS NOT NULL AND fq NOT LIKE 'system.%' AND fq NOT LIKE 'crdb_internal.%' GROUP BY 1, 2"""),
    "a20_slow_performers": (("stmt_stats",), """
  SELECT max(round(CAST(run_mean AS DOUBLE) * 1000, 2)) AS avg_ms, query FROM stmt_stats WHERE app_name = 'app1' GROUP BY 2 ORDER BY 1 DESC, 2 LIMIT 5"""),
    "a21_random_sample": ((), f"""
  SELECT o_orderkey FROM orders ORDER BY md5('{SAMPLE_SEED}/' || o_orderkey), o_orderkey LIMIT 16"""),
    "a22_offset_sample": ((), f"""
  SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
  WHERE pos >= floor({OFFSET_DRAW} * n / 10) AND pos < floor({OFFSET_DRAW} * n / 10) + 16"""),
    "a23_latency": (("ev",), """
  SELECT op, count(DISTINCT user_id) AS threads, max(n) AS ops, CAST(sum(cents) AS DOUBLE) / count(*) AS mean, max(cents) AS max, max(n) / 3600.0::DOUBLE AS ops_per_second,
    max(cents) FILTER (pos = (n * 50 + 99) // 100) AS p50, max(cents) FILTER (pos = (n * 90 + 99) // 100) AS p90,
    max(cents) FILTER (pos = (n * 95 + 99) // 100) AS p95, max(cents) FILTER (pos = (n * 99 + 99) // 100) AS p99
  FROM (SELECT event_type AS op, user_id, cents, row_number() OVER (PARTITION BY event_type ORDER BY cents) AS pos,
          count(*) OVER (PARTITION BY event_type) AS n FROM ev) GROUP BY op"""),
    "a24_run_compare": (("stmt_stats",), f"""
  SELECT app_name, fingerprint_id, b.n AS base_execs, o.n AS other_execs, b.run / b.n AS base_mean_run, o.run / o.n AS other_mean_run,
    o.run / o.n - b.run / b.n AS run_change, b.svc / b.n AS base_mean_svc, o.svc / o.n AS other_mean_svc, o.svc / o.n - b.svc / b.n AS svc_change
  FROM (SELECT app_name, fingerprint_id, CAST(sum(cnt) AS BIGINT) AS n, CAST(sum(cnt * run_mean) AS DOUBLE) AS run, CAST(sum(cnt * svc_mean) AS DOUBLE) AS svc
        FROM stmt_stats WHERE aggregated_ts < TIMESTAMP '{COMPARE_AT}' GROUP BY 1, 2) b
  FULL JOIN (SELECT app_name, fingerprint_id, CAST(sum(cnt) AS BIGINT) AS n, CAST(sum(cnt * run_mean) AS DOUBLE) AS run, CAST(sum(cnt * svc_mean) AS DOUBLE) AS svc
        FROM stmt_stats WHERE aggregated_ts >= TIMESTAMP '{COMPARE_AT}' GROUP BY 1, 2) o USING (app_name, fingerprint_id)"""),
    "a25_keyed_update": ((), f"""
  SELECT o_orderkey, o_custkey,
    CASE WHEN hit THEN (['on_time', 'delayed', 'cancelled'])[CAST(floor({u(2)} * 3) AS BIGINT) + 1] ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN hit THEN o_totalprice * (1 + ({u(3)} - 0.5::DOUBLE) / 10::DOUBLE) ELSE o_totalprice END AS o_totalprice,
    CASE WHEN hit THEN o_orderdate + to_minutes(CASE WHEN {u(0)} < 0.5 THEN 1 ELSE -1 END * (CAST(floor({u(1)} * 56) AS BIGINT) + 5)) ELSE o_orderdate END AS o_orderdate,
    o_orderpriority
  FROM (SELECT *, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS hit FROM orders)"""),
    "a25b_predicate_update": ((), """
  SELECT * REPLACE (CASE WHEN c_mktsegment = 'MACHINERY' THEN 'renamed' ELSE c_name END AS c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey) FROM customer"""),
    "m01_stream_totals": (("metrics",), """
  SELECT stream, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(errors) AS BIGINT) AS errors, count(*) AS batches, CAST(sum(duration_ms) AS BIGINT) AS duration_ms
  FROM metrics GROUP BY 1"""),
    "m03_durations": (("metrics",), """
  SELECT stream, CAST(le_ms AS BIGINT) AS le_ms, count(*) FILTER (le_ms IS NULL OR duration_ms <= le_ms) AS batches
  FROM metrics CROSS JOIN (SELECT unnest([5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000, NULL]) AS le_ms) GROUP BY 1, 2"""),
    "m04_active_runs": (("runs", "state", "clock"), """
  SELECT count(*) AS active_runs
  FROM runs CROSS JOIN clock LEFT JOIN (SELECT test_run, min(watermark_ts) AS min_watermark FROM state GROUP BY 1) USING (test_run)
  WHERE now >= start_time AND (now <= closes OR min_watermark IS NULL OR min_watermark < closes)"""),
    "m05_watermark_lag": (("due", "clock"), """
  SELECT test_run, stream, all_ts AS to_ts, CAST(epoch_us(now) - epoch_us(all_ts) AS DOUBLE) / 1000000 AS lag_seconds FROM due CROSS JOIN clock WHERE all_ts > from_ts"""),
    "m06_backfilled": (("p_contention", "contention_later"), f"""
  SELECT test_run, count(*) AS rows FROM p_contention t JOIN contention_later s USING (collection_ts, blocking_txn_id, waiting_txn_id)
  WHERE (t.blocking_txn_fingerprint_id = '{ZERO}' AND s.blocking_txn_fingerprint_id <> '{ZERO}')
     OR (t.waiting_txn_fingerprint_id = '{ZERO}' AND s.waiting_txn_fingerprint_id <> '{ZERO}') GROUP BY 1"""),
    "m07_alert_errors": (("metrics",), alert("ObsDaemonIngestErrors", "warning", "stream", "errors", False, "> 0", 5, 2)),
    "m08_alert_lag": (("metrics",), alert("ObsDaemonWatermarkLagHigh", "warning", "stream, test_run", "lag_seconds", True, "> 180", 5, 5)),
    "m09_alert_idle": (("metrics",), alert("ObsDaemonNotIngesting", "warning", "stream", "rows", False, "= 0", 10, 10, True)),
    "m10_alert_backfill": (("metrics",), alert("ObsDaemonBackfillStuck", "info", "test_run", "backfilled", False, "= 0", 30, 60, True)),
}

cte("older", "runs", "state")("""
  SELECT r.*, last_copy_time, last_agg_copy_time FROM runs r LEFT JOIN (
    SELECT test_run, max(watermark_ts) FILTER (stream = 'contention') AS last_copy_time,
      max(watermark_ts) FILTER (stream <> 'contention') AS last_agg_copy_time FROM state GROUP BY 1) USING (test_run)""")
cte("counts", "p_contention", "p_insights", "p_stmt", "p_txn")("""
  SELECT test_run, stream, count(*) AS rows FROM (
    SELECT test_run, 'contention' AS stream FROM p_contention UNION ALL SELECT test_run, 'insights' FROM p_insights
    UNION ALL SELECT test_run, 'stmt_stats' FROM p_stmt UNION ALL SELECT test_run, 'txn_stats' FROM p_txn) GROUP BY 1, 2""")
cte("summary", "runs", "counts")("""
  SELECT test_run, CAST(coalesce(sum(rows) FILTER (stream = 'contention'), 0) AS BIGINT) AS contention,
    CAST(coalesce(sum(rows) FILTER (stream = 'insights'), 0) AS BIGINT) AS insights,
    CAST(coalesce(sum(rows) FILTER (stream = 'stmt_stats'), 0) AS BIGINT) AS statements,
    CAST(coalesce(sum(rows) FILTER (stream = 'txn_stats'), 0) AS BIGINT) AS transactions
  FROM runs LEFT JOIN counts USING (test_run) GROUP BY 1""")
cte("horizon", "stmt_stats", "txn_stats", "insights", "contention")("""
  SELECT source, count(*) AS rows, min(ts) AS oldest, max(ts) AS newest, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM (
    SELECT 'cluster_statement_statistics' AS source, aggregated_ts AS ts FROM stmt_stats
    UNION ALL SELECT 'cluster_transaction_statistics', aggregated_ts FROM txn_stats
    UNION ALL SELECT 'cluster_execution_insights', start_time FROM insights
    UNION ALL SELECT 'transaction_contention_events', collection_ts FROM contention) GROUP BY 1""")


def _with(needs: tuple[str, ...]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in CTES[name][0]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    return order


_SINCE, _UNTIL = (f"TIMESTAMP '{t:%Y-%m-%d}'" for t in (READ_SINCE, READ_UNTIL))
QUERIES |= {
    f"{k[:3]}b_{k[4:]}_typed": QUERIES[k] for k in ("a01_slow_mean", "a02_slow_total", "a03_full_scans", "a18_failed_txns", "a19_write_hotspots")
} | {
    "e05b_stage1_streamed": QUERIES["e05_stage1"],
    "a23b_latency_sketched": (("ev",), """
  SELECT event_type AS op, count(*) AS ops, round(avg(cents), 6) AS mean, max(cents) AS max,
    true AS p50_near, true AS p90_near, true AS p95_near, true AS p99_near, true AS users_near FROM ev GROUP BY 1"""),
    "s01_read_contention": (("contention",), f"""
  SELECT * FROM contention WHERE database_name = 'schedules' AND collection_ts >= {_SINCE} AND collection_ts < {_UNTIL}"""),
    "s02_read_insights": (("insights",), f"SELECT * FROM insights WHERE query <> 'SELECT _' AND start_time >= {_SINCE}"),
    "s03_read_stmt_stats": (("stmt_stats",), f"""
  SELECT aggregated_ts, fingerprint_id, transaction_fingerprint_id, plan_hash, app_name, metadata, statistics, sampled_plan,
    aggregation_interval, array_to_string(recs, '|') AS index_recommendations FROM stmt_stats WHERE aggregated_ts < {_UNTIL}"""),
    "s04_read_txn_stats": (("txn_stats",), """
  SELECT aggregated_ts, fingerprint_id, app_name, metadata, statistics, aggregation_interval FROM txn_stats"""),
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (needs, body) in QUERIES.items():
        ctes = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in _with(needs))
        out[name] = (f"WITH {ctes}\n" if ctes else "") + body.lstrip()
    return out
