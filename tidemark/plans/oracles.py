"""DuckDB SQL for every query of plans.queries, written independently of them."""

from __future__ import annotations

_LOG = """plog AS (
 SELECT 'events' AS topic, CAST(user_id % 4 AS INT) AS part, ROW_NUMBER() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS off,
  CAST(user_id AS VARCHAR) AS k, props AS v, ts, event_id, event_type, value,
  CASE WHEN event_type = 'error' THEN CAST(event_id % 6 AS INT) ELSE 0 END AS fail_until, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS dlq_broken,
  CAST(COALESCE(octet_length(encode(CAST(user_id AS VARCHAR))), 0) + COALESCE(octet_length(encode(props)), 0) AS BIGINT) AS bytes
 FROM events)"""
_OUTCOME = (
    _LOG
    + """, outcome AS (
 SELECT *, CASE WHEN event_id % 50 = 7 THEN 'HOOK_SKIP' WHEN fail_until <= 3 THEN 'SUCCESS' WHEN dlq_broken = 0 THEN 'DLQ_SUCCESS' WHEN part <> 3 THEN 'SKIP' ELSE 'FAIL_PARTITION' END AS resolution,
  CAST(CASE WHEN event_id % 50 = 7 THEN 0 WHEN fail_until <= 3 THEN fail_until + 1 ELSE 4 END AS INT) AS attempts
 FROM plog)"""
)
_LEDGER = (
    _OUTCOME
    + """, ordered AS (
 SELECT * REPLACE (CASE WHEN fails > 0 THEN 'HELD' ELSE resolution END AS resolution), CASE WHEN fails > 0 THEN 'REGISTERED' WHEN resolution = 'FAIL_PARTITION' THEN 'FAILED' ELSE 'DONE' END AS status, resolution = 'FAIL_PARTITION' AS would_fail
 FROM (SELECT *, COALESCE(SUM(CASE WHEN resolution = 'FAIL_PARTITION' THEN 1 ELSE 0 END) OVER (PARTITION BY topic, part ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fails FROM outcome)),
 led AS (SELECT *, SUM(CASE WHEN status <> 'DONE' THEN 1 ELSE 0 END) OVER (PARTITION BY topic, part ORDER BY off ROWS UNBOUNDED PRECEDING) AS gaps FROM ordered),
 mark AS (SELECT topic, part, CAST(MAX(CASE WHEN gaps = 0 THEN off END) + 1 AS BIGINT) AS committable, MAX(off) AS last FROM led GROUP BY ALL)"""
)


def _with(base: str, query: str) -> str:
    return f"WITH {base} {query}"


_REGS = _LOG + ", regs AS (SELECT topic, part, off, event_id * 2 AS seq FROM plog UNION ALL SELECT topic, part, off, event_id * 2 + 5 FROM plog WHERE event_id % 97 = 0)"
_CHANGES = (
    _LEDGER
    + """, steps AS (SELECT topic, part, off, CASE WHEN event_id % 101 = 0 THEN ['REGISTERED', fin] WHEN event_id % 89 = 0 THEN ['REGISTERED', 'REGISTERED', 'IN_PROGRESS', fin] ELSE ['REGISTERED', 'IN_PROGRESS', fin] END AS s
 FROM (SELECT *, CASE WHEN status = 'FAILED' THEN 'FAILED' ELSE 'DONE' END AS fin FROM led WHERE resolution <> 'HELD')),
 changes AS (SELECT topic, part, off, CAST(i - 1 AS INT) AS seq, s[i] AS status FROM (SELECT *, UNNEST(range(1, len(s) + 1)) AS i FROM steps))"""
)
_SAMPLES = "samples AS (SELECT event_id, event_id * 37 % 600 AS records, event_id * 7919 % 500 AS bytes, CAST(event_id * 31 % 100 AS DOUBLE) / 100.0 AS ratio FROM events)"


def _sense(x: str, low: str, high: str, critical: str) -> str:
    latch = f"LAST_VALUE(CASE WHEN {x} >= {high} THEN 1 WHEN {x} <= {low} THEN 0 END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)"
    return f"CASE WHEN {x} >= {critical} THEN 'CRITICAL' WHEN {latch} = 1 THEN 'THROTTLE' ELSE 'OK' END"


_R, _B, _H = _sense("records", "60", "100", "500"), _sense("bytes", "100", "200", "400"), _sense("ratio", "0.5", "0.7", "0.9")
_SENSED = (
    _SAMPLES
    + f", sensed AS (SELECT *, CASE WHEN 'CRITICAL' IN (r, b, h) THEN 'CRITICAL' WHEN 'THROTTLE' IN (r, b, h) THEN 'THROTTLE' ELSE 'OK' END AS status FROM (SELECT *, {_R} AS r, {_B} AS b, {_H} AS h FROM samples))"
)


def _size(n: str) -> str:
    one = lambda d: f"printf('%.1f', floor({n} / {d}.0 * 10 + 0.5) / 10)"
    return f"CASE WHEN {n} >= 1073741824 THEN {one(1 << 30)} || 'GB' WHEN {n} >= 1048576 THEN {one(1 << 20)} || 'MB' WHEN {n} >= 1024 THEN {one(1 << 10)} || 'KB' ELSE CAST({n} AS VARCHAR) || 'B' END"


_MARKED = "SELECT led.*, committable FROM led JOIN mark USING (topic, part)"
_EXP = lambda cap: f"CASE WHEN a <= 0 THEN 100 ELSE {'LEAST(' if cap else ''}100 * CAST(pow(2, LEAST(a, 30)) AS BIGINT){f', {cap})' if cap else ''} END"

ORACLES: dict[str, str] = {
    "partitioned_log_scan": _with(_LOG, "SELECT topic, part, off, k, v, event_id FROM plog"),
    "poll_batches": _with(_LOG, "SELECT topic, part, CAST(floor(off / 500) AS BIGINT) AS poll_id, MIN(off) AS first_off, MAX(off) AS last_off, COUNT(*) AS n, CAST(SUM(bytes) AS BIGINT) AS bytes FROM plog GROUP BY ALL"),
    "partition_fifo": _with(_LOG, "SELECT topic, part, COUNT(*) AS n, MIN(off) AS first_off, MAX(off) AS last_off, CAST(0 AS BIGINT) AS out_of_order FROM plog GROUP BY ALL"),
    "queue_depth": _with(_LEDGER, "SELECT topic, part, COUNT(*) FILTER (status = 'REGISTERED') AS queued FROM led GROUP BY ALL"),
    "retain_partitions": _with(_LOG, "SELECT topic, part, off, k, v, event_id FROM plog WHERE part IN (0, 2)"),
    "abandoned_records": _with(_LEDGER, "SELECT topic, part, off, status FROM led WHERE part IN (1, 3) AND status <> 'DONE'"),
    "record_handler": _with(_LOG, "SELECT topic, part, off, CAST(COALESCE(length(v), 0) + part AS BIGINT) AS handled FROM plog"),
    "batch_handler": _with(_LOG, "SELECT topic, part, CAST(floor(off / 500) AS BIGINT) AS poll_id, COUNT(*) AS n, COUNT(*) FILTER (fail_until > 0) AS failing FROM plog GROUP BY ALL"),
    "record_outcomes": _with(_OUTCOME, "SELECT topic, part, off, resolution, attempts FROM outcome"),
    "batch_outcomes": _with(
        _LOG,
        """SELECT topic, part, poll_id, first_off, last_off, n, resolution, attempts, CASE WHEN resolution = 'FAIL_PARTITION' THEN first_off END AS failed_off FROM (
 SELECT *, CASE WHEN f <= 3 THEN 'SUCCESS' WHEN d = 0 THEN 'DLQ_SUCCESS' WHEN part <> 3 THEN 'SKIP' ELSE 'FAIL_PARTITION' END AS resolution, CAST(LEAST(f, 3) + 1 AS INT) AS attempts FROM (
 SELECT topic, part, CAST(floor(off / 5) AS BIGINT) AS poll_id, MIN(off) AS first_off, MAX(off) AS last_off, COUNT(*) AS n, MAX(fail_until) AS f, MAX(dlq_broken) AS d FROM plog GROUP BY ALL))""",
    ),
    "hook_skip": _with(_LOG, "SELECT topic, part, off FROM plog WHERE event_id % 50 = 7"),
    "dedup_anti": _with(_LOG, "SELECT topic, part, off, event_id FROM plog WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0)"),
    "register_violations": _with(_REGS, "SELECT topic, part, off, COUNT(*) AS times FROM regs GROUP BY ALL HAVING COUNT(*) > 1"),
    "order_violations": _with(_REGS, "SELECT topic, part, off, seq, highest FROM (SELECT *, MAX(off) OVER (PARTITION BY topic, part ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM regs) WHERE off <= highest"),
    "register_batch_expand": _with(_LOG, "SELECT topic, part, CAST(floor(off / 500) AS BIGINT) AS poll_id, off FROM plog"),
    "illegal_transitions": _with(
        _CHANGES,
        """SELECT topic, part, off, seq, was, status FROM (SELECT *, LAG(status) OVER (PARTITION BY topic, part, off ORDER BY seq) AS was FROM changes)
 WHERE COALESCE(was, '-') || '>' || status NOT IN ('->REGISTERED', 'REGISTERED>IN_PROGRESS', 'IN_PROGRESS>DONE', 'IN_PROGRESS>FAILED', 'FAILED>DONE')""",
    ),
    "latest_status": _with(_CHANGES, "SELECT topic, part, off, arg_max(status, seq) AS status FROM changes GROUP BY ALL"),
    "failed_partitions": _with(_LEDGER, "SELECT topic, part, MIN(off) AS failed_off FROM led WHERE status = 'FAILED' GROUP BY ALL"),
    "held_records": _with(_LEDGER, "SELECT topic, part, off, status FROM led WHERE fails > 0"),
    "resolve_failure": _with(
        _LEDGER,
        """, again AS (SELECT *, SUM(CASE WHEN would_fail THEN 1 ELSE 0 END) OVER (PARTITION BY topic, part ORDER BY off ROWS UNBOUNDED PRECEDING) AS nth FROM led)
 SELECT m.topic, m.part, m.committable AS before, a.after FROM mark m JOIN (SELECT topic, part, CAST(MAX(CASE WHEN nth <= 1 THEN off END) + 1 AS BIGINT) AS after FROM again GROUP BY ALL) a USING (topic, part)""",
    ),
    "committable_offset": _with(_LEDGER, "SELECT topic, part, committable, CAST(last + 1 - COALESCE(committable, 0) AS BIGINT) AS lag, pending FROM mark JOIN (SELECT topic, part, COUNT(*) FILTER (status = 'REGISTERED') AS pending FROM led GROUP BY ALL) USING (topic, part)"),
    "commit_map": _with(_LEDGER, "SELECT topic, part, committable FROM mark WHERE committable IS NOT NULL"),
    "drain_result": _with(_LEDGER, f"SELECT topic, part, COUNT(*) FILTER (status = 'REGISTERED') = 0 AS all_completed, COUNT(*) FILTER (status = 'DONE') AS completed, COUNT(*) FILTER (status = 'REGISTERED') AS abandoned, MAX(committable) AS committable FROM ({_MARKED}) GROUP BY topic, part"),
    "partition_counts": _with(_LEDGER, "SELECT topic, part, " + ", ".join(f"COUNT(*) FILTER (status = '{s}') AS {s.lower()}" for s in ("REGISTERED", "IN_PROGRESS", "DONE", "FAILED")) + " FROM led GROUP BY ALL"),
    "partition_lag": _with(_LEDGER, "SELECT topic, part, CAST(last + 1 - COALESCE(committable, 0) AS BIGINT) AS lag FROM mark"),
    "window_occupancy": _with(_LEDGER, "SELECT topic, part, COUNT(*) FILTER (gaps > 0) AS occupied, COUNT(*) FILTER (gaps > 0) >= 10000 AS is_full, COUNT(*) FILTER (status = 'FAILED') > 0 AS is_failed FROM led GROUP BY topic, part"),
    "retry_outcomes": _with(_OUTCOME, "SELECT topic, part, off, attempts, resolution = 'SUCCESS' AS success FROM outcome WHERE resolution <> 'HOOK_SKIP'"),
    "retry_counts": _with(_OUTCOME, "SELECT topic, part, CAST(SUM(CASE WHEN resolution = 'HOOK_SKIP' THEN 0 ELSE LEAST(fail_until, 3) END) AS BIGINT) AS retries FROM outcome GROUP BY ALL"),
    "backoff_schedule": f"SELECT CAST(a AS INT) AS attempt, CAST(100 AS BIGINT) AS fixed_ms, CAST({_EXP(0)} AS BIGINT) AS free_ms, CAST({_EXP(500)} AS BIGINT) AS capped_ms, CAST(0 AS BIGINT) AS zero_ms FROM range(-1, 51) t(a)",
    "error_attempts": _with(_OUTCOME, "SELECT topic, part, off, CAST(i AS INT) AS attempt FROM (SELECT *, UNNEST(range(0, LEAST(fail_until, 4))) AS i FROM outcome WHERE resolution <> 'HOOK_SKIP')"),
    "dlq_records": _with(_LEDGER, "SELECT topic, part, off, k, v, attempts, 'attempt ' || attempts || ' failed' AS last_error FROM led WHERE resolution = 'DLQ_SUCCESS'"),
    "skipped_records": _with(_LEDGER, "SELECT topic, part, off, resolution FROM led WHERE resolution IN ('SKIP', 'HOOK_SKIP')"),
    "in_flight": _with(
        _LOG,
        """, d AS (SELECT event_id * 2 AS seq, CAST(1 AS BIGINT) AS records, bytes FROM plog UNION ALL SELECT event_id * 2 + 5, -1, -bytes FROM plog)
 SELECT seq, records, CAST(SUM(records) OVER w AS BIGINT) AS in_flight, CAST(SUM(bytes) OVER w AS BIGINT) AS in_flight_bytes FROM d WINDOW w AS (ORDER BY seq, records ROWS UNBOUNDED PRECEDING)""",
    ),
    "record_count_sensor": _with(_SAMPLES, f"SELECT event_id, records, {_R} AS status FROM samples"),
    "byte_size_sensor": _with(_SAMPLES, f"SELECT event_id, bytes, {_B} AS status FROM samples"),
    "ratio_sensor": _with(_SAMPLES, f"SELECT event_id, ratio, {_H} AS status FROM samples"),
    "worst_status": _with(_SENSED, "SELECT event_id, status FROM sensed"),
    "status_summary": _with(
        _SENSED,
        f"""SELECT event_id, 'backpressure{{records=' || records || '/100 in-flight' || CASE WHEN r <> 'OK' THEN ' [throttled]' ELSE '' END || ', bytes=' || {_size("bytes")} || '/200B' || CASE WHEN b <> 'OK' THEN ' [throttled]' ELSE '' END
 || ', heap=' || printf('%.1f', ratio * 100.0) || '%/70% heap' || CASE WHEN h <> 'OK' THEN ' [throttled]' ELSE '' END || '}}' AS summary FROM sensed""",
    ),
    "throttle_transitions": _with(_SENSED, "SELECT event_id, status FROM (SELECT *, COALESCE(LAG(status) OVER (ORDER BY event_id), 'OK') AS was FROM sensed) WHERE status <> 'OK' AND was = 'OK'"),
    "metrics_snapshot": _with(
        _LEDGER,
        """SELECT COUNT(*) FILTER (resolution = 'SUCCESS') AS records_processed, COUNT(*) FILTER (resolution = 'FAIL_PARTITION') AS records_failed, COUNT(*) FILTER (resolution IN ('SKIP', 'HOOK_SKIP')) AS records_skipped,
 CAST(COALESCE(SUM(CASE WHEN resolution NOT IN ('HELD', 'HOOK_SKIP') THEN attempts - 1 END), 0) AS BIGINT) AS retries, COUNT(*) FILTER (resolution = 'DLQ_SUCCESS') AS dlq_ok, COUNT(*) FILTER (resolution IN ('SKIP', 'FAIL_PARTITION')) AS dlq_failed,
 COUNT(DISTINCT CASE WHEN status = 'FAILED' THEN topic || part END) AS failed_partitions, COUNT(DISTINCT topic || part) AS assigned_partitions, COUNT(DISTINCT topic || part || '/' || floor(off / 500)) AS polls,
 (SELECT CAST(SUM(last + 1 - COALESCE(committable, 0)) AS BIGINT) FROM mark) AS total_lag FROM led""",
    ),
    "assigned_partitions": _with(_LOG, "SELECT string_agg(x, ',' ORDER BY x) AS partitions, COUNT(*) AS n FROM (SELECT DISTINCT topic || '-' || part AS x FROM plog)"),
    "metrics_rate": _with(
        _LEDGER,
        """SELECT snap, CAST(SUM(done) OVER (ORDER BY snap ROWS UNBOUNDED PRECEDING) AS BIGINT) AS processed, CASE WHEN took > 0 THEN done * 1000000.0::DOUBLE / took END AS per_second FROM (
 SELECT *, epoch_us(tip) - LAG(epoch_us(tip)) OVER (ORDER BY snap) AS took FROM (SELECT CAST(floor(event_id / 1000) AS BIGINT) AS snap, COUNT(*) FILTER (resolution = 'SUCCESS') AS done, MAX(ts) AS tip FROM led GROUP BY ALL))""",
    ),
    "avg_poll_size": _with(_LEDGER, "SELECT processed, polls, CASE WHEN polls > 0 THEN processed / polls END AS average FROM (SELECT COUNT(*) FILTER (resolution = 'SUCCESS') AS processed, COUNT(DISTINCT topic || part || '/' || floor(off / 500)) AS polls FROM led)"),
    "record_bytes": _with(_LOG, "SELECT topic, part, off, bytes FROM plog"),
    "format_bytes": f"SELECT event_id, n, {_size('n')} AS text FROM (SELECT event_id, event_id * event_id * 7919 AS n FROM events)",
    # Here ranges come in ascending order, so one overlaps those before it if it begins at or below the highest accepted offset.
    "register_batches": "WITH RECURSIVE "
    + _LOG
    + """, polls AS (SELECT topic, part, CAST(floor(off / 50) AS BIGINT) AS n, MIN(off) AS a, MAX(off) AS b FROM plog GROUP BY ALL),
 calls AS (SELECT topic, part, n * 4 AS seq, CASE WHEN n % 11 = 5 THEN b + 1 ELSE a END AS first_off, CASE WHEN n % 11 = 5 THEN a ELSE b END AS last_off FROM polls
  UNION ALL SELECT topic, part, n * 4 + 1, a, b FROM polls WHERE n % 7 = 3 UNION ALL SELECT topic, part, n * 4 + 2, a + 1, b + 1 FROM polls WHERE n % 13 = 6),
 numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY topic, part ORDER BY seq) AS i FROM calls),
 walk AS (SELECT topic, part, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS first_off, CAST(NULL AS BIGINT) AS last_off, CAST('' AS VARCHAR) AS verdict, CAST(0 AS BIGINT) AS held, CAST(-1 AS BIGINT) AS top FROM (SELECT DISTINCT topic, part FROM plog)
  UNION ALL SELECT topic, part, i, seq, a, b, v, CASE WHEN v = 'ACCEPTED' THEN held + b - a + 1 ELSE held END, CASE WHEN v = 'ACCEPTED' THEN b ELSE top END FROM (
   SELECT w.topic, w.part, x.i, x.seq, x.first_off AS a, x.last_off AS b, w.held, w.top,
    CASE WHEN x.first_off > x.last_off THEN 'EMPTY_RANGE' WHEN w.held + x.last_off - x.first_off + 1 > 10000 THEN 'FULL' WHEN x.first_off <= w.top THEN 'DUPLICATE' ELSE 'ACCEPTED' END AS v
   FROM walk w JOIN numbered x ON x.topic = w.topic AND x.part = w.part AND x.i = w.i + 1))
 SELECT topic, part, seq, first_off, last_off, verdict FROM walk WHERE i > 0""",
    "batch_marks": _with(
        _LOG,
        """, m AS (SELECT topic, part, off, CASE WHEN (off // 10) % 5 = 4 THEN 'REGISTERED' WHEN off // 10 < 20 OR (off // 10) % 2 = 0 THEN 'DONE' ELSE 'IN_PROGRESS' END AS status FROM plog),
 c AS (SELECT topic, part, MIN(off) FILTER (status <> 'DONE') AS o FROM m GROUP BY ALL)
 SELECT topic, part, COUNT(*) FILTER (status = 'REGISTERED') AS registered, COUNT(*) FILTER (status = 'IN_PROGRESS') AS in_progress, COUNT(*) FILTER (status = 'DONE') AS done, CAST(0 AS BIGINT) AS failed,
  CAST(MAX(off) FILTER (o IS NULL OR off < o) + 1 AS BIGINT) AS committable FROM m JOIN c USING (topic, part) GROUP BY topic, part""",
    ),
    "init_partitions": _with(
        _LEDGER,
        """, s AS (SELECT 'events' AS topic, * FROM (VALUES (0, 0), (1, 100), (3, 1000000000), (9, 5)) t(part, base)),
 own AS (SELECT topic, part, base, off, SUM(CASE WHEN status <> 'DONE' THEN 1 ELSE 0 END) OVER (PARTITION BY topic, part ORDER BY off ROWS UNBOUNDED PRECEDING) AS g FROM led JOIN s USING (topic, part) WHERE off >= base)
 SELECT topic, CAST(part AS INT) AS part, CAST(base AS BIGINT) AS base, CAST(COALESCE(c, -1) AS BIGINT) AS committable, CAST(COALESCE(l + 1 - COALESCE(c, base), 0) AS BIGINT) AS lag
 FROM s LEFT JOIN (SELECT topic, part, MAX(off) AS l, MAX(off) FILTER (g = 0) + 1 AS c FROM own GROUP BY ALL) USING (topic, part)""",
    ),
    "clear_partitions": _with(_LEDGER, "SELECT topic, part, " + ", ".join(f"COUNT(*) FILTER (status = '{s}') AS {s.lower()}" for s in ("REGISTERED", "IN_PROGRESS", "DONE", "FAILED")) + " FROM led WHERE part NOT IN (1, 3) GROUP BY ALL"),
    "rebalances": _with(_LEDGER, "SELECT topic, part, COUNT(*) FILTER (status = 'DONE') AS completed, COUNT(*) FILTER (status <> 'DONE') AS abandoned, part = 3 AS drain_timeout FROM led WHERE part IN (1, 3) GROUP BY topic, part"),
    "full_metrics": _with(
        _LEDGER + ", " + _SENSED,
        """, lags AS (SELECT topic || '-' || part AS x, CAST(last + 1 - COALESCE(committable, 0) AS BIGINT) AS lag FROM mark WHERE part NOT IN (1, 3)),
 polls AS (SELECT topic, part, floor(off / 500) AS n, COUNT(*) FILTER (resolution <> 'HELD') AS live FROM led GROUP BY ALL)
 SELECT COUNT(*) FILTER (resolution = 'SUCCESS') AS records_processed, COUNT(*) FILTER (resolution = 'FAIL_PARTITION') AS records_failed, COUNT(*) FILTER (resolution IN ('SKIP', 'HOOK_SKIP')) AS records_skipped,
 (SELECT COUNT(*) FROM polls) AS poll_count, (SELECT COUNT(*) FROM polls WHERE live = 0) AS empty_poll_count,
 COUNT(*) FILTER (status <> 'DONE') AS in_flight_records, CAST(COALESCE(SUM(bytes) FILTER (status <> 'DONE'), 0) AS BIGINT) AS in_flight_bytes,
 (SELECT arg_max(status, event_id) FROM sensed) AS backpressure_status, (SELECT COUNT(*) FROM (SELECT status, COALESCE(LAG(status) OVER (ORDER BY event_id), 'OK') AS was FROM sensed) WHERE status <> 'OK' AND was = 'OK') AS throttle_count,
 (SELECT string_agg(x || '=' || lag, ',' ORDER BY x || '=' || lag) FROM lags) AS partition_lags, (SELECT string_agg(x, ',' ORDER BY x) FROM lags) AS assigned_partitions,
 CAST(COALESCE(SUM(CASE WHEN resolution NOT IN ('HELD', 'HOOK_SKIP') THEN attempts - 1 END), 0) AS BIGINT) AS retry_attempts, COUNT(*) FILTER (resolution = 'DLQ_SUCCESS') AS dlq_successes, COUNT(*) FILTER (resolution IN ('SKIP', 'FAIL_PARTITION')) AS dlq_failures,
 COUNT(DISTINCT CASE WHEN status = 'FAILED' THEN topic || part END) AS partition_failures,
 (SELECT COUNT(*) FILTER (event_id % 7 <> 0) FROM events WHERE event_id % 500 = 0) AS commit_successes, (SELECT COUNT(*) FILTER (event_id % 7 = 0) FROM events WHERE event_id % 500 = 0) AS commit_failures,
 CAST(2 AS BIGINT) AS rebalance_count, CAST(1 AS BIGINT) AS drain_timeouts, COUNT(*) FILTER (status <> 'DONE' AND part IN (1, 3)) AS records_abandoned FROM led""",
    ),
}
