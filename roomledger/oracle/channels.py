_RESULTS = """
, results AS (
  SELECT l.id, l.ota_configuration_id, c.ota_name, l.status <> 'failed' AS delivered,
         lower(c.ota_name) IN ('booking.com', 'booking_com', 'agoda', 'airbnb') AS supported,
         CASE lower(c.ota_name) WHEN 'agoda' THEN 'Agoda' WHEN 'airbnb' THEN 'Airbnb'
              ELSE 'Booking.com' END AS shown,
         l.sync_started_at, l.sync_completed_at
  FROM ota_sync_logs l JOIN ota_configurations c ON l.ota_configuration_id = c.id
  WHERE c.is_active)"""
_STATS = """
SELECT c.ota_name, count(l.id) AS total_syncs,
  count(*) FILTER (WHERE l.status = 'success') AS successful_syncs,
  count(*) FILTER (WHERE l.status = 'failed') AS failed_syncs,
  max(l.sync_started_at) AS last_sync_at,
  CAST(sum(l.records_processed) AS BIGINT) AS total_records_processed
FROM ota_configurations c LEFT JOIN ota_sync_logs l ON c.id = l.ota_configuration_id
WHERE c.is_active {} GROUP BY c.id, c.ota_name"""

SQL = {
    "channel_configs": ("ota_configurations", "SELECT * FROM ota_configurations"),
    "sync_logs": (
        "ota_sync_logs ota_configurations",
        """
SELECT l.*, c.ota_name
FROM ota_sync_logs l JOIN ota_configurations c ON l.ota_configuration_id = c.id
ORDER BY l.sync_started_at DESC, l.id DESC LIMIT 50 OFFSET 50""",
    ),
    "failed_syncs": (
        "ota_sync_logs ota_configurations",
        """
SELECT ota_name, count(*) AS failed_count
FROM ota_sync_logs l JOIN ota_configurations c ON l.ota_configuration_id = c.id
WHERE status = 'failed' AND sync_started_at >= TIMESTAMP '2024-01-30'
GROUP BY c.id, ota_name""",
    ),
    "sync_stats": (
        "ota_sync_logs ota_configurations",
        _STATS.format("AND l.sync_started_at >= TIMESTAMP '2024-01-24'"),
    ),
    "sync_stats_all": ("ota_sync_logs ota_configurations", _STATS.format("")),
    "append_sync_log": (
        "ota_sync_logs ota_configurations rooms",
        f"""{_RESULTS}
SELECT id, ota_configuration_id, 'availability' AS sync_type,
  CASE WHEN supported AND delivered THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN NOT supported THEN 'Unsupported OTA: ' || ota_name
       WHEN delivered THEN shown || ' ARI sync completed successfully'
       ELSE shown || ' sync failed' END AS message,
  sync_started_at, sync_completed_at,
  CAST(CASE WHEN supported THEN (SELECT count(*) FROM rooms WHERE is_active) ELSE 0 END AS INTEGER)
    AS records_processed,
  supported AS moves_clock
FROM results""",
    ),
    "append_sync_log_last_sync": (
        "ota_sync_logs ota_configurations",
        f"""{_RESULTS}
SELECT c.id, c.ota_name, max(r.sync_completed_at) FILTER (WHERE supported) AS last_sync_at
FROM ota_configurations c LEFT JOIN results r ON r.ota_configuration_id = c.id
GROUP BY c.id, c.ota_name""",
    ),
    "sync_run_summary": (
        "ota_sync_logs ota_configurations",
        f"""{_RESULTS}
SELECT count(*) AS total_otas, count(*) FILTER (WHERE supported AND delivered)
  AS successful_syncs, count(*) FILTER (WHERE NOT (supported AND delivered)) AS failed_syncs
FROM results""",
    ),
    "request_rate": (
        "",
        """
SELECT user_id AS client_id, time_bucket(INTERVAL '15 minutes', ts) AS window_start,
  count(*) AS requests, count(*) > 1 AS over_limit
FROM events GROUP BY 1, 2""",
    ),
    "sync_health_stream": (
        "ota_sync_logs",
        """
SELECT ota_configuration_id, time_bucket(INTERVAL '1 hour', sync_started_at) AS window_start,
  count(*) AS total_syncs, count(*) FILTER (WHERE status = 'failed') AS failed_syncs,
  CAST(sum(records_processed) AS BIGINT) AS records_processed
FROM ota_sync_logs GROUP BY 1, 2""",
    ),
}
