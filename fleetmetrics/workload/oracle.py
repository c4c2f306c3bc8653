"""The registered queries as plain SQL over the same tables, for an independent engine.

Averages are formed from whole numbers: each double is cut into its floor and the rest times
2**96, both are summed as 128-bit integers, and one division ends it.
"""

from __future__ import annotations

_TWO_48, _TWO_96 = 1 << 48, 1 << 96


def _case(metric: str) -> str:
    return f"CASE WHEN metric_name = '{metric}' THEN value END"


def _mean(x: str, n: str) -> str:
    """The exact sum of ``x`` over a group, divided by ``n``."""
    low = f"sum(((({x}) - floor({x})) * {_TWO_96}.0::DOUBLE)::HUGEINT)"
    whole = f"(sum(floor({x})::HUGEINT) + {low} // {_TWO_96}::HUGEINT)"
    part = f"({low} % {_TWO_96}::HUGEINT)"
    over = f"((({whole} % {n}) + {n}) % {n})"
    fraction = (
        f"(({part} // {_TWO_48}::HUGEINT)::DOUBLE / {_TWO_48}.0::DOUBLE"
        f" + ({part} % {_TWO_48}::HUGEINT)::DOUBLE / {_TWO_48}.0::DOUBLE / {_TWO_48}.0::DOUBLE)"
    )
    return f"((({whole} - {over}) // {n})::DOUBLE + ({over}::DOUBLE + {fraction}) / ({n})::DOUBLE)"


def _round(x: str, decimals: int) -> str:
    """SQL ROUND, but for doubles that have no digit left to round."""
    return f"CASE WHEN abs({x}) * {10**decimals} < 4503599627370496 THEN round({x}, {decimals}) ELSE {x} END"


def _avg(metric: str, decimals: int) -> str:
    x = _case(metric)
    return f"CASE WHEN count({x}) > 0 THEN {_round(_mean(x, f'greatest(count({x}), 1)'), decimals)} END"


def _dev(metric: str, decimals: int) -> str:
    return f"round(stddev_samp({_case(metric)}), {decimals})"


def _max(metric: str, decimals: int) -> str:
    return f"round(max({_case(metric)}), {decimals})"


def _min(metric: str, decimals: int) -> str:
    return f"round(min({_case(metric)}), {decimals})"


def _even(x: str, decimals: int) -> str:
    """Half-to-even rounding of the exact value of a double: product plus its exact error."""
    s = f"{10**decimals}.0::DOUBLE"
    split = f"({x} * 134217729.0::DOUBLE)"
    high = f"({split} - ({split} - {x}))"
    product = f"({x} * {s})"
    error = f"(({high} * {s} - {product}) + ({x} - {high}) * {s})"
    return (
        f"(CASE WHEN {product} - floor({product}) = 0.5 AND {error} > 0 THEN floor({product}) + 1 "
        f"WHEN {product} - floor({product}) = 0.5 AND {error} < 0 THEN floor({product}) "
        f"ELSE round_even({product}, 0) END / {s})"
    )


_METRIC = """
CASE event_type
  WHEN 'click' THEN 'CPUUtilization'
  WHEN 'view' THEN 'DatabaseConnections'
  WHEN 'purchase' THEN CASE event_id % 2 WHEN 0 THEN 'ReadIOPS' ELSE 'ReadLatency' END
  WHEN 'signup' THEN CASE event_id % 2 WHEN 0 THEN 'WriteIOPS' ELSE 'WriteLatency' END
  ELSE CASE event_id % 4 WHEN 0 THEN 'DiskQueueDepth' WHEN 1 THEN 'AuroraReplicaLag'
       WHEN 2 THEN 'FreeableMemory' ELSE 'FreeStorageSpace' END
END"""

_CURATED = f"""
SELECT 'u' || user_id AS resource_id,
       CASE user_id % 3 WHEN 0 THEN 'aurora-mysql' WHEN 1 THEN 'mysql' ELSE 'postgres' END AS engine,
       CASE user_id % 2 WHEN 0 THEN 'writer' ELSE 'reader' END AS cluster_role,
       {_METRIC} AS metric_name, ts AS metric_timestamp, value, CAST(ts AS DATE) AS date
FROM events"""

_HEALTH = f"""
  {_avg('CPUUtilization', 2)} AS cpu_avg, {_max('CPUUtilization', 2)} AS cpu_max,
  {_min('FreeableMemory', 0)} AS freeable_memory_min_bytes,
  {_avg('DatabaseConnections', 2)} AS connections_avg, {_max('DatabaseConnections', 2)} AS connections_max,
  {_avg('ReadLatency', 4)} AS read_latency_avg, {_avg('WriteLatency', 4)} AS write_latency_avg,
  {_avg('ReadIOPS', 2)} AS read_iops_avg, {_avg('WriteIOPS', 2)} AS write_iops_avg,
  {_avg('DiskQueueDepth', 2)} AS disk_queue_depth_avg,
  {_max('AuroraReplicaLag', 2)} AS aurora_replica_lag_max,
  {_min('FreeStorageSpace', 0)} AS free_storage_space_min_bytes"""

_LIVE = f"""
  {_avg('CPUUtilization', 4)} AS cpu_avg, {_max('CPUUtilization', 4)} AS cpu_max,
  {_min('FreeableMemory', 4)} AS freeable_memory_min_bytes,
  {_avg('DatabaseConnections', 4)} AS connections_avg, {_max('DatabaseConnections', 4)} AS connections_max,
  {_avg('ReadLatency', 4)} AS read_latency_avg, {_avg('WriteLatency', 4)} AS write_latency_avg,
  {_avg('ReadIOPS', 4)} AS read_iops_avg, {_avg('WriteIOPS', 4)} AS write_iops_avg,
  {_avg('DiskQueueDepth', 4)} AS disk_queue_depth_avg,
  {_max('AuroraReplicaLag', 4)} AS aurora_replica_lag_max,
  {_min('FreeStorageSpace', 4)} AS free_storage_space_min_bytes"""

_BASELINE = f"""
  {_avg('CPUUtilization', 4)} AS cpu_avg_baseline, {_dev('CPUUtilization', 4)} AS cpu_stddev_baseline,
  {_avg('DatabaseConnections', 4)} AS connections_avg_baseline,
  {_dev('DatabaseConnections', 4)} AS connections_stddev_baseline,
  {_avg('ReadLatency', 4)} AS read_latency_avg_baseline, {_avg('WriteLatency', 4)} AS write_latency_avg_baseline,
  {_avg('ReadIOPS', 4)} AS read_iops_avg_baseline, {_avg('WriteIOPS', 4)} AS write_iops_avg_baseline,
  {_avg('DiskQueueDepth', 4)} AS disk_queue_depth_avg_baseline,
  {_avg('AuroraReplicaLag', 4)} AS aurora_replica_lag_avg_baseline,
  {_max('AuroraReplicaLag', 4)} AS aurora_replica_lag_max_baseline,
  {_avg('FreeableMemory', 4)} AS freeable_memory_avg_baseline_bytes,
  {_avg('FreeStorageSpace', 4)} AS free_storage_space_avg_baseline_bytes"""

_DEVIATIONS = """
  CASE WHEN cpu_stddev_baseline > 0
       THEN round((cpu_avg - cpu_avg_baseline) / cpu_stddev_baseline, 4) END AS cpu_deviation,
  CASE WHEN connections_stddev_baseline > 0
       THEN round((connections_avg - connections_avg_baseline) / connections_stddev_baseline, 4) END
       AS connections_deviation"""

_SNAPSHOT_SQL = f"""
SELECT resource_id, engine, cluster_role, {_HEALTH}
FROM ({_CURATED}) WHERE date = DATE '2024-01-20' GROUP BY resource_id, engine, cluster_role"""

_BASELINE_SQL = f"""
SELECT resource_id, {_BASELINE}
FROM ({_CURATED}) WHERE date BETWEEN DATE '2024-01-13' AND DATE '2024-01-20' GROUP BY resource_id"""

_LIVE_SQL = f"""
SELECT resource_id, {_LIVE}
FROM ({_CURATED})
WHERE metric_timestamp > TIMESTAMP '2024-01-19 12:00:00' AND metric_timestamp <= TIMESTAMP '2024-01-20 12:00:00'
GROUP BY resource_id"""

_PERIODS = f"""
SELECT user_id, CAST(period_start AS DATE) AS day, metric_name, period_start,
       {{even}} AS point_value
FROM (SELECT user_id, {_METRIC} AS metric_name, time_bucket(INTERVAL 5 MINUTE, ts) AS period_start,
             avg(value) AS v
      FROM events GROUP BY ALL)""".format(even=_even("v", 4))

_RESPONSE_METRICS = """
(VALUES ('CPUUtilization','Average','Percent'), ('DatabaseConnections','Average','Count'),
        ('ReadIOPS','Average','Count/Second'), ('ReadLatency','Average','Seconds'),
        ('WriteIOPS','Average','Count/Second'), ('WriteLatency','Average','Seconds'),
        ('DiskQueueDepth','Average','Count'), ('AuroraReplicaLag','Maximum','Milliseconds'),
        ('FreeableMemory','Minimum','Bytes'), ('FreeStorageSpace','Minimum','Bytes'))
 AS m(metric_name, statistic, unit)"""

_CURATED_FILES_SQL = f"""
SELECT '000000000001' AS account_id, 'ap-northeast-2' AS region, day AS date,
       strftime(period_start, '%H') AS hour, 'u' || user_id AS resource_id, metric_name,
       period_start AS metric_timestamp, point_value AS value,
       CASE user_id % 3 WHEN 0 THEN 'aurora-mysql' WHEN 1 THEN 'mysql' ELSE 'postgres' END AS engine
FROM ({_PERIODS})"""

_FLAWED = """
SELECT 'o' || o_orderkey AS source_file,
       CASE o_orderstatus WHEN 'P' THEN '  ' WHEN 'O' THEN '000000000001'
            ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE '000000000001' END END AS account_id,
       CASE WHEN o_orderpriority = '2-HIGH' THEN '' ELSE 'c' || o_custkey END AS resource_id,
       CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' THEN NULL ELSE 'CPUUtilization' END AS metric_name,
       o_orderpriority = '5-LOW' AND o_orderstatus = 'F' AS late,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O' THEN 'n/a'
            WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN NULL
            ELSE CAST(o_totalprice AS VARCHAR) END AS value_text,
       o_totalprice, o_orderdate, o_orderstatus
FROM orders"""

_GUARDED = f"""
SELECT *, CASE WHEN account_id IS NULL THEN 'Missing source_account_id'
               WHEN trim(account_id) = '' THEN 'Empty source_account_id'
               WHEN trim(resource_id) = '' THEN 'Empty resource_id'
               WHEN metric_name IS NULL THEN 'Missing metric_name'
               WHEN late THEN 'Invalid collected_at'
               WHEN value_text IS NULL THEN 'Missing datapoint.value'
               WHEN value_text = 'n/a' THEN 'Invalid datapoint.value' END AS reject_reason,
       TRY_CAST(value_text AS DOUBLE) AS value
FROM ({_FLAWED})"""

_STORAGE_SERIES = """
SELECT 's' || l_suppkey AS resource_id, date, l_suppkey % 2 = 1 AS odd,
       sum(quantity) OVER (PARTITION BY l_suppkey ORDER BY date) AS used
FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS quantity
      FROM lineitem GROUP BY 1, 2)"""

_STORAGE_HISTORY_SQL = f"""
SELECT resource_id, date,
       CASE WHEN NOT odd THEN (20000 - used) * 1048576 END AS free_storage_space_bytes,
       CASE WHEN odd THEN used * 1048576 END AS volume_bytes_used
FROM ({_STORAGE_SERIES})"""


def _forecast_sql(anchor: str, bounds: str = "true", days: str = "", also: str = "") -> str:
    """The forecast; ``days`` joins a table of report days, and ``also`` names its column."""
    # Bytes are whole numbers of at most 50 bits here, so whole-number sums are exact.
    return f"""
WITH points AS (
  SELECT resource_id, {also} date, coalesce(free_storage_space_bytes, volume_bytes_used) AS bytes,
         CASE WHEN free_storage_space_bytes IS NOT NULL THEN 'FreeStorageSpace' ELSE 'VolumeBytesUsed' END AS metric,
         date_diff('day', DATE '{anchor}', date) AS x
  FROM ({_STORAGE_HISTORY_SQL}) {days} WHERE {bounds}),
fitted AS (
  SELECT resource_id, {also} arg_max(metric, date) AS storage_metric, count(*) AS history_days,
         max(date) AS latest_date, arg_max(bytes, date) AS latest_value_bytes, max(x) AS last_x,
         count(*)::HUGEINT AS n, sum(x)::HUGEINT AS sx, sum(x * x)::HUGEINT AS sxx,
         sum(bytes::HUGEINT) AS sy, sum(x * bytes::HUGEINT) AS sxy
  FROM points GROUP BY ALL),
lines AS (
  SELECT *, n * sxy - sx * sy AS rise, n * sxx - sx * sx AS run,
         coalesce((n * sxy - sx * sy)::DOUBLE / nullif((n * sxx - sx * sx)::DOUBLE, 0), 0) AS slope
  FROM fitted),
zeroed AS (
  SELECT *, CASE WHEN history_days >= 3 AND storage_metric = 'FreeStorageSpace' AND slope < 0
    THEN greatest(round_even(((sx - n * last_x) * rise - run * sy)::DOUBLE
                  / nullif(rise::DOUBLE * n::DOUBLE, 0), 0), 0)::BIGINT
    END AS days FROM lines)
SELECT resource_id, {also} storage_metric, history_days::INTEGER AS history_days, latest_date, latest_value_bytes,
       CASE WHEN history_days >= 3 THEN {_even('slope', 2)} END AS trend_bytes_per_day,
       CASE WHEN days <= date_diff('day', latest_date, DATE '9999-12-31')
            THEN latest_date + days::INTEGER END AS projected_exhaustion_date,
       days AS days_until_exhaustion,
       CASE WHEN history_days < 3 THEN 'insufficient_history' END AS forecast_note,
       {_even('(latest_value_bytes / 1073741824)', 2)} AS latest_value_gb,
       CASE WHEN history_days >= 3 THEN {_even(f'({_even('slope', 2)} / 1073741824)', 4)} END AS trend_gb_per_day
FROM zeroed"""


_FORECAST_SQL = _forecast_sql("1998-05-31", "date BETWEEN DATE '1998-05-31' AND DATE '1998-06-30'")

_MONTH_SQL = f"""
SELECT resource_id, strftime(date, '%Y-%m') AS month, engine, cluster_role,
       count(DISTINCT date)::INTEGER AS active_days,
       {_avg('CPUUtilization', 4)} AS cpu_avg, {_max('CPUUtilization', 4)} AS cpu_max,
       {_avg('DatabaseConnections', 4)} AS connections_avg, {_max('DatabaseConnections', 4)} AS connections_max,
       {_avg('ReadLatency', 4)} AS read_latency_avg, {_avg('WriteLatency', 4)} AS write_latency_avg,
       {_avg('ReadIOPS', 4)} AS read_iops_avg, {_avg('WriteIOPS', 4)} AS write_iops_avg,
       {_avg('DiskQueueDepth', 4)} AS disk_queue_depth_avg,
       {_max('AuroraReplicaLag', 4)} AS aurora_replica_lag_max,
       {_min('FreeableMemory', 4)} AS freeable_memory_min_bytes,
       {_min('FreeStorageSpace', 4)} AS free_storage_space_min_bytes,
       {_max('VolumeBytesUsed', 4)} AS volume_bytes_used_max
FROM (
  SELECT CAST(o_orderdate AS DATE) AS date, 'n' || c_nationkey || '-' || lower(c_mktsegment) AS resource_id,
         CASE o_orderstatus WHEN 'P' THEN 'postgres' ELSE 'mysql' END AS engine,
         CASE o_orderstatus WHEN 'O' THEN 'writer' ELSE 'reader' END AS cluster_role,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'CPUUtilization' WHEN '2-HIGH' THEN 'DatabaseConnections'
              WHEN '3-MEDIUM' THEN 'ReadIOPS' WHEN '4-NOT SPECIFIED' THEN 'FreeStorageSpace'
              ELSE 'VolumeBytesUsed' END AS metric_name,
         o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey)
WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-02-28'
GROUP BY resource_id, month, engine, cluster_role"""

_COMPARED = (
    "cpu_avg",
    "cpu_max",
    "connections_avg",
    "connections_max",
    "read_latency_avg",
    "write_latency_avg",
    "read_iops_avg",
    "write_iops_avg",
    "disk_queue_depth_avg",
)


def _month_pair(column: str) -> str:
    change = f"((n.{column} - p.{column}) / abs(p.{column}) * 100)"
    pct = f"CASE WHEN p.{column} <> 0 THEN {_even(change, 1)} END"
    return (
        f"n.{column} AS {column}, p.{column} AS {column}_previous, {pct} AS {column}_change_pct, "
        f"abs({pct}) >= 10 AS {column}_notable"
    )


_MONTHLY_SQL = f"""
WITH rows_ AS (
  SELECT *, row_number() OVER (PARTITION BY resource_id, month
      ORDER BY active_days DESC, cluster_role DESC, engine DESC) AS pick
  FROM ({_MONTH_SQL})),
n AS (SELECT * FROM rows_ WHERE pick = 1 AND month = '1998-02'),
p AS (SELECT * FROM rows_ WHERE pick = 1 AND month = '1998-01')
SELECT coalesce(n.resource_id, p.resource_id) AS resource_id, '1998-02' AS month, '1998-01' AS previous_month,
       coalesce(n.engine, p.engine) AS engine, coalesce(n.cluster_role, p.cluster_role) AS cluster_role,
       coalesce(n.active_days, 0) AS active_days, 28 AS days_in_month,
       coalesce(p.active_days, 0) AS previous_active_days,
       CASE WHEN n.active_days IS NULL THEN 'no_data' WHEN n.active_days < 14 THEN 'partial_month' END AS coverage_note,
       {', '.join(_month_pair(c) for c in _COMPARED)},
       n.aurora_replica_lag_max, n.freeable_memory_min_bytes, n.free_storage_space_min_bytes,
       n.volume_bytes_used_max
FROM n FULL OUTER JOIN p ON n.resource_id = p.resource_id"""


def _month_text(column: str) -> str:
    return (
        f"'{column}=' || {column} || CASE WHEN {column}_previous IS NULL THEN '' "
        f"WHEN {column}_change_pct IS NULL THEN ' (prev=' || {column}_previous || ')' "
        f"ELSE ' (prev=' || {column}_previous || ', change=' || {column}_change_pct || '%)' END"
    )


_MONTHLY_TEXT_SQL = f"""
SELECT resource_id, concat_ws(', ', 'resource_id=' || resource_id, 'engine=' || engine,
  'cluster_role=' || cluster_role, 'active_days=' || active_days, 'days_in_month=' || days_in_month,
  'previous_active_days=' || previous_active_days, 'coverage_note=' || coalesce(coverage_note, 'None'),
  {', '.join(_month_text(c) for c in _COMPARED)},
  'free_storage_space_min_gb=' || {_even('(free_storage_space_min_bytes / 1073741824)', 2)},
  'volume_bytes_used_max_gb=' || {_even('(volume_bytes_used_max / 1073741824)', 2)}) AS line
FROM ({_MONTHLY_SQL})"""


def _loads(where: str) -> str:
    return f"""
SELECT resource_id, sql_id, sql_text, {_even('average', 4)} AS avg_active_sessions
FROM (SELECT resource_id, sql_id, sql_text, {_mean('value', 'max(samples)')} AS average FROM (
        SELECT 'u' || user_id AS resource_id, 'q' || (props ->> '$.k') AS sql_id,
               'select * from t' || (props ->> '$.k') || ' where id = ?' AS sql_text, value
        FROM events WHERE {where})
      JOIN (SELECT 'u' || user_id AS resource_id, count(DISTINCT ts) AS samples FROM events WHERE {where} GROUP BY 1)
      USING (resource_id) GROUP BY resource_id, sql_id, sql_text)"""


def _ranked(where: str) -> str:
    return f"""
SELECT resource_id, sql_id, sql_text, avg_active_sessions, rank, false AS sql_text_truncated
FROM (SELECT *, row_number() OVER (PARTITION BY resource_id
        ORDER BY avg_active_sessions DESC, sql_id, sql_text)::INTEGER AS rank FROM ({_loads(where)}))
WHERE rank <= 10"""


_WINDOW = "ts > TIMESTAMP '2024-01-19 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'"

_TOP_SQL = f"""
SELECT resource_id, sql_id, sql_text, avg_active_sessions, rank, sql_text_truncated,
       CASE WHEN total > 0 THEN {_even("(avg_active_sessions / total)", 4)} END AS load_share
FROM (SELECT *, sum(avg_active_sessions::DECIMAL(28,4)) OVER (PARTITION BY resource_id) AS total FROM ({_ranked(_WINDOW)}))"""

_TOTAL_SQL = f"""
SELECT *, CASE WHEN total_active_sessions < 1 THEN 'idle' END AS load_note
FROM (SELECT resource_id, t::DOUBLE AS total_active_sessions, ranked_statements
      FROM (SELECT resource_id, sum(avg_active_sessions::DECIMAL(28,4)) AS t, count(*) AS ranked_statements
            FROM ({_ranked(_WINDOW)}) GROUP BY resource_id))"""

_FINDINGS_SQL = """
SELECT 'u' || conv_id AS resource_id, (turn + 1)::INTEGER AS rank, trim(text, E' \\t\\n\\r') AS finding, role AS suggestion,
       CASE role WHEN 'user' THEN 'high' ELSE 'low' END AS confidence
FROM conversations WHERE role <> 'system' AND trim(text, E' \\t\\n\\r') <> ''"""

_INSTANCES = """
SELECT '00000000000' || (n_regionkey + 1) AS account_id,
       CASE WHEN n_nationkey % 2 = 1 THEN 'us-east-1' ELSE 'ap-northeast-2' END AS region, s_suppkey AS ordinal,
       s_name AS identifier, CASE WHEN s_acctbal <= 9000 THEN 'db-S' || s_suppkey END AS dbi_resource_id,
       CASE s_suppkey % 8 WHEN 0 THEN 'aurora-mysql' WHEN 1 THEN 'mysql' WHEN 2 THEN 'postgres'
            WHEN 3 THEN 'oracle-ee' WHEN 4 THEN 'sqlserver-ex' WHEN 5 THEN 'sqlserver-se'
            WHEN 6 THEN 'mariadb' END AS engine,
       '1' AS engine_version,
       CASE s_suppkey % 5 WHEN 0 THEN 'db.serverless' WHEN 1 THEN 'db.t3.medium' WHEN 2 THEN 'db.r6g.large'
            WHEN 3 THEN 'db.t4g.small' ELSE 'db.t2.micro' END AS instance_class,
       CASE s_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS availability_zone,
       CASE WHEN s_acctbal < 0 THEN 'stopped' ELSE 'available' END AS status,
       s_suppkey % 2 = 0 AS multi_az,
       CASE s_suppkey % 3 WHEN 0 THEN 'gp2' WHEN 1 THEN 'gp3' ELSE 'io1' END AS storage_type,
       s_suppkey % 4 <> 3 AS performance_insights_enabled,
       n_name AS cluster_identifier,
       CASE s_suppkey % 4 WHEN 0 THEN 'writer' ELSE 'reader' END AS cluster_role
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

_NAMES = """
SELECT DISTINCT lower(trim(name)) AS name FROM (
  SELECT substr(c_name, 9, 20) AS name FROM customer
  UNION ALL SELECT '  ' || upper(s_name) || ' ' FROM supplier
  UNION ALL SELECT lower(n_name) FROM nation
  UNION ALL SELECT substr(n_name, 2, 7) FROM nation
  UNION ALL SELECT p_name FROM part)"""


def _resolved(names: str) -> str:
    return f"""
SELECT name, account_id, region, tier, resource_id, position FROM (
  SELECT *, min(tier) OVER (PARTITION BY name, account_id, region) AS best FROM (
    SELECT name, account_id, region, 1 AS tier, identifier AS resource_id, NULL::BIGINT AS position
    FROM ({names}) JOIN ({_INSTANCES}) ON lower(identifier) = name
    UNION ALL
    SELECT name, account_id, region, 2, identifier, ordinal
    FROM ({names}) JOIN ({_INSTANCES}) ON lower(cluster_identifier) = name
    UNION ALL
    SELECT DISTINCT name, account_id, region, 3, identifier, NULL::BIGINT
    FROM ({names}) JOIN ({_INSTANCES}) ON contains(lower(cluster_identifier), name)
    UNION ALL
    SELECT name, account_id, region, 4, identifier, NULL::BIGINT
    FROM ({names}) JOIN ({_INSTANCES}) ON contains(lower(identifier), name)))
WHERE tier = best"""


_REQUESTS_SQL = r"""
WITH lines AS (
  SELECT 'o' || o_orderkey AS request_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'health' WHEN '2-HIGH' THEN 'storage' WHEN '3-MEDIUM' THEN 'topsql'
         WHEN '4-NOT SPECIFIED' THEN 'report' ELSE 'status' END AS command,
    CASE o_orderstatus WHEN 'O' THEN '#' || lpad(o_custkey::VARCHAR, 9, '0')
         WHEN 'F' THEN 'nation_' || (o_custkey % 25)
         ELSE ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE-EAST', 'nation'][(o_custkey % 6) + 1] END AS target,
    CASE WHEN day(o_orderdate) <= 5 THEN NULL WHEN day(o_orderdate) <= 10 THEN '30m'
         WHEN day(o_orderdate) <= 15 THEN '2h' WHEN day(o_orderdate) <= 20 THEN '30d'
         WHEN day(o_orderdate) <= 25 THEN strftime(o_orderdate, '%Y-%m')
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS argument
  FROM orders
  UNION ALL
  SELECT 'c-' || conv_id || '-' || turn, words[1], words[2], words[3]
  FROM (SELECT *, string_split_regex(trim(text, E' \t\n\r'), '\s+') AS words FROM conversations)),
valued AS (
  SELECT *, command IN ('health', 'storage', 'topsql', 'report') AND target IS NOT NULL AS usable,
    CASE command
      WHEN 'report' THEN CASE WHEN argument IS NULL THEN '2024-01'
           WHEN regexp_full_match(argument, '\d{4}-(0[1-9]|1[0-2])') THEN argument END
      WHEN 'storage' THEN CASE WHEN argument IS NULL THEN '30'
           WHEN regexp_full_match(argument, '\d+d') THEN rtrim(argument, 'd') END
      ELSE CASE WHEN argument IS NULL THEN CASE command WHEN 'topsql' THEN '10' ELSE '30' END
           WHEN regexp_full_match(argument, '\d+m') THEN rtrim(argument, 'm')::BIGINT::VARCHAR
           WHEN regexp_full_match(argument, '\d+h') THEN (rtrim(argument, 'h')::BIGINT * 60)::VARCHAR
           WHEN command = 'health' AND regexp_full_match(argument, '\d{4}-\d{2}-\d{2}') THEN argument END
    END AS v,
    CASE WHEN command <> 'health' THEN command
         WHEN regexp_full_match(argument, '\d{4}-\d{2}-\d{2}') THEN 'date' ELSE 'live' END AS m
  FROM lines)
SELECT request_id, CASE WHEN usable AND v IS NOT NULL THEN target END AS target,
       CASE WHEN usable AND v IS NOT NULL THEN m END AS mode,
       CASE WHEN usable AND v IS NOT NULL THEN v END AS value,
       CASE WHEN NOT coalesce(usable, false) THEN 'bad_usage' WHEN v IS NULL THEN 'bad_argument' ELSE 'ok' END AS status
FROM valued"""

_TARGETS = """
SELECT replace(r_name, ' ', '-') AS target_name, '00000000000' || (r_regionkey + 1) AS account_id
FROM region WHERE r_regionkey < 4"""

# Requests look at a target in the first of its regions.
_ASKED = """
SELECT replace(r_name, ' ', '-') AS target_name, '00000000000' || (r_regionkey + 1) AS account_id,
       CASE WHEN r_regionkey % 2 = 1 THEN 'us-east-1' ELSE 'ap-northeast-2' END AS region
FROM region WHERE r_regionkey < 4"""

_REQUEST_NAMES = f"SELECT DISTINCT lower(target) AS name FROM ({_REQUESTS_SQL}) WHERE status = 'ok'"

# The instance's own cluster only: one supplier in three names none.
_OWN_CLUSTER = """
SELECT s_name AS identifier, n_name AS cluster_identifier FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE s_suppkey % 3 <> 0"""

_SCOPE_SQL = f"""
WITH parsed AS ({_REQUESTS_SQL}), t AS ({_ASKED}),
ids AS (SELECT r.name, r.account_id, r.region, t.target_name, r.resource_id
        FROM ({_resolved(_REQUEST_NAMES)}) r JOIN t USING (account_id, region)),
counts AS (SELECT name, count(DISTINCT account_id) AS matches, min(account_id) AS account_id, min(region) AS region,
                  min(target_name) AS target_name FROM ids GROUP BY name),
settled AS (
  SELECT p.*, t.account_id AS named, t.region AS named_region, c.account_id AS found, c.region AS found_region, c.target_name AS found_name,
    CASE WHEN p.status <> 'ok' THEN p.status
         WHEN t.account_id IS NOT NULL AND p.mode IN ('live', 'topsql')
              AND t.account_id || t.region NOT IN (SELECT account_id || region FROM ({_INSTANCES})) THEN 'no_instances'
         WHEN t.account_id IS NOT NULL THEN 'ok'
         WHEN c.matches IS NULL THEN 'not_found' WHEN c.matches > 1 THEN 'ambiguous' ELSE 'ok' END AS final
  FROM parsed p LEFT JOIN t ON p.target = t.target_name LEFT JOIN counts c ON lower(p.target) = c.name)"""

_SCOPES_SQL = f"""{_SCOPE_SQL}
SELECT request_id, target, mode, value,
       CASE WHEN final = 'ok' THEN coalesce(named, found) END AS account_id,
       CASE WHEN final = 'ok' THEN coalesce(named_region, found_region) END AS region,
       CASE WHEN final = 'ok' THEN CASE WHEN named IS NOT NULL THEN target ELSE found_name END END AS target_name,
       coalesce(final = 'ok' AND named IS NOT NULL AND mode NOT IN ('live', 'topsql'), false) AS all_resources,
       CASE WHEN final <> 'ok' THEN NULL
            WHEN named IS NULL THEN CASE WHEN mode IN ('storage', 'report') THEN 'clusters:' ELSE 'name:' END || lower(target)
            WHEN mode IN ('live', 'topsql') THEN 'account:' || named || ':' || named_region END AS scope,
       final AS status
FROM settled"""

_SCOPE_IDS_SQL = f"""{_SCOPE_SQL},
loose AS (SELECT DISTINCT s.mode IN ('storage', 'report') AS wide, i.name, i.account_id, i.region, i.resource_id
          FROM settled s JOIN ids i ON lower(s.target) = i.name WHERE s.final = 'ok' AND s.named IS NULL)
SELECT CASE WHEN wide THEN 'clusters:' ELSE 'name:' END || name AS scope, account_id, region, resource_id FROM loose
UNION
SELECT 'clusters:' || name, account_id, region, o.cluster_identifier FROM loose JOIN ({_OWN_CLUSTER}) o ON resource_id = o.identifier
WHERE wide
UNION
SELECT DISTINCT 'account:' || named || ':' || named_region, named, named_region, i.identifier
FROM settled s JOIN ({_INSTANCES}) i ON s.named = i.account_id AND s.named_region = i.region
WHERE s.final = 'ok' AND s.mode IN ('live', 'topsql')"""

_BASE_METRICS = """['CPUUtilization', 'DatabaseConnections', 'FreeableMemory', 'ReadIOPS', 'WriteIOPS', 'ReadLatency',
 'WriteLatency', 'ReadThroughput', 'WriteThroughput', 'DiskQueueDepth', 'NetworkReceiveThroughput',
 'NetworkTransmitThroughput']"""

_PLANNED = f"""
SELECT t.target_name, i.account_id, i.region, 'DBInstanceIdentifier' AS resource_dimension,
       identifier AS resource_id, engine, cluster_identifier, cluster_role,
       'operational-v1' AS metric_profile,
       CASE WHEN engine LIKE 'aurora%' THEN 'aurora-' || cluster_role
            WHEN engine IS NULL THEN 'rds-generic' ELSE 'rds-' || engine END AS resource_profile,
       list_concat({_BASE_METRICS}, string_split(concat_ws(',',
         CASE WHEN engine LIKE 'aurora%' AND instance_class <> 'db.serverless' THEN 'FreeLocalStorage' END,
         CASE WHEN engine LIKE 'aurora%' AND cluster_role = 'writer' THEN 'AuroraReplicaLagMaximum' END,
         CASE WHEN engine LIKE 'aurora%' AND cluster_role = 'reader' THEN 'AuroraReplicaLag' END,
         CASE WHEN coalesce(engine, '') NOT LIKE 'aurora%' THEN 'FreeStorageSpace' END,
         CASE WHEN engine IN ('mysql', 'mariadb') THEN 'BinLogDiskUsage' END,
         CASE WHEN engine = 'postgres' THEN 'TransactionLogsDiskUsage' END,
         CASE WHEN engine IN ('mysql', 'mariadb', 'postgres') OR engine LIKE 'oracle%' THEN 'SwapUsage' END,
         CASE WHEN engine LIKE 'sqlserver%' THEN 'TempDbAvailableDataSpace' END,
         CASE WHEN engine LIKE 'sqlserver%' THEN 'TempDbAvailableLogSpace' END,
         CASE WHEN engine LIKE 'sqlserver%' THEN 'TempDbDataFileUsage' END,
         CASE WHEN engine LIKE 'sqlserver%' THEN 'TempDbLogFileUsage' END,
         CASE WHEN engine LIKE 'sqlserver%' AND engine <> 'sqlserver-ex' THEN 'FailedSQLServerAgentJobsCount' END,
         CASE WHEN coalesce(engine, '') NOT LIKE 'aurora%' AND storage_type = 'gp2' THEN 'BurstBalance' END,
         CASE WHEN instance_class LIKE 'db.t2.%' OR instance_class LIKE 'db.t3.%' OR instance_class LIKE 'db.t4g.%'
              THEN 'CPUCreditBalance' END), ',')) AS metrics
FROM ({_INSTANCES}) i JOIN ({_TARGETS}) t USING (account_id)
WHERE status = 'available'
UNION ALL
SELECT t.target_name, account_id, CASE WHEN n_nationkey % 2 = 1 THEN 'us-east-1' ELSE 'ap-northeast-2' END, 'DBClusterIdentifier', n_name,
       CASE n_nationkey % 3 WHEN 0 THEN 'aurora-mysql' ELSE 'aurora-postgresql' END, n_name, 'cluster',
       'operational-v1', 'aurora-cluster', ['VolumeBytesUsed']
FROM (SELECT *, '00000000000' || (n_regionkey + 1) AS account_id FROM nation) JOIN ({_TARGETS}) t USING (account_id)
WHERE n_nationkey % 3 < 2 AND n_nationkey % 4 <> 3"""

_CATALOGUE = """
(VALUES ('CPUUtilization','Average','Percent'), ('DatabaseConnections','Average','Count'),
 ('FreeableMemory','Minimum','Bytes'), ('ReadIOPS','Average','Count/Second'), ('WriteIOPS','Average','Count/Second'),
 ('ReadLatency','Average','Seconds'), ('WriteLatency','Average','Seconds'),
 ('ReadThroughput','Average','Bytes/Second'), ('WriteThroughput','Average','Bytes/Second'),
 ('DiskQueueDepth','Average','Count'), ('NetworkReceiveThroughput','Average','Bytes/Second'),
 ('NetworkTransmitThroughput','Average','Bytes/Second'), ('FreeStorageSpace','Minimum','Bytes'),
 ('FreeLocalStorage','Minimum','Bytes'), ('VolumeBytesUsed','Average','Bytes'),
 ('AuroraReplicaLag','Maximum','Milliseconds'), ('AuroraReplicaLagMaximum','Maximum','Milliseconds'),
 ('BinLogDiskUsage','Maximum','Bytes'), ('TransactionLogsDiskUsage','Maximum','Bytes'),
 ('SwapUsage','Maximum','Bytes'), ('FailedSQLServerAgentJobsCount','Sum','Count'),
 ('TempDbAvailableDataSpace','Minimum','Bytes'), ('TempDbAvailableLogSpace','Minimum','Bytes'),
 ('TempDbDataFileUsage','Maximum','Percent'), ('TempDbLogFileUsage','Maximum','Percent'),
 ('CPUCreditBalance','Minimum','Count'), ('BurstBalance','Minimum','Percent')) AS c(metric_name, statistic, unit)"""

_PLAN_SQL = f"""
SELECT p.* EXCLUDE (metrics, metric_name, metric_pos), metric_pos::INTEGER AS metric_pos, metric_name, statistic, unit
FROM (SELECT *, unnest(metrics) AS metric_name, generate_subscripts(metrics, 1) - 1 AS metric_pos
      FROM ({_PLANNED})) p JOIN {_CATALOGUE} USING (metric_name)"""

_HEALTH_TEXT_COLUMNS = (
    "resource_id",
    "engine",
    "cluster_role",
    "cpu_avg",
    "cpu_max",
    "freeable_memory_min_bytes",
    "connections_avg",
    "connections_max",
    "read_latency_avg",
    "write_latency_avg",
    "read_iops_avg",
    "write_iops_avg",
    "disk_queue_depth_avg",
    "aurora_replica_lag_max",
    "free_storage_space_min_bytes",
)

_FORECAST_TEXT_COLUMNS = (
    "resource_id",
    "storage_metric",
    "history_days",
    "latest_date",
    "latest_value_gb",
    "trend_gb_per_day",
    "projected_exhaustion_date",
    "days_until_exhaustion",
    "forecast_note",
)


def _spelled(columns: tuple[str, ...]) -> str:
    return "concat_ws(', ', " + ", ".join(
        f"'{c}=' || coalesce({c}::VARCHAR, 'None')" for c in columns
    ) + ")"


_SUMMARY_SQL = f"""
WITH t AS ({_TARGETS}), where_ AS (SELECT *, unnest(['ap-northeast-2', 'us-east-1']) AS region FROM t),
i AS ({_INSTANCES}), p AS ({_PLAN_SQL})
SELECT w.target_name, w.account_id, w.region,
  (SELECT count(*) FROM nation WHERE '00000000000' || (n_regionkey + 1) = w.account_id
     AND CASE WHEN n_nationkey % 2 = 1 THEN 'us-east-1' ELSE 'ap-northeast-2' END = w.region) AS cluster_count,
  (SELECT count(*) FROM i WHERE i.account_id = w.account_id AND i.region = w.region) AS instance_count,
  (SELECT count(*) FROM i WHERE i.account_id = w.account_id AND i.region = w.region AND i.status = 'available')
    AS selected_instance_count,
  (SELECT count(*) FROM p WHERE p.account_id = w.account_id AND p.region = w.region) AS uploaded_count
FROM where_ w"""

ORACLES: dict[str, str] = {
    "dedup_latest": f"""
SELECT resource_id, metric_name, metric_timestamp, value, collected_at, source_file FROM (
  SELECT 'u' || user_id AS resource_id, {_METRIC} AS metric_name, ts AS metric_timestamp, value + plus AS value,
         ts + to_minutes(minutes) AS collected_at, file AS source_file,
         row_number() OVER (PARTITION BY user_id, metric_name, ts
           ORDER BY ts + to_minutes(minutes) DESC, string_split(file, '/')) AS pick
  FROM (SELECT *, (props ->> '$.k')::INTEGER AS minutes, 0.0::DOUBLE AS plus, 'b/first.json' AS file FROM events
        UNION ALL SELECT *, 50, 1.0, 'a/second.json' FROM events
        UNION ALL SELECT *, 50, 2.0, 'a-b/third.json' FROM events))
WHERE pick = 1""",
    "required_guard": f"SELECT source_file, account_id, resource_id, value, reject_reason FROM ({_GUARDED})",
    "flatten_valid": f"""
SELECT source_file, account_id, 'ap-northeast-2' AS region, CAST(o_orderdate AS DATE) AS date,
       strftime(o_orderdate, '%H') AS hour, resource_id, metric_name, o_orderdate AS metric_timestamp, value
FROM ({_GUARDED}) WHERE reject_reason IS NULL""",
    "curate_stats": f"""
WITH points AS ({_PERIODS}),
asked AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)
SELECT (SELECT count(*) * 10 FROM asked) AS raw_payload_count,
       (SELECT count(*) * 10 FROM asked) - (SELECT count(DISTINCT (user_id, day, metric_name)) FROM points)
         AS no_data_payload_count,
       (SELECT count(*) FROM points) AS raw_datapoint_count,
       (SELECT count(*) FROM points) AS curated_row_count,
       (SELECT count(DISTINCT date_trunc('hour', period_start)) FROM points) AS partition_count,
       0::BIGINT AS rejected_count, 0::BIGINT AS duplicates_removed""",
    "response_datapoints": f"""
WITH points AS ({_PERIODS}),
asked AS (SELECT user_id, day, metric_name, statistic, unit
          FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), {_RESPONSE_METRICS})
SELECT 'u' || a.user_id AS resource_id, strftime(a.day, '%Y-%m-%dT00:00:00Z') AS start_time, a.metric_name,
       statistic, unit, (count(period_start) OVER w)::INTEGER AS datapoint_count,
       CASE WHEN period_start IS NOT NULL
            THEN (row_number() OVER (PARTITION BY a.user_id, a.day, a.metric_name ORDER BY period_start) - 1)::INTEGER
            END AS pos,
       strftime(period_start, '%Y-%m-%dT%H:%M:%SZ') AS point_timestamp, point_value
FROM asked a LEFT JOIN points p ON a.user_id = p.user_id AND a.day = p.day AND a.metric_name = p.metric_name
WINDOW w AS (PARTITION BY a.user_id, a.day, a.metric_name)""",
    "curate_roundtrip": _CURATED_FILES_SQL,
    "incremental_roundtrip": _CURATED_FILES_SQL,
    "health_snapshot": _SNAPSHOT_SQL,
    "baseline": _BASELINE_SQL,
    "health_vs_baseline": f"""
SELECT s.*, b.* EXCLUDE (resource_id), {_DEVIATIONS}
FROM ({_SNAPSHOT_SQL}) s LEFT JOIN ({_BASELINE_SQL}) b ON s.resource_id = b.resource_id""",
    "health_text": f"SELECT resource_id, {_spelled(_HEALTH_TEXT_COLUMNS)} AS line FROM ({_SNAPSHOT_SQL})",
    "live_window": f"""
SELECT q.position, q.resource_id, l.* EXCLUDE (resource_id),
       coalesce(cpu_avg, cpu_max, freeable_memory_min_bytes, connections_avg, connections_max, read_latency_avg,
                write_latency_avg, read_iops_avg, write_iops_avg, disk_queue_depth_avg, aurora_replica_lag_max,
                free_storage_space_min_bytes) IS NOT NULL AS has_data,
       b.* EXCLUDE (resource_id), {_DEVIATIONS}
FROM (SELECT c_custkey AS position, 'u' || c_custkey AS resource_id FROM customer) q
LEFT JOIN ({_LIVE_SQL}) l ON q.resource_id = l.resource_id
LEFT JOIN ({_BASELINE_SQL}) b ON q.resource_id = b.resource_id""",
    "sliding_live_health": f"""
SELECT window_start, window_start + INTERVAL 30 MINUTE AS window_end, resource_id, {_LIVE}
FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, metric_timestamp) - to_minutes(5 * step) AS window_start
      FROM ({_CURATED}), (SELECT unnest([0, 1, 2, 3, 4, 5]) AS step))
GROUP BY window_start, resource_id""",
    "baseline_from_states": _BASELINE_SQL,
    "monthly_from_states": _MONTHLY_SQL,
    "published_roundtrip": _CURATED_FILES_SQL,
    "observed_batches": f"""
SELECT (NOT first)::INTEGER AS batch_id, count(*) AS raw_payload_count, 0::BIGINT AS no_data_payload_count,
       count(*) FILTER (WHERE reason IS NULL) AS raw_datapoint_count, count(reason) AS rejected_count,
       count(DISTINCT (resource_id, date)) FILTER (WHERE reason IS NULL) AS curated_row_count,
       count(*) FILTER (WHERE reason IS NULL) - count(DISTINCT (resource_id, date)) FILTER (WHERE reason IS NULL)
         AS duplicates_removed,
       count(DISTINCT date) FILTER (WHERE reason IS NULL) AS touched_hour_count
FROM (SELECT o_orderstatus <> 'F' AS first, resource_id, CAST(o_orderdate AS DATE) AS date,
             CASE WHEN o_orderstatus = 'F' THEN 'Missing source_account_id' ELSE reject_reason END AS reason
      FROM ({_GUARDED}))
GROUP BY first""",
    "variant_guard": """
SELECT reject_reason, count(*) AS rows, sum(value::DECIMAL(28,2))::DECIMAL(28,2) AS total
FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'Malformed payload'
                  WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'datapoints must be a list' END
               AS reject_reason,
             CASE WHEN o_orderstatus <> 'P' AND o_orderpriority = '5-LOW' THEN o_totalprice END AS value,
             o_orderstatus, o_orderpriority FROM orders)
WHERE reject_reason IS NOT NULL OR value IS NOT NULL GROUP BY reject_reason""",
    "findings_variant": """
SELECT conv_id::VARCHAR AS resource_id, (turn + 1)::INTEGER AS rank, role AS finding, '' AS suggestion, 'low' AS confidence
FROM conversations WHERE role <> 'system' AND conv_id <> 0""",
    "live_stream": f"""
WITH samples AS (
  SELECT *, metric_name IN ('DiskQueueDepth', 'AuroraReplicaLag', 'FreeableMemory', 'FreeStorageSpace') AS second
  FROM ({_CURATED_FILES_SQL})),
marks AS (
  SELECT max(metric_timestamp) FILTER (NOT second) - INTERVAL 15 MINUTE AS first_mark,
         max(metric_timestamp) - INTERVAL 15 MINUTE AS last_mark FROM samples)
SELECT window_start, window_start + INTERVAL 30 MINUTE AS window_end, resource_id, {_LIVE}
FROM (SELECT *, metric_timestamp - to_minutes(5 * step) AS window_start
      FROM samples, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS step), marks
      WHERE NOT second OR metric_timestamp > first_mark)
WHERE window_start + INTERVAL 30 MINUTE <= last_mark
GROUP BY window_start, resource_id""",
    "storage_history": _STORAGE_HISTORY_SQL,
    "storage_forecast": _FORECAST_SQL,
    "storage_forecast_full": _forecast_sql("1990-01-01"),
    "storage_forecast_daily": _forecast_sql(
        "1998-05-02",
        "date BETWEEN as_of - 30 AND as_of",
        "CROSS JOIN (SELECT DATE '1998-06-30' - n::INTEGER AS as_of FROM range(30) AS r(n))",
        "as_of,",
    ),
    "storage_text": f"SELECT resource_id, {_spelled(_FORECAST_TEXT_COLUMNS)} AS line FROM ({_FORECAST_SQL})",
    "monthly_aggregate": _MONTH_SQL,
    "monthly_report": _MONTHLY_SQL,
    "monthly_text": _MONTHLY_TEXT_SQL,
    "top_sql": _TOP_SQL,
    "top_sql_all_time": _ranked("true"),
    "top_sql_total_load": _TOTAL_SQL,
    "top_sql_text": f"""
SELECT resource_id, rank, '[' || resource_id || '] Top SQL #' || rank || ': avg_active_sessions=' ||
       avg_active_sessions || ', sql_id=' || sql_id || ', sql_text_truncated=false, sql_text=' || sql_text AS line
FROM ({_ranked(_WINDOW)})""",
    "top_sql_overview": f"""
SELECT position, q.resource_id, h.id IS NOT NULL AS has_load,
       CASE WHEN h.id IS NULL THEN 'not_enabled' WHEN ranked_statements IS NULL THEN 'no_load_data' ELSE 'ok' END
         AS load_status,
       CASE WHEN h.id IS NOT NULL THEN total_active_sessions END AS total_active_sessions,
       CASE WHEN h.id IS NOT NULL THEN ranked_statements END AS ranked_statements,
       CASE WHEN h.id IS NOT NULL THEN load_note END AS load_note, cpu_avg, connections_max
FROM (SELECT c_custkey AS position, 'u' || c_custkey AS resource_id FROM customer) q
LEFT JOIN (SELECT 'u' || ordinal AS id FROM ({_INSTANCES})
           WHERE performance_insights_enabled AND dbi_resource_id IS NOT NULL) h ON q.resource_id = h.id
LEFT JOIN ({_TOTAL_SQL}) t ON q.resource_id = t.resource_id AND h.id IS NOT NULL
LEFT JOIN ({_LIVE_SQL}) l ON q.resource_id = l.resource_id""",
    "sql_health": f"""
SELECT s.*, b.* EXCLUDE (resource_id), {_DEVIATIONS}
FROM ({_SNAPSHOT_SQL}) s LEFT JOIN ({_BASELINE_SQL}) b ON s.resource_id = b.resource_id""",
    "sql_live": f"""
SELECT l.*, b.* EXCLUDE (resource_id), {_DEVIATIONS}
FROM ({_LIVE_SQL}) l LEFT JOIN ({_BASELINE_SQL}) b ON l.resource_id = b.resource_id""",
    "sql_storage": _FORECAST_SQL,
    "sql_months": _MONTHLY_SQL,
    "sql_top_sql": _TOP_SQL,
    "sql_truncate": """
SELECT doc_id, CASE WHEN length(text) > 1200 THEN substr(text, 1, 1200) || '…' ELSE text END AS sql_text,
       coalesce(length(text) > 1200, false) AS sql_text_truncated,
       CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '…' ELSE text END AS display_text,
       coalesce(length(text) > 400, false) AS display_shortened
FROM documents""",
    "findings_normalized": _FINDINGS_SQL,
    "findings_join": f"""
SELECT t.*, finding, suggestion, confidence,
       CASE confidence WHEN 'high' THEN '가능성 높음' WHEN 'low' THEN '확인 필요' END AS confidence_label,
       confidence AS capped_confidence
FROM ({_TOP_SQL}) t LEFT JOIN ({_FINDINGS_SQL}) f ON t.resource_id = f.resource_id AND t.rank = f.rank""",
    "load_enabled_split": f"""
SELECT resource_id, i.dbi_resource_id, i.dbi_resource_id IS NOT NULL AS has_load
FROM (SELECT replace(c_name, 'Customer', 'Supplier') AS resource_id FROM customer)
LEFT JOIN (SELECT * FROM ({_INSTANCES}) WHERE performance_insights_enabled) i ON resource_id = i.identifier""",
    "role_join": _INSTANCES,
    "available_instances": f"""
SELECT identifier, status, cluster_role FROM ({_INSTANCES}) WHERE status = 'available'""",
    "cluster_extend": f"""
SELECT replace(c_name, 'Customer', 'Supplier') AS resource_id FROM customer
UNION
SELECT cluster_identifier FROM ({_INSTANCES})
WHERE identifier IN (SELECT replace(c_name, 'Customer', 'Supplier') FROM customer)""",
    "resolve_names": _resolved(_NAMES),
    "parse_requests": _REQUESTS_SQL,
    "resolve_scope": _SCOPES_SQL,
    "scope_resources": _SCOPE_IDS_SQL,
    "collection_plan": _PLAN_SQL,
    "resource_metric_counts": f"SELECT * EXCLUDE (metrics), len(metrics)::INTEGER AS metric_count FROM ({_PLANNED})",
    "collection_summary": _SUMMARY_SQL,
    "request_check": f"""
SELECT event_id, resource_dimension, metric_name,
       CASE WHEN resource_dimension = 'DBName' THEN 'Unsupported resource dimension: DBName'
            WHEN metric_name = 'ErrorCount' THEN 'Unsupported metric: ErrorCount' END AS request_error
FROM (SELECT event_id,
             CASE event_id % 3 WHEN 0 THEN 'DBInstanceIdentifier' WHEN 1 THEN 'DBClusterIdentifier' ELSE 'DBName' END
               AS resource_dimension,
             CASE event_type WHEN 'error' THEN 'ErrorCount' ELSE {_METRIC} END AS metric_name FROM events)""",
    "raw_objects": f"""
SELECT DISTINCT true AS partitioned, '000000000001' AS account_id, 'ap-northeast-2' AS region, metric_name AS metric,
       strftime(day + 1, '%Y-%m-%d') AS date
FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), {_RESPONSE_METRICS}
UNION ALL SELECT false, NULL, NULL, NULL, NULL""",
    "payload_regions": f"""
SELECT 'ap-northeast-2' AS region, m.metric_name, count(*) AS documents, sum(coalesce(n, 0))::BIGINT AS datapoints
FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events) d CROSS JOIN {_RESPONSE_METRICS}
LEFT JOIN (SELECT user_id, day, metric_name, count(*) AS n FROM ({_PERIODS}) GROUP BY ALL) p
  ON p.user_id = d.user_id AND p.day = d.day AND p.metric_name = m.metric_name
GROUP BY m.metric_name""",
    "registered_hours": """
SELECT '000000000001' AS account_id, 'ap-northeast-2' AS region, CAST(ts AS DATE) AS date,
       strftime(ts, '%H') AS hour, count(*) AS samples FROM events GROUP BY ALL""",
    "health_without_history": f"""
SELECT s.*, b.* EXCLUDE (resource_id), {_DEVIATIONS}
FROM ({_SNAPSHOT_SQL}) s LEFT JOIN (SELECT * FROM ({_BASELINE_SQL}) WHERE false) b ON s.resource_id = b.resource_id""",
    "validated_values": r"""
SELECT id, value, regexp_full_match(value, '[0-9]{12}') AS account_id,
       regexp_full_match(value, '[a-z]{2}-[a-z]+-[0-9]') AS region,
       regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS date,
       regexp_full_match(value, '[0-9]{4}-(0[1-9]|1[0-2])') AS month,
       regexp_full_match(value, '[A-Za-z0-9_-]+') AS resource_id,
       regexp_full_match(value, 'db-[A-Z0-9]+') AS dbi_resource_id,
       coalesce(TRY_CAST(value AS BIGINT) BETWEEN 1 AND 1440, false) AS lookback
FROM (SELECT 'o' || o_orderkey AS id,
             CASE o_orderkey % 7 WHEN 0 THEN lpad(o_orderkey::VARCHAR, 12, '0') WHEN 1 THEN strftime(o_orderdate, '%Y-%m')
                  WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN 'db-' || upper(o_orderstatus) || o_orderkey
                  WHEN 4 THEN 'ap-northeast-2' WHEN 5 THEN o_orderpriority || chr(10)
                  ELSE strftime(o_orderdate, '%Y-') || (o_orderkey % 20) END AS value
      FROM orders
      UNION ALL SELECT 'p' || p_partkey, (p_partkey * 37 % 1600 - 20)::VARCHAR FROM part)""",
    "landed_summary": _SUMMARY_SQL,
    "shown_instances": f"""
SELECT COLUMNS(*)::VARCHAR FROM (SELECT * REPLACE (coalesce(dbi_resource_id, '') AS dbi_resource_id,
       coalesce(engine, '') AS engine) FROM ({_INSTANCES}))""",
    "cluster_extend_keyed": f"""
SELECT account_id, region, identifier AS resource_id FROM ({_INSTANCES})
UNION SELECT account_id, region, cluster_identifier FROM ({_INSTANCES})""",
    "described_clusters": """
SELECT '00000000000' || (n_regionkey + 1) AS account_id,
       CASE WHEN n_nationkey % 2 = 1 THEN 'us-east-1' ELSE 'ap-northeast-2' END AS region, n_name AS identifier,
       CASE n_nationkey % 3 WHEN 0 THEN 'aurora-mysql' WHEN 1 THEN 'aurora-postgresql' ELSE 'mysql' END AS engine,
       '1' AS engine_version, CASE n_nationkey % 4 WHEN 3 THEN 'creating' ELSE 'available' END AS status FROM nation""",
    "described_members": f"""
SELECT account_id, region, cluster_identifier, identifier, cluster_role AS role,
       (ordinal % 16)::INTEGER AS promotion_tier FROM ({_INSTANCES})""",
    "described_instances": f"SELECT * EXCLUDE (ordinal) FROM ({_INSTANCES})",
    "metric_allow_list": "SELECT event_id, 'ErrorCount' AS metric_name FROM events WHERE event_type = 'error'",
}
