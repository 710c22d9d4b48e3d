"""The same results in SQL for DuckDB, over the driver's tables as views."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
MICROS = "'%Y-%m-%dT%H:%M:%S.%fZ'"
HOUR = 3_600_000
US = "chr(31)"

# The adapter views of klaxon.plans.adapter.
VIEWS = {
    "raw_alerts": """
        SELECT event_id AS id,
            CASE WHEN event_id % 97 = 0 THEN NULL
                 WHEN event_id % 3 = 0 THEN 'NATION_' || CAST(user_id % 30 AS VARCHAR)
                 WHEN event_id % 3 = 1 THEN '  nation_' || CAST(user_id % 30 AS VARCHAR) || ' '
                 ELSE 'Nation_' || CAST(user_id % 30 AS VARCHAR) END AS location_title,
            CASE WHEN event_id % 50 = 0 THEN ''
                 WHEN event_type = 'click' THEN 'air_raid'
                 WHEN event_type = 'view' THEN 'artillery_shelling'
                 WHEN event_type = 'purchase' THEN 'chemical'
                 WHEN event_type = 'signup' THEN 'urban_fights'
                 ELSE 'Drone Attack' END AS alert_type,
            ts AS seen_at
        FROM events""",
    "mapped": """
        SELECT lower(n_name) AS raw_title, n_name || '_REGION' AS region_id, CAST(n_nationkey AS BIGINT) AS id
        FROM nation""",
    "regions": "SELECT n_name || '_REGION' AS region_id, 'Nation ' || n_nationkey AS display_name FROM nation",
    "typed": """
        SELECT *, CASE lower(alert_type)
                WHEN '' THEN 'AIR_RAID' WHEN 'air_raid' THEN 'AIR_RAID'
                WHEN 'artillery_shelling' THEN 'ARTILLERY' WHEN 'chemical' THEN 'CHEMICAL_RISK'
                WHEN 'urban_fights' THEN 'URBAN_FIGHTS' ELSE replace(upper(alert_type), ' ', '_') END AS event_type
        FROM raw_alerts""",
    "alerts": """
        SELECT 'alerts-in-ua-' || r.id AS event_id, r.id AS num,
            coalesce(m.region_id, upper(trim(r.location_title)) || '_REGION') AS region_id,
            r.event_type, 'ACTIVE' AS status,
            CASE WHEN r.event_type IN ('AIR_RAID', 'ARTILLERY', 'RADIATION_RISK') THEN 'CRITICAL'
                 WHEN r.event_type IN ('CHEMICAL_RISK', 'URBAN_FIGHTS') THEN 'WARNING'
                 ELSE 'INFO' END AS severity,
            r.seen_at, epoch_us(r.seen_at) // 1000 AS ms
        FROM typed r LEFT JOIN mapped m ON m.raw_title = lower(trim(r.location_title))
        WHERE r.location_title IS NOT NULL""",
    "subs": """
        SELECT c_custkey AS id, c_name AS user_id,
            CASE WHEN c_custkey % 2 = 0 THEN 'DISCORD' ELSE 'NTFY' END AS channel,
            'topic-' || CAST(c_custkey % 40 AS VARCHAR) AS recipient_address,
            'NATION_' || CAST(c_nationkey AS VARCHAR) || '_REGION' AS region_id,
            CASE c_mktsegment WHEN 'BUILDING' THEN 'INFO' WHEN 'AUTOMOBILE' THEN 'WARNING'
                 WHEN 'MACHINERY' THEN 'CRITICAL' WHEN 'FURNITURE' THEN '' END AS min_severity,
            c_acctbal >= 0 AS active
        FROM customer""",
    "tasks": f"""
        SELECT sha256(a.event_id || {US} || s.id) AS task_id, a.event_id, s.id AS subscription_id, s.channel,
            s.recipient_address, a.region_id, a.severity, a.seen_at,
            'Alert in ' || a.region_id || ': ' || a.event_type || ' [' || a.severity || ']' AS message
        FROM alerts a JOIN subs s ON a.region_id = s.region_id AND s.active
        WHERE s.min_severity IS NULL OR s.min_severity = ''
            OR (CASE a.severity WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END)
               >= (CASE s.min_severity WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END)""",
    "varied": """
        SELECT * REPLACE (
            CASE subscription_id % 8 WHEN 0 THEN ' '
                 WHEN 1 THEN 'https://push.example.net/' || recipient_address
                 WHEN 2 THEN '/' || recipient_address ELSE recipient_address END AS recipient_address,
            CASE WHEN subscription_id % 17 <> 0 THEN channel END AS channel)
        FROM tasks""",
    "unrecognized": """
        SELECT trim(location_title) AS raw_title, count(*) AS occurrences_count,
            min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at
        FROM raw_alerts
        WHERE location_title IS NOT NULL AND lower(trim(location_title)) NOT IN (SELECT raw_title FROM mapped)
        GROUP BY 1""",
    "attempts": """
        SELECT 'task-' || o_orderkey AS task_id, o_orderkey,
            CASE WHEN o_orderkey % 2 = 0 THEN 'DISCORD' ELSE 'NTFY' END AS channel,
            o_orderdate + to_microseconds(CAST(nth * 1500000 AS BIGINT)) AS attempt_at,
            (o_orderkey + nth) % 5 = 0 AS ok
        FROM (SELECT o_orderkey, o_orderdate, unnest(range(1, o_orderkey % 4 + 2)) AS nth FROM orders)""",
    "region_requests": """
        SELECT c_custkey AS seq,
            CASE WHEN c_custkey % 19 = 0 THEN 'bad-' || CAST(c_custkey % 60 AS VARCHAR)
                 WHEN c_custkey % 23 = 0 THEN ' '
                 ELSE 'NATION_' || CAST(c_custkey % 60 AS VARCHAR) || '_REGION' END AS region_id,
            CASE WHEN c_custkey % 29 = 0 THEN '' ELSE ' Area ' || c_custkey || ' ' END AS display_name
        FROM customer""",
    "checked_requests": """
        SELECT *, CASE WHEN trim(region_id) = '' THEN 'BLANK_REGION_ID'
            WHEN NOT regexp_full_match(region_id, '[A-Z0-9_]+')
                THEN 'BAD_REGION_ID'
            WHEN trim(display_name) = '' THEN 'BLANK_DISPLAY_NAME' END AS reason
        FROM region_requests""",
    "mapping_requests": """
        SELECT c_custkey AS seq,
            CASE WHEN c_custkey % 2 = 0 THEN ' Nation_' || CAST(c_custkey % 200 AS VARCHAR)
                 ELSE 'NATION_' || CAST(c_custkey % 200 AS VARCHAR) || chr(9) END AS raw_title,
            CASE WHEN c_custkey % 31 = 0 THEN '  '
                 ELSE ' nation_' || CAST(c_custkey % 28 AS VARCHAR) || '_region' END AS region_id
        FROM customer""",
    "customer_mappings": """
        SELECT c_custkey AS id, c_mktsegment || CAST(c_custkey % 500 AS VARCHAR) AS raw_title,
            'NATION_' || CAST(c_nationkey + c_custkey % 3 AS VARCHAR) || '_REGION' AS region_id
        FROM customer""",
    "changes": """
        SELECT seq, op, CASE WHEN op <> 'CREATE' THEN o_custkey + CASE WHEN seq % 41 = 0 THEN 100000000 ELSE 0 END END AS id,
            CASE WHEN op = 'CREATE' THEN 'user-' || o_custkey END AS user_id,
            CASE WHEN op = 'CREATE' AND seq % 13 <> 0 THEN 'NTFY' END AS channel,
            CASE WHEN op = 'CREATE' THEN 'topic-' || CAST(o_custkey % 40 AS VARCHAR) END AS recipient_address,
            CASE WHEN seq % 4 = 0 THEN ' ' ELSE 'NATION_' || CAST(seq % 25 AS VARCHAR) || '_REGION' END AS region_id,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'WARNING'
                WHEN '3-MEDIUM' THEN '' END AS min_severity,
            CASE WHEN seq % 3 = 0 THEN seq % 2 = 0 END AS active
        FROM (SELECT *, o_orderkey AS seq,
                CASE WHEN o_orderstatus = 'F' THEN 'CREATE'
                     WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 7 = 0 THEN 'DELETE'
                     ELSE 'UPDATE' END AS op FROM orders)""",
    "created": f"""
        SELECT CAST('0x' || left(sha256(seq || {US} || user_id), 15) AS BIGINT) AS id, user_id, channel,
            recipient_address, region_id, coalesce(nullif(trim(min_severity), ''), 'INFO') AS min_severity,
            TRUE AS active
        FROM changes WHERE op = 'CREATE' AND channel IS NOT NULL AND trim(region_id) <> ''""",
    "recipients": """
        SELECT DISTINCT 'topic-' || CAST(s_nationkey AS VARCHAR) AS recipient_address,
            CASE WHEN s_suppkey % 2 = 0 THEN 'DISCORD' ELSE 'NTFY' END AS channel
        FROM supplier""",
    "polls": """
        SELECT 'feed-' || CAST((id // 20) % 3 AS VARCHAR) AS feed, id // 20 AS seq,
            CASE WHEN (id // 20) % 5 = 0 THEN NULL ELSE strftime(max(seen_at), '%Y-%m-%d %H') END AS version
        FROM raw_alerts GROUP BY id // 20""",
    "history": f"""
        SELECT event_id, region_id, severity, strftime(seen_at, {MICROS}) AS event_time, seen_at,
            CAST(num % 3 AS INTEGER) AS kafka_partition, num AS kafka_offset,
            strftime(seen_at, '%Y-%m-%d') AS event_date
        FROM alerts""",
}

# What each view stands on, in order.
_NEEDS = {
    "typed": ["raw_alerts"],
    "alerts": ["raw_alerts", "mapped", "typed"],
    "tasks": ["raw_alerts", "mapped", "typed", "alerts", "subs"],
    "varied": ["raw_alerts", "mapped", "typed", "alerts", "subs", "tasks"],
    "unrecognized": ["raw_alerts", "mapped"],
    "checked_requests": ["region_requests"],
    "created": ["changes"],
    "polls": ["raw_alerts"],
    "history": ["raw_alerts", "mapped", "typed", "alerts"],
}


def _sql(body: str, *views: str, **more: str) -> str:
    """`body` with the adapter views it names, and further CTEs, in front."""
    names: list[str] = []
    for view in views:
        for name in [*_NEEDS.get(view, []), view]:
            if name not in names:
                names.append(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({b})" for n, b in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def _chain(source: str, keys: str, ttl: int, op: str = ">=") -> dict[str, str]:
    """CTEs `thin` and `chain`: the instants of `source` (keys, ms) that pass a gate."""
    same = " AND ".join(f"t.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    named = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    return {
        "thin": f"SELECT DISTINCT {keys}, ms FROM {source}",
        "chain": f"""
            SELECT {keys}, min(ms) AS ms FROM thin GROUP BY {keys}
            UNION ALL
            SELECT {named}, min(t.ms) AS ms FROM chain c JOIN thin t ON {same} AND t.ms {op} c.ms + {ttl}
            GROUP BY {named}, c.ms""",
    }


def _passed(source: str, keys: str) -> str:
    """Ids that pass: the first of each passing instant."""
    same = " AND ".join(f"a.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    return (
        f"SELECT min(a.event_id) AS event_id FROM {source} a JOIN chain c ON {same} AND a.ms = c.ms "
        f"GROUP BY {', '.join('a.' + k.strip() for k in keys.split(','))}, a.ms"
    )


def _counted(window: int) -> str:
    """Alerts with the count each sees: earlier members of its window, and itself."""
    return f"""
        SELECT *, count(*) OVER (PARTITION BY region_id ORDER BY ms RANGE BETWEEN {window} PRECEDING AND CURRENT ROW)
            - count(*) OVER (PARTITION BY region_id, ms)
            + row_number() OVER (PARTITION BY region_id, ms ORDER BY event_id) AS n
        FROM alerts"""


def _spikes(window: int, threshold: int, cooldown: int) -> dict[str, str]:
    """CTE `fired`: (region_id, event_id, ms, n, seen_at) of the alerts that fire."""
    return {
        "counted": _counted(window),
        "ready": f"SELECT * FROM counted WHERE n >= {threshold}",
        **_chain("ready", "region_id", cooldown, ">"),
        "fired": """
            SELECT r.region_id, r.event_id, r.ms, r.n, make_timestamp(r.ms * 1000) AS seen_at
            FROM ready r JOIN chain c ON r.region_id = c.region_id AND r.ms = c.ms
            QUALIFY row_number() OVER (PARTITION BY r.region_id, r.ms ORDER BY r.event_id) = 1""",
    }


def _description(window: int, threshold: int) -> str:
    return (
        f"'Rapid-fire alert spike detected in ' || region_id || ': ' || n || "
        f"' events within {window // 1000} seconds (threshold: {threshold})'"
    )


_INSTANT_MS = "strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"


def _anomalies(window: int, threshold: int, cooldown: int) -> dict[str, str]:
    return {
        **_spikes(window, threshold, cooldown),
        "anomalies": f"""
            SELECT sha256('anomaly' || {US} || region_id || {US} || event_id || {US} || {_INSTANT_MS} || {US} || '{window}')
                AS anomaly_id, region_id, 'RAPID_FIRE_SPIKE' AS anomaly_type, {_description(window, threshold)} AS description,
                CAST(n AS INTEGER) AS event_count, CAST({window // 1000} AS BIGINT) AS window_duration_seconds,
                'CRITICAL' AS severity, strftime(seen_at, {MICROS}) AS detected, seen_at, event_id, ms
            FROM fired""",
    }


_BIG = (6 * HOUR, 6, 24 * HOUR)
_SMALL = (300_000, 3, 600_000)
_HISTORY_COLUMNS = "event_id, region_id, severity, event_time, kafka_partition, kafka_offset, event_date"
_ANOMALY_COLUMNS = "anomaly_id, region_id, anomaly_type, event_count, window_duration_seconds, severity, detected, event_id"
_BETWEEN = "seen_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:30:00'"
_SUB_COLUMNS = "id, user_id, channel, recipient_address, region_id, min_severity, active"
_UNRECOGNIZED = (
    f"SELECT raw_title, CAST(occurrences_count AS BIGINT) AS occurrences_count, "
    f"strftime(first_seen_at, {MICROS}) AS first_seen, strftime(last_seen_at, {MICROS}) AS last_seen FROM unrecognized"
)


def _detect_spikes() -> str:
    """Both configurations side by side: two gates in one statement."""
    blocks = []
    for name, (window, threshold, cooldown) in (("5m/3/10m", _SMALL), ("6h/6/24h", _BIG)):
        inner = _sql(
            f"SELECT '{name}' AS config, region_id, event_id, n, {_description(window, threshold)} AS description FROM fired",
            "alerts",
            **_spikes(window, threshold, cooldown),
        )
        blocks.append(f"SELECT * FROM ({inner})")
    return " UNION ALL ".join(blocks)


def _debounce_alerts() -> str:
    keys = "region_id, event_type"
    blocks = []
    for name, ttl in (("1h", HOUR), ("12h", 12 * HOUR)):
        inner = _sql(
            f"SELECT '{name}' AS ttl, event_id FROM ({_passed('alerts', keys)})", "alerts", **_chain("alerts", keys, ttl)
        )
        blocks.append(f"SELECT * FROM ({inner})")
    return " UNION ALL ".join(blocks)


def _changed(*ops: str) -> str:
    """The table after the log: ids of CREATEs cannot be named by later rows of this log."""
    wanted = ", ".join(f"'{op}'" for op in ops)
    created = "UNION ALL SELECT * FROM created" if "CREATE" in ops else ""
    return _sql(
        f"""SELECT s.id, s.user_id, s.channel, s.recipient_address,
                coalesce(f.region_id, s.region_id) AS region_id,
                coalesce(f.min_severity, s.min_severity) AS min_severity, coalesce(f.active, s.active) AS active
            FROM subs s LEFT JOIN folded f ON f.id = s.id WHERE NOT coalesce(f.gone, FALSE) {created}""",
        "subs",
        "created",
        folded=f"""
            SELECT id, arg_max(region_id, seq) FILTER (op = 'UPDATE' AND trim(region_id) <> '') AS region_id,
                arg_max(min_severity, seq) FILTER (op = 'UPDATE' AND trim(min_severity) <> '') AS min_severity,
                arg_max(active, seq) FILTER (op = 'UPDATE' AND active IS NOT NULL) AS active,
                bool_or(op = 'DELETE') AS gone
            FROM changes WHERE op <> 'CREATE' AND op IN ({wanted}) GROUP BY id""",
    )


_SETTLED_REGIONS = """
    SELECT *, CASE WHEN reason IS NOT NULL THEN reason
        WHEN region_id IN (SELECT region_id FROM regions)
            OR row_number() OVER (PARTITION BY region_id, reason IS NULL ORDER BY seq) > 1
        THEN 'REGION_EXISTS' END AS outcome
    FROM checked_requests"""


def _settled_mappings(requests: str) -> dict[str, str]:
    return {
        "placed": f"""
            SELECT *, lower(trim(raw_title, ' ' || chr(9))) AS title, upper(trim(region_id)) AS target,
                CASE WHEN trim(region_id) = '' THEN 'BLANK_REGION_ID'
                     WHEN upper(trim(region_id)) NOT IN (SELECT region_id FROM regions)
                     THEN 'NO_SUCH_REGION' END AS reason
            FROM {requests}""",
        "settled": """
            SELECT *, CASE WHEN reason IS NOT NULL THEN reason
                WHEN title IN (SELECT raw_title FROM mapped)
                    OR row_number() OVER (PARTITION BY title, reason IS NULL ORDER BY seq) > 1
                THEN 'Mapping for title already exists' END AS outcome
            FROM placed""",
    }


_MAPPING_RESULT = """
    SELECT 'table' AS status, raw_title AS subject, region_id AS detail FROM mapped
    UNION ALL SELECT 'table', title, target FROM settled WHERE outcome IS NULL
    UNION ALL SELECT 'unrecognized', raw_title, CAST(occurrences_count AS VARCHAR) FROM unrecognized
        WHERE raw_title NOT IN (SELECT trim(raw_title, ' ' || chr(9)) FROM settled WHERE outcome IS NULL)
    UNION ALL SELECT 'rejected', raw_title, seq || ' ' || outcome FROM settled WHERE outcome IS NOT NULL"""

_NTFY_TARGET = """
    CASE WHEN trim(recipient_address) = '' THEN 'https://push.example.org/all-alerts'
         WHEN starts_with(recipient_address, 'https://') THEN recipient_address
         ELSE 'https://push.example.org/' || ltrim(recipient_address, '/') END"""
_DISCORD_TARGET = "CASE WHEN trim(recipient_address) = '' THEN {default} ELSE recipient_address END"
_PRIORITY = """
    CASE upper(severity) WHEN 'CRITICAL' THEN 'urgent' WHEN 'WARNING' THEN 'high' WHEN 'HIGH' THEN 'high'
         WHEN 'LOW' THEN 'low' ELSE 'default' END"""


def _filled() -> str:
    given = "region_id, event_type, num, seen_at, event_id"
    return f"""
        SELECT {given},
            CASE WHEN num % 4 <> 0 THEN 'ENDED' END AS status_in,
            CASE WHEN num % 3 <> 0 THEN severity END AS severity_in,
            CASE WHEN num % 7 <> 0 THEN seen_at END AS seen_in
        FROM alerts"""


ORACLES: dict[str, str] = {
    # sources and sinks
    # streams
    "stream_late_rows": _sql(
        """SELECT FALSE AS late, region_id, event_id, n FROM fired
           UNION ALL SELECT TRUE, region_id, event_id, 0 FROM all_alerts WHERE num % 37 = 0""",
        "typed",
        "mapped",
        all_alerts=VIEWS["alerts"],
        alerts="SELECT * FROM all_alerts WHERE num % 37 <> 0",
        **_spikes(*_BIG),
    ),
    "stream_debounce_with_clear": _sql(
        f"SELECT FALSE AS late, event_id FROM ({_passed('since', 'region_id, event_type, freed')})",
        "alerts",
        since="""SELECT a.*, coalesce((SELECT max(e.ms) FROM alerts e WHERE e.num % 11 = 0
                AND e.region_id = a.region_id AND e.event_type = a.event_type AND e.ms <= a.ms), 0) AS freed
            FROM alerts a WHERE a.num % 11 <> 0""",
        **_chain("since", "region_id, event_type, freed", 12 * HOUR),
    ),
    "stream_snapshot_filter": _sql(
        """SELECT FALSE AS late, feed, seq FROM (SELECT *, last_value(version IGNORE NULLS) OVER (
                PARTITION BY feed ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM polls)
           WHERE version IS NULL OR before IS NULL OR version <> before""",
        "polls",
    ),
    "stream_discovery": _sql(
        "SELECT raw_title, CAST(occurrences_count AS BIGINT) AS occurrences_count FROM unrecognized", "unrecognized"
    ),
    "stream_pipeline": _sql(
        f"""SELECT p.event_id, a.region_id, CAST(count(t.task_id) AS BIGINT) AS tasks
            FROM ({_passed('alerts', 'region_id, event_type')}) p JOIN alerts a ON a.event_id = p.event_id
            LEFT JOIN tasks t ON t.event_id = p.event_id GROUP BY ALL""",
        "tasks",
        **_chain("alerts", "region_id, event_type", 12 * HOUR),
    ),
    "snapshot_quarantine": _sql(
        """SELECT 'alert' AS kind, CAST(id AS VARCHAR) AS what FROM raw_alerts WHERE (id // 20) % 7 <> 3
           UNION ALL SELECT DISTINCT 'unreadable', '{"alerts":[{"id":' || (id // 20) FROM raw_alerts WHERE (id // 20) % 7 = 3""",
        "raw_alerts",
    ),
    "spikes_of_torn_rows": _sql(
        "SELECT region_id, event_id, CAST(n AS INTEGER) AS n FROM fired",
        "typed",
        "mapped",
        all_alerts=VIEWS["alerts"],
        alerts="SELECT * FROM all_alerts WHERE num % 13 <> 0",
        **_spikes(*_BIG),
    ),
    "snapshot_explode": _sql("SELECT id, location_title, alert_type FROM raw_alerts", "raw_alerts"),
    "snapshot_change_filter": _sql(
        """SELECT feed, seq FROM (SELECT *, last_value(version IGNORE NULLS) OVER (
                PARTITION BY feed ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM polls)
           WHERE version IS NULL OR before IS NULL OR version <> before""",
        "polls",
    ),
    "alert_log_encode": _sql(
        f"""SELECT region_id AS key, CAST(json_object('eventId', event_id, 'regionId', region_id,
                'eventType', event_type, 'status', status, 'severity', severity,
                'timestamp', strftime(seen_at, {MICROS})) AS VARCHAR) AS value FROM alerts""",
        "alerts",
    ),
    "alert_log_decode": _sql(
        f"""SELECT event_id, region_id, event_type, status, severity, strftime(seen_at, {MICROS}) AS seen_at,
                'events.raw-alerts' AS topic, CAST(num % 3 AS INTEGER) AS log_partition, num AS log_offset FROM alerts""",
        "alerts",
    ),
    "malformed_quarantine": _sql(
        "SELECT num AS log_offset, num % 53 = 0 OR num % 59 = 0 OR num % 61 = 0 AS is_bad FROM alerts", "alerts"
    ),
    "anomaly_log_decode": _sql(
        """SELECT anomaly_id, region_id, description, event_count, detected AS detected_at, event_id FROM anomalies""",
        "alerts",
        **_anomalies(*_BIG),
    ),
    "ingest_defaults": _sql(
        f"""SELECT CASE WHEN num % 10 <> 0 THEN event_id ELSE sha256(region_id || {US} || event_type || {US} ||
                coalesce(status_in, '\\N') || {US} || coalesce(severity_in, '\\N') || {US} ||
                coalesce(CAST(epoch_us(seen_in) AS VARCHAR), '\\N')) END AS event_id,
            region_id, event_type, coalesce(status_in, 'ACTIVE') AS status,
            coalesce(severity_in, 'WARNING') AS severity,
            strftime(coalesce(seen_in, {AS_OF}), {MICROS}) AS seen_at FROM filled""",
        "alerts",
        filled=_filled(),
    ),
    "merge_feeds": _sql(
        f"""SELECT event_id, 'polled' AS feed FROM ({_passed('polled', 'region_id, event_type')})
            UNION ALL SELECT event_id, 'pushed' FROM alerts WHERE num % 2 = 1""",
        "alerts",
        polled="SELECT * FROM alerts WHERE num % 2 = 0",
        **_chain("polled", "region_id, event_type", 12 * HOUR),
    ),
    "snapshot_to_events": _sql(
        f"SELECT event_id, region_id, event_type, status, severity, strftime(seen_at, {MICROS}) AS seen_at FROM alerts",
        "alerts",
    ),
    # scalars
    "event_type_norm": _sql("SELECT id, event_type FROM typed", "typed"),
    "severity_rollup": _sql(
        """SELECT event_type, CASE WHEN event_type IN ('AIR_RAID', 'ARTILLERY') THEN 'CRITICAL'
                WHEN event_type IN ('CHEMICAL_RISK', 'URBAN_FIGHTS') THEN 'WARNING' ELSE 'INFO' END AS severity,
            count(*) AS alerts FROM typed GROUP BY 1, 2""",
        "typed",
    ),
    "severity_weight": _sql(
        """SELECT id, CAST(CASE min_severity WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 WHEN 'INFO' THEN 1
                ELSE 0 END AS INTEGER) AS weight FROM subs""",
        "subs",
    ),
    "region_slug": r"""
        SELECT c_custkey, CASE c_custkey % 10 WHEN 0 THEN '_REGION'
            WHEN 1 THEN 'CUSTOMER_' || replace(c_name, 'Customer#', '') || '_REGION'
            ELSE regexp_replace(regexp_replace(upper('смт. ' || c_name || ' (' || c_mktsegment || ') область!'),
                '[^A-Z0-9А-ЯІЇЄҐ]+', '_', 'g'), '^_+|_+$', '', 'g') || '_REGION' END AS region_id
        FROM customer""",
    "ntfy_priority": _sql(
        f"""SELECT event_id, {_PRIORITY} AS priority FROM (SELECT event_id, CASE num % 5 WHEN 0 THEN 'low'
                WHEN 1 THEN 'High' WHEN 2 THEN NULL ELSE severity END AS severity FROM alerts)""",
        "alerts",
    ),
    "mask_recipient": _sql(
        """SELECT id, CASE WHEN id % 9 = 0 OR length(a) <= 35 THEN '***' ELSE left(a, 35) || '...' END AS shown
           FROM (SELECT id, 'https://hooks.example.org/' || recipient_address || '/' || id AS a FROM subs)""",
        "subs",
    ),
    "parse_started_at": _sql(
        f"""SELECT id, strftime(CASE WHEN id % 5 IN (0, 1) OR (id % 5 > 2 AND id % 35 IN (3, 4)) THEN {AS_OF}
                WHEN id % 5 = 2 THEN date_trunc('second', seen_at) - INTERVAL 2 HOUR
                ELSE seen_at END, {MICROS}) AS started_at FROM raw_alerts""",
        "raw_alerts",
    ),
    # joins, windows, gates
    "normalize_regions": _sql(
        """SELECT r.id, CASE WHEN location_title IS NULL THEN 'UNKNOWN_REGION'
                ELSE coalesce(m.region_id, upper(trim(location_title)) || '_REGION') END AS region_id
           FROM raw_alerts r LEFT JOIN mapped m ON m.raw_title = lower(trim(location_title))""",
        "raw_alerts",
        "mapped",
    ),
    "match_alerts": _sql("SELECT task_id, event_id, subscription_id, channel, message, severity FROM tasks", "tasks"),
    "sliding_counts": _sql(f"SELECT event_id, n FROM ({_counted(6 * HOUR)})", "alerts"),
    "spike_candidates": _sql(f"SELECT event_id, n FROM ({_counted(6 * HOUR)}) WHERE n >= 6", "alerts"),
    "detect_spikes": _detect_spikes(),
    "debounce_alerts": _debounce_alerts(),
    "debounce_with_clear": _sql(
        _passed("since", "region_id, event_type, freed"),
        "alerts",
        since="""SELECT a.*, coalesce((SELECT max(e.ms) FROM alerts e WHERE e.num % 11 = 0
                AND e.region_id = a.region_id AND e.event_type = a.event_type AND e.ms <= a.ms), 0) AS freed
            FROM alerts a WHERE a.num % 11 <> 0""",
        **_chain("since", "region_id, event_type, freed", 12 * HOUR),
    ),
    "match_anomalies": _sql(
        f"""SELECT a.anomaly_id, s.id AS subscription_id, 'CRITICAL SPIKE ALERT in ' || a.region_id || ': ' ||
                a.description || ' (Detected: ' || {_INSTANT_MS} || ')' AS message
            FROM anomalies a JOIN subs s ON a.region_id = s.region_id AND s.active""",
        "alerts",
        "subs",
        **_anomalies(*_BIG),
    ),
    "orphan_subscriptions": _sql(
        "SELECT id, lower(region_id) AS region_id FROM subs WHERE id % 6 = 0", "subs"
    ),
    # delivery
    "route_tasks": _sql(
        """SELECT task_id, CASE channel WHEN 'DISCORD' THEN 'notification.discord' WHEN 'NTFY' THEN 'notification.ntfy'
                ELSE 'REJECTED' END AS routing_key FROM varied""",
        "varied",
    ),
    "render_discord": _sql(
        f"""SELECT task_id, {_DISCORD_TARGET.format(default="'https://hooks.example.org/default/channel/one'")} AS target,
                CAST(json_object('content', message, 'username', 'alert desk') AS VARCHAR) AS payload
            FROM varied WHERE channel = 'DISCORD'""",
        "varied",
    ),
    "render_ntfy": _sql(
        f"""SELECT task_id, {_NTFY_TARGET} AS target, 'Alert: ' || region_id AS title, {_PRIORITY} AS priority,
                message AS payload FROM varied WHERE channel = 'NTFY'""",
        "varied",
    ),
    "outbox_dry_run": _sql(
        f"""SELECT task_id, channel, CASE WHEN t IS NULL OR length(t) <= 35 THEN '***' ELSE left(t, 35) || '...' END
                AS shown_target, CASE WHEN channel = 'NTFY' THEN {_PRIORITY} END AS priority, 'DRY_RUN' AS status
            FROM (SELECT *, CASE channel WHEN 'NTFY' THEN {_NTFY_TARGET}
                    ELSE {_DISCORD_TARGET.format(default='NULL')} END AS t FROM varied WHERE channel IS NOT NULL)""",
        "varied",
    ),
    "dedup_tasks": _sql(
        "SELECT task_id, ms FROM chain",
        "tasks",
        copies="""SELECT task_id, epoch_us(seen_at) // 1000 + m * 60000 AS ms
            FROM tasks, (SELECT unnest([0, 5, 15, 20]) AS m)""",
        **_chain("copies", "task_id", 15 * 60_000),
    ),
    "resolve_attempts": _sql(
        f"""SELECT task_id, attempts, state,
                CASE WHEN state = 'RETRY' THEN strftime(last_at + to_microseconds(
                    CAST(least(10000, 1000 * 2 ** (attempts - 1)) * 1000 AS BIGINT)), {MICROS}) END AS next_at,
                CASE WHEN state = 'DEAD' THEN 'notifications.' || lower(channel) || '.dlq' END AS dead_letter
            FROM (SELECT task_id, channel, count(*) AS attempts, max(attempt_at) AS last_at,
                    CASE WHEN bool_or(ok) THEN 'DELIVERED' WHEN count(*) >= 3 THEN 'DEAD' ELSE 'RETRY' END AS state
                FROM attempts GROUP BY task_id, channel)""",
        "attempts",
    ),
    "drop_delivered": _sql(
        "SELECT task_id, count(*) AS attempts FROM attempts GROUP BY task_id HAVING NOT bool_or(ok)", "attempts"
    ),
    # discovery and region maintenance
    "discover_unrecognized": _sql(_UNRECOGNIZED, "unrecognized"),
    "merge_unrecognized": _sql(_UNRECOGNIZED, "unrecognized"),
    "review_queue": _sql(_UNRECOGNIZED, "unrecognized"),
    "purge_mapped_titles": _sql(
        """SELECT raw_title, occurrences_count FROM unrecognized
           WHERE raw_title NOT IN (SELECT trim(raw_title, ' ' || chr(9)) FROM mapping_requests)""",
        "unrecognized",
        "mapping_requests",
    ),
    "validate_regions": _sql("SELECT seq, coalesce(reason, '') AS reason FROM checked_requests", "checked_requests"),
    "add_regions": _sql(
        """SELECT 'table' AS status, region_id AS subject, display_name AS detail FROM regions
           UNION ALL SELECT 'table', region_id, trim(display_name) FROM settled WHERE outcome IS NULL
           UNION ALL SELECT 'rejected', region_id, seq || ' ' || outcome FROM settled WHERE outcome IS NOT NULL""",
        "regions",
        "checked_requests",
        settled=_SETTLED_REGIONS,
    ),
    "add_mappings": _sql(
        _MAPPING_RESULT, "mapped", "regions", "unrecognized", "mapping_requests", **_settled_mappings("mapping_requests")
    ),
    "assign_unrecognized": _sql(
        _MAPPING_RESULT
        + " UNION ALL SELECT 'rejected', NULL, seq || ' Unrecognized location not found' FROM wanted"
        + " WHERE wanted_title NOT IN (SELECT raw_title FROM unrecognized)",
        "mapped",
        "regions",
        "unrecognized",
        wanted="""SELECT c_custkey AS seq, 'Nation_' || CAST(c_custkey % 35 AS VARCHAR) AS wanted_title,
            'nation_' || CAST(c_custkey % 30 AS VARCHAR) || '_region' AS region_id FROM customer""",
        known="SELECT w.seq, u.raw_title, w.region_id FROM wanted w JOIN unrecognized u ON u.raw_title = w.wanted_title",
        **_settled_mappings("known"),
    ),
    "delete_mappings": _sql(
        """SELECT 'table' AS status, id FROM customer_mappings WHERE id NOT IN (SELECT o_custkey * 3 FROM orders)
           UNION ALL SELECT DISTINCT 'not found', o_custkey * 3 FROM orders
           WHERE o_custkey * 3 NOT IN (SELECT id FROM customer_mappings)""",
        "customer_mappings",
    ),
    "mapping_fk_check": _sql(
        "SELECT id, region_id IN (SELECT region_id FROM regions) AS valid FROM customer_mappings",
        "customer_mappings",
        "regions",
    ),
    "cascade_mappings": _sql(
        """SELECT id, region_id FROM customer_mappings WHERE region_id IN (SELECT region_id FROM regions)
           AND region_id NOT IN ('NATION_3_REGION', 'NATION_11_REGION')""",
        "customer_mappings",
        "regions",
    ),
    "load_seed_check": _sql(
        """SELECT 'INVALID_REGION' AS kind, region_id AS subject FROM checked_requests WHERE reason IS NOT NULL
           UNION ALL SELECT 'REPEATED_REGION', region_id FROM seed GROUP BY region_id HAVING count(*) > 1
           UNION ALL SELECT 'UNKNOWN_REGION', raw_title FROM customer_mappings
               WHERE region_id NOT IN (SELECT region_id FROM seed)
           UNION ALL SELECT 'REPEATED_TITLE', lower(raw_title) FROM customer_mappings
               GROUP BY lower(raw_title) HAVING count(*) > 1""",
        "checked_requests",
        "customer_mappings",
        "regions",
        seed="SELECT region_id FROM regions UNION ALL SELECT region_id FROM region_requests",
    ),
    "list_regions": _sql("SELECT region_id, display_name FROM region_requests ORDER BY region_id", "region_requests"),
    "list_mappings": _sql("SELECT id, raw_title, region_id FROM customer_mappings ORDER BY raw_title", "customer_mappings"),
    # subscriptions
    "subs_create": _changed("CREATE"),
    "subs_update": _changed("UPDATE"),
    "subs_delete": _changed("DELETE"),
    "subs_changes": _changed("CREATE", "UPDATE", "DELETE"),
    "subs_rejected": _sql(
        """SELECT seq, op, CASE WHEN channel IS NULL THEN 'channel must not be null'
                ELSE 'BLANK_REGION_ID' END AS reason
           FROM changes WHERE op = 'CREATE' AND (channel IS NULL OR trim(region_id) = '')
           UNION ALL
           SELECT c.seq, c.op, 'Subscription not found' FROM changes c
               LEFT JOIN (SELECT id, min(seq) AS gone FROM changes WHERE op = 'DELETE' GROUP BY id) d ON d.id = c.id
           WHERE c.op <> 'CREATE' AND (c.id NOT IN (SELECT id FROM subs) OR c.seq > d.gone)""",
        "subs",
        "changes",
    ),
    "deactivate_recipients": _sql(
        """SELECT id, CASE WHEN r.channel IS NULL THEN active ELSE FALSE END AS active
           FROM subs s LEFT JOIN recipients r ON r.recipient_address = s.recipient_address AND r.channel = s.channel""",
        "subs",
        "recipients",
    ),
    "deactivated_regions": _sql(
        "SELECT DISTINCT region_id FROM subs JOIN recipients USING (recipient_address, channel)", "subs", "recipients"
    ),
    "find_subscriptions": _sql(
        """SELECT 'user' AS search, id FROM subs WHERE user_id = 'Customer#000000007'
           UNION ALL SELECT 'user and active', id FROM subs WHERE user_id = 'Customer#000000007' AND active
           UNION ALL SELECT 'region', id FROM subs WHERE region_id = 'NATION_3_REGION'
           UNION ALL SELECT 'region and inactive', id FROM subs WHERE region_id = 'NATION_3_REGION' AND NOT active
           UNION ALL SELECT 'region in lower case', id FROM subs WHERE region_id = 'nation_3_region'
           UNION ALL SELECT 'inactive', id FROM subs WHERE NOT active
           UNION ALL SELECT 'all', id FROM subs""",
        "subs",
    ),
    "find_by_recipient": _sql(
        """SELECT 'every' AS search, id FROM subs WHERE recipient_address = 'topic-7' AND channel = 'NTFY'
           UNION ALL SELECT 'active', id FROM subs WHERE recipient_address = 'topic-7' AND channel = 'NTFY' AND active""",
        "subs",
    ),
    "find_by_user_region_channel": _sql(
        """SELECT id, user_id, region_id, channel FROM subs
           WHERE user_id = 'Customer#000000001' AND region_id = 'NATION_19_REGION' AND channel = 'NTFY'""",
        "subs",
    ),
    "get_subscription": _sql(f"SELECT {_SUB_COLUMNS} FROM subs WHERE id = 42", "subs"),
    # history
    "archive_alerts": _sql(f"SELECT {_HISTORY_COLUMNS} FROM history", "history"),
    "archive_quarantine": _sql("SELECT event_id, region_id FROM alerts WHERE num % 13 = 0", "alerts"),
    "alert_history_desc": _sql(
        f"SELECT {_HISTORY_COLUMNS} FROM history WHERE region_id = 'NATION_3_REGION' ORDER BY seen_at DESC", "history"
    ),
    "alert_history_between": _sql(
        f"SELECT {_HISTORY_COLUMNS} FROM history WHERE region_id = 'NATION_3_REGION' AND {_BETWEEN}", "history"
    ),
    "archive_anomalies": _sql(f"SELECT {_ANOMALY_COLUMNS} FROM anomalies", "alerts", **_anomalies(*_BIG)),
    "anomaly_history_desc": _sql(
        f"SELECT {_ANOMALY_COLUMNS} FROM anomalies WHERE region_id = 'NATION_3_REGION' ORDER BY seen_at DESC",
        "alerts",
        **_anomalies(*_BIG),
    ),
    "anomaly_history_between": _sql(
        f"SELECT {_ANOMALY_COLUMNS} FROM anomalies WHERE region_id = 'NATION_3_REGION' AND {_BETWEEN}",
        "alerts",
        **_anomalies(*_BIG),
    ),
}
