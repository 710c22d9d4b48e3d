"""Documented cases of the operators that hold no state of their own."""

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from klaxon.functions import columns as C
from klaxon.operators import delivery, history, matching, regions, subscriptions
from klaxon.schemas import LOG_RECORD, SUBSCRIPTION, SUBSCRIPTION_CHANGE
from klaxon.sources import feeds, logs

def as_of():
    return F.to_timestamp(F.lit("2026-10-02T00:00:00Z"))

MAPPINGS = [
    (1, "м. київ", "KYIV_REGION"),
    (2, "львівська область", "LVIV_REGION"),
]


def mappings(spark, rows=MAPPINGS):
    df = spark.createDataFrame(rows, "id long, raw_title string, region_id string")
    return df.withColumns({"created_at": as_of(), "updated_at": as_of()})


def region_table(spark, *ids):
    df = spark.createDataFrame([(i, i.title()) for i in ids], "region_id string, display_name string")
    return df.withColumn("created_at", as_of())


def unrecognized(spark, *rows):
    df = spark.createDataFrame(list(rows), "id long, raw_title string, occurrences_count long")
    return df.withColumns({"first_seen_at": as_of(), "last_seen_at": as_of()})


def values(spark, make, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", make("x").alias("y")).orderBy("i").collect()]


def subs(spark, *rows):
    """rows: (id, user, channel, address, region, severity, active)"""
    shape = "id long, user_id string, channel string, recipient_address string, region_id string, min_severity string, active boolean"
    return spark.createDataFrame(list(rows), shape).withColumn("created_at", as_of())


def one(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_scalars(spark):
    assert values(spark, C.region_slug, ["Полтава ТГ", "!!!", "region", "foo region", "\t  Unknown Hromada\n"]) == [
        "ПОЛТАВА_ТГ_REGION",
        "_REGION",
        "REGION_REGION",
        "FOO_REGION",
        "UNKNOWN_HROMADA_REGION",
    ]
    assert values(spark, C.event_type, [None, " ", "AIR_RAID", "Artillery", "nuclear", "Drone Attack now"]) == [
        "AIR_RAID",
        "AIR_RAID",
        "AIR_RAID",
        "ARTILLERY",
        "RADIATION_RISK",
        "DRONE_ATTACK_NOW",
    ]
    assert values(spark, C.severity_weight, ["critical", "Warning", "INFO", "unknown", None]) == [3, 2, 1, 0, 0]
    assert values(spark, C.ntfy_priority, ["CRITICAL", "warning", "High", "LOW", "x", None]) == [
        "urgent",
        "high",
        "high",
        "low",
        "default",
        "default",
    ]
    assert values(spark, C.masked, [None, "a" * 35, "b" * 36]) == ["***", "***", "b" * 35 + "..."]
    assert values(spark, C.alert_title, ["KYIV_REGION", None]) == ["Alert: KYIV_REGION", "Alert: National"]
    late = ["2026-10-01T20:00Z", "2026-10-01t20:00:01z", "2026-10-01 20:00:00Z"]
    assert values(spark, lambda x: C.instant_text(C.parse_instant(x, as_of())), late) == [
        "2026-10-02T00:00:00.000Z",
        "2026-10-01T20:00:01.000Z",
        "2026-10-02T00:00:00.000Z",
    ]
    parse = lambda x: C.instant_text(C.parse_instant(x, as_of()))
    assert values(spark, parse, ["2026-10-01T20:00:00Z", "2026-10-01", None, "soon", "2026-10-01T20:00:00.1239+02:00"]) == [
        "2026-10-01T20:00:00.000Z",
        "2026-10-02T00:00:00.000Z",
        "2026-10-02T00:00:00.000Z",
        "2026-10-02T00:00:00.000Z",
        "2026-10-01T18:00:00.123Z",
    ]


def test_severity_minimum(spark):
    cases = [("INFO", None, True), ("INFO", "", True), ("INFO", "WARNING", False), ("warning", "Warning", True)]
    cases += [("unknown", "INFO", False), ("unknown", "unknown", True), ("INFO", "unknown", True), (None, " ", True)]
    df = spark.createDataFrame(cases, "severity string, minimum string, want boolean")
    assert df.filter(C.severity_sufficient("severity", "minimum") != F.col("want")).count() == 0


def test_snapshot_to_events(spark, tmp_path):
    alerts = [
        dict(id=101, location_title="м. Київ", alert_type="air_raid", started_at="2026-10-01T20:00:00Z", more=1),
        dict(id=102, location_title="Львівська область", alert_type="artillery_shelling", started_at="2026-10-01T20:10:00Z"),
        dict(id=103, location_title="  ", alert_type="air_raid"),
        dict(location_title="Полтава ТГ"),
    ]
    path = tmp_path / "snap.json"
    path.write_text(json.dumps({"alerts": alerts, "x": 1}) + "\n" + json.dumps({"disclaimer": "none"}) + "\n")
    events = feeds.snapshot_to_events(feeds.read_snapshots(spark, str(path)), mappings(spark), as_of())
    got = one(events.filter("event_id like 'alerts%'"), "event_id", "region_id", "event_type", "severity", "status")
    assert got == [
        ("alerts-in-ua-101", "KYIV_REGION", "AIR_RAID", "CRITICAL", "ACTIVE"),
        ("alerts-in-ua-102", "LVIV_REGION", "ARTILLERY", "CRITICAL", "ACTIVE"),
    ]
    (other,) = events.filter("event_id not like 'alerts%'").collect()
    assert other.region_id == "ПОЛТАВА_ТГ_REGION" and len(other.event_id) == 64


def test_unchanged_snapshots(spark):
    polls = [("f", i, v) for i, v in enumerate(["a", "a", None, "a", " ", "b", "b", "a"])] + [("g", 3, "a")]
    df = spark.createDataFrame(polls, "feed string, seq long, last_modified string").withColumn("payload", F.lit("{}"))
    for width in (1, 3, 100):
        kept = feeds.drop_unchanged_snapshots(df, polls_per_slot=width)
        assert one(kept, "feed", "seq") == [("f", 0), ("f", 2), ("f", 4), ("f", 5), ("f", 7), ("g", 3)]


def test_malformed_records(spark):
    good = json.dumps(dict(eventId="e", regionId="R", timestamp="2026-10-01T20:00:00Z", unknown=1))
    rows = [("t", 0, i, "k", v) for i, v in enumerate([good, good[:20], "", None, "[]", "  "])]
    ok, bad = logs.split_malformed(spark.createDataFrame(rows, LOG_RECORD))
    assert one(ok, "offset") == [(0,)]
    assert one(bad, "offset") == [(1,), (2,), (3,), (4,), (5,)]
    (event,) = logs.decode_alerts(spark.createDataFrame(rows, LOG_RECORD)).collect()
    assert (event.event_id, event.severity) == ("e", None)


def test_normalize_and_discover(spark):
    titles = ["м. Київ", "  ЛЬВІВСЬКА ОБЛАСТЬ  ", None, "   ", "Полтава ТГ", " Полтава ТГ\t", "полтава тг"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string").withColumn("at", as_of())
    got = [r.region_id for r in regions.normalize_regions(df, mappings(spark), "t").orderBy("i").collect()]
    assert got == ["KYIV_REGION", "LVIV_REGION", "UNKNOWN_REGION", "UNKNOWN_REGION"] + ["ПОЛТАВА_ТГ_REGION"] * 3
    found = regions.discover_unrecognized(df, mappings(spark), "t", "at")
    assert one(found, "raw_title", "occurrences_count") == [("Полтава ТГ", 2), ("полтава тг", 1)]
    stored = unrecognized(spark, (9, "Полтава ТГ", 2), (8, "Old", 1))
    merged = regions.merge_unrecognized(stored, found)
    assert one(merged.filter("raw_title <> 'полтава тг'"), "id", "raw_title", "occurrences_count") == [
        (8, "Old", 1),
        (9, "Полтава ТГ", 4),
    ]
    assert [r.raw_title for r in regions.review_queue(merged).collect()] == ["Полтава ТГ", "Old", "полтава тг"]


def test_region_requests(spark):
    requests = spark.createDataFrame(
        [
            (1, "CHERKASY_REGION", " Черкаська область "),
            (2, "KYIV_REGION", "again"),
            (3, "CHERKASY_REGION", "later"),
            (4, "bad id", "x"),
            (5, None, "x"),
            (6, "SUMY_REGION", " "),
        ],
        "seq long, region_id string, display_name string",
    )
    change = regions.add_regions(region_table(spark, "KYIV_REGION"), requests, as_of())
    assert one(change.regions, "region_id", "display_name") == [
        ("CHERKASY_REGION", "Черкаська область"),
        ("KYIV_REGION", "Kyiv_Region"),
    ]
    assert one(change.rejected, "seq") == [(2,), (3,), (4,), (5,), (6,)]


def test_mapping_requests(spark):
    requests = spark.createDataFrame(
        [
            (1, "м. Бровари", "NON_EXISTENT_REGION"),
            (2, " м. Бровари ", " kyiv_region "),
            (3, "М. БРОВАРИ", "LVIV_REGION"),
            (4, "м. Київ", "KYIV_REGION"),
        ],
        "seq long, raw_title string, region_id string",
    )
    found = unrecognized(spark, (1, "м. Бровари", 5), (2, "М. БРОВАРИ", 1))
    change = regions.add_mappings(
        mappings(spark), region_table(spark, "KYIV_REGION", "LVIV_REGION"), found, requests, as_of()
    )
    assert ("м. бровари", "KYIV_REGION") in one(change.mappings, "raw_title", "region_id")
    assert change.mappings.count() == 3
    assert one(change.unrecognized, "raw_title") == [("М. БРОВАРИ",)]
    assert one(change.rejected, "seq", "reason") == [
        (1, "NO_SUCH_REGION"),
        (3, "Mapping for title already exists"),
        (4, "Mapping for title already exists"),
    ]
    left, missing = regions.delete_mappings(mappings(spark), spark.createDataFrame([(1,), (77,)], "id long"))
    assert one(left, "id") == [(2,)] and one(missing, "id") == [(77,)]
    again = spark.createDataFrame([("м. київ",)], "t string")
    assert one(regions.normalize_regions(again, left, "t"), "region_id") == [("М_КИЇВ_REGION",)]


def test_assignment(spark):
    found = unrecognized(spark, (42, "Дрогобицький район", 3), (43, "дрогобицький район", 1))
    wanted = spark.createDataFrame(
        [(1, 42, "LVIV_REGION"), (2, 43, "LVIV_REGION"), (3, 99, "LVIV_REGION")], "seq long, id long, region_id string"
    )
    change = regions.assign_unrecognized(mappings(spark), region_table(spark, "LVIV_REGION"), found, wanted, as_of())
    assert ("дрогобицький район", "LVIV_REGION") in one(change.mappings, "raw_title", "region_id")
    assert one(change.unrecognized, "id") == [(43,)]
    assert one(change.rejected, "seq", "reason") == [
        (2, "Mapping for title already exists"),
        (3, "Unrecognized location not found"),
    ]


def test_seed(spark, tmp_path):
    (tmp_path / "r.csv").write_text("region_id,display_name\nKYIV_REGION,Київ\nbad,Bad\n")
    (tmp_path / "m.csv").write_text("raw_title,region_id\n М. КИЇВ,KYIV_REGION\nм. київ,KYIV_REGION\nx,NOWHERE\n")
    seed = regions.load_seed(spark, str(tmp_path / "r.csv"), str(tmp_path / "m.csv"), as_of())
    assert one(regions.check_seed(*seed), "kind", "subject") == [
        ("INVALID_REGION", "bad"),
        ("REPEATED_TITLE", "м. київ"),
        ("UNKNOWN_REGION", "x"),
    ]
    assert regions.check_seed(region_table(spark, "KYIV_REGION", "LVIV_REGION"), mappings(spark)).count() == 0


def test_matching(spark):
    table = subs(
        spark,
        (101, "user-101", "DISCORD", "a", "KYIV_REGION", "WARNING", True),
        (102, "user-102", "NTFY", "b", "KYIV_REGION", "WARNING", False),
        (103, "user-103", "NTFY", "c", "LVIV_REGION", "INFO", True),
        (104, "user-104", "NTFY", "d", "kyiv_region", None, True),
        (105, "user-105", "NTFY", "e", "KYIV_REGION", "CRITICAL", True),
        (106, "user-106", "NTFY", "f", " ", None, True),
    )
    alert = spark.createDataFrame(
        [("e1", "KYIV_REGION", "AIR_RAID", "WARNING"), ("e2", " ", "X", "INFO"), ("e3", None, "X", "INFO")],
        "event_id string, region_id string, event_type string, severity string",
    )
    tasks = matching.match_alerts(alert, table, as_of())
    assert one(tasks, "user_id", "message") == [("user-101", "Alert in KYIV_REGION: AIR_RAID [WARNING]")]
    anomaly = spark.createDataFrame(
        [("a1", "KYIV_REGION", "three", "CRITICAL"), ("a2", "ODESA_REGION", "x", "CRITICAL")],
        "anomaly_id string, region_id string, description string, severity string",
    ).withColumn("detected_at", as_of())
    tasks = matching.match_anomalies(anomaly, table, as_of())
    assert one(tasks, "user_id", "message") == [
        (u, "CRITICAL SPIKE ALERT in KYIV_REGION: three (Detected: 2026-10-02T00:00:00.000Z)")
        for u in ("user-101", "user-105")
    ]


def test_delivery(spark):
    tasks = spark.createDataFrame(
        [
            ("1", "DISCORD", "https://hooks/own", None, "m", "CRITICAL"),
            ("2", "DISCORD", "", "R", "m", "WARNING"),
            ("3", "NTFY", "custom-topic", "R", "m", "WARNING"),
            ("4", "NTFY", "https://elsewhere/x", "R", None, None),
            ("5", "NTFY", "", None, "m", "LOW"),
            ("6", None, "x", "R", "m", "INFO"),
        ],
        "task_id string, channel string, recipient_address string, region_id string, message string, severity string",
    )
    routed, rejected = delivery.route_tasks(tasks)
    assert dict(one(routed, "task_id", "routing_key")) == {
        **{t: "notification.discord" for t in "12"},
        **{t: "notification.ntfy" for t in "345"},
    }
    assert one(rejected, "task_id") == [("6",)]
    sent = delivery.outbox(tasks, "https://push/", "all", "https://hooks/default", None, dry_run=False)
    assert one(sent, "task_id", "target", "status", "payload")[:2] == [
        ("1", "https://hooks/own", "PENDING", '{"content":"m","username":null}'),
        ("2", "https://hooks/default", "PENDING", '{"content":"m","username":null}'),
    ]
    assert one(sent.filter("channel = 'NTFY'"), "task_id", "target", "title", "priority", "payload") == [
        ("3", "https://push/custom-topic", "Alert: R", "high", "m"),
        ("4", "https://elsewhere/x", "Alert: R", "default", ""),
        ("5", "https://push/all", "Alert: National", "low", "m"),
    ]
    none = delivery.outbox(tasks, "https://push", "all", " ", None, dry_run=False)
    assert one(none.filter("status = 'REJECTED'"), "task_id") == [("2",)]
    bare = delivery.ntfy_message(tasks.select("recipient_address", "message"), "https://push", "/all", "Notice")
    assert one(bare, "title", "priority")[0] == ("Notice", "high")


def test_attempts(spark):
    rows = [("ok-after-two", 0, False), ("ok-after-two", 1, True), ("one", 0, False), ("two", 0, False), ("two", 5, False)]
    rows += [("three", i, False) for i in range(3)]
    df = spark.createDataFrame(rows, "task_id string, s int, ok boolean").selectExpr(
        "task_id", "'NTFY' channel", "timestamp_seconds(s) attempt_at", "ok"
    )
    states = delivery.resolve_attempts(df).selectExpr("task_id", "state", "unix_millis(next_at)", "dead_letter")
    assert sorted(map(tuple, states.collect())) == [
        ("ok-after-two", "DELIVERED", None, None),
        ("one", "RETRY", 1000, None),
        ("three", "DEAD", None, "notifications.ntfy.dlq"),
        ("two", "RETRY", 7000, None),
    ]
    capped = delivery.resolve_attempts(df, max_attempts=9, longest_ms=3000).filter("task_id = 'three'")
    assert one(capped.selectExpr("unix_millis(next_at) n"), "n") == [(5000,)]
    tasks = df.select("task_id").distinct()
    assert one(delivery.drop_delivered(tasks, df), "task_id") == [("one",), ("three",), ("two",)]


def run_log(base, log):
    """The change log run one by one."""
    table = {r[0]: list(r) for r in base}
    refused = []
    for seq, op, key, user, channel, address, region, severity, active in sorted(log, key=lambda r: r[0]):
        blank = lambda x: x is None or not x.strip()
        if op == "CREATE":
            if blank(user) or channel not in ("DISCORD", "NTFY") or blank(address) or blank(region):
                refused.append(seq)
            else:
                table[f"new {seq}"] = [None, user, channel, address, region, "INFO" if blank(severity) else severity, True]
        elif op in ("UPDATE", "DELETE") and key in table:
            if op == "DELETE":
                del table[key]
                continue
            row = table[key]
            row[4] = row[4] if blank(region) else region
            row[5] = row[5] if blank(severity) else severity
            row[6] = row[6] if active is None else active
        else:
            refused.append(seq)
    return sorted(tuple(r[1:]) for r in table.values()), sorted(refused)


def test_subscription_changes(spark):
    base = [(i, f"u{i}", "NTFY", f"a{i}", "R", "INFO", True) for i in range(1, 7)]
    log = [
        (1, "UPDATE", 1, None, None, None, "LVIV_REGION", "CRITICAL", False),
        (2, "UPDATE", 2, None, None, None, " ", None, None),
        (3, "UPDATE", 2, None, None, None, "A", "", True),
        (4, "UPDATE", 2, None, None, None, None, "WARNING", False),
        (5, "DELETE", 3, None, None, None, None, None, None),
        (6, "UPDATE", 3, None, None, None, "B", None, None),
        (7, "DELETE", 3, None, None, None, None, None, None),
        (8, "UPDATE", 99, None, None, None, "B", None, None),
        (9, "CREATE", None, "n", "DISCORD", "x", "R", " ", None),
        (10, "CREATE", None, "n", None, "x", "R", None, None),
        (11, "CREATE", None, " ", "NTFY", "x", "R", None, None),
        (12, "UPDATE", None, None, None, None, "B", None, None),
        (13, "MOVE", 1, None, None, None, "B", None, None),
        (14, "UPDATE", 4, None, None, None, "C", None, None),
        (15, "DELETE", 4, None, None, None, None, None, None),
    ]
    change = subscriptions.apply_subscription_changes(
        subs(spark, *base), spark.createDataFrame(log, SUBSCRIPTION_CHANGE), as_of()
    )
    rows, refused = run_log(base, log)
    assert one(change.subscriptions, *[c for c in SUBSCRIPTION.names if c not in ("id", "created_at")]) == rows
    assert [s for (s,) in one(change.rejected, "seq")] == refused


def test_changes_of_a_created_subscription(spark):
    base = subs(spark, (1, "u", "NTFY", "a", "R", "INFO", True))
    create = (5, "CREATE", None, "n", "NTFY", "x", "R", None, None)
    made = subscriptions.created_rows(spark.createDataFrame([create], SUBSCRIPTION_CHANGE), as_of()).first().id
    log = [
        (2, "DELETE", made, None, None, None, None, None, None),
        (3, "UPDATE", made, None, None, None, "EARLY", None, None),
        create,
        (6, "UPDATE", made, None, None, None, "LATE", None, None),
    ]
    change = subscriptions.apply_subscription_changes(base, spark.createDataFrame(log, SUBSCRIPTION_CHANGE), as_of())
    assert one(change.subscriptions, "user_id", "region_id") == [("n", "LATE"), ("u", "R")]
    assert one(change.rejected, "seq") == [(2,), (3,)]


def test_single_operation_forms(spark):
    base = subs(spark, (1, "u", "NTFY", "a", "R", "INFO", True), (2, "v", "DISCORD", "b", "R", None, True))
    ids = spark.createDataFrame([(1, 1), (2, 9)], "seq long, id long")
    change = subscriptions.delete_subscriptions(base, ids, as_of())
    assert one(change.subscriptions, "id") == [(2,)] and one(change.rejected, "seq") == [(2,)]
    new = spark.createDataFrame([(1, "w", "NTFY", "c", "R")], "seq long, user_id string, channel string, recipient_address string, region_id string")
    made = subscriptions.create_subscriptions(base, new, as_of()).subscriptions.filter("user_id = 'w'")
    assert one(made, "min_severity", "active") == [("INFO", True)]
    off = subscriptions.deactivate_recipients(base, spark.createDataFrame([("a", "NTFY"), ("a", "NTFY")], "recipient_address string, channel string"))
    assert one(off, "id", "active") == [(1, False), (2, True)]


def test_history(spark, tmp_path):
    rows = [("e1", "R", "2026-10-01 23:59:59"), ("e2", "R", "2026-10-02 00:00:00"), ("e3", "R", "2026-10-03 10:00:00"), ("e4", "S", "2026-10-02 01:00:00"), ("e5", None, "2026-10-02 01:00:00")]
    alerts = spark.createDataFrame(rows, "event_id string, region_id string, t string").selectExpr(
        "event_id", "region_id", "'X' event_type", "'ACTIVE' status", "'INFO' severity", "cast(t as timestamp) event_timestamp", "'t' topic", "0 partition", "1L offset"
    )
    path = str(tmp_path / "h")
    assert one(history.archive_alerts(alerts, path, as_of()), "event_id") == [("e5",)]
    table = history.read_alert_history(spark, path)
    newest = history.history_of_region(table, "R", "event_timestamp")
    assert [r.event_id for r in newest.collect()] == ["e3", "e2", "e1"]
    at = lambda day, hour=0: datetime(2026, 10, day, hour, tzinfo=timezone.utc)
    found = history.history_between(table, "R", at(2), at(3, 10), "event_timestamp")
    assert one(found, "event_id") == [("e2",), ("e3",)]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "PushedFilters: [IsNotNull(region_id)" in plan


def test_matching_without_broadcast(spark):
    alert = spark.range(400).selectExpr(
        "concat('e', id) event_id", "if(id < 300, 'HOT', concat('R', id % 7)) region_id", "'X' event_type", "'INFO' severity"
    )
    table = spark.range(60).selectExpr(
        "id", "concat('u', id) user_id", "'NTFY' channel", "'a' recipient_address",
        "if(id < 40, 'HOT', concat('R', id % 7)) region_id", "cast(null as string) min_severity", "true active",
    )
    small = matching.match_alerts(alert, table, as_of())
    want = one(small, "event_id", "subscription_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert one(matching.match_alerts(alert, table, as_of()), "event_id", "subscription_id") == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(want) == len(set(want)) > 300 * 40


def test_blank_titles_and_region_ids(spark):
    from klaxon.functions import columns

    odd = [(" ", True), ("\u001c \t", True), (" ", False), ("", True), (None, True), ("a\n", False)]
    rows = spark.createDataFrame(odd, "t string, want boolean").withColumn("got", columns.is_blank("t"))
    assert rows.filter("got <> want").isEmpty()
    asked = spark.createDataFrame([(1, "ABC\n", "x"), (2, "ABC", "x"), (3, "AB C", "x")], "seq int, region_id string, display_name string")
    judged = {r["seq"]: r["reason"] for r in regions.validate_regions(asked).collect()}
    assert judged == {1: "BAD_REGION_ID", 2: None, 3: "BAD_REGION_ID"}


def test_repeated_polls_count_as_one(spark):
    polls = [("f", 1, "a", "p"), ("f", 1, "a", "p"), ("f", 2, "a", "q"), ("f", 2, "b", "r"), ("f", 3, "b", "s"), ("f", 4, "", "t")]
    df = spark.createDataFrame(polls, "feed string, seq long, last_modified string, payload string")
    kept = sorted(r["payload"] for r in feeds.drop_unchanged_snapshots(df).collect())
    assert kept == ["p", "p", "r", "t"]
