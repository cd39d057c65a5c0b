from __future__ import annotations

import json

from pyspark.sql import functions as F

from logloom.functions import text
from logloom.operators import ingest
from logloom.sources import io


def requests(spark, bodies, **extra):
    rows = [(f"r{i}", b if isinstance(b, str) or b is None else json.dumps(b), "k", "p", "2024-01-01T00:00:00.000Z") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "request_id string, body string, header_key string, header_project string, received_at string")


def rows_of(spark, *bodies):
    got = ingest.normalize_requests(requests(spark, bodies)).collect()
    return [r.asDict() for r in got]


def accounts(spark, *bodies):
    got = ingest.accounting(requests(spark, bodies)).orderBy("request_id").collect()
    return [(r["stored"], r["dropped"], r["skipped"]) for r in got]


def test_extract(spark):
    got = accounts(spark, {"logs": [{"message": "a"}]}, {"message": "a"}, {"level": "info"}, {"logs": [{"message": "b"}], "message": "c"},
                   {"logs": "x", "message": "c"}, "not json", [1, 2], None)
    assert got == [(1, 0, 0), (1, 0, 0), (0, 0, 0), (1, 0, 0), (1, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_mixed_and_overflow(spark):
    ok = {"message": "m"}
    got = accounts(spark, {"logs": [ok, {}, None, {"level": "x"}, 5, "x", '{"message":"no"}']}, {"logs": [ok] * 600},
                   {"logs": [ok if i % 2 else {} for i in range(500)] + [ok] * 10}, {"logs": []})
    assert got == [(1, 0, 6), (500, 100, 0), (250, 10, 250), (0, 0, 0)]


def test_overflow_rows_are_the_first(spark):
    rows = rows_of(spark, {"logs": [{"message": f"m{i}"} for i in range(505)]})
    assert {r["message"] for r in rows} == {f"m{i}" for i in range(500)}
    assert len({r["id"] for r in rows}) == 500


def test_ids_repeat_on_retry(spark):
    body = {"logs": [{"message": "a"}, {"message": "a"}]}
    assert sorted(r["id"] for r in rows_of(spark, body)) == sorted(r["id"] for r in rows_of(spark, body))


def test_fields(spark):
    (r,) = rows_of(spark, {"message": "m", "level": "error", "traceId": "t1", "trace_id": "t0", "requestId": "q1", "project": "other",
                           "key": "x", "timestamp": "2099-01-01T00:00:00Z", "user": {"id": 7}, "context": {"b": 1, "a": {"z": 2.5}, "user": {"id": 8}}})
    assert (r["project_id"], r["level"], r["trace_id"], r["request_id"], r["timestamp"]) == ("p", "error", "t0", "q1", "2099-01-01T00:00:00Z")
    assert r["context"] == '{"b":1,"a":{"z":2.5},"user":{"id":8}}' and r["user_context"] == '{"id":7}'
    assert (r["environment"], r["channel"], r["sdk"]) == ("production", None, None)


def test_defaults_and_coercion(spark):
    (r,) = rows_of(spark, {"message": 42, "level": "ERROR", "environment": "", "channel": True})
    assert (r["message"], r["level"], r["environment"], r["channel"], r["timestamp"]) == ("42", "info", "", "true", "2024-01-01T00:00:00.000Z")


def test_empty_message_is_stored(spark):
    (r,) = rows_of(spark, {"message": ""})
    assert r["message"] == ""


def test_json_columns(spark):
    cases = [({"a": 1}, '{"a":1}'), ("x", None), (5, None), (None, None), ({}, None), ([], None), ([1], "[1]"), ('{"a":1}', None)]
    for value, stored in cases:
        (r,) = rows_of(spark, {"message": "m", "context": value})
        assert r["context"] == stored, value
    (r,) = rows_of(spark, {"message": "m", "context": {"a": "x" * 99000}, "sdk": {"n": "y" * 5000}})
    assert r["context"] == r["sdk"] == text.OVERSIZED_JSON


def test_user_rules(spark):
    ctx = {"user": {"id": 8}}
    users = [({"user": {"id": 1}, "context": ctx}, '{"id":1}'), ({"context": ctx}, '{"id":8}'), ({"user": None, "context": ctx}, '{"id":8}'),
             ({"user": 5, "context": ctx}, None), ({"context": '{"user":{"id":8}}'}, None)]
    for fields, stored in users:
        (r,) = rows_of(spark, {"message": "m", **fields})
        assert r["user_context"] == stored, fields


def test_duplicate_keys_keep_the_last(spark):
    (r,) = rows_of(spark, '{"message":"first","message":"last"}')
    assert r["message"] == "last"


def test_caps(spark):
    (r,) = rows_of(spark, {"message": "x" * 20000, "host": "h" * 300, "trace_id": "t" * 70})
    assert r["message"] == "x" * 16384 + text.CLIP_MARK and len(r["host"]) == 255 and r["trace_id"] == "t" * 63 + "…"


def test_quarantine(spark):
    got = ingest.quarantine(requests(spark, [{"message": "m"}, "{broken", {"x": 1}, None]))
    assert {(r["request_id"], r["reason"]) for r in got.collect()} == {("r1", "malformed"), ("r2", "no log entries"), ("r3", "malformed")}


def test_admission_truth_table(spark):
    projects = spark.createDataFrame([("demo", "good", True), ("off", "k2", False), ("bare", None, True), ("null", "k4", None)],
                                     "id string, ingest_key string, is_active boolean")
    entry = json.dumps({"message": "m"})
    cases = [  # key, project, body, status, error
        ("good", "demo", entry, 201, None), ("good", None, entry, 201, None), ("good", "nope", entry, 404, "unknown project"),
        ("bad", None, entry, 404, "unknown project"), (None, None, entry, 404, "unknown project"), ("k2", "off", entry, 403, "project inactive"),
        ("x", "bare", entry, 403, "project has no ingest key"), (None, "bare", entry, 403, "project has no ingest key"),
        ("wrong", "demo", entry, 401, "invalid ingest key"), (None, "demo", entry, 401, "invalid ingest key"), ("", "demo", entry, 401, "invalid ingest key"),
        ("k4", "null", entry, 201, None), ("good", "demo", "{}", 400, "no log entries"),
        ("good", "demo", json.dumps({"message": "x" * 530000}), 413, "payload too large"),
        (None, None, json.dumps({"message": "m", "key": "good"}), 201, None), ("good", None, json.dumps({"message": "m", "p": "off"}), 403, "project inactive"),
    ]
    df = spark.createDataFrame([(f"{i:02}", b, k, p, "2024-01-01T00:00:00Z") for i, (k, p, b, _, _) in enumerate(cases)],
                               "request_id string, body string, header_key string, header_project string, received_at string")
    got = [(r["status"], r["error"]) for r in ingest.admission(df, projects).orderBy("request_id").collect()]
    assert got == [(s, e) for *_, s, e in cases]


def test_address_quota_comes_before_the_project(spark):
    projects = spark.createDataFrame([("demo", "good", True)], "id string, ingest_key string, is_active boolean")
    df = requests(spark, [{"message": "m"}, {"message": "m"}])
    over = spark.createDataFrame([("r1",)], "request_id string")
    got = {r["request_id"]: r["status"] for r in ingest.admission(df, projects, over).collect()}
    assert got == {"r0": 404, "r1": 429}


def test_readers_and_sink(spark, tmp_path):
    raw = requests(spark, [{"message": "a"}, {"message": "b"}]).selectExpr("*", "null forwarded_for", "null real_ip", "null direct_ip")
    for fmt, options in (("parquet", {}), ("json", {}), ("csv", {"header": "true", "escape": '"'})):
        raw.select(*[F.col(c).cast("string") for c in raw.columns]).write.format(fmt).options(**options).save(str(tmp_path / fmt))
        back = io.read_raw(spark, str(tmp_path / fmt), fmt, **({**options, "enforceSchema": "false"} if fmt == "csv" else options)) if fmt != "csv" \
            else spark.read.options(**options).csv(str(tmp_path / fmt))
        assert ingest.normalize_requests(back).count() == 2
    lines = tmp_path / "lines"
    raw.select("body").write.text(str(lines))
    bodies = io.read_bodies(spark, str(lines)).withColumn("received_at", F.lit("2024-01-01T00:00:00Z")).withColumn("header_project", F.lit("p"))
    assert {r["message"] for r in ingest.normalize_requests(bodies).collect()} == {"a", "b"}

    entries = ingest.normalize_requests(requests(spark, [{"message": "a", "timestamp": "2024-01-05T00:00:00Z"}, {"message": "b", "timestamp": "junk"}]))
    out = str(tmp_path / "log")
    io.append_entries(entries, out)
    io.append_entries(entries, out)
    log = io.read_entries(spark, out)
    assert log.count() == 4
    plan = log.where((F.col("project_id") == "p") & (F.col("event_date") == "2024-01-05"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(project_id" in plan
    assert io.drop_partitions_before(log.withColumn("event_date", F.col("event_date").cast("string")), "2024-01-05").count() == 4


def test_day_pruning_reaches_the_stored_log(spark, tables, tmp_path):
    from logloom.operators import fixwork, issues, stream_query
    from logloom.sources import io
    path = str(tmp_path / "log")
    late = tables.log_entries().limit(3).withColumn("timestamp", F.lit("not a time"))
    io.append_entries(tables.log_entries().unionByName(late), path)
    stored, as_of = io.read_entries(spark, path), "2024-01-31T00:00:00.000Z"
    for plan, plain in ((stream_query.in_range(stored, "24h", as_of), stream_query.in_range(tables.log_entries(), "24h", as_of)),
                        (issues.retain(stored, as_of, 10), issues.retain(tables.log_entries(), as_of, 10).unionByName(late))):
        assert "event_date" in plan._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
        assert plan.count() == plain.count()
    counts = fixwork.recent_occurrences(tables.log_entries().limit(50), stored, as_of)
    assert sorted(counts.collect()) == sorted(fixwork.recent_occurrences(tables.log_entries().limit(50), tables.log_entries().unionByName(late), as_of).collect())


def test_time_ahead_of_arrival_goes_to_the_unknown_day(spark):
    from logloom.sources import io
    rows = spark.createDataFrame([("2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z"), ("2099-01-02T00:00:00Z", "2024-01-03T00:00:00Z"), ("x", "2024-01-03T00:00:00Z")], "timestamp string, received_at string")
    assert [r["event_date"] for r in io.with_partitions(rows, F.col("received_at")).collect()] == ["2024-01-02", "unknown", "unknown"]


def test_request_ids_survive_another_file(spark, tmp_path):
    from logloom.sources import io
    (tmp_path / "b.txt").write_text("same\nsame\nother\n" * 50)
    ids = lambda: sorted(r["request_id"] for r in io.read_bodies(spark, str(tmp_path)).collect())
    before = ids()
    (tmp_path / "a.txt").write_text("same\nmore\n")
    after = ids()
    assert len(set(before)) == 150 and len(set(after)) == 152 and set(before) <= set(after)
