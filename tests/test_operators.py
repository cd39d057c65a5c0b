from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from logloom.functions import times
from logloom.operators import alerts, changes, commerce, delivery, fixwork, ingest, issues, quality, querylog, quota, relations, search
from logloom.operators import stream_query as sq
from logloom.sources import io
from logloom.streaming import jobs


def test_limit_rule():
    assert [sq.resolve_limit(n) for n in (None, 0, -5, "abc", float("nan"), 1000, 7, "50")] == [100, 100, 1, 100, 100, 200, 7, 50]
    assert sq.level_set("Error, bogus ,INFO") == ["error", "info"] and sq.level_set("x,y") == [] and sq.level_set(None) == []


def test_long_trace_ids(spark):
    stored = "t" * 63 + "…"
    df = spark.createDataFrame([("a", stored)], "id string, trace_id string")
    assert sq.stream_filter(df, trace="t" * 80).count() == 0
    assert sq.stream_filter(df, trace="t" * 80, normalize_key=True).count() == 1


def test_null_levels_survive_the_lowest_floor(spark):
    df = spark.createDataFrame([("a", None, "2024-01-01T00:00:00Z"), ("b", "debug", "junk")], "id string, level string, timestamp string")
    for floor in ("all", "debug", None, "odd"):
        assert sq.dashboard_filter(df, "2024-01-01T01:00:00Z", floor=floor, range_key="all").count() == 2
    assert sq.dashboard_filter(df, "2024-01-01T01:00:00Z", range_key="24h").count() == 1
    assert sq.dashboard_filter(df, "2024-01-01T01:00:00Z", floor="info", range_key="all").count() == 0


def test_paging_over_ties(spark):
    df = spark.createDataFrame([(f"e{i:02}", "2024-01-01T00:00:00Z" if i < 8 else "2024-01-02T00:00:00Z") for i in range(10)], "id string, timestamp string")
    page = sq.newest_first(df, 4).collect()
    # the plain cursor loses the ties, the safe one does not
    last = page[-1]
    assert sq.stream_filter(df, before=last["timestamp"]).count() == 0
    seen = [r["id"] for r in page]
    while True:
        rows = sq.page_after(df, last["timestamp"], last["id"], 4).collect()
        if not rows:
            break
        seen += [r["id"] for r in rows]
        last = rows[-1]
    assert seen == sorted(seen, reverse=True)[:2] + [f"e{i:02}" for i in range(7, -1, -1)] and len(set(seen)) == 10


def test_empty_pager(spark):
    row = sq.pager(spark.createDataFrame([], "id string"), requested=5).first()
    assert row.asDict() == {"total": 0, "pages": 1, "page": 1, "from_row": 0, "to_row": 0, "has_prev": False, "has_next": False}


def test_filters_reach_the_scan(tables):
    plan = tables.spark.read.parquet(f"{tables.directory}/orders.parquet").where("o_orderstatus = 'F'").select("o_orderkey")._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan
    narrow = tables.heavy.log_entries().select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint>" in narrow


def test_latest_run_window(spark):
    runs = spark.createDataFrame([("fresh", "p", "f", "e", "completed", "2024-01-03 00:00:00"), ("stale", "p", "g", "e", "completed", "2023-12-31 00:00:00"),
                                  ("active", "p", "h", "e", "running", "2020-01-01 00:00:00"), ("failed", "p", "f", "e", "failed", "2024-01-03 01:00:00")],
                                 "id string, project_id string, fingerprint string, log_entry_id string, status string, created_at string")
    got = {r["fingerprint"]: r["id"] for r in fixwork.latest_runs(runs, "2024-01-04T00:00:00Z", 48).collect()}
    assert got == {"f": "failed", "h": "active"}


def test_run_states(spark):
    events = [("a", 1, "queued"), ("a", 2, "completed"), ("a", 3, "running"), ("a", 4, "failed"), ("a", 5, "completed"), ("b", 1, "queued"), ("c", 1, "running")]
    df = spark.createDataFrame([(r, i, f"2024-01-01 00:00:0{i}", k) for r, i, k in events], "run_id string, event_id bigint, at string, kind string")
    got = {r["run_id"]: (r["status"], r["completed_at"]) for r in fixwork.run_states(df).collect()}
    assert got == {"a": ("failed", "2024-01-01 00:00:04"), "b": ("queued", None), "c": ("running", None)}


def test_one_work_item_for_many_repeats(spark):
    df = spark.createDataFrame([(f"e{i}", "p", "error", "c", f"failed after {i + 10} tries", f"2024-01-01T00:00:{i % 60:02}Z") for i in range(400)],
                               "id string, project_id string, level string, channel string, message string, timestamp string")
    none = spark.createDataFrame([], "id string, project_id string, fingerprint string, log_entry_id string, status string, created_at string")
    (row,) = fixwork.worklist(df, none, "2024-01-02T00:00:00Z").collect()
    assert row["repeats"] == 400 and row["log_entry_id"] == "e0"


def test_upsert_keeps_created_at(spark):
    cols = "k string, v string, created_at string, updated_at string"
    target = spark.createDataFrame([("a", "old", "1", "1"), ("b", "old", "1", "1")], cols)
    new = spark.createDataFrame([("a", "x", "2", "2"), ("a", "y", "3", "3"), ("c", "z", "2", "2"), ("c", None, "4", "4")], cols)
    got = {r["k"]: (r["v"], r["created_at"], r["updated_at"]) for r in changes.upsert(target, new, "k", ["updated_at"]).collect()}
    assert got == {"a": ("y", "1", "3"), "b": ("old", "1", "1"), "c": (None, "2", "4")}


def test_subscription_lifecycle(spark):
    users = spark.createDataFrame([(1, "cus_1")], "id bigint, stripe_id string")
    ev = "event_id bigint, at string, provider_id string, customer string, kind string, status string, price_id string, unit_price bigint, quantity int"
    rows = [(1, "1", "s1", "cus_1", "deleted", "x", None, None, None), (2, "2", "s1", "cus_1", "created", "trialing", "p1", 100, None),
            (3, "3", "s1", "cus_1", "updated", "active", "p2", 200, 9), (4, "4", "s2", "cus_0", "created", "active", "p", 1, 1),
            (5, "1", "s3", "cus_1", "created", "active", "p", 1, 3), (6, "2", "s3", "cus_0", "deleted", "x", None, None, None)]
    got = {r["provider_id"]: r for r in changes.sync_subscriptions(spark.createDataFrame(rows, ev), users).collect()}
    assert set(got) == {"s1", "s3"}
    assert (got["s1"]["provider_status"], got["s1"]["provider_price_id"], got["s1"]["unit_price"], got["s1"]["quantity"]) == ("active", "p2", 200, 1)
    assert (got["s3"]["provider_status"], got["s3"]["quantity"]) == ("canceled", 3)


def test_category_tree_ignores_cycles(spark):
    nodes = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "y", "X"), ("y", "x", "Y")], "id string, parent_id string, name string")
    assert {r["path"] for r in commerce.category_tree(nodes).collect()} == {"A", "A / B", "A / B / C"}


def test_range_lookup_bounds(spark):
    bands = spark.createDataFrame([(1, 0, 5, "a"), (1, 5, 25, "b"), (2, 0, 100, "c")], "zone int, low int, high int, rate string")
    rows = spark.createDataFrame([(1, 0.0), (1, 4.9), (1, 5.0), (1, 24.99), (1, 25.0), (2, 99.0)], "zone int, w double")
    got = sorted((r["zone"], r["w"], r["rate"]) for r in relations.range_lookup(rows, "w", bands, "low", "high", "zone", 10).collect())
    assert got == [(1, 0.0, "a"), (1, 4.9, "a"), (1, 5.0, "b"), (1, 24.99, "b"), (2, 99.0, "c")]


def test_related_rows_have_one_shape(spark):
    parents = spark.createDataFrame([("p",), ("q",), ("r",), (None,)], "k string")
    kids = spark.createDataFrame([("p", i) for i in range(30_000)] + [("q", 1), (None, 2)], "k string, i int")
    rows = relations.with_related(parents, kids, "k", ["i"]).collect()
    assert len(rows) == 30_003
    assert all(r["position"] == r["i"] for r in rows if r["k"] == "p") and [(r["position"], r["i"]) for r in rows if r["k"] == "q"] == [(0, 1)]
    assert [(r["position"], r["i"]) for r in rows if r["k"] in ("r", None)] == [(None, None)] * 2


def test_batches_respect_the_limits(spark):
    rows = [("s", i, "x" * (300 if i % 7 else 5000)) for i in range(2000)] + [("s", 5000, "y" * 20000), (None, 1, "z"), ("s", 6000, None)]
    packed = delivery.pack_batches(spark.createDataFrame(rows, "s string, o bigint, b string"), "s", "o", F.col("b"), 50, 10_000)
    per = packed.where("batch is not null").groupBy("s", "batch").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    worst = per.agg(F.max("n"), F.max("b")).first()
    assert worst[0] <= 50 and worst[1] <= 20_000
    assert packed.count() == 2003 and packed.where("batch is null").count() == 1
    large = spark.createDataFrame([("s", 1, "a" * 262_143), ("s", 2, "b" * 262_144), ("s", 3, "c" * 196_608), ("s", 4, "d" * 196_608)], "s string, o bigint, b string")
    framed = delivery.pack_batches(large, "s", "o", F.col("b")).groupBy(F.coalesce("batch", F.col("o").cast("string"))).agg((F.sum("bytes") + F.count("*") + 20).alias("b"))
    assert framed.agg(F.max("b")).first()[0] < 512 * 1024


def test_moments_and_spikes(spark):
    base = "id string, project_id string, level string, channel string, message string, timestamp string"
    days = [("a", "01T10"), ("b", "01T23"), ("c", "04T22"), ("d", "08T00"), ("e", "08T01")]
    df = spark.createDataFrame([(i, "p", "error", "c", "boom", f"2024-01-{d}:00:00Z") for i, d in days] + [("z", "p", "error", "c", "boom", "junk")], base)
    got = {(r["moment"], r["log_entry_id"]) for r in issues.issue_moments(df, 3).collect()}
    assert got == {("new", "a"), ("regression", "d")}
    hours = [(f"h{h}-{i}", "p", "info", "c", "m", f"2024-01-{1 + h // 24:02}T{h % 24:02}:00:00Z") for h in range(30) for i in range(50 if h == 28 else 2 if h % 3 else 0)]
    (spike,) = issues.spikes(spark.createDataFrame(hours, base)).collect()
    assert spike["hour"] == "2024-01-02 04:00:00" and spike["events"] == 50


def test_payload_escaping(spark):
    import json
    cols = "project_id string, project_name string, issue_id string, title string, culprit string, level string, environment string, count bigint, kind string"
    rows = [("p", "A&B", "i1", 'say "<hi>" & go', None, None, "", 3, "regression"), ("p", "N", "test", "t" * 300, "x", "info", "e", 3, "new")]
    out = {r["issue_id"]: r for r in alerts.render(spark.createDataFrame(rows, cols), app="demo").collect()}
    slack = json.loads(out["i1"]["slack"])
    assert slack["text"] == '[demo] Regression in A&B: say "<hi>" & go'
    assert slack["blocks"][1]["text"]["text"] == '*<http://localhost:3000/issue/i1|say "&lt;hi&gt;" &amp; go>*\nAn issue you resolved is happening again.'
    assert [f["text"] for f in slack["blocks"][2]["fields"]] == ["*Project*\nA&amp;B", "*Level*\nerror", "*Occurrences*\n3"]
    discord = json.loads(out["test"]["discord"])["embeds"][0]
    assert len(discord["title"]) == 240 and discord["url"].endswith("/dashboard") and [f["inline"] for f in discord["fields"]] == [True, True, False, True]


def test_quality_rules(spark):
    df = spark.createDataFrame([(1, "a@b.co", 1.25), (2, None, -3.0), (3, "bad", 2.0)], "id int, email string, n double")
    checked = quality.validate(df, [("email", quality.email(F.col("email"))), ("positive", quality.positive(F.col("n"))), ("digits", quality.decimal_digits(F.col("n"), 0, 1))])
    assert {r["id"]: r["errors"] for r in checked.collect()} == {1: ["digits"], 2: ["email", "positive"], 3: ["email"]}
    good, bad = quality.split(checked)
    assert (good.count(), bad.count()) == (0, 3)


@pytest.mark.parametrize("raw, shape", [
    ("select * from t where a = 'it''s' and b in (1, 2,3)", "select * from t where a = ? and b in (?)"),
    ("SELECT  x1, 2.5\nFROM t2 WHERE y='a 9'", "SELECT x1, ? FROM t2 WHERE y=?")])
def test_normalize_query(one, raw, shape):
    assert one(querylog.normalize_query(F.col("q")), q=raw) == shape


def test_typos_and_terms(spark):
    assert [search.allowed_typos(t) for t in ("that", "thats", "wonderful")] == [0, 1, 2]
    assert search.allowed_typos("wonderful", {"wonderful"}) == 0
    df = spark.createDataFrame([("a", "Wonderful things"), ("b", "wondreful thing"), ("c", "wonder")], "id string, text string")
    assert {r["id"]: r["typos"] for r in search.fuzzy_search(df, "text", "wonderful things").collect()} == {"a": 0, "b": 3}
    assert df.select(search.highlight(F.col("text"), ["things"]).alias("x")).first()["x"] == "Wonderful <em>things</em>"


def test_future_clocks_cannot_close_windows(spark, tmp_path):
    rows = [("a", "2099-01-01T00:00:00Z", "2024-01-01T00:00:01Z"), ("b", "2024-01-01T00:00:02Z", "2024-01-01T00:00:03Z"),
            ("c", "2024-01-01T00:30:00Z", "2024-01-01T00:30:00Z")]
    for row in rows:
        spark.createDataFrame([(*row, "p", "error")], "id string, timestamp string, received_at string, project_id string, level string").coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema("id string, timestamp string, received_at string, project_id string, level string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    out = jobs.run_available(jobs.severity_windows(jobs.with_guarded_time(stream), "1 minute", late="1 minute"), "w").collect()
    assert [(r["total"], r["errors"]) for r in out] == [(2, 2)]


RAW = "request_id string, body string, header_key string, header_project string, forwarded_for string, real_ip string, direct_ip string, received_at string"


def test_stream_ingest_is_exactly_once(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    row = lambda i, b: (f"r{i}", b, None, "007", None, None, None, "2024-01-01T00:00:00Z")
    for i in range(2):
        bodies = ['{"logs":[{"message":"a"},{"message":"b","timestamp":"2099-01-01T00:00:00Z"},{"x":1}]}', "{broken", "{}", '{"message":"c","timestamp":"1999-05-05T00:00:00Z"}']
        spark.createDataFrame([row(10 * i + k, b) for k, b in enumerate(bodies)], RAW).coalesce(1).write.mode("append").parquet(src)
        q = jobs.start_ingest(io.stream_raw(spark, src), out, check)
        q.processAllAvailable()
        q.stop()
    log, bad = jobs.stored_entries(spark, out), jobs.stored_quarantine(spark, out)
    assert log.count() == 6 and log.select("id").distinct().count() == 6 and {r["project_id"] for r in log.collect()} == {"007"}
    assert sorted(r["event_date"] for r in log.collect()) == ["2024-01-01"] * 4 + ["unknown"] * 2
    assert sorted((r["request_id"], r["reason"]) for r in bad.collect()) == [("r1", "malformed"), ("r11", "malformed"), ("r12", "no log entries"), ("r2", "no log entries")]
    # the last batch was written, but its commit is lost: it runs again
    newest = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    newest.with_name(f".{newest.name}.crc").unlink(missing_ok=True)
    q = jobs.start_ingest(io.stream_raw(spark, src), out, check)
    q.processAllAvailable()
    q.stop()
    assert jobs.stored_entries(spark, out).count() == 6 and jobs.stored_quarantine(spark, out).count() == 4
    plain = ingest.normalize_requests(spark.read.schema(RAW).parquet(src))
    assert sorted(jobs.stored_entries(spark, out).drop("event_date").collect()) == sorted(plain.collect())


def test_stream_ingest_does_not_sort_its_rows(spark, tmp_path, monkeypatch):
    """A task writes its days side by side; with more days than it may hold open the same rows are written."""
    days = [f"2024-01-{d:02d}T00:00:00Z" for d in range(1, 6)]
    rows = [(f"r{i}", '{"message":"a%d"}' % i if i % 4 else "{", None, "p", None, None, None, days[i % 5]) for i in range(40)]
    spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(str(tmp_path / "src"))
    found = []
    for most in (jobs.OPEN_DAYS, 2):
        monkeypatch.setattr(jobs, "OPEN_DAYS", most)
        out = str(tmp_path / f"out{most}")
        jobs.start_ingest(io.stream_raw(spark, str(tmp_path / "src")), out, str(tmp_path / f"check{most}"), once=True).awaitTermination()
        found.append((sorted(jobs.stored_entries(spark, out).collect()), sorted(jobs.stored_quarantine(spark, out).collect())))
        store = spark._jsparkSession.sharedState().statusStore()
        runs = store.executionsList()
        plans = [p for p in (runs.apply(i).physicalPlanDescription() for i in range(runs.size())) if f"{out}/stream=" in p]
        assert plans and not any("Sort" in p for p in plans)
    assert found[0] == found[1] and len(found[0][0]) == 30 and len(found[0][1]) == 10
    assert {r["event_date"] for r in found[0][0]} == {d[:10] for d in days}
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_written_log_keeps_its_partition_types(spark, tables, tmp_path):
    from logloom.operators import fixwork
    as_of = "2024-01-31T00:00:00.000Z"
    entries = tables.log_entries().withColumn("project_id", F.regexp_replace("project_id", "proj-", "00"))
    for name, rows in (("known", entries), ("unknown", entries.unionByName(entries.limit(2).withColumn("timestamp", F.lit("no time"))))):
        path = str(tmp_path / name)
        io.append_entries(rows, path)
        log = io.read_entries(spark, path)
        assert dict(log.dtypes)["event_date"] == dict(log.dtypes)["project_id"] == "string"
        assert {r[0] for r in log.select("project_id").distinct().collect()} == {f"00{i}" for i in range(5)}
        for span in ("24h", "7d"):
            assert sorted(r["id"] for r in sq.in_range(log, span, as_of).collect()) == sorted(r["id"] for r in sq.in_range(rows, span, as_of).collect())
        assert issues.retain(log, as_of, 5).count() == issues.retain(rows, as_of, 5).count()
        key = ["id", "occurrences"]
        assert sorted(fixwork.recent_occurrences(rows.limit(40), log, as_of).select(key).collect()) == sorted(fixwork.recent_occurrences(rows.limit(40), rows, as_of).select(key).collect())


ALERT_LOG = "id string, project_id string, level string, channel string, message string, timestamp string, received_at string"


def test_alerts_are_throttled_over_batches_and_a_restart(spark, tmp_path):
    from logloom.streaming.alerts import first_seen_alerts
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    word = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    when = lambda m: f"2024-01-{1 + m // 1440:02d}T{m // 60 % 24:02d}:{m % 60:02d}:00.000Z"

    def add(rows):
        spark.createDataFrame([(f"e{m:06}{i:03}", p, "error", "c", f"fails {word(s)}", when(m), when(m)) for i, (p, s, m) in enumerate(rows)], ALERT_LOG).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(ALERT_LOG).option("maxFilesPerTrigger", 1).parquet(src)
        q = (first_seen_alerts(jobs.with_guarded_time(stream), remember="1 day", late="1 minute").writeStream.format("parquet").option("checkpointLocation", check)
             .trigger(availableNow=True).start(out))
        q.awaitTermination()
        return q

    add([("hot", s % 12, s % 30) for s in range(200)] + [("calm", 1, 0)])
    run()
    add([("hot", s, 40) for s in range(10, 40)])
    run()
    add([("hot", s, 61) for s in range(30, 60)])
    run()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == len({(r["project_id"], r["fingerprint"]) for r in rows}) == 61
    sent = [r["ms"] for r in rows if r["sent"] and r["project_id"] == "hot"]
    first = min(sent)
    # 12 and 3 in the first hour, 15 in the second
    assert sum(t < first + 3_600_000 for t in sent) == 15 and len(sent) == 30
    held = lambda q: [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]
    # two days later all shapes are forgotten, and the first one is new again
    add([("calm", 99, 2 * 1440 + 300)])
    run()
    add([("hot", 0, 2 * 1440 + 301)])
    q = run()
    again = [r for r in spark.read.parquet(out).collect() if r["ms"] > 2 * 86_400_000 + first]
    assert {r["project_id"] for r in again} == {"calm", "hot"} and all(r["sent"] for r in again)
    assert held(q) < 20


def test_spikes_survive_one_bad_clock(spark):
    base = "project_id string, timestamp string"
    hours = [("p", f"2024-01-01T{h:02d}:00:00.000Z") for h in range(24)] + [("p", "2024-01-02T00:10:00.000Z")] * 30 + [("p", "9999-01-01T00:00:00.000Z")] * 12
    rows = issues.spikes(spark.createDataFrame(hours, base)).collect()
    assert {(r["hour"], r["events"]) for r in rows} == {("2024-01-02 00:00:00", 30), ("9999-01-01 00:00:00", 12)}


def test_resent_entries_are_told_apart_by_every_field(spark):
    from logloom.schema import LOG_ENTRY
    from logloom.streaming import jobs
    names = [p.split()[0] for p in LOG_ENTRY.replace("\n", " ").split(",")]
    row = dict.fromkeys(names, None) | {"id": "1", "message": "m"}
    rows = [row, row | {"id": "2"}, row | {"trace_id": "x"}, row | {"request_id": "x"}, row | {"context": "{}"}, row | {"trace_id": ""}]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], LOG_ENTRY)
    hashes = [r[0] for r in df.select(jobs.client_hash()).collect()]
    assert hashes[0] == hashes[1] and len(set(hashes)) == 5


def test_open_counters_know_only_the_past(spark):
    hits = spark.createDataFrame([(i, "k", ms, 1) for i, ms in enumerate((0, 1000, 2000, 8000))], "hit_id bigint, key string, ms bigint, charge bigint")
    count = lambda limit, mode: [r["count"] for r in quota.open_windows(hits, limit, 10_000, 1500, mode).collect()]
    assert count(5, "memory") == [2] and count(1, "memory") == [1] and count(1, "shared") == [2]


def test_category_tree_by_doubling(spark):
    rows = [(0, None, "r")] + [(i, i - 1, f"n{i}") for i in range(1, 37)] + [(100, 200, "lost"), (101, 100, "loster"), (300, 301, "a"), (301, 300, "b"), (302, 301, "c"), (400, None, "s")]
    got = {r["id"]: (r["depth"], r["path"]) for r in commerce.category_tree(spark.createDataFrame(rows, "id int, parent_id int, name string")).collect()}
    expect = {i: (i, " / ".join(["r", *(f"n{j}" for j in range(1, i + 1))])) for i in range(37)} | {400: (0, "s")}
    assert got == expect


def test_a_parent_with_most_children_is_spread(spark, monkeypatch):
    from logloom.operators import skew
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "k int, name string")
    children = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 0), (9, 5), (None, 7)], "k int, v int")
    salted = lambda *args, **kw: skew.salted_join(*args, **kw, min_rows=20)
    monkeypatch.setattr(relations, "salted_join", salted)
    rows = relations.with_related(parents, children, "k", ["v"]).collect()
    assert [c for c in rows[0].asDict()] == ["k", "name", "v", "position"]
    assert sorted(r["v"] for r in rows if r["k"] == 1) == list(range(300)) and sorted(r["position"] for r in rows if r["k"] == 1) == list(range(300))
    assert sorted((str(r["k"]), r["name"], r["v"]) for r in rows if r["k"] != 1) == [("2", "b", 0), ("3", "c", None), ("None", "d", None)]


def test_ranking_by_the_smallest_window(spark):
    """Places, windows and ranks against all combinations of places; one text has its terms far behind."""
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefg") for _ in range(r.randint(0, 14))) for _ in range(150)]
    texts += ["", "x " * 5000 + "alpha " + "y " * 40 + "b a", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {x["id"]: x for x in search.ranked(df, "text", "a b c", 1000, [], "id").collect()}
    for i, text in enumerate(texts):
        words = (text or "").split()
        lists = [[p for p, w in enumerate(words, 1) if w == t] for t in "abc"]
        held = [at for at in lists if at]
        if not held:
            assert i not in got
            continue
        window = min(max(p) - min(p) + 1 for p in itertools.product(*held))
        row = got[i]
        assert (row["words"], row["proximity"]) == (len(held), window - len(held) if len(held) > 1 else None)
        assert row["attribute"] == min(at[0] for at in held)
    keys = [(-x["words"], math.inf if x["proximity"] is None else x["proximity"], x["attribute"], i) for i, x in got.items()]
    assert keys == sorted(keys) and got[151]["proximity"] == 0 and got[151]["attribute"] == 5042


def test_order_key_follows_the_text(spark):
    r = random.Random(5)
    base = ["2024-01-15T08:00:00.000Z", "2023-12-31T23:59:59.999Z", "2024-01-15T08:00:00.001Z", "9999-99-99T99:99:99.999Z"]
    texts = [*base, "", "junk", "2024", "2024-01-15", "2024-01-15 08:00:00", "2024-01-15T08:00:00Z", "2024-01-15T08:00:00.000+02:00", "é", "~"]
    for _ in range(400):
        t = r.choice(base)
        cut = r.randint(0, len(t))
        texts.append(t[:cut] + r.choice(["", " ", "0", "5", "9", ":", "-", "Z", "z", "é"]) + t[cut + r.randint(0, 2):])
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    keys = sorted((x["t"].encode(), x["k"]) for x in df.select("t", times.order_key(F.col("t")).alias("k")).collect())
    assert all(a[1] <= b[1] for a, b in zip(keys, keys[1:], strict=False))
    assert len({k for t, k in keys if t.decode() in base}) == len(base)
    assert spark.range(1).select(times.order_key(F.lit(None).cast("string")).alias("k")).first()["k"] == -1


def test_first_events_over_odd_times_and_ties(spark):
    """Against plain sorting; many events share a millisecond or have unreadable times, one project is NULL."""
    r = random.Random(8)
    moments = ["2024-01-15T08:00:00.000Z", "2024-01-15T08:00:00.001Z", "2024-01-15T08:00:00Z", "2024-01-15", "junk", "", "2024-02-01T00:00:00.000Z"]
    rows = [(f"e{i}", r.choice(["p", "q", None]), r.choice(["error", "info"]), r.choice(["slow", "down", "gone"]), r.choice(["http", None]), r.choice(["prod", None]), r.choice(["1", "2", None]), r.choice(moments)) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, project_id string, level string, message string, channel string, environment string, release string, timestamp string").repartition(5)
    groups = {}
    for x in fixwork.with_fingerprint(df).collect():
        groups.setdefault((x["project_id"], x["fingerprint"]), []).append(x)
    rolled = issues.issue_rollup(df)
    got = {(x["project_id"], x["fingerprint"]): x for x in rolled.collect()}
    released = {(x["project_id"], x["fingerprint"]): x["first_release"] for x in issues.first_releases(df).collect()}
    assert got.keys() == groups.keys() == released.keys()
    for k, events in groups.items():
        first = min(events, key=lambda x: (x["timestamp"], x["id"]))
        row = got[k]
        assert (row["events"], row["first_seen"], row["last_seen"]) == (len(events), first["timestamp"], max(x["timestamp"] for x in events))
        assert (row["title"], row["first_release"], row["channel"], row["environment"]) == (first["message"], first["release"], first["channel"], first["environment"])
        assert released[k] == first["release"]
    plan = rolled._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan
