from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import quota
from logloom.streaming import jobs
from logloom.streaming.quota import closed_windows_stream, rate_limit_stream

SCHEMA = "hit_id string, key string, ms bigint, charge bigint"


def simulate(hits, limit, window_ms, mode):
    state, out = {}, {}
    for hit_id, key, ms, charge in sorted(hits, key=lambda h: (h[2], h[0])):
        opened, used = state.get(key, (None, 0))
        if opened is None or ms >= opened + window_ms:
            opened, used = ms, 0
        left = opened + window_ms - ms
        if mode == "shared":
            used += charge
            ok, retry = used <= limit, (left + 500) // 1000 or math.ceil(window_ms / 1000)
        else:
            ok, retry = used < limit, max(1, math.ceil(left / 1000))
            used += charge if ok else 0
        state[key] = (opened, used)
        out[hit_id] = (opened, ok, None if ok else retry)
    return out


def hits(n, seed, span, ties=1):
    rng = random.Random(seed)
    return [(f"h{i:05}", "hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}", rng.randrange(span) // ties * ties + 1_700_000_000_000, rng.choice([1, 1, 2, 5]))
            for i in range(n)]


@pytest.mark.parametrize("mode", ["memory", "shared"])
@pytest.mark.parametrize("n, span, ties, limit, segment", [(800, 60_000, 1, 20, None), (800, 300_000, 700, 9, 2_000), (300, 9_000_000, 1, 1, 3_000), (500, 4_000, 1000, 30, None)])
def test_distributed_quota_matches_simulation(spark, mode, n, span, ties, limit, segment):
    rows = hits(n, n + limit, span, ties)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["hit_id"]: (r["opened"], r["ok"], r["retry_after"]) for r in
           quota.rate_limit(df, limit, 2_000, mode, segment_ms=segment, min_rows=5).collect()}
    assert got == simulate(rows, limit, 2_000, mode)


@pytest.mark.parametrize("n, span, ties, window, segment, fan", [
    (900, 400_000, 1, 2_000, 500, 2), (900, 4_000, 1, 50, 40, 3), (600, 90_000, 10, 7_000, 900, 4), (400, 500, 1, 30, 30, 2), (200, 50_000_000, 1, 600_000, 1_000, 16)])
def test_windows_are_the_same_at_any_depth(spark, n, span, ties, window, segment, fan):
    rows = hits(n, n, span, ties)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {(r["key"], r["ms"]): r["opened"] for r in quota.anchored_windows(df, window, segment, fan, steps=5).collect()}
    opened, expect = {}, {}
    for _, key, ms, _ in sorted(rows, key=lambda h: h[2]):
        if key not in opened or ms >= opened[key] + window:
            opened[key] = ms
        expect[key, ms] = opened[key]
    assert got == expect


def test_dense_key_in_levels(spark):
    # every millisecond of more than an hour; windows follow each other without a gap
    n, window = 4_000_000, 10_000
    df = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") + 1_700_000_000_123).alias("ms"), F.lit(1).cast("bigint").alias("charge"))
    per_window = quota.anchored_windows(df, window, 60_000, 8, 100_000).groupBy("opened").agg(F.count("*").alias("n"), F.min("ms").alias("low"))
    bad = per_window.where((F.col("n") != window) | (F.col("low") != F.col("opened")) | ((F.col("opened") - 1_700_000_000_123) % window != 0))
    assert per_window.count() == n // window and bad.isEmpty()


def test_no_hits(spark):
    assert quota.rate_limit(spark.createDataFrame([], SCHEMA), 5, 1000).collect() == []


def test_first_batch_larger_than_the_limit(spark):
    rows = [("a", "k", 0, 500), ("b", "k", 1, 1), ("c", "k", 10_000, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    memory = {r["hit_id"]: r["ok"] for r in quota.rate_limit(df, 100, 10_000).collect()}
    shared = {r["hit_id"]: r["ok"] for r in quota.rate_limit(df, 100, 10_000, "shared").collect()}
    assert memory == {"a": True, "b": False, "c": True}
    assert shared == {"a": False, "b": False, "c": True}


def test_groups_cross_batch_borders():
    import pandas as pd
    frames = [pd.DataFrame({"key": ["a", "a"], "seg": [1, 1], "ms": [1, 2]}), pd.DataFrame({"key": ["a"], "seg": [1], "ms": [3]}),
              pd.DataFrame({"key": ["a", "b"], "seg": [2, 2], "ms": [4, 5]}), pd.DataFrame({"key": ["b"], "seg": [2], "ms": [6]})]
    got = [(g[0][0], int(g[1][0]), g[2].tolist()) for g in quota._groups(iter(frames), ["key", "seg", "ms"])]
    assert got == [("a", 1, [1, 2, 3]), ("a", 2, [4]), ("b", 2, [5, 6])]


@pytest.mark.parametrize("mode", ["memory", "shared"])
def test_streaming_state_spans_batches(spark, tmp_path, mode):
    rows = sorted(hits(300, 5, 60_000), key=lambda h: h[2])
    for i in range(3):
        part = rows[i * 100:(i + 1) * 100]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = {r["hit_id"]: (r["opened"], r["ok"], r["retry_after"]) for r in jobs.run_available(rate_limit_stream(stream, 7, 2_000, mode), "t").collect()}
    assert got == simulate(rows, 7, 2_000, mode)


@pytest.mark.parametrize("mode", ["memory", "shared"])
def test_idle_windows_close_and_leave_no_state(spark, tmp_path, mode):
    rows = sorted(hits(300, 9, 40_000), key=lambda h: h[2])
    for i in range(3):
        spark.createDataFrame(rows[i * 100:(i + 1) * 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    # time moves on by a hit of another key
    far = rows[-1][2] + 10_000_000
    spark.createDataFrame([("z", "other", far, 1)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    expect = {}
    verdicts = simulate(rows, 7, 2_000, mode)
    for hit_id, key, _, charge in rows:
        opened, ok, _ = verdicts[hit_id]
        n, used = expect.get((key, opened), (0, 0))
        expect[key, opened] = (n + 1, used + (charge if ok or mode == "shared" else 0))
    q = (closed_windows_stream(stream(), 7, 2_000, "1 minute", mode).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c1"))
         .trigger(availableNow=True).start(str(tmp_path / "o1")))
    q.awaitTermination()
    got = {(r["key"], r["opened"]): (r["hits"], r["used"]) for r in spark.read.parquet(str(tmp_path / "o1")).collect()}
    assert got == expect
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(state) > state[-1] and state[-1] <= 2
    judged = jobs.run_available(rate_limit_stream(stream(), 7, 2_000, mode, late="1 minute"), "t").collect()
    assert {r["hit_id"]: (r["opened"], r["ok"], r["retry_after"]) for r in judged if r["hit_id"] != "z"} == verdicts
