from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import correlate
from logloom.operators.skew import hot_keys, salted_join

SCHEMA = "id string, project_id string, channel string, timestamp string, trace_id string, request_id string"


def log(rows=600, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        hot = i % 2 == 0  # one trace, project and channel with half of the rows
        minute = rng.randrange(40) if not hot else rng.choice([5, 5, 5, 30])
        out.append((f"e{i:04}", "p0" if hot else f"p{rng.randrange(3)}", "c" if hot else rng.choice([None, "", "c"]),
                    f"2024-01-01T00:{minute:02}:{rng.randrange(3):02}", "hot" if hot and i % 4 == 0 else rng.choice([None, "", "t1", "t2"]),
                    rng.choice([None, "r1", ""])))
    return out


def brute(rows, k):
    out = {}
    for t in rows:
        tid, project, channel, ts, trace, request = t
        if trace or request:
            col = 4 if trace else 5
            near = sorted((r[3], r[0]) for r in rows if r[1] == project and r[col] == (trace or request) and r[0] != tid)[:k]
        else:
            near = sorted((r[3], r[0]) for r in rows if r[1] == project and (r[2] or "") == (channel or "") and r[3] < ts)[-k:]
        if near:
            out[tid] = [i for _, i in near]
    return out


@pytest.mark.parametrize("k, min_rows", [(12, 10), (3, 1_000_000), (40, 2)])
def test_surrounding_matches_brute_force(spark, k, min_rows):
    rows = log()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = correlate.surrounding(df, df, k, min_rows=min_rows).collect()
    assert len(got) == len({r["id"] for r in got})
    assert {r["id"]: [o["id"] for o in r["around"]] for r in got if r["around"]} == brute(rows, k)


def test_preceding_with_short_buckets(spark):
    rows = [(i, p, c, t, None, None) for i, p, c, t, _, _ in log(300, 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    for chars in (10, 14, 16, 19):
        got = correlate.preceding(df, df, 5, bucket_chars=chars, min_rows=3).collect()
        assert {r["id"]: [o["id"] for o in r["around"]] for r in got} == brute(rows, 5), chars


def test_limit_zero(spark):
    df = spark.createDataFrame(log(20), SCHEMA)
    assert correlate.surrounding(df, df, 0).count() == 0


def test_rank_filter_prunes_before_the_shuffle(spark):
    df = spark.createDataFrame(log(20), SCHEMA)
    plan = correlate.correlated(df, df)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    big = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}" if i % 5 else None) for i in range(400)], "i int, k string")
    few = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("k2", "z"), ("zz", "w")], "k string, v string")
    plain = big.join(few, "k", how)
    salted = salted_join(big, few, ["k"], how, min_rows=20)
    assert sorted(map(str, salted.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert hot_keys(big, ["k"], 100).count() == 1


def test_many_hot_keys_are_all_split(spark):
    big = spark.range(600 * 40 + 900).select(F.when(F.col("id") < 24_000, F.col("id") % 600).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    hot = {r["_hash"]: r["_parts"] for r in hot_keys(big, ["k"], 10).collect()}
    keys = {r["h"] for r in spark.range(600).select(F.xxhash64("id").alias("h")).collect()}
    assert set(hot) == keys and set(hot.values()) == {4}
    few = spark.range(700).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    joined = salted_join(big, few, ["k"], min_rows=10)
    assert joined.count() == 24_000
    plan = hot_keys(big, ["k"], 10)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "approx_top_k" in plan


def test_key_filter_lets_every_key_pass(spark):
    from logloom.operators.skew import key_filter
    keys = spark.createDataFrame([(f"k{i}", i % 3) for i in range(500)] + [(None, 1)], "a string, b int")
    rows = spark.createDataFrame([(f"k{i}", i % 3) for i in range(5000)] + [(None, 1), ("k1", None)], "a string, b int")
    held = rows.where(key_filter(keys, ["a", "b"])(F.col("a"), F.col("b")))
    assert held.join(keys, ["a", "b"], "left_semi").count() == 500 and held.count() < 510
    assert rows.where(key_filter(keys.limit(0), ["a"])(F.col("a"))).count() == 0


def test_preceding_over_years_without_ranking_a_project(spark):
    rng = random.Random(4)
    rows = [(f"e{i:04}", "p", rng.choice(["c", ""]), f"{rng.choice([1999, 2023, 2024])}-{rng.choice([1, 12]):02}-{rng.choice([1, 31]):02}T0{rng.randrange(2)}:{rng.randrange(3):02}:00", None, None) for i in range(400)]
    rows += [("odd", "p", "c", "yesterday", None, None), ("void", "p", "c", "", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = correlate.preceding(df, df, 7).collect()
    assert {r["id"]: [o["id"] for o in r["around"]] for r in got} == {k: v for k, v in brute(rows, 7).items()}
    some = df.where("id like '%7'")
    part = correlate.preceding(some, df, 7).collect()
    assert {r["id"]: [o["id"] for o in r["around"]] for r in part} == {k: v for k, v in brute(rows, 7).items() if k.endswith("7")}


def test_evidence_budget(spark):
    rows = [("a", "p", "c", "2024-01-01T00:00:00Z", None, None, "error", "m" * 30000, "x" * 90000, "production", None, "1.0", None)]
    df = spark.createDataFrame(rows, SCHEMA + ", level string, message string, context string, environment string, framework string, release string, host string")
    seen = spark.createDataFrame([("a", 4)], "id string, occurrences bigint")
    text = correlate.evidence(df, df, seen, budget=1).first()["evidence"]
    assert "(no correlated entries)" in text and "last 7 days: 4" in text and "framework" not in text and "release: 1.0" in text
    assert "m" * 2048 + "\n...[truncated]" in text and "x" * 4096 + "\n...[truncated]" in text and "m" * 2049 not in text
    bare = correlate.evidence(df.withColumn("context", F.lit(None).cast("string")), df, seen).first()["evidence"]
    assert "## Context\n(none)" in bare
