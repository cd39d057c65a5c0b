"""Operators over the whole corpus against plain versions and on odd input."""

from __future__ import annotations

import hashlib
import math
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import attention_lm, bpe, catalog, components, decontaminate, jaccard, secret_scan, sharding
from tools.check import compare

from ..conftest import DATA
from .conftest import by_id, documents, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def test_decontamination_matches_sql(spark):
    status, _, note = compare(spark, "op4", catalog.QUERIES["op4_decontamination"], catalog.SQL["op4_decontamination"], DATA)
    assert status == "ok", note


def _plain_hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j: j + n])].add(i)
    out = {}
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for key, ids in windows.items():
            for j in range(len(w) - len(key) + 1):
                if tuple(w[j: j + len(key)]) == key:
                    hit.update(range(j, j + len(key)))
                    found |= ids
        out[i] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    return out


def test_decontamination_odd_input(spark, odd, none):
    base, other = prose(1, 120), prose(9, 40)
    items = [(1, " ".join(base[5:40])), (2, " ".join(base[5:40])), (3, None), (4, ""), (5, "One!"), (6, "b, c; d"), (7, " ".join(other)),
             (None, " ".join(base[50:70])), (10, " ".join(["x"] * 30)), (1, "ti ti")]
    bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, token string")
    docs = documents(spark, [(20, " ".join([*base[5:13], "new", *base[13:30]]), "en"), (21, "X x " * 20, "en"), (22, "; ".join(other) + " b c d", "en")], clash=True).unionByName(odd)
    expect = _plain_hits([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    rows = decontaminate.decontaminate(docs, bench).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["items"]) == expect[r["doc_id"]], r["doc_id"]
        assert r["contaminated"] == (r["n_hit"] > 0)
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(odd, bench.limit(0)).collect())


def _plain_spans(text):
    t = text or ""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, t, re.I | re.A) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_secret_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = catalog.QUERIES["op5_secrets"](spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = _plain_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in secret_scan.BASE] == [sum(x[0] == k for x in spans) for k in secret_scan.BASE]


def test_secret_ledger(spark, odd, none, tmp_path):
    path = str(tmp_path / "ledger")
    rules = dict(secret_scan.RULES)
    ledger = secret_scan.update_ledger(odd, path, first=True)
    blobs = {hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in odd.collect()}
    assert sorted(r["blob"] for r in ledger.collect()) == sorted(blobs)
    # Nothing new: nothing is scanned. One new text: it alone, with all rules.
    assert secret_scan.increment(odd, ledger).count() == 0
    more = documents(spark, [(30, "token: ghp_" + "a1B2" * 10, "en"), (31, None, "en")]).unionByName(odd)
    new = secret_scan.increment(more, ledger).collect()
    assert len(new) == 1 and len(new[0]["rules"]) == len(rules)
    ledger = secret_scan.update_ledger(more, path)
    # A new rule version is run on every blob, the others are not run again.
    rules["hex"] = (2, r"[0-9a-f]+", 18, 0)
    again = secret_scan.increment(more, ledger, rules=rules).collect()
    assert len(again) == len(blobs) + 1 and all(r["rules"] == ["hex@2"] for r in again)
    ledger = secret_scan.update_ledger(more, path, rules=rules)
    found = by_id(secret_scan.findings_of(more, ledger, ["doc_id"], rules=rules).collect(), "findings")
    assert [(f["kind"], f["version"]) for f in found[14][0][0]] == [("assign", 1), ("access", 1)]
    assert [f["kind"] for f in found[30][0][0]] == ["assign", "github"]
    assert found[1] == [([],)] and len(found[6]) == 2
    assert secret_scan.increment(none, None).count() == 0
    marked = more.select("doc_id", "text", secret_scan.blob_of(F.col("text")).alias("b")).join(secret_scan.findings_by_blob(ledger, rules).select(F.col("blob").alias("b"), F.col("findings").alias("fs")), "b", "left")
    texts = {r["doc_id"]: r["t"] for r in marked.select("doc_id", secret_scan.masked(F.col("text"), F.col("fs")).alias("t")).collect()}
    assert texts[30] == "[SECRET]" and texts[14] == "[SECRET]' [SECRET] 0123456789abcdef0" and texts[1] is None


def _plain_components(rows):
    sets = []
    for i, t in rows:
        w = blank_words(t)
        sets.append((i, frozenset(tuple(w[j: j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    least = {}
    for (i, s), g in zip(sets, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [(i, len(s), (least.get(g) if s else i)) for (i, s), g in zip(sets, group, strict=True)]


def test_similar_documents(spark, odd, none):
    base, shared = prose(11, 200), prose(12, 60)
    rows = [(100 + k, " ".join([*base[:3 * k], f"edit{k}", *base[3 * k + 1:]]), "en") for k in range(40)]  # a hot group of near copies
    rows += [(200 + k, " ".join([*shared, *prose(300 + k, 70)]), "en") for k in range(40)]  # a passage that many share
    rows += [(300 + k, " ".join(base[6 * k:] + prose(500 + k, 2 * k)), "en") for k in range(1, 15)]  # chains at the threshold
    rows += [(400 + k, " ".join(prose(700, 90)), "en") for k in range(30)]  # copies
    docs = documents(spark, rows).unionByName(odd)
    plain = sorted(_plain_components([(r["doc_id"], r["text"]) for r in docs.collect()]), key=str)
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(docs).collect()), key=str)
    assert found == plain
    assert jaccard.similar_documents(none).count() == 0


def test_similar_documents_at_the_threshold(spark):
    """Clusters of edited copies whose members are similar or not by a word or two, of several sizes, some around a common half."""
    r = random.Random(8)
    rows = []
    for c in range(24):
        base, other = prose(1000 + c, r.choice([40, 60, 90, 140])), prose(2000 + c, 30)
        for k in range(16):
            words = list(base if k % 4 or c % 2 else base[: len(base) // 2] + other)
            for _ in range(r.randint(0, max(1, len(words) // 20))):
                at = r.randrange(len(words))
                words[at: at + r.choice([0, 1, 1, 3])] = r.choice([[], [f"w{r.randrange(4)}"], [f"v{r.random()}"], prose(r.randrange(9), 2)])
            rows.append((100 * c + k, " ".join(words), "en"))
    docs = documents(spark, rows)
    plain = sorted(_plain_components([(i, t) for i, t, _ in rows]))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(docs).collect()) == plain
    assert 24 < len({x[2] for x in plain}) < len(rows) - 24


def test_pairs_of_rows_without_keys(spark):
    """Probe of three similar sets of which one has no key."""
    base = prose(77, 80)
    docs = documents(spark, [(None, " ".join(base), "en"), (5, " ".join([*base[:-1], "x"]), "en"), (7, " ".join([*base[:-1], "y"]), "en")])
    assert sorted(((r["class_a"], r["class_b"]) for r in jaccard.similar_pairs(docs).collect()), key=str) == [(5, 7), (None, 5), (None, 7)]


def test_similar_documents_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    plain = sorted(_plain_components([(r["doc_id"], r["text"]) for r in docs]))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in catalog.QUERIES["op8_ngram_jaccard"](spark, DATA).collect()) == plain


def test_similar_pairs(spark, odd, none):
    """Every link is given, also between sets that others connect already."""
    base = prose(11, 200)
    rows = [(100 + k, " ".join([*base[:3 * k], f"edit{k}", *base[3 * k + 1:]]), "en") for k in range(20)]
    rows += [(300 + k, " ".join(base[6 * k:] + prose(500 + k, 2 * k)), "en") for k in range(1, 15)] + [(400 + k, " ".join(base), "en") for k in range(3)]
    docs = documents(spark, rows).unionByName(odd)
    least = {}
    for r in docs.collect():
        w = blank_words(r["text"])
        s = frozenset(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) if w else None
        if s and r["doc_id"] is not None:
            least[s] = min(least.get(s, r["doc_id"]), r["doc_id"])
    plain = sorted(tuple(sorted((i, j))) for (s, i), (t, j) in combinations(least.items(), 2) if 100 * len(s & t) >= 80 * len(s | t))
    found = sorted((r["class_a"], r["class_b"]) for r in jaccard.similar_pairs(docs).collect())
    assert found == plain and len(found) > 30
    assert jaccard.similar_pairs(none).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 7), (9, 7)], "a long, b long")
    labels = {r["node"]: r["label"] for r in components.least_labels(edges).collect()}
    assert all(labels[i] == 100 for i in range(100, 161)) and [labels[i] for i in (5, 7, 9)] == [5, 5, 5]
    assert components.least_labels(edges.limit(0)).count() == 0


def test_sharding(spark, odd, none):
    for docs in (odd, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
        rows = sharding.shard_records(docs, [1.0] * 16, [1.0] * 17).collect()
        raw = [((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in texts]
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(raw)
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 16)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert len({(r["doc_id"], r["shard"]) for r in rows}) == len({i for i, _ in texts})
    assert len(slots) == 16 and 0.02 < np.mean([r["grown_shard"] == 16 for r in rows]) < 0.11
    heavy = sharding.shard_records(docs, [3.0, 1.0, 0.0], [1.0]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / len(rows) for r in heavy}
    assert set(share) == {0, 1} and 0.68 < share[0] < 0.82
    assert sharding.shard_records(none, [1.0], [1.0, 1.0]).count() == 0


def test_language_model_gradients():
    m = attention_lm.Model(np.array([5, 3, 2, 9, 1, 1, 4]), 3, list("abcdefg"), classes=4)
    m.weights = {k: v.astype(np.float64) for k, v in m.weights.items()}
    r = np.random.default_rng(0)
    seen, target, real = r.integers(0, 6, (3, 7)), r.integers(0, 6, (3, 7)), r.random((3, 7)) < 0.8
    _, g = m.gradients(seen, target, real)
    for k, v in g.items():
        at = np.unravel_index(np.abs(v).argmax(), v.shape)
        old, step = m.weights[k][at], 1e-4
        m.weights[k][at] = old + step
        up = m.gradients(seen, target, real)[0]
        m.weights[k][at] = old - step
        down = m.gradients(seen, target, real)[0]
        m.weights[k][at] = old
        assert math.isclose((up - down) / (2 * step), v[at], rel_tol=1e-3, abs_tol=1e-7), k


def test_language_model_training_is_adam():
    """Windows of a batch lie one after the other; the weights are those of a plain Adam over padded batches."""
    r = np.random.default_rng(3)
    counts = r.integers(1, 50, 60)
    models = [attention_lm.Model(counts, 5, [f"t{i}" for i in range(60)], classes=40) for _ in range(2)]
    batches = [[np.concatenate([[-1 if i % 2 else 7], r.integers(0, 60, n), [-2] if n < 32 and i % 3 else []]).astype(np.int32) for i, n in enumerate(sizes)]
               for sizes in ([32, 0, 5, 31], [1, 2], [0], [30] * 5)]
    flat = [(np.concatenate(b), np.array([len(w) for w in b], np.int32)) for b in batches]
    m, steps = models[0], 0
    first = {k: np.zeros(v.shape) for k, v in m.weights.items()}
    second = {k: np.zeros(v.shape) for k, v in m.weights.items()}
    for batch in batches:
        length = max(map(len, batch)) - 1
        if length < 1:
            continue
        classes, real = np.zeros((len(batch), length + 1), np.int64), np.zeros((len(batch), length), bool)
        for i, ids in enumerate(batch):
            classes[i, : len(ids)] = [0 if x < 0 else m.class_of[x] for x in ids]
            real[i, : len(ids) - 1] = True
        _, g = m.gradients(classes[:, :-1], classes[:, 1:], real)
        steps += 1
        for k, v in g.items():
            first[k], second[k] = 0.9 * first[k] + 0.1 * v, 0.99 * second[k] + 0.01 * v * v
            rate = attention_lm.LEARNING_RATE * math.sqrt(1 - 0.99 ** steps) / (1 - 0.9 ** steps)
            m.weights[k] = (m.weights[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    assert models[1].train(iter(flat)) == sum(len(b) for b in batches if max(map(len, b)) > 1)
    assert np.abs(models[1].vector() - m.vector()).mean() < 1e-4


def test_language_model_targets_in_parts():
    """Every target has a slot of its own in a part of its group, also when a batch has none or all are of one group."""
    r, groups = np.random.default_rng(4), 5
    target = np.concatenate([r.integers(0, groups * attention_lm.GROUP, 70), np.full(3 * attention_lm.PART, 40), [7]])
    step = np.concatenate([np.full(70, 0), np.full(3 * attention_lm.PART, 2), [3]])
    found = list(attention_lm.targets_of(target, np.arange(len(target)), step, 5, groups))
    assert len(found) == 5 and [len(t.rows) for t in found] == [70, 0, 3 * attention_lm.PART, 1, 0] and [len(t.parts) for t in found][1:] == [0, 3, 1, 0]
    assert np.concatenate([t.rows for t in found]).tolist() == list(range(len(target)))
    for t in found:
        assert len(set(t.slots.tolist())) == len(t.slots) and (t.parts[t.slots // attention_lm.PART] == t.group).all()
        assert (t.group * attention_lm.GROUP + t.place == target[t.rows]).all()


@pytest.mark.parametrize("kind", ["one group", "none real", "far logits"])
def test_language_model_gradients_of_odd_batches(kind):
    """One group for all targets, no target at all, and logits whose exponents overflow."""
    counts = np.random.default_rng(5).integers(1, 50, 300)
    m = attention_lm.Model(counts, 5, [f"t{i}" for i in range(300)], classes=200)
    r = np.random.default_rng(6)
    m.weights = {k: v.astype(np.float64) for k, v in m.weights.items()}
    seen, target, real = r.integers(0, 202, (5, 9)), r.integers(0, 202, (5, 9)), r.random((5, 9)) < 0.7
    if kind == "one group":
        target = target % attention_lm.GROUP
    elif kind == "none real":
        real[:] = False
    else:
        m.weights["distance"] = m.weights["distance"] + 800.0
        m.weights["out"][-1] += 800.0
        m.weights["inner"][:, -1] -= 800.0
    loss, g = m.gradients(seen, target, real)
    assert math.isfinite(loss) and (loss > 0) == (kind != "none real")
    for k, v in g.items():
        at = np.unravel_index(np.abs(v).argmax(), v.shape)
        old, step = m.weights[k][at], 1e-4
        m.weights[k][at] = old + step
        up = m.gradients(seen, target, real)[0]
        m.weights[k][at] = old - step
        down = m.gradients(seen, target, real)[0]
        m.weights[k][at] = old
        assert math.isclose((up - down) / (2 * step), v[at], rel_tol=1e-3, abs_tol=1e-7), k


def test_language_model_step_does_not_grow_with_groups(monkeypatch):
    """A training step makes as many products for many groups of classes as for one: groups are multiplied together, not one after the other."""
    made, plain, products = [], np.matmul, []
    monkeypatch.setattr(np, "matmul", lambda *a, **k: made.append(1) or plain(*a, **k))
    for classes in (20, 600):
        m = attention_lm.Model(np.arange(1, 801), 5, [f"t{i:03}" for i in range(800)], classes=classes)
        ids = np.random.default_rng(7).integers(0, 800, 16 * 33).astype(np.int32)
        made.clear()
        m.train(iter([(ids, np.full(16, 33))]))
        products.append(len(made))
    assert products[0] == products[1]


def test_language_model_scores_each_token_once():
    """Blocks give what one query at a time gives, and the probabilities of all continuations sum to one."""
    r = np.random.default_rng(1)
    counts = r.integers(0, 50, 60)
    m = attention_lm.Model(counts, 5, [f"t{i}" for i in range(60)], classes=20)
    lengths = np.array([0, 1, 15, 16, 17, 100, 3])
    ids = r.integers(0, 60, lengths.sum())
    whole = m.score(ids, lengths)
    w, at = m.weights, 0
    for k, n in enumerate(lengths):
        own = ids[at: at + n]
        at += n
        classes = np.concatenate([[0], m.class_of[own]])
        target, total = np.append(m.class_of[own], 0), 0.0
        for i in range(n + 1):
            # Query i sees the tokens of its block's context: from (block start - CONTEXT + STRIDE) on.
            low = max(0, i // attention_lm.STRIDE * attention_lm.STRIDE - attention_lm.CONTEXT + attention_lm.STRIDE)
            x = w["embed"][classes[low: i + 1]]
            s = x @ w["key"] @ (x[-1] @ w["query"]) / math.sqrt(attention_lm.WIDTH) + w["distance"][np.arange(i - low, -1, -1)]
            a = np.exp(s - s.max())
            h = x[-1] + (a / a.sum()) @ (x @ w["value"])
            z = h + np.maximum(h @ w["up"], 0) @ w["down"]
            total += m.output(z[None], np.array([target[i]]))[0][0] + (m.log_inside[own[i]] if i < n else 0.0)
        assert math.isclose(total, whole[k], rel_tol=1e-4, abs_tol=1e-4)
    z = r.standard_normal((1, attention_lm.WIDTH)).astype(np.float32)
    every = [float(m.output(z, np.array([c]))[0][0]) for c in range(2 + int((np.bincount(m.class_of)[2:] > 0).sum()))]
    rare = m.class_of == 1
    assert math.isclose(sum(math.exp(p) for p in every), 1.0, rel_tol=1e-4) and math.isclose(np.exp(m.log_inside[rare]).sum(), 1.0, rel_tol=1e-6)


def _plain_base(docs, training):
    words = lambda t: [*blank_words(t), None]
    c = Counter(w for t in training for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for t in docs]


@pytest.mark.parametrize("head", [4, 1 << 18])
def test_language_model_base(spark, odd, none, head):
    v = bpe.load(spark, bpe.word_vocabulary())
    train = odd.filter("doc_id % 3 <> 0")
    expect = _plain_base([r["text"] for r in odd.collect()], [r["text"] for r in train.collect()])
    rows = attention_lm.score_documents(odd, train, v, head_words=head, rounds=1).collect()
    key = lambda x: (x[0], round(x[3], 6))
    got = sorted(((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows), key=key)
    for a, b in zip(got, sorted(expect, key=key), strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9)
    assert all(r["score"] < 0 for r in rows)
    if head == 4:
        assert attention_lm.score_documents(none, train, v, rounds=1).count() == 0
        blind = attention_lm.score_documents(odd, none, v, rounds=1).collect()
        assert {r["train_tokens"] for r in blind} == {0} and {r["n_known"] for r in blind} == {0} and all(math.isfinite(r["score"]) for r in blind)


def test_language_model_trains_on_every_window(spark, odd):
    v = bpe.load(spark, bpe.word_vocabulary())
    rows = attention_lm.gathered(odd, v).collect()
    counts, seen, ends = Counter(), Counter(), 0
    for r in rows:
        if r["ids"] is None:
            counts[r["id"]] += r["n"]
        else:
            seen.update(i for i in r["ids"][1:] if i >= 0)
            ends += r["ids"][-1] == -2
    assert seen == counts and ends == odd.count()


@pytest.mark.parametrize("sizes", [[0], [0, 0, 1], [31, 32, 33, 0, 64, 65, 5], [1000, 0, 32]])
def test_language_model_windows(spark, sizes):
    """The windows of many texts are what slicing one text after the other gives, in that order."""
    v, n = bpe.load(spark, bpe.word_vocabulary()), attention_lm.CONTEXT
    texts = [" ".join("abcdefgh"[(i * 7 + k) % 8] for i in range(size)) or None for k, size in enumerate(sizes)]
    encoder, expect = bpe.Encoder(pickle.loads(v.value)), []
    for text in texts:
        ids = encoder.encode_all([text or ""])[0].tolist()
        framed = [-1, *ids, -2]
        expect += [framed[a: a + n + 1] for a in range(0, len(ids) + 1, n)]
    rows = attention_lm.gathered(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), v).collect()
    assert [r["ids"] for r in rows if r["ids"] is not None] == expect


def test_language_model_trains_on_a_condition(spark, odd, none):
    """A condition trains on what a table of the rows that meet it trains on, with its windows in that order; rows of which it is null don't train."""
    v = bpe.load(spark, bpe.word_vocabulary())
    condition = F.when(F.length("text") > 3, F.length("text") % 3 != 0)
    plain, shared = (attention_lm.score_documents(odd, t, v, rounds=2).collect() for t in (odd.filter(condition), condition))
    key = lambda r: (str(r["doc_id"]), round(r["base_score"], 6), r["score"])
    assert len(plain) == len(shared) == odd.count() and plain[0]["train_tokens"] > 0
    for a, b in zip(sorted(plain, key=key), sorted(shared, key=key), strict=True):
        assert a[:-2] == b[:-2] and math.isclose(a["base_score"], b["base_score"], rel_tol=1e-9) and math.isclose(a["score"], b["score"], rel_tol=1e-5)
    windows = [r["ids"] for r in attention_lm.gathered(odd, v).collect() if r["ids"] is not None]
    numbers, own = attention_lm.gathered_ids(odd.select(bpe.encoded("text", v).alias("ids")))
    assert [r["ids"] for r in own.collect()] == windows
    counts = Counter()
    for r in numbers.collect():
        counts[r["id"]] += r["n"]
    assert counts == Counter(i for w in windows for i in w[1:] if i >= 0)
    assert attention_lm.score_documents(none, condition, v, rounds=1).count() == 0


@pytest.mark.parametrize("sizes", [[], [0], [0, 0, 5], [3, 4, 9, 1, 0], [20, 1]])
def test_language_model_lists(sizes):
    """Lists are taken up whole and in order, also from the middle of an array."""
    import pyarrow as pa

    column = pa.array([[7]] + [[i] * n for i, n in enumerate(sizes)], pa.list_(pa.int32()))[1:]
    pieces = list(attention_lm.lists(column, most=8))
    assert [n for _, c in pieces for n in c.tolist()] == sizes and all(len(c) == 1 or c.sum() <= 8 for _, c in pieces)
    assert [i for ids, _ in pieces for i in ids.tolist()] == [i for k, n in enumerate(sizes) for i in [k] * n]


def test_language_model_query(spark):
    rows = catalog.QUERIES["op10_lm_scoring"](spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    # The text's own probability under equally likely ids is about log10(49408) a token; the model does far better.
    assert sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held) > -6.0
