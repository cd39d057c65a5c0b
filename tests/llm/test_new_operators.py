"""Packing, periodic runs and the prefix trie against plain versions and on odd input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import bpe, catalog, packing, periodic, prefix_trie
from logloom.llm.flat import Hasher
from tools.check import compare

from ..conftest import DATA
from .conftest import documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_runs(words):
    """All runs by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def words_with_runs(seed, n, letters=3):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        kind = r.random()
        if kind < 0.5:
            out += [r.choice("abcdefghij"[:letters]) for _ in range(r.randint(1, 60))]
        else:
            period = [r.choice("abcdefghij"[:letters]) for _ in range(r.choice([1, 2, 5, 9, 31, 32, 33, 40, 63, 64, 65, 100, 130]))]
            if kind > 0.8:
                # A period that holds a row of equal words, so a shorter run inside.
                period += ["z"] * r.choice([3, 24, 40])
            length = r.randint(2 * len(period), 5 * len(period) + 3)
            out += [period[i % len(period)] for i in range(length)]
    return out[:n]


def found_runs(texts):
    numbers = {}
    ids = np.array([numbers.setdefault(w, hash((len(numbers), 7)) & (2**64 - 1)) for t in texts for w in t], np.uint64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    out = [[] for _ in texts]
    for t, s, n, q in zip(*periodic.runs_of_texts(ids, first, Hasher()), strict=True):
        out[t].append((int(s), int(n), int(q)))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_runs_are_those_of_all_periods(seed):
    texts = [words_with_runs(seed * 100 + i, n, letters) for i, (n, letters) in enumerate([(900, 3), (23, 1), (24, 1), (0, 1), (700, 2), (400, 9), (96, 2), (1500, 4)])]
    texts += [["a"] * 500, (["b"] * 70 + ["c"]) * 9, (["a"] * 33 + ["b"]) * 3, ["x", "y"] * 12, ["x", "y"] * 11 + ["x"]]
    assert found_runs(texts) == [plain_runs(t) for t in texts]


def test_runs_of_fibonacci_words():
    a, b = ["a"], ["a", "b"]
    while len(b) < 2000:
        a, b = b, b + a
    triple = b[:233] * 3 + b[:610]
    assert found_runs([b, triple]) == [plain_runs(b), plain_runs(triple)]


def plain_op12(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    return (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n_},{q}\n" for s, n_, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_op12_matches_a_plain_version(spark, tmp_path):
    rows = [(i, " ".join(prose(i, n)), "en") for i, n in enumerate([0, 1, 5, 30, 60, 90, 150, 300] * 30)]
    rows += [(1000, " ".join("ab cd ef".split() * 20), "en"), (1000, " ".join("ab cd ef".split() * 20), "en"), (None, "x " * 50, "en"), (1001, None, "en"), (1002, "", "en"),
             (1003, " \n\t", "en"), (1004, "  é😀\n" * 30 + "end \x0b", "en"), (1005, " ".join(words_with_runs(5, 3000)), "en"), (1006, "y" * 300000, "en")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted((repr(r["doc_id"]), tuple(r[c] for c in columns)) for r in catalog.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect())
    assert got == sorted((repr(i), plain_op12(i, t)) for i, t, _ in rows)
    assert sum(t[0] > 0 for _, t in got) > 8


def test_runs_of_nothing(spark, none):
    assert periodic.find_runs(none).collect() == []


def plain_trie(rows):
    """Nodes from all prefixes of all conversations as the contract rebuilds them."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}:{text}".encode()).digest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in convs.items()}
    full = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + t[h:])
    nodes = {}
    for c, t in full.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    out = []
    for k, members in nodes.items():
        below = [x for x in nodes if x[:len(k)] == k]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        leaves = sum(not any(len(y) == len(x) + 1 and y[:-1] == x for y in below) for x in below)
        children = sum(len(x) == len(k) + 1 for x in below)
        ends = ",".join(str(c) for c in sorted(members) if len(full[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children, leaves, saved, sha(ends)))
    return sorted(out, key=repr)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(r.choice([1, 1, 2, 3, 5, 12])):
            rows.append((c * r.choice([1, 1, 1, 7]), turn, r.choice(["user", "bot"]) if r.random() < 0.1 else "user", r.choice(["hi", "hi", "hi", "you", "é"])))
    return rows


@pytest.mark.parametrize("seed, n, partitions", [(1, 60, 1), (2, 60, 7), (3, 90, 40), (4, 2, 3)])
def test_trie_matches_all_prefixes(spark, tmp_path, seed, n, partitions):
    rows = trie_rows(seed, n) + ([(500 + i, j, "user", "same") for i in range(40) for j in range(9)] if seed == 3 else [])
    rows += [(None, 1, "user", "x"), (5, None, "user", "first"), (5, None, None, None), (6, 1, "a", "bc"), (6, 1, "ab", "c"), (6, 1, "ab", "c")]
    table = spark.createDataFrame([(*x, "k", 1) for x in rows], "conv_id long, turn long, role string, text string, key string, part int")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = [tuple(r[c] for c in TRIE) for r in catalog.QUERIES["op13_prefix_trie"](spark, str(tmp_path)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got, key=repr) == plain_trie(rows)


def test_trie_of_nothing_and_long_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(prefix_trie.keyed(prefix_trie.sequences(spark.createDataFrame([], schema)))).collect() == []
    rows = [(c, i, "user", "t") for c in (1, 2) for i in range(3000)] + [(2, 3000, "user", "t"), (3, 0, "user", "long " * 100_000)]
    nodes = {(r["conv_id"], r["depth"]): r for r in prefix_trie.prefix_trie(prefix_trie.keyed(prefix_trie.sequences(spark.createDataFrame(rows, schema)))).collect()}
    assert len(nodes) == 3003 and nodes[1, 3000]["n_children"] == 1 and nodes[1, 1]["saved_tokens"] == 3000 and nodes[1, 0]["n_leaves"] == 2


def test_trie_sql(spark):
    status, _, note = compare(spark, "op13_prefix_trie", catalog.QUERIES["op13_prefix_trie"], catalog.SQL["op13_prefix_trie"], DATA)
    assert status == "ok", note


@pytest.mark.parametrize("seed", range(6))
def test_deficits_are_carried(seed):
    r = random.Random(seed)
    stock = [r.choice([0, 1, 7, 1000, 50_000]) for _ in range(r.randint(1, 7))]
    sizes = [64] * (sum(stock) // 64) + [sum(stock) % 64]
    dealt = packing.deal(stock, stock, sizes)
    assert [sum(x) for x in dealt] == sizes and [sum(x) for x in zip(*dealt, strict=True)] == stock
    total, so_far = sum(stock), [0] * len(stock)
    for k, row in enumerate(dealt[:-1], 1):
        so_far = [a + n for a, n in zip(so_far, row, strict=True)]
        assert all(abs(a * total - 64 * k * n) < 2 * total for a, n in zip(so_far, stock, strict=True))


def test_targets_hold_until_a_queue_is_dry():
    dealt = packing.deal([3000, 3000, 500], [3, 1, 0], [64] * 101 + [36])
    assert all(x == [48, 16, 0] for x in dealt[:62])
    assert all(x[0] + x[1] == 64 for x in dealt[:93]) and sum(x[2] for x in dealt) == 500
    assert dealt[70] == [0, 64, 0]


@pytest.mark.parametrize("totals, weights", [([5], [5]), ([300, 20, 7], [300, 20, 7]), ([70_000, 9000, 123, 1], [70_000, 9000, 123, 1]), ([60_000, 60_000], [9, 1]), ([64], [64])])
def test_schedule_places_every_id_once(totals, weights):
    window = 16
    plan, far = packing.Schedule(totals, weights, window), packing.Schedule(totals, weights, window)
    taken, lengths, held = {}, {}, {}
    for q, n in enumerate(totals):
        for p in range(n):
            w, at, room, length = plan.place(q, p)
            assert (w, at) not in taken and room > 0
            taken[w, at], lengths[w] = q, length
            held.setdefault(w, [0] * len(totals))[q] += 1
    for q, n in enumerate(totals):
        for p in random.Random(1).sample(range(n), min(n, 50)):
            assert taken[far.place(q, p)[:2]] == q
    assert len(taken) == sum(totals) and sorted(lengths) == list(range(len(lengths)))
    for w, length in lengths.items():
        assert all((w, i) in taken for i in range(length)) and (length == window or length & (length - 1) == 0)
    if totals == weights:
        for w in range(sum(totals) // window):
            assert all(abs(n - window * t / sum(totals)) < 3 for n, t in zip(held[w], totals, strict=True))


def plain_pack_check(rows, pieces, tokenizer, window=4096):
    """Every id of every document in one piece, windows gapless, ids as the library gives them."""
    from collections import Counter
    whole = Counter()
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        whole[i, tuple(ids)] += 1
    by_window, by_doc = {}, {}
    for p in pieces:
        by_window.setdefault(p["sequence_id"], []).append(p)
        by_doc.setdefault(p["doc_id"], []).append(p)
    assert sorted(by_window) == list(range(len(by_window)))
    for members in by_window.values():
        at = 0
        for p in sorted(members, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == members[0]["sequence_length"] and (at == window or at & (at - 1) == 0 and at < window)
    found = Counter()
    for (i, ids), n in whole.items():
        cuts = Counter((p["start"], p["length"], p["ids_crc32"]) for p in by_doc.pop(i) if p["doc_tokens"] == len(ids)) if i in by_doc else Counter()
        if n == 1:
            end = 0
            for start, length, crc in sorted(cuts):
                assert start == end and crc == zlib.crc32(np.array(ids[start: start + length], "<u4").tobytes())
                end += length
            assert end == len(ids)
        found[i, ids] += n
    assert found == whole and not by_doc
    return by_window


def test_op11_matches_the_library(spark, tmp_path, odd):
    from tokenizers import Tokenizer
    rows = [(i, " ".join(prose(i, 10 + 7 * i)), "en", f"src{i % 4 if i % 2 else 0}") for i in range(80)] + [(200 + i, t, "en", s) for i, (t, s) in enumerate([(None, None), ("", "a"), ("x é 😀 12", "b")])]
    spark.createDataFrame([(i, t, x, s, 0, 1, 2) for i, t, x, s in rows], "doc_id long, text string, lang string, source string, part int, ids int, queue int").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(bpe.word_vocabulary())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    windows = plain_pack_check(rows, catalog.QUERIES["op11_packing"](spark, str(tmp_path)).collect(), tokenizer)
    assert len(windows) > 3
    small = packing.pack(spark.read.parquet(f"{tmp_path}/documents.parquet"), bpe.load(spark, bpe.word_vocabulary()), window=128, targets={"src0": 1, "src1": 3})
    plain_pack_check(rows, small.collect(), tokenizer, 128)


def test_packing_of_odd_rows(spark, odd, none):
    vocabulary = bpe.load(spark, bpe.word_vocabulary())
    assert packing.pack(none, vocabulary).collect() == []
    pieces = packing.pack(odd, vocabulary, window=64).collect()
    assert sum(p["length"] for p in pieces if p["doc_id"] == 6) == 2 * next(p["doc_tokens"] for p in pieces if p["doc_id"] == 6)
    assert sum(p["length"] for p in pieces if p["doc_id"] is None) == next(p["doc_tokens"] for p in pieces if p["doc_id"] is None)
    assert {p["doc_id"]: p["doc_tokens"] for p in pieces}[1] == 1


def test_more_sources_than_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 3)
    rows = [(i, "some words here", "en", f"s{i % 7}") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    pieces = packing.pack(docs, bpe.load(spark, bpe.word_vocabulary()), window=16).collect()
    assert sum(p["length"] for p in pieces) == sum({p["doc_id"]: p["doc_tokens"] for p in pieces}.values())
    assert len({(p["sequence_id"], p["offset"]) for p in pieces}) == len(pieces)
