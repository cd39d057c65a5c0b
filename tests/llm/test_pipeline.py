"""The pipeline's stages, each against a plain version."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from logloom.llm import bpe, decontaminate

from ..conftest import DATA
from .conftest import documents
from .test_corpus_operators import _plain_components, _plain_hits, _plain_spans

STAGE = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "secrets", "bpe"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clear = STAGE["language_id"](spark, docs, DATA)
    assert clear.columns == docs.columns and 0.95 * docs.count() <= clear.count() <= docs.count()
    one = STAGE["ngram_jaccard"](spark, clear, DATA)
    assert sorted(r[0] for r in rows_of(one)) == sorted({c for _, _, c in _plain_components(rows_of(clear))})
    clean = STAGE["decontamination"](spark, one, DATA)
    hits = _plain_hits(rows_of(one), items)
    assert sorted(r[0] for r in rows_of(clean)) == sorted(i for i, _ in rows_of(one) if not hits[i][1])
    safe = STAGE["secrets"](spark, clean, DATA)
    before, after = dict(rows_of(clean)), dict(rows_of(safe))
    assert set(before) == set(after) and safe.columns == docs.columns
    for i, t in before.items():
        assert not _plain_spans(after[i]) and (after[i] == t) == (not _plain_spans(t))
    library = Tokenizer.from_file(bpe.word_vocabulary())
    library.no_truncation()
    last = {r["doc_id"]: r["ids"] for r in STAGE["bpe"](spark, safe, DATA).collect()}
    assert last == {i: library.encode(t, add_special_tokens=False).ids for i, t in after.items()}


def test_short_benchmark_items(spark, tmp_path):
    """Documents that the operator marks go, also those that hold an item of few words."""
    items = spark.createDataFrame([(1, "answer"), (2, "three short words"), (3, " ".join(f"w{i}" for i in range(15)))], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, [(1, "the answer is here", "en"), (2, "of three short words only", "en"), (3, "short words three", "en"), (4, " ".join(f"w{i}" for i in range(12)), "en"), (5, None, "en")])
    assert sorted(r[0] for r in rows_of(STAGE["decontamination"](spark, docs, str(tmp_path)))) == [3, 5]
    marked = decontaminate.decontaminate(docs, items)
    assert sorted(r["doc_id"] for r in marked.filter("contaminated").collect()) == [1, 2, 4]


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"] and rows.count() > 0


def test_odd_input(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0, name
        out = stage(spark, odd, DATA)
        if name != "bpe":
            assert out.columns == odd.columns
    kept = Counter(r[0] for r in rows_of(STAGE["ngram_jaccard"](spark, odd, DATA)))
    # Copies and near copies go to the least id, null first; rows of the same id and text are one.
    assert kept == Counter([None, 1, 2, 3, 7, 9, 10, 11, 12, 13, 14, 15])
    assert re.search("SECRET", dict(rows_of(STAGE["secrets"](spark, odd, DATA)))[14])
    assert 1 not in dict(rows_of(STAGE["language_id"](spark, odd, DATA)))


@pytest.mark.parametrize("column", ["_row", "_blob", "_content", "_language", "_at", "_findings"])
def test_clashing_columns(spark, column):
    docs = documents(spark, [(1, "some words of a text", "en"), (2, None, "en")], clash=False).selectExpr("*", f"doc_id as {column}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and all(r[column] == r["doc_id"] for r in out.collect()), name
