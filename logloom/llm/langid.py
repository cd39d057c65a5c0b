"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from labelled texts. A text belongs to the language whose
dictionary makes it smallest; it is rejected when the runner-up is nearly as small. What is compressed are the distinct words of the
whole text (letters only, lower case, in the order they come), in chunks, so that the dictionary matters to the end of a long text
and repetition does not hide it.

Learning reads a bounded sample: at most ``SAMPLE_TEXTS`` texts a language, of ``SAMPLE_BYTES`` bytes each, cut to a dictionary
of ``DICTIONARY_BYTES``. Texts that fit whole are preferred. The sample goes by a hash of the text, in which copies are one, and grows
no further with the data. More than ``MOST_LANGUAGES`` labels are an error. Prediction is local to a row: no shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing was labelled. Equal
sizes go to the language with more labelled texts, then the first by name, with score 0. The score is 1 - least size / second size; with one language it is 1.
Labels, ids and other columns are never read in predicting; repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship_by_value
from .flat import tidy
from .registry import query, table

SAMPLE_TEXTS = 128
SAMPLE_BYTES = 8_192
DICTIONARY_BYTES = 131_072
MOST_LANGUAGES = 1_000
CHUNK = 8_192
# Short matches are found: syllables tell languages apart.
SEARCH = {"window_log": 18, "chain_log": 17, "hash_log": 17, "search_log": 4, "min_match": 3, "target_length": 0, "strategy": zstandard.STRATEGY_LAZY}
# Texts whose best two languages differ by less than this share of their size are rejected.
LEAST_MARGIN = 0.01
UNKNOWN = "und"


class Learned(NamedTuple):
    texts: int
    dictionary: bytes


def words(text: str) -> bytes:
    """The distinct words of a text."""
    return " ".join(dict.fromkeys(re.sub(r"[\W\d_]+", " ", text.lower()).split())).encode()


def learn(docs: DataFrame, text_column: str = "text", label_column: str = "lang") -> dict[str, Learned]:
    """For each label of ``docs`` the number of its texts and a dictionary."""
    text, label = F.col(text_column), F.col(label_column)
    rows = docs.filter(label.isNotNull() & text.isNotNull()).select(label.alias("label"), text.alias("text"))
    # Copies of a text are one: they must neither lower the share of the others nor fill the sample.
    distinct = rows.groupBy("label", F.xxhash64("text").alias("draw")).agg(F.count("*").alias("n"))
    held = distinct.groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).limit(MOST_LANGUAGES + 1).collect()
    if len(held) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    if not held:
        return {}
    counts = {r["label"]: r["n"] for r in held}
    # About four times the texts needed pass; ranking then sees few rows.
    share = F.create_map(*(F.lit(x) for r in held for x in (r["label"], min(1.0, 4.0 * SAMPLE_TEXTS / r["distinct"]))))
    drawn = rows.withColumn("draw", F.xxhash64("text")).filter(F.pmod("draw", F.lit(1 << 30)) / F.lit(float(1 << 30)) < share[F.col("label")])
    cut = F.struct((F.octet_length("text") > SAMPLE_BYTES).alias("long"), F.substring(F.encode("text", "UTF-8"), 1, SAMPLE_BYTES).alias("bytes"))
    once = drawn.groupBy("label", "draw").agg(F.min(cut).alias("cut")).select("label", "draw", "cut.*")
    order = Window.partitionBy("label").orderBy("long", "draw")
    cut = once.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= SAMPLE_TEXTS).select("label", "at", "bytes")
    found: dict[str, list[bytes]] = {}
    for r in sorted(cut.collect(), key=lambda r: (r["label"], r["at"])):
        found.setdefault(r["label"], []).append(words(bytes(r["bytes"]).decode("utf-8", "ignore")))
    return {k: Learned(counts[k], b" ".join(v)[:DICTIONARY_BYTES]) for k, v in found.items() if any(v)}


def language(text: str | Column, learned: dict[str, Learned], least_margin: float = LEAST_MARGIN) -> Column:
    """Struct of ``lang``, ``score`` and ``rejected`` of a whole text."""

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, makers = sorted(learned, key=lambda k: (-learned[k].texts, k)), []
        search = zstandard.ZstdCompressionParameters(write_content_size=False, write_dict_id=False, **SEARCH)
        for name in names:
            d = zstandard.ZstdCompressionDict(learned[name].dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=search)
            makers.append(zstandard.ZstdCompressor(dict_data=d, compression_params=search))

        def one(t: str | None) -> tuple[str, float, bool]:
            if not names or t is None or not any(map(str.isalpha, t)):
                return UNKNOWN, 0.0, True
            raw = memoryview(words(t))
            parts = [raw[i: i + CHUNK] for i in range(0, len(raw), CHUNK)]
            sizes = sorted((sum(len(m.compress(p)) for p in parts), i) for i, m in enumerate(makers))
            score = 1.0 if len(sizes) == 1 else 1.0 - sizes[0][0] / sizes[1][0]
            return names[sizes[0][1]], score, score < least_margin

        for batch in batches:
            rows = [one(x.as_py()) for x in batch]
            lang, score, rejected = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["lang", "score", "rejected"])
        tidy()

    predict.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(predict, "lang string, score double, rejected boolean")(text)


def remainder(key: str, parts: int) -> Column:
    """crc32 of a key as text, modulo ``parts``; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(parts))


def identify(docs: DataFrame, training: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> DataFrame:
    """One row per document: key, ``lang_pred``, ``score`` and ``rejected``, learned from ``training``."""
    found = language(F.col(text_column), learn(training, text_column, label_column))
    return docs.select(F.col(id_column), found.alias("l")).select(
        id_column, F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"), F.col("l.rejected").alias("rejected"))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, directory: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, directory, "documents")
    held_out = remainder("doc_id", 4) == 2
    return identify(docs, docs.filter(~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


ship_by_value(__name__)
