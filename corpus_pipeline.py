"""From raw documents to token ids, in five stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``docs``.

1. ``language_id`` drops documents whose language is not clear (no letter, or two languages nearly as likely).
2. ``ngram_jaccard`` keeps one document of each group of similar ones: the one of the least id (null first).
3. ``decontamination`` drops documents that hold a window of a benchmark item, as the operator's ``contaminated`` says; a shorter item is one window.
4. ``secrets`` writes a mark in place of every secret; no document goes.
5. ``bpe`` turns texts into ids.

Defined results: columns that the stages don't know are passed through, whatever their names; the stages read ``doc_id``, ``text`` and
``lang``. Null texts go in stage 1. Rows of the same id and text are one document in stage 2. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm import bpe, decontaminate, jaccard, langid, secret_scan
from logloom.llm.registry import bound_batches, table
from logloom.llm.shared import shared_folder

ORACLE_SQL = None


def _bounded(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(bound_batches(spark), docs, sf_dir)

    return run_stage


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = unused(docs, "_language")
    learned = langid.learn(docs)
    return docs.withColumn(found, langid.language(F.col("text"), learned)).filter(~F.col(f"{found}.rejected")).select(*docs.columns)


def _row_key(docs: DataFrame) -> Column:
    return F.sha2(F.concat_ws(":", F.when(F.col("doc_id").isNull(), "n").otherwise("d"), F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))), 256)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row, at = unused(docs, "_row"), unused(docs, "_at")
    keyed = docs.select(F.struct("doc_id", _row_key(docs).alias("row")).alias("key"), "text")
    kept = jaccard.similar_documents(keyed, "key").filter(F.col("key") == F.col("component_id")).select(F.col("key.row").alias(row)).distinct()
    # Rows that are equal in id and text are told apart only by their number.
    number = F.row_number().over(Window.partitionBy(row).orderBy(row))
    return docs.withColumn(row, _row_key(docs)).join(kept, row, "left_semi").withColumn(at, number).filter(F.col(at) == 1).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    content = unused(docs, "_content")
    _, found, _ = decontaminate.occurrences(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    held = found.select(F.col("content").alias(content)).distinct()
    return docs.withColumn(content, F.sha2(F.coalesce("text", F.lit("")), 256)).join(held, content, "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    blob, found = unused(docs, "_blob"), unused(docs, "_findings")
    ledger = secret_scan.update_ledger(docs.select("text"), shared_folder(spark, "secret-ledger"), first=True)
    findings = secret_scan.findings_by_blob(ledger).select(F.col("blob").alias(blob), F.col("findings").alias(found))
    rows = docs.withColumn(blob, secret_scan.blob_of(F.col("text"))).join(findings, blob, "left")
    rows = rows.withColumn("text", secret_scan.masked(F.col("text"), F.col(found)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = bpe.load(spark, bpe.word_vocabulary())
    rows = docs.select("doc_id", "lang", "source", bpe.there_and_back(F.col("text"), vocabulary).alias("b")).select("doc_id", "lang", "source", "b.*")
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [(name, _bounded(stage)) for name, stage in (
    ("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("secrets", secrets), ("bpe", encode))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    folder, docs = shared_folder(spark, "corpus-pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
