"""A training corpus from documents: language ID, near-duplicates, secrets, mixing, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import langid, mixing, packing, secrets, simhash
from corvane.llm.queries import table, tokenizer_path
from corvane.llm.shared import BATCH_ROWS, Scratch, discard, fresh, materialize

#: Tokens after mixing as a share of those before. Above 1, so that what the targets do not cut stays once at least.
BUDGET_SHARE = 1.1


def _settings(spark: SparkSession) -> None:
    """The pipeline's own setting of its session: Python workers, and the JVM's queues for them, hold few whole texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the model rejects go: null texts, texts without a letter, and those far from every centroid.

    All columns keep their values, whatever their names; repeated rows stay or go together; an empty table gives no row. Where no
    document has a label there is no model, nothing is known of any text, and all documents stay.
    """
    _settings(spark)
    model = langid.fit(docs.select("doc_id", "text", "lang").where(~langid.held_out()))
    if model is None:
        return docs
    names = fresh(docs, "lang_pred", "score", "rejected")
    return langid.predict(docs, model, tuple(names)).where(~F.col(names[2])).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the smallest doc_id: texts whose five-word shingles share 0.8 of their union link.

    Null, empty and wordless texts are one class; repeated rows are copies.
    """
    _settings(spark)
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported spans are replaced in the text; every document stays, null and empty texts as they are."""
    _settings(spark)
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says; texts without a word once, repeated rows alike."""
    _settings(spark)
    return mixing.apply_mix(docs, table(spark, sf_dir, "labels"), budget_share=BUDGET_SHARE)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 4096 tokens; a null or empty text is one end mark."""
    _settings(spark)
    return packing.best_fit_pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Several stages are beyond SQL (hashing with seeds, model fits); tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables written on the way, with their texts, are deleted as soon as the next stage is written, and on failure."""
    docs, before = table(spark, sf_dir, "documents"), None
    with Scratch(spark) as all_stages:
        for name, stage in STAGES:
            with Scratch(spark) as own:
                docs = own.keep(materialize(stage(spark, docs, sf_dir), name))
            if before is not None:
                discard(before)
            before = docs
        return all_stages.keep(docs)
