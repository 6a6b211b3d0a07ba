"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, source mixing.

Each stage takes (spark, docs, sf_dir), reads the whole of ``docs`` and returns a DataFrame; all but the last return the
columns of ``documents``.  ``run`` writes every stage to the shared folder and reads it back as the next one's docs.

A document with a null id goes by a key made from its text, so null ids neither meet nor get lost.  Columns beyond those of
``documents`` pass through every stage but the last untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm import decontam, langid, line_dedup, mixing, simhash
from issuelens.llm.common import stage
from issuelens.session import prepare, table

#: Below this share of word probability no language is clear, and the document is rejected like one without a letter.
MIN_LANGUAGE_SCORE = 0.3

#: No stage's rows can be had from SQL alone (the first one is a trained model).
ORACLE_SQL = None


class Named:
    """``docs`` under names of our own, so that no column of its own can clash with one of ours, and the way back.

    ``key`` is the id, or for a null id a negative number from the text.
    """

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.names = [f"own_{i}" for i in range(len(docs.columns))]
        plain = docs.toDF(*self.names)
        hashed = F.xxhash64(F.coalesce(F.col(self["text"]).cast("string"), F.lit("")))
        self.rows = plain.withColumn("key", F.coalesce(F.col(self["doc_id"]).cast("long"), F.shiftrightunsigned(hashed, 2).cast("long") * -1 - 1))

    def __getitem__(self, column: str) -> str:
        return self.names[self.columns.index(column)]

    def back(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.names).toDF(*self.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; a null language becomes the predicted one."""
    own = Named(docs)
    found = langid.detect(own.rows, own["doc_id"], own["text"], own["lang"], keep=own.names)
    kept = found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return own.back(kept.withColumn(own["lang"], F.coalesce(own["lang"], "lang_pred")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines; a document goes when no word is left."""
    own = Named(docs)
    cleaned = line_dedup.drop_lines(own.rows, "key", own["text"], keep=[c for c in own.names if c != own["text"]])
    left = cleaned.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    left = left.withColumn(own["text"], F.col("text"))
    if "n_chars" in docs.columns:
        left = left.withColumn(own["n_chars"], F.length("text").cast(docs.schema["n_chars"].dataType))
    return own.back(left)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Rows that share an id are one document: all its different rows stay, repeated ones once.
    """
    own = Named(docs)
    found = simhash.near_duplicates(own.rows, "key", own["text"], shingle=3, radius=3)
    rows = found.where(F.col("id") == F.col("component")).groupBy(F.col("id").alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    kept = own.rows.join(stage(rows, "pipeline-first"), "key")
    once, several = kept.where("n_rows = 1"), kept.where("n_rows > 1").dropDuplicates(own.names)
    return own.back(once.unionByName(several))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    own = Named(docs)
    found = decontam.contaminated(own.rows, table(spark, sf_dir, "benchmark"), id_col="key", text_col=own["text"])
    leaky = found.select(F.col("id").alias("key")).distinct()
    return own.back(own.rows.join(leaky, "key", "left_anti"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: how often each document is taken, and its words times that."""
    found = mixing.mix(docs.select("doc_id", "text", "source"))
    return found.select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "epochs", F.col("taken").cast("long").alias("taken")
    )


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("mix_sources", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
