"""The registered queries: one ``opN_<name>`` per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm import bwt, decontam, langid, line_dedup, minhash, mixing, outliers, paragraphs, pii, runs, simhash, toxicity, whiten
from issuelens.llm.common import words_column
from issuelens.llm.registry import query
from issuelens.session import table


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query(
    "op4_mix_sources",
    mixing.MIX_SQL.replace("{docs}", "documents")
    + """SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(epochs * size AS BIGINT) AS taken FROM chosen""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.detect(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


@query("op8_benchmark_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("similarity", 9).alias("similarity"),
        "first_word", "n_words", "distance",
    )


@query("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_lines(table(spark, sf_dir, "documents"))
    return cleaned.select(
        F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = outliers.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op3_paragraph_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = paragraphs.remove_paragraphs(table(spark, sf_dir, "documents"), min_words=paragraphs.PASSAGE)
    return cleaned.select(
        F.col("id").alias("doc_id"), "n_paragraphs", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


@query("op9_pii_surrogates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = pii.pseudonymise(table(spark, sf_dir, "documents"))
    return safe.select(
        F.col("id").alias("doc_id"), "n_entities", F.array_join("kinds", ",").alias("kinds"), "text"
    )


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = bwt.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """The texts of the run query's contract: one document in ten repeats its words from a position on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cut = docs.select("doc_id", "text", words_column(F.col("text")).alias("w"), h.alias("h"), F.expr("h div 10").alias("g"))
    sized = cut.withColumn("n", F.size("w").cast("long"))
    placed = sized.withColumn("a", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.col("g") % F.col("n")))
    turned = placed.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(0L, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return turned.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten.whiten(table(spark, sf_dir, "embeddings"))
    each = white.select("*", F.posexplode("whitened").alias("pos", "value"))
    return each.select(
        F.col("id").alias("vec_id"),
        (F.col("pos") + 1).alias("component"),
        "n",
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        F.col("value").alias("whitened"),
        F.get("explained", F.col("pos")).alias("explained"),
        "identity_error",
    )


@query("op12_minhash_near_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")
