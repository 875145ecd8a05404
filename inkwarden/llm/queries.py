"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, langid, mixing, packing, secrets, simhash, suffixes, toxicity, vectors
from .common import documents, n_words, remainder, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, digest and spans."""
    return secrets.find_secrets(documents(spark, sf_dir))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what is read back from the string and its mask."""
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = chat.chains(rows)
    roots = messages.where(F.col("parent").isNull()).select(F.col("id").alias("root"), "conv_id")
    out = chat.format_paths(messages).join(roots, "root")
    read = out.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.taught(F.col("formatted"), F.col("mask")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix takes."""
    mixed = mixing.mix(documents(spark, sf_dir), n_words(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of the labels that aren't held out."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0)
    found = toxicity.score(docs, toxicity.learn(docs, labels))
    return found.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.shown(F.col("fp")).alias("fingerprint"), "component_id")


def op6_minhash_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they are."""
    return fingerprints.fingerprint(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of every document by samples of those that aren't held out."""
    docs = documents(spark, sf_dir)
    parser = langid.learn(docs.where(remainder(F.col("doc_id"), 3) != 1))
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return langid.identify(docs.select("doc_id", held_out, "text"), parser).drop("text")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector."""
    return vectors.vector_links(table(spark, sf_dir, "embeddings"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document repeats an earlier one."""
    return suffixes.repeats(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of every document goes."""
    return packing.pack(documents(spark, sf_dir), n_words(F.col("text")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_chat_format,
        op3_source_mixing,
        op4_toxicity,
        op5_simhash_near_dedup,
        op6_minhash_fingerprint,
        op7_language_id,
        op8_embedding_near_dedup,
        op9_suffix_array_dedup,
        op10_best_fit_packing,
    )
}
