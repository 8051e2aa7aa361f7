"""A corpus from raw documents to token ids, in five stages over the whole table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes what a stage returns
as Parquet in the shared folder and rereads it as the next stage's docs. Every stage takes rows with nulls
in any column, repeated rows, repeated ids and an empty table, and keeps the columns it is given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filterlab.llm import langid, line_dedup, mixing, simhash, spm
from filterlab.llm.common import row_key, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are spelled like the learned languages: null texts, texts without a letter, and texts
    whose words are less familiar than the tagger's limit (gibberish, other scripts, languages of other spelling) go; what
    mixes learned languages stays. If there is nothing to learn from, all documents stay that have a letter."""
    out = langid.held_out(F.col("doc_id"))
    tagger = langid.train(docs, F.col("doc_id").isNotNull() & ~out)
    if not tagger.labels:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    # with names that no column of docs has
    named = langid.predicted(docs, tagger, "text", docs.columns).toDF(*docs.columns, "__lang", "__score", "__noise", "__familiar")
    return named.where((F.col("__lang") != langid.UND) & (F.col("__familiar") >= tagger.limit)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that a copy stands in for; documents of which nothing is left go. Null texts and rows
    without id stay as they are."""
    left = line_dedup.without_copies(docs)
    counted = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left
    return counted.where(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each SimHash group: that of the least id, null ids last; of rows that share it, the one of
    the least hash over all columns. Rows alike in all columns are one."""
    row = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), row_key(docs).alias("hash"))
    keyed = docs.withColumn("__row", row)
    first = simhash.simhash_groups(keyed, id_col="__row").where("doc_id = component_id").select(F.col("doc_id.hash").alias("__hash"), F.col("doc_id.id").alias("__id")).distinct()
    kept = keyed.join(first, (F.col("__row.hash") == F.col("__hash")) & F.col("__row.id").eqNullSafe(F.col("__id")))
    return kept.dropDuplicates(["__row"]).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target weight asks for, in order of finish time."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded, n_tokens of each document; a null text has no ids."""
    coded = spm.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language", language), ("line dedup", lines), ("near-duplicates", near_duplicates), ("mixing", mix), ("tokens", tokens)]

#: Hashes, floating-point fields and byte-pair encoding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
