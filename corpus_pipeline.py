"""A corpus from raw documents to packed sequences: each stage is written and read again by the next.

STAGES are (name, function of (spark, docs, sf_dir)). All but the last return the columns of `documents`.
The last stage's sequences hold tokens, which SQL can't make, so ORACLE_SQL is None and tests compare each
stage with a plain version.

Every stage takes rows as they are: ids may be null or repeated, and each row stands for itself. An empty table gives an
empty one. Columns besides those of `documents` are left out by the first stage, whatever their names; texts of any
length are taken whole. What a stage does with null texts, ties and repeated rows is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacelake.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from pacelake.llm import text as tx


def _as_documents(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from every document, and documents that the rules reject go. Null and empty texts have too few words and go;
    equal rows are judged alike, so all of them stay or go."""
    return _as_documents(quality_rules.clean_lines(docs, carry=("lang", "source"), with_text=True, phrase_words=30).where("kept"), "clean_text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of a source go from its documents; a document that was nothing else stays, empty. A null source is a
    source of its own; a null text stays null; repeated rows count as documents of their source each. A line exactly at the ratio stays."""
    return _as_documents(line_dedup.dedup_lines(docs, "source", "text", ratio=0.05).withColumn("clean_text", F.col("line_dedup.text")), "clean_text")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that with the smallest id (null ids last), of equal ids the first in the order of
    the files. Rows are told by their place, so of repeated rows one stays, and rows of one id with different texts are apart. Null
    texts and texts without words are near nothing and stay.

    A row's number comes from its place in the files that it is read from, which is the same in every pass.
    """
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    groups = near_dedup.near_duplicates(numbered, "_row").select(F.col("doc_id").alias("_at"), F.col("component_id").alias("_group"))
    ranked = numbered.select("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row").alias("_rank")).join(groups, F.col("_row") == F.col("_at"))
    kept = ranked.groupBy("_group").agg(F.min("_rank").alias("_first")).select(F.col("_first._row").alias("_kept"))
    return numbered.join(kept, F.col("_row") == F.col("_kept"), "left_semi").drop("_row")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the mix takes, as rows of their own; those that it takes no copy of go, as do texts without words. A
    null source is the last of the sources."""
    sized = docs.withColumn("_size", mixing.size_of("text"))
    copies = mixing.mix(sized, size="_size")
    taken = copies.where("mix.copies > 0").select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("mix.copies").cast("int"))).alias("_copy"))
    return taken.drop("_copy")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences. A null text is an empty one: its end token alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet into the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = tx.shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
