"""The corpus pipeline: each stage calls one operator of panelspark.llm on all that the stage before it kept.

Every stage but the last returns the columns of ``documents``, whatever they are; ``n_chars``, where present, follows the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm.common import read_table, ship_package
from panelspark.llm.mixing import draw_mix
from panelspark.llm.near_dup import drop_near_duplicates
from panelspark.llm.packing import pack_documents, word_tokenizer
from panelspark.llm.substring_dedup import remove_repeated_strings
from panelspark.llm.toxicity import toxicity
from panelspark.session import checkpoint_dir


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, of the text as it is now."""
    for c in docs.columns:
        if c.lower() == "n_chars":
            docs = docs.withColumn(c, F.length("text").cast(docs.schema[c].dataType))
    return docs


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity network scores 0.5 or more; null and empty texts stay."""
    ship_package(spark)
    name = "toxicity"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    return toxicity(docs, read_table(spark, sf_dir, "labels"), name=name).filter((F.col(name) < 0.5) | F.coalesce(F.length("text") == 0, F.lit(True))).drop(name)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest doc_id."""
    ship_package(spark)
    return drop_near_duplicates(docs, shingle_size=5, percent=80)


def repeated_strings_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes from each text the bytes of 50-byte strings that a smaller doc_id has too; of a character cut in two nothing stays."""
    ship_package(spark)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"])
    out = remove_repeated_strings(docs.select("doc_id", "text", rest.alias("row")), as_text=True)
    return _recount(out.select(*[F.col("kept").alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns]))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a document appears as often as it is drawn, the last draw of a source perhaps in part."""
    ship_package(spark)
    return _recount(draw_mix(docs, name=None))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents of the mix in sequences of at most 4096 tokens."""
    ship_package(spark)
    return pack_documents(docs, word_tokenizer())


STAGES = [("toxicity", toxic_out), ("near_duplicates", near_duplicates_out), ("repeated_strings", repeated_strings_out),
          ("mixing", mixed), ("packing", packed)]

# Hashing, training and tokenizing have no SQL form; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/llm/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return docs
