"""A training corpus from raw documents: quality rules, near duplicates, repeated passages, the mix, packed sequences.

Each stage takes documents with columns doc_id, source, text and n_chars and any others, which it hands on. Empty tables
give empty results; what a stage does with null and empty texts, null keys, ties and repeated rows stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agendum.llm import common, mixing, ngramjoin, packing, quality, substring
from agendum.llm.tokens import vocabulary


#: The columns that operators read; all others travel in one struct, so that no operator's column can clash with theirs.
READ = ("doc_id", "source", "text")


def held(docs: DataFrame) -> DataFrame:
    return docs.select(*READ, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in READ]).alias("others"))


def opened(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, in their order."""
    return df.select(*[F.col(c) if c in READ else F.col("others")[c].alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep. Null and empty texts fail the base rules; null ids and repeated
    rows are judged by their texts like any other; documents on a threshold count as above it."""
    return opened(quality.judge(held(docs), common.table(spark, sf_dir, "labels")).filter("kept"), docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, null ids last. Of repeated rows one stays;
    ties are settled as in ngramjoin.keep_one. Documents without any term (null and empty texts too) all stay."""
    return ngramjoin.keep_one(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words and more that stand in two places; n_chars is that of what is left. A null text
    becomes empty; repeated rows lose all their windows of 35 words; a document that loses all its words stays, empty."""
    cut = opened(substring.remove_repeats(held(docs)), docs)
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, those of small sources up to twice, as the target entropy asks. Null sources are one source;
    documents without words cost nothing; repeated rows stand in one place of the permutation and are taken together."""
    return opened(mixing.mix(held(docs)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens. A null or empty text makes a piece of one token;
    null ids and documents taken twice make pieces of their own."""
    packed = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1)
    pieces = packed.pieces.select("piece_uid", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pieces.join(packed.placement, "piece_uid").drop("piece_uid")


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("substring dedup", remove_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: The learned list, the hashed permutations and the tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again; what they stored on the way is deleted."""
    docs = common.table(spark, sf_dir, "documents")
    with common.scope():
        for name, stage in STAGES:
            with common.scope():
                docs = common.keep(common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        common.keep(docs)
    return docs
