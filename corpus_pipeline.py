"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all its
predecessor kept. ``run`` writes each stage's result as Parquet in the shared
folder and rereads it as the next one's documents, so a lost executor costs no
more than the stage at hand. All but the last return the columns of documents.

Defined results: a null text is empty; empty texts and those without letters go in
the first stage, and so do all where no row names its language. Of equal texts the largest doc_id stays, and of its repeated rows
one. Rows without a doc_id go through all stages: of equal texts a row with an id
goes before one without, each is a class of its own among near duplicates, they are
compared with the benchmark like others, and are packed with a null doc_id. Ties
go by doc_id. A very long text is cut by the last stage alone. Further columns are
carried along by all stages but the last, whatever their names. An empty table, or
one of which a stage keeps nothing, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesselith.llm import decontaminate, exact_dedup, language_id, near_dedup, packing
from tesselith.staging import scratch, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, whose language is unknown, go."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays."""
    return near_dedup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: Signatures, mixture inference and tokens are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table. What a stage staged on its way goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        path = f"{shared_folder(spark)}/{name}"
        with scratch(spark):
            result = function(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
