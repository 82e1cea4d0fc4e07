"""A training corpus from ``documents``: five stages, each written before the next one reads it.

toxicity          documents that the classifier rejects go; it learns from ``labels`` of the same folder
near_duplicates   one document of each group of near copies stays (five-word shingles, similarity 0.8)
decontamination   documents that hold a passage of ``benchmark`` go
mixing            sources come to their target weights: documents are repeated, left out or cut short
tokens            ids of all remaining documents as binary files; the result describes them

All but the last return the columns of ``documents``.  NULLs in any column are allowed: a NULL text is an
empty document (mixing leaves it out, having no words).  Copies are found by row: one row of a group stays, whatever
the ids, repeated ones and NULLs included.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm import decontamination, mixing, near_duplicates, token_files, toxicity
from treeledger.llm.common import fold, free_name, table, written
from treeledger.llm.queries import vocabulary
from treeledger.sources.scratch import delete_folder, fresh_folder, materialise

# SQL has neither compression with dictionaries nor the vocabulary's tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold("doc_id", 5) != 0))
    score = free_name(docs, "score")
    return docs.withColumn(score, toxicity.score_column(model)).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Every row is a node of its own, so that repeated ids and rows without one are grouped like any others.
    row = free_name(docs, "row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()))
    found = near_duplicates.near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"))
    dropped = found.where("not kept").select(F.col("doc_id").alias(row))
    return numbered.join(dropped, row, "left_anti").select(*[f"`{name}`" for name in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = free_name(docs, "found")
    scanned = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), name=found)
    return scanned.where(F.size(F.col(found)["hits"]) == 0).drop(found)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    token_files.write_tokens(docs, folder, vocabulary())
    return token_files.describe_tokens(spark, folder)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``; what a stage has read is deleted once its result is written."""
    docs, read = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        folder = fresh_folder(spark)
        docs = materialise(stage(spark, docs, sf_dir), folder)
        if read:
            delete_folder(spark, read)
        read = folder
    return docs
