"""A corpus in five stages: toxic and poor texts go, one of each group of near copies stays, sources are mixed, texts are packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; labels
come from the folder of the tables. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lidaraudit.llm import mixing, ngram_join, packing, quality, toxicity
from lidaraudit.llm.common import bound_batches, read_documents, written
from lidaraudit.llm.labelled import read_labels


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, read_labels(spark, sf_dir)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.of_quality(docs, quality.fit(docs, read_labels(spark, sf_dir)))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs, ngram_join.Measure(5, 80, 100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of a document as copies of it are taken."""
    return mixing.sampled(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The models and the packing aren't expressed in SQL; test_pipeline_against_plain_stages holds run()'s rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next reads it."""
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
