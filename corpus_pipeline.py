"""A training corpus from ``documents``, in five stages.

Every stage is a function of (spark, docs, sf_dir) and calls one operator of
``loomtrace.llm`` on all that the stage before it kept. What it returns is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of ``documents``; the last returns where each
document goes.

Every stage takes nulls in any column, empty and very long texts, ties, repeated
rows and ids, empty tables and further columns, of any name, and says below what
becomes of them. An empty table gives an empty result. Texts are read whole.
Further columns stay as they are, whatever their names, up to the last stage,
which returns its own columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import decontamination, mixing, sharding, simhash, toxicity
from loomtrace.llm.common import fold, read, stored
from loomtrace.llm.queries import TREE


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives 0.3 or more go. It learns from the stage's own documents and ``labels``.

    Null and empty texts score the intercept, so they stay but where most labelled texts are toxic; repeated rows score
    alike and go or stay together; rows of null ids are scored like others. Labels of null value or id count for nothing, of an id
    labelled twice the larger counts. Without labels nothing goes.
    """
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), "toxic", fold(F.col("doc_id"), 4) != 2)
    return toxicity.keep_clean(docs, model, 0.3)


def keep_one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id stays.

    Rows are judged each by itself, so texts that share an id are not lost; null ids come last; of rows of the least id
    that of the least hash stays, and of equal rows one. Null and empty texts are alike: one of them stays.
    """
    return simhash.keep_one(docs)


def reject_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark`` go.

    Null and empty texts hold none and stay; repeated rows go or stay together. Null and empty items, and items of fewer
    than eight characters, reject nothing; an item of null id rejects like any other.
    """
    return decontamination.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole time (0 to 3).

    Null and empty texts have no words and are not taken; a null source is a source of its own; rows of equal id and text
    share evenly what is taken of them; ties in the shuffle fall to id and text.
    """
    return mixing.copies(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: shard and slot, with the path through the tree.

    The id alone decides, so repeated rows go to one shard, each with a slot of its own; a null id counts as an empty one;
    null text has size 1 and checksum 0.
    """
    return sharding.shard(docs, TREE, TREE.grown()).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack"
    )


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", keep_one_of_a_kind),
    ("benchmark decontamination", reject_benchmark),
    ("mixing sources", mix_sources),
    ("sharding", deal_shards),
]

#: SQL cannot express the trained classifier nor banded alignment; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
