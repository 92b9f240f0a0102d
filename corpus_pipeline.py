"""Corpus preparation: each stage works on what the stage before kept, and on all of it.

Defined cases, from stage to stage: without ratings every document is good; a null or empty text is near to none, holds no
benchmark passage, has no words to mix and becomes the end id alone; of copies, one row stays, also where they share an id,
but all rows without an id stay and come first in the token files; very long texts are judged, mixed and encoded whole; an
empty benchmark removes nothing; an empty table makes no files and no rows. Columns that documents have beyond those read
(id, text, source) are carried to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrat.llm import decontamination, mixing, ngram_join, quality, token_files
from quadrat.llm.common import stored, table
from quadrat.llm.queries import tokenizer_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely good than toxic or of low quality."""
    return quality.select(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates (five words, similarity 0.8)."""
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without, or with under 5 % of, words in benchmark passages."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold by document."""
    return token_files.read(spark, token_files.encode(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", good),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mixed),
    ("token-ID output", tokens),
]
#: A trained model, hashes and a tokenizer: not SQL. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
