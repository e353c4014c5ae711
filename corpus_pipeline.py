"""A corpus from raw documents to token ids, in five stages over the operators of
`repoquarry.llm`. Each stage takes (spark, docs, sf_dir); its rows are written and read
again before the next. All but the last return the columns of documents.

SQL cannot express repeated passages, fingerprints or token ids, so there is no SQL for the rows;
the tests compare the run with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repoquarry.llm import line_dedup, mixing, quality_rules, sentencepiece_codec, simhash
from repoquarry.llm.common import table
from repoquarry.llm.registered import TOKENIZER
from repoquarry.session import materialise, ship_package


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the production policy go."""
    ship_package(spark)
    return quality_rules.filter_documents(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of passages of lines go; the documents stay."""
    ship_package(spark)
    return line_dedup.dedup_lines(docs).drop("_gone")


# The SimHash contract: 3-word shingles, fingerprints linked at 2 or fewer differing bits.
SIMHASH_WIDTH, SIMHASH_DISTANCE = 3, 2


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by SimHash stays: the smallest doc_id."""
    ship_package(spark)
    return simhash.one_of_each(docs, width=SIMHASH_WIDTH, distance=SIMHASH_DISTANCE)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document."""
    ship_package(spark)
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    ship_package(spark)
    return sentencepiece_codec.encode_texts(docs, TOKENIZER)


STAGES = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_each),
    ("source_mix", mix_to_weights),
    ("sentencepiece_encode", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if number + 1 < len(STAGES):
            rows = materialise(rows, f"stage-{name}")
    return rows
