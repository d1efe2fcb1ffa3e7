"""Documents to training sequences: quality, line dedup, near dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written as Parquet and read again
as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestary.llm import linededup, mixing, packing, quality, simhash
from attestary.llm.encoding import Encoder
from attestary.llm.queries import tokenizer_file
from attestary.session import bound_batches, stage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier rejects go; those without words stay."""
    return quality.keep_good(docs)


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 10 or more characters stay in the first document that holds them."""
    return linededup.drop_repeated_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose sets of 5-word shingles are similar by 0.8 or more."""
    return simhash.keep_one_of_similar(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, as many words of each source as its target."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2 048 ids."""
    pieces = packing.pack_documents(docs, Encoder(tokenizer_file("byte_bpe_50k.json"), drops_blanks=False))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _bounded(apply: Callable) -> Callable:
    """The stage in a session that hands texts to Python in batches of bounded size."""
    @wraps(apply)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return apply(bound_batches(spark), docs, sf_dir)
    return run


STAGES = [(name, _bounded(apply)) for name, apply in [
    ("quality", good_documents), ("line dedup", first_lines), ("near dedup", one_of_each),
    ("mixing", mixed), ("packing", sequences)]]
ORACLE_SQL = None  # no SQL expresses the fitted classifier; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
