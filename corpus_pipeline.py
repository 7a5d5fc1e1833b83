"""Training-corpus pipeline: quality, line dedup, near-dedup, mixing, token ids.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm import bpe, line_dedup, mixing, quality, simhash_dedup
from sitegraph.llm.common import named, row_struct, stored, text_of
from sitegraph.llm.queries import MIN_DOCS, RADIUS, REPEATS, SHINGLE, token_digests
from sitegraph.llm.tokens import default_tokenizer
from sitegraph.sources.tables import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject."""
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def _packed(docs: DataFrame, *reads: str) -> DataFrame:
    """The columns a stage reads, and the whole row as the struct ``_row``: no further column can clash."""
    return docs.select(*reads, row_struct(docs).alias("_row"))


def _unpacked(rows: DataFrame, like: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``like`` again, those in ``new`` replaced."""
    return rows.select(*[new.get(c, named(c, "_row")).alias(c) for c in like.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many different texts share; ``n_chars`` follows the text.

    Copies are left to the next stage: counted here, ten of them would lose every line.
    """
    kept = line_dedup.line_dedup(_packed(docs, "text"), min_docs=MIN_DOCS, copies_count=False)
    return _unpacked(kept, docs, text=F.col("text"), n_chars=F.length("text").cast("long"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return simhash_dedup.keep_one(docs, shingle=SHINGLE, radius=RADIUS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: left out, once, or repeated rows."""
    rows = _packed(docs, "doc_id", "source", "text")
    mixed = mixing.mix(rows, F.array("source"), mixing.word_count(text_of()), F.col("doc_id"), REPEATS, carry={"_row": F.col("_row")})
    return _unpacked(mixed.where(F.col("copies") > 0).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, as digests."""
    return token_digests(bpe.encode_decode(docs, default_tokenizer()))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing to target weights", mixing_stage),
    ("BPE encoding and decoding", token_stage),
]
ORACLE_SQL = None  # hashes, flows and a trained model: tests/llm compares the stages with brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every stage's result but the last is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
