"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import only, shuffle_partitions, text_of
from sitegraph.operators.frontier import rank_within


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard (position in ``weights``) with the best score for the key.

    Each shard draws a number ``u`` in (0, 1) from the hash of (key, shard) and
    scores ``-ln(u) / weight``; the least wins, the lower shard on a tie. A
    shard's share is its weight; a changed weight or a new shard moves only the
    records it wins or loses, since no other score changes.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")

    def score(w, s):
        u = (F.call_function("shiftrightunsigned", F.xxhash64(key, s), F.lit(11)) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.ln(u) / w).alias("score"), s.alias("shard"))

    return F.array_min(F.transform(F.array(*[F.lit(float(w)) for w in weights]), score))["shard"]


def record_key(id_col: str, text_col: str) -> Column:
    """Stable key of a row: the hash of its id, for a null id of its text."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("text"), text_of(text_col))).otherwise(
        F.xxhash64(F.col(id_col).cast("string")))


def shard(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text",
          new_weight: float = 1.0) -> DataFrame:
    """Shard and slot of every row, and the shard it would have with one shard more (of ``new_weight``).

    Returns ``doc_id, size, text_crc32, shard, slot, grown_shard``: ``size`` is
    the text's UTF-8 bytes plus 16, ``slot`` numbers a shard's rows from 0 by
    (id, crc, size). The record key is the id; a null id uses its text instead,
    so such rows spread too. A null text has no bytes. Rows of one id share a
    shard and get a slot each. An empty table gives an empty result; further
    columns are ignored.
    """
    t = text_of(text_col)
    rows = only(docs, doc_id=id_col, size=(F.octet_length(t) + 16).cast("long"), text_crc32=F.crc32(t), _key=record_key(id_col, text_col))
    dealt = rows.select("doc_id", "size", "text_crc32", rendezvous(F.col("_key"), list(weights)).alias("shard"),
                        rendezvous(F.col("_key"), [*weights, new_weight]).alias("grown_shard"))
    return rank_within(dealt, ["doc_id", "text_crc32", "size"], "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - 1).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the whole rows as Parquet, one folder a shard, with the shards that ``shard`` gives; returns the folders' name.

    The folders are ``shard=<k>``; where the input has a column of that name,
    underscores are added. A shard's rows are dealt to as many tasks as there
    are shuffle partitions for each shard, so a shard has that many files at
    most and no task holds a whole one. An empty table writes no folder.
    """
    name = "shard"
    while name in docs.columns:
        name += "_"
    n = shuffle_partitions(docs.sparkSession)
    tasks = -(-n // len(weights))
    deal = F.pmod(F.xxhash64(F.lit("task"), id_col, text_of(text_col)), F.lit(tasks))
    out = docs.withColumn(name, rendezvous(record_key(id_col, text_col), list(weights)))
    out.repartition(n, name, deal).write.partitionBy(name).parquet(path)
    return name
