"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised texts, an external sort places
equal texts next to each other, and full comparisons of neighbours find the
groups. A group that crosses partition borders is put together afterwards from
one small row per border run.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegraph.llm.common import WS, only, shuffle_partitions, stored, text_of

RUN_SCHEMA = ("doc_id long, sha string, keep_id long, keep_chars long, group_size long, kept boolean, "
              "pid int, edge int, edge_norm string")
ARROW_SCHEMA = pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("keep_id", pa.int64()),
                          ("keep_chars", pa.int64()), ("group_size", pa.int64()), ("kept", pa.bool_()),
                          ("pid", pa.int32()), ("edge", pa.int32()), ("edge_norm", pa.string())])
INNER, FIRST, LAST, BOTH = 0, 1, 2, 3  # place of a run of equal texts in its partition


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``."""
    for c in WS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _runs(batches):
    """Rows sorted by (text, longest original, id) -> the same rows with the keeper and size of their run."""
    pid = TaskContext.get().partitionId()
    out = {f.name: [] for f in ARROW_SCHEMA}

    def emit(run, edge):
        norm, ids, chars = run
        sha = hashlib.sha256(norm.encode()).hexdigest()
        n = len(ids)
        out["doc_id"] += ids
        out["sha"] += [sha] * n
        out["keep_id"] += [ids[0]] * n
        out["keep_chars"] += [chars] * n
        out["group_size"] += [n] * n
        out["kept"] += [True] + [False] * (n - 1)
        out["pid"] += [pid] * n
        out["edge"] += [edge] * n
        out["edge_norm"] += [norm if edge else None] + [None] * (n - 1)

    def drain():
        b = pa.RecordBatch.from_pydict(out, schema=ARROW_SCHEMA)
        for v in out.values():
            v.clear()
        return b

    run, place = None, FIRST
    for batch in batches:
        for norm, doc_id, chars in zip(*(batch.column(c).to_pylist() for c in ("norm", "doc_id", "n_chars")), strict=True):
            if run is not None and run[0] == norm:
                run[1].append(doc_id)
                continue
            if run is not None:
                emit(run, place)
                place = INNER
                if len(out["doc_id"]) >= 10_000:
                    yield drain()
            run = (norm, [doc_id], chars)
    if run is not None:
        emit(run, BOTH if place == FIRST else LAST)
        yield drain()


def _border_fixes(runs: DataFrame) -> DataFrame:
    """``(pid, edge, fix_id, fix_size, host)`` for border runs that continue in a neighbouring partition.

    There are at most two border runs a partition, so the two windows without a
    key see a few narrow rows per partition; the texts meet in a join on the
    partition number.
    """
    border = runs.where(F.col("edge_norm").isNotNull())
    pids = border.select("pid").distinct().withColumn("next", F.lead("pid").over(Window.orderBy("pid")))
    tails = border.where(F.col("edge").isin(LAST, BOTH)).select("pid", F.col("edge_norm").alias("tail"))
    heads = border.where(F.col("edge").isin(FIRST, BOTH)).select(F.col("pid").alias("next"), F.col("edge_norm").alias("head"))
    glued = pids.join(tails, "pid").join(heads, "next").where(F.col("tail") == F.col("head")).select(
        F.col("next").alias("pid"), F.lit(True).alias("glued"))
    narrow = border.drop("edge_norm").join(glued, "pid", "left").withColumn(
        "starts", F.when(F.col("edge").isin(FIRST, BOTH) & F.col("glued"), 0).otherwise(1))
    chained = narrow.withColumn("gid", F.sum("starts").over(Window.orderBy("pid", "edge")))
    best = chained.groupBy("gid").agg(
        F.count(F.lit(1)).alias("n"), F.sum("group_size").alias("fix_size"),
        F.min(F.struct(-F.col("keep_chars"), F.col("keep_id").isNull(), F.col("keep_id"), "pid")).alias("m")).where("n > 1")
    return chained.join(best, "gid").select(
        "pid", "edge", F.col("m")["keep_id"].alias("fix_id"), "fix_size", (F.col("pid") == F.col("m")["pid"]).alias("host"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                partitions: int | None = None) -> DataFrame:
    """Groups of rows whose texts are equal after deleting ``[\\x20\\x09-\\x0D]``.

    Of a group the row with the most code points in its original text, then the
    smallest id, stays. Returns one row per input row: ``doc_id, keep_id,
    group_size, kept, text_sha256`` (of the normalised text).

    A null text counts as empty; all texts without other characters form one
    group. Null ids sort after all others. Of rows that tie in all of this
    exactly one is ``kept``. An empty table gives an empty result; further
    columns are ignored. Range borders fall inside a group too, so no group has
    to fit one task, nor do rows equal in all columns: the row's number in the
    input is the last key. The splitters are short (16 characters, hash, length, id, number).
    """
    spark = docs.sparkSession
    t = text_of(text_col)
    base = only(docs, doc_id=F.col(id_col).cast("long"), norm=normalised(t), n_chars=F.length(t).cast("long"))
    base = base.select("*", F.substring("norm", 1, 16).alias("_p"), F.xxhash64("norm").alias("_h"),
                       F.monotonically_increasing_id().alias("_n"))
    tail = [F.col("n_chars").desc(), F.col("doc_id").asc_nulls_last(), F.col("_n")]
    dealt = base.repartitionByRange(partitions or shuffle_partitions(spark), "_p", "_h", *tail)
    ordered = dealt.sortWithinPartitions("_p", "_h", "norm", *tail)
    runs = stored(ordered.select("norm", "doc_id", "n_chars").mapInArrow(_runs, RUN_SCHEMA), "exact")
    return runs.join(_border_fixes(runs), ["pid", "edge"], "left").select(
        "doc_id", F.when(F.col("fix_size").isNull(), F.col("keep_id")).otherwise(F.col("fix_id")).alias("keep_id"),
        F.coalesce("fix_size", "group_size").alias("group_size"),
        (F.col("kept") & F.coalesce("host", F.lit(True))).alias("kept"), F.col("sha").alias("text_sha256"))
