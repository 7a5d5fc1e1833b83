"""Line deduplication with levelled sorted runs of line hashes.

The store holds sorted runs of (line hash, number of documents). A batch is
merge-anti-joined with the settled lines of the runs (those already found in
enough documents) and its remaining counts become a new run; when a level has
``fanout`` runs they are compacted into one run of the next level.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegraph.llm.common import WS, ascii_lower, named, scratch, shuffle_partitions, stored, text_of

LINES = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
                      T.StructField("kept", T.StringType())])
HASH = ["hi", "lo"]  # two 64-bit hashes of a line's key


def line_key(line: Column) -> Column:
    """The line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, with A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(WS)))


def line_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("hi"), F.xxhash64(F.lit("line"), key).alias("lo"))


class LineRuns:
    """Levelled sorted runs of ``(hi, lo, n_docs)`` in a shared folder.

    Every batch leaves a manifest of the runs that count; a store opened again
    with its ``path`` goes on behind the last batch that was added whole.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 4, path: str | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.path = path or scratch(spark, "line-runs")
        self.levels: list[list[str]] = []
        self._made = 0
        if path:
            self._open()

    def _open(self) -> None:
        try:
            kept = self.spark.read.schema("level int, run int, v int").parquet(f"{self.path}/manifest").collect()  # one row a run and batch
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                raise
            return
        last = max(r.v for r in kept)
        self._made = last
        for r in sorted((r for r in kept if r.v == last), key=lambda r: r.run):
            while len(self.levels) <= r.level:
                self.levels.append([])
            self.levels[r.level].append(f"{self.path}/level={r.level}/run={r.run}")

    def _save(self) -> None:
        live = [(level, int(p.rsplit("=", 1)[1])) for level, paths in enumerate(self.levels) for p in paths]
        self.spark.createDataFrame(live, "level int, run int").coalesce(1).write.parquet(f"{self.path}/manifest/v={self._made}")

    def _write(self, counts: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        run = f"{self.path}/level={level}/run={self._made}"
        self._made += 1
        counts.repartitionByRange(shuffle_partitions(self.spark), *HASH).sortWithinPartitions(*HASH).write.mode("overwrite").option(
            "compression", "zstd").parquet(run)
        self.levels[level].append(run)

    def _merged(self, paths: list[str]) -> DataFrame:
        schema = "hi long, lo long, n_docs long"
        if not paths:
            return self.spark.createDataFrame([], schema)
        runs = [self.spark.read.schema(schema).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, runs).groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"))

    def counts(self) -> DataFrame:
        """Documents per line hash; a settled line's count is at least ``min_docs``, later batches left out."""
        return self._merged([p for level in self.levels for p in level])

    def settled(self) -> DataFrame:
        return self.counts().where(F.col("n_docs") >= self.min_docs).select(*HASH)

    def add(self, batch: DataFrame) -> None:
        """Add a batch of ``(hi, lo, n_docs)``; lines that are settled already add nothing."""
        self._write(batch.join(self.settled(), HASH, "left_anti") if self.levels else batch, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            level += 1
        self._save()


@F.pandas_udf(LINES)
def _without(text: pd.Series, drops: pd.Series) -> pd.DataFrame:
    rows = []
    for t, d in zip(text, drops, strict=True):
        lines = t.split("\n")
        gone = set() if d is None else set(d)
        rows.append((len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t))
    return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])


def line_dedup(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4,
               runs: LineRuns | None = None, copies_count: bool = True) -> DataFrame:
    """Drop every line whose key occurs in at least ``min_docs`` documents, in all of them.

    Returns the input rows and columns with ``text_col`` replaced by the kept
    lines joined by ``\\n`` and two columns more, ``n_lines`` (before) and
    ``n_dropped``; input columns of those names are replaced. ``runs`` may hold
    earlier batches; the documents are added in ``batches`` batches by the hash
    of their text.

    A null or empty text is one empty line; keys shorter than ``min_chars`` code
    points are never dropped; a document that loses all lines keeps the empty
    text. Every row is a document, repeated rows too; a key counts once a
    document. With ``copies_count=False`` rows of equal text count as one
    document, so copies alone do not empty one another. An empty table gives an
    empty result.

    Equal texts lose the same lines, so line work is done once per distinct
    text, counted with its number of rows (or as one), and only hashes and line numbers are
    shuffled before the one join that brings each text its dropped lines.
    """
    spark = docs.sparkSession
    t = text_of(text_col)
    tid = F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit("text"), t).alias("b"))
    keys = F.transform(F.split(t, "\n"), line_key)
    hashes = F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, line_hash(k)))
    seen = docs.select(tid.alias("tid"), hashes.alias("h"))
    n = F.count(F.lit(1)) if copies_count else F.lit(1).cast("long")
    texts = stored(seen.groupBy("tid").agg(n.alias("n"), F.first("h").alias("h")), "line-texts")
    per_batch = texts.select(F.pmod(F.col("tid.a"), F.lit(batches)).alias("batch"), "n", F.explode(
        F.array_distinct(F.filter("h", lambda x: x.isNotNull()))).alias("x")).groupBy("batch", "x.hi", "x.lo").agg(
        F.sum("n").alias("n_docs"))
    counts = stored(per_batch, "line-counts", ("batch",))
    runs = runs or LineRuns(spark, min_docs)
    for b in range(batches):
        runs.add(counts.where(F.col("batch") == b).select(*HASH, "n_docs"))
    where = texts.select("tid", F.posexplode("h").alias("pos", "x")).select("tid", "pos", "x.hi", "x.lo")
    # stored first: two plain shuffles meet in this join, and Spark can split a line that very many texts share
    settled = stored(runs.settled(), "line-settled")
    drops = stored(where.join(settled, HASH).groupBy("tid").agg(F.collect_list("pos").alias("_drops")), "line-drops")
    keep = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[named(c).alias(c) for c in keep]).alias("_row") if keep else F.lit(0).alias("_row"), t.alias("_t"), tid.alias("tid"))
    done = rows.join(drops, "tid", "left").select("_row", _without("_t", "_drops").alias("_d"))
    back = [named(c, "_row").alias(c) if c in keep else F.col("_d.kept").alias(c)
            for c in docs.columns if c in keep or c == text_col]
    return done.select(*back, F.col("_d.n_lines").alias("n_lines"), F.col("_d.n_dropped").alias("n_dropped"))
