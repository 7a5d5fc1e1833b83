"""Helpers shared by the llm operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.session import checkpoint_dir

WS = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]
WS_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """Runs of characters other than ``[\\x20\\x09-\\x0D]``, as an array."""
    return F.filter(F.split(text, WS_RUN), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def values(column: pa.Array, rows: int = 256) -> Iterator:
    """The Python values of an Arrow column, made ``rows`` at a time: the texts of a batch never all exist twice."""
    for k in range(0, len(column), rows):
        yield from column.slice(k, rows).to_pylist()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The copy cuts the lineage: a lost executor costs a reread, and branches that
    read it all see the same rows even where ``df`` is not repeatable.
    """
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(name: str, of: str | None = None) -> Column:
    """The column of exactly this name (or field of the struct column ``of``), whatever signs it holds."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def row_struct(df: DataFrame) -> Column:
    """The whole row as one struct, so that no column of it can clash with those an operator adds."""
    return F.struct(*[named(c).alias(c) for c in df.columns])


def only(df: DataFrame, **cols: Column | str) -> DataFrame:
    """Just the named columns, so that further columns of the input cannot clash."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in cols.items()])
