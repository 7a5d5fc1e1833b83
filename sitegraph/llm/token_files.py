"""Token-id files of directly addressable codes.

A segment holds the ids of some documents. Every id is split into chunks of
eight bits; level 0 has the lowest chunk of every id and a bitmap that says
which ids go on, level 1 the next chunk of those, and so on. A rank directory
over each bitmap gives the place in the next level, so any token is read by a
few array look-ups without decoding what stands before it.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegraph.llm.common import only, scratch, shuffle_partitions, text_of
from sitegraph.llm.tokens import default_tokenizer, pieces

MAGIC = b"DAC1"
BLOCK = 64  # bits per entry of a rank directory: one machine word
SEGMENT = 1 << 18  # ids after which a segment is closed; a document stays in one segment


def pack(ids: np.ndarray) -> bytes:
    """Ids (unsigned 32-bit) as one self-contained blob: header, then per level chunks, bitmap and rank directory."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    levels = []
    while True:
        more = (rest >> np.uint32(8)) > 0
        chunk = (rest & np.uint32(255)).astype(np.uint8).tobytes()
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.pad(bitmap, (0, -len(bitmap) % (BLOCK // 8)))
        ones = np.bitwise_count(bitmap.view("<u8")).astype(np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes()
        levels.append((len(rest), chunk, bitmap.tobytes(), ranks))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    head = MAGIC + struct.pack("<I", len(levels)) + b"".join(
        struct.pack("<QQQ", n, len(b), len(r)) for n, _, b, r in levels)
    return head + b"".join(c + b + r for _, c, b, r in levels)


class Dac:
    """Random access to the ids of a blob."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        (n_levels,) = struct.unpack_from("<I", blob, 4)
        at, self.levels = 8 + 24 * n_levels, []
        for k in range(n_levels):
            n, nb, nr = struct.unpack_from("<QQQ", blob, 8 + 24 * k)
            chunk = np.frombuffer(blob, np.uint8, n, at)
            bitmap = np.frombuffer(blob, "<u8", nb // 8, at + n)
            ranks = np.frombuffer(blob, "<u4", nr // 4, at + n + nb)
            self.levels.append((chunk, bitmap, ranks))
            at += n + nb + nr

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def get(self, where: np.ndarray) -> np.ndarray:
        """Ids at any positions, in any order."""
        where = np.asarray(where, dtype=np.int64)
        out = np.zeros(len(where), dtype=np.uint32)
        todo, pos = np.arange(len(where)), where
        for level, (chunk, bitmap, ranks) in enumerate(self.levels):
            out[todo] |= chunk[pos].astype(np.uint32) << np.uint32(8 * level)
            word, bit = bitmap[pos // BLOCK], (pos % BLOCK).astype(np.uint64)
            on = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            nxt = ranks[pos // BLOCK] + np.bitwise_count(below)
            todo, pos = todo[on], nxt[on].astype(np.int64)
            if not len(pos):
                break
        return out

    def run(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, one after the other: the directory is asked once a level, for the run's first id."""
        out = np.zeros(stop - start, dtype=np.uint32)
        todo, a, b = slice(None), start, stop
        for level, (chunk, bitmap, ranks) in enumerate(self.levels):
            out[todo] |= chunk[a:b].astype(np.uint32) << np.uint32(8 * level)
            first = a // BLOCK
            bits = np.unpackbits(bitmap[first:-(-b // BLOCK)].view(np.uint8), bitorder="little")
            skipped = int(bits[:a - first * BLOCK].sum())
            on = np.flatnonzero(bits[a - first * BLOCK:b - first * BLOCK])
            if not len(on):
                break
            todo = on if level == 0 else todo[on]
            a = int(ranks[first]) + skipped
            b = a + len(on)
        return out


SEGMENTS = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                      ("lengths", pa.list_(pa.int64())), ("blob", pa.binary())])
SEGMENTS_DDL = "part int, seg int, n_ids long, doc_ids array<long>, lengths array<long>, blob binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text", partitions: int | None = None) -> None:
    """Encode every text, append ``end_id`` and write the ids in ascending id order as segments under ``path``.

    The files are Parquet with a row per segment: ``part, seg`` (its order),
    ``n_ids``, the documents' ids and lengths, and the blob of ``pack``. Rows are
    range-partitioned by id before they are encoded, so a text is moved once
    and encoded once. A null text counts as empty (just the end id). Null ids
    come last; equal ids are ordered by the hash of their text. An empty table
    writes no segment; further columns are ignored.
    """
    tok = tokenizer or default_tokenizer()

    def run(batches):
        p, part, seg = pieces(tok), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        ids, names, lengths, held = [], [], [], 0

        def close():
            arr = np.frombuffer(b"".join(ids), dtype="<u4")
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
                (part, seg, len(arr), names, lengths, pack(arr)), SEGMENTS, strict=True)], schema=SEGMENTS)

        for b in batches:
            for doc_id, t in zip(b.column("doc_id").to_pylist(), b.column("t").to_pylist(), strict=True):
                got = p.encode(t) + end
                ids.append(got), names.append(doc_id), lengths.append(len(got) // 4)
                held += len(got) // 4
                if held >= SEGMENT:
                    yield close()
                    seg += 1
                    ids, names, lengths, held = [], [], [], 0
        if names:
            yield close()

    rows = only(docs, doc_id=F.col(id_col).cast("long"), t=text_of(text_col)).withColumn("_h", F.xxhash64("t"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("_h")]
    dealt = rows.repartitionByRange(partitions or shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "t").mapInArrow(run, SEGMENTS_DDL).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Documents of the files: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids`` (little-endian bytes).

    A segment's ids are read in one run and cut at its documents' ends. The segments'
    offsets are broadcast if there are at most ``broadcast_rows``, else joined.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for b in batches:
            for base, names, lengths, blob in zip(*(b.column(c).to_pylist() for c in ("base", "doc_ids", "lengths", "blob")), strict=True):
                dac, ends = Dac(blob), np.cumsum(lengths, dtype=np.int64)
                ids = pa.py_buffer(dac.run(0, len(dac)).astype("<u4"))
                offsets = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int64))
                found = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, offsets, ids]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(base + ends - lengths), pa.array(lengths, pa.int64()), found],
                                                 schema=schema)

    files = spark.read.schema(SEGMENTS_DDL).parquet(path)
    sizes = files.select("part", "seg", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per task that wrote
    before = parts.withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "base")
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seg")) - F.col("n_ids")
    offsets = sizes.withColumn("inside", inside).join(before, "part").select("part", "seg", (F.col("base") + F.col("inside")).alias("base"))
    small = sizes.limit(broadcast_rows + 1).count() <= broadcast_rows  # an offset is three integers
    placed = files.join(F.broadcast(offsets) if small else offsets, ["part", "seg"])
    return placed.select("base", "doc_ids", "lengths", "blob").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")


def token_table(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row, from files written in the shared folder and read back."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id, id_col, text_col)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

