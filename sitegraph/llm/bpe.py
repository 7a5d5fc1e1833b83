"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash cuts texts into chunks at places that depend only on the text
nearby, so passages that documents share give the same chunks. Chunks that
occur more than once in the corpus are encoded once and their ids brought to
every document; the joins between chunks, where a cut may split a word, are
repaired by encoding the text around them again until it agrees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import only, stored, text_of, values
from sitegraph.llm.tokens import default_tokenizer, pieces

MASK_BITS = 9  # a cut every 512 bytes on average
MOST = 8192  # no chunk is longer
FILTER_BITS = 27  # size of the bitmap of repeated chunks (16 MB), whatever the input
FLUSH = 4 << 20  # bytes of results per Arrow batch
TABLE = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], dtype=np.uint32)
BLANKS = (32, 10)  # blanks and line ends: no token of the tokenizer spans them


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data`` (UTF-8), the last one its length; never inside a character."""
    n = len(data)
    if not n:
        return []
    b = np.frombuffer(data, dtype=np.uint8)
    h = TABLE[b]
    for width, mult in ((1, 0x9E3779B1), (2, 0x85EBCA77), (4, 0xC2B2AE3D), (8, 0x27D4EB2F)):  # window: 16 bytes
        if n > width:
            h = h.copy()
            h[width:] = h[width:] + h[:-width] * np.uint32(mult)
    start = (b & 0xC0) != 0x80  # a character begins here
    at = np.nonzero(((h[:-1] >> np.uint32(32 - MASK_BITS)) == 0) & start[1:])[0] + 1
    out, last = [], 0
    for c in [*at.tolist(), n]:
        while c - last > MOST:
            last += MOST
            while not start[last]:
                last -= 1
            out.append(last)
        if c > last:
            out.append(c)
            last = c
    return out


def keys(data: bytes, ends: list[int]) -> np.ndarray:
    """128-bit hashes of the chunks, as an array of two signed 64-bit columns."""
    out = np.empty((len(ends), 2), dtype="<i8")
    last = 0
    for k, e in enumerate(ends):
        out[k] = np.frombuffer(xxhash.xxh3_128_digest(data[last:e]), dtype="<i8")
        last = e
    return out


def _chunk_counts(batches):
    for b in batches:
        found = [keys(d, cuts(d)) for d in (t.encode() for t in values(b.column("t")))]
        if sum(map(len, found)):
            k, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(n)], ["k1", "k2", "n"])


def repeated_filter(rows: DataFrame) -> np.ndarray:
    """Bitmap over chunk hashes with the bits of all chunks that occur more than once.

    Its size is fixed. A chunk that occurs once may hit a set bit; it is then
    encoded like a repeated one, with the same result.
    """
    seen = rows.mapInArrow(_chunk_counts, "k1 long, k2 long, n long").groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    bit = F.col("k1").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = seen.where("n > 1").select(F.shiftright(bit, 6).alias("word"), F.call_function(
        "shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("bits")).groupBy("word").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def is_repeated(k: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = k[:, 0].view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _left(data: bytes, at: int) -> int:
    """Start of the word that holds the byte before ``at``."""
    return max(data.rfind(b" ", 0, at), data.rfind(b"\n", 0, at)) + 1


def _right(data: bytes, at: int) -> int:
    """End of the word that holds the byte at ``at``."""
    found = [p for p in (data.find(b" ", at), data.find(b"\n", at)) if p >= 0]
    return min(found, default=len(data))


def seam(data: bytes, at: int, encode) -> tuple[int, int]:
    """The smallest span of whole words around a cut that encodes alike alone and among its neighbours."""
    a, z = _left(data, at), _right(data, at)
    while a > 0 or z < len(data):
        a2, z2 = _left(data, max(a - 1, 0)), _right(data, min(z + 1, len(data)))
        if encode(data[a2:z2]) == encode(data[a2:a]) + encode(data[a:z]) + encode(data[z:z2]):
            break
        a, z = a2, z2
    return a, z


def take_apart(data: bytes, ends: list[int], k: np.ndarray, repeated: np.ndarray, encode):
    """A document as encoded spans and references to repeated chunks.

    Returns ``(fixed, holes)`` with one more span than holes: the ids are
    ``fixed[0] + hole 0 + fixed[1] + ...``, where hole = (start, end, key, ids to
    drop at its left, at its right). Next to every hole the seam's ids belong to
    the spans, so what is left of the chunk's own ids is exact.
    """
    starts = [0, *ends[:-1]]
    holes = [(starts[i], ends[i], k[i]) for i in np.nonzero(repeated)[0].tolist()]
    spans = {}

    def around(at):
        if at not in spans:
            blank = at in (0, len(data)) or data[at] in BLANKS or data[at - 1] in BLANKS
            spans[at] = (at, at) if blank else seam(data, at, encode)
        return spans[at]

    fixed, kept, done = [], [], 0
    for s, e, key in holes:
        a, z = max(around(s)[1], done), around(e)[0]
        if a >= z or a < s or z > e:  # the seams take the whole chunk: its text goes to the span
            continue
        fixed.append(encode(data[done:a]))
        kept.append((s, e, key, len(encode(data[s:a])) // 4, len(encode(data[z:e])) // 4))
        done = z
    fixed.append(encode(data[done:]))
    return fixed, kept


def _pack(ids: bytes, wide: bool) -> bytes:
    return ids if wide else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()


def _unpack(ids: bytes, wide: bool) -> bytes:
    return ids if wide else np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()


def _flushed(schema: pa.Schema, rows):
    """Rows (tuples, with their size) as record batches of bounded bytes."""
    buf, held = [], 0
    for row, size in rows:
        buf.append(row)
        held += size
        if held >= FLUSH or len(buf) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*buf, strict=True), schema, strict=True)], schema=schema)
            buf, held = [], 0
    if buf:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*buf, strict=True), schema, strict=True)], schema=schema)


HOLE = pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("dl", pa.int32()), ("dr", pa.int32())])
PARTS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("fixed", pa.list_(pa.binary())),
                   ("holes", pa.list_(HOLE)), ("k1", pa.int64()), ("k2", pa.int64()), ("chunk", pa.string())])
PARTS_DDL = ("uid long, doc_id long, fixed array<binary>, holes array<struct<k1: long, k2: long, dl: int, dr: int>>, "
             "k1 long, k2 long, chunk string")
DONE = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
DONE_DDL = "doc_id long, ids binary, decoded string"


def encode_decode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Token ids of every whole text and the text they decode to.

    Returns one row per input row: ``doc_id, ids`` (little-endian unsigned
    32-bit integers) and ``decoded``, as the tokenizers library's ``encode``
    without special tokens and ``decode(ids, skip_special_tokens=False)`` give
    them. ``tokenizer`` is the path of a tokenizer file on the workers.

    A null text counts as empty (no ids). Null ids and repeated rows stay. An
    empty table gives an empty result; further columns are ignored. A tokenizer
    whose tokens may span blanks (see ``Pieces.by_piece``) is applied to whole
    texts instead of chunks.

    The corpus is read three times: to find repeated chunks (only hashes are
    shuffled), to take documents with repeated chunks apart (only these and each
    repeated chunk's text are shuffled), and to encode the others on the spot.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    rows = only(docs, doc_id=F.col(id_col).cast("long"), t=text_of(text_col))
    by_piece, wide = pieces(path).by_piece, pieces(path).tok.get_vocab_size() > 1 << 16
    if not by_piece:
        def plain(batches):
            p = pieces(path)

            def each():
                for b in batches:
                    for i, t in zip(values(b.column("doc_id")), values(b.column("t")), strict=True):
                        ids = p.encode(t)
                        yield (i, ids, p.decode(ids)), 3 * len(ids)
            yield from _flushed(DONE, each())
        return rows.mapInArrow(plain, DONE_DDL)

    bitmap = spark.sparkContext.broadcast(repeated_filter(rows))

    def documents(batches):
        for b in batches:
            for i, t in zip(values(b.column("doc_id")), values(b.column("t")), strict=True):
                data = t.encode()
                ends = cuts(data)
                k = keys(data, ends)
                yield i, t, data, ends, k, is_repeated(k, bitmap.value)

    def unshared(batches):
        p = pieces(path)

        def each():
            for i, t, _, _, _, rep in documents(batches):
                if not rep.any():
                    ids = p.encode(t)
                    yield (i, ids, p.decode(ids)), 3 * len(ids)
        yield from _flushed(DONE, each())

    def apart(batches):
        p, sent = pieces(path), set()
        at = TaskContext.get().partitionId() << 33

        def encode(part):
            return p.encode(part.decode())

        def each():
            nonlocal at
            for i, _, data, ends, k, rep in documents(batches):
                if rep.any():
                    fixed, holes = take_apart(data, ends, k, rep, encode)
                    at += 1
                    yield (at, i, [_pack(f, wide) for f in fixed], [
                        {"k1": int(q[0]), "k2": int(q[1]), "dl": dl, "dr": dr} for _, _, q, dl, dr in holes],
                        None, None, None), sum(map(len, fixed))
                    for s, e, q, _, _ in holes:
                        key = (int(q[0]), int(q[1]))
                        if key not in sent:
                            sent.add(key)
                            yield (None, None, None, None, *key, data[s:e].decode()), e - s
        yield from _flushed(PARTS, each())

    def encode_chunks(batches):
        p = pieces(path)
        schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ids", pa.binary())])

        def each():
            for b in batches:
                for k1, k2, c in zip(*(values(b.column(x)) for x in ("k1", "k2", "chunk")), strict=True):
                    ids = _pack(p.encode(c), wide)
                    yield (k1, k2, ids), len(ids)
        yield from _flushed(schema, each())

    def assemble(batches):
        p, unit = pieces(path), 4 if wide else 2

        def each():
            for b in batches:
                for i, fixed, holes, got in zip(*(values(b.column(x)) for x in ("doc_id", "fixed", "holes", "got")), strict=True):
                    chunks = {g["j"]: g["ids"] for g in got or []}
                    out = [fixed[0]]
                    for j, h in enumerate(holes):
                        ids = chunks[j]
                        out += [ids[unit * h["dl"]: len(ids) - unit * h["dr"]], fixed[j + 1]]
                    ids = _unpack(b"".join(out), wide)
                    yield (i, ids, p.decode(ids)), 3 * len(ids)
        yield from _flushed(DONE, each())

    parts = stored(rows.mapInArrow(apart, PARTS_DDL), "bpe-parts")
    chunks = parts.where(F.col("uid").isNull()).groupBy("k1", "k2").agg(F.first("chunk").alias("chunk"))
    encoded = chunks.mapInArrow(encode_chunks, "k1 long, k2 long, ids binary")
    open_docs = parts.where(F.col("uid").isNotNull()).select("uid", "doc_id", "fixed", "holes")
    wanted = open_docs.select("uid", F.posexplode("holes").alias("j", "h")).select("uid", "j", "h.k1", "h.k2")
    got = wanted.join(encoded, ["k1", "k2"]).groupBy("uid").agg(F.collect_list(F.struct("j", "ids")).alias("got"))
    shared = open_docs.join(got, "uid", "left").select("doc_id", "fixed", "holes", "got").mapInArrow(assemble, DONE_DDL)
    return rows.mapInArrow(unshared, DONE_DDL).unionByName(shared)
