"""SimHash near-dedup: pigeonhole blocks, Hamming verification and connected components.

Texts become 64-bit fingerprints of their word shingles; only distinct
fingerprints are compared. Close fingerprints share some choice of blocks, so
they meet in that block table's bucket, where their distance is verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegraph.llm.common import named, only, row_struct, stored, text_of, values
from sitegraph.llm.simhash import block_keys, block_masks, to_hex
from sitegraph.operators.graph import checkpoint_counted

SLICE = 1024  # members of a bucket that are compared with one another in one go
HASHES = 1 << 16  # shingle hashes unpacked to bits at a time
SALTS = 64  # keys over which the rows of one group are spread
CHUNK = 1 << 16  # links that are joined up in one go


def simhash(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Bit b is 1 if it is set in over half of the XXH64 hashes of the text's word shingles.

    Words are runs of bytes other than ``[\\x20\\x09-\\x0D]`` after lowering A-Z;
    shingles repeat as often as they occur; a text of fewer words is one
    shingle; a text without words gives 0.
    """
    words = text.encode().lower().split()  # bytes: ASCII case and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()]
    stops = (ends[shingle - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), HASHES):
        part = hashes[k:k + HASHES].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                     seed: int = 42, **carry: Column) -> DataFrame:
    """``doc_id, fp`` (signed long) of every row, and the long columns ``carry``."""
    def run(batches):
        for b in batches:
            fps = np.array([simhash(t, shingle, seed) for t in values(b.column("t"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64)), *map(b.column, names)],
                                             ["doc_id", "fp", *names])

    names = list(carry)
    rows = only(docs, doc_id=F.col(id_col).cast("long"), t=text_of(text_col), **carry)
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", "fp", *names]))


def _stars(batches_radius: int):
    """For each pair of bucket slices: links that connect its members as all close pairs would (a forest)."""
    def run(batches):
        for b in batches:
            a, c = [], []
            for left, right in zip(b.column("left").to_pylist(), b.column("right").to_pylist(), strict=True):
                same = right is None
                x = np.array(left, dtype=np.int64).view(np.uint64)
                y = x if same else np.array(right, dtype=np.int64).view(np.uint64)
                near = np.bitwise_count(x[:, None] ^ y[None, :]) <= batches_radius
                root = list(range(len(x) + (0 if same else len(y))))

                def find(k, root=root):
                    while root[k] != k:
                        root[k] = root[root[k]]
                        k = root[k]
                    return k

                for i, j in zip(*np.nonzero(near), strict=True):
                    p, q = find(int(i)), find(int(j) + (0 if same else len(x)))
                    if p != q:
                        root[q] = p
                        a.append(int(x[i].view(np.int64)))
                        c.append(int(y[j].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])
    return run


def links(fps: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Edges ``(a, b)`` with the connected components of "differs in at most ``radius`` bits" over distinct ``fp``.

    A bucket of a block table is cut into slices of ``SLICE`` members; every two
    slices of it (and each with itself) are compared in a task of their own,
    which returns only a spanning forest of the close pairs it saw. So a large
    group of near copies gives at most as many rows as members and slices, its
    pairs are never listed, and none is left out.
    """
    masks = block_masks(radius, blocks)
    keyed = fps.select("fp", F.inline(block_keys(F.col("fp"), masks)))
    sized = keyed.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keyed.join(sized, ["tab", "key"])
    n_slices = F.ceil(F.col("n") / SLICE).cast("int")
    sliced = members.withColumn("slice", F.pmod(F.xxhash64("fp", F.lit("slice")), n_slices).cast("int"))
    groups = stored(sliced.groupBy("tab", "key", "slice").agg(
        F.collect_list("fp").alias("left"), F.first(n_slices).alias("k")), "simhash-slices")
    alone = groups.where(F.size("left") > 1).select("left", F.lit(None).cast("array<bigint>").alias("right"))
    many = groups.where("k > 1")
    across = many.select("tab", "key", "left", "slice", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")).where(
        F.col("o") > F.col("slice")).join(many.select("tab", "key", F.col("slice").alias("o"), F.col("left").alias("right")),
                                          ["tab", "key", "o"]).select("left", "right")
    return alone.unionByName(across).mapInArrow(_stars(radius), "a long, b long").distinct()


def _salt(col: str) -> Column:
    return F.pmod(F.xxhash64(col, F.lit("salt")), F.lit(SALTS))


def with_least(rows: DataFrame, by: str, value: str, name: str, salt: str) -> DataFrame:
    """``rows`` with the least ``value`` of their ``by`` as ``name``; no task gets a whole large group.

    Each group is spread by ``salt`` over ``SALTS`` keys; only the least value of
    every such key meets its group's others.
    """
    spread = rows.withColumn("_salt", _salt(salt))
    least = spread.groupBy(by, "_salt").agg(F.min(value).alias("_least"))
    least = least.select(by, "_salt", F.min("_least").over(Window.partitionBy(by)).alias(name))
    return spread.join(least, [by, "_salt"]).drop("_salt")


def spread_join(rows: DataFrame, classes: DataFrame, key: str, salt: str) -> DataFrame:
    """``rows`` joined with the one row that ``classes`` has for their ``key``, a frequent key spread by ``salt``."""
    spread = rows.withColumn("_salt", _salt(salt))
    keys = spread.select(key, "_salt").distinct().join(classes, key)
    return spread.join(keys, [key, "_salt"]).drop("_salt")


def _joined_up(batches):
    """Every ``CHUNK`` links of a task as stars: each end but the least of its connected ones, with the least."""
    parent, held = {}, 0

    def find(k):
        while (p := parent.setdefault(k, k)) != k:
            parent[k] = k = parent[p]
        return k

    def stars():
        ends = [(k, r) for k in list(parent) if (r := find(k)) != k]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*ends, strict=True)] or [pa.array([], pa.int64())] * 2, ["u", "v"])

    for b in batches:
        for u, v in zip(values(b.column("u")), values(b.column("v")), strict=True):
            p, q = find(u), find(v)
            parent[max(p, q)] = min(p, q)
            held += 1
            if held == CHUNK:
                yield stars()
                parent.clear()
                held = 0
    yield stars()


def _chunks(n: int) -> int:
    """Tasks for ``n`` links."""
    return -(-n // CHUNK)


def components(edges: DataFrame) -> DataFrame:
    """``(fp, root)`` for every end of an edge: all connected ones share a root (large-star, small-star rounds).

    First every ``CHUNK`` links are joined up on the spot, each chunk by itself;
    the rounds then connect the chunks. A round's links are read and written in
    as many tasks as they fill chunks, not in one for every shuffle partition:
    each of these takes memory pages however few its rows.

    Each round is checkpointed in the shared folder; the driver sees one row
    count a round. Ends when a round changes nothing; the number of rounds
    grows with the logarithm of the longest path.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur, n = checkpoint_counted(both)
    if n:
        cur, n = checkpoint_counted(cur.coalesce(_chunks(n)).mapInArrow(_joined_up, "u long, v long"))
    while n:
        sym = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(sym, "u", "v", "m", "v").where("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        joined = with_least(large, "u", "v", "m", "v")
        small = joined.select("u", F.col("m").alias("v")).unionByName(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        nxt, n_next = checkpoint_counted(small.coalesce(_chunks(n)))
        same = n_next == n and nxt.join(cur, ["u", "v"], "left_anti").isEmpty()
        cur, n = nxt, n_next
        if same:
            break
    return cur.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(
        cur.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3,
                  blocks: int = 6, seed: int = 42) -> DataFrame:
    """Fingerprint and near-duplicate component of every row.

    Rows are linked if their fingerprints differ in at most ``radius`` bits.
    Returns one row per input row: ``doc_id, fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id that a row reaches over links.

    A null text counts as empty; texts without words have fingerprint 0 and link
    like any other. Null ids take part but name a component only if it has no
    other id (then null). Repeated rows all stay. An empty table gives an empty
    result; further columns are ignored. Equal fingerprints are one node, so
    copies cost no comparisons.
    """
    marked = stored(with_fingerprint(docs, id_col, text_col, shingle, seed), "simhash")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), radius, blocks))
    named = nodes.join(roots, "fp")
    moved = with_least(named, "root", "least", "best", "fp").select("fp", "best", F.lit(True).alias("linked"))
    classes = stored(nodes.join(moved, "fp", "left").select(
        "fp", F.when(F.col("linked"), F.col("best")).otherwise(F.col("least")).alias("component_id")), "simhash-classes")
    return spread_join(marked, classes, "fp", "doc_id").select(
        "doc_id", to_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3,
             blocks: int = 6, seed: int = 42) -> DataFrame:
    """Exactly one row of every near-duplicate component, with all columns.

    It is the row of the smallest id, null ids last; of rows that share the id,
    the one of the smallest text hash; of equal ones any. Rows are told apart by
    a number stored with them, so a table that was loaded twice leaves no copy.
    """
    rows = stored(docs.select(row_struct(docs).alias("_doc"),
                              F.monotonically_increasing_id().alias("_n")), "simhash-rows")
    marked = with_fingerprint(rows.select("_n", named(id_col, "_doc").alias("id"), named(text_col, "_doc").alias("text")),
                              "id", "text", shingle, seed, n=F.col("_n"), h=F.xxhash64(text_of()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "n")).alias("first")
    nodes = stored(marked.groupBy("fp").agg(first), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius, blocks))
    best = nodes.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return rows.join(best.select(F.col("first.n").alias("_n")), "_n", "left_semi").select("_doc.*")
