"""Merkle manifest of a dataset: a tree per group of rows, a tree over the groups, and a proof per row.

A leaf's place in its group is its id's rank. No group is sorted for it: the ids
of a group are merged into a bitmap (64 ids a word, only words that occur are
kept), a directory holds the number of rows before each word, and a rank is that
number plus the bits below the id's own. The places then key arrays of 16^3
slots, in which a task reduces three levels of the tree at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegraph.llm.common import only, shuffle_partitions, stored
from sitegraph.operators.frontier import rank_within

FANOUT_BITS = 4  # 16 nodes become one
LEVELS = 3  # of the tree, reduced in one slot array
SLOT_BITS = FANOUT_BITS * LEVELS
WORD_BITS = 6  # 64 ids to a word of the bitmap
STEPS = (10, 16, 16)  # bits of a word's number that each level of the directory takes off; 16 remain
NO_ID = -(1 << 57) - 1  # the word of rows without an id: below every word of a 64-bit id
REPEATS = 12  # bits: rows that are equal in everything are unfolded in runs of this size
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: every field is ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    def part(c):
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(c) for c in fields]), 256))


def group_key(c: Column) -> Column:
    """The group as a string that is never null and orders null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("1"), c.cast("string")), F.lit("0"))


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], totals: dict[str, str]) -> DataFrame:
    """``df`` plus, per entry ``name: column``, the sum of the column over the rows of its group before it in ``order``.

    Rows are dealt to key ranges, so a group that holds most rows is spread; the
    ranges are written once and both sums, within and before a range, read them.
    The columns of ``by`` must not be null.
    """
    keys = [*by, *order]
    local = stored(df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).withColumn(
        "_range", F.spark_partition_id()), "running-total")
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)

    def summed(c, w):
        return F.coalesce(F.sum(c).over(w), F.lit(0))

    sums = local.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()]).select(
        *by, "_range", *[summed(f"_sum_{n}", across).alias(f"_before_{n}") for n in totals])
    met = local.select("*", *[summed(c, inside).alias(f"_inside_{n}") for n, c in totals.items()]).join(sums, [*by, "_range"])
    return met.select(*df.columns, *[(F.col(f"_before_{n}") + F.col(f"_inside_{n}")).alias(n) for n in totals])


def bitmap(rows: DataFrame) -> DataFrame:
    """Bitmap and rank directory of every tree's ids: ``tree, word, bits, n, before, size``.

    ``n`` rows have an id in the word, ``before`` rows of the tree an id in a
    lower one, ``size`` rows belong to the tree. Words are merged with map-side
    combination. The directory has a level for every ``STEPS`` bits, so a window
    never holds more than 2^16 + 1 entries however large a tree is.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").bitwiseAND(63).cast("int"))
    words = stored(rows.groupBy("tree", F.coalesce(F.shiftright("id", WORD_BITS), F.lit(NO_ID)).alias("word")).agg(
        F.bit_or(F.coalesce(bit, F.lit(0).cast("long"))).alias("bits"), F.count(F.lit(1)).alias("n")), "merkle-words")
    levels = [words.select("tree", F.col("word").alias("k"), "n")]
    for step in STEPS:
        levels.append(levels[-1].groupBy("tree", F.shiftright("k", step).alias("k")).agg(F.sum("n").alias("n")))
    run = Window.partitionBy("tree").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    upper = levels[-1].select("tree", "k", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"),
                              F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    for step, entries in zip(reversed(STEPS), reversed(levels[:-1]), strict=True):
        run = Window.partitionBy("tree", "up").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        inside = entries.withColumn("up", F.shiftright("k", step)).withColumn("inside", F.coalesce(F.sum("n").over(run), F.lit(0)))
        upper = inside.join(upper.withColumnRenamed("k", "up"), ["tree", "up"]).select(
            "tree", "k", (F.col("before") + F.col("inside")).alias("before"), "size")
    return words.join(upper.withColumnRenamed("k", "word"), ["tree", "word"])


def coordinates(rows: DataFrame) -> DataFrame:
    """``rows(tree, id, leaf, other)`` with ``pos``, the place in the tree from 0 by (id, leaf), null ids first, and ``size``.

    A word whose rows all differ in id answers by its bits. Where ids repeat,
    equal rows are counted and the counts summed along (id, leaf); such rows
    get their places in turn.
    """
    words = stored(bitmap(rows), "merkle-bitmap")
    alone = F.bit_count("bits") == F.col("n")
    found = rows.withColumn("word", F.coalesce(F.shiftright("id", WORD_BITS), F.lit(NO_ID))).join(words, ["tree", "word"])
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("id").bitwiseAND(63).cast("int")))
    out = found.where(alone).select("tree", "size", (F.col("before") + F.bit_count(F.col("bits").bitwiseAND(below))).alias("pos"),
                                    "id", "leaf", "other")
    if words.where(~alone).isEmpty():
        return out
    counted = found.where(~alone).groupBy("tree", "word", "before", "size", "id", "leaf", "other").agg(F.count(F.lit(1)).alias("m"))
    placed = running_total(counted, ["tree", "word"], ["id", "leaf"], {"earlier": "m"})
    runs = placed.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("m") - 1, REPEATS))))
    first = F.shiftleft("r", REPEATS)
    each = runs.withColumn("k", F.explode(F.sequence(first, F.least(F.col("m"), first + (1 << REPEATS)) - 1)))
    return out.unionByName(each.select("tree", "size", (F.col("before") + F.col("earlier") + F.col("k")).alias("pos"), "id", "leaf", "other"))


# ------------------------------------------------------------------ slot arrays

def _slots(nodes: DataFrame, name: str, *carry: str) -> DataFrame:
    """``nodes(tree, size, pos, leaf, *carry)`` as arrays of at most 16^3 slots, stored."""
    slot = F.struct(F.col("pos").bitwiseAND((1 << SLOT_BITS) - 1).cast("int").alias("slot"), "leaf", *carry)
    return stored(nodes.groupBy("tree", F.shiftright("pos", SLOT_BITS).alias("g")).agg(
        F.first("size").alias("size"), F.collect_list(slot).alias("slots")), name)


def _hash(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


def _each(batches):
    """Rows of Arrow batches, one at a time: a row may hold 16^3 slots."""
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _by_slot(row: dict, *names: str) -> list[list]:
    """Values of each field, in slot order."""
    out = []
    for name in names:
        values = [None] * len(row["slots"])
        for s in row["slots"]:
            values[s["slot"]] = s[name]
        out.append(values)
    return out


def _runs(digests: list[bytes], size: int) -> tuple[list[list[bytes]], bytes]:
    """Per level the runs of at most 16 hex digests, each joined; and the node that remains."""
    level, out = [d.hex().encode() for d in digests], []
    while size > 1 and len(out) < LEVELS:
        out.append([b"".join(level[k:k + 16]) for k in range(0, len(level), 16)])
        level = [_hash(r) for r in out[-1]]
        size = -(-size >> FANOUT_BITS)
    return out, level[0]


def _above(runs: list[list[bytes]], slot: int) -> list[tuple[int, bytes]]:
    """A slot's place and run at every level."""
    return [(slot >> FANOUT_BITS * k & 15, r[slot >> FANOUT_BITS * (k + 1)]) for k, r in enumerate(runs)]


def _arrow(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _reduced(groups: DataFrame) -> DataFrame:
    """The node that each slot array becomes: ``tree, pos, size, leaf``."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("leaf", pa.binary())])

    def run(batches):
        for row in _each(batches):
            _, top = _runs(_by_slot(row, "leaf")[0], row["size"])
            yield _arrow(schema, [(row["tree"], row["g"], -(-row["size"] >> SLOT_BITS), bytes.fromhex(top.decode()))])

    return groups.mapInArrow(run, "tree string, pos long, size long, leaf binary")


PATH = "array<struct<slot:int,run:binary>>"  # a node's place in its run and the run's hex digests, from below to the root


def _paths(groups: DataFrame, above: DataFrame) -> DataFrame:
    """Path of every node in the slot arrays: ``tree, pos, path, top``, given those of the nodes they became."""
    step = pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.binary())]))
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", step), ("top", pa.binary()), ("leaf", pa.binary())])

    def run(batches):
        for row in _each(batches):
            digests = _by_slot(row, "leaf")[0]
            runs, _ = _runs(digests, row["size"])
            yield _arrow(schema, [(row["tree"], (row["g"] << SLOT_BITS) + s, [*(dict(slot=k, run=r) for k, r in _above(runs, s)),
                                                                              *row["path"]], row["top"], d)
                                  for s, d in enumerate(digests)])

    met = groups.join(above.withColumnRenamed("pos", "g"), ["tree", "g"])
    return met.select("tree", "g", "size", F.col("slots"), "path", "top").mapInArrow(
        run, f"tree string, pos long, path {PATH}, top binary, leaf binary")


def _proofs(groups: DataFrame, above: DataFrame, root: bytes) -> DataFrame:
    """Proof of every leaf, and the root that its ``other`` digest (else its own) folds to along the path."""
    names = ["id", "leaf", "subroot", "proof", "folded"]
    schema = pa.schema([("id", pa.int64()), *((n, pa.string()) for n in names[1:])])

    def run(batches):
        for row in _each(batches):
            ids, digests, others = _by_slot(row, "id", "leaf", "other")
            runs, _ = _runs(digests, row["size"])
            upper = [(p["slot"], p["run"]) for p in row["path"]]
            tail = b"".join(r[:64 * k] + r[64 * k + 64:] for k, r in upper)
            out = []
            for s, d in enumerate(digests):
                here, proof = _above(runs, s), hashlib.sha256()
                now = (others[s] or d).hex().encode()
                for k, r in here:
                    before, after = r[:64 * k], r[64 * k + 64:]
                    proof.update(before + after)
                    now = _hash(before + now + after)
                for k, r in upper:
                    now = _hash(r[:64 * k] + now + r[64 * k + 64:])
                proof.update(tail)
                out.append((ids[s], d.hex(), row["top"].hex(), proof.hexdigest(), now.decode()))
            yield _arrow(schema, out)

    met = groups.join(above.select("tree", F.col("pos").alias("g"), "path", "top"), ["tree", "g"])
    rows = met.select("g", "size", "slots", "path", "top").mapInArrow(run, "id long, leaf string, subroot string, proof string, folded string")
    whole = F.lit(root.hex())
    return rows.select("id", "leaf", "subroot", whole.alias("root"), "proof", "folded", (F.col("folded") == whole).alias("verified"))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source",
             tampered: dict[str, Column] | None = None, tamper_where: Column | None = None) -> DataFrame:
    """One row per input row: ``id, leaf, subroot, root, proof, folded, verified``, digests as hex text.

    Leaves of a group ascend by id; while several nodes remain, every 16
    consecutive ones become their digest; a lone leaf is its group's subroot.
    Subroots, by group (null first, bytewise), give the root in the same way.
    ``proof`` is the digest of the siblings on the way up, left to right;
    ``folded`` the root recomputed from those and the row's leaf, which for
    rows of ``tamper_where`` is made with the ``tampered`` columns instead.

    Null fields, ids and groups have their own marks: a null id comes first in
    its group and is never tampered with, rows without a group are a group.
    Rows that repeat an id are ordered by leaf; equal rows take consecutive
    places and so get proofs of their own. Empty and very long texts are
    hashed whole. Further columns are ignored; an empty table gives no row.

    Every row is hashed once and its 32 bytes are moved twice, to its word of
    the bitmap and to its slot array; the upper levels have a 4096th as many
    nodes. The driver sees the root, the largest group's size and the number
    of groups.
    """
    spark = docs.sparkSession
    cols = {f: F.col(f) for f in fields}
    other = leaf([(tampered or {}).get(f, c) for f, c in cols.items()])
    rows = stored(only(docs, tree=group_key(F.col(group_col)), id=F.col(id_col).cast("long"), leaf=leaf(list(cols.values())),
                       other=F.when(tamper_where, other) if tamper_where is not None else F.lit(None).cast("binary")), "merkle-rows")

    def climb(nodes: DataFrame, name: str, *carry: str) -> tuple[list[DataFrame], DataFrame]:
        """Slot arrays from below, and the trees' tops."""
        levels = [_slots(nodes, name, *carry)]
        size = levels[0].agg(F.max("size")).first()[0] or 0
        nodes = _reduced(levels[0])
        while (size := -(-size >> SLOT_BITS)) > 1:
            levels.append(_slots(nodes, name))
            nodes = _reduced(levels[-1])
        return levels, nodes

    leaves, tops = climb(coordinates(rows), "merkle-slots", "id", "other")
    tops = stored(tops.select(F.col("tree").alias("group"), "leaf"), "merkle-tops")
    ranked = rank_within(tops.withColumn("tree", F.lit("")), ["group"], "tree")
    crowns, top = climb(ranked.select("tree", F.lit(tops.count()).cast("long").alias("size"), (F.col("rank") - 1).alias("pos"), "leaf",
                                      "group"), "merkle-crown", "group")
    found = top.select("leaf").collect()  # one row, none for an empty table
    root = bytes(found[0][0]) if found else b""
    paths = spark.createDataFrame([("", 0, [], None)], f"tree string, pos long, path {PATH}, top binary")
    for groups in reversed(crowns):
        paths = stored(_paths(groups, paths.drop("leaf")), "merkle-paths")
    names = ranked.select("group", (F.col("rank") - 1).alias("pos"))
    paths = paths.drop("tree", "top").join(names, "pos").select(
        F.col("group").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("leaf").alias("top"))
    for groups in reversed(leaves[1:]):
        paths = stored(_paths(groups, paths.drop("leaf")), "merkle-paths")
    return _proofs(leaves[0], paths, root)
