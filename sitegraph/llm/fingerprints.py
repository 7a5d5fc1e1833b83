"""Document fingerprints (SimHash) with the likeness of each text to an edited form and to its neighbour.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegraph.llm import simhash as S
from sitegraph.llm.common import only, shuffle_partitions, stored, text_of, words


def fingerprint(text: Column) -> Column:
    """64-bit SimHash of a text: word pairs weighted by how often they occur. Null counts as empty; empty: 0."""
    return S.fingerprint(words(F.coalesce(text, F.lit(""))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints, 0 to 1."""
    return F.lit(1.0) - S.distance(a, b) / F.lit(64.0)


def _bucket(key: Column, splitters: list[int]) -> Column:
    """Number of splitters that are <= key, by binary search in the constant array."""
    if not splitters:
        return F.lit(0)
    arr = F.array(*[F.lit(s) for s in splitters]).cast("array<long>")
    step, steps = 1, []
    while step <= len(splitters):
        steps.append(step)
        step *= 2
    return F.aggregate(F.array(*[F.lit(s) for s in reversed(steps)]), F.lit(0), lambda at, s: F.when(
        F.get(arr, at + s - 1) <= key, at + s).otherwise(at))


def dealt_by_id(docs: DataFrame, id_col: str, buckets: int) -> DataFrame:
    """Adds ``_b``, the id range of a row: about ``buckets`` ranges, in the order of the ids, by sampled splitters.

    An id that fills several ranges gets one of its own, cut into 64
    ranges of ``_h``. Null ids are dealt by ``_h`` to 64 numbers below 0.
    """
    top, parts = (1 << 63) - 1, 64
    probs = [k / buckets for k in range(1, buckets)]
    ids = docs.select(id_col).where(F.col(id_col).isNotNull())
    found = [min(int(i), top) for i in ids.approxQuantile(id_col, probs, 1 / (4 * buckets))]
    hot = [i for i, n in Counter(found).items() if n > 1]
    splitters = sorted({*found, *[min(i + 1, top) for i in hot]})
    part = F.shiftright("_h", 58).cast("int") + 32  # the six upper bits, in the order of _h
    return docs.withColumn("_b", F.when(F.col(id_col).isNotNull(), _bucket(F.col(id_col), splitters) * parts + F.when(
        F.col(id_col).isin(hot), part).otherwise(0)).otherwise(-1 - F.pmod(F.col("_h"), F.lit(parts)).cast("int")))


def with_next(docs: DataFrame, id_col: str, carry: list[str], buckets: int) -> DataFrame:
    """Adds ``next_<c>`` for every carried column: its value in the next row by descending id, cyclically.

    ``docs`` needs ``id_col`` (long) and ``_h`` (long, orders equal ids). The
    rows are dealt into id ranges, so no task holds more than a range; each
    range's successor row is sent along as a guest. The driver sees one small
    row per range. Null ids come last.
    """
    dealt = dealt_by_id(docs, id_col, buckets)
    order = F.struct(F.col(id_col).isNotNull(), F.col(id_col), F.col("_h"))
    firsts = dealt.groupBy("_b").agg(F.max(order).alias("m")).select(
        "_b", F.col("m")[id_col].alias("id"), F.col("m")["_h"].alias("h")).collect()  # one small row per bucket
    firsts.sort(key=lambda r: r._b)
    if not firsts:
        return dealt.select("*", *[F.col(c).alias(f"next_{c}") for c in carry]).drop("_b")
    host = {r._b: firsts[k + 1]._b if k + 1 < len(firsts) else firsts[0]._b for k, r in enumerate(firsts)}
    # a bucket's first row is the successor of the last row of the bucket above it
    guests = F.map_from_arrays(F.array(*[F.lit(b) for b in host]), F.array(*[F.lit(b) for b in host.values()]))
    head = F.array(*[F.struct(F.lit(r._b).alias("b"), F.lit(r.id).cast("long").alias("id"), F.lit(r.h).alias("h"))
                     for r in firsts])
    is_head = F.exists(head, lambda r: (r["b"] == F.col("_b")) & r["id"].eqNullSafe(F.col(id_col)) & (r["h"] == F.col("_h")))
    seats = F.array(F.struct(F.col("_b").alias("_seat"), F.lit(False).alias("_guest")))
    seated = dealt.select("*", F.inline(F.when(is_head, F.concat(seats, F.array(F.struct(
        F.element_at(guests, F.col("_b")).alias("_seat"), F.lit(True).alias("_guest"))))).otherwise(seats)))
    w = Window.partitionBy("_seat").orderBy("_guest", F.col(id_col).desc_nulls_last(), F.col("_h").desc())
    return seated.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry]).where(~F.col("_guest")).drop(
        "_b", "_seat", "_guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, blocks: int = 6,
                 query_every: int = 100, buckets: int | None = None) -> DataFrame:
    """Fingerprint of every text, of its edited form, and how near others lie.

    The edited text replaces the last ``floor(n_chars / 2)`` code points by the
    first as many (or all) of the next document by descending id; the smallest
    id's next is the largest. Returns one row per input row: ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``
    and ``n_near``: for ids divisible by ``query_every`` the number of rows,
    the row itself included, whose fingerprint the block tables find within
    ``radius`` bits; else null.

    Null texts count as empty (fingerprint 0). Null ids sort last, by the hash
    of their text. Rows with equal ids sort by that hash too; equal rows all
    stay. A single row is its own next. An empty table gives an empty result;
    further columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    base = only(docs, doc_id=F.col(id_col).cast("long"), t=text_of(text_col))
    base = base.select("doc_id", "t", F.xxhash64("t").alias("_h"), fingerprint(F.col("t")).alias("fp"))
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    joined = with_next(base, "doc_id", ["t", "fp"], buckets or min(4096, max(64, 4 * shuffle_partitions(spark))))
    edited = joined.select("doc_id", n.alias("n_chars"), "fp", "next_fp", F.concat(
        F.expr("substring(t, 1, length(t) - cast(floor(length(t) / 2) as int))"),
        F.substring("next_t", F.lit(1), half)).alias("e"))
    done = stored(edited.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"),
                                F.sha2(F.col("e"), 256).alias("edited_sha256"), "fp", "next_fp",
                                fingerprint(F.col("e")).alias("efp")), "fingerprints")
    wanted = done.where(F.col("doc_id") % query_every == 0).select("fp")
    sizes = done.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    near = S.search(wanted, done.select("fp"), radius, blocks).join(sizes, "fp").groupBy("query_fp").agg(
        F.sum("n").alias("n_near")).select(F.col("query_fp").alias("fp"), "n_near")
    return done.join(near, "fp", "left").select(
        "doc_id", "n_chars", "edited_sha256", S.to_hex(F.col("fp")).alias("fingerprint"),
        S.to_hex(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("doc_id") % query_every == 0, F.col("n_near")).alias("n_near"))
