"""SimHash fingerprints and exact search within a Hamming radius, all as column expressions.

A text's terms are hashed to 64 bits; every occurrence of a term casts one vote
per bit (its frequency is its weight), for a set bit +1 and else -1; a
fingerprint bit is 1 where the sum is positive.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import let

LANES = 0x0101010101010101  # eight counters of eight bits in a long
CHUNK = 127  # votes that fit one counter without touching the sign bit


def term_hashes(words: Column) -> Column:
    """One 64-bit hash per word and its successor (the last word stands alone)."""
    return let(F.transform(words, lambda w: F.xxhash64(w)),
               lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1))))


def vote(hashes: Column) -> Column:
    """The 64-bit fingerprint of an array of term hashes (empty: 0, an even vote: bit 0).

    Bits ``j, 8+j, ..., 56+j`` of a hash, shifted by ``j`` and masked, are eight
    counters in one long, so eight sums over at most 127 hashes count all 64
    bits; the counters are then unpacked and added over the chunks.
    """
    def lanes(part):
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.aggregate(
            part, F.lit(0).cast("long"),
            lambda acc, h: acc + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(LANES))))

    def bits(h, counts):
        def count(b):
            return F.aggregate(counts, F.lit(0).cast("long"), lambda acc, c: acc + F.call_function(
                "shiftrightunsigned", F.get(c, F.pmod(b, F.lit(8))), (b - F.pmod(b, F.lit(8)))).bitwiseAND(F.lit(255)))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(
            F.when(count(b) * 2 > F.size(h), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(
                F.lit(0).cast("long"))))

    def chunks(h):
        starts = F.sequence(F.lit(1), F.greatest(F.size(h), F.lit(1)), F.lit(CHUNK))
        return F.transform(starts, lambda at: let(F.slice(h, at, F.lit(CHUNK)), lanes))

    return let(hashes, lambda h: let(chunks(h), lambda c: bits(h, c)))


def fingerprint(words: Column) -> Column:
    return vote(term_hashes(words))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def to_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def block_masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of the block tables: fingerprints within ``radius`` agree on at least one mask.

    The 64 bits fall into ``blocks`` blocks; ``radius`` differing bits spoil at
    most ``radius`` of them, so some ``blocks - radius`` blocks agree whole. Each
    such choice of blocks, moved to the front, is one permuted table's key.
    """
    if not 0 <= radius < blocks <= 64:
        raise ValueError("0 <= radius < blocks <= 64 is needed")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(m) for m in combinations(part, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]  # as signed longs


def block_keys(fp: Column, masks: list[int]) -> Column:
    """Array of ``(table, key)``: where the fingerprint stands in each block table."""
    return F.array(*[F.struct(F.lit(t).alias("tab"), fp.bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])


def search(queries: DataFrame, corpus: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All fingerprints of ``corpus`` within ``radius`` bits of each fingerprint of ``queries``.

    Both sides have one long column ``fp`` (further columns are ignored, nulls
    match nothing, repeats count once). Returns distinct ``(query_fp, fp,
    bits)``. Both sides are made distinct before they meet, so copies cost
    nothing; the block tables are joined on (table, key) and every candidate's
    distance is checked. No candidate is capped.
    """
    masks = block_masks(radius, blocks)

    def tables(df, name):
        fps = df.select(F.col("fp").cast("long").alias(name)).where(F.col(name).isNotNull()).distinct()
        return fps.select(name, F.inline(block_keys(F.col(name), masks)))

    both = tables(queries, "query_fp").join(tables(corpus, "fp"), ["tab", "key"])
    d = distance(F.col("query_fp"), F.col("fp"))
    # a pair that agrees on several tables is reported by the first of them only
    first = F.get(F.filter(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m, t: F.when(
        F.col("query_fp").bitwiseXOR(F.col("fp")).bitwiseAND(m) == 0, t)), lambda t: t.isNotNull()), F.lit(0))
    return both.where(d <= radius).where(first == F.col("tab")).select("query_fp", "fp", d.alias("bits"))
