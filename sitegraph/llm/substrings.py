"""Removing repeated passages: suffix automata of reference shards, and matching statistics against them.

A window of ``length`` words that occurs twice has the same least word gram both
times (its anchor), so only the surroundings of anchors that occur twice need to
be looked at. Surroundings that are equal as a whole settle themselves by their
count. One copy of each of the others is the reference: it is dealt to shards
by anchor, each shard becomes a suffix automaton whose states know the first
and last place they occur at, and the surroundings that hold the shard's
anchors are streamed through it. The longest suffix at each word that occurs
at another place, too, gives the maximal spans.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import only, scratch, shuffle_partitions, stored, text_of
from sitegraph.llm.simhash_dedup import spread_join

GRAM = 12  # words to an anchor
SHARD = 1000  # surroundings to a reference shard, about
FREQUENT = 256  # different surroundings of one anchor beyond which its windows are counted one by one
CHUNK = 1 << 23  # bytes of text looked at together
TABLE = 1_000_000  # word hashes kept per process
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd: they have an inverse modulo 2^64


class WordHashes(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > TABLE:
            self.clear()
        h = self[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hash of any run of values, by differences of running sums modulo 2^64."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values) + 1
        self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, pow(base, -1, 1 << 64), np.uint64)]))
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:-1], dtype=np.uint64)])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def least_right(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value of every run of ``width``, the last of equal ones."""
    def better(a, b):
        return np.where(h[b] <= h[a], b, a)

    best, have = np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        if len(best) <= step:
            return best[:0]
        best, have = better(best[:-step], best[step:]), have + step
    return best


def anchors(lengths: np.ndarray, v: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts given as word hashes one after the other: text, place in it, hash, hash of the surroundings.

    The surroundings are all words of windows that hold the anchor, and say
    where the anchor stands in them.
    """
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    if len(v) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    start = np.arange(len(v) - gram + 1)
    grams = Rolling(v, BASES[0]).runs(start, start + gram)
    best = least_right(grams, length - gram + 1)
    whole = np.arange(len(best)) + length <= ends[owner[:len(best)]]
    at = np.unique(best[whole])
    text = owner[at]
    a, b = (ends - lengths)[text], ends[text]
    lo, hi = np.maximum(a, at - (length - gram)), np.minimum(b, at + length)
    around = _mixed(Rolling(v, BASES[1]).runs(lo, hi) + (at - lo).astype(np.uint64) * np.uint64(BASES[0]))
    return text, at - a, grams[at], around


class Automaton:
    """Suffix automaton of several word sequences; a state knows the least and the greatest place its words end at."""

    def __init__(self):
        self.next, self.link, self.len, self.lo, self.hi = [{}], [-1], [0], [None], [None]

    def _state(self, length: int, link: int, nxt: dict) -> int:
        self.next.append(nxt), self.link.append(link), self.len.append(length), self.lo.append(None), self.hi.append(None)
        return len(self.len) - 1

    def _split(self, p: int, w, q: int) -> int:
        """The state of ``p``'s words and ``w`` alone, taken out of ``q``."""
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, seq: list, places: list[int]) -> None:
        """``places``: where the words end; a list per word is not needed, they follow the first."""
        last = 0
        for k, w in enumerate(seq):
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.len[q] == self.len[last] + 1 else self._split(last, w, q)
            else:
                cur, p = self._state(self.len[last] + 1, 0, {}), last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = cur
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][w]
                    self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
                last = cur
            for x in places:
                self._seen(last, x + k, x + k)

    def _seen(self, s: int, lo: int, hi: int) -> None:
        self.lo[s] = lo if self.lo[s] is None else min(self.lo[s], lo)
        self.hi[s] = hi if self.hi[s] is None else max(self.hi[s], hi)

    def close(self) -> None:
        """Hand the places down to shorter suffixes, and to each state the longest suffix that has two places."""
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        for s in reversed(order):
            if self.link[s] > 0:
                self._seen(self.link[s], self.lo[s], self.hi[s])
        self.twice = [0] * len(self.len)
        for s in order:
            self.twice[s] = self.len[s] if self.lo[s] != self.hi[s] else self.twice[self.link[s]]

    def statistics(self, seq: list):
        """Per word the length of the longest run ending there that occurs at two places of the reference."""
        s, have = 0, 0
        for w in seq:
            while s and w not in self.next[s]:
                s = self.link[s]
                have = self.len[s]
            if w in self.next[s]:
                s, have = self.next[s][w], have + 1
            yield min(have, self.twice[s]) if self.lo[s] == self.hi[s] else have


def repeated_spans(pieces: list[tuple], length: int) -> list[tuple]:
    """Maximal spans ``(text, start, end)`` covered by windows that occur at another place of the shard.

    A piece is ``(text, start, words, copied)``: its words, the first at
    ``start`` of its text; ``copied``: it stands for several places.
    """
    number, machine = {}, Automaton()
    for text, start, seq, copied in pieces:
        at = (number.setdefault(text, len(number)) << 32) + start
        machine.add(seq, [at, -1 - (1 << 62) + at] if copied else [at])
    machine.close()
    out = []
    for text, start, seq, copied in pieces:
        lo = hi = None
        for k, n in enumerate(machine.statistics(seq) if not copied else ()):
            if n >= length:
                a, b = start + k + 1 - n, start + k + 1
                if hi is None or a > hi:
                    if hi is not None:
                        out.append((text, lo, hi))
                    lo = a
                lo, hi = min(lo, a), b
        if hi is not None:
            out.append((text, lo, hi))
    return out


def _chunks(batches, *cols: str):
    """Rows of Arrow batches as lists of about ``CHUNK`` bytes of ``text``, the first column."""
    held, size = [], 0
    for b in batches:
        text = b.column("text").cast(pa.binary())
        for k in range(b.num_rows):
            t = text[k].as_py()
            held.append((t, *(b.column(c)[k].as_py() for c in cols)))
            size += len(t)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


SPANS = "tid binary, start long, end long"


def substring_dedup(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text",
                    finish: Callable[[Column], Column] = lambda kept: kept, gram: int | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Every row's text without the words of windows that start at another place, too.

    Words are runs of ``[^\\x20\\x09-\\x0D]``, a window ``length`` consecutive
    ones of a text; a window also found elsewhere, in the same or another row,
    loses all its words at all its places. Windows are judged on the input.
    Returns ``id_col, n_words, n_removed, spans`` (what was removed, as word
    ranges) and ``kept`` (the other words joined by one space, through
    ``finish``). A null or empty text, or one shorter than a window, keeps all
    it has; rows of equal text, or of equal ids, are rows of their own, so
    copies lose all their windows. Further columns are ignored; an empty table
    gives an empty result.

    Texts are moved once, to a table of distinct texts bucketed by their digest
    that later joins read in place. The automaton of a shard is sent to the
    surroundings of its own anchors only: every document against every shard
    would be quadratic in a corpus that is its own reference. An anchor
    with more than ``frequent`` different surroundings has its windows counted
    by their digests instead, so no shard grows with a frequent passage.
    """
    spark = docs.sparkSession
    gram = min(gram or GRAM, length)
    t = text_of(text_col)
    ids = only(docs, id=id_col, t=t).select("id", "t", F.unhex(F.substring(F.sha2("t", 256), 1, 32)).alias("tid"))
    n, name = shuffle_partitions(spark), f"llm_texts_{uuid.uuid4().hex}"
    ids.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.first("t").alias("text")).write.option("compression", "zstd").option(
        "path", scratch(spark, "texts")).bucketBy(n, "tid").sortBy("tid").saveAsTable(name)
    texts = spark.table(name)

    def find(batches):
        schema = pa.schema([("tid", pa.binary()), ("copies", pa.int64()), ("n_words", pa.int64()), ("at", pa.list_(pa.int64())),
                            ("anchor", pa.list_(pa.int64())), ("around", pa.list_(pa.int64()))])
        table = WordHashes()
        for rows in _chunks(batches, "tid", "copies"):
            words = [r[0].split() for r in rows]
            lengths = np.array([len(w) for w in words])
            v = np.fromiter((table[w] for ws in words for w in ws), np.uint64, int(lengths.sum()))
            owner, at, anchor, around = anchors(lengths, v, length, gram)
            offsets = pa.array(np.searchsorted(owner, np.arange(len(rows) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64, copy=False).view(np.int64))) for x in (at, anchor.view(np.int64), around.view(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()),
                                              pa.array(lengths, pa.int64()), *lists], schema=schema)

    found = stored(texts.select("text", "tid", "copies").mapInArrow(
        find, "tid binary, copies long, n_words long, at array<long>, anchor array<long>, around array<long>"), "anchors")
    each = found.select("tid", "copies", "n_words", F.explode(F.arrays_zip("at", "anchor", "around")).alias("x")).select(
        "tid", "copies", "n_words", "x.at", "x.anchor", "x.around")
    again = stored(each.groupBy("anchor").agg(F.sum("copies").alias("_n")).where(F.col("_n") > 1).select("anchor"), "anchors-again")
    each = stored(each.join(again, "anchor"), "anchors-met")
    kinds = stored(each.groupBy("anchor", "around").agg(
        F.sum("copies").alias("n"), F.min(F.struct("tid", "at")).alias("one")), "surroundings")
    pair = F.struct("anchor", "around").alias("pair")
    whole = stored(kinds.where(F.col("n") > 1).select(pair), "surroundings-copied")
    reach = F.lit(length - gram)
    spans = [spread_join(each.select(pair, "tid", "at", "n_words"), whole, "pair", "tid").select(
        "tid", F.greatest(F.col("at") - reach, F.lit(0)).alias("start"), F.least(F.col("at") + length, "n_words").alias("end"))]

    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1)
    open_ = stored(spread_join(kinds, several, "anchor", "around").select(
        "one.tid", "one.at", "anchor", (F.col("n") > 1).alias("copied"), (F.col("kinds") > frequent).alias("hot")), "surroundings-open")
    wanted = stored(open_.groupBy("tid").agg(F.collect_list(F.struct("at", "anchor", "copied", "hot")).alias("want")), "wanted")

    def cut(batches):
        schema = pa.schema([("hot", pa.bool_()), ("anchor", pa.int64()), ("tid", pa.binary()), ("start", pa.int64()), ("words", pa.binary()),
                            ("copied", pa.bool_())])
        for rows in _chunks(batches, "tid", "want"):
            out = []
            for text, tid, want in rows:
                ws = text.split()
                for x in want:
                    lo, hi = max(0, x["at"] - (length - gram)), min(len(ws), x["at"] + length)
                    if x["hot"]:
                        out += [(True, None, tid, k, hashlib.blake2b(b" ".join(ws[k:k + length]), digest_size=16).digest(), x["copied"])
                                for k in range(lo, hi - length + 1)]
                    else:
                        out.append((False, x["anchor"], tid, lo, b" ".join(ws[lo:hi]), x["copied"]))
                    if len(out) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    pieces = stored(texts.join(wanted, "tid").select("text", "tid", "want").mapInArrow(
        cut, "hot boolean, anchor long, tid binary, start long, words binary, copied boolean"), "pieces")
    reference = pieces.where(~F.col("hot"))
    n_shards = max(1, -(-reference.count() // SHARD))

    def match(batches):
        schema = pa.schema([("tid", pa.binary()), ("start", pa.int64()), ("end", pa.int64())])

        def done(held):
            spans = repeated_spans(held, length)
            return pa.RecordBatch.from_arrays([pa.array([s[k] for s in spans], f.type) for k, f in enumerate(schema)], schema=schema)

        now, held = None, []
        for b in batches:
            for shard, tid, start, words, copied in zip(*(b.column(c).to_pylist() for c in ("shard", "tid", "start", "words", "copied")), strict=True):
                if shard != now and held:
                    yield done(held)
                    held = []
                now = shard
                held.append((tid, start, words.split(), copied))
        if held:
            yield done(held)

    dealt = reference.select(F.pmod(F.xxhash64("anchor"), F.lit(n_shards)).alias("shard"), "tid", "start", "words", "copied")
    spans.append(dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(match, SPANS))
    windows = pieces.where(F.col("hot")).groupBy("words", "tid", "start").agg(F.max("copied").alias("copied"))
    windows = stored(windows, "windows")
    often = stored(windows.groupBy("words").agg(F.sum(F.when(F.col("copied"), 2).otherwise(1)).alias("_n")).where(F.col("_n") > 1).select("words"), "windows-again")
    spans.append(spread_join(windows, often, "words", "tid").select("tid", "start", (F.col("start") + length).alias("end")))
    long_enough = reduce(DataFrame.unionByName, spans).where(F.col("end") - F.col("start") >= length)
    gone = stored(long_enough.distinct().groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")

    def strip(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        schema = pa.schema([("tid", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.string())])
        for rows in _chunks(batches, "tid", "spans"):
            out = []
            for text, tid, spans in rows:
                ws, merged, kept, at = text.split(), [], [], 0
                for s in sorted((s["start"], s["end"]) for s in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                for a, b in merged:
                    kept += ws[at:a]
                    at = b
                kept += ws[at:]
                out.append((tid, len(ws), len(ws) - len(kept), [dict(start=a, end=b) for a, b in merged], b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    shape = "tid binary, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"
    clean = stored(texts.join(gone, "tid", "left").select("text", "tid", "spans").mapInArrow(strip, shape).withColumn(
        "kept", finish(F.col("kept"))), "clean")
    spark.sql(f"drop table {name}")
    return spread_join(ids.select("id", "tid"), clean, "tid", "id").select(F.col("id").alias(id_col), "n_words", "n_removed", "spans", "kept")
