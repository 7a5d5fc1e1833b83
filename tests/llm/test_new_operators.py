"""Merkle manifest, substring dedup and conversation trie against brute-force versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sitegraph.llm import conversation_trie, merkle, substrings
from sitegraph.llm.common import LOWER, UPPER


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=repr)


# ------------------------------------------------------------------ Merkle manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, id long, leaf string"


def plain_manifest(rows):
    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k:k + 16])) for k in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            a = i & ~15
            yield i - a, level[a:a + 16]
            i >>= 4

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in order}
    crown = tree([trees[s][-1][0] for s in order])
    for g, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            steps = [*path(trees[s], i), *path(crown, g)]
            now = leaf(r)
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                now = leaf((*r[:4], r[4].translate(str.maketrans(UPPER, LOWER))))
            proof = sha("".join(x for k, run in steps for j, x in enumerate(run) if j != k))
            for k, run in steps:
                now = sha("".join([*run[:k], now, *run[k + 1:]]))
            yield (r[0], leaf(r), trees[s][-1][0], crown[-1][0], proof, now, now == crown[-1][0])


def manifest_of(spark, rows):
    df = spark.createDataFrame([(*r, "t", -1, -2, "l") for r in rows], DOCS).repartition(5)
    return [tuple(r) for r in merkle.manifest(df, tampered={"text": F.translate("text", UPPER, LOWER)},
                                              tamper_where=F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()]


def test_manifest(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([i, i, i, -i, None if i % 50 == 0 else i * 10**12, 7]), rnd.choice(["big"] * 6 + [None, "", "z", "é", f"s{i % 300}"]),
             rnd.choice([None, "en"]), rnd.choice([None, i % 3]), rnd.choice([None, "", "Abc", "Zé" * 3, "same", "Long " * 9000 if i % 900 == 0 else "x"]))
            for i in range(9000)]  # more than 16^3 leaves in one source, repeated and null ids, negative and huge ones
    assert in_order(manifest_of(spark, rows)) == in_order(plain_manifest(rows))


def test_manifest_small_tables(spark):
    assert manifest_of(spark, []) == []
    for rows in ([(1, "a", None, 3, "Abc")], [(5, None, "de", None, None)] * 5000, [(i, f"s{i}", "en", 1, "T") for i in range(300)]):
        assert in_order(manifest_of(spark, rows)) == in_order(plain_manifest(rows))


def test_running_total_spreads_one_group(spark):
    df = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") % 7000).alias("o"), "id", (F.col("id") % 5).alias("v"))
    got = merkle.running_total(df, ["g"], ["o", "id"], {"before": "v"})
    want, total = {}, 0
    for o, i in sorted((i % 7000, i) for i in range(20_000)):
        want[i] = total
        total += i % 5
    assert {r.id: r.before for r in got.collect()} == want


# ------------------------------------------------------------------ substring dedup

def plain_substrings(rows, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[s:s + length]) for w in words for s in range(len(w) - length + 1))
    for (i, _), w in zip(rows, words, strict=True):
        gone = {s + k for s in range(len(w) - length + 1) if seen[tuple(w[s:s + length])] > 1 for k in range(length)}
        yield i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


def passages():
    rnd = random.Random(4)
    shared = [[f"p{k}w{j}" for j in range(60)] for k in range(6)]
    rows = []
    for i in range(300):
        ws = [f"v{rnd.randint(0, 400)}" for _ in range(rnd.choice([0, 3, 20, 34, 35, 36, 100, 200]))]
        if rnd.random() < .5:
            p, a, at = rnd.choice(shared), rnd.randint(0, 30), rnd.randint(0, len(ws))
            ws[at:at] = p[a:a + rnd.randint(10, 60)]
        if rnd.random() < .1:
            ws += ["spam"] * rnd.randint(1, 120)
        if rnd.random() < .05:
            ws += ["x", "y", "z"] * rnd.randint(1, 40)
        rows.append((i, rnd.choice([" ", "\n", "\t ", "\x0b"]).join(ws)))
    for i in range(30):
        text = rows[rnd.randrange(300)][1]
        ws = text.split(" ")
        ws[rnd.randrange(len(ws))] = "changed"
        rows += [(1000 + i, text), (2000 + i, " ".join(ws))]
    return [*rows, (None, rows[0][1]), (7, None), (7, ""), (None, None), (5, "  é  x\x1cy" * 50), (6, " ".join(f"u{k}" for k in range(30_000)))]


@pytest.mark.parametrize("kw", [{}, {"frequent": 2}, {"length": 20, "gram": 5, "frequent": 0}], ids=str)
def test_substring_dedup(spark, kw):
    rows = passages()
    df = spark.createDataFrame([(*r, "t", b"x", 1) for r in rows], "doc_id long, text string, t string, tid binary, start long").repartition(4)
    got = substrings.substring_dedup(df, **kw).collect()
    assert in_order((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == in_order(plain_substrings(rows, kw.get("length", 35)))
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_substring_dedup_small_tables(spark):
    for rows in ([], [(1, "a " * 40)], [(1, None)]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert in_order((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.substring_dedup(df).collect()) == in_order(plain_substrings(rows, 35))
    assert spark.catalog.listTables() == [] or all(not t.name.startswith("llm_texts") for t in spark.catalog.listTables())


def test_matching_statistics():
    rnd = random.Random(6)
    seqs = [[rnd.choice("ab") for _ in range(rnd.randint(1, 25))] for _ in range(8)]
    m = substrings.Automaton()
    for k, s in enumerate(seqs):
        m.add(s, [k << 32])
    m.close()
    places = collections.defaultdict(set)
    for k, s in enumerate(seqs):
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                places["".join(s[a:b])].add((k, b))
    for _ in range(50):
        q = [rnd.choice("abc") for _ in range(20)]
        want = [max([n for n in range(1, e + 1) if len(places.get("".join(q[e - n:e]), ())) > 1], default=0) for e in range(1, 21)]
        assert list(m.statistics(q)) == want


# ------------------------------------------------------------------ conversation trie

def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0), sha(f"{len(role.encode())}:{role}{text}")[:32], (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    full, nodes, children = {}, collections.defaultdict(list), collections.defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(full[c]) + 1):
            nodes[tuple(full[c][:d])].append(c)
    leaves, saved = collections.Counter(), collections.Counter()
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] += k not in children
        if k:
            saved[k] += (len(nodes[k]) - 1) * len(k[-1][1])
            children[k[:-1]].append(k)
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    for k, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if len(full[c]) == len(k))
        yield (min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(children.get(k, [])), leaves[k], saved[k], sha(ends))


def conversations():
    rnd = random.Random(3)
    rows = []
    for c in range(500):
        n = rnd.choice([0, 1, 2, 3, 5, 9, 9, 30])
        if c % 7 == 0:  # copies that end at the end of a block of 8 turns
            seq = [(i, "user", f"common {i}") for i in range(24)]
        elif c % 5 == 0:
            seq = [(i, "user", "hot" if i < 3 else rnd.choice("ab")) for i in range(n)]
        else:
            seq = [(rnd.choice([None, i, i, i]), rnd.choice([None, "user", "é"]), rnd.choice([None, "", "x", "long é" * 5])) for i in range(n)]
        rows += [(c, *s) for s in seq]
    return [*rows, *rows[:3], (None, 1, "a", "b"), (-5, 0, "user", "neg"), (10**15, 0, "user", "big")]


def trie_of(spark, rows, block):
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, place long").repartition(4)
    return [tuple(r) for r in conversation_trie.conversation_trie(df, block=block).collect()]


@pytest.mark.parametrize("block", [8, 64])
def test_conversation_trie(spark, block):
    rows = conversations()
    assert in_order(trie_of(spark, rows, block)) == in_order(plain_trie(rows))


def test_conversation_trie_small_tables(spark):
    for rows in ([], [(3, None, None, None)], [(c, 0, "user", "same") for c in range(40)], [(1, t, "u", f"t{t % 3}") for t in range(200)]):
        assert in_order(trie_of(spark, rows, 8)) == in_order(plain_trie(rows))


def test_every_shard_boundary(spark):
    """Shards of about 100 turns: far more splitters than partitions by default."""
    rows, turns = conversations(), conversation_trie.SHARD_TURNS
    conversation_trie.SHARD_TURNS = 100
    try:
        assert in_order(trie_of(spark, rows, 8)) == in_order(plain_trie(rows))
    finally:
        conversation_trie.SHARD_TURNS = turns
