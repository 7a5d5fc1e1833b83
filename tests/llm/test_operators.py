"""Edge cases and brute-force comparisons of the llm operators.

The fixture holds null and empty texts, a null id, ties, copies, a long text
and columns whose names the operators use inside.
"""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sitegraph.llm import bpe, exact_dedup, fingerprints, licenses, line_dedup, mixing, quality, sharding, simhash_dedup
from sitegraph.llm import simhash, token_files, tokens
from sitegraph.llm.common import stored, text_of, values

WS = " \t\n\x0b\x0c\r"
COMMON = "Shared line of many pages"


def _texts():
    rnd = random.Random(5)
    vocab = ["der", "Haus", "naïve", "été", "don't", "x1", "日本", "<|endoftext|>", "|", "end.", "word"]
    out = []
    for i in range(60):
        lines = [" ".join(rnd.choices(vocab, k=rnd.randint(0, 30))) for _ in range(rnd.randint(1, 5))]
        if i % 3 == 0:
            lines.insert(0, COMMON.upper() + " \t")
        out.append("\n".join(lines))
    out += [None, "", " \n\t", out[3], out[3], out[3] + " ", "a b", "A\x0bB", "ab" * 9000, "é" * 5000]
    out += [" ".join(rnd.choices(vocab, k=6000))] * 3
    return out


@pytest.fixture(scope="module")
def rows():
    return [(None if i == 7 else i, t, None if i % 11 == 0 else f"s{i % 4}", -1) for i, t in enumerate(_texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 0) for r in rows],
                               "doc_id long, text string, source string, n_chars long, t string, fp string, pid int")
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def _key(line):
    return line.strip(WS).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_block_masks_cover_every_close_pair():
    rnd = random.Random(1)
    for radius, blocks in ((3, 6), (2, 5), (0, 1)):
        masks = simhash.block_masks(radius, blocks)
        for _ in range(200):
            a = rnd.getrandbits(64)
            b = a
            for bit in rnd.sample(range(64), radius):
                b ^= 1 << bit
            assert any((a ^ b) & (m & (1 << 64) - 1) == 0 for m in masks)


def test_search_finds_exactly_the_close_fingerprints(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(63) for _ in range(20)]
    fps = base + [x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5))) for x in base for _ in range(10)]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in [*signed, None, signed[0]]], "fp long")
    got = {(r.query_fp, r.fp) for r in simhash.search(df.limit(30), df).collect()}
    queries = {r.fp for r in df.limit(30).collect()} - {None}
    want = {(a, b) for a in queries for b in set(signed) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert got == want


def test_fingerprints(spark, docs, rows, empty):
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, *_ in rows if i is not None}
    ids = sorted(text, reverse=True)
    null = rows[7][1]
    ring = [*[(i, text[i]) for i in ids], (None, null)]
    by = {r.doc_id: r for r in got}
    for k, (i, t) in enumerate(ring):
        nxt, half = ring[(k + 1) % len(ring)][1], len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        assert (by[i].n_chars, by[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        d = bin(int(by[i].fingerprint, 16) ^ int(by[i].edited_fingerprint, 16)).count("1")
        assert by[i].near_edited == 1 - d / 64
    assert by[3].fingerprint == by[63].fingerprint == by[64].fingerprint
    assert by[61].fingerprint == "0" * 16
    assert by[0].n_near >= 1 and by[1].n_near is None
    assert fingerprints.fingerprints(empty).count() == 0
    one = fingerprints.fingerprints(docs.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    plan = fingerprints.fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_next_row_of_an_id_on_most_rows(spark):
    ids = [7] * 900 + [6, 8, None, None, 2**63 - 1, 2**53 + 1] * 3 + list(range(100, 160))
    rows = [(i, k * 0x9E3779B97F4A7C15 % 2**64 - 2**63, f"v{k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, _h long, v string")
    got = {r.v: r.next_v for r in fingerprints.with_next(df, "doc_id", ["v"], 16).collect()}
    with_id = sorted((r for r in rows if r[0] is not None), key=lambda r: r[:2], reverse=True)
    nulls = [r[2] for r in rows if r[0] is None]
    assert len(got) == len(rows)
    assert [got[r[2]] for r in with_id[:-1]] == [r[2] for r in with_id[1:]]
    at, ring = got[with_id[-1][2]], []
    while at in nulls:  # the null ids follow in an order of their own and lead back to the largest id
        ring.append(at)
        at = got[at]
    assert sorted(ring) == sorted(nulls) and at == with_id[0][2]
    ranges = fingerprints.dealt_by_id(df, "doc_id", 16).groupBy("_b").count().collect()
    assert max(r["count"] for r in ranges) < 100  # 900 rows of one id, cut by _h


def test_votes_of_many_terms_match_a_plain_count(spark):
    words = [f"w{i % 97}" for i in range(1000)]
    df = spark.createDataFrame([(" ".join(words),)], "t string").select(
        F.split("t", " ").alias("w")).select(simhash.term_hashes(F.col("w")).alias("h"), simhash.fingerprint(F.col("w")).alias("f"))
    r = df.first()
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r.h) > len(r.h))
    assert r.f & (1 << 64) - 1 == want


def test_exact_dedup(docs, rows, empty):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i))
    want = {}
    for norm, members in groups.items():
        keep = min(members)[2]
        for _, _, i in members:
            want[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    for parts in (1, 5, 40):  # with 40 ranges a group of copies crosses borders
        got = exact_dedup.exact_dedup(docs, partitions=parts).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want and len(got) == len(rows)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_of_one_huge_group_and_repeated_rows(spark):
    df = spark.range(3000).select((F.col("id") % 2900).alias("doc_id"), F.lit("same text").alias("text"))
    got = exact_dedup.exact_dedup(df, partitions=16).collect()
    assert len(got) == 3000 and {(r.keep_id, r.group_size) for r in got} == {(0, 3000)} and sum(r.kept for r in got) == 1


def test_exact_dedup_spreads_rows_equal_in_all_columns(spark, monkeypatch):
    runs = []

    def kept(df, name):
        runs.append(stored(df, name))
        return runs[-1]

    monkeypatch.setattr(exact_dedup, "stored", kept)
    df = spark.range(0, 100_000, 1, 5).select(F.lit(4).cast("long").alias("doc_id"), F.lit("one row, many times").alias("text"))
    got = exact_dedup.exact_dedup(df, partitions=10).groupBy("keep_id", "group_size").agg(
        F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    assert [tuple(r) for r in got] == [(4, 100_000, 100_000, 1)]
    tasks = [r["count"] for r in runs[0].groupBy("pid").count().collect()]
    assert len(tasks) == 10 and max(tasks) < 20_000


def test_line_dedup(docs, rows, empty):
    found = collections.Counter(k for _, t, *_ in rows for k in {_key(x) for x in (t or "").split("\n")})
    got = line_dedup.line_dedup(docs, min_docs=10).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and sum(r.n_dropped for r in got) > 0
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (_key(x) and found[_key(x)] >= 10)]
        assert (by[i].n_lines, by[i].n_dropped, by[i].text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert got[0].t == "x" and got[0].pid == 0
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_runs_are_levelled_and_exact(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    total = collections.Counter()
    for b in range(5):
        part = [(k, -k, 1) for k in range(b, 12)]
        total.update(k for k, *_ in part)
        runs.add(spark.createDataFrame(part, "hi long, lo long, n_docs long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {r.hi for r in runs.settled().collect()} == {k for k, n in total.items() if n >= 3}


def test_sharding(docs, rows, empty):
    got = sharding.shard(docs, [1.0] * 8).collect()
    text = {i: (t or "").encode() for i, t, *_ in rows}
    slots = collections.defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id]))
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(rows)
    assert sharding.shard(empty, [1.0]).count() == 0


def test_shares_follow_the_weights_and_growth_moves_few(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shard(ids, [1.0, 3.0], new_weight=1.0).toPandas()
    assert abs((got["shard"] == 1).mean() - 0.75) < 0.02
    moved = got[got["shard"] != got["grown_shard"]]
    assert (moved["grown_shard"] == 2).all() and abs(len(moved) / len(got) - 0.2) < 0.02


def test_license_scan(spark, empty):
    docs = spark.createDataFrame([
        (1, "Copyright 2020 A\nReleased  under the M.I.T. licence", "q"), (2, "RELEASED UNDER THE MIT LICENSE!!", "q"),
        (3, "some\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT License.", "q"),
        (4, None, "q"), (5, "", "q"), (None, "Released under the MIT License", "q"), (2, "RELEASED UNDER THE MIT LICENSE!!", "q"),
    ], "doc_id long, text string, digest string")
    got = sorted(((r.doc_id or 0, r.text_license, r.line_licenses, r.n_license_lines) for r in licenses.license_scan(docs).collect()),
                 key=str)
    assert got == sorted([(1, None, None, 0), (2, "MIT", "MIT", 1), (2, "MIT", "MIT", 1), (3, None, "CC-BY-NC-4.0,MIT", 3),
                          (4, None, None, 0), (5, None, None, 0), (0, "MIT", "MIT", 1)], key=str)
    mit = spark.createDataFrame([("a", "Released under the MIT License"), ("b", "released under the mit licence")], "license string, text string")
    for rows in (10, 0):  # broadcast, and beyond the bound joined by shuffles
        assert licenses.license_scan(docs.where("doc_id = 2"), mit, broadcast_rows=rows).first().text_license == "a,b"
    assert licenses.license_scan(empty).count() == 0


def test_license_scan_knows_whole_licences(spark):
    """Whole licence files, wrapped or not, with a copyright line between title and text."""
    mit = """The MIT License (MIT)

Copyright (c) 2015 Some One and the authors

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
    texts = {name: [] for name in licenses.FULL_TEXTS}
    for name, text in licenses.full_texts():
        texts[name].append(text)
    assert len(texts["GPL-3.0"][0]) > 30_000 and "MERCHANTABILITY" in texts["BSD-2-Clause"][0]
    bsd = "BSD 3-Clause License\n\nCopyright (c) 2024, A\nAll rights reserved.\n\n" + texts["BSD-3-Clause"][0]
    isc = "ISC License\n\nCopyright 2020 B\n\n" + texts["ISC"][0].upper()
    apache = texts["Apache-2.0"][0]
    docs = spark.createDataFrame([(1, mit), (2, bsd), (3, isc), (4, apache), (5, mit + "and more"), (6, texts["GPL-3.0"][0])],
                                 "doc_id long, text string")
    got = {r.doc_id: r.text_license for r in licenses.license_scan(docs).collect()}
    assert got == {1: "MIT", 2: "BSD-3-Clause", 3: "ISC", 4: "Apache-2.0", 5: None, 6: "GPL-3.0"}


def test_targets_and_flow():
    assert mixing.targets([100, 100, 10], [1, 1, 2], 3) == [90.0, 90.0, 30.0]
    assert mixing.targets([0, 5], [1, 1]) == [0.0, 5.0] and mixing.targets([], []) == []
    # the shared pattern serves whichever source lacks words; repeats cost more than first use
    flow = mixing.min_cost_flow([50, 50, 100], [[0], [1], [0, 1]], [120, 80])
    assert [sum(x) for x in zip(*flow, strict=True)] == [120, 80] and [sum(x) for x in flow] == [50, 50, 100]
    assert sum(mixing.min_cost_flow([10], [[0]], [25])[0]) == 25


def _mixed(docs, **options):
    return mixing.mix(docs, F.array("source"), mixing.word_count(text_of()), F.col("doc_id"),
                      carry={"doc_id": F.col("doc_id"), "source": F.col("source")}, **options)


def test_mixing(spark, rows, docs, empty):
    got = _mixed(docs).collect()
    assert len(got) == len(rows)
    sizes = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t, *_ in rows}
    total, taken = collections.Counter(), collections.Counter()
    for r in got:
        assert r.size == sizes[r.doc_id] and 0 <= r.copies <= 3
        total[r.source] += r.size
        taken[r.source] += r.size * r.copies
    names = sorted(total, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([total[s] for s in names], mixing.in_turn(names)), strict=True))
    assert all(r.source_size == total[r.source] and abs(r.target - goal[r.source]) < 1e-6 for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, _mixed(docs.repartition(7)).collect()), key=str)
    assert _mixed(empty).count() == 0
    many = spark.range(20_000).select("id", F.concat(F.lit("s"), F.col("id") % 3).alias("source"),
                                      F.repeat(F.lit("w "), (F.col("id") % 40 + 1).cast("int")).alias("text")).withColumnRenamed("id", "doc_id")
    agg = _mixed(many).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 20 for r in agg)


def _brute_components(fps, radius=3):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= radius:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def test_simhash_dedup(docs, rows, empty):
    got = simhash_dedup.simhash_dedup(docs).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, *_ in rows:
        w = re.findall(b"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        h = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        want[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == want
    named = {i: f for i, f in want.items() if i is not None}
    comp = _brute_components(named)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == comp
    kept = simhash_dedup.keep_one(docs).collect()
    assert {r.doc_id for r in kept} - {None} == set(comp.values()) and kept[0].t == "x"
    assert simhash_dedup.simhash_dedup(empty).count() == 0


def test_keep_one_row_of_a_component(spark):
    long, other, third = (" ".join(f"{w}{k}" for k in range(80)) for w in ("a", "b", "c"))
    rows = [(1, long), (2, long), (3, other), (3, third), (None, third + "  "), (None, "no id here"), (None, "no id  here"),
            (5, None), (6, "")]
    rows += rows  # the table was loaded twice
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _n string").repartition(4)
    assert docs.count() == 18
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = collections.Counter((r.doc_id, " ".join((r.text or "").split()), r._n) for r in kept.collect())
    assert got == {(1, long, "x"): 1, (3, other, "x"): 1, (3, third, "x"): 1, (None, "no id here", "x"): 1, (5, "", "x"): 1}


def test_links_of_chains_and_a_bucket_of_many_slices(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "SLICE", 8)
    rnd = random.Random(3)
    fps, x = [], 0
    for _ in range(120):  # a chain in which only neighbours are close
        fps.append(x)
        x ^= sum(1 << b for b in rnd.sample(range(40), 3))
    fps += [rnd.getrandbits(63) for _ in range(50)]
    ids = dict(enumerate(dict.fromkeys(fps)))
    comp = _brute_components(ids)
    edges = simhash_dedup.links(spark.createDataFrame([(f,) for f in ids.values()], "fp long"))
    roots = {r.fp: r.root for r in simhash_dedup.components(edges).collect()}
    classes = collections.defaultdict(set)
    for i, f in ids.items():
        classes[roots.get(f, f)].add(i)
    want = collections.defaultdict(set)
    for i, c in comp.items():
        want[c].add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_components_of_hubs_and_chains(spark):
    hub = [(0, k) for k in range(1, 400)] + [(-5, k) for k in range(300, 320)]  # a least and a middle hub, joined
    high = [(10_000, k) for k in range(5_000, 5_300)]  # the hub is the greatest
    chain = [(k, k + 1) for k in range(20_000, 20_040)]
    edges = spark.createDataFrame(hub + high + chain + [(7, 7)], "a long, b long")
    got = {r.fp: r.root for r in simhash_dedup.components(edges).collect()}
    want = {k: -5 for k in [-5, *range(400)]} | {k: 5_000 for k in [10_000, *range(5_000, 5_300)]}
    assert got == want | {k: 20_000 for k in range(20_000, 20_041)}


def test_components_of_few_links_take_few_tasks_and_rounds(spark, monkeypatch):
    counted, parts = simhash_dedup.checkpoint_counted, []

    def noted(df):
        out, n = counted(df)
        parts.append(out.rdd.getNumPartitions())
        return out, n

    monkeypatch.setattr(simhash_dedup, "checkpoint_counted", noted)
    names = random.Random(5).sample(range(-10**12, 10**12), 300)  # a path in no order of its numbers, and a hub
    links = list(zip(names, names[1:])) + [(names[0], 10**13 + k) for k in range(100)] + [(10**14, 10**14 + 1)]
    edges = spark.createDataFrame(links, "a long, b long")
    want = dict.fromkeys(set(names) | {10**13 + k for k in range(100)}, min(names)) | dict.fromkeys((10**14, 10**14 + 1), 10**14)
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r.fp: r.root for r in simhash_dedup.components(edges).collect()} == want
        assert len(parts) <= 4 and set(parts[1:]) == {1}  # not a task for every shuffle partition, nor a round for every doubling of the path
        monkeypatch.setattr(simhash_dedup, "CHUNK", 150)  # three chunks: the rounds connect them
        parts.clear()
        assert {r.fp: r.root for r in simhash_dedup.components(edges).collect()} == want
        assert parts[1] == 3
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    assert simhash_dedup.components(edges.where("a = b")).count() == 0


def test_links_are_joined_up_chunk_by_chunk(monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CHUNK", 4)
    links = [(5, 4), (4, 3), (9, 5), (3, 1), (7, 3), (8, 7)]  # the fifth begins a new chunk
    batches = [pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in part]) for part in (links[:3], links[3:])]
    got = [{(r["u"], r["v"]) for r in b.to_pylist()} for b in simhash_dedup._joined_up(batches)]
    assert got == [{(5, 1), (4, 1), (3, 1), (9, 1)}, {(7, 3), (8, 3)}]
    assert [b.num_rows for b in simhash_dedup._joined_up([])] == [0]


def test_values_of_a_column_a_few_at_a_time():
    rows = [None, "", "a", "é" * 300] * 70
    assert list(values(pa.array(rows))) == rows == list(values(pa.array(rows), 7))
    made = [next(values(pa.chunked_array([rows]), 1)), *values(pa.array([[b"x"], [], None]), 2)]
    assert made == [None, [b"x"], [], None]


def test_spread_join_of_a_frequent_key(spark):
    rows = spark.createDataFrame([(1, i) for i in range(500)] + [(2, None), (2, None)], "k long, i long")
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, name string")
    got = collections.Counter((r.k, r.i, r.name) for r in simhash_dedup.spread_join(rows, names, "k", "i").collect())
    assert got == collections.Counter([(1, i, "a") for i in range(500)] + [(2, None, "b")] * 2)


def test_pieces_encode_as_the_library():
    p = tokens.pieces(tokens.default_tokenizer())
    extra = ["Σίσυφος ΟΔΟΣ", "ﬁx İstanbul", "a b c\x1cd", "it's I'LL 'sup", "x<|startoftext|>y", "ÀÉ'd, q!!'s", "́a ¼ ²"]
    for t in [*_texts(), *extra]:
        ids = p.tok.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(p.encode(t or ""), "<u4").tolist() == ids


def test_cuts_are_content_defined_and_whole():
    data = " ".join(str(xxhash.xxh32_intdigest(str(i))) for i in range(3000)).encode()
    ends = bpe.cuts(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    moved = bpe.cuts(b"new words first " + data)
    assert len({e + 16 for e in ends} & set(moved)) > 0.9 * len(ends)
    for t in ("é" * 9000, "日本" * 5000, ""):
        at = 0
        for e in bpe.cuts(t.encode()):
            t.encode()[at:e].decode()
            at = e


def test_bpe_round_trip(docs, rows, empty):
    tok = tokens.pieces(tokens.default_tokenizer()).tok
    got = {r.doc_id: r for r in bpe.encode_decode(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == ids
        assert got[i].decoded == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty).count() == 0


def test_every_chunk_taken_apart_gives_the_same_ids():
    p = tokens.pieces(tokens.default_tokenizer())
    for t in filter(None, _texts()):
        data = t.encode()
        ends = bpe.cuts(data)
        fixed, holes = bpe.take_apart(data, ends, bpe.keys(data, ends), np.ones(len(ends), bool), lambda x: p.encode(x.decode()))
        out = fixed[0]
        for (s, e, _, dl, dr), f in zip(holes, fixed[1:], strict=True):
            ids = p.encode(data[s:e].decode())
            out += ids[4 * dl:len(ids) - 4 * dr] + f
        assert out == p.encode(t)


def test_directly_addressable_codes():
    rnd = np.random.default_rng(4)
    for ids in (rnd.integers(0, 1 << 16, 5000), rnd.integers(0, 200, 600), np.array([0, 255, 256, (1 << 32) - 1]), np.zeros(0, int)):
        dac = token_files.Dac(token_files.pack(ids.astype(np.uint32)))
        where = rnd.permutation(len(ids))
        assert len(dac) == len(ids) and dac.get(where).tolist() == ids[where].tolist()


def test_token_files(docs, rows, empty, monkeypatch):
    tok = tokens.pieces(tokens.default_tokenizer()).tok
    got = {r.doc_id: r for r in token_files.token_table(docs).collect()}
    at = 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.token_table(empty).count() == 0


def _labelled(spark, n=400):
    rnd = random.Random(6)
    good = ["the", "river", "runs", "slowly", "past", "old", "town", "and", "its", "bridge"]
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        lines = [" ".join((["BUY!!"] * 8) if bad else rnd.choices(good, k=9)) + ("" if bad else ".") for _ in range(rnd.randint(1, 6))]
        rows.append((i, "\n".join(lines), int(not bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int"), rows


def test_quality_on_held_out_documents(spark, docs, empty):
    train_docs, labels, rows = _labelled(spark)
    model = quality.train(train_docs, labels)
    got = quality.score_documents(train_docs, model).collect()
    truth = {i: q for i, _, q in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.predicted == truth[r.doc_id] and 0 <= r.score <= 1 for r in got if r.held_out)
    assert quality.score_documents(docs, model).count() == docs.count()
    assert quality.score_documents(empty, model).count() == 0
    nothing = quality.train(train_docs, labels.where("false"))
    assert {r.score for r in quality.score_documents(train_docs, nothing).collect()} == {0.5}
    kept = quality.keep_good(train_docs, model).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in got if r.predicted}


def test_quality_training_keeps_texts_off_the_driver(spark):
    """About 200 training documents of two lines, 40 KB each: the driver must not hold these 8 MB, nor arrays of that size."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(
        F.repeat(F.when(F.col("id") % 2 == 0, "BUY!! now$ ").otherwise("a river flows. "), 1600), F.lit("\n"),
        F.repeat(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" ")), 5000)).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    tracemalloc.start()
    try:
        model = quality.train(docs, labels)
        assert tracemalloc.get_traced_memory()[1] < 5e6
    finally:
        tracemalloc.stop()
    got = quality.score_documents(docs, model).collect()
    assert len(got) == 300 and all(r.predicted == r.doc_id % 2 for r in got)


def test_quality_lines_described_in_parts_equal_the_whole(monkeypatch):
    rnd = random.Random(8)
    texts = ["\n".join(rnd.choices(["", "a b. a b.", "a b. a b.", "BUY!! naïve 12 |", "\t x"], k=rnd.randint(1, 7))) for _ in range(60)] + [""]
    whole, sizes, counts = quality.line_features(texts)
    monkeypatch.setattr(quality, "PART", 40)
    cuts = list(quality.parts([len(t) for t in texts]))
    assert len(cuts) > 5 and [k for s in cuts for k in range(s.start, s.stop)] == list(range(len(texts)))
    each = [quality.own_features(texts[s]) for s in cuts]
    own = np.concatenate([e[0] for e in each])
    assert np.array_equal(quality.chained(own, counts), whole)
    assert all(np.array_equal(np.concatenate([e[k] for e in each]), x) for k, x in ((1, sizes), (2, counts)))
    for t, s in zip(texts, np.split(whole, np.cumsum(counts)[:-1]), strict=True):
        assert np.array_equal(quality.line_features([t])[0], s)


def test_crf_marginals_and_gradient_match_enumeration():
    rnd = np.random.default_rng(7)
    m = quality.Crf(np.zeros(quality.WIDTH), rnd.normal(size=(2, 2)))
    u = rnd.normal(size=5)
    weight = {}
    for states in np.ndindex(*[2] * 5):
        weight[states] = np.exp(sum(u[i] for i, s in enumerate(states) if s) + sum(m.trans[a, b] for a, b in zip(states, states[1:], strict=False)))
    want = [sum(w for s, w in weight.items() if s[i]) / sum(weight.values()) for i in range(5)]
    assert np.allclose(m.marginals(np.exp(u).tolist()), want)


def test_line_stage_leaves_the_text_of_copies(spark):
    texts = ["only copies\nhave this"] * 12 + [f"text {k}\nin ten texts" for k in range(10)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    want = [t.removesuffix("\nin ten texts") for t in texts]
    assert got == {i: (t, len(t)) for i, t in enumerate(want)}
    by_rows = line_dedup.line_dedup(docs, min_docs=10).collect()  # op3's rule stays: every row is a document
    assert {r.text for r in by_rows if r.doc_id < 12} == {""}


def test_pipeline_stages(spark, tmp_path):
    train_docs, labels, rows = _labelled(spark, 120)
    docs = train_docs.select("doc_id", F.concat(F.lit("A line that all pages share\n"), "text").alias("text"),
                             F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("doc_id") % 2).alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs = docs.unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(1000).cast("long")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    cur = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        cur = stage(spark, cur, str(tmp_path))
        assert cur.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        counts.append(cur.count())
    good = {i for i, _, q in rows if q} | {1000}
    assert counts[0] == counts[1] == len(good) and counts[2] <= len(good) - 1
    assert all("all pages share" not in r.text for r in cur.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[3]
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
        assert none.count() == 0, name


def test_line_runs_are_opened_again_behind_the_last_whole_batch(spark, tmp_path):
    def batch(k):
        return spark.range(60).select((F.col("id") * 7 % 40 + k).alias("hi"), F.col("id").alias("lo"), F.lit(1).cast("long").alias("n_docs"))

    straight = line_dedup.LineRuns(spark, 3, fanout=2, path=str(tmp_path / "a"))
    for k in range(5):
        straight.add(batch(k % 2))
    for k in range(5):
        store = line_dedup.LineRuns(spark, 3, fanout=2, path=str(tmp_path / "b"))
        store.add(batch(k % 2))
    batch(9).write.parquet(f"{store.path}/level=0/run={store._made}")  # a batch that broke off before its manifest
    again = line_dedup.LineRuns(spark, 3, fanout=2, path=store.path)
    assert [len(x) for x in again.levels] == [len(x) for x in straight.levels]
    assert sorted(map(tuple, again.counts().collect())) == sorted(map(tuple, straight.counts().collect()))
    again.add(batch(1))
    straight.add(batch(1))
    assert sorted(map(tuple, again.settled().collect())) == sorted(map(tuple, straight.settled().collect()))


def test_the_tokenizer_remembers_no_more_than_its_bound(monkeypatch):
    from sitegraph.llm import tokens

    monkeypatch.setattr(tokens, "MAX_PIECES", 50)
    p = tokens.Pieces(tokens.default_tokenizer())
    text = " ".join(f"{w}{s}" for k in range(300) for w in ("Wort" + chr(97 + k % 26) * (k // 26 + 1),) for s in ("", ".", "!?"))
    want = p.tok.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(p.encode(text), dtype="<u4").tolist() == want
    held = len(p) + sum(len(v) for k, v in vars(p).items() if isinstance(v, dict) and k != "table")
    assert held <= 60  # words without signs had a table of their own, of a million words more
