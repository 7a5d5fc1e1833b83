"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. The token
capacity of each pattern is routed to the quotas of its sources by a min-cost
flow whose cost rises with every repetition of a document; the patterns' flows
are then met by whole documents in a seeded order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegraph.llm.common import only, stored, text_of, words
from sitegraph.llm.merkle import running_total

BITS = 12  # of the seeded order's hash, for each of the two histograms


def targets(sizes: list[int], weights: list[float], repeats: int = 3, total: int | None = None) -> list[float]:
    """Share of the total size per source by weight, none above ``repeats`` times its size, the excess reshared.

    The total is that of the sources unless given (documents of overlapping sources count once).
    """
    left, open_, out = float(sum(sizes) if total is None else total), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * unit > repeats * sizes[i]}
        for i in over or open_:
            out[i] = float(repeats * sizes[i]) if over else weights[i] * unit
        left -= sum(out[i] for i in over)
        open_ -= over or open_
    return out


def min_cost_flow(capacity: list[int], member: list[list[int]], quota: list[int], repeats: int = 3) -> list[list[int]]:
    """Words to take from every pattern for each of its sources.

    Edges: start -> pattern, one of ``capacity`` for each repetition r at cost
    r*r; pattern -> its sources, free; source -> end, up to its quota.
    Augments along cheapest paths, so the flow is greatest and cheapest of these.
    """
    n_p, n_s = len(capacity), len(quota)
    start, end = n_p + n_s, n_p + n_s + 1
    to, cap, cost, adj = [], [], [], [[] for _ in range(n_p + n_s + 2)]

    def edge(a, b, c, w):
        for x, y, k, z in ((a, b, c, w), (b, a, 0, -w)):
            adj[x].append(len(to))
            to.append(y), cap.append(k), cost.append(z)

    for p in range(n_p):
        for r in range(repeats):
            edge(start, p, capacity[p], r * r)
    routes = []
    for p, sources in enumerate(member):
        for s in sources:
            routes.append((p, s, len(to)))
            edge(p, n_p + s, repeats * capacity[p], 0)
    for s in range(n_s):
        edge(n_p + s, end, quota[s], 0)
    while True:
        dist, via, queue, queued = {start: 0}, {}, deque([start]), {start}
        while queue:  # label-correcting search; costs are small integers
            x = queue.popleft()
            queued.discard(x)
            for e in adj[x]:
                if cap[e] > 0 and dist[x] + cost[e] < dist.get(to[e], 1 << 60):
                    dist[to[e]], via[to[e]] = dist[x] + cost[e], e
                    if to[e] not in queued:
                        queue.append(to[e])
                        queued.add(to[e])
        if end not in dist:
            break
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push
    flow = [[0] * n_s for _ in range(n_p)]
    for p, s, e in routes:
        flow[p][s] = cap[e ^ 1]
    return flow


def in_turn(sources: list[str | None]) -> list[float]:
    """Weights 1, 2, 3, repeating, over the sources in order."""
    return [float(1 + k % 3) for k in range(len(sources))]


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def mix(docs: DataFrame, sources: Column, size: Column, key: Column, repeats: int = 3, seed: int = 42,
        weights: Callable[[list[str | None]], list[float]] = in_turn, carry: dict[str, Column] | None = None,
        max_patterns: int = 100_000) -> DataFrame:
    """How often each row is taken so that every source's taken size comes near its target.

    ``sources`` is the array of sources of a row (a null member is a source of
    its own, last in order; an empty or null array takes part in nothing),
    ``size`` its size, ``key`` what the seeded order hashes, ``carry`` further
    result columns by name. Returns ``carry`` plus ``size, source_size, target``
    (sums over the row's sources) and ``copies`` (0 to ``repeats``).

    Documents come whole: in the seeded order as many as fit, then the one whose
    size comes nearest to what is still open. A row of size 0 before
    the cut is taken once more than its pattern's rows are taken whole, but not
    more than ``repeats`` times. Rows that share a key are
    ordered by what ``carry`` holds and their size; rows equal in that, too, may
    differ in ``copies`` only at the cut, so reruns give equal results however
    the table is dealt. The targets share the documents' total, each counted
    once however many sources it has. An empty table gives
    an empty result. The driver sees one row per membership pattern; more than
    ``max_patterns`` of them is an error, not a cut.
    """
    spark = docs.sparkSession
    cols = carry or {}
    size = F.coalesce(size, F.lit(0)).cast("long")
    tie = F.xxhash64(F.lit("tie"), *cols.values(), size)
    h = F.xxhash64(F.lit(seed), key, tie)  # rows of one key are spread over the order, too
    low = F.lit((1 << BITS) - 1)
    rows = only(docs, **cols, size=size, _src=F.array_distinct(F.array_sort(sources)), _h=h, _t=tie)
    rows = stored(rows.select(
        "*", F.monotonically_increasing_id().alias("_uid"), F.call_function("shiftrightunsigned", "_h", F.lit(64 - BITS)).cast("int").alias("_b1"),
        F.call_function("shiftrightunsigned", "_h", F.lit(64 - 2 * BITS)).bitwiseAND(low).cast("int").alias("_b2")), "mix")
    found = rows.groupBy("_src").agg(F.sum("size").alias("words")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = sorted(((list(r._src or []), int(r.words), r._src is None) for r in found),
                      key=lambda p: (p[2], [(s is None, s or "") for s in p[0]]))
    names = sorted({s for p, _, _ in patterns for s in p}, key=lambda s: (s is None, s or ""))
    at = {s: k for k, s in enumerate(names)}
    sizes = [sum(w for p, w, _ in patterns if s in p) for s in names]
    goal = targets(sizes, weights(names), repeats, sum(w for p, w, _ in patterns if p))
    flow = min_cost_flow([w for _, w, _ in patterns], [[at[s] for s in p] for p, _, _ in patterns],
                         [round(g) for g in goal], repeats)
    plan = []
    for k, ((p, w, none), f) in enumerate(zip(patterns, flow, strict=True)):
        whole, rest = divmod(sum(f), w) if w else (0, 0)
        plan.append((k, None if none else p, sum(sizes[at[s]] for s in p), float(sum(goal[at[s]] for s in p)), whole, rest))
    plan_df = spark.createDataFrame(plan, "_k int, _src array<string>, source_size long, target double, _whole long, _rest long")
    joined = rows.join(F.broadcast(plan_df.withColumnRenamed("_src", "_p")), F.col("_src").eqNullSafe(F.col("_p"))).drop("_p")

    def cut(df, bucket, c, s):
        """Adds ``c``, the histogram bucket in which a pattern's size reaches ``_rest``, and ``s``, the size before it."""
        w = Window.partitionBy("_k").orderBy(bucket)
        run = df.groupBy("_k", bucket).agg(F.sum("size").alias("here"), F.first("_rest").alias("r")).withColumn(
            "upto", F.sum("here").over(w))
        found = run.where((F.col("upto") > F.col("r")) & (F.col("here") > 0)).groupBy("_k").agg(
            F.min(F.struct(F.col(bucket).alias("b"), (F.col("upto") - F.col("here")).alias("before"))).alias("m"))
        cuts = [(r._k, r.m.b, r.m.before) for r in found.collect()]  # one row per pattern
        return df.join(F.broadcast(spark.createDataFrame(cuts, f"_k int, {c} int, {s} long")), "_k", "left")

    marked = cut(joined, "_b1", "_c1", "_s1")
    at_cut = cut(marked.where(F.col("_b1") == F.col("_c1")).withColumn("_rest", F.col("_rest") - F.col("_s1")),
                 "_b2", "_c2", "_s2")
    border = running_total(at_cut.where(F.col("_b2") == F.col("_c2")), ["_k"], ["_h", "_t", "_uid"], {"_sum": "size"}).withColumn(
        "_extra", (F.col("_s2") + F.col("_sum") + F.col("size")) <= F.col("_rest"))
    parts = [marked.where(F.col("_c1").isNull() | (F.col("_b1") != F.col("_c1"))).withColumn(
                 "_extra", F.col("_b1") < F.coalesce("_c1", F.lit(1 << BITS))),
             at_cut.where(F.col("_c2").isNull() | (F.col("_b2") != F.col("_c2"))).withColumn(
                 "_extra", F.col("_b2") < F.coalesce("_c2", F.lit(1 << BITS))),
             border]
    out = [*cols, "size", "source_size", "target", "_k", "_h", "_t", "_uid", "_whole", "_extra"]
    chosen = reduce(DataFrame.unionByName, [p.select(*out) for p in parts])
    # what the whole documents before the cut leave open goes to the one document whose size comes nearest
    taken = chosen.groupBy("_k").agg(F.sum(F.when(F.col("_extra"), F.col("size")).otherwise(0)).alias("t"))
    open_ = [(k, rest - t) for k, rest, t in ((r._k, plan[r._k][5], r.t) for r in taken.collect()) if rest > t]
    gap = F.broadcast(spark.createDataFrame(open_, "_k int, gap long"))
    fits = chosen.where(~F.col("_extra")).join(gap, "_k").where(F.abs(F.col("size") - F.col("gap")) < F.col("gap"))
    best = [(r._k, r.m["_uid"]) for r in fits.groupBy("_k").agg(
        F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("d"), "_h", "_t", "_uid")).alias("m")).collect()]
    pick = F.broadcast(spark.createDataFrame(best, "_k int, _pick long"))
    extra = F.col("_extra") | (F.col("_uid") == F.coalesce("_pick", F.lit(-1)))
    return chosen.join(pick, "_k", "left").select(*cols, "size", "source_size", "target",
                                                  F.least(F.col("_whole") + extra.cast("long"), F.lit(repeats).cast("long")).alias("copies"))
