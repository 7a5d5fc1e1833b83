"""Prefix trie of conversations, finished shard by shard under a skeleton of splitter paths.

A conversation is a path of turn digests. Sampled paths split the sorted
conversations into shards. A node whose conversations stand on both sides of a
splitter is a prefix of that splitter, so the splitters' paths are the skeleton
of the trie: every other node lies in one shard, which finishes it in one walk
over its sorted paths, and the nodes of the skeleton add up the parts that the
shards give.

Long conversations are cut into blocks of turns. A block stands under the
digest of all turns before it; the totals of lower blocks are added up along
each conversation and join the block above as one number.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import only, shuffle_partitions, stored, text_of
from sitegraph.llm.merkle import running_total
from sitegraph.llm.simhash_dedup import spread_join
from sitegraph.operators.frontier import rank_within

BLOCK = 64  # turns to a block
DIGIT = 32  # characters of a turn's digest
SHARD_TURNS = 1 << 18  # turns to a shard, about
SAMPLE = 8  # sampled paths per shard
ENDS = 1 << 14  # ids to a part of a skeleton node's list
SMALL = 200_000  # rows of the skeleton up to which it is broadcast
NOTHING = hashlib.sha256(b"").hexdigest()

ROWS = "conv_id long, b long, pkey string, up long, path string, lens array<long>, cont boolean, x_children long, x_leaves long, x_saved long"
PARTS = ("kind int, b long, pkey string, path string, depth long, conv_id long, parent long, up long, n_convs long, n_children long, "
         "n_leaves long, saved long, length long, cont boolean, ends string, part long")
NODE, PART, LIST, ROOT = range(4)  # kinds: finished node, part of a skeleton node, part of its list of ends, a lower block's totals


def turns(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, place, digit, length``: each turn's place from 1 in its conversation, its digest and the code points of its text.

    Turns stand by number, null first, equal numbers by digest. A null role or
    text is empty. Turns of no conversation (a null id) are left out.
    """
    role, text = text_of(role_col), text_of(text_col)
    digit = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGIT)
    rows = only(convs.where(F.col(conv_col).isNotNull()), conv_id=F.col(conv_col).cast("long"), turn=F.col(turn_col).cast("long"),
                digit=digit, length=F.length(text).cast("long"))
    return rank_within(rows, ["turn", "digit"], "conv_id").select("conv_id", F.col("rank").alias("place"), "digit", "length")


def grafted(rows: DataFrame, head: Column, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``head`` turns (at most ``most``) are those of conversation ``c - c % every``.

    Returns the turns ``conv_id, place, digit, length`` and the ids ``conv_id``
    of all conversations, those left without turns too.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    ids = stored(rows.select("conv_id").distinct().select("conv_id", base.alias("base"), head.cast("long").alias("head")), "trie-ids")
    heads = stored(rows.where((F.col("conv_id") % every == 0) & (F.col("place") <= most)).withColumnRenamed("conv_id", "base"), "trie-heads")
    long_ = ids.select("base").distinct().join(heads.groupBy("base").agg(F.count(F.lit(1)).alias("n_base")), "base", "left")
    own = rows.select("*", base.alias("base"), head.cast("long").alias("head")).where(F.col("place") > F.col("head"))
    own = spread_join(own, long_, "base", "place").select(
        "conv_id", (F.least("head", F.coalesce("n_base", F.lit(0))) + F.col("place") - F.col("head")).alias("place"), "digit", "length")
    given = ids.join(heads, "base").where(F.col("place") <= F.col("head")).select("conv_id", "place", "digit", "length")
    return own.unionByName(given), ids.select("conv_id")


def blocks(rows: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """Paths of at most ``block`` turns, stored: ``conv_id, b, pkey, up, path, lens, cont``.

    ``pkey`` names all turns before the block (empty for the first), ``up`` is
    the least conversation that has them; ``cont``: a further block follows.
    The digest of many blocks is a sum of their hashes by number, so it is
    taken by running sums and a conversation of any length is spread.
    """
    turn = F.struct("place", "digit", "length")
    cut = rows.groupBy("conv_id", F.expr(f"(place - 1) div {block}").alias("b")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    cut = stored(cut.select("conv_id", "b", F.array_join(F.transform("t", lambda x: x["digit"]), "").alias("path"),
                            F.transform("t", lambda x: x["length"]).alias("lens")), "trie-blocks")
    follows = cut.where(F.col("b") > 0).select("conv_id", (F.col("b") - 1).alias("b"), F.lit(True).alias("cont"))
    cut = cut.join(follows, ["conv_id", "b"], "left").withColumn("cont", F.coalesce("cont", F.lit(False)))
    none = ids.join(rows.select("conv_id"), "conv_id", "left_anti").select(
        "conv_id", F.lit(0).cast("long").alias("b"), F.lit("").alias("path"), F.array().cast("array<long>").alias("lens"), F.lit(False).alias("cont"))
    first = cut.where(F.col("b") == 0).unionByName(none).withColumns({"pkey": F.lit(""), "up": F.lit(None).cast("long")})

    def hash50(k):
        return F.call_function("shiftrightunsigned", F.xxhash64(F.lit(k), "b", "path"), F.lit(14)).cast("decimal(38,0)")

    full = cut.where(F.size("lens") == block).withColumn("h", (hash50(1) * F.lit(1 << 50).cast("decimal(20,0)") + hash50(2)).cast("decimal(38,0)"))
    chain = running_total(full.select("conv_id", "b", "h"), ["conv_id"], ["b"], {"sofar": "h"})
    named = stored(chain.select("conv_id", (F.col("b") + 1).alias("b"), F.concat(
        (F.col("b") + 1).cast("string"), F.lit(":"), (F.col("sofar") + F.col("h")).cast("string")).alias("pkey")), "trie-names")
    least = named.groupBy("pkey").agg(F.min("conv_id").alias("up"))
    later = spread_join(cut.where(F.col("b") > 0).join(named, ["conv_id", "b"]), least, "pkey", "conv_id")
    names = ["conv_id", "b", "pkey", "up", "path", "lens", "cont"]
    return stored(first.select(*names).unionByName(later.select(*names)), "trie-rows")


# ------------------------------------------------------------------ one shard

class _Node:
    __slots__ = ("at", "length", "skeleton", "n", "least", "children", "leaves", "saved", "cont", "hash", "ends", "waiting")

    def __init__(self, at: int, length: int, skeleton: bool):
        self.at, self.length, self.skeleton = at, length, skeleton
        self.n, self.least, self.children, self.leaves, self.saved, self.cont = 0, None, 0, 0, 0, False
        self.hash, self.ends, self.waiting = None, [], []


class _Walk:
    """A walk over sorted paths; ``out`` gets the rows of nodes that end."""

    def __init__(self, shard: int, splitters: list[tuple], block: int):
        self.bounds = splitters[max(shard - 1, 0):shard + 1]  # those at the shard's ends
        self.shard, self.block, self.stack, self.out, self.lists = shard, block, [], [], 0
        self.pkey = self.path = self.b = self.up = None

    def _on_skeleton(self, path: str) -> bool:
        return any(p == self.pkey and s.startswith(path) for p, s, _ in self.bounds)

    def add(self, r: dict) -> None:
        path, lens = r["path"], r["lens"]
        if r["pkey"] != self.pkey:
            self.close(0)
            self.pkey, self.path, self.b, self.up = r["pkey"], "", r["b"], r["up"]
            self.stack = [_Node(0, 0, self._on_skeleton(""))]
        same, most = 0, min(len(self.stack) - 1, len(lens))
        while same < most and path[same * DIGIT:(same + 1) * DIGIT] == self.path[same * DIGIT:(same + 1) * DIGIT]:
            same += 1
        self.close(same + 1)
        self.path = path
        for at in range(same + 1, len(lens) + 1):
            self.stack.append(_Node(at, lens[at - 1], self.stack[-1].skeleton and self._on_skeleton(path[:at * DIGIT])))
        node, conv = self.stack[-1], r["conv_id"]
        node.n += 1
        node.least = conv if node.least is None else min(node.least, conv)
        if r["cont"]:
            node.cont = True
            node.children += r["x_children"]
            node.leaves += r["x_leaves"]
            node.saved += r["x_saved"]
        elif node.skeleton:
            node.ends.append(str(conv))
            if len(node.ends) >= ENDS:
                self._list(node)
        elif node.hash is None:
            node.hash = hashlib.sha256(str(conv).encode())
        else:
            node.hash.update(b",%d" % conv)

    def _list(self, node: _Node) -> None:
        self._row(kind=LIST, path=self.path[:node.at * DIGIT], ends=",".join(node.ends), part=(self.shard << 32) + self.lists)
        node.ends, self.lists = [], self.lists + 1

    def _row(self, **cols) -> None:
        self.out.append({"b": self.b, "pkey": self.pkey, **cols})

    def close(self, depth: int) -> None:
        """End the nodes from ``depth`` down."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            above = self.stack[-1] if self.stack else None
            sums = dict(n_convs=node.n, conv_id=node.least)
            if node.skeleton:
                if node.ends:
                    self._list(node)
                self._row(kind=PART, path=self.path[:node.at * DIGIT], up=self.up, n_children=node.children, n_leaves=node.leaves,
                          saved=node.saved, length=node.length, cont=node.cont, **sums)
            else:
                if not node.children and not node.cont:
                    node.leaves = 1
                node.saved += (node.n - 1) * node.length
                own = node.least if node.at or not self.b else self.up
                for row in node.waiting:
                    self.out.append({**row, "parent": own})
                sums |= dict(n_children=node.children, n_leaves=node.leaves, saved=node.saved)
                row = {"kind": NODE, "b": self.b, "pkey": self.pkey, "depth": self.b * self.block + node.at,
                       "ends": node.hash.hexdigest() if node.hash else NOTHING, **sums}
                if above is None:
                    self._row(kind=ROOT, **sums) if self.b else self.out.append(row)
                elif above.skeleton:
                    self.out.append({**row, "path": self.path[:above.at * DIGIT]})
                else:
                    above.waiting.append(row)
                if above is not None:
                    above.children += 1
                    above.leaves += node.leaves
                    above.saved += node.saved
            if above is not None:
                above.n += node.n
                above.least = node.least if above.least is None else min(above.least, node.least)


def shard_tries(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Trie over ``rows`` (of schema ``ROWS``, stored): its nodes, and the totals of every lower block's root.

    Nodes: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``; totals: ``pkey, n_children, n_leaves, saved``.

    The driver sees ``SAMPLE`` paths per shard and sends the splitters to all
    tasks; a splitter has at most ``block`` digests.
    """
    spark = rows.sparkSession
    n_turns = rows.agg(F.sum(F.size("lens") + 1)).first()[0] or 0
    n = max(shuffle_partitions(spark), -(-n_turns // SHARD_TURNS))
    seen = rows.select("pkey", "path", "conv_id", "b").orderBy(F.xxhash64("conv_id", "b"), "conv_id", "b").limit(n * SAMPLE).collect()
    keys = sorted((r.pkey, r.path, r.conv_id) for r in seen)
    splitters = sorted({keys[k * len(keys) // n] for k in range(1, n)}) if keys else []
    sent = spark.sparkContext.broadcast(splitters)
    names = rows.columns

    def deal(batches):
        for b in batches:
            shard = [bisect_right(sent.value, key) for key in zip(*(b.column(c).to_pylist() for c in ("pkey", "path", "conv_id")), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard, pa.int32())], names=[*names, "shard"])

    schema = pa.schema([("kind", pa.int32()), ("b", pa.int64()), ("pkey", pa.string()), ("path", pa.string()),
                        *((c, pa.int64()) for c in "depth conv_id parent up n_convs n_children n_leaves saved length".split()),
                        ("cont", pa.bool_()), ("ends", pa.string()), ("part", pa.int64())])

    def walk(batches):
        now = None
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                for r in b.slice(k, 1000).to_pylist():
                    if now is None or now.shard != r["shard"]:
                        rest = now.out if now and now.close(0) is None else []
                        now = _Walk(r["shard"], sent.value, block)
                        now.out = rest
                    now.add(r)
                if len(now.out) > 5000:
                    yield pa.RecordBatch.from_pylist(now.out, schema)
                    now.out.clear()
        if now:
            now.close(0)
            yield pa.RecordBatch.from_pylist(now.out, schema)

    dealt = rows.mapInArrow(deal, ROWS + ", shard int").repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "pkey", "path", "conv_id")
    out = stored(dealt.mapInArrow(walk, PARTS), "trie-parts")

    # ---- the skeleton: parts added up per node, then along the paths to the root
    key, above = ["pkey", "path"], F.substring("path", F.lit(1), F.length("path") - DIGIT)
    bone = out.where(F.col("kind") == PART).groupBy("b", *key).agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("up").alias("up"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("length").alias("length"), F.max("cont").alias("cont"))
    bone = stored(bone, "trie-bone")
    kids = bone.where(F.col("path") != "").groupBy("pkey", above.alias("path")).agg(F.count(F.lit(1)).alias("kids"))
    bone = bone.join(kids, key, "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    leaf = ((F.col("n_children") == 0) & ~F.col("cont")).cast("long")
    own = bone.select("*", (F.col("n_leaves") + leaf).alias("l"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("length")).alias("s"))
    up_path = F.explode(F.transform(F.sequence(F.lit(0), F.expr(f"cast(length(path) div {DIGIT} as int)")),
                                    lambda j: F.substring("path", F.lit(1), j * DIGIT)))
    sums = own.select("pkey", up_path.alias("path"), "l", "s").groupBy(*key).agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved"))

    def listed(batches):
        now, h = None, None
        for b in batches:
            for pkey, path, ends in zip(*(b.column(c).to_pylist() for c in ("pkey", "path", "ends")), strict=True):
                if now != (pkey, path):
                    if now:
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, h.hexdigest())], names=["pkey", "path", "ends"])
                    now, h = (pkey, path), hashlib.sha256(ends.encode())
                else:
                    h.update(b"," + ends.encode())
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, h.hexdigest())], names=["pkey", "path", "ends"])

    lists = out.where(F.col("kind") == LIST).select(*key, "part", "ends").repartition(*key).sortWithinPartitions(*key, "part").select(
        *key, "ends").mapInArrow(listed, "pkey string, path string, ends string")
    bone = stored(bone.drop("n_leaves", "saved").join(sums, key).join(lists, key, "left").withColumns({
        "own": F.when((F.col("path") == "") & (F.col("b") > 0), F.col("up")).otherwise(F.col("conv_id")),
        "ends": F.coalesce("ends", F.lit(NOTHING)), "depth": F.col("b") * block + F.expr(f"length(path) div {DIGIT}")}), "trie-skeleton")

    size = ["n_convs", "n_children", "n_leaves", "saved"]
    shape = ["conv_id", "depth", F.col("parent").alias("parent_conv_id"), *size[:3], F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    parents = bone.select("pkey", "path", F.col("own").alias("parent"))
    parents = F.broadcast(parents) if bone.count() <= SMALL else parents
    whole = out.where(F.col("kind") == NODE)
    under = whole.where(F.col("path").isNotNull()).drop("parent").join(parents, key)
    joints = bone.where((F.col("b") == 0) | (F.col("path") != "")).withColumn(
        "path", F.when(F.col("path") != "", above)).join(parents, key, "left")  # the root finds no parent
    nodes = whole.where(F.col("path").isNull()).select(*shape).unionByName(under.select(*shape)).unionByName(joints.select(*shape))
    totals = out.where(F.col("kind") == ROOT).select("pkey", *size[1:]).unionByName(
        bone.where((F.col("b") > 0) & (F.col("path") == "")).select("pkey", *size[1:]))
    return nodes, totals


def trie(rows: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes of the prefix trie of ``rows(conv_id, place, digit, length)``; ``ids`` names all conversations.

    One row per distinct prefix: ``conv_id`` (least member), ``depth``,
    ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``,
    ``n_leaves`` (childless nodes below or itself), ``saved_tokens`` (sum below
    and itself of (members - 1) times the code points of the last text) and
    ``ends_sha256`` (digest of the comma-joined ids that end there, ascending).

    A conversation without turns is a member of the root alone. Without
    conversations there is no root either. The list of ids that end at one node
    is hashed in one stream, in parts, since its digest has to be; everything
    else of a frequent path is shared among the shards that hold it.
    """
    cut = blocks(rows, ids, block)
    zero = F.lit(0).cast("long")
    plain = {c: zero for c in ("x_children", "x_leaves", "x_saved")}
    if not cut.where(F.col("b") > 0).isEmpty():
        lower = cut.where(F.col("b") > 0)
        _, totals = shard_tries(stored(lower.withColumns(plain), "trie-lower"), block)
        first = lower.groupBy("pkey").agg(F.min("conv_id").alias("first"))  # the member that carries the block's totals
        met = spread_join(lower.select("conv_id", "b", "pkey"), totals.join(first, "pkey"), "pkey", "conv_id")
        here = F.col("first") == F.col("conv_id")
        mine = met.select("conv_id", "b", *[F.when(here, F.col(c)).otherwise(zero).alias(c) for c in ("n_children", "n_leaves", "saved")],
                          (-F.col("b")).alias("back"))
        below = running_total(mine, ["conv_id"], ["back"], {"l": "n_leaves", "s": "saved"})
        extra = below.select("conv_id", (F.col("b") - 1).alias("b"), F.col("n_children").alias("x_children"),
                             (F.col("l") + F.col("n_leaves")).alias("x_leaves"), (F.col("s") + F.col("saved")).alias("x_saved"))
        cut = stored(cut.join(extra, ["conv_id", "b"], "left").withColumns({c: F.coalesce(c, zero) for c in plain}), "trie-whole")
    else:
        cut = stored(cut.withColumns(plain), "trie-whole")
    return shard_tries(cut, block)[0]


def conversation_trie(convs: DataFrame, heads: int = 6, every: int = 100, block: int = BLOCK) -> DataFrame:
    """Trie of the table's conversations, each rebuilt on another's first turns.

    Conversation c takes the first h turns of ``c - c % every`` (all if it has
    fewer, none if it is absent) and then its own after the first h, where h is
    the unsigned CRC-32 of the decimal id modulo ``heads``. See ``turns`` for
    nulls and ties and ``trie`` for the result; further columns are ignored.
    """
    rows = stored(turns(convs), "trie-turns")
    head = F.crc32(F.col("conv_id").cast("string")) % heads
    return trie(*grafted(rows, head, every, heads - 1), block)
