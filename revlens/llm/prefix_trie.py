"""Conversation prefix trie by a splitter skeleton.

A conversation is a path: a 16-byte digest (the head of SHA-256) per turn of its role and text.  Paths sort as byte
strings, so the members of a node (the conversations that start with its path) are neighbours.

1. Paths are range-partitioned by (path, conv_id); runs of one path are packed into rows of at most ``PACK`` ids, so
   equal conversations, however many, cost little further on.
2. Splitters cut the order of paths into shards.  They come from a bounded sample, which settles the balance and not
   the result.  The trie of the splitters' prefixes (the skeleton) is broadcast: at most ``splitters * DEPTH`` nodes.
3. A node whose members lie on both sides of a splitter is a prefix of it, hence in the skeleton.  All other nodes are
   finished by their shard, in one pass over its sorted paths with a stack as deep as the path.
4. Skeleton nodes leave a partial row per shard; these are reduced, and then summed over the skeleton's subtrees.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, written

WIDTH = 16     # bytes of a turn's digest
PACK = 65_536  # ids in a packed row
DEPTH = 256    # turns of a splitter
NONE = hashlib.sha256(b"").hexdigest()


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` -> a row per conversation: conv_id, turns (array of dig, len) in order of turn.

    Null turns come first; equal turn numbers follow by digest; null role or text counts as empty.
    Rows without a conv_id belong to no conversation and are dropped.  Texts do not leave the scan.
    """
    role, text = (F.coalesce(col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    dig = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH)
    rows = conversations.where(col("conv_id").isNotNull()).select(
        col("conv_id").cast("long").alias("conv_id"),
        F.struct(col("turn").isNotNull().alias("known"), F.coalesce(col("turn").cast("long"), F.lit(0).cast("long")).alias("turn"),
                 dig.alias("dig"), F.length(text).alias("len")).alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["dig"].alias("dig"), t["len"].alias("len")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(lists: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """Each conversation with its first h turns replaced by those of conversation c - c % family; h = crc32(c) % most."""
    c = lists.withColumn("base", F.col("conv_id") - F.col("conv_id") % family) \
        .withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    b = lists.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    head = F.when(F.col("head").isNotNull(), F.expr("slice(head, 1, h)")).otherwise(F.expr("slice(turns, 1, 0)"))
    return c.join(b, "base", "left").select("conv_id", F.concat(head, own).alias("turns"))


def _paths(lists: DataFrame) -> DataFrame:
    return lists.select(F.unhex(F.array_join(F.transform("turns", lambda t: t["dig"]), "")).alias("path"),
                        F.transform("turns", lambda t: t["len"]).alias("lens"), "conv_id")


def _pack(batches):
    """Rows sorted by (path, conv_id) -> (path, lens, at, n, ids): the ids of a path, comma-joined, in packs."""
    out, now, lens, ids = [], None, None, []

    def close():
        if ids:
            out.append((now, lens, ids[0], len(ids), ",".join(map(str, ids))))

    def batch():
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.int64()),
                                           pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())], names=["path", "lens", "at", "n", "ids"])

    for b in batches:
        for p, ln, c in zip(*(b.column(i).to_pylist() for i in range(3))):
            if p != now or len(ids) == PACK:
                close()
                now, lens, ids = p, ln, []
                if len(out) >= 1024:
                    yield batch()
                    out = []
            ids.append(c)
    close()
    if out:
        yield batch()


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their start."""
    n = min(len(a), len(b)) // WIDTH
    if a[:n * WIDTH] == b[:n * WIDTH]:
        return n
    lo, hi = 0, n
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid * WIDTH] == b[:mid * WIDTH] else (lo, mid)
    return lo


def splitters(packed: DataFrame, shards: int, per_shard: int = 16) -> list[bytes]:
    """At most ``shards - 1`` splitters from a sample of ``shards * per_shard`` packed rows, each cut after the turn that
    tells it from its predecessor in the sample, and at ``DEPTH`` turns."""
    rows = packed.select(F.substring("path", 1, WIDTH * DEPTH).alias("p"), F.xxhash64("path", "at").alias("o")) \
        .orderBy("o").limit(shards * per_shard).collect()
    ps = sorted({bytes(r.p) for r in rows})
    cut = {ps[i][:WIDTH * (_common(ps[i - 1], ps[i]) + 1)] for i in range(per_shard, len(ps), per_shard)}
    return sorted(cut)[:shards - 1]


def skeleton(cuts: list[bytes]) -> dict[bytes, int]:
    """The prefixes of the splitters, numbered; the root (the empty path) is 0."""
    paths = {b""} | {c[:k] for c in cuts for k in range(WIDTH, len(c) + 1, WIDTH)}
    return {p: i for i, p in enumerate(sorted(paths))}


_NODE = "skel int, parent int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string, len long"


def _shard(known: dict[bytes, int]):
    """mapInArrow over rows sorted by (shard, path, at): finished nodes, and partial rows of skeleton nodes.

    On the stack lies a node per turn of the current path.  A node holds the rows of its closed children until it is
    closed itself, for only then their parent's smallest member is known; children of a skeleton node carry its number.
    """
    names = [c.split()[0] for c in _NODE.split(", ")]

    class Node:
        __slots__ = ("path", "skel", "low", "n", "kids", "leaves", "saved", "sha", "len", "held")

        def __init__(self, path, ln):
            self.path, self.len, self.skel = path, ln, known.get(path, -1)
            self.low, self.n, self.kids, self.leaves, self.saved, self.sha, self.held = None, 0, 0, 0, 0, None, []

    def run(batches):
        out, stack, last = [], [], None

        def close():
            x = stack.pop()
            ends = x.sha.hexdigest() if x.sha else NONE
            depth = len(x.path) // WIDTH
            out.extend((-1, -1, *r[:2], x.low, *r[2:]) for r in x.held)
            up = stack[-1] if stack else None
            if up is not None:
                up.n, up.low = up.n + x.n, x.low if up.low is None else min(up.low, x.low)
            if x.skel >= 0:
                out.append((x.skel, -1, x.low, depth, None, x.n, x.kids, x.leaves, x.saved, ends if x.sha else None, x.len))
                return
            own = (x.n - 1) * x.len + x.saved
            leaves = x.leaves if x.kids else 1
            up.kids, up.leaves, up.saved = up.kids + 1, up.leaves + leaves, up.saved + own
            row = (x.low, depth, x.n, x.kids, leaves, own, ends, x.len)
            if up.skel >= 0:
                out.append((-1, up.skel, *row[:2], None, *row[2:]))
            else:
                up.held.append(row)

        def flush():
            cols = list(zip(*out))
            types = [pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for b in batches:
            for shard, path, lens, at, n, ids in zip(*(b.column(i).to_pylist() for i in range(6))):
                if shard != last:
                    while stack:
                        close()
                    last = shard
                    stack.append(Node(b"", 0))
                keep = _common(stack[-1].path, path)
                while len(stack) - 1 > keep:
                    close()
                for d in range(len(stack), len(path) // WIDTH + 1):
                    stack.append(Node(path[:d * WIDTH], lens[d - 1]))
                top = stack[-1]
                top.n, top.low = top.n + n, at if top.low is None else min(top.low, at)
                if top.sha is None:
                    top.sha = hashlib.sha256(ids.encode())
                else:
                    top.sha.update(b"," + ids.encode())
                if len(out) >= 4096:
                    yield flush()
                    out.clear()
        while stack:
            close()
        if out:
            yield flush()
    return run


def prefix_trie(lists: DataFrame, shards: int | None = None) -> DataFrame:
    """``(conv_id, turns)`` of :func:`turn_lists` or :func:`rebuilt` -> a row per node of the trie of all conversations:

    conv_id (smallest member), depth, parent_conv_id (the parent's; root: null), n_convs (members), n_children, n_leaves
    (childless nodes below, the node itself if childless), saved_tokens (over the subtree, (n_convs - 1) times the code
    points of the node's text), ends_sha256 (of the ids that end there, ascending, comma-joined).

    The root stands for the empty path, of which every conversation is a member, also one without turns.  Without
    conversations there is no node.  ``shards`` (default: ``spark.sql.shuffle.partitions``, 4,096 at most) settles cost only.
    A conversation must fit in a task; the ids of equal conversations pass one task in packed rows, as their hash asks.
    """
    spark = lists.sparkSession
    conf = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or max(2, min(conf, 4096))
    paths = _paths(lists).repartitionByRange(max(shards, conf), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    packed = written(paths.mapInArrow(_pack, "path binary, lens array<int>, at long, n long, ids string"), "paths")
    cuts = splitters(packed, shards)
    known = skeleton(cuts)
    number = spark.sparkContext.broadcast(cuts)

    @F.arrow_udf("int")
    def shard_of(p: pa.Array) -> pa.Array:
        return pa.array([bisect_right(number.value, x) for x in p.to_pylist()], pa.int32())

    order = ["shard", "path", "at"]
    rows = packed.withColumn("shard", shard_of("path")).select("shard", "path", "lens", "at", "n", "ids") \
        .repartition(shards, "shard").sortWithinPartitions(*order)
    nodes = written(rows.mapInArrow(_shard(known), _NODE), "nodes")

    own = nodes.where("skel >= 0").groupBy("skel").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("kids"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"), F.max("len").alias("len"))
    # the skeleton's own shape: every node with its ancestors, itself included
    up = [(i, known[p[:k]], k == len(p) - WIDTH) for p, i in known.items() for k in range(0, len(p) + 1, WIDTH)]
    up = spark.createDataFrame(up, "skel int, top int, direct boolean")
    kids = up.where("direct").groupBy(F.col("top").alias("skel")).agg(F.count(F.lit(1)).alias("more"))
    own = own.join(kids, "skel", "left").withColumn("n_children", F.col("kids") + F.coalesce("more", F.lit(0)))
    below = own.select("skel", F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).alias("leaves"),
                       (F.col("saved") + (F.col("n_convs") - 1) * F.col("len")).alias("saved"))
    total = below.join(up, "skel").groupBy(F.col("top").alias("skel")).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    top = written(own.drop("leaves", "saved").join(total, "skel"), "skeleton")  # at most splitters * DEPTH rows
    parents = top.select(F.col("skel").alias("parent"), F.col("conv_id").alias("parent_low"))
    direct = up.where("direct").select("skel", F.col("top").alias("parent")).join(F.broadcast(parents), "parent")
    shape = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    skel = top.join(direct, "skel", "left").select("conv_id", "depth", F.col("parent_low").alias("parent_conv_id"), "n_convs", "n_children",
                                                   "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"))
    local = nodes.where("skel < 0").join(F.broadcast(parents), "parent", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "parent_low").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
    return skel.select(*shape).unionByName(local.select(*shape))
