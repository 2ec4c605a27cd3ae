"""N-gram Jaccard join by adaptive multi-match prefixes.

A document's set is its distinct word shingles; two documents link when ``100 * common >= threshold * union``.  Shingles
follow one order of the whole corpus: those that occur once in a task or whose count is small first, the frequent ones last,
each by hash.  With ``o`` shingles in common at least, the first ``|x| - o + l`` shingles of both sets share ``l`` or more.

* Every document takes its own ``l``: the one of least estimated cost, where reading a prefix costs its postings and
  verification costs the pairs that can reach ``l`` matches (postings / l).  A pair is verified from the smaller of its two
  ``l`` on.  A longer prefix thus has to show more matches.
* Documents of one set are one class from the start.  Within a posting list the member with the fewest rare shingles is
  the hub: every member is first verified against it, and what links is one component.  Only pairs of different
  components go on, by the size and position of their matches, until all lists are done: no list is turned into all pairs.
* Links are counted in full afterwards: in a component that the verified pairs do not fill, all pairs, block by block.
* The order and the hubs settle cost only; any order and any hub give the same links.

Sets are hashed to 64 bits (words by XXH3, mixed one after the other); classes are told apart by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, utf8, word_blocks, written
from .graph import components

TURN = np.uint64(0x9E3779B97F4A7C15)  # the golden ratio in 64 bits
ODD = np.uint64(0xBF58476D1CE4E5B9)   # an odd multiplier with mixed bits
HALF = np.uint64(29)
MOST = 16         # largest l
VERIFY = 256      # cost of a verification in postings: two sets travel for it
PACK_MB = 16      # prefixes in a bucket of posting lists, about
FREQUENT = 1 << 17  # shingles that are ordered last, at most (1 MB to every task); cost only
BLOCK = 512       # sets of a block whose pairs one task counts, about
BLOCK_MB = 4      # their size, about
SMALL = 16        # members of a list that is never called frequent


class _Words(dict):
    """Word -> 64-bit hash, bounded."""

    def __missing__(self, w):
        from xxhash import xxh3_64_intdigest
        if len(self) > 1 << 20:
            self.clear()
        h = self[w] = xxh3_64_intdigest(w)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> HALF)) * ODD
    return h ^ (h >> np.uint64(32))


def shingle_set(raw: bytes | None, words: int, cache: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one text (A-Z lower-cased); fewer words: the whole sequence."""
    cache = _Words() if cache is None else cache
    parts, tail = [], np.zeros(0, np.uint64)
    for block in word_blocks((raw or b"").lower()):
        w = np.concatenate([tail, np.fromiter(map(cache.__getitem__, block), np.uint64, len(block))])
        n = len(w) - words + 1
        if n > 0:
            h = np.full(n, words, np.uint64)
            for i in range(words):
                h = _mix((h + TURN) ^ w[i:i + n])
            parts.append(np.unique(h))
        tail = w[max(0, len(w) - words + 1):]
    if not parts:
        h = np.full(1, len(tail), np.uint64)
        for x in tail:
            h = _mix((h + TURN) ^ x)
        return h if len(tail) else tail
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def frequent_shingles(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """The most frequent shingles, sorted: counts over all documents, of the shingles that a task meets twice or more.

    A bounded estimate (``FREQUENT`` entries) that settles the order of shingles, not the result.
    """
    def count(batches):
        cache, held, size = _Words(), [], 0

        def out():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            u, n = u[n > 1], n[n > 1]
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["s", "n"])

        for b in batches:
            for raw in utf8(b.column(0)):
                x = shingle_set(raw, words, cache)
                if len(x):
                    held.append(x)
                    size += len(x)
                if size > 1 << 21:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    got = docs.select(col(text).cast("string").alias("t")).mapInArrow(count, "s long, n long") \
        .groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") > SMALL).orderBy(F.desc("n"), "s").limit(FREQUENT).select("s").toArrow()
    return np.sort(got.column("s").to_numpy().view(np.uint64))


def _needed(n, threshold: int):
    """Least overlap of a set of n with any partner that is not larger: ceil(threshold * n / 100)."""
    return (n * threshold + 99) // 100


def _sets(frequent, words: int, threshold: int):
    """Arrow: text -> (n, sig, rare, prefix): set size, 128-bit digest, shingles not frequent, the first shingles in order."""
    def run(a: pa.Array) -> pa.Array:
        from xxhash import xxh3_128_digest
        cache, hot, rows = _Words(), frequent.value, ([], [], [], [])
        for raw in utf8(a):
            x = shingle_set(raw, words, cache)
            late = np.zeros(len(x), bool)
            if len(hot) and len(x):
                late = hot[np.minimum(np.searchsorted(hot, x), len(hot) - 1)] == x
            order = np.concatenate([x[~late], x[late]])
            rows[0].append(len(x))
            rows[1].append(xxh3_128_digest(x.astype("<u8").tobytes()))
            rows[2].append(int(len(x) - late.sum()))
            rows[3].append(order[:len(x) - _needed(len(x), threshold) + MOST].astype("<u8").tobytes())
        return pa.StructArray.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.int32()),
                                           pa.array(rows[3], pa.binary())], names=["n", "sig", "rare", "prefix"])

    return F.arrow_udf("struct<n: int, sig: binary, rare: int, prefix: binary>")(run)


_PACK = "bucket int, s binary, cid binary, pos binary"


def _postings(buckets: int):
    """mapInArrow: (cid, prefix) -> postings by bucket of the shingle, as arrays."""
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                cid, prefix = b.column(0).slice(i, 2048).to_numpy(zero_copy_only=False), b.column(1).slice(i, 2048).to_pylist()
                n = np.array([len(p) // 8 for p in prefix])
                s = np.frombuffer(b"".join(prefix), "<u8")
                pos = (np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)).astype("<u4")
                who = np.repeat(cid, n).astype("<i8")
                own = (s % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(own, kind="stable")
                got, at = np.unique(own[order], return_index=True)
                ends = [*at[1:], len(own)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got), *(pa.array([x[order[f:t]].tobytes() for f, t in zip(at, ends)], pa.binary()) for x in (s, who, pos))],
                    names=["bucket", "s", "cid", "pos"])
    return run


def _shared(batches):
    """mapInArrow over packed postings sorted by bucket -> (s, cid, pos, df) of the shingles that several classes have."""
    held, now = [], None

    def out():
        s, cid, pos = (np.concatenate([np.frombuffer(h[i], t) for h in held]) for i, t in ((0, "<u8"), (1, "<i8"), (2, "<u4")))
        order = np.argsort(s, kind="stable")
        s = s[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        df = np.repeat(np.diff(np.r_[first, len(s)]), np.diff(np.r_[first, len(s)]))
        keep = df > 1
        return pa.RecordBatch.from_arrays([pa.array(s[keep].view(np.int64)), pa.array(cid[order][keep]), pa.array(pos[order][keep].astype(np.int32)),
                                           pa.array(df[keep])], names=["s", "cid", "pos", "df"])

    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(4))):
            if row[0] != now and held:
                yield out()
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield out()


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (u, v) of classes whose sets reach the threshold."""
    @F.arrow_udf("boolean")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= threshold * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    one = sets.select(F.col("cid").alias("u"), F.col("body").alias("x"))
    two = sets.select(F.col("cid").alias("v"), F.col("body").alias("y"))
    return pairs.select("u", "v").distinct().join(one, "u").join(two, "v").where(similar("x", "y")).select("u", "v")


def _bodies(docs: DataFrame, classes: DataFrame, need: DataFrame, words: int) -> DataFrame:
    """(cid, body): the whole sets of the classes ``need``, from the texts of the rows that stand for them."""
    def key(i):
        return F.col(i).isNull().alias("z"), F.coalesce(i, F.lit(0).cast("long")).alias("d")

    @F.arrow_udf("binary")
    def body(t: pa.Array) -> pa.Array:
        cache = _Words()
        return pa.array([shingle_set(x, words, cache).astype("<u8").tobytes() for x in utf8(t)], pa.binary())

    need = need.join(classes, "cid").select("cid", *key("doc_id"), "h")
    texts = docs.select(*key("doc_id"), F.xxhash64("t").alias("h"), "t").join(need, ["z", "d", "h"])
    # a repeated row stands for its class as often as it is there
    return texts.select("cid", body("t").alias("body")).groupBy("cid").agg(F.first("body").alias("body"))


def _counted(threshold: int):
    """mapInArrow over (root, a, b, part, cid, body) sorted by root, a, b -> (cid, links) of each pair of blocks."""
    def out(key, part, cid, body):
        part, cid = np.array(part), np.array(cid)
        sets = [np.frombuffer(x, "<u8") for x in body]
        n = np.array([len(x) for x in sets])
        word, at = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(n)
        starts, links, mark = ends - n, np.zeros(len(n), np.int64), np.zeros(len(word), np.int8)
        cut = int((part == 0).sum())
        alone = key[1] == key[2]  # a block with itself; of two blocks one may be empty
        for i in range(cut):
            j = i + 1 if alone else cut
            if j == len(n):
                break
            own = at[starts[i]:ends[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[at[starts[j]:]], starts[j:] - starts[j], dtype=np.int64)
            mark[own] = 0
            linked = 100 * both >= threshold * (n[i] + n[j:] - both)
            links[i] += linked.sum()
            links[j:] += linked
        return pa.RecordBatch.from_arrays([pa.array(cid[links > 0]), pa.array(links[links > 0])], names=["cid", "links"])

    def run(batches):
        held, now = [], None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6))):
                if row[:3] != now and held:
                    yield out(now, *zip(*held))
                    held = []
                now = row[:3]
                held.append(row[3:])
        if held:
            yield out(now, *zip(*held))
    return run


def _degrees(links: DataFrame, comp: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(cid, links): with how many other classes each class links, all pairs of a component counted.

    ``links`` hold enough pairs to connect the components.  In a component that they fill every class links with all
    others.  The classes of another one are dealt to blocks of at most about ``BLOCK`` sets and ``BLOCK_MB``, and every
    two blocks are compared in one task: a set is copied once a block, not once a pair.
    """
    comp = written(comp, "members")
    edges = links.join(comp, links.u == comp.cid).groupBy("root").agg(F.count(F.lit(1)).alias("e"))
    size = written(comp.groupBy("root").agg(F.count(F.lit(1)).alias("k")).join(edges, "root"), "sizes")
    full = comp.join(size.where("2 * e = k * (k - 1)"), "root").select("cid", (F.col("k") - 1).alias("links"))
    apart = written(comp.join(size.where("2 * e < k * (k - 1)").select("root", "k"), "root"), "open")
    held = written(sets.join(apart, "cid"), "open-sets")
    mb = held.groupBy("root").agg((F.sum(F.length("body")) / (BLOCK_MB << 20)).alias("mb"))
    dealt = written(apart.join(mb, "root").select("cid", F.ceil(F.greatest(F.col("k") / BLOCK, "mb")).cast("int").alias("blocks")), "blocks")
    held = held.join(dealt, "cid").withColumn("i", F.expr("cast(pmod(xxhash64(cid), blocks) as int)")) \
        .withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)")))
    two = held.select("root", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), (F.col("i") > F.col("j")).cast("int").alias("part"), "cid", "body")
    counted = two.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b", "part").mapInArrow(_counted(threshold), "cid long, links long")
    return full.unionByName(counted.groupBy("cid").agg(F.sum("links").alias("links")))


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, threshold: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, links (other classes whose sets reach the threshold), component_id.

    ``class_id`` numbers the distinct sets; ``component_id`` is the smallest doc_id that links reach, the document's own
    included.  Documents without words (null, empty and blank texts) have an empty set and link with nothing, not even
    each other.  Null ids are passed over when the smallest is sought; a component of null ids alone has a null
    component_id.  Repeated rows each come back.  An empty table gives an empty result.
    """
    if not 0 < threshold <= 100:
        raise ValueError("threshold must be 1 to 100 (per cent)")
    spark = docs.sparkSession
    docs = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("t"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, "t", words))
    rows = written(docs.select("doc_id", F.xxhash64("t").alias("h"), _sets(frequent, words, threshold)(F.col("t")).alias("g"))
                   .select("doc_id", "h", "g.*", F.monotonically_increasing_id().alias("cid")), "shingles")
    # a class is a set: its smallest row (by id, hash of the text, number) stands for it
    at = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h", "cid", "rare")
    classes = written(rows.where("n > 0").groupBy("sig", "n").agg(F.min(at).alias("at")).select("sig", "n", "at.doc_id", "at.h", "at.cid", "at.rare"), "classes")

    size = rows.agg(F.sum(F.length("prefix"))).first()[0] or 0
    buckets = max(1, size >> 20, 1) // PACK_MB + 1
    # the row that stands for a class was told apart by its number: one row per class
    packed = rows.select("cid", "prefix").join(classes.select("cid").hint("merge"), "cid").mapInArrow(_postings(buckets), _PACK)
    lists = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "s long, cid long, pos int, df long")
    base = written(lists, "postings").join(classes.select("cid", "n", "rare"), "cid")

    # l of a class: postings read + verifications, for prefixes of 1 to MOST matches against a partner of its own size
    first = F.col("n") - F.floor(_overlap("n", "n", threshold))
    cost = [F.sum(F.when(F.col("pos") < first + m, F.col("df") - 1).otherwise(0)) * (1 + VERIFY / m) for m in range(1, MOST + 1)]
    level = F.expr(f"{MOST + 1} - array_position(reverse(c), array_min(c))").cast("int")  # of equal costs the largest l: it proposes least
    chosen = base.groupBy("cid").agg(F.array(*cost).alias("c")).select("cid", level.alias("l"))
    shared = written(base.join(chosen, "cid"), "levels")

    # 1. every member of a list against its hub, once enough lists show the pair
    hub = written(shared.groupBy("s").agg(F.min(F.struct((F.col("rare") / F.col("n")).alias("r"), "cid", "n", "pos", "l")).alias("hub")), "hubs")
    enough = F.least(F.col("l").cast("long"), F.col("hub.l").cast("long"), F.floor(_overlap("n", "hub.n", threshold)))
    star = shared.join(hub, "s").where(F.col("cid") != F.col("hub.cid")) \
        .where(_possible("n", "hub.n", "pos", "hub.pos", "l", "hub.l", threshold)) \
        .groupBy(F.least("cid", "hub.cid").alias("u"), F.greatest("cid", "hub.cid").alias("v")) \
        .agg(F.count(F.lit(1)).alias("matches"), F.max(enough).alias("l")).where("matches >= l").select("u", "v")
    star = written(star, "star")

    # the sets of the classes that can reach their number of matches, from a second look at the texts
    able = shared.groupBy("cid").agg(F.count(F.lit(1)).alias("m"), F.max(F.least(F.col("l").cast("long"), F.expr(f"(n * {threshold} + 99) div 100"))).alias("l"))
    able = able.where("m >= l").select("cid").union(star.select("u")).union(star.select("v")).distinct()
    sets = written(_bodies(docs, classes, able, words), "sets")
    linked = written(_verified(star, sets, threshold), "star-links")

    # 2. what is still apart: a list's members outside its hub's component against all members of other components
    comp = components(linked)
    placed = written(shared.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")), "placed")
    main = placed.join(hub.select("s", F.col("hub.cid").alias("cid")), ["s", "cid"]).select("s", F.col("root").alias("main"))
    mixed = placed.join(main, "s")
    names = ["s", "cid", "n", "pos", "l", "root"]
    apart = mixed.where("root != main").select(*names)
    other = mixed.select("s", *[F.col(c).alias(f"{c}_2") for c in names[1:]], (F.col("root") == F.col("main")).alias("in_main"))
    once = F.col("in_main") | (F.col("cid") < F.col("cid_2"))  # two members outside the main component meet once
    pairs = apart.join(other, "s").where("root != root_2").where(once).where(_possible("n", "n_2", "pos", "pos_2", "l", "l_2", threshold))
    overlap = _overlap("n", "n_2", threshold)
    pairs = pairs.groupBy(F.least("cid", "cid_2").alias("u"), F.greatest("cid", "cid_2").alias("v")) \
        .agg(F.count(F.lit(1)).alias("matches"), F.max(F.least(F.col("l").cast("long"), F.col("l_2").cast("long"), F.floor(overlap))).alias("l")).where("matches >= l")
    pairs = written(pairs.join(star, ["u", "v"], "left_anti").select("u", "v"), "pairs")
    # a class may fall short of its own l and yet meet a partner of a smaller one
    late = pairs.select(F.explode(F.array("u", "v")).alias("cid")).distinct().join(sets, "cid", "left_anti")
    if not late.isEmpty():
        sets = sets.unionByName(written(_bodies(docs, classes, late, words), "late-sets"))
    links = written(linked.unionByName(_verified(pairs, sets, threshold)), "links")

    named = components(links).withColumnRenamed("node", "cid")
    degree = _degrees(links, named, sets, threshold)
    named = written(classes.select("sig", "n", "cid", "doc_id").join(named, "cid", "left").join(degree, "cid", "left")
                    .select("sig", "n", "cid", "doc_id", F.coalesce("root", "cid").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "components")
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "root").select("sig", "n", F.col("cid").alias("class_id"), "links", "component_id")
    return rows.select("doc_id", "n", "sig").join(named, ["sig", "n"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), "class_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _overlap(n: str, m: str, threshold: int):
    """Least overlap of two linked sets of n and m: ceil(threshold * (n + m) / (100 + threshold))."""
    return ((F.col(n) + F.col(m)) * threshold + (99 + threshold)).cast("long") / F.lit(100 + threshold)


def _possible(n, m, pos, pos2, level, level2, threshold):
    """A match that counts: sizes within the threshold, and both places within the prefix of l matches for these sizes."""
    o = F.floor(_overlap(n, m, threshold))
    ell = F.least(F.col(level).cast("long"), F.col(level2).cast("long"), o)
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * threshold
    return sizes & (F.col(pos) <= F.col(n) - o + ell - 1) & (F.col(pos2) <= F.col(m) - o + ell - 1)
