"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints within ``distance`` bits are cut into ``distance // 2 + 1`` segments, so that one
segment differs by at most one bit.  Each fingerprint is indexed under every segment value with one
bit removed (a wildcard): 64 variants for 64 bits, whatever the number of segments.  An equality
join of the variants (rows of one variant brought together and sorted) proposes pairs, and the
whole fingerprints are compared.

Distinct fingerprints are indexed once, so copies cost nothing.  Inside a variant a spanning forest
of the verified links is emitted, never all pairs.  A variant shared by more than ``group`` distinct
fingerprints is not compared in one task: its members go to a next level, where the bits still
free are cut into two segments with one-wildcard variants again.  As each level fixes about half
of the free bits, a group can hold at most 2**free fingerprints, and the levels end: no link is lost
and no group is unbounded.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, packed, unpacked, utf8, word_blocks, written
from .graph import components

SEED = 42
FULL = (1 << 64) - 1


def fingerprint_bytes(raw: bytes | None, words: int = 3) -> int:
    """64-bit SimHash of one text: word shingles, repeats included, hashed by XXH64 with seed 42.

    A bit is set if over half of the hashes have it.  Fewer words than a shingle: the whole
    sequence is the one shingle; no word (null, empty, white space): 0.
    """
    from xxhash import xxh64_intdigest as xx

    if not raw:
        return 0
    ones, n, tail = np.zeros(64, np.int64), 0, []
    for block in word_blocks(raw.lower()):
        w = tail + block
        if len(w) >= words:
            line = b" ".join(w)
            ends = list(accumulate(map(len, w), lambda a, b: a + b + 1))
            starts = [0, *(e + 1 for e in ends)]
            h = np.array([xx(line[a:b], SEED) for a, b in zip(starts, ends[words - 1:])], np.uint64)
            n += len(h)
            for i in range(0, len(h), 1 << 16):
                part = h[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        tail = w[max(0, len(w) - words + 1):]
    if not n:
        return xx(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(c, words: int = 3):
    """Column: SimHash of a text column as a signed long (the unsigned value's bits)."""
    @F.arrow_udf("long")
    def simhash(a: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_bytes(x, words) for x in utf8(a)], np.uint64).view(np.int64))

    return simhash(c)


def _segments(mask: int, parts: int) -> list[int]:
    """Masks of one-wildcard variants: each fixes one of ``parts`` segments of the bits not yet in ``mask`` but one bit."""
    free = [i for i in range(64) if not mask >> i & 1]
    out = []
    for s in range(parts):
        own = free[len(free) * s // parts:len(free) * (s + 1) // parts]
        whole = sum(1 << i for i in own)
        out += [mask | whole & ~(1 << i) for i in own]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants(parts: int):
    """mapInArrow: (mask, fp) -> (mask, value, fp), every variant of the next level."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                piece = b.slice(at, 4096)
                masks, fps = (piece.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                for m in np.unique(masks):
                    new = np.array([_signed(x) for x in _segments(int(m) & FULL, parts)], np.int64)
                    f = fps[masks == m]
                    fp, mk = np.repeat(f, len(new)), np.tile(new, len(f))
                    yield pa.RecordBatch.from_arrays([pa.array(mk), pa.array(fp & mk), pa.array(fp)],
                                                     names=["mask", "value", "fp"])
    return run


def _forest(fp, distance: int):
    """Spanning forest (child, parent) of the fingerprints within ``distance`` bits, by breadth-first search."""
    left, a, b = fp, [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = []
            for i in range(0, len(front), 256):
                near = np.bitwise_count(front[i:i + 256, None] ^ left[None, :]) <= distance
                hit = near.any(axis=0)
                if hit.any():
                    a.append(left[hit])
                    b.append(front[i:i + 256][near[:, hit].argmax(axis=0)])
                    reached.append(left[hit])
                    left = left[~hit]
                    if not len(left):
                        break
            front = np.concatenate(reached) if reached else left[:0]
    none = fp[:0]
    return (np.concatenate(a) if a else none), (np.concatenate(b) if b else none)


def _links(distance: int, group: int):
    """mapInArrow over rows sorted by (mask, value, fp): verified links, and the members of oversized variants.

    Holds at most ``group`` rows of a variant beside the batch.  Output: (u, v, mask): a link has no
    mask; a member of an oversized variant has its fingerprint in u and the variant's mask.
    """
    def run(batches):
        def out(u, v=None, mask=None):
            n = len(u)
            return pa.RecordBatch.from_arrays([
                pa.array(u.view(np.int64)), pa.nulls(n, pa.int64()) if v is None else pa.array(v.view(np.int64)),
                pa.nulls(n, pa.int64()) if mask is None else pa.array(np.full(n, mask, np.int64))], names=["u", "v", "mask"])

        keep = [np.zeros(0, np.int64)] * 3  # the rows of the last variant, which may go on
        deep = None                         # the variant that is passed on whole
        for b in batches:
            if not b.num_rows:
                continue
            mask, value, fp = (np.concatenate([k, b.column(i).to_numpy(zero_copy_only=False)]) for i, k in enumerate(keep))
            if deep is not None:
                same = (mask == deep[0]) & (value == deep[1])
                if same.any():
                    yield out(fp[same].view(np.uint64), mask=deep[0])
                    mask, value, fp = mask[~same], value[~same], fp[~same]
                if not len(fp):
                    keep = [mask, value, fp]
                    continue
                deep = None
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
            start = np.concatenate([[0], cut])
            last = start[-1]
            ends = cut
            yield from _runs(mask, fp, start[:-1], ends, distance, group, out)
            keep = [mask[last:], value[last:], fp[last:]]
            if len(keep[0]) > group:
                deep = int(keep[0][0]), int(keep[1][0])
                yield out(keep[2].view(np.uint64), mask=deep[0])
                keep = [x[:0] for x in keep]
        if len(keep[2]):
            yield from _runs(keep[0], keep[2], np.array([0]), np.array([len(keep[2])]), distance, group, out)
    return run


def _runs(mask, fp, starts, ends, distance, group, out):
    size = ends - starts
    two = starts[size == 2]
    if len(two):
        u, v = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
        ok = np.bitwise_count(u ^ v) <= distance
        if ok.any():
            yield out(u[ok], v[ok])
    more = np.flatnonzero(size > 2)
    us, vs = [], []
    for i in more:
        own = fp[starts[i]:ends[i]].view(np.uint64)
        if size[i] > group:
            yield out(own, mask=int(mask[starts[i]]))
        else:
            u, v = _forest(own, distance)
            us.append(u)
            vs.append(v)
    if us and sum(map(len, us)):
        yield out(np.concatenate(us), np.concatenate(vs))


def links(fps: DataFrame, distance: int = 3, group: int = 4096) -> DataFrame:
    """Distinct fingerprints (column ``fp``, long) -> links ``(u, v)`` that connect all within ``distance`` bits.

    Any two fingerprints within ``distance`` are joined by a path of the links; each link is
    within ``distance``.  ``group`` bounds the memory of a comparison, not the result.
    """
    if group < 64:
        raise ValueError("group must be 64 at least")
    todo, parts, found = fps.select(F.lit(0).cast("long").alias("mask"), "fp"), distance // 2 + 1, None
    while True:
        rows = (todo.mapInArrow(_variants(parts), "mask long, value long, fp long")
                .repartition("mask", "value").sortWithinPartitions("mask", "value", "fp"))
        out = written(rows.mapInArrow(_links(distance, group), "u long, v long, mask long"), "links")
        here = out.where("mask is null").select("u", "v")
        found = here if found is None else found.union(here)
        more = out.where("mask is not null").select("mask", F.col("u").alias("fp")).distinct()
        if more.isEmpty():
            return found
        todo = more


def simhash_components(docs: DataFrame, carry: list[str] | None = None, text: str = "text", doc_id: str = "doc_id",
                       words: int = 3, distance: int = 3, group: int = 4096) -> DataFrame:
    """One row per document: the ``carry`` columns (default: the id) in the struct ``row``, ``doc_id``,
    ``fp``, ``root`` (the component's smallest fingerprint), ``component_id`` (its smallest doc_id),
    ``members`` (rows of its documents that carry that doc_id).

    Null, empty and blank texts have fingerprint 0 and link like any other.  Null ids are passed over
    when the smallest is sought; a component of null ids alone has a null component_id.  Repeated rows
    each come back.  An empty table gives an empty result.
    """
    carry = [doc_id] if carry is None else carry
    rows = written(docs.select(packed(docs.select(*[col(c) for c in carry]), "row"), col(doc_id).alias("doc_id"),
                               fingerprint(col(text).cast("string"), words).alias("fp")), "simhash")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    named = fps.join(components(links(fps, distance, group)), fps.fp == F.col("node"), "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = written(named, "components")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest doc_id.

    Of several rows that carry that doc_id one stays.  Columns are those of ``docs``, whatever their names.
    """
    rows = simhash_components(docs, carry=docs.columns, **options)
    first = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = first.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("fp"))).where("n = 1")
    return one.select(*unpacked(docs.columns, "row"))
