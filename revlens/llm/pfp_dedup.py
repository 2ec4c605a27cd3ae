"""Suffix-array dedup of repeated byte strings by prefix-free parsing.

Every byte that lies in a string of ``LENGTH`` bytes that starts anywhere else too is removed.

A rolling hash over ``TRIGGER`` bytes places the triggers: the trigger of a window of ``LENGTH`` bytes is the
position with the smallest hash among its first ``REACH`` ones (the last of equals), so equal windows have
their triggers at the same place, wherever they stand.  Consecutive triggers cut a text into phrases:
the windows of one trigger start in the phrase before it and run on into the parse after it.

1.  The content that all windows of a trigger share is counted over the corpus; a trigger whose content
    occurs once cannot lie in a repeat, and drops out with all its windows.
2.  The other triggers meet by that content, each with its phrase and the parse that follows.  The phrase
    suffixes and the parse suffixes are sorted; their neighbours' common lengths (the two suffix
    arrays with their LCP) name each suffix of g bytes and each continuation of ``LENGTH - g`` bytes, and
    the pair of names is the window's place in the order of the corpus: windows with one name
    are equal byte for byte.
3.  The repeated windows come back to their texts, which are cut.

Equal texts are handled once by a 128-bit digest.  A content that more than ``group`` triggers share is not
gathered: its windows are hashed to 128 bits one by one and counted by a partial aggregate, so a
passage in any share of the corpus loads no task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, written

LENGTH = 200     # bytes of a repeat
REACH = 128      # a power of two: places a trigger is sought in
TRIGGER = 16     # bytes of the rolling hash
SHARED = LENGTH - REACH + 1
BLOCK = 1 << 20
_LOW = np.uint64(0xFFFFFFFF)
_ODD = 0x9E3779B97F4A7C15


def triggers(raw: bytes):
    """-> (trigger, first window start, last window start) of a text, ``t, p0, p1``; none if it is shorter than a window."""
    windows = len(raw) - LENGTH + 1
    ts, lows, highs = [], [], []
    for at in range(0, max(windows, 0), BLOCK):
        n = min(BLOCK, windows - at)
        h = np.frombuffer(raw, np.uint8, n + REACH - 1 + TRIGGER - 1, at).astype(np.uint64) + np.uint64(1)
        step, power = 1, _ODD
        while step < TRIGGER:
            h = h[:-step] * np.uint64(power) + h[step:]
            step, power = 2 * step, power * power % (1 << 64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        low = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        step = 1
        while step < REACH:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        t = (_LOW - (low & _LOW)).astype(np.int64) + at
        cut = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        ts.append(t[cut])
        lows.append(cut + at)
        highs.append(np.append(cut[1:], n) - 1 + at)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(ts or none), np.concatenate(lows or none), np.concatenate(highs or none)


def _shared(raw: bytes, t) -> np.ndarray:
    from xxhash import xxh3_64_intdigest as xx
    return np.array([xx(raw[i:i + SHARED]) for i in t.tolist()], np.uint64).view(np.int64)


def _places(a, b):
    """One mixed 64-bit number per (text, place)."""
    h = (a.view(np.uint64) + b.astype(np.uint64) * np.uint64(_ODD))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(33))).view(np.int64)


# a trigger in one long: place, and how far its windows start before it (first and last, below 256)
def _pack(t, p0, p1):
    return (t << 16) | ((t - p1) << 8) | (t - p0)


def _parse(batches):
    """mapInArrow (body, t1) -> (shared, place, trigger, t1): every trigger of every text."""
    for b in batches:
        bodies, own = b.column(0).to_pylist(), b.column(1).to_numpy()
        rows, size = [], 0
        for raw, t1 in zip(bodies, own):
            t, p0, p1 = triggers(raw)
            if len(t):
                ids = np.full(len(t), t1, np.int64)
                rows.append((_shared(raw, t), _places(ids, p0), _pack(t, p0, p1), ids))
                size += len(t)
            if size > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], names=["shared", "place", "trigger", "t1"])
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], names=["shared", "place", "trigger", "t1"])


def _contexts(batches):
    """mapInArrow (body, t1, t2, triggers) -> (shared, t1, t2, trigger, context): the bytes of all windows of a trigger."""
    for b in batches:
        bodies, t1, t2 = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
        for k, (raw, got) in enumerate(zip(bodies, b.column(3).to_pylist())):
            got = np.array(got, np.int64)
            for i in range(0, len(got), 10_000):
                part = got[i:i + 10_000]
                t, g0, g1 = part >> 16, (part >> 8) & 255, part & 255
                cut = [raw[x:y] for x, y in zip((t - g1).tolist(), (t - g0 + LENGTH).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_shared(raw, t)), pa.array(np.full(len(t), t1[k])), pa.array(np.full(len(t), t2[k])), pa.array(part), pa.array(cut, pa.binary())],
                    names=["shared", "t1", "t2", "trigger", "context"])


def _suffix_order(rows):
    """Rows of bytes -> (sorted order, common length of each row with the one before it in that order)."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    s = rows[order]
    same = s[1:] == s[:-1]
    lcp = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    return order, np.append(0, lcp)


def repeated_windows(t, g0, g1, contexts: list[bytes]):
    """Flags (row, g): the window that starts g bytes before the row's trigger equals one of another row."""
    n = len(t)
    left, right = np.zeros((n, REACH), np.uint8), np.zeros((n, LENGTH), np.uint8)
    for r, c in enumerate(contexts):
        a = np.frombuffer(c, np.uint8)
        left[r, :g1[r]] = a[:g1[r]][::-1]
        right[r, :len(a) - g1[r]] = a[g1[r]:]
    lo, ll = _suffix_order(left)     # phrase suffixes
    ro, rl = _suffix_order(right)    # parse suffixes
    flags = np.zeros((n, REACH), bool)
    name_l, name_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for g in range(int(g0.min()), int(g1.max()) + 1):
        use = np.flatnonzero((g0 <= g) & (g <= g1))
        if len(use) < 2:
            continue
        name_l[lo] = np.cumsum(ll < g)
        name_r[ro] = np.cumsum(rl < LENGTH - g)
        name = name_l[use] * (n + 1) + name_r[use]
        order = np.argsort(name)
        s = name[order]
        twin = s[1:] == s[:-1]
        flags[use[order], g] = np.append(False, twin) | np.append(twin, False)
    return flags


def _flagged(t1, t2, t, flags):
    """Runs of flagged windows: (t1, t2, first, last) start positions."""
    wide = np.zeros((len(t), REACH + 2), np.int8)
    wide[:, 1:-1] = flags
    edge = np.diff(wide, axis=1)
    r, g = np.nonzero(edge == 1)
    _, h = np.nonzero(edge == -1)  # the run is g .. h - 1
    return pa.RecordBatch.from_arrays([pa.array(t1[r]), pa.array(t2[r]), pa.array(t[r] - h + 1), pa.array(t[r] - g)], names=["t1", "t2", "first", "last"])


def _compare(rows: int):
    """mapInArrow over contexts sorted by (shared, t1, t2, trigger): runs of repeated windows.

    Whole groups of one shared content are compared, some thousand rows at a time.
    """
    def run(batches):
        held = None

        def done(cols):
            shared, t1, t2, trig, ctx = cols
            new = np.append(True, (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1]) | (trig[1:] != trig[:-1]))
            first = np.append(True, shared[1:] != shared[:-1])
            new |= first
            group = np.cumsum(first) - 1
            use = np.flatnonzero(new & (np.bincount(group[new])[group] > 1))
            if len(use):
                t, g0, g1 = trig[use] >> 16, (trig[use] >> 8) & 255, trig[use] & 255
                yield _flagged(t1[use], t2[use], t, repeated_windows(t, g0, g1, [ctx[i] for i in use.tolist()]))

        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(4)] + [b.column(4).to_pylist()]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held[:4], cols[:4])] + [held[4] + cols[4]]
            held = cols
            if len(cols[0]) >= rows:
                edge = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
                if len(edge):
                    e = int(edge[-1])
                    yield from done([x[:e] for x in cols])
                    held = [x[e:] for x in cols]
        if held is not None and len(held[0]):
            yield from done(held)
    return run


def _hot_windows(batches):
    """mapInArrow (body, t1, t2, triggers) -> (w1, w2, t1, t2, place): every window of the triggers, hashed to 128 bits."""
    from xxhash import xxh3_128_digest as xx
    for b in batches:
        bodies, t1, t2 = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
        for k, (raw, got) in enumerate(zip(bodies, b.column(3).to_pylist())):
            for i in range(0, len(got), 500):
                p = np.concatenate([np.arange((x >> 16) - (x & 255), (x >> 16) - ((x >> 8) & 255) + 1) for x in got[i:i + 500]])
                h = np.frombuffer(b"".join([xx(raw[j:j + LENGTH]) for j in p.tolist()]), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(np.full(len(p), t1[k])),
                                                  pa.array(np.full(len(p), t2[k])), pa.array(p)], names=["w1", "w2", "t1", "t2", "place"])


def cut(raw: bytes, runs) -> tuple[int, int, bytes]:
    """Remove the bytes of all windows that start in ``runs`` of (first, last): (bytes removed, maximal removed runs, the rest)."""
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, [a for a, _ in runs], 1)
    np.add.at(edge, [b + LENGTH for _, b in runs], -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=np.int8(0)) == 1))
    return int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def _cut_texts(batches):
    """mapInArrow (body, t1, t2, runs) -> (t1, t2, removed, spans, kept)."""
    for b in batches:
        got = [cut(raw, [(r["first"], r["last"]) for r in runs]) for raw, runs in zip(b.column(0).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
                                          pa.array([g[2] for g in got], pa.binary())], names=["t1", "t2", "removed", "spans", "kept"])


def kept_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", group: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """-> (documents, texts).

    documents: doc_id, t1, t2 (128 bits that name the text), n_bytes, sha (of the whole text), copies.
    texts: t1, t2, removed, spans, kept (bytes left), for single texts from which something is removed; a text
    with copies of 200 bytes or more goes whole.

    Null texts are empty; a text below 200 bytes loses nothing; repeated rows are copies; an empty table
    gives an empty result.  ``group`` bounds the triggers compared in one task, not the result.
    """
    body = F.coalesce(col(text).cast("string"), F.lit("")).cast("binary")
    d = docs.select(col(doc_id).alias("doc_id"), body.alias("body")).select(
        "doc_id", "body", F.xxhash64("body").alias("t1"), F.xxhash64(F.lit(1), "body").alias("t2"))
    small = written(d.select("doc_id", "t1", "t2", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("sha")), "pfp-documents")
    names = small.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"))
    long_enough = d.where(F.octet_length("body") >= LENGTH)
    parsed = long_enough.select("body", "t1").mapInArrow(_parse, "shared long, place long, trigger long, t1 long")
    again = written(parsed.groupBy("shared").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.count(F.lit(1)).alias("n"))
                    .where("a != b").select("shared", (F.col("n") > group).alias("hot")), "pfp-shared")
    found = parsed.select("shared", "trigger", "t1").join(again, "shared").groupBy("t1").agg(
        F.array_sort(F.collect_set(F.when(~F.col("hot"), F.col("trigger")))).alias("triggers"),
        F.array_sort(F.collect_set(F.when(F.col("hot"), F.col("trigger")))).alias("hot"))
    picks = found.join(names, "t1")
    b, p = long_enough.alias("b"), picks.alias("p")
    texts = written(b.join(p, (F.col("b.t1") == F.col("p.t1")) & (F.col("b.t2") == F.col("p.t2")) & F.col("b.doc_id").eqNullSafe(F.col("p.rep")))
                    .select("b.body", "b.t1", "b.t2", "p.copies", "p.triggers", "p.hot"), "pfp-texts")
    contexts = texts.where("size(triggers) > 0").select("body", "t1", "t2", "triggers").mapInArrow(
        _contexts, "shared long, t1 long, t2 long, trigger long, context binary")
    runs = contexts.repartition("shared").sortWithinPartitions("shared", "t1", "t2", "trigger") \
        .mapInArrow(_compare(8192), "t1 long, t2 long, first long, last long")
    hot = texts.where("size(hot) > 0").select("body", "t1", "t2", "hot").mapInArrow(_hot_windows, "w1 long, w2 long, t1 long, t2 long, place long")
    place = F.xxhash64("t1", "t2", "place")
    twice = hot.groupBy("w1", "w2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("w1", "w2")
    runs = runs.union(hot.join(twice, ["w1", "w2"]).select("t1", "t2", F.col("place").alias("first"), F.col("place").alias("last")))
    runs = runs.groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    own = texts.where("copies = 1").select("body", "t1", "t2").join(runs, ["t1", "t2"]).select("body", "t1", "t2", "runs")
    kept = own.mapInArrow(_cut_texts, "t1 long, t2 long, removed long, spans long, kept binary")
    return small.join(names.select("t1", "t2", "copies"), ["t1", "t2"]), kept


def repeat_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    small, kept = kept_texts(docs, **options)
    kept = kept.select("t1", "t2", "removed", "spans", F.sha2("kept", 256).alias("kept_sha"))
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    zero = F.lit(0).cast("long")
    return small.join(kept, ["t1", "t2"], "left").select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("spans", zero)).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"))
