"""Exact dedup, SimHash near-duplicates, repeated strings: against brute force."""

import collections
import hashlib
import random
import re

import pytest
from xxhash import xxh64_intdigest

from revlens.llm import graph, pfp_dedup, radix_dedup, simhash

WS = re.compile("[\x20\x09-\x0D]+")


def exact_want(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[WS.sub(" ", t or "")].append(i)
    out = collections.Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        stays = 1
        for i in ids:
            kept = i == keep and stays == 1
            stays -= kept
            out[i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def test_exact_dedup_equals_brute_force(docs):
    got = collections.Counter(tuple(r) for r in radix_dedup.exact_dedup(docs).collect())
    assert got == exact_want([(r.doc_id, r.text) for r in docs.collect()])


def test_exact_dedup_edges(edge, empty):
    got = collections.Counter(tuple(r) for r in radix_dedup.exact_dedup(edge).collect())
    assert got == exact_want([(r.doc_id, r.text) for r in edge.collect()])
    assert radix_dedup.exact_dedup(empty).count() == 0


def test_radix_digits_split_late_differences(spark):
    rnd = random.Random(1)
    base = "".join(rnd.choice("ab") for _ in range(3000))
    rows = [(i, base[:k] + str(i % 3) + base[k:]) for i, k in enumerate([0, 63, 64, 65, 319, 320, 321, 2999] * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(tuple(r) for r in radix_dedup.exact_dedup(df).collect()) == exact_want(rows)


def plain_fingerprint(text, words=3):
    w = [x for x in WS.split("".join(c.lower() if c.isascii() else c for c in text or "")) if x]
    if not w:
        return 0
    grams = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    hs = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def reach(fps, distance=3):
    """Smallest fingerprint reachable, by all pairs."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def simhash_want(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = reach(fps)
    first = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            first[root[f]] = min(i, first.get(root[f], i))
    return collections.Counter((i, f, first.get(root[f])) for (i, _), f in zip(rows, fps))


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_simhash_equals_brute_force(which, request):
    df = request.getfixturevalue(which)
    got = collections.Counter((r.doc_id, r.fp & simhash.FULL, r.component_id) for r in simhash.simhash_components(df).collect())
    assert got == simhash_want([(r.doc_id, r.text) for r in df.collect()])


def test_simhash_keeps_one_row_of_each_component(edge, empty):
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    want = {k[2] for k in simhash_want(rows)}
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(w or -1 for w in want)
    assert simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("distance", [1, 3, 5])
def test_links_lose_nothing_in_oversized_groups(spark, distance):
    rnd = random.Random(distance)
    fps = set()
    for _ in range(4):  # families of hundreds that share all but few bits
        centre = rnd.getrandbits(64)
        low = rnd.randrange(56)
        fps |= {centre ^ sum(rnd.getrandbits(1) << (low + b) for b in range(8)) ^ (1 << rnd.randrange(64)) for _ in range(200)}
    fps |= {rnd.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for group in (64, 4096):
        links = simhash.links(df, distance, group)
        edges = [(r.u & simhash.FULL, r.v & simhash.FULL) for r in links.collect()]
        assert all((a ^ b).bit_count() <= distance for a, b in edges)
        got = {}
        for r in graph.components(links).collect():
            got.setdefault(r.root, set()).add(r.node & simhash.FULL)
        want = {}
        for f, root in reach(fps, distance).items():
            want.setdefault(root, set()).add(f)
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i + 1, i) for i in range(300)] + [(1000, 2000 + i) for i in range(300)] + [(5, 5), (7, None)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{2000 + i: 1000 for i in range(300)}, 1000: 1000}


def repeats_want(texts, length=200):
    bodies = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[p:p + length] for b in bodies for p in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        upto = 0
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[max(p, upto):p + length] = b"\1" * (p + length - max(p, upto))
                upto = p + length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def same_repeats(df, **options):
    rows = df.select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, *w) for r, w in zip(rows, repeats_want([r.text for r in rows])))
    assert collections.Counter(tuple(r) for r in pfp_dedup.repeat_report(df, **options).collect()) == want


@pytest.mark.parametrize("group", [20_000, 2])
def test_repeats_equal_brute_force(docs, group):
    same_repeats(docs, group=group)


@pytest.mark.parametrize("group", [20_000, 2])
def test_repeats_at_every_offset(spark, group):
    rnd = random.Random(3)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(600))
    rows = [(0, passage)]
    for i in range(1, 60):
        a, n = rnd.randrange(300), rnd.choice([198, 199, 200, 201, 250, 300])
        own = ["".join(rnd.choice("stuvwxyz ") for _ in range(rnd.randrange(150))) for _ in range(2)]
        rows.append((i, own[0] + passage[a:a + n] + own[1]))
    rows += [(100, "q" * 199), (101, "q" * 200), (102, "ab" * 400), (103, "é" * 150 + "x"), (104, None)]
    same_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group=group)


def test_repeats_edges(spark, edge, empty):
    small = edge.where("length(text) < 10000 or text is null")
    same_repeats(small)
    assert pfp_dedup.repeat_report(empty).count() == 0


def test_triggers_are_the_same_for_equal_windows_across_blocks(monkeypatch):
    rnd = random.Random(5)
    raw = bytes(rnd.randrange(97, 101) for _ in range(9000))

    def by_window(t, p0, p1):
        return {p: int(a) for a, x, y in zip(t, p0, p1) for p in range(x, y + 1)}

    whole = by_window(*pfp_dedup.triggers(raw))
    monkeypatch.setattr(pfp_dedup, "BLOCK", 1000)
    assert by_window(*pfp_dedup.triggers(raw)) == whole
    shifted = by_window(*pfp_dedup.triggers(b"zz" + raw))
    assert all(shifted[p + 2] == a + 2 for p, a in whole.items())
    assert sorted(whole) == list(range(9000 - 199)) and all(0 <= a - p < pfp_dedup.REACH for p, a in whole.items())
