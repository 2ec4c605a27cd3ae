"""Conversation prefix trie against a plain trie."""

import hashlib
import random
import zlib

import pytest

from revlens.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn int, role string, text string, size int, path string, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def dig(t):
    return hashlib.sha256(f"{len(t[0])}:{t[0]}{t[1]}".encode()).hexdigest()[:32]


def want(rows, rebuild=True):
    lists = {}
    for c, turn, role, text in rows:
        if c is not None:
            lists.setdefault(c, []).append((turn is not None, turn or 0, dig((role or "", text or "")), role or "", text or ""))
    lists = {c: [t[3:] for t in sorted(ts)] for c, ts in lists.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in lists}
        lists = {c: lists.get(c - c % 100, [])[:h[c]] + ts[h[c]:] for c, ts in lists.items()}
    nodes = {}
    for c, ts in lists.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        own = (len(nodes[p]) - 1) * len(p[-1][1]) if p else 0
        got = [below(k) for k in kids.get(p, [])]
        return (sum(g[0] for g in got) if got else 1), own + sum(g[1] for g in got)

    out = []
    for p, cs in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(lists[c]) == len(p)))
        out.append((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


EDGE = [(None, 0, "user", "lost"), (0, None, None, None), (0, 0, "user", "hi"), (0, 0, "user", "hi"), (0, 1, None, ""), (0, 2, "a", "x" * 100_000),
        (1, 3, "user", "é\U0001F600"), (101, 0, "user", "no base"), (101, 1, "user", "hi"), (205, 0, "u", "1:u"), (205, 1, "1", ":u")]


def test_rebuilt_conversations_and_edges(spark):
    df = frame(spark, EDGE)
    assert got(pt.prefix_trie(pt.rebuilt(pt.turn_lists(df)))) == want(EDGE)
    assert got(pt.prefix_trie(pt.turn_lists(df))) == want(EDGE, rebuild=False)
    assert pt.prefix_trie(pt.rebuilt(pt.turn_lists(df.limit(0)))).count() == 0


@pytest.mark.parametrize("shards", [1, 3, 17])
def test_any_number_of_shards_gives_one_trie(spark, shards, monkeypatch):
    monkeypatch.setattr(pt, "PACK", 4)
    rnd = random.Random(shards)
    rows = []
    for c in range(600):
        if c % 3 == 0:  # a third of all conversations are equal
            turns = [("system", "same"), ("user", "again"), ("assistant", "and again")]
        else:
            turns = [(rnd.choice("us"), rnd.choice(["a", "b", "longer", ""])) for _ in range(rnd.randrange(1, 6))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    assert got(pt.prefix_trie(pt.rebuilt(pt.turn_lists(frame(spark, rows))), shards)) == want(rows)
    assert got(pt.prefix_trie(pt.turn_lists(frame(spark, rows)), shards)) == want(rows, rebuild=False)
