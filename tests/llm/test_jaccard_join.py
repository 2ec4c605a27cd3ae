"""N-gram Jaccard join against all pairs."""

import random
import re

import pytest

from revlens.llm import jaccard_join as jj

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain_set(text, words=5):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(" ".join(w[i:i + words]) for i in range(len(w) - words + 1)) or (frozenset([" ".join(w)]) if w else frozenset())


def want(rows, words=5, threshold=80):
    sets = [plain_set(t, words) for _, t in rows]
    kinds = sorted({s for s in sets if s}, key=sorted)
    root = list(range(len(kinds)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(kinds):
        for j in range(i):
            b = kinds[j]
            if 100 * len(a & b) >= threshold * len(a | b):
                root[find(i)] = find(j)
    at = {s: find(i) for i, s in enumerate(kinds)}
    low = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            low[at[s]] = min(i, low.get(at[s], i))
    return sorted(((i, len(s), low.get(at[s]) if s else i) for (i, _), s in zip(rows, sets)), key=str)


def got(df, **options):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.jaccard_components(df, **options).collect()), key=str)


def test_components_equal_all_pairs(docs):
    assert got(docs) == want([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(edge, empty):
    assert got(edge) == want([(r.doc_id, r.text) for r in edge.collect()])
    assert got(empty) == []


def edited(rnd, words, k):
    w = list(words)
    for _ in range(k):
        w[rnd.randrange(len(w))] = f"n{rnd.randrange(10 ** 6)}"
    return w


@pytest.mark.parametrize("words,threshold", [(5, 80), (1, 60), (3, 95)])
def test_crowded_lists_lose_no_link(spark, words, threshold, monkeypatch):
    """Templates with borderline copies, passages shared by many, chains of copies, short texts of few words."""
    monkeypatch.setattr(jj, "SMALL", 3)
    rnd = random.Random(words)
    rows, n = [], 0

    def add(w):
        nonlocal n
        rows.append((n, " ".join(w)))
        n += 1

    for size in (20, 60, 200):
        base = [f"t{size}w{rnd.randrange(50)}" for _ in range(size)]
        for _ in range(80):
            add(edited(rnd, base, rnd.randrange(0, max(2, size // 15))))
    passage = [f"p{i}" for i in range(40)]
    for _ in range(100):
        own = [f"o{rnd.randrange(10 ** 6)}" for _ in range(rnd.randrange(0, 30))]
        add(own + passage if rnd.random() < 0.5 else passage + own)
    chain = [f"c{i}" for i in range(120)]
    for i in range(40):
        chain = chain[1:] + [f"c{120 + i}"]
        add(chain)
    for _ in range(100):
        add([rnd.choice("abc") for _ in range(rnd.randrange(0, 8))])
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, words=words, threshold=threshold) == want(rows, words, threshold)


@pytest.mark.parametrize("block", [1, 7, 512])  # 1: some blocks are empty
def test_links_count_every_pair_at_the_threshold(spark, monkeypatch, block):
    """Copies of one template link with each other, not only with the hub; a chain links with its neighbours; blocks of few sets."""
    monkeypatch.setattr(jj, "BLOCK", block)
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(edited(rnd, base, rnd.randrange(0, 5))) for _ in range(40)]
    texts += [" ".join(f"c{j}" for j in range(i, i + 100)) for i in range(0, 60, 2)]
    texts += ["one two three", "One two three", "four five", "", None] + [" ".join(["x", "y", "z", "u", "v", "w"] * 3)] * 2
    rows = list(enumerate(texts))
    sets = [plain_set(t) for t in texts]
    kinds = {s for s in sets if s}
    count = {s: sum(s != o and 100 * len(s & o) >= 80 * len(s | o) for o in kinds) for s in kinds}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    links = {r.doc_id: r.links for r in jj.jaccard_components(df).collect()}
    assert links == {i: count.get(s, 0) for i, s in enumerate(sets)}
    assert max(links.values()) > 20


def test_a_set_does_not_depend_on_blocks(monkeypatch):
    raw = " ".join(f"w{i % 700}" for i in range(5000)).encode()
    whole = jj.shingle_set(raw, 5)
    assert len(whole) == len(plain_set(raw.decode()))
    blocks = jj.word_blocks
    monkeypatch.setattr(jj, "word_blocks", lambda r: blocks(r, 100))
    assert list(jj.shingle_set(raw, 5)) == list(whole)
