"""Language ID, decontamination, lattice scores, secret scan: against plain Python."""

import binascii
import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import decontam, langid, lattice, queries, secrets


def crc(i, n):
    return binascii.crc32(("" if i is None else str(i)).encode()) % n


# ---- language ID

def test_language_is_right_on_held_out_documents(spark, sf, docs):
    got = queries.op1_language_id(spark, sf).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) for r in got) and len(held) > 30
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.accepted for r in got) >= 0.99 * len(got)


def test_language_edges(edge, empty):
    model = langid.fit(edge)
    rows = edge.select("doc_id", "text", langid.identify(F.col("text"), model).alias("g")).collect()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.g.lang in model.labels and 0 < r.g.score <= 1) if letters else (r.g.lang, r.g.score, r.g.accepted) == ("und", 0.0, False)
    kept = langid.accepted_documents(edge, model)
    assert kept.columns == edge.columns and kept.where(~F.col("text").rlike(r"\p{L}")).count() == 0
    assert langid.fit(empty) is None and langid.accepted_documents(empty, model).count() == 0
    assert langid.fit(edge.withColumn("lang", F.lit(None).cast("string"))) is None


FOREIGN = ["Helsingin rautatieasemalla odotti suuri joukko matkustajia, jotka olivat myöhästyneet junasta ja etsivät nyt lippuluukkua",
           "İstanbul'da yağmurlu bir günde çocuklar okuldan eve yürürken küçük bir kedi buldular ve onu beslediler",
           "Wczoraj wieczorem spacerowaliśmy długo nad brzegiem rzeki i rozmawialiśmy o przyszłości",
           "Вчера вечером мы долго гуляли по берегу реки и говорили о будущем", "Χθες το βράδυ περπατήσαμε πολλή ώρα δίπλα στο ποτάμι",
           "昨天晚上我们在河边散步了很久，谈论未来的计划"]


@pytest.mark.parametrize("langs", [("de", "en", "es", "fr"), ("de", "en")])
def test_unlearned_languages_and_noise_are_rejected(docs, langs):
    model = langid.fit(docs.where(F.col("lang").isin(*langs)))
    rnd = random.Random(1)
    noise = ["".join(rnd.choices(pool, k=300)) for pool in ("abcdefghijklmnopqrstuvwxyz ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")]
    assert model.labels == list(langs) and not any(model.predict(t.encode())[2] for t in FOREIGN + noise)
    known = [model.predict(r.text.encode())[2] for r in docs.where(F.col("lang").isin(*langs)).collect()]
    assert sum(known) >= 0.97 * len(known)


def test_counts_do_not_depend_on_blocks():
    raw = ("Ärger und Überfluss " * 500).encode()
    assert (langid.counts(raw) == langid.counts(raw, block=777)).all()
    assert langid.counts(raw).sum() == sum(len(raw) - n + 1 for n in langid.NGRAMS)


# ---- decontamination

def words_of(s):
    return re.findall(r"[^\W_]+", (s or "").lower())


def leaks_want(rows, items, window=20, similarity=0.8):
    """Spaced seeds as plain loops."""
    index = collections.defaultdict(set)
    toks = {i: words_of(t) for i, t in items}
    for i, w in toks.items():
        for m, mask in enumerate(decontam.MASKS):
            for j in range(len(w) - decontam.SPAN + 1):
                index[m, tuple(w[j + k] for k, c in enumerate(mask) if c == "1")].add((i, j))
    out = {}
    for d, t in rows:
        w = words_of(t)
        for m, mask in enumerate(decontam.MASKS):
            for a in range(len(w) - decontam.SPAN + 1):
                for i, j in index.get((m, tuple(w[a + k] for k, c in enumerate(mask) if c == "1")), ()):
                    x = toks[i]
                    same = [0 <= q + a - j < len(w) and w[q + a - j] == x[q] for q in range(len(x))]
                    n = min(window, len(x))
                    first, last = max(0, min(j, j + decontam.SPAN - n)), min(j, len(x) - n)
                    best = max(sum(same[s:s + n]) for s in range(first, max(first, last) + 1)) / n
                    if best >= similarity:
                        o = out.setdefault((d, i), [0, len(x), 0.0, 10**9])
                        o[0], o[2], o[3] = max(o[0], sum(same)), max(o[2], best), min(o[3], max(0, a - j))
    return {(*k, v[0], v[1], round(v[2], 9), v[3]) for k, v in out.items()}


def as_set(df):
    return {(r.doc_id, r.item_id, r.words_matched, r.item_words, round(r.overlap, 9), r.first_word) for r in df.collect()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_leaks_equal_brute_force(spark, sf, docs, broadcast):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = as_set(decontam.contaminated(docs, items, broadcast=broadcast))
    assert got == leaks_want([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]) and got


def test_substituted_passages_are_found_and_clean_texts_are_not(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randrange(25, 60)))) for i in range(60)]
    rows, planted = [], set()
    for i, t in items:
        w = t.split()
        for rate in (0.0, 0.05, 0.1):
            own = [rnd.choice(vocab) if rnd.random() < rate else x for x in w]
            rows.append((len(rows), " ".join(rnd.choices(vocab, k=40)) + ", " + " ".join(own).upper() + ". " + " ".join(rnd.choices(vocab, k=30))))
            planted.add((rows[-1][0], i))
    clean = [(1000 + k, " ".join(rnd.choices(vocab, k=120))) for k in range(200)]
    d = spark.createDataFrame(rows + clean, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(g in planted for g in got)
    assert len(got) >= 0.97 * len(planted)


def test_decontamination_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, "the cat sat on the mat and the dog ran away"), (1, "the cat sat on the mat and the dog ran away"),
                                   (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(edge, items).collect()} == {(1, 1), (2, 1), (11, 1)}
    kept = decontam.decontaminated(edge, items)
    assert kept.columns == edge.columns and kept.count() == edge.count() - 4
    assert decontam.contaminated(empty, items).count() == 0
    assert decontam.decontaminated(edge, items.limit(0)).count() == edge.count()


# ---- lattice scores

def pieces_of(rows, held):
    """Pieces weighed as the operator does it, from plain counts."""
    p = lattice.Pieces(open(lattice.VOCABULARY, "rb").read())
    c = collections.Counter(w for t, h in zip(rows, held) if not h for w in tokens(t))
    n = p.counts([w.decode("utf-8", "replace") for w in c], list(c.values())) if c else []
    p.weigh({i: x for i, x in enumerate(n) if x}, sum(not h for h in held))
    ids = {name: i for i, name in p.names.items()}
    for _ in range(lattice.PASSES):
        n = collections.Counter()
        for w, k in c.items():
            for piece, x in expected_of(p, "▁" + w.decode("utf-8", "replace")).items():
                n[ids[piece]] += k * x
        p.weigh(n, sum(not h for h in held))
    return p, c


def expected_of(p, s):
    """Expected piece counts of a word: forward and backward sums over all segmentations."""
    longest = max(map(len, p.plain))
    edges = [(j - 1, j, p.spelled(s[j - 1]), [f"<0x{b:02X}>" for b in s[j - 1].encode()]) for j in range(1, len(s) + 1)]
    edges += [(i, j, p.plain[s[i:j]], [s[i:j]]) for j in range(1, len(s) + 1) for i in range(max(0, j - longest), j) if s[i:j] in p.plain]
    edges.sort(key=lambda e: e[1])
    fore, back = [0.0] + [-math.inf] * len(s), [-math.inf] * len(s) + [0.0]
    for i, j, x, _ in edges:
        fore[j] = float(np.logaddexp(fore[j], fore[i] + x))
    for i, j, x, _ in sorted(edges, key=lambda e: -e[0]):
        back[i] = float(np.logaddexp(back[i], x + back[j]))
    out = collections.Counter()
    for i, j, x, names in edges:
        for name in names:
            out[name] += math.exp(fore[i] + x + back[j] - fore[-1])
    return out


def tokens(t):
    return (t or "").encode().lower().split()


def recursed(p, s):
    """Sum over all segmentations, every piece length tried at every end."""
    longest = max(map(len, p.plain))
    at = [0.0] + [-math.inf] * len(s)
    for j in range(1, len(s) + 1):
        at[j] = at[j - 1] + p.spelled(s[j - 1])
        for i in range(max(0, j - longest), j):
            if s[i:j] in p.plain:
                at[j] = float(np.logaddexp(at[j], at[i] + p.plain[s[i:j]]))
    return at[-1]


def scores_want(rows):
    held = [crc(i, 7) == 2 for i, _ in rows]
    p, c = pieces_of([t for _, t in rows], held)
    ends = held.count(False)
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    cache, out = {}, []
    for (i, t), h in zip(rows, held):
        w = tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        for x in w:
            if x not in cache:
                cache[x] = recursed(p, "▁" + x.decode("utf-8", "replace"))
        score = (sum(cache[x] for x in w) + p.end) / math.log(10)
        out.append((i, h, len(w) + 1, sum(c[x] > 0 for x in w) + (ends > 0), n, base, score))
    return out


def close(got, want):
    key = lambda r: (r[0] is None, *map(str, r[:4]), r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-6)


def test_scores_equal_plain_recursion(spark, sf, docs):
    close(queries.op9_lattice_score(spark, sf).collect(), scores_want([(r.doc_id, r.text) for r in docs.collect()]))


def test_score_edges(edge, empty):
    held = queries.crc_mod(F.col("doc_id"), 7) == 2
    rows = edge.where("length(text) < 10000 or text is null")
    close(lattice.lattice_scores(rows, held).collect(), scores_want([(r.doc_id, r.text) for r in rows.collect()]))
    assert lattice.lattice_scores(empty, held).count() == 0
    alone = lattice.lattice_scores(rows, F.lit(True)).collect()   # nothing to learn from
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in alone)


def test_lattice_sums_all_segmentations_and_is_a_distribution():
    p = lattice.Pieces(open(lattice.VOCABULARY, "rb").read())
    p.weigh({i: float(i % 7) for i in p.use}, 10.0)
    assert sum(map(math.exp, p.plain.values())) + sum(map(math.exp, p.bytes)) + math.exp(p.end) == pytest.approx(1.0)

    def every(s):
        if not s:
            yield 0.0
        for n in range(1, len(s) + 1):
            if s[:n] in p.plain:
                yield from (p.plain[s[:n]] + r for r in every(s[n:]))
        if s:
            yield from (p.spelled(s[0]) + r for r in every(s[1:]))

    words = ["the", "thesis", "ÿß", "an", "ant", "\U0001F600"]
    for w, got in zip(words, p.marginals(words)):
        assert got == pytest.approx(math.log(sum(map(math.exp, every("▁" + w)))))


def test_expected_counts_and_likelihood_grows():
    p = lattice.Pieces(open(lattice.VOCABULARY, "rb").read())
    words = ["the", "thesis", "theses", "the", "", "ÿß", "an", "ant", "antelope", "\U0001F600x", "a" * 40]
    weights = [5, 1, 2, 3, 4, 1, 7, 2, 1, 1, 2]
    start = p.counts(words, weights)
    p.weigh({i: x for i, x in enumerate(start) if x}, 10.0, smoothing=1e-3)
    ids = {name: i for i, name in p.names.items()}
    likelihood = []
    for _ in range(5):
        got, want = p.expected(words, weights), collections.Counter()
        for w, k in zip(words, weights):
            for piece, x in expected_of(p, "▁" + w).items():
                want[piece] += k * x
        assert set(got) == set(want) and all(got[x] == pytest.approx(want[x], rel=1e-9) for x in want)
        likelihood.append(sum(k * x for k, x in zip(weights, p.marginals(words))) + 10 * p.end)
        p.weigh({ids[x]: n for x, n in got.items()}, 10.0, smoothing=1e-3)
    assert all(b > a - 0.01 for a, b in zip(likelihood, likelihood[1:])) and likelihood[-1] > likelihood[0]
    long = "ab" * 50_000                                   # a very long word: every character is spelled or covered
    got = p.expected([long], [1])
    first = {f"<0x{b:02X}>" for b in [*range(128), 0xE2]}   # the first bytes of the characters spelled
    covered = sum(n * (x in first if x in p.names.values() and x.startswith("<0x") else len(x)) for x, n in got.items())
    assert covered == pytest.approx(len(long) + 1, rel=1e-6)


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("bits", [64, 12])
def test_words_that_share_a_hash_are_told_apart(spark, bits):
    """Words that collide under polynomial hashes, and hashes of few bits: counts follow each word's own."""
    own = [f"w{i}" for i in range(60)]
    rows = [(1, thue_morse(1024, "a", "b")), (2, thue_morse(1024, "b", "a")), (3, " ".join(own[:40])), (4, " ".join(own[20:]) + " " + own[59])]
    learn = {1, 3}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lattice.lattice_scores(df, ~F.col("doc_id").isin(*learn), hash_bits=bits).collect()}
    count = collections.Counter(w for i, t in rows if i in learn for w in t.split())
    n, v = sum(count.values()) + len(learn), len(count) + 1
    for i, t in rows:
        c = [count[w] for w in t.split()] + [len(learn)]
        assert got[i].n_known == sum(x > 0 for x in c) and got[i].n_tokens == len(c)
        assert math.isclose(got[i].base_score, sum(math.log10((x + 1) / (n + v + 1)) for x in c), rel_tol=1e-9)


# ---- secrets

def base_want(t):
    t = t or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t)
        if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return sorted(found)


def markov_want(t, base, model, least=8.0):
    n, out, covered = len(secrets.ALPHABET), [], bytearray(len(t or ""))
    for a, _, b in base:
        covered[a:b] = b"\1" * (b - a)
    for m in re.finditer("[A-Za-z0-9+/_=-]+", t or ""):
        s = m[0]
        if len(s) < 16 or not re.search("[0-9]", s) or not re.search("[A-Za-z]", s) or any(covered[m.start():m.end()]):
            continue
        k = [secrets.ALPHABET.index(c) for c in s]
        if sum(model[x * n + y] for x, y in zip(k, k[1:])) >= least:
            out.append((m.start(), 3, m.end()))
    return out


def report_want(rows, model):
    def text(spans):
        return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)

    out = []
    for i, t in rows:
        base = base_want(t)
        n = [sum(k == x for _, k, _ in base) for x in range(3)]
        out.append((i, *n, hashlib.sha256(text(base).encode()).hexdigest(), text(sorted(base + markov_want(t, base, model)))))
    return collections.Counter(out)


TRICKY = ["token=api_key=abc", "api_key=token:abcdef PASSWORD : 'hunter22' Passwd='x'", "AKIAAKIA" + "A1" * 9, "0" * 23 + " " + "a1" * 12,
          "é\U0001F600 secret = \"Zm9vYmFyMTIzNDU2Nzg5\" and eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9 ", "the_quick_brown_fox_jumps_2 internationalisation20",
          "token=abcdef" * 3, "api-key: 1234567", "apikey:'Ab/+=_.-9'", "deadbeef" * 4 + "g", "TOKEN\x20\x20=\x20\x20abcdefg"]


def test_spans_equal_python_regexes(spark, docs):
    model = secrets.train(secrets.samples_of(docs))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + list(enumerate(TRICKY, 10_000))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = secrets.report(secrets.scan(df, model)).collect()
    assert collections.Counter(map(tuple, got)) == report_want(rows, model)


def test_running_folds_every_place(spark):
    rows = [([],), ([5],), (list(range(64)),), (list(range(65)),), ([3, 1, 4, 1, 5] * 2000,)]
    df = spark.createDataFrame(rows, "a array<int>")
    got = secrets.with_running(df, {"s": (F.col("a"), 0, lambda x, y: x + y), "m": (F.col("a"), -1, lambda x, y: F.greatest(x, y))}, 8)
    for r in got.collect():
        assert r.s == [sum(r.a[:i]) for i in range(len(r.a))] and r.m == [max([-1, *r.a[:i]]) for i in range(len(r.a))]


def test_long_tokens_and_many_spans_are_linear(spark, docs):
    import time
    rnd = random.Random(4)
    model = secrets.train(secrets.samples_of(docs))
    uri = "data:image/png;base64," + "".join(rnd.choices(secrets.ALPHABET[:62] + "+/", k=1_000_000))
    many = " ".join(f"{rnd.getrandbits(100):025x}" for _ in range(100_000))
    mixed = " ".join(rnd.choice(["token=abcdef12", "a1" * 20, "AKIA" + "B2" * 8, "Zx9" * 7, "plain"]) for _ in range(20_000))
    rows = [(1, uri), (2, many), (3, mixed), (4, "token:abcdef:" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id").cache()
    df.count()
    secrets.report(secrets.scan(df.where("doc_id = 0"), model)).collect()
    took = time.time()
    got = secrets.report(secrets.scan(df, model)).collect()
    took = time.time() - took
    assert collections.Counter(map(tuple, got)) == report_want(rows, model)
    assert took < 30  # four texts on shared cores; with quadratic cost each would take many minutes


def test_ratio_tells_random_strings_from_identifiers(spark, docs):
    rnd = random.Random(2)
    pool = secrets.ALPHABET[:62]
    model = secrets.train(secrets.samples_of(docs))
    noise = [(i, "key is " + "".join(rnd.choices(pool, k=32)) + " then") for i in range(100)]
    plain = [(1000 + i, r.text) for i, r in enumerate(docs.where("not text rlike '[0-9]'").collect())]
    got = secrets.scan(spark.createDataFrame(noise + plain, "doc_id long, text string"), model).select("doc_id", F.size("found").alias("n")).collect()
    assert sum(r.n == 1 for r in got if r.doc_id < 1000) >= 95 and all(r.n == 0 for r in got if r.doc_id >= 1000)


def test_secret_edges(edge, empty):
    model = secrets.train(secrets.samples_of(edge))
    got = secrets.report(secrets.scan(edge, model)).collect()
    assert collections.Counter(map(tuple, got)) == report_want([(r.doc_id, r.text) for r in edge.collect()], model)
    assert secrets.scan(empty, secrets.train(secrets.samples_of(empty))).count() == 0
    assert secrets.train(secrets.samples_of(empty)) == [0.0] * len(secrets.ALPHABET) ** 2


# ---- decontamination misses nothing that its rule admits

def rule_want(rows, items, window=20, similarity=0.8):
    """The rule slid over every diagonal and window, without seeds."""
    toks, out = {i: words_of(t) for i, t in items}, {}
    for d, t in rows:
        w = words_of(t)
        for i, x in toks.items():
            n = min(window, len(x))
            for g in range(1 - len(x), len(w)) if x else ():
                same = [0 <= q + g < len(w) and w[q + g] == x[q] for q in range(len(x))]
                best = max(sum(same[s:s + n]) for s in range(len(x) - n + 1)) / n
                if best >= similarity:
                    o = out.setdefault((d, i), [0, len(x), 0.0, 10**9])
                    o[0], o[2], o[3] = max(o[0], sum(same)), max(o[2], best), min(o[3], max(0, g))
    return {(*k, v[0], v[1], round(v[2], 9), v[3]) for k, v in out.items()}


def test_masks_miss_no_pattern_of_the_rule():
    for words in range(1, 21):
        differ = max(m for m in range(words + 1) if (words - m) / words >= 0.8)
        assert decontam._fits(decontam.masks_for(words), words, differ), words
    assert not decontam._fits(decontam.MASKS, 9, 1) and not decontam._fits(decontam.MASKS, 20, 4)
    assert decontam.masks_for(100, 0.9) == ("1" * 9,) and decontam.masks_for(10, 1.1) == ()


@pytest.mark.parametrize("broadcast", [True, False])
def test_every_admitted_substitution_is_found(spark, broadcast):
    import itertools
    items, rows = [], []
    for n, differ in ((1, 0), (2, 0), (4, 0), (5, 1), (8, 1), (9, 1), (10, 2), (12, 2), (15, 3), (24, 4)):
        item = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        patterns = list(itertools.combinations(range(min(n, 20)), differ))
        for bad in patterns if n <= 15 else random.Random(3).sample(patterns, 300):
            own = ["other" if k in bad or k >= 20 else x for k, x in enumerate(item)]
            rows.append((len(rows), " ".join(["before", *own, "after"])))
        one_more = ["other" if k <= differ else x for k, x in enumerate(item[:20])]
        rows.append((len(rows), " ".join(one_more)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = as_set(decontam.contaminated(d, spark.createDataFrame(items, "item_id long, text string"), broadcast=broadcast))
    assert got == rule_want(rows, items) and len(got) == len(rows) - 10


def test_leaks_equal_the_rule_without_seeds(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").limit(12)
    rows = docs.where(F.length("text") < 3000).orderBy("doc_id").limit(60)
    got = as_set(decontam.contaminated(rows, items))
    assert got == rule_want([(r.doc_id, r.text) for r in rows.collect()], [(r.item_id, r.text) for r in items.collect()])


# ---- decontamination moves only what may be a hit

def test_a_sieve_loses_no_hash_and_keeps_few_others(spark):
    from pyspark.sql import functions as F
    hashes = spark.range(5000).select(F.xxhash64("id").alias("seed"))
    df = spark.range(50_000).select("id", F.xxhash64("id").alias("seed"))
    got = [r.id for r in decontam._sifted(df, "seed", hashes, 5000).collect()]
    assert set(range(5000)) <= set(got) and len(got) == len(set(got)) < 5000 + 0.03 * 45_000
    assert decontam._sifted(df, "seed", hashes.limit(0), 0).count() == 0


def test_equal_items_are_seeded_once(spark, monkeypatch):
    """A hundred ids of one text are as few seeds as one: the training texts stay where they are."""
    rnd = random.Random(4)
    t = " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(99)) for _ in range(30))
    items = spark.createDataFrame([*((i, t if i % 2 else t.upper() + ".") for i in range(100)), (None, t), (7, "words of another text under an id that is taken by then")],
                                  "item_id long, text string")
    d = spark.createDataFrame([(1, "some words before " + t), (1, "some words before " + t), (None, t), (2, None), (3, "clean"),
                               (4, "words of another text under an id that is taken by then")], "doc_id long, text string")
    want = {(doc, i, 30, 30, 1.0, at) for doc, at in ((1, 3), (None, 0)) for i in range(100)} | {(4, 7, 12, 12, 1.0, 0)}
    assert as_set(decontam.contaminated(d, items, broadcast=False)) == want

    def never(*a):
        raise AssertionError("shuffled")
    monkeypatch.setattr(decontam, "_distant_hits", never)
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 200)
    assert as_set(decontam.contaminated(d, items)) == want
