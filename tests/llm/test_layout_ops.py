"""Mixing, sharding, preference formatting and the pipeline: against plain Python."""

import binascii
import collections
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from revlens.llm import decontam, langid, mixing, preference, queries, sharding, simhash

WORD = re.compile("[^\x20\x09-\x0D]+")


# ---- mixing

def targets_want(sizes, weights, most=3.0):
    """Shares by weight, what is above a cap reshared among the others until none is above."""
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and left * weights[s] / w > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return {s: most * sizes[s] if s in capped else left * weights[s] / w for s in sizes}
        capped |= over


def mix_checks(df):
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    want = targets_want(dict(sizes), {s: i % 3 + 1 for i, s in enumerate(order)})
    out, segments = mixing.mix(df)
    got = out.collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _, _ in rows)
    by_target, taken = {}, collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by_target[r.target] = r.source_size
        taken[r.target] += r.taken
    assert sorted(by_target) == pytest.approx(sorted({want[s] for s in want}))
    total = sum(sizes.values())
    assert sum(want.values()) == pytest.approx(total)
    for target, n in taken.items():
        same = sum(math.isclose(target, t) for t in want.values())
        assert abs(n - target * same) <= 0.03 * target * same + 8 * total / mixing.isqrt(total) / 32 * same + 1
    # the mix itself: words of a document are taken in segments that lie inside it
    words = segments.groupBy("tag").agg(F.sum("words").alias("n")).join(out, "tag").where("n != taken")
    assert words.count() == 0
    inside = segments.join(out, "tag").where("offset < 0 or words < 1 or offset + words > size")
    assert inside.count() == 0
    return got, segments


def test_mix_follows_targets(docs):
    got, segments = mix_checks(docs)
    again = mixing.mix(docs)[0].collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_keeps_shares_in_every_stretch(docs):
    """Low discrepancy: any run of 400 slots holds each source within a few slots of its share."""
    out, segments = mixing.mix(docs)
    per = segments.join(out.select("tag", "target"), "tag").groupBy((F.col("slot") / 400).cast("int").alias("run"), "target").agg(F.sum("words").alias("n"))
    total = docs.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    block = -(-total // (32 * (mixing.isqrt(total) + 1)))
    runs = collections.defaultdict(dict)
    for r in per.collect():
        runs[r.run][r.target] = r.n
    shared = collections.Counter(r.target for r in out.select("target", "source_size").distinct().collect())
    full = [runs[k] for k in sorted(runs)[:-1]]
    assert full and all(abs(n - 400 * block * t * shared[t] / total) <= 6 * block * shared[t] + 3 * block for run in full for t, n in run.items())


def test_mix_edges(edge, empty):
    mix_checks(edge)
    out, segments = mixing.mix(empty)
    assert out.count() == 0 and segments.count() == 0
    none = mixing.mix(edge.where("text is null"))[0].collect()
    assert len(none) == 2 and all(r.taken == 0 and r.size == 0 for r in none)
    whole = mixing.mixed_documents(edge)
    assert whole.columns == edge.columns and whole.where("text is null").count() == 0
    assert mixing.mixed_documents(empty).count() == 0


def test_targets_water_filling(spark):
    cases = [{"a": 100, "b": 1, "c": 1, "d": 50}, {"a": 0, "b": 5}, {"a": 7}, {"a": 10, "b": 10, "c": 10, "d": 10}, {"a": 1000, "b": 1, "c": 2, "d": 3, "e": 4}]
    for sizes in cases:
        df = mixing.cyclic_weights(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(targets_want(sizes, {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}))


def test_schedule_visits_shares_evenly(spark):
    half = mixing.POINTS // 2
    shares = spark.createDataFrame([(0, 0, half // 5), (1, half // 5, half), (2, half, half), (3, half, mixing.POINTS)], "rank int, low long, high long")
    n = 200_000
    got = mixing.schedule(spark, shares, n)
    counts = {r["rank"]: (r.n, r.top, r.kinds) for r in got.groupBy("rank").agg(F.count("k").alias("n"), F.max("k").alias("top"), F.countDistinct("k").alias("kinds")).collect()}
    assert set(counts) == {0, 1, 3} and all(top == n - 1 == kinds - 1 for n, top, kinds in counts.values())
    assert abs(counts[0][0] - n / 10) < 8 and abs(counts[1][0] - n * 4 / 10) < 8 and abs(counts[3][0] - n / 2) < 8


def test_small_sources_reach_their_targets_among_large_blocks(spark):
    sizes = {"big": 90_000, **{f"s{k:02}": 3 + 7 * k for k in range(40)}}
    rows = [(k, s, " ".join(["w"] * min(50, n - at))) for s, n in sizes.items() for k, at in enumerate(range(0, n, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out, segments = mixing.mix(docs, density=1, carry=["doc_id", "source"])
    got = out.groupBy("row.source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    block = mixing.isqrt(sum(sizes.values()))
    assert len(got) == 41 and sum(r.target < block / 2 for r in got) > 5           # whole slots would miss these or give them none
    assert all(abs(r.taken - r.target) <= 0.5 for r in got)
    assert sum(r.taken == round(r.target) for r in got) >= 40
    assert segments.join(out, "tag").where("offset < 0 or words < 1 or offset + words > size").count() == 0
    assert segments.groupBy("tag").agg(F.sum("words").alias("n")).join(out, "tag").where("n != taken").count() == 0
    kept = mixing.mixed_documents(docs, density=1)
    assert kept.select("source").distinct().count() >= 40


# ---- sharding

def md5_32(s):
    return int(hashlib.md5(s.encode()).hexdigest()[:8], 16)


def shard_want(key, shards):
    v = md5_32("" if key is None else str(key)) % sharding.SLOTS
    return v, max(j for j in range(shards) if md5_32(f"{v}:{j}") % (j + 1) == 0)


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_shards_follow_key_and_count_alone(which, request):
    df = request.getfixturevalue(which)
    got = sharding.assign(df, 40).collect()
    assert len(got) == df.count()
    text = collections.defaultdict(list)
    for r in df.collect():
        text[r.doc_id].append(r.text)
    places = collections.defaultdict(list)
    for r in got:
        v, s = shard_want(r.doc_id, 40)
        assert (r.virtual_slot, r.shard) == (v, s) and r.grown_shard == shard_want(r.doc_id, 41)[1] and r.grown_shard in (s, 40)
        assert (r.size, r.text_crc32) in [(len((t or "").encode()) + 16, binascii.crc32((t or "").encode())) for t in text[r.doc_id]]
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_shard_edges(edge, empty):
    rows = sharding.sharded_documents(edge)
    assert [c for c in rows.columns if c not in ("shard", "shard_slot")] == [c if c != "shard" else "shard_in" for c in edge.columns]
    assert rows.count() == edge.count() and sharding.assign(empty).count() == 0


def test_map_versions_and_rebalancing(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    sharding.assign(docs, 8, map_path=path).count()
    stored = spark.read.parquet(path)
    assert {r.version: r["count"] for r in stored.groupBy("version").count().collect()} == {8: sharding.SLOTS, 9: sharding.SLOTS}
    total = docs.select(F.sum(F.octet_length("text") + 16)).first()[0]
    assert {r.b for r in stored.groupBy("version").agg(F.sum("bytes").alias("b")).collect()} == {total}
    new = sharding.rebalanced(stored, 8, 10)
    def load(m):
        return {r.shard: r.b for r in m.join(stored.where("version = 8").select("slot", "bytes"), "slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    before, after = load(stored.where("version = 8").drop("bytes")), load(new)
    full, least = max(before, key=lambda s: (before[s], s)), min(before, key=lambda s: (before[s], s))
    assert new.count() == sharding.SLOTS and sum(after.values()) == total
    assert after[full] < before[full] and after[least] > before[least]
    assert max(after[full], after[least]) <= before[full]
    assert all(after[s] == before[s] for s in before if s not in (full, least))


def test_shards_are_read_from_the_stored_map(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    rows = sharding.assign(docs, 8, map_path=path).collect()
    stored = {(r.version, r.slot): r.shard for r in sharding.stored_map(spark, path).collect()}
    assert all((r.shard, r.grown_shard) == (stored[8, r.virtual_slot], stored[9, r.virtual_slot]) for r in rows)
    again = sharding.assign(docs, 8, map_path=path).collect()      # a rerun replaces its versions
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert sharding.stored_map(spark, path).count() == 2 * sharding.SLOTS


def test_a_balanced_map_grows_by_editing(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    sharding.assign(docs, 8, map_path=path)
    stored = sharding.stored_map(spark, path)
    sizes = stored.where("version = 8").select("slot", "bytes", "rows")

    def load(m):
        got = {r.shard: r.b for r in m.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
        return max(got.values()) - min(got.values()), sum(got.values())
    even = sharding.balanced(stored, 8, 0.02)
    before, after = load(stored.where("version = 8")), load(even)
    assert after[1] == before[1] and even.count() == sharding.SLOTS and after[0] < before[0]
    assert after[0] <= max(0.02 * after[1] / 8, max(r.bytes for r in even.collect()))
    stored = sharding.store_map(even, sizes, path, 100)
    stored = sharding.store_map(sharding.grown(stored, 100, 8), sizes, path, 101)
    maps = {v: {r.slot: r.shard for r in stored.where(F.col("version") == v).collect()} for v in (8, 100, 101)}
    assert maps[100] != maps[8] and any(maps[101][v] == 8 for v in maps[101])
    assert all(maps[101][v] in (maps[100][v], 8) for v in maps[101])


def test_grown_map_moves_slots_to_the_new_shard_only(spark):
    maps = [{r.slot: r.shard for r in sharding.base_map(spark, n).collect()} for n in (1, 2, 39, 40, 41)]
    assert set(maps[0].values()) == {0}
    for a, b, n in ((0, 1, 1), (2, 3, 39), (3, 4, 40)):
        assert all(maps[b][s] in (maps[a][s], n) for s in maps[a])
    counts = collections.Counter(maps[3].values())
    assert len(counts) == 40 and max(counts.values()) < 1.6 * sharding.SLOTS / 40


# ---- preference formatting

def rendered(turns):
    return "".join(f"<|{r.replace('<|', '< |')}|>\n{t.replace('<|', '< |')}<|end|>\n" for r, t in turns)


def mask_of(turns):
    out, at = [], 0
    for r, t in turns:
        n = len(rendered([(r, t)]))
        if r == "assistant":
            out.append(f"{at + len(rendered([(r, ''),])) - len('<|end|>' + chr(10))}:{at + n}")
        at += n
    return ",".join(out)


def pairs_want(chosen, rejected):
    out = set()
    for p in set(chosen) | set(rejected):
        a, b = ([(r or "", t or "") for _, r, t in sorted(x.get(p, []), key=lambda y: (y[0], y[1] or "", y[2] or ""))] for x in (chosen, rejected))
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        out.add((p, rendered(a[:n]), rendered(a[n:]), rendered(b[n:]), n, mask_of(a[n:]), mask_of(b[n:])))
    return out


def gathered(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        if r.pair_id is not None:
            out[r.pair_id].append((r.turn, r.role, r.text))
    return out


def test_preference_pairs_equal_plain_rendering(spark, sf):
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    c, r = preference.swapped_answers(conv)
    got = {tuple(x) for x in preference.format_preferences(c, r).collect()}
    assert got == pairs_want(gathered(c), gathered(r)) and len(got) == conv.select("conv_id").distinct().count()
    # the rejected side ends with the neighbour's last answer
    plain = collections.defaultdict(list)
    for x in sorted(conv.collect(), key=lambda x: x.turn):
        plain[x.conv_id].append((x.role, x.text))
    for p, _, _, rejected, *_ in got:
        answers = [t for r, t in plain.get(p ^ 1, []) if r == "assistant"]
        if any(r == "assistant" for r, _ in plain[p]) and answers and rejected:
            assert rejected.endswith(answers[-1] + "<|end|>\n")


def test_preference_edges(spark):
    schema = "pair_id long, turn long, role string, text string, pos int, side int, extra string"
    a = [(1, 0, "user", "hi <|end|>"), (1, 1, "assistant", "é\U0001F600 yes"), (2, 0, None, None), (3, 0, "user", "only chosen"), (None, 0, "user", "x"),
         (5, 0, "user", "same"), (5, 0, "user", "same"), (5, 1, "assistant", "A" * 50_000), (6, 0, "assistant", "equal")]
    b = [(1, 0, "user", "hi <|end|>"), (1, 1, "assistant", "no"), (2, 0, "", ""), (4, 0, "assistant", "only rejected"), (5, 0, "user", "same"),
         (5, 1, "assistant", "B"), (5, 2, "user", "more"), (6, 0, "assistant", "equal")]
    c, r = (spark.createDataFrame([(*x, 9, 9, "z") for x in rows], schema) for rows in (a, b))
    got = {tuple(x) for x in preference.format_preferences(c, r).collect()}
    assert got == pairs_want(gathered(c), gathered(r))
    assert preference.format_preferences(c.limit(0), r.limit(0)).count() == 0
    empty = c.select(F.col("pair_id").alias("conv_id"), "turn", "role", "text").limit(0)
    assert preference.format_preferences(*preference.swapped_answers(empty)).count() == 0


# ---- pipeline

def test_stages_work_on_what_is_left(spark, sf, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, kept[-1], sf), "test-stage")
        kept.append(out)
    assert all(k.columns == docs.columns for k in kept[:-1])
    ids = [collections.Counter(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    model = queries.language_model(docs)
    want = {r.doc_id for r in docs.select("doc_id", langid.identify(F.col("text"), model).alias("g")).where("g.accepted").collect()}
    assert set(ids[1]) == want and len(want) >= 0.99 * docs.count()
    from test_dedup_ops import plain_fingerprint, reach
    fps = {r.doc_id: plain_fingerprint(r.text) for r in kept[1].collect()}
    root, first = reach(fps.values()), {}
    for i, f in sorted(fps.items()):
        first.setdefault(root[f], i)
    assert set(ids[2]) == set(first.values()) and max(ids[2].values()) == 1
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    bad = {r.doc_id for r in decontam.contaminated(kept[2], items).collect()}
    assert bad and set(ids[3]) == set(ids[2]) - bad
    taken = {r.doc_id: math.floor(r.taken / r.size + 0.5) for r in mixing.mix(kept[3])[0].collect()}
    assert ids[4] == {i: n for i, n in taken.items() if n}
    assert ids[5] == ids[4] and all(r.shard == shard_want(r.doc_id, 40)[1] for r in kept[5].collect())
    run = collections.Counter((r.doc_id, r.shard, r.shard_slot) for r in corpus_pipeline.run(spark, sf).collect())
    assert run == collections.Counter((r.doc_id, r.shard, r.shard_slot) for r in kept[5].collect())


def test_stages_take_edge_rows_and_empty_tables(spark, sf, edge, empty):
    for df in (edge, empty):
        out = df
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = corpus_pipeline.written(stage(spark, out, sf), "test-stage")
            assert k == 4 or out.columns == df.columns
        assert out.count() >= 0
    assert simhash.keep_one(edge.where("doc_id is null")).count() >= 1
