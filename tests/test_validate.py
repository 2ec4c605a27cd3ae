from pyspark.sql import functions as F

from revlens.operators import validate as V

# the validator's own demo shape: 10 rows -> 3 (short, blank, digits-only, symbols-only,
# duplicate, null, out-of-range stars)
DEMO = [
    (0, "The noodles were great and staff kind!", 5),
    (1, "ok", 3),
    (2, "", 4),
    (3, "123456789", 2),
    (4, "!!!!!!!!!!", 1),
    (5, "Fair prices, a pretty dining room.", 4),
    (6, "The noodles were great and staff kind!", 5),
    (7, "Slow service, rude waiter tonight.", 2),
    (8, None, 3),
    (9, "Airy room and a varied menu overall.", 99),
]


def _demo(spark):
    return spark.createDataFrame(DEMO, "seq long, text string, stars long").withColumn("business_id", F.lit("b"))


def test_golden_validator_demo(spark):
    raw = _demo(spark)
    clean = V.validate_reviews(raw, ["business_id"]).orderBy("seq")
    rows = clean.select("seq", "stars").collect()
    assert [r.seq for r in rows] == [0, 5, 7]
    assert [r.stars for r in rows] == [5.0, 4.0, 2.0]
    st = V.present_validation_stats(V.validation_stats(raw, clean, ["business_id"])).first()
    assert (st.total_before, st.total_after, st.removed, st.kept_ratio) == (10, 3, 7, 30.0)
    assert st.avg_stars_before == 12.8 and st.avg_stars_after == 3.67


def test_reject_counts_per_step(spark):
    rc = {r.step: r.removed for r in V.reject_counts(_demo(spark), ["business_id"]).collect()}
    # "123456789" is 9 characters: removed as short, not as spam
    assert rc == {"text": 2, "short": 2, "stars": 1, "duplicate": 1, "spam": 1}


def test_keep_first_survivor(spark):
    rows = [(0, "Same text for both rows here", 99), (1, "Same text for both rows here", 4)]
    df = spark.createDataFrame(rows, "seq long, text string, stars long").withColumn("business_id", F.lit("b"))
    out = V.validate_reviews(df, ["business_id"]).collect()
    assert [(r.seq, r.stars) for r in out] == [(1, 4.0)]


def test_scope_controls_dedup(spark):
    rows = [(0, "Same text in two businesses", 4, "a"), (1, "Same text in two businesses", 4, "b")]
    df = spark.createDataFrame(rows, "seq long, text string, stars long, business_id string")
    assert V.validate_reviews(df, ["business_id"]).count() == 2
    assert V.validate_reviews(df, []).count() == 1


def test_defaults_and_ids(spark):
    df = spark.createDataFrame([(5, "A perfectly fine review"), (7, "Another perfectly fine one")],
                               "seq long, text string")
    out = V.validate_reviews(df, []).orderBy("seq").collect()
    assert [r.review_id for r in out] == ["r_0", "r_1"]
    assert [r.stars for r in out] == [3.0, 3.0] and out[0].business_name == "Unknown"


def test_idempotent_and_partition_independent(spark):
    raw = _demo(spark)
    a = sorted(map(tuple, V.validate_reviews(raw, ["business_id"]).select("seq", "text").collect()))
    b = sorted(map(tuple, V.validate_reviews(raw.repartition(7), ["business_id"]).select("seq", "text").collect()))
    c = sorted(map(tuple, V.validate_reviews(V.validate_reviews(raw, ["business_id"]), ["business_id"])
                   .select("seq", "text").collect()))
    assert a == b == c


def test_near_duplicates_in_a_crowded_bucket_are_found(spark):
    """Texts of one template below the threshold, and late near copies of some that stand apart from them."""
    import random
    from revlens.operators.validate import near_duplicates
    rnd = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    template = "".join(rnd.choices(letters, k=300))

    def shingles(t):
        return {t[i:i + 5] for i in range(len(t) - 4)}
    texts = [template + "".join(rnd.choices(letters, k=150)) for _ in range(400)]
    for k in range(0, 400, 8):
        t = list(texts[k])
        for at in rnd.sample(range(300), 6):
            t[at] = rnd.choice("0123456789")
        texts.append("".join(t))
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = {i for i, _ in pairs}
    df = spark.createDataFrame([(i, "b", t) for i, t in enumerate(texts)], "seq long, business_id string, text string")
    got = {(r.seq, r.earlier_seq) for r in near_duplicates(df, bands=4, rows_per_band=1).collect()}   # crowded buckets
    assert len(want) >= 45 and {i for i, _ in got} == want and got <= set(pairs)


def test_near_duplicates_shuffle_names_not_shingle_sets(spark, tmp_path):
    """What the comparison of near copies shuffles and writes stays within a few times the texts; results as by brute force."""
    import glob
    import os
    import random
    from revlens.operators import lineage
    from revlens.operators.validate import near_duplicates
    rnd = random.Random(3)
    texts = []
    for _ in range(60):
        words = [f"w{rnd.randrange(4000)}" for _ in range(300)]
        texts += [" ".join(words), " ".join(words[:-8] + ["\U0001f600" + str(rnd.randrange(9))]), " ".join(words[:100])]
    df = spark.createDataFrame([(i, None if i % 2 else "b", t) for i, t in enumerate(t for p in range(2) for t in texts)], "seq long, business_id string, text string")
    wrote, write = [], lineage.write_table
    from revlens.operators import validate

    def counted(frame, name):
        out = write(frame, name)
        wrote.extend(os.path.getsize(f.removeprefix("file:").removeprefix("//")) for f in out.inputFiles())
        return out
    validate.write_table = counted
    try:
        got = {(r.business_id, r.seq): r.earlier_seq for r in near_duplicates(df).collect()}
    finally:
        validate.write_table = write
    sets = [{t[i:i + 5] for i in range(len(t) - 4)} for t in texts] * 2
    for i in range(360):
        like = {j for j in range(i % 2, i, 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        assert (got.get((None if i % 2 else "b", i)) in like) if like else (None if i % 2 else "b", i) not in got
    assert wrote and sum(wrote) < 4 * sum(len(t) for t in texts) * 2


def test_min_hashes_are_sparks(spark):
    """Signatures keep their values bit for bit: the same texts meet as before."""
    from pyspark.sql import functions as F
    from revlens.operators.validate import _min_hashes
    rows = [(i, [(-1) ** j * (i * 7919 + j) ** 5 % (2 ** 62) for j in range(n)]) for i, n in enumerate((1, 3, 2, 70_000, 1, 5))]
    df = spark.createDataFrame(rows, "id long, _hs array<long>")
    got = df.mapInArrow(_min_hashes(["id"], 3), "id long, h0 long, h1 long, h2 long")
    want = df.select("id", F.explode("_hs").alias("h")).groupBy("id").agg(*[F.min(F.xxhash64("h", F.lit(k))).alias(f"h{k}") for k in range(3)])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert df.limit(0).mapInArrow(_min_hashes(["id"], 3), "id long, h0 long, h1 long, h2 long").count() == 0


def test_near_duplicates_fetch_few_texts_of_unlike_pairs(spark, monkeypatch):
    """Texts that share a bucket but not their hashes are not compared; the pairs found are those of brute force."""
    import random
    from revlens.operators import validate as V
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcde", k=4)) for _ in range(40)]
    rows = [("b", i, " ".join(rnd.choices(words, k=30))) for i in range(120)]
    rows += [("b", 200 + i, rows[i][2] + " " + words[i % 40]) for i in range(20)] + [("b", 300, "x\U0001F600" * 20), ("b", 301, "x\U0001F600" * 20 + "y")]
    seen, old = [], V.write_table
    monkeypatch.setattr(V, "write_table", lambda df, name: seen.append((name, old(df, name))) or seen[-1][1])
    got = {(r.seq, r.earlier_seq) for r in V.near_duplicates(spark.createDataFrame(rows, "business_id string, seq long, text string"), bands=32, rows_per_band=3).collect()}

    def shingles(t):
        return {t[i:i + 5] for i in range(len(t) - 4)}
    sets = {s: shingles(t) for _, s, t in rows}
    like = {(b, a) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {b for b, _ in like} == {b for b, _ in got} and got <= like and len(like) >= 20
    assert sum(t.count() for name, t in seen if name == "near-pairs") <= len(like) + 5
    assert V._agreeing(96, 0.8) == 47 and V._agreeing(4, 0.8) == 0 and V._agreeing(96, 1.0) == 96
