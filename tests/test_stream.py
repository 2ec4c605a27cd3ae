import os
import tempfile

from revlens.streaming.landing import run_landing_once, start_landing_stream


def _upload(path, rows):
    with open(path, "w", encoding="utf-8") as f:
        f.write("business_name,stars,text\n" + "".join(f"{b},{s},{t}\n" for b, s, t in rows))


def _folders():
    base = tempfile.mkdtemp(prefix="revlens-stream-")
    landing, sink, ckpt = (os.path.join(base, x) for x in ("landing", "sink", "checkpoint"))
    os.makedirs(landing)
    return landing, sink, ckpt


def test_stream_lives_through_a_first_batch_without_a_valid_row(spark):
    landing, sink, ckpt = _folders()
    _upload(os.path.join(landing, "a.csv"), [("b", "9", "stars out of range here"), ("b", "5", "short")])
    assert run_landing_once(spark, landing, sink, ckpt).count() == 0
    _upload(os.path.join(landing, "b.csv"), [("b", "5", "good food and staff"), ("c", "4", "good food and staff")])
    assert run_landing_once(spark, landing, sink, ckpt).count() == 2
    _upload(os.path.join(landing, "c.csv"), [("b", "3", "good food and staff"), ("b", "2", "another valid review")])
    got = run_landing_once(spark, landing, sink, ckpt)
    assert sorted((r.business_name, r.text, r.epoch) for r in got.collect()) == [
        ("b", "another valid review", 2), ("b", "good food and staff", 1), ("c", "good food and staff", 1)]


def test_a_retried_batch_replaces_its_output_even_when_empty(spark):
    landing, sink, ckpt = _folders()
    _upload(os.path.join(landing, "a.csv"), [("b", "5", "good food and staff")])
    run_landing_once(spark, landing, sink, ckpt)
    # the batch failed after its write: its commit is not there, and the upload was corrected before the retry
    os.remove(os.path.join(ckpt, "commits", "0"))
    crc = os.path.join(ckpt, "commits", ".0.crc")
    if os.path.exists(crc):
        os.remove(crc)
    _upload(os.path.join(landing, "a.csv"), [("b", "7", "good food and staff")])
    assert run_landing_once(spark, landing, sink, ckpt).count() == 0


def _shift(path, seconds):
    now = os.stat(path).st_mtime + seconds
    os.utime(path, (now, now))


def test_late_file_restart_and_first_copy(spark):
    landing, sink, ckpt = _folders()
    _upload(os.path.join(landing, "a.csv"), [("b", "5", "good food and staff"), ("b", "1", "good food and staff"), (None or "", "4", "good food and staff")])
    first = run_landing_once(spark, landing, sink, ckpt)
    assert [(r.business_name, r.stars) for r in first.orderBy("business_name").collect()] == [(None, 4.0), ("b", 5.0)]
    # a file that is older than the first, uploaded late, after a restart of the query: its copies are known
    _upload(os.path.join(landing, "late.csv"), [("b", "2", "good food and staff"), ("b", "3", "never seen before at all"), ("", "3", "good food and staff")])
    _shift(os.path.join(landing, "late.csv"), -3600)
    got = run_landing_once(spark, landing, sink, ckpt)
    assert sorted((r.business_name or "", r.text, r.stars) for r in got.collect()) == [
        ("", "good food and staff", 4.0), ("b", "good food and staff", 5.0), ("b", "never seen before at all", 3.0)]


def test_batch_cost_does_not_grow_with_what_was_kept(spark):
    landing, sink, ckpt = _folders()
    for i in range(50):
        path = os.path.join(landing, f"{i:03}.csv")
        _upload(path, [("b", "5", f"review number {i} of text {j}") for j in range(30)] + [("b", "4", f"review number {i - 1} of text {j}") for j in range(5)])
        _shift(path, i - 100)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        q = start_landing_stream(spark, landing, sink, ckpt, max_files_per_trigger=1)
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    done = [p for p in q.recentProgress if p["numInputRows"]]
    assert len(done) == 50 and spark.read.parquet(sink).count() == 50 * 30 + 5
    assert {p["numInputRows"] for p in done} == {35}  # a batch reads its own file, nothing of the sink or of a key table
    assert [p["stateOperators"][0]["numRowsUpdated"] for p in done][1:] == [35] * 49
    took = [p["durationMs"]["addBatch"] for p in done]
    assert sorted(took[-20:])[10] < 2 * sorted(took[5:25])[10] + 200


def test_forgotten_texts_are_kept_anew(spark):
    import time
    landing, sink, ckpt = _folders()
    _upload(os.path.join(landing, "a.csv"), [("b", "5", "good food and staff")])
    run_landing_once(spark, landing, sink, ckpt, ttl_ms=1000)
    time.sleep(2)
    _upload(os.path.join(landing, "b.csv"), [("b", "5", "another review text")])  # this batch forgets
    run_landing_once(spark, landing, sink, ckpt, ttl_ms=1000)
    _upload(os.path.join(landing, "c.csv"), [("b", "3", "good food and staff")])
    assert run_landing_once(spark, landing, sink, ckpt, ttl_ms=1000).count() == 3


def test_a_batch_is_computed_once(spark, monkeypatch, tmp_path):
    """Numbering and writing a batch run several jobs; files, validation and state are run by the first alone."""
    from revlens.streaming import landing as L
    log, keep_first = str(tmp_path / "calls"), L._keep_first

    def counted(columns, ttl_ms):
        run = keep_first(columns, ttl_ms)

        def go(key, frames, state):
            with open(log, "a") as f:
                f.write("x")
            yield from run(key, frames, state)
        return go

    monkeypatch.setattr(L, "_keep_first", counted)
    landing, sink, ckpt = _folders()
    _upload(os.path.join(landing, "a.csv"), [("b", s, f"review of the text {t}") for t in "abc" for s in (5, 4)])
    got = run_landing_once(spark, landing, sink, ckpt)
    assert sorted((r.text[-1], r.stars, r.review_id) for r in got.collect()) == [("a", 5.0, "r_0"), ("b", 5.0, "r_1"), ("c", 5.0, "r_2")]
    assert os.path.getsize(log) == 3


def test_a_key_moves_three_texts_and_rows_come_back_whole(spark, monkeypatch):
    """Each column of a key's frame costs; what stream and validation made of a row is what the sink holds."""
    from revlens.streaming import landing as L
    seen, keep_first = [], L._keep_first

    def narrow(columns, ttl_ms):
        run = keep_first(columns, ttl_ms)

        def go(key, frames, state):
            frames = list(frames)
            assert len(key) == 1 and all(set(f.columns) == {"_key", "_place", "_packed"} for f in frames)
            yield from run(key, iter(frames), state)
        seen.append(columns)
        return go

    monkeypatch.setattr(L, "_keep_first", narrow)
    landing, sink, ckpt = _folders()
    with open(os.path.join(landing, "a.csv"), "w", encoding="utf-8") as f:
        f.write('business_name,stars,text\n"a ""b"", c\\d",3.6,"a ""quoted"" text,\nof two lines \U0001F600 \\ é"\n,4,"a ""quoted"" text,\nof two lines \U0001F600 \\ é"\n')
    got = run_landing_once(spark, landing, sink, ckpt)
    text = 'a "quoted" text,\nof two lines \U0001F600 \\ é'
    assert {(r.business_name, r.stars, r.text) for r in got.collect()} == {('a "b", c\\d', 3.5, text), (None, 4.0, text)}
    assert seen == [["_packed"]]


def test_landing_files_follow_the_texts_and_not_the_shuffle(spark, tmp_path):
    """Micro-batches of a few MB ran each with all jobs and all state partitions."""
    from pyspark.sql import functions as F
    from revlens.plans import q_stream
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("review text "), F.sha2(F.col("id").cast("string"), 256)).alias("text"),
                                   F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = q_stream.q_landing_stream(spark, str(tmp_path))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got.select("epoch").distinct().count() == 1
    assert got.count() == spark.read.parquet(str(tmp_path / "documents.parquet")).where("(doc_id * 7) % 25 between 4 and 20").count()
