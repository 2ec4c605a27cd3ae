import os
import tempfile

from pyspark.sql import functions as F

from revlens.operators import collect as B
from revlens.operators import validate as V
from revlens.sources import readers as R

CSV_CRLF = (
    "business_name,stars,text\r\n"
    "n1,3,fine taste but slow staff\r\n"
    "n2,4,\"pricey, but the food is good\"\r\n"
    "n3,5,I love this little place\r\n"
    "n4,2,bad\r\n"
    "n5,1,bad\r\n"
    "n6,4,high price \r\n"
    "n7,1,high price \r\n"
    "n8,5,I love this little place\r\n"
    "n9,abc,stars are not a number here\r\n"
    "n10,3,NA\r\n"
)


def _write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)


def test_csv_load_clean_and_validate(spark):
    d = tempfile.mkdtemp(prefix="revlens-csv-")
    _write(os.path.join(d, "a.csv"), CSV_CRLF)
    df = R.load_review_csv(spark, os.path.join(d, "a.csv"))
    rows = df.orderBy("seq").collect()
    # 'abc' stars and the NA text are dropped by the loader; ids count rows before cleaning
    assert [r.review_id for r in rows] == [f"csv_{i}" for i in range(8)]
    assert rows[1].text == "pricey, but the food is good"
    assert rows[0].useful == 0 and rows[0].date is None
    clean = V.validate_reviews(df, scope=[])
    # short 'bad' x2 dropped, 'high price ' and the repeated sentence deduplicated
    assert clean.count() == 4


def test_csv_latin1_fallback(spark):
    d = tempfile.mkdtemp(prefix="revlens-csv-")
    _write(os.path.join(d, "u.csv"), "text,stars\ncafé crème très bon,5\n", "utf-8")
    _write(os.path.join(d, "l.csv"), "text,stars\ncafé crème très bon,4\n", "latin-1")
    df = R.load_review_csv(spark, [os.path.join(d, "u.csv"), os.path.join(d, "l.csv")])
    assert sorted(r.text for r in df.collect()) == ["café crème très bon"] * 2


def test_csv_missing_required(spark):
    d = tempfile.mkdtemp(prefix="revlens-csv-")
    _write(os.path.join(d, "x.csv"), "text,rating\nsomething good here,5\n")
    try:
        R.load_review_csv(spark, os.path.join(d, "x.csv"))
        raise AssertionError("expected ValueError")
    except ValueError as e:
        assert "stars" in str(e)


def test_json_missing_path_is_empty(spark):
    assert R.read_review_json(spark, "/nonexistent/reviews.json").count() == 0


def test_cards(spark):
    cards = spark.createDataFrame(
        [("b", "4 stars", "nice", "1 week ago", 0), ("b", "four stars", "bad parse", "x", 1),
         ("b", None, "no label", "x", 2), ("b", "5 stars", "", "x", 3), ("b", "3 stars", "ok", "x", 4)],
        "business_name string, aria_label string, text string, date string, seq long")
    out = R.normalise_cards(cards, limit=2).orderBy("seq").collect()
    assert [(r.text, r.stars) for r in out] == [("nice", 4), ("no label", None)]


def test_search_resolve(spark):
    biz = spark.createDataFrame(
        [("1", "Pho 100%", "Hanoi", 120, 0), ("2", "Pho Corner", "Hue", 30, 1), ("3", "Bun Cha", "Hanoi", 60, 2)],
        "business_id string, name string, city string, review_count long, seq long") \
        .withColumn("state", F.lit("")).withColumn("stars", F.lit(4.0)).withColumn("categories", F.lit(None).cast("string"))
    m = B.search_businesses(biz, ["pho", "100%", "bun", "  "])
    got = sorted((r.request, r.business_id, r.reliability) for r in m.collect())
    assert got == [("100%", "1", "High"), ("bun", "3", "Medium"), ("pho", "1", "High"), ("pho", "2", "Low")]
    res = sorted((r.request, r.business_id) for r in B.resolve(m).collect())
    assert res == [("100%", "1"), ("bun", "3")]
    assert B.blank_request_errors(["pho", "  "]) == ["  "]


def test_csv_files_are_read_by_their_own_header(spark):
    d = tempfile.mkdtemp(prefix="revlens-csv-")
    _write(os.path.join(d, "a.csv"), "text,stars\ngood food here,5\n")
    _write(os.path.join(d, "b.csv"), "stars,review_id,text\n4,own,slow service here\n")
    _write(os.path.join(d, "c.csv"), "business_name,stars,text\nCafé,3,fair price here\n", "latin-1")
    got = {(r.text, r.stars, r.business_name, r.review_id) for r in R.load_review_csv(spark, d + "/*.csv").collect()}
    assert got == {("good food here", 5.0, "Unknown", "csv_0"), ("slow service here", 4.0, "Unknown", "own"),
                   ("fair price here", 3.0, "Café", "csv_2")}


def test_csv_with_replacement_character_stays_utf8(spark):
    d = tempfile.mkdtemp(prefix="revlens-csv-")
    _write(os.path.join(d, "u.csv"), "text,stars\ncafé \ufffd good,5\n")
    assert [r.text for r in R.load_review_csv(spark, d + "/u.csv").collect()] == ["café \ufffd good"]


def test_csv_one_file_without_a_required_column_is_an_error(spark):
    d = tempfile.mkdtemp(prefix="revlens-csv-")
    _write(os.path.join(d, "a.csv"), "text,stars\ngood food here,5\n")
    _write(os.path.join(d, "b.csv"), "text,rating\ngood food here,5\n")
    try:
        R.load_review_csv(spark, d + "/*.csv", clean=False)
        raise AssertionError("expected ValueError")
    except ValueError as e:
        assert "stars" in str(e)


def test_null_scopes_are_one_scope(spark):
    before = spark.createDataFrame([(1, None, "good food here", 4.0), (2, None, "nice staff there", 5.0), (3, "b", "fair price here", 3.0)],
                                   "seq long, business_id string, text string, stars double")
    stats = {r.business_id: (r.total_before, r.total_after) for r in V.validation_stats(before, V.validate_reviews(before)).collect()}
    assert stats == {None: (2, 2), "b": (1, 1)}
    src = B.source_fallback({"yelp": before, "csv": before.filter("seq = 1")})
    assert sorted((r.seq, r.source) for r in src.collect()) == [(1, "csv"), (3, "yelp")]


def test_default_topic_queries_are_the_originals(spark):
    from revlens.operators.modelio import TOPIC_QUERIES
    assert TOPIC_QUERIES == {"food_quality": "food quality taste delicious menu dish meal", "service": "service staff waiter attitude speed helpful",
                             "price": "price cost expensive cheap value worth money", "ambiance": "ambiance atmosphere decor noise clean location"}


def test_sample_key_takes_any_id(spark):
    from revlens.operators.profile import sample_per_label
    rev = spark.createDataFrame([(4_000_000_000 + i, float(i % 5 + 1)) for i in range(50)], "seq long, stars double")
    assert sample_per_label(rev, 5).groupBy().count().first()[0] == 15


def test_near_duplicates_follow_chains_of_copies(spark):
    import random
    rnd = random.Random(4)
    rows = []
    for g in range(100):
        words = [f"w{rnd.randrange(5000)}" for _ in range(40)]
        for c in range(3):
            rows.append((len(rows), "b", " ".join(words)))
            words = words[:]
            for _ in range(1):
                words[rnd.randrange(40)] = f"x{rnd.randrange(5000)}"
    df = spark.createDataFrame(rows, "seq long, business_id string, text string")
    got = {r.seq for r in V.near_duplicates(df).collect()}
    sets = [{t[i:i + 5] for i in range(len(t) - 4)} for _, _, t in rows]
    want = {i for i in range(len(rows)) for j in range(i - i % 3, i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(want) > 150 and len(want - got) == 0


def test_csv_files_are_never_read_whole_to_learn_header_and_encoding(spark, tmp_path):
    from revlens.sources.readers import _csv_heads, load_review_csv
    body = "".join(f'{k % 5 + 1},"café {k}\nsecond line"\n' for k in range(300))
    (tmp_path / "a b+c%.csv").write_bytes(("text_id,stars,text\n" + "".join(f"t{k},4,naïve {k}\n" for k in range(300))).encode())
    (tmp_path / "latin.csv").write_bytes(("stars,text\n" + body).encode("latin-1"))
    (tmp_path / "late.csv").write_bytes(b"stars,text\n" + b"3,plain\n" * 300 + "2,été\n".encode("latin-1"))
    (tmp_path / "bom.csv").write_bytes(("﻿stars,text\r\n" + body.replace("café", "Ω")).encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    names = ("spark.sql.sources.binaryFile.maxLength", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "100")       # a file above the limit of whole values
        spark.conf.set(names[1], "500")       # many splits a file
        heads = _csv_heads(spark, [str(tmp_path)]).collect()
        got = [r.text for r in load_review_csv(spark, str(tmp_path)).collect()]
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    from urllib.parse import unquote
    found = {unquote(r["file"]).rsplit("/", 1)[1]: (R.header_names(bytes(r["head"]).decode()), r["utf8"]) for r in heads}
    assert found == {"a b+c%.csv": (["text_id", "stars", "text"], True), "late.csv": (["stars", "text"], False),
                     "latin.csv": (["stars", "text"], False), "bom.csv": (["stars", "text"], True)}
    assert len(got) == 1201 and {"naïve 7", "café 7\nsecond line", "été", "Ω 7\nsecond line"} <= set(got)


def test_csv_headers_as_pandas_has_them(spark, tmp_path):
    import io
    import pandas as pd
    files = {"repeat": 'text,stars,stars,text\ngood food,5,1,other\n',
             "lines": 'text,"stars","useful\nvotes, all"\n"one\ntwo",4,7\nthree,3,8\n',
             "gaps": '\n\nstars,,text,\n2,x,slow,y\n',
             "inch": 'a 5" cell,text,stars\nz,"a ""quote""",4\n',
             "three": '"a\nb","c\n""d""\ne",text,stars\n1,2,long header,1\n',
             "suffix": 'stars,stars,stars.1,text,stars\n1,2,3,fine,4\n',
             "case": 'Stars,text,stars,seq\n9,mixed case,5,6\n'}
    for name, body in files.items():
        _write(tmp_path / f"{name}.csv", body)
        want = pd.read_csv(io.StringIO(body), dtype=str)
        heads = R._csv_heads(spark, [str(tmp_path / f"{name}.csv")]).collect()
        assert R.header_names(bytes(heads[0]["head"]).decode()) == list(want.columns), name
        got = R.load_review_csv(spark, str(tmp_path / f"{name}.csv"), clean=False).drop("seq").toPandas()
        assert got.values.tolist() == want.where(want.notna(), None).values.tolist(), name
    every = R.load_review_csv(spark, str(tmp_path))
    assert every.count() == 8 and {r.text for r in every.collect()} >= {"good food", "one\ntwo", 'a "quote"', "long header"}
    _write(tmp_path / "never.csv", 'text,"stars\n1,2\n')
    try:
        R.load_review_csv(spark, str(tmp_path / "never.csv"))
        raise AssertionError("expected ValueError")
    except ValueError as e:
        assert "never closes" in str(e)


def test_csv_header_names_follow_pandas(spark):
    import io
    import random
    import pandas as pd
    rnd = random.Random(7)
    for _ in range(300):
        cells = [rnd.choice(["a", "a.1", "b", "", "a.2", "Unnamed: 1"]) for _ in range(rnd.randrange(2, 7))]
        if any(cells):
            assert R.header_names(",".join(cells)) == list(pd.read_csv(io.StringIO(",".join(cells) + "\n")).columns), cells


def test_csv_jobs_do_not_grow_with_the_files(spark, tmp_path):
    jobs = []
    for n in (4, 80):
        d = tmp_path / str(n)
        d.mkdir()
        for i in range(n):
            _write(d / f"{i}.csv", ("text,stars\ncafé food,5\n", "stars,text\n4,fine food\n")[i % 2], ("utf-8", "latin-1")[i % 4 // 2])
        spark.sparkContext.setJobGroup(f"csv-{n}", "jobs of a load")
        assert R.load_review_csv(spark, str(d)).count() == n
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"csv-{n}")))
        spark.sparkContext.setJobGroup("other", "")
    # a listing of more than 32 paths would be a job of its own; here one folder is listed
    assert jobs[1] <= jobs[0] + 1 and jobs[1] < 30


def test_csv_header_scan_aggregates_by_hash(spark, tmp_path, capsys):
    _write(tmp_path / "a.csv", "text,stars\ngood food here,5\n")
    lines = R._csv_lines(spark, [str(tmp_path)])
    some = F.length("value") > 0
    lines.groupBy("file").agg(F.min_by(F.when(some, F.struct("at", "value")), F.when(some, F.col("at"))),
                              F.collect_set(F.is_valid_utf8("value"))).explain()
    plan = capsys.readouterr().out
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan


def test_header_report(spark, tmp_path):
    _write(tmp_path / "a.csv", "text,stars\ngood food here,5\nfine,4\n")
    _write(tmp_path / "b.csv", "rating,text\n1,café\n", "latin-1")
    _write(tmp_path / "c.csv", "rating,text\n1,plain\n")
    got = {(tuple(r.present), tuple(r.missing), r.n_files, r.n_rows) for r in R.header_report(spark, str(tmp_path)).collect()}
    assert got == {(("text", "stars"), (), 1, 2), (("rating", "text"), ("stars",), 2, 2)}
