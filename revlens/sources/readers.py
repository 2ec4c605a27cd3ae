"""Sources and sinks (inventory A1-A11, A13).

Every reader has an explicit schema (no inference) and adds an explicit order column
``seq`` - pandas frames are ordered and keep-first / first-N semantics depend on it.  For
file sources ``seq = struct(file path, row position)``: a bare
``monotonically_increasing_id`` is not enough because Spark packs file splits by size,
not by name.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import na_to_null, py_strip, to_numeric
from ..operators.lineage import materialize
from ..operators.ordering import dense_index
from .literal import literal_table

# --- fixed values -------------------------------------------------------------------
BUSINESS_SCHEMA = T.StructType([
    T.StructField("business_id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("city", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("address", T.StringType()), T.StructField("stars", T.DoubleType()),
    T.StructField("review_count", T.LongType()), T.StructField("categories", T.StringType()),
])
REVIEW_SCHEMA = T.StructType([
    T.StructField("review_id", T.StringType()), T.StructField("business_id", T.StringType()),
    T.StructField("stars", T.DoubleType()), T.StructField("text", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("useful", T.LongType()),
])
CARD_SCHEMA = T.StructType([
    T.StructField("business_name", T.StringType()), T.StructField("aria_label", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("date", T.StringType()),
])
CSV_REQUIRED = ["text", "stars"]
CSV_OPTIONAL_DEFAULTS = {"business_name": "Unknown", "useful": 0}
CSV_ID_PREFIX = "csv_"
# ------------------------------------------------------------------------------------

_CSV_OPTS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
             "mode": "PERMISSIVE"}


def _with_file_order(df: DataFrame) -> DataFrame:
    """Add ``seq = struct(file, row)``.  Multi-line CSV/JSON files are read whole by one
    task, so the row position inside a task is the position inside the file."""
    mid = F.monotonically_increasing_id()
    return df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", mid) \
        .withColumn("seq", F.struct(F.col("_file").alias("file"), F.col("_row").alias("row"))) \
        .drop("_file", "_row")


# A CSV line as the header's reader sees it: a cell, a line that leaves a quoted cell open, and a line
# inside a quoted cell that does not end the record.  Possessive, so that no line needs a deep stack.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
_CELLS = rf'(?:(?:{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+'
_OPENS = rf'^{_CELLS}{_QUOTED}\z'
_STAYS_OPEN = rf'^[^"]*+(?:""[^"]*+)*+(?:"[^,]*+,{_CELLS}{_QUOTED})?\z'


def _csv_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(file, at, value)``: the lines of all files as raw bytes in a splittable scan; ``at`` orders a file's lines."""
    return spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"), "value")


def _csv_heads(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(file, head, utf8)`` of every file that has a header, in a number of jobs that does not depend on the files.

    A3 decides on a file's bytes: UTF-8 when they are valid UTF-8 (no UTF-8 sequence holds a line end, so
    lines are tested one by one), else Latin-1.  The head is the first line that is not empty, and the
    lines after it as far as a quoted cell of the header reaches.  Only files whose first line leaves a
    quote open are read for that a second time.  No file is held whole.
    """
    some = F.length("value") > 0
    # the set of at most two flags has an object buffer, so the lines are aggregated by hash and never sorted
    firsts = materialize(_csv_lines(spark, paths).groupBy("file").agg(
        F.min_by(F.when(some, F.struct("at", "value")), F.when(some, F.col("at"))).alias("first"),
        F.collect_set(F.is_valid_utf8("value")).alias("flags"))
        .where("first is not null")
        .select("file", "first.at", F.col("first.value").alias("value"), (~F.array_contains("flags", False)).alias("utf8"),
                F.regexp_replace("first.value", "^\ufeff", "").rlike(_OPENS).alias("open")))
    whole = firsts.where("not open").select("file", F.col("value").cast("binary").alias("head"), "utf8")
    if firsts.where("open").isEmpty():
        return whole
    opened = firsts.where("open").select("file", F.col("at").alias("start"), "utf8")
    rest = _csv_lines(spark, paths).join(opened, "file").where(F.col("at") >= F.col("start"))
    ends = materialize(rest.where((F.col("at") > F.col("start")) & ~F.col("value").rlike(_STAYS_OPEN))
                       .groupBy("file").agg(F.min("at").alias("end")))
    unclosed = opened.join(ends, "file", "left_anti").first()
    if unclosed:
        raise ValueError(f"the header of {unclosed['file']} opens a quote that the file never closes")
    lines = rest.join(ends, "file").where(F.col("at") <= F.col("end")) \
        .groupBy("file", "utf8").agg(F.array_sort(F.collect_list(F.struct("at", F.col("value").cast("binary").alias("value")))).alias("lines"))
    joined = F.aggregate(F.slice("lines", F.lit(2), F.size("lines")), F.get(F.col("lines.value"), F.lit(0)),
                         lambda acc, x: F.concat(acc, F.lit(bytearray(b"\n")), x["value"]))
    return whole.unionByName(lines.select("file", joined.alias("head"), "utf8"))


def header_names(head: str) -> list[str]:
    """Column names of a header record as pandas gives them: a cell without text is ``Unnamed: i``, a repeated
    name gets the next free suffix (``stars``, ``stars.1``); given names come before unnamed ones."""
    cells = next(csv.reader([head.removeprefix("\ufeff")]), [])
    given = [c or f"Unnamed: {i}" for i, c in enumerate(cells)]
    names: dict[int, str] = {}
    for i in sorted(range(len(cells)), key=lambda i: cells[i] == ""):
        name, n = given[i], 0
        while name in names.values() or (n and name in given):
            n += 1
            name = f"{given[i]}.{n}"
        names[i] = name
    return [names[i] for i in range(len(cells))]


def _spark_names(headers: Sequence[Sequence[str]]) -> dict[str, str]:
    """Column of each header name.  Spark compares names without case and ``seq`` is the row order, so a name that
    clashes with one before it gets a suffix; the names of the loader come first and stay as they are."""
    known = [*CSV_REQUIRED, "review_id", "business_name", "date", "useful"]
    names = dict.fromkeys(n for h in headers for n in h)
    out, taken = {}, {"seq"}
    for name in sorted(names, key=lambda n: n not in known):
        column, n = name, 0
        while column.lower() in taken:
            n += 1
            column = f"{name}.{n}"
        taken.add(column.lower())
        out[name] = column
    return {name: out[name] for name in names}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _csv_frame(spark: SparkSession, paths: Sequence[str] | str) -> tuple[DataFrame, list[list[str]]]:
    """All files in one all-string scan, and their distinct headers.

    ``_kind`` is the number of a row's header.  Header and encoding are data: the files are scanned once by
    cell position, joined with their header, and a column takes the position that its name has there.  The
    driver gets the distinct (header, encoding) pairs only.  Where both encodings occur the scan keeps the
    bytes (Latin-1 maps each byte to a character) and the cells of UTF-8 files are decoded from them.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    heads = materialize(_csv_heads(spark, paths))
    kinds = sorted((bytes(r["head"]), r["utf8"]) for r in heads.select("head", "utf8").distinct().collect())
    if not kinds:
        raise ValueError(f"no CSV file with a header in {paths}")
    headers = [header_names(raw.decode("UTF-8" if utf8 else "ISO-8859-1")) for raw, utf8 in kinds]
    mixed = len({utf8 for _, utf8 in kinds}) > 1
    encoding = "UTF-8" if kinds[0][1] and not mixed else "ISO-8859-1"
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(max(map(len, headers)))])
    scan = _with_file_order(spark.read.options(**_CSV_OPTS, encoding=encoding).schema(schema).csv(paths))
    if len(kinds) == 1:
        scan = scan.withColumn("_kind", F.lit(0))
    else:
        numbers = literal_table(spark, [(bytearray(raw), utf8, i) for i, (raw, utf8) in enumerate(kinds)], "head binary, utf8 boolean, _kind int")
        of_file = heads.join(numbers, ["head", "utf8"]).select(F.col("file").alias("_file"), "_kind")
        scan = scan.withColumn("_file", F.col("seq.file")).join(of_file, "_file").drop("_file")
    decoded = [i for i, (_, utf8) in enumerate(kinds) if utf8] if mixed else []

    def cell(position: int, used: list[int]):
        c = F.col(f"_c{position}")
        if set(used) & set(decoded):
            c = F.when(F.col("_kind").isin(decoded), F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")).otherwise(c)
        return c if len(used) == len(kinds) else F.when(F.col("_kind").isin(used), c)

    def column(name: str):
        places: dict[int, list[int]] = {}
        for i, h in enumerate(headers):
            if name in h:
                places.setdefault(h.index(name), []).append(i)
        return F.coalesce(*[cell(p, used) for p, used in places.items()])

    return scan.select(*[column(n).alias(c) for n, c in _spark_names(headers).items()], "seq", "_kind"), headers


def header_report(spark: SparkSession, paths: Sequence[str] | str, required: Sequence[str] = CSV_REQUIRED) -> DataFrame:
    """A4 as a report: one row per distinct header with its columns (``present``), the required ones it lacks
    (``missing``, both arrays) and the files and rows that have it."""
    frame, headers = _csv_frame(spark, paths)
    counts = frame.groupBy("_kind", F.col("seq.file").alias("file")).agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("_kind").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_rows"))
    said = literal_table(spark, [(i, h, sorted(set(required) - set(h))) for i, h in enumerate(headers)],
                         "_kind int, present array<string>, missing array<string>")
    return said.join(counts, "_kind", "left").groupBy("present", "missing").agg(
        F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))


def read_csv_any_encoding(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """A3: each file is decoded as UTF-8 when its bytes are valid UTF-8, else as Latin-1 (the
    reference's whole-file fallback, decided per file) and read by its own header; columns that
    a file lacks are NULL."""
    return _csv_frame(spark, paths)[0].drop("_kind")


def check_required(columns: DataFrame | Sequence[str], required: Sequence[str] = CSV_REQUIRED) -> None:
    """A4: raise when a required column is missing (lists missing / present / required)."""
    present = list(getattr(columns, "columns", columns))
    missing = sorted(set(required) - set(present))
    if missing:
        raise ValueError(f"CSV is missing required columns {missing}; present {present}; "
                         f"required {sorted(required)}")


def fill_csv_defaults(df: DataFrame) -> DataFrame:
    """A5: add absent optional columns (absent column only, not per null):
    ``review_id = csv_{i}`` with i the 0-based row position before cleaning,
    ``business_name = 'Unknown'``, ``date = NULL``, ``useful = 0``."""
    if "review_id" not in df.columns:
        df = (dense_index(df, [], "seq", name="_i")
              .withColumn("review_id", F.concat(F.lit(CSV_ID_PREFIX), F.col("_i").cast("string"))).drop("_i"))
    return _fill_other_defaults(df)


def _fill_other_defaults(df: DataFrame) -> DataFrame:
    if "business_name" not in df.columns:
        df = df.withColumn("business_name", F.lit(CSV_OPTIONAL_DEFAULTS["business_name"]))
    if "date" not in df.columns:
        df = df.withColumn("date", F.lit(None).cast("string"))
    if "useful" not in df.columns:
        df = df.withColumn("useful", F.lit(CSV_OPTIONAL_DEFAULTS["useful"]).cast("long"))
    return df


def clean_csv(df: DataFrame) -> DataFrame:
    """Drop null text, drop text blank after strip (text itself kept unstripped),
    coerce stars to a number, drop non-numeric, keep 1 <= stars <= 5."""
    stars = to_numeric(F.col("stars"))
    return (df.filter(F.col("text").isNotNull() & (py_strip("text") != ""))
            .withColumn("stars", stars)
            .filter(F.col("stars").isNotNull() & F.col("stars").between(1, 5)))


def _numbered(raw: DataFrame) -> DataFrame:
    """``_i``, the 0-based position of a row in the load, files in the order of their paths.

    One task reads a file from its first row to its last and counts on, so a row's place in its file is its
    number less the file's first; only the rows per file are counted and no row is moved.
    """
    file, row = F.col("seq.file").alias("_file"), F.col("seq.row")
    files = materialize(raw.groupBy(file).agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_first")))
    before = Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return raw.withColumn("_file", file).join(starts, "_file").withColumn("_i", F.col("_shift") + row).drop("_file", "_shift")


def load_review_csv(spark: SparkSession, paths: Sequence[str] | str, clean: bool = True) -> DataFrame:
    """A1 (clean=True) / A2 (clean=False): read review CSV files.

    All cells are read as strings, pandas' NA tokens become NULL, the required columns
    are checked; A1 additionally fills defaults and cleans.
    """
    raw, headers = _csv_frame(spark, paths)
    for h in headers:
        check_required(h)
    raw = raw.select(*[na_to_null(F.col(_quoted(c))).alias(c) if c not in ("seq", "_kind") else F.col(c) for c in raw.columns])
    if not clean:
        return raw.drop("_kind")
    # defaults belong to the files that lack a column; ids number all rows of the load
    defaults = {"business_name": F.lit(CSV_OPTIONAL_DEFAULTS["business_name"]), "useful": F.lit(str(CSV_OPTIONAL_DEFAULTS["useful"]))}
    for name, value in defaults.items():
        lacking = [i for i, h in enumerate(headers) if name not in h]
        if lacking and len(lacking) < len(headers):
            raw = raw.withColumn(name, F.when(F.col("_kind").isin(lacking), value).otherwise(F.col(name)))
    unnamed = [i for i, h in enumerate(headers) if "review_id" not in h]
    if unnamed:
        own = F.col("review_id") if len(unnamed) < len(headers) else F.lit(None).cast("string")
        number = F.concat(F.lit(CSV_ID_PREFIX), F.col("_i").cast("string"))
        raw = _numbered(raw).withColumn(
            "review_id", F.when(F.col("_kind").isin(unnamed), number).otherwise(own)).drop("_i")
    return clean_csv(_fill_other_defaults(raw.drop("_kind")))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> str:
    """CSV with header, UTF-8, no index; a directory of part files (``single_file``
    coalesces to one part - only for small outputs)."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode(mode).option("header", "true").option("escape", '"').option("quote", '"')
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .option("encoding", "UTF-8").csv(path))
    return path


def read_business_json(spark: SparkSession, path: str) -> DataFrame:
    """Business JSON lines with an explicit schema; a missing path gives an empty
    typed frame."""
    try:
        df = spark.read.schema(BUSINESS_SCHEMA).json(path)
        df.schema  # noqa: B018  (resolves the path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return _with_seq_empty(spark, BUSINESS_SCHEMA)
        raise
    return _with_file_order(df)


def read_review_json(spark: SparkSession, path: str, business_ids: Sequence[str] | None = None) -> DataFrame:
    """Review JSON lines, explicit 6-column schema, optional ``business_id`` predicate
    (evaluated in the scan).  Missing path gives an empty typed frame."""
    try:
        df = spark.read.schema(REVIEW_SCHEMA).json(path)
        df.schema  # noqa: B018
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return _with_seq_empty(spark, REVIEW_SCHEMA)
        raise
    if business_ids is not None:
        df = df.filter(F.col("business_id").isin(list(business_ids)))
    return _with_file_order(df.withColumn("useful", F.coalesce("useful", F.lit(0))))


def _with_seq_empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    seq = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])
    return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("seq", seq)]))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Nested results as JSON lines (one object per business)."""
    df.write.mode(mode).json(path)
    return path


def normalise_cards(cards: DataFrame, limit: int | None = 100, scope: str = "business_name",
                    order: str = "seq") -> DataFrame:
    """Captured review cards -> reviews.

    ``stars`` = integer before the first space of the aria label; an empty/missing label
    gives NULL stars; a non-empty label that does not parse as an integer drops the card
    (the reference skips it).  Empty text is dropped; at most ``limit`` cards are kept per
    business in page order (first N, WindowGroupLimit).
    """
    label = F.col("aria_label")
    first = F.element_at(F.split(py_strip(label), "\\s+"), 1)
    ok_int = first.rlike("^[+-]?[0-9]+(_[0-9]+)*$")
    stars = F.when(ok_int, F.regexp_replace(first, "_", "").try_cast("int"))
    has_label = label.isNotNull() & (label != "")
    out = (cards.withColumn("stars", F.when(has_label, stars))
           .filter(~has_label | F.col("stars").isNotNull())
           .filter(F.col("text").isNotNull() & (F.col("text") != "")))
    if limit:
        w = Window.partitionBy(scope).orderBy(order)
        out = out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")
    return out.select(scope, "stars", "text", "date", order)
