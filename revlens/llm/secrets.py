"""Secret scans by character Markov models.

Rules find the secrets that name themselves: assignments to a password-like name, access keys, long
hex strings.  Beside them, every long token that mixes letters and digits is scored by two first-order
character models, one of random strings and one of ordinary identifiers; where the log-likelihood ratio
speaks clearly for random, the token is a span of kind ``markov``.

The models are trained from labelled samples, a table ``(token, secret)``: character pairs are counted per
label and smoothed, which leaves one number per pair of the alphabet.  The scan is one pass over the texts in
DataFrame expressions, without a shuffle: a pattern's matches and the pieces between them give the
positions, and a token's score is a sum over its character pairs.  Its cost grows with the length of a
text and not with its square, however long a token is and however many spans there are: running sums and
bounds are taken block by block (``with_running``), and a token is cut into characters once.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, col

# Kinds in their order, and their patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_ASSIGNED = 6

# a whole run of token characters, of 16 at least, with a letter and a digit
RUN = "[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{RUN})(?={RUN}{{16}})(?={RUN}*?[0-9])(?={RUN}*?[A-Za-z]){RUN}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."


SPAN = "array<struct<start:int,kind:int,end:int,token:string>>"


def with_running(df: DataFrame, columns: dict, block: int = 256) -> DataFrame:
    """Adds per entry ``name: (array<int> column, start, op)`` the array of ``op`` folded over all places before each place.

    A plain fold copies its growing result at every step.  Here ``block`` places at a time are folded that way, then the
    blocks' totals, which shift their blocks; ``op`` is associative.  Steps are columns of their own, read twice or more
    by the next, so that no step is computed again inside a lambda.
    """
    def plain(a, start, op):
        none = F.expr("array()").cast("array<int>")
        return F.aggregate(a, F.struct(start.alias("s"), none.alias("o")),
                           lambda acc, v: F.struct(op(acc["s"], v).alias("s"), F.concat(acc["o"], F.array(acc["s"])).alias("o")), lambda acc: acc["o"])

    def cut(a):
        last = F.floor((F.size(a) - 1) / block).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(a, i * block + 1, F.lit(block)))
        return F.when(F.size(a) > 0, parts).otherwise(F.expr("array()").cast("array<array<int>>"))

    names = {n: [f"__{n}_{x}" for x in ("values", "parts", "totals", "shift")] for n in columns}
    df = df.withColumns({names[n][0]: v for n, (v, _, _) in columns.items()})
    df = df.withColumns({names[n][1]: cut(F.col(names[n][0])) for n in columns})
    df = df.withColumns({names[n][2]: _totals(F.col(names[n][1]), z, op) for n, (_, z, op) in columns.items()})
    df = df.withColumns({names[n][3]: plain(F.col(names[n][2]), F.lit(z), op) for n, (_, z, op) in columns.items()})

    def shifted(parts, shift, op):
        return F.flatten(F.transform(parts, lambda x, i: plain(x, F.when(F.size(shift) > i, F.get(shift, i)), op)))

    df = df.withColumns({n: shifted(F.col(names[n][1]), F.col(names[n][3]), op) for n, (_, _, op) in columns.items()})
    return df.drop(*[x for v in names.values() for x in v])


def _totals(parts: Column, zero: int, op) -> Column:
    return F.transform(parts, lambda x: F.aggregate(x, F.lit(zero), lambda a, b: op(a, b)))


def with_spans(df: DataFrame, text: str, patterns: dict) -> DataFrame:
    """Adds per entry ``name: (pattern, kind, least_group2)`` all matches, leftmost first and without overlap, as an array of
    (start, kind, end, token) in code points, end exclusive.

    The text is cut at the matches, so a match starts after the pieces and matches before it.
    ``least_group2`` drops matches whose second group is shorter (after matching, as they use up their text).
    """
    def steps(pattern, least):
        whole, pieces = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), F.split(F.col(text), pattern, -1)
        secret = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(2)) if least else whole
        found = F.arrays_zip(pieces.alias("p"), whole.alias("m"), secret.alias("s"))
        return F.when(F.col(text).rlike(pattern), found).otherwise(F.expr("array()").cast("array<struct<p:string,m:string,s:string>>"))

    def placed(step, before, kind, least):
        def one(x, at):
            a = at + F.length(x["p"])
            keep = x["m"].isNotNull() & (F.length(x["s"]) >= least)
            return F.when(keep, F.struct(a.alias("start"), F.lit(kind).alias("kind"), (a + F.length(x["m"])).alias("end"), x["s"].alias("token")))

        return F.filter(F.zip_with(step, before, one), lambda x: x.isNotNull()).cast(SPAN)

    cut = {n: f"__{n}_steps" for n in patterns}
    df = df.withColumns({cut[n]: steps(p, least) for n, (p, _, least) in patterns.items()})
    size = lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))
    df = with_running(df, {f"__{n}_before": (F.transform(cut[n], size), 0, lambda a, b: a + b) for n in patterns})
    df = df.withColumns({n: placed(F.col(cut[n]), F.col(f"__{n}_before"), kind, least) for n, (_, kind, least) in patterns.items()})
    return df.drop(*cut.values(), *[f"__{n}_before" for n in patterns])


RULES = {"assign": (ASSIGN, 0, LEAST_ASSIGNED), "access": (ACCESS, 1, 0), "hex": (HEX, 2, 0)}


def with_base(df: DataFrame, text: str) -> DataFrame:
    """Adds ``base``: the spans of the rules, by start, then kind."""
    return with_spans(df, text, RULES).withColumn("base", F.array_sort(F.concat(*RULES))).drop(*RULES)


def with_untouched(df: DataFrame) -> DataFrame:
    """Adds ``free``: the spans of ``more`` that no span of ``base`` touches, by one sweep from either side."""
    low, high = -1, 2147483647
    df = df.withColumn("__all", F.array_sort(F.concat("base", "more")))
    ends = F.transform("__all", lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(F.lit(low)))
    starts = F.reverse(F.transform("__all", lambda x: F.when(x["kind"] < 3, x["start"]).otherwise(F.lit(high))))
    df = with_running(df, {"__ended": (ends, low, lambda a, b: F.greatest(a, b)), "__begun": (starts, high, lambda a, b: F.least(a, b))})
    near = F.zip_with("__ended", F.reverse("__begun"), lambda a, b: F.struct(a.alias("before"), b.alias("after")))
    free = F.zip_with("__all", near, lambda x, n: F.when((x["kind"] == 3) & (n["before"] <= x["start"]) & (n["after"] >= x["end"]), x))
    return df.withColumn("free", F.filter(free, lambda x: x.isNotNull())).drop("__all", "__ended", "__begun")


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """``samples(token, secret boolean)`` -> log-likelihood ratio, random over ordinary, of each pair of the alphabet.

    Pairs are numbered first * len(ALPHABET) + second.  Null tokens and labels are passed over.  An unseen
    pair has the smoothed probability of its first character; without samples every ratio is 0.
    """
    a = len(ALPHABET)
    t = samples.where("token is not null and secret is not null and length(token) > 1")
    pairs = t.select("secret", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))).alias("pair"))
    seen = pairs.groupBy("secret", "pair").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("pair").rlike("^[A-Za-z0-9+/_=.-]{2}$")).collect()  # at most two rows per pair of the alphabet
    n = {(r.secret, r.pair): r.n for r in seen}
    total = {(s, c): sum(n.get((s, c + d), 0) for d in ALPHABET) for s in (True, False) for c in ALPHABET}

    def p(s, c, d):
        return log((n.get((s, c + d), 0) + smoothing) / (total[s, c] + smoothing * a))

    return [p(True, c, d) - p(False, c, d) for c in ALPHABET for d in ALPHABET]


def ratio(token: Column, model: Column) -> Column:
    """Log-likelihood ratio of a token of alphabet characters."""
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def step(acc, c):  # the previous character's code, and the sum so far
        one = F.when(acc["last"] >= 0, F.coalesce(F.get(model, acc["last"] * len(ALPHABET) + c), F.lit(0.0))).otherwise(F.lit(0.0))
        return F.struct(c.alias("last"), (acc["sum"] + one).alias("sum"))

    return F.aggregate(codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])


def samples_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = 2000, tokens: int = 50_000) -> DataFrame:
    """Labelled samples from a table of texts, bounded by ``rows`` texts in the mean and ``tokens`` tokens per label.

    Secret: what the rules find in the whole table, and random strings (digests of the sampled ids in
    hex and base 64).  Ordinary: the words of the sampled texts that no rule covers.
    """
    t = docs.select(F.coalesce(col(text).cast("string"), F.lit("")).alias("t"), col(doc_id).cast("string").alias("id"))
    n = max(1, t.count())
    drawn = t.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 20)) < max(1, (rows << 20) // n))
    named = with_base(t, "t").select(F.explode(F.col("base").getField("token")).alias("token"))
    digest = F.sha2(F.coalesce("id", F.lit("")).cast("binary"), 256)
    random = drawn.select(F.explode(F.array(F.substring(digest, 1, 40), F.base64(F.unhex(digest)))).alias("token"))
    words = drawn.select(F.explode(F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).alias("token")) \
        .where(F.col("token").rlike("^[A-Za-z_-]{2,}[.]?$") | F.col("token").rlike("^[a-z]+[0-9]{1,4}$"))

    def some(df, secret):
        return df.distinct().orderBy(F.xxhash64(F.lit(5), "token"), "token").limit(tokens).withColumn("secret", F.lit(secret))

    return some(named.union(random), True).union(some(words, False))


def scan(docs: DataFrame, model: list[float], text: str = "text", doc_id: str = "doc_id", least: float = 8.0) -> DataFrame:
    """One row per document: doc_id and ``found``, array of (start, kind, end, token) by start, then kind.

    Kinds are places in ``KINDS``.  A ``markov`` span is a token whose log-likelihood ratio is ``least`` or
    more and which no rule's span touches.  Null texts count as empty and have no span; repeated rows
    come back each; an empty table gives an empty result.
    """
    t = F.coalesce(col(text).cast("string"), F.lit(""))
    llr = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    d = with_base(docs.select(col(doc_id).alias("doc_id"), t.alias("t"), llr.alias("llr")), "t")
    d = with_untouched(with_spans(d, "t", {"more": (CANDIDATE, 3, 0)}))
    added = F.filter("free", lambda x: ratio(x["token"], F.col("llr")) >= least)
    return d.select("doc_id", F.array_sort(F.concat("base", added)).alias("found"))


def listed(found: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts per rule, digest of the rules' spans, and all spans as text."""
    base = F.filter("found", lambda x: x["kind"] < 3)
    n = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
