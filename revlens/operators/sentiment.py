"""Built-in scoring path that stands in for the text model (inventory E8-E11).

The reference asks a hosted text model for labels, percentages, highlights and per-topic
scores.  No network model is shipped here; these operators produce the same result
shapes from the data itself, distributed:

* E8  a Spark ML text classifier trained on star-derived labels (``train_classifier``),
* E9  per-scope percentages from labels, closed to 100 with half-even rounding,
* E10 highlight phrases: bigrams whose document frequency in one class most exceeds the
      other classes', top 5 per (scope, class),
* E11 per-topic mentions / sentiment / score / keywords from a topic lexicon (a bounded,
      user-extendable word list attached to every row, no join of words x reviews).

A user's own model plugs in through ``modelio.score_batches`` (E7) instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import write_table
from .modelio import SENTIMENTS, TOPIC_QUERIES, TOPICS
from .ordering import _cols
from .profile import attach_one_row, stars_to_label
from ..sources.literal import literal_table

# --- fixed values -------------------------------------------------------------------
MAX_HIGHLIGHTS = 5
MAX_TOPIC_KEYWORDS = 4
TOKEN_PATTERN = "[\\p{L}\\p{N}_]+"
# ------------------------------------------------------------------------------------


def train_classifier(labelled: DataFrame, text: str = "text", label: str = "label", seed: int = 42,
                     num_features: int = 1 << 18, max_iter: int = 50):
    """Fit ``RegexTokenizer -> StopWordsRemover -> HashingTF -> IDF ->
    LogisticRegression`` on labelled reviews (labels from stars by default).  Training is
    distributed (IDF and the optimiser are aggregates over the whole table).  Reviews are tokenised
    and counted in one pass, whose term counts are written: the later stages are fitted on those."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StopWordsRemover, StringIndexer

    rows = labelled.filter(F.col(text).isNotNull())
    words = [
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True),
        StopWordsRemover(inputCol="_tok", outputCol="_tok2"),
        HashingTF(inputCol="_tok2", outputCol="_tf", numFeatures=num_features),
    ]
    counted = write_table(PipelineModel(words).transform(rows).select(label, "_tf"), "classifier-terms")
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(counted)
    counted = index.transform(counted)
    idf = IDF(inputCol="_tf", outputCol="_x").fit(counted)
    model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=max_iter, regParam=0.01).fit(idf.transform(counted))
    return PipelineModel([index, *words, idf, model])


def apply_classifier(model, reviews: DataFrame, out: str = "predicted") -> DataFrame:
    """Label reviews with a fitted ``train_classifier`` model (index -> label name)."""
    labels = model.stages[0].labels
    pred = model.transform(reviews)
    name = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
    return pred.withColumn(out, name).drop("_y", "_tok", "_tok2", "_tf", "_x", "rawPrediction", "probability",
                                          "prediction")


def sentiment_percentages(labelled: DataFrame, scope: Sequence[str] = ("business_id",),
                          label: str = "label") -> DataFrame:
    """Per scope, percentage of positive / negative labels rounded half-even,
    neutral = 100 - positive - negative (sums to 100 by construction)."""
    scope = _cols(scope)
    n = F.count(F.lit(1))
    agg = labelled.groupBy(*scope).agg(
        F.rint(F.count_if(F.col(label) == "positive") * 100.0 / n).alias("positive"),
        F.rint(F.count_if(F.col(label) == "negative") * 100.0 / n).alias("negative"),
        n.alias("n_reviews"))
    return agg.withColumn("neutral", 100 - F.col("positive") - F.col("negative"))


def _tokens(c) -> F.Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)


def _bigrams(tokens: str) -> F.Column:
    """Consecutive token pairs of an (already materialised) token-array column."""
    t = F.col(tokens)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def highlight_phrases(labelled: DataFrame, scope: Sequence[str] = ("business_id",), label: str = "label",
                      id_col: str = "review_id", text: str = "text", n: int = MAX_HIGHLIGHTS) -> DataFrame:
    """Per scope and class (positive / negative), the ``n`` bigrams with the largest
    contrast ``df_in_class / n_in_class - df_elsewhere / n_elsewhere`` (> 0), ties by
    phrase.  Each review contributes a phrase once.

    One aggregate per (scope, phrase) counts the reviews of each class and of all classes
    (map-side combined), one aggregate per scope gives the class sizes, which are written: the two meet in a
    join on the scope that shuffles no phrase while the sizes are small enough to broadcast, then each phrase
    row becomes one row per class and a partial top-n keeps the best per (scope, class)."""
    scope = _cols(scope)
    classes = ["positive", "negative"]
    lab = F.col(label)
    # tokens are materialised once per review; the bigram lambda only indexes into them
    tok = labelled.select(*scope, label, _tokens(F.col(text)).alias("_t"))
    # explode would first ask for the size of the array, and so compute tokens and bigrams of each review twice
    bi = (tok.select(*scope, label, F.explode_outer(F.array_distinct(_bigrams("_t"))).alias("phrase"))
          .filter(F.col("phrase").isNotNull()))
    per_phrase = bi.groupBy(*scope, "phrase").agg(
        *[F.count_if(lab == c).alias(f"_df_{c}") for c in classes], F.count(F.lit(1)).alias("df_all"))
    sizes = labelled.groupBy(*scope).agg(
        *[F.count_if(lab == c).alias(f"_n_{c}") for c in classes], F.count(F.lit(1)).alias("n_all"))
    # a shuffle by scope would bring all phrases of a large scope to one task: the sizes, of known bytes, are broadcast
    if scope:
        sizes = write_table(sizes, "highlight-sizes")
    j = per_phrase.join(sizes, scope) if scope else attach_one_row(per_phrase, sizes)
    per_class = F.explode(F.array(*[
        F.struct(F.lit(c).alias(label), F.col(f"_df_{c}").alias("df"), F.col(f"_n_{c}").alias("n_class"))
        for c in classes])).alias("_c")
    s = (j.select(*scope, "phrase", "df_all", "n_all", per_class)
         .select(*scope, "phrase", "_c.*", "df_all", "n_all")
         .filter(F.col("df") > 0)
         .withColumn("contrast", F.col("df") / F.col("n_class")
                     - F.when(F.col("n_all") > F.col("n_class"),
                              (F.col("df_all") - F.col("df")) / (F.col("n_all") - F.col("n_class"))).otherwise(0.0))
         .filter(F.col("contrast") > 0))
    w = Window.partitionBy(*scope, label).orderBy(F.desc("contrast"), F.desc("df"), F.asc("phrase"))
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(
        *scope, label, "rank", "phrase", "df", "contrast")


def lexicon_table(spark, topics: dict[str, str] | None = None) -> DataFrame:
    """Topic lexicon (topic, topic_ord, word) from the topic query words."""
    topics = topics or TOPIC_QUERIES
    order = {t: i for i, t in enumerate(TOPICS)}
    rows = []
    for j, (t, q) in enumerate(topics.items()):
        for w in dict.fromkeys(q.lower().split()):
            rows.append((t, order.get(t, len(TOPICS) + j), w))
    return literal_table(spark, rows, "topic string, topic_ord int, word string")


def topic_stats(reviews: DataFrame, lexicon: DataFrame, scope: Sequence[str] = ("business_id",),
                id_col: str = "review_id", text: str = "text", stars: str = "stars",
                label: str | None = None) -> DataFrame:
    """Per (scope, topic): ``mentions`` = reviews containing a lexicon word,
    ``score`` = mean stars of those reviews (1 dp, half-even), ``sentiment`` = most frequent
    label among them (ties positive, negative, neutral), ``keywords`` = up to 4 matched
    words by frequency.  The lexicon is bounded and attached to every row as an array."""
    scope = _cols(scope)
    lab = F.col(label) if label else stars_to_label(stars)
    lex = lexicon.agg(F.collect_list(F.struct("topic", "topic_ord", "word")).alias("_lex"))
    toks = reviews.select(*scope, id_col, F.col(stars).alias("_stars"), lab.alias("_label"),
                          F.array_distinct(_tokens(F.col(text))).alias("_t"))
    hits = attach_one_row(toks, lex).select(
        *scope, id_col, "_stars", "_label",
        F.explode(F.filter("_lex", lambda e: F.array_contains(F.col("_t"), e["word"]))).alias("h"))
    hits = hits.select(*scope, id_col, "_stars", "_label", "h.topic", "h.topic_ord", "h.word")
    per_review = hits.groupBy(*scope, "topic", "topic_ord", id_col).agg(
        F.first("_stars").alias("_stars"), F.first("_label").alias("_label"))
    agg = per_review.groupBy(*scope, "topic", "topic_ord").agg(
        F.count(F.lit(1)).alias("mentions"), F.avg("_stars").alias("_avg"),
        *[F.count_if(F.col("_label") == s).alias(f"_n_{s}") for s in SENTIMENTS])
    p, n, u = (F.col(f"_n_{s}") for s in SENTIMENTS)
    dom = F.when((p >= n) & (p >= u), "positive").when(n >= u, "negative").otherwise("neutral")
    words = hits.groupBy(*scope, "topic", "word").agg(F.count(F.lit(1)).alias("_wn"))
    ww = Window.partitionBy(*scope, "topic").orderBy(F.desc("_wn"), F.asc("word"))
    kw = (words.withColumn("_r", F.row_number().over(ww)).filter(F.col("_r") <= MAX_TOPIC_KEYWORDS)
          .groupBy(*scope, "topic").agg(F.array_sort(F.collect_list(F.struct("_r", "word"))).alias("_k"))
          .select(*scope, "topic", F.transform("_k", lambda x: x["word"]).alias("keywords")))
    return agg.join(kw, [*scope, "topic"]).select(
        *scope, "topic", "topic_ord", dom.alias("sentiment"), F.bround("_avg", 1).alias("score"),
        F.col("mentions").cast("long").alias("mentions"), "keywords")
