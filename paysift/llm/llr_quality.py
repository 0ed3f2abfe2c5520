"""Quality rules: hashed n-gram log-likelihood ratio.

DataFrame functions only.  The word 1-grams to ``order``-grams of every whole
text are hashed into ``buckets``; two add-one smoothed multinomials are counted
over all rows, one of the raw corpus and one of the trusted target (rows whose
label says good quality and not toxic).  A text's score is the mean over its
n-grams of ``ln p_target - ln p_corpus``; it is kept if the base rules pass and
the score reaches ``threshold``.

Counts are aggregated map-side, so a shuffle moves at most ``buckets`` rows a
task.  The ratio table is one array of ``buckets`` floats, a fixed size.

Defined cases: null or empty text has no words, fails the base rules and
scores 0; null labels and labels of unknown rows are ignored; a row labelled
twice is trusted if any label is; without trusted rows every ratio is 0;
extra columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysift.llm.words import WORD, word_array

SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, k: int = 8) -> Column:
    """Words inside ``k``-word windows that occur twice or more.  ``words``
    must be bound (a column or lambda variable), as lambdas refer to it."""
    last = F.size(words) - k + 1
    runs = F.when(last >= 2, F.transform(
        F.sequence(F.lit(1), last),
        lambda i: F.xxhash64(F.slice(words, i, k)))) \
        .otherwise(F.array().cast("array<long>"))

    def marked(pairs: Column) -> Column:
        def equal(p: Column, j: Column) -> Column:
            return (j >= 0) & (j < F.size(pairs)) & \
                (F.get(pairs, j)["h"] == p["h"])
        return F.sort_array(F.transform(F.filter(
            pairs, lambda p, i: equal(p, i - 1) | equal(p, i + 1)),
            lambda p: p["i"]))

    def width(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.when(
            i + 1 < F.size(places),
            F.least(F.lit(k), F.get(places, i + 1) - p)).otherwise(k))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(
            h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(let(pairs, marked), width)
    # the sort runs only for texts that have a repeated window
    return let(runs, lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), covered(h))
        .otherwise(0)).cast("long")


def base_stats(text: Column, words: Column) -> dict[str, Column]:
    """The base measures of a text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(
            F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x)
                           - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words),
    }


def gram_buckets(words: Column, order: int, buckets: int) -> Column:
    """The bucket of every 1-gram to ``order``-gram.  ``words`` must be bound
    (a column or lambda variable), as lambdas refer to it."""
    def grams(k: int) -> Column:
        every = F.transform(words, lambda w, i: F.pmod(F.xxhash64(
            w, *[F.get(words, i + j) for j in range(1, k)]),
            F.lit(buckets)).cast("int"))
        return every if k == 1 else F.slice(
            every, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))
    return F.concat(*[grams(k) for k in range(1, order + 1)])


def bucket_counts(docs: DataFrame, text: str, buckets: int,
                  order: int = 1) -> DataFrame:
    """__b, __n: how many n-grams of all texts fall into each bucket."""
    return docs.select(F.explode(let(word_array(F.col(text)), lambda words:
                                     gram_buckets(words, order, buckets)))
                       .alias("__b")) \
        .groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))


def ratio_table(docs: DataFrame, labels: DataFrame, key: str, text: str,
                buckets: int, order: int = 1) -> DataFrame:
    """One row: __llr, the log ratio of each bucket as array<float>."""
    good = labels.filter((F.col("quality") == 1)
                         & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
                         & F.col(key).isNotNull()) \
        .select(F.col(key)).distinct()
    # a shuffle join at every size: the labels grow with the documents
    trusted = docs.select(key, text).join(good.hint("merge"), key,
                                          "left_semi")
    raw = bucket_counts(docs, text, buckets, order)
    target = bucket_counts(trusted, text, buckets, order) \
        .withColumnRenamed("__n", "__t")
    every = docs.sparkSession.range(buckets) \
        .select(F.col("id").cast("int").alias("__b"))
    # one array of counts for each model: a fixed number of buckets
    t = every.join(raw, "__b", "left").join(target, "__b", "left") \
        .groupBy().agg(F.sort_array(F.collect_list(F.struct(
            "__b", F.coalesce("__n", F.lit(0)).alias("n"),
            F.coalesce("__t", F.lit(0)).alias("t")))).alias("c"),
            F.coalesce(F.sum("__n"), F.lit(0)).alias("sn"),
            F.coalesce(F.sum("__t"), F.lit(0)).alias("st"))
    return t.select(F.transform("c", lambda x: F.when(
        F.col("st") > 0,
        F.log((x["t"] + 1.0) / (F.col("st") + float(buckets)))
        - F.log((x["n"] + 1.0) / (F.col("sn") + float(buckets))))
        .otherwise(0.0).cast("float")).alias("__llr"))


def llr_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id",
                text: str = "text", buckets: int = 16384,
                threshold: float = -0.4, min_words: int = 20,
                max_repeat_pct: int = 30, order: int = 1) -> DataFrame:
    """Per row: key, base measures, base_failed, llr, kept.  ``order`` is the
    longest n-gram counted."""
    table = F.broadcast(ratio_table(docs, labels, key, text, buckets, order))
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit(""))
                       .alias("__text")).crossJoin(table)  # one fixed row

    def mean_ratio(grams: Column) -> Column:
        total = F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(
            F.col("__llr"), g).cast("double"))
        return F.when(F.size(grams) > 0, total / F.size(grams)) \
            .otherwise(0.0)

    def measured(words: Column) -> Column:
        stats = base_stats(F.col("__text"), words)
        return F.struct(*[c.alias(n) for n, c in stats.items()], let(
            gram_buckets(words, order, buckets), mean_ratio).alias("llr"))
    rows = rows.select(key, let(word_array(F.col("__text")), measured)
                       .alias("__m")).select(key, "__m.*")
    failed = (F.col("n_words") < min_words) | \
        (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return rows.withColumn("base_failed", failed) \
        .withColumn("kept", ~F.col("base_failed")
                    & (F.col("llr") >= threshold))
