"""New-word discovery over a corpus: n-grams, cohesion and the entropy of neighbours.

n-grams of 1 to 5 characters are counted inside runs of word characters. A candidate
(2 to 4) stays if it is more frequent than ``min_freq``, its cohesion f(w) * total /
max over splits of first or last character is above ``min_cohesion``, and the
smaller entropy of its left and right neighbours is above ``min_entropy``.

Plan: the corpus is read once, for an aggregation by run and one by n-gram, both combined before the shuffle; the counts are
cut by a checkpoint. Candidates and their parts, which are at least as frequent, are taken from the
frequent n-grams, a small part of it; only the extensions, which may be rare, are read from the whole.
All joins are equi-joins on n-grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphline.shared import cut

MOST = 5


RUNS = r"([\p{L}\p{M}\p{N}\p{Pc}]+)"


def runs(col: Column | str) -> Column:
    """A text's runs of word characters: array of strings."""
    return F.regexp_extract_all(F.col(col) if isinstance(col, str) else col, F.lit(RUNS), F.lit(1))


def grams_of(run: Column, most: int = MOST) -> Column:
    """All n-grams of one run."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.least(F.length(run), F.lit(most))),
            lambda n: F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, n)),
        )
    )


def ngrams(col: Column | str, most: int = MOST) -> Column:
    """All n-grams of a text's runs of word characters: array of strings."""
    return F.flatten(F.transform(runs(col), lambda r: grams_of(r, most)))


def count_ngrams(corpus: DataFrame, text_col: str = "text", most: int = MOST) -> DataFrame:
    """(gram, freq). Equal runs are counted first and taken apart once."""
    each = corpus.select(F.explode(runs(text_col)).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    return each.select("n", F.explode(grams_of(F.col("run"), most)).alias("gram")).groupBy("gram").agg(F.sum("n").alias("freq"))


def discover(corpus: DataFrame, text_col: str = "text", min_freq: int = 10, min_cohesion: float = 80, min_entropy: float = 3) -> DataFrame:
    """(word, freq, entropy); order it by entropy for reading."""
    return from_counts(count_ngrams(corpus, text_col), min_freq, min_cohesion, min_entropy)


def from_counts(counts: DataFrame, min_freq: int = 10, min_cohesion: float = 80, min_entropy: float = 3) -> DataFrame:
    counts = cut(counts)
    total = counts.agg(F.sum("freq").cast("double").alias("total"))
    n = F.length("gram")
    frequent = cut(counts.where((n <= 4) & (F.col("freq") > min_freq)))
    part = lambda name, key: frequent.where(F.length("gram") < 4).select(F.col("gram").alias(key), F.col("freq").alias(name))
    heads = frequent.where(n >= 2).select(
        "gram", "freq",
        F.substring("gram", 1, 1).alias("k1"), F.expr("substring(gram, 2)").alias("k2"),
        F.expr("substring(gram, 1, length(gram) - 1)").alias("k3"), F.expr("right(gram, 1)").alias("k4"),
    )
    for name, key in (("f1", "k1"), ("f2", "k2"), ("f3", "k3"), ("f4", "k4")):
        heads = heads.join(part(name, key), key)
    cohesion = F.col("freq") * F.col("total") / F.greatest(F.col("f1").cast("double") * F.col("f2"), F.col("f3").cast("double") * F.col("f4"))
    words = cut(heads.crossJoin(F.broadcast(total)).where(cohesion > min_cohesion).select(F.col("gram").alias("word"), "freq"))  # total: one row
    longer = counts.where(F.length("gram") >= 3)

    def entropy(core: str, name: str) -> DataFrame:
        ext = longer.select(F.expr(core).alias("word"), F.col("freq").alias("f")).join(words.select("word"), "word", "left_semi")
        # -sum p log2 p with p = f / s is log2 s - sum(f log2 f) / s: one aggregation, no window over a hot word
        return ext.groupBy("word").agg((F.log2(F.sum("f")) - F.sum(F.col("f") * F.log2("f")) / F.sum("f")).alias(name))

    left, right = entropy("substring(gram, 2)", "l"), entropy("substring(gram, 1, length(gram) - 1)", "r")
    return (
        words.join(left, "word").join(right, "word")
        .select("word", "freq", F.least("l", "r").alias("entropy"))
        .where(F.round("entropy", 9) > min_entropy)  # so that sums in another order don't decide
    )


def shares(counts: DataFrame, key: str = "gram", freq: str = "freq") -> DataFrame:
    """key, freq, prob, neg_log10: a distribution table of words or characters."""
    total = counts.agg(F.sum(freq).cast("double").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, freq, (F.col(freq) / F.col("total")).alias("prob"), (-F.log10(F.col(freq) / F.col("total"))).alias("neg_log10"))


def top(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_nth") <= k).drop("_nth")
