"""Quality rules with a hashed n-gram likelihood ratio (operator 2), in DataFrame functions only.

Base rules count words, symbols, repeated lines and words in repeated 3-word windows. Documents
that pass them are judged by the log-likelihood ratio of their hashed word 1- and 2-grams between
two multinomials over BUCKETS buckets: that of trusted documents (label quality 1) and that of
the whole corpus, both with one count added to each bucket. The ratio is divided by the number
of n-grams and compared with a fixed threshold, so the same document always gets the same verdict.

Counting is one scan with aggregation before the shuffle (at most BUCKETS rows a task); the
table of BUCKETS log ratios, bounded by that parameter, goes through the driver; scoring is one
more scan without a shuffle.

Cases: a null text has no words and fails the base rules; without trusted labels all ratios are
0 and the threshold, being negative, keeps what passes the base rules; labels that are null or of
unknown documents don't count; a document labelled trusted in any row is trusted; repeated rows
count each and are judged alike; other columns are kept by the operator, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, words_of

BUCKETS = 8192
#: Least log-likelihood ratio for each n-gram.
THRESHOLD = -0.06
#: Ids of trusted documents are broadcast up to this many and joined by shuffle beyond.
BROADCAST_IDS = 500_000
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _grams(words: Column) -> Column:
    """Buckets of a text's word 1- and 2-grams."""
    n = F.size(words)
    ones = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    at = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    twos = F.transform(at, lambda i: F.pmod(F.xxhash64(words[i], words[i + 1]), F.lit(BUCKETS)).cast("int"))
    return F.concat(ones, twos)


def base_rules(df: DataFrame, text: str = "text", words: str = "__words") -> DataFrame:
    """df with the column ``words`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = text_of(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    df = df.withColumn(words, words_of(F.col(text)))
    w = F.col(words)
    df = df.withColumn("n_words", F.size(w).cast("long"))
    at = F.when(F.size(w) > 2, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("__windows", F.transform(at, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))
    h = F.col("__windows")
    # windows in the order of their hash, only where some hash repeats; each step is a column of
    # its own, so that no function of a whole array is computed again for each element
    order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("__order", F.when(F.size(F.array_distinct(h)) < F.size(h), order)).drop("__windows")
    o = F.col("__order")
    equal = lambda e, k: e["h"] == F.get(o, k)["h"]
    flagged = F.transform(o, lambda e, k: F.when(equal(e, k - 1) | equal(e, k + 1), e["i"]))
    df = df.withColumn("__at", F.sort_array(F.array_compact(flagged))).drop("__order")
    p = F.col("__at")
    covered = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    df = df.withColumn("__lines", lines).select(
        "*",
        F.length(F.translate(t, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__at", "__lines")


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """For each bucket, the log of its share among trusted documents over its share in the corpus.
    trusted: one column doc_id."""
    ids = trusted.select(F.col("doc_id").alias("__id"), F.lit(1).alias("__good")).filter("__id is not null").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("__id"), "left")
    grams = marked.select("__good", words_of(F.col("text")).alias("__w")).select("__good", F.explode(_grams(F.col("__w"))).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("__good").alias("good")).collect()  # at most BUCKETS rows
    raw, good = [1] * BUCKETS, [1] * BUCKETS
    for r in counts:
        raw[r["b"]] += r["raw"]
        good[r["b"]] += r["good"]
    if sum(good) == BUCKETS:
        return [0.0] * BUCKETS
    shift = math.log(sum(raw) / sum(good))
    return [round(math.log(g / r) + shift, 6) for g, r in zip(good, raw, strict=True)]


def judge(df: DataFrame, ratios: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with the base rules' columns, ``llr`` (for each n-gram) and ``kept``."""
    df = base_rules(df, text)
    table_of = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    df = df.withColumn("__grams", _grams(F.col("__words")))
    total = F.aggregate("__grams", F.lit(0.0), lambda a, b: a + table_of[b])
    df = df.withColumn("llr", F.when(F.size("__grams") > 0, total / F.size("__grams")).otherwise(0.0))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).drop("__words", "__grams")


def op2_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over the whole of documents; trusted are those that labels call good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = log_ratios(docs, table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))
    return judge(docs, ratios).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
