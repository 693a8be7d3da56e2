"""Mixing sources to target weights by temperature (operator 4), in DataFrame functions only.

A source's weight is its share of all tokens to the power alpha, normalised. Alpha is the largest
in [0, 1] whose weights have at least ENTROPY of the greatest possible entropy, or a larger one
where that would repeat some source more than REPEATS times. Both bounds are found by bisection
to 24 bits, eight halvings in one distributed aggregate. The budget of tokens is then dealt out
by weight: each source is read in whole passes, and the rest from the start of one more pass,
whose order is a permutation by hash. The permutation's blocks (by the hash's first three digits,
then six) are totalled first, so that only the block in which the budget ends, a part in 16 million
of its source, is ranked row by row; a hot source is never gathered in one task.

Tokens are the words of the whole text. Result: the number of copies of every document.

Cases: a null source counts as the source named by the empty text; null and empty texts have no
tokens and follow their source's passes; rows of one doc_id stand at one place of the order and
are taken together; sources without tokens are read in one pass; without any tokens every
document has one copy; other columns are kept by mix, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table, text_of

ENTROPY = 0.95
REPEATS = 4.0
BUDGET = 1.0
SEED = 7
#: Digits of the key that name the blocks to look into, and those into which these are parted.
LENGTHS = ((0, 3), (3, 6))
#: Rows of the table of sources that are broadcast at most; more are joined by shuffle.
BROADCAST_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def _source(col: str = "source") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def _key(doc_id: Column, whole: Column) -> Column:
    """Place of a document in the pass after ``whole`` passes."""
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.concat(F.md5(F.concat(F.lit(f"{SEED}:"), whole.cast("string"), F.lit(":"), name)), F.lit(":"), name)


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens) of every document."""
    return docs.select(F.col(doc_id).alias("doc_id"), _source(source).alias("source"), F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("n_tokens"))


def _measures(shares: DataFrame, low: float, step: float) -> list:
    """Log of the sum of weights, entropy and largest weight over share, at 255 exponents above low."""
    points = shares.select("p", F.explode(F.sequence(F.lit(1), F.lit(255))).alias("j")).withColumn("a", F.lit(low) + F.col("j") * F.lit(step))
    w = F.pow("p", "a")
    sums = points.groupBy("j", "a").agg(F.sum(w).alias("s"), F.sum(w * F.ln("p")).alias("t"), F.max(w / F.col("p")).alias("r"))
    return sorted(sums.select("j", (F.ln("s") - F.col("a") * F.col("t") / F.col("s")).alias("entropy"), (F.col("r") / F.col("s")).alias("repeats")).collect())


def exponent(shares: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET) -> float:
    """Alpha for the shares p of a table of sources."""
    n = shares.count()
    if n < 2:
        return 1.0
    want = entropy * math.log(n)
    bounds = []
    for good in (lambda x: x["entropy"] < want, lambda x: x["repeats"] * budget <= repeats):
        # the points are false up to some place and true from there on
        low, step = 0.0, 1 / 256
        for _ in range(3):
            low += step * next((x["j"] - 1 for x in _measures(shares, low, step) if good(x)), 255)
            step /= 256
        bounds.append((low, low + step * 256))
    whole = shares.agg((-F.sum(F.col("p") * F.ln("p"))).alias("h"), (1 / (F.count("*") * F.min("p"))).alias("r")).first()
    by_entropy = 1.0 if whole["h"] >= want else bounds[0][0]
    by_repeats = 0.0 if whole["r"] * budget <= repeats else bounds[1][1]
    return max(by_entropy, by_repeats)


def plan(sized: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET) -> DataFrame:
    """(source, weight, passes, cut): how often each source is read whole, and up to which key once more."""
    totals = checkpoint(sized.groupBy("source").agg(F.sum("n_tokens").alias("n")))
    total = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    if not total:
        return totals.select("source", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("passes"), F.lit("").alias("cut"))
    shares = checkpoint(totals.filter("n > 0").withColumn("p", F.col("n") / F.lit(float(total))))
    alpha = exponent(shares, entropy, repeats, budget)
    scale = shares.agg(F.sum(F.pow("p", F.lit(alpha))).alias("s")).first()["s"]
    weight = F.pow("p", F.lit(alpha)) / F.lit(scale)
    goal = F.round(weight * F.lit(budget * total)).cast("long")
    goals = shares.select("source", weight.alias("weight"), "n", goal.alias("goal"))
    goals = goals.select("source", "weight", F.floor(F.col("goal") / F.col("n")).alias("passes"), (F.col("goal") - F.floor(F.col("goal") / F.col("n")) * F.col("n")).alias("rest"))
    goals = checkpoint(goals)
    keyed = sized.join(_small(goals), "source").withColumn("key", _key(F.col("doc_id"), F.col("passes")))
    # the block of each source in which the budget ends, by ever longer prefixes of the key, then by rows
    edge, cuts = goals.select("source", F.lit("").alias("block"), F.lit(0).cast("long").alias("before")), []
    for length in LENGTHS:
        within = keyed.withColumn("block", F.substring("key", 1, length[0])).join(_small(edge), ["source", "block"])
        blocks = within.groupBy("source", F.substring("key", 1, length[1]).alias("block"), "rest", "before").agg(F.sum("n_tokens").alias("n"), F.max("key").alias("last"))
        blocks = checkpoint(blocks.withColumn("end", F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("block"))))
        cuts.append(blocks.filter("end <= rest").groupBy("source").agg(F.max("last").alias("cut")))
        edge = blocks.filter("end > rest and end - n <= rest").select("source", "block", (F.col("end") - F.col("n")).alias("before"))
    within = keyed.withColumn("block", F.substring("key", 1, LENGTHS[-1][1])).join(_small(edge), ["source", "block"])
    upto = F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("key"))
    cuts.append(within.withColumn("upto", upto).filter("upto <= rest").groupBy("source").agg(F.max("key").alias("cut")))
    cuts = reduce(DataFrame.unionByName, cuts).groupBy("source").agg(F.max("cut").alias("cut"))
    known = goals.join(cuts, "source", "left").select("source", "weight", "passes", F.coalesce("cut", F.lit("")).alias("cut"))
    empty = totals.filter("n = 0").select("source", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("passes"), F.lit("").alias("cut"))
    return checkpoint(known.unionByName(empty))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else df


def _copies(passes: str = "passes", doc_id: str = "doc_id") -> Column:
    return (F.col(passes) + F.when(_key(F.col(doc_id), F.col(passes)) <= F.col("cut"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with every row as often as the mixture holds it."""
    planned = plan(checkpoint(sizes(docs, doc_id, text, source))).select(F.col("source").alias("__source"), F.col("passes").alias("__passes"), "cut")
    planned = planned.withColumnRenamed("cut", "__cut")
    joined = docs.withColumn("__name", _source(source)).join(_small(planned), F.col("__name") == F.col("__source"))
    extra = F.when(_key(F.col(doc_id), F.col("__passes")) <= F.col("__cut"), 1).otherwise(0)
    copies = (F.col("__passes") + extra).cast("int")
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over the whole of documents: copies of each in the mixture."""
    sized = checkpoint(sizes(table(spark, sf_dir, "documents")))
    return sized.join(_small(plan(sized)), "source").select("doc_id", "source", "n_tokens", _copies().alias("copies"))


OP4_SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM documents),
totals AS (SELECT source, sum(n_tokens)::BIGINT AS n FROM sized GROUP BY source),
shares AS (SELECT source, n, n / (SELECT sum(n) FROM totals)::DOUBLE AS p FROM totals WHERE n > 0),
ps AS (SELECT list(p ORDER BY source) AS p FROM shares),
bis(side, k, lo, hi) AS (
  SELECT side, 0, 0.0::DOUBLE, 1.0::DOUBLE FROM (VALUES ('entropy'), ('repeats')) v(side)
  UNION ALL
  SELECT side, k + 1,
         CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (SELECT side, k, lo, hi, mid,
               CASE WHEN side = 'entropy'
                    THEN ln(s) - mid * t / s < {ENTROPY} * ln(len(p))
                    ELSE r / s * {BUDGET} <= {REPEATS} END AS ok
        FROM (SELECT side, k, lo, hi, p, (lo + hi) / 2 AS mid,
                     list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) AS s,
                     list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2) * ln(x))) AS t,
                     list_max(list_transform(p, lambda x: pow(x, (lo + hi) / 2) / x)) AS r
              FROM bis, ps WHERE k < 24))),
whole AS (SELECT -list_sum(list_transform(p, lambda x: x * ln(x))) AS h, 1 / (len(p) * list_min(p)) AS r, len(p) AS n FROM ps),
alpha AS (
  SELECT CASE WHEN n < 2 THEN 1.0 ELSE greatest(
    CASE WHEN h >= {ENTROPY} * ln(n) THEN 1.0 ELSE (SELECT lo FROM bis WHERE side = 'entropy' AND k = 24) END,
    CASE WHEN r * {BUDGET} <= {REPEATS} THEN 0.0 ELSE (SELECT hi FROM bis WHERE side = 'repeats' AND k = 24) END) END AS a
  FROM whole),
goals AS (
  SELECT source, n, round(pow(p, (SELECT a FROM alpha)) / (SELECT sum(pow(p, (SELECT a FROM alpha))) FROM shares)
                          * ({BUDGET} * (SELECT sum(n) FROM totals)))::BIGINT AS goal FROM shares),
plan AS (
  SELECT source, goal // n AS passes, goal % n AS rest FROM goals
  UNION ALL SELECT source, 1, -1 FROM totals WHERE n = 0),
ranked AS (
  SELECT doc_id, source, n_tokens, passes, rest,
         sum(n_tokens) OVER (PARTITION BY source
           ORDER BY md5('{SEED}:' || passes::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')), coalesce(doc_id::VARCHAR, '')) AS upto
  FROM sized JOIN plan USING (source))
SELECT doc_id, source, n_tokens, (passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM ranked
"""
