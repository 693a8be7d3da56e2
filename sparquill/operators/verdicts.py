"""Frames of per-task verdicts: pivots, compositions, paired arms, exact tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wide(frame: DataFrame, values: list[str], key: str = "task_id", column: str = "condition", value: str = "passed", complete: bool = True) -> DataFrame:
    """One column a condition (means of duplicates); with ``complete`` only rows that have them all."""
    out = frame.groupBy(key).pivot(column, values).agg(F.avg(value))
    return out.na.drop("any", subset=[f"`{v}`" for v in values]) if complete else out


def mcnemar_p(n01: Column, n10: Column) -> Column:
    """Exact two-sided McNemar test: twice the binomial tail of the rarer side, at most 1."""
    m, k = n01 + n10, F.least(n01, n10)
    start = F.struct((-m * F.lit(0.6931471805599453)).alias("log"), F.lit(0.0).alias("sum"))
    step = lambda a, i: F.struct((a["log"] + F.ln((m - i) / (i + 1))).alias("log"), (a["sum"] + F.exp(a["log"])).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0), k.cast("int")), start, step, lambda a: a["sum"])
    return F.when((m == 0) | (n01 == n10), 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def holm(df: DataFrame, p: str = "p", order: str = "ord", alpha: float = 0.05) -> DataFrame:
    """Step-down correction over a small frame: p_holm, significant. Null p stays out."""
    tested, rest = df.filter(F.col(p).isNotNull()), df.filter(F.col(p).isNull())
    by = Window.orderBy(p, order)
    m, rank = F.count(F.lit(1)).over(Window.partitionBy()), F.row_number().over(by)
    out = tested.withColumn("__x", (m - rank + 1) * F.col(p))
    out = out.withColumn("p_holm", F.least(F.lit(1.0), F.max("__x").over(by.rowsBetween(Window.unboundedPreceding, 0)))).drop("__x")
    out = out.withColumn("significant", F.col("p_holm") <= alpha)
    return out.unionByName(rest.withColumn("p_holm", F.lit(None).cast("double")).withColumn("significant", F.lit(None).cast("boolean")))


def condition_table(frame: DataFrame, conditions: list[str], reference: str) -> DataFrame:
    """Per condition over complete tasks: pass rate, tasks, clusters, and the paired contrast with a
    reference condition (difference, discordant counts, exact p, Holm over the contrasts)."""
    w = wide(frame, conditions)
    api = frame.groupBy("task_id").agg(F.min_by("api_name", "ord").alias("api_name"))
    w = w.join(api, "task_id")
    # one conditional aggregation for all arms; no self-joins of the fact table
    aggs = [F.count(F.lit(1)).alias("n"), F.countDistinct("api_name").alias("c")]
    ref = F.col(f"`{reference}`") > 0.5
    for i, c in enumerate(conditions):
        arm = F.col(f"`{c}`") > 0.5
        aggs += [F.avg(f"`{c}`").alias(f"m{i}"), F.count_if(~arm & ref).alias(f"r{i}"), F.count_if(arm & ~ref).alias(f"a{i}")]
    row = w.agg(*aggs)
    base = conditions.index(reference)
    rows = row.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("ord"), F.lit(c).alias("condition"), F.col(f"m{i}").alias("pass_at_1"), F.col("n").alias("n_tasks"), F.col("c").alias("n_clusters"),
                        (F.col(f"m{i}") - F.col(f"m{base}")).alias("delta"), F.col(f"r{i}").alias("n01"), F.col(f"a{i}").alias("n10"),
                        F.when(F.lit(i != base), mcnemar_p(F.col(f"r{i}"), F.col(f"a{i}"))).alias("p"),
                    )
                    for i, c in enumerate(conditions)
                ]
            )
        ).alias("x")
    ).select("x.*")
    return holm(rows)


def composition(frame: DataFrame, conditions: list[str], labels: list[str]) -> DataFrame:
    """Share of each label in each condition, zeros included, in the given orders; shares of one condition sum to 1."""
    aggs = [F.avg((F.col("label") == label).cast("int")).alias(f"s{i}") for i, label in enumerate(labels)]
    by = frame.filter(F.col("condition").isin(conditions)).groupBy("condition").agg(*aggs)
    return by.select("condition", F.explode(F.array(*[F.struct(F.lit(i).alias("label_ord"), F.lit(x).alias("label"), F.col(f"s{i}").alias("share")) for i, x in enumerate(labels)])).alias("x")).select("condition", "x.*")


def offsets(shares: DataFrame) -> DataFrame:
    """Running total of the shares before each label, by condition."""
    before = Window.partitionBy("condition").orderBy("label_ord").rowsBetween(Window.unboundedPreceding, -1)
    return shares.withColumn("offset", F.coalesce(F.sum("share").over(before), F.lit(0.0)))


def grid(frame: DataFrame, rows: list[str], columns: list[str], row: str = "novelty", column: str = "condition") -> DataFrame:
    """Mean, tasks and clusters of a fixed grid; empty cells have n 0 and no mean."""
    cells = frame.groupBy(row, column).agg(F.avg("passed").alias("mean"), F.count(F.lit(1)).alias("n"), F.countDistinct("api_name").alias("n_clusters"))
    spark = frame.sparkSession
    dims = spark.createDataFrame([(r, c) for r in rows for c in columns], f"{row} string, {column} string")
    return F.broadcast(dims).join(cells, [row, column], "left").select(row, column, "mean", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"))


def paired(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Two arms side by side where both have the row: passed_a, passed_b."""
    return a.select(*on, F.col("passed").alias("passed_a")).join(b.select(*on, F.col("passed").alias("passed_b")), on)


def paired_summary(pairs: DataFrame, by: str = "condition") -> DataFrame:
    """Means, difference, discordant counts and exact p of paired arms by group."""
    a, b = F.col("passed_a") > 0.5, F.col("passed_b") > 0.5
    s = pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("passed_a").alias("mean_a"), F.avg("passed_b").alias("mean_b"), F.count_if(~a & b).alias("n01"), F.count_if(a & ~b).alias("n10"))
    return s.withColumn("delta", F.col("mean_a") - F.col("mean_b")).withColumn("p", mcnemar_p(F.col("n01"), F.col("n10")))


def shared_by_all(hits: DataFrame, conditions: list[str]) -> DataFrame:
    """Tasks with a hit under every listed condition; a repeated (task, condition) raises."""
    c = F.col("condition").isin(conditions)
    g = hits.groupBy("task_id").agg(F.count_if((F.col("hit5") == 1) & c).alias("h"), F.count_if(c).alias("n"), F.count_distinct(F.when(c, F.col("condition"))).alias("d"))
    g = g.withColumn("h", F.when(F.col("n") > F.col("d"), F.raise_error(F.lit("repeated task and condition")).cast("bigint")).otherwise(F.col("h")))
    return g.filter(F.col("h") == len(conditions)).select("task_id")


def label_counts_with_total(frame: DataFrame, label: str = "label") -> DataFrame:
    """By label and in total: failures n, what other arms fixed, percent."""
    out = frame.groupingSets([[label], []], label).agg(F.coalesce(F.col(label), F.lit("TOTAL")).alias("row"), F.count(F.lit(1)).alias("n"), F.sum("fixed").alias("fixed"))
    return out.select("row", "n", F.coalesce("fixed", F.lit(0)).alias("fixed"), F.try_divide(100.0 * F.coalesce("fixed", F.lit(0)), F.col("n")).alias("percent"))


def cluster_moments(frame: DataFrame, cluster: str = "api_name", value: str = "passed") -> DataFrame:
    """Sum and count by cluster: all that resampling needs."""
    return frame.groupBy(cluster).agg(F.sum(value).cast("double").alias("s"), F.count(value).alias("c"))


def jackknife(moments: DataFrame, cluster: str = "api_name") -> DataFrame:
    """Mean without each cluster; on cluster sums only."""
    w = Window.partitionBy()
    return moments.select(cluster, F.try_divide(F.sum("s").over(w) - F.col("s"), F.sum("c").over(w) - F.col("c")).alias("mean_without"))


def cell_summary(frame: DataFrame, by: list[str]) -> DataFrame:
    """Rows, pass rate (0 for none), mean pass_at_5 of those that have it, histogram of labels."""
    counts = frame.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"), F.sum("passed").alias("p"), F.sum("pass_at_5").alias("f"), F.count("pass_at_5").alias("fn"))
    out = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("f").alias("f"), F.sum("fn").alias("fn"), F.array_sort(F.collect_list(F.struct("label", "n"))).alias("h"))
    return out.select(*by, "n", F.coalesce(F.try_divide("p", "n"), F.lit(0.0)).alias("pass_rate"), F.try_divide("f", "fn").alias("pass_at_5"), F.map_from_entries("h").alias("labels"))


def min_max(df: DataFrame, by: str, value: str, out: str = "scaled") -> DataFrame:
    """Values scaled to [0, 1] within a group; equal ones become 1. Extremes are aggregated and joined."""
    ends = df.groupBy(F.col(by).alias("__by")).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    scaled = F.when(F.col("__high") == F.col("__low"), 1.0).otherwise((F.col(value) - F.col("__low")) / (F.col("__high") - F.col("__low")))
    return df.join(ends, F.col(by).eqNullSafe(F.col("__by"))).withColumn(out, scaled).drop("__by", "__low", "__high")
