"""Resampling intervals and permutation tests over cluster sums.

Only (cluster, sum, count) rows reach Python: one group is one statistic, and its size the
number of clusters, not of tasks.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import is_bypass_candidate
from ..functions.text import bypass_mode
from . import verdicts

BOOT, SEED = 10_000, 20260912
PERM, TEST_SEED = 5_000, 2026


def bca(sums: np.ndarray, counts: np.ndarray, alpha: float = 0.05, n_boot: int = BOOT, seed: int = SEED) -> tuple[float, float, float]:
    """Point and bias-corrected accelerated interval of the mean under resampling of clusters."""
    k = len(sums)
    if not k or not counts.sum():
        return (math.nan,) * 3
    point = sums.sum() / counts.sum()
    draws = np.random.default_rng(seed).integers(0, k, (n_boot, k))
    reps = sums[draws].sum(1) / counts[draws].sum(1)
    below = float((reps < point).mean())
    if below in (0.0, 1.0):
        low, high = np.percentile(reps, [100 * alpha / 2, 100 * (1 - alpha / 2)])
        return point, low, high
    unit = NormalDist()
    z0 = unit.inv_cdf(below)
    rest = counts.sum() - counts
    acc = 0.0
    if k > 1 and (rest > 0).all():
        jack = (sums.sum() - sums) / rest
        d = jack.mean() - jack
        scale = (d**2).sum() ** 1.5
        acc = (d**3).sum() / (6 * scale) if scale else 0.0
    ends = []
    for a in (alpha / 2, 1 - alpha / 2):
        z = z0 + unit.inv_cdf(a)
        p = unit.cdf(z0 + z / (1 - acc * z)) if 1 - acc * z else a
        ends.append(100 * min(max(p, 1e-6), 1 - 1e-6))
    low, high = np.percentile(reps, ends)
    return point, low, high


def mean_ci(frame: DataFrame, by: list[str], value: str = "passed", cluster: str = "api_name", order: str = "ord") -> DataFrame:
    """Interval of the mean for each group: point, lo, hi, n, n_clusters. Clusters go to the
    resampler in the order they first appear."""
    sums = frame.groupBy(*by, cluster).agg(F.min(order).alias("__o"), F.sum(value).cast("double").alias("__s"), F.count(value).cast("double").alias("__c"))
    kinds = dict(frame.dtypes)

    def run(key, pdf):
        pdf = pdf.sort_values("__o")
        s, c = pdf["__s"].to_numpy(), pdf["__c"].to_numpy()
        point, low, high = bca(s, c)
        return pd.DataFrame([[*key, point, low, high, int(c.sum()), len(c)]], columns=[*by, "point", "lo", "hi", "n", "n_clusters"])

    return sums.groupBy(*by).applyInPandas(run, ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", point double, lo double, hi double, n long, n_clusters long")


def interaction(diffs: DataFrame, by: str, side: str, value: str = "diff", cluster: str = "api_name") -> DataFrame:
    """Difference between the two sides' task-weighted means, its cluster-bootstrap interval, and a
    two-sided permutation p over clusters. ``side`` is true for the first side."""
    sums = diffs.groupBy(by, cluster, side).agg(F.sum(value).cast("double").alias("__s"), F.count(value).cast("double").alias("__c"))
    kind = dict(diffs.dtypes)[by]

    def run(key, pdf):
        pdf = pdf.sort_values([side, cluster], ascending=[False, True])
        s, c, first = pdf["__s"].to_numpy(), pdf["__c"].to_numpy(), pdf[side].to_numpy(bool)
        if first.all() or not first.any():
            return pd.DataFrame(columns=[by, "delta", "lo", "hi", "p"])
        rng = np.random.default_rng(TEST_SEED)
        gap = lambda f: s[f].sum() / c[f].sum() - s[~f].sum() / c[~f].sum()
        delta = gap(first)
        a, b = np.flatnonzero(first), np.flatnonzero(~first)
        ia, ib = a[rng.integers(0, len(a), (BOOT, len(a)))], b[rng.integers(0, len(b), (BOOT, len(b)))]
        reps = s[ia].sum(1) / c[ia].sum(1) - s[ib].sum(1) / c[ib].sum(1)
        hits = sum(abs(gap(rng.permutation(first))) >= abs(delta) - 1e-12 for _ in range(PERM))
        low, high = np.percentile(reps, [2.5, 97.5])
        return pd.DataFrame([[key[0], delta, low, high, (hits + 1) / (PERM + 1)]], columns=[by, "delta", "lo", "hi", "p"])

    return sums.groupBy(by).applyInPandas(run, f"`{by}` {kind}, delta double, lo double, hi double, p double")


def paired_diff_ci(pairs: DataFrame, by: list[str], a: str = "passed_a", b: str = "passed_b", **options) -> DataFrame:
    """Interval of mean(a) - mean(b) of arms scored on the same tasks; clusters are shared by both."""
    return mean_ci(pairs.withColumn("__d", F.col(a) - F.col(b)), by, "__d", **options)


def intervals(frame: DataFrame, by: list[str], measures: dict[str, Column], cluster: str = "api_name", order: str = "ord") -> DataFrame:
    """For each group, of each measure the mean in percent and its interval: name, name_lo, name_hi;
    null where the measure has no value."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), v.cast("double").alias("v")) for m, v in measures.items()]))
    long = frame.select(*by, cluster, order, each.alias("x")).select(*by, cluster, order, "x.m", "x.v").filter("v is not null")
    found = mean_ci(long, [*by, "m"], "v", cluster, order).select(*by, "m", *[(100 * F.col(c)).alias(c) for c in ("point", "lo", "hi")])
    at = lambda m, c: F.max(F.when(F.col("m") == m, F.col(c)))
    return found.groupBy(*by).agg(*[at(m, c).alias(m if c == "point" else f"{m}_{c}") for m in measures for c in ("point", "lo", "hi")])


def condition_intervals(frame: DataFrame, conditions: list[str], reference: str) -> DataFrame:
    """verdicts.condition_table with intervals, in percent, of every pass rate and contrast."""
    w = verdicts.wide(frame, conditions).join(frame.groupBy("task_id").agg(F.min_by("api_name", "ord").alias("api_name"), F.min("ord").alias("ord")), "task_id")
    arms = F.array(*[F.struct(F.lit(c).alias("condition"), F.col(f"`{c}`").alias("p"), F.when(F.lit(c != reference), F.col(f"`{c}`") - F.col(f"`{reference}`")).alias("d")) for c in conditions])
    long = w.select("api_name", "ord", F.explode(arms).alias("x")).select("api_name", "ord", "x.*")
    found = intervals(long, ["condition"], {"pass1": F.col("p"), "delta_pct": F.col("d")})
    return verdicts.condition_table(frame, conditions, reference).join(found, "condition")


def cross_backbone(frame: DataFrame, models: list[str], conditions: list[str], reference: str) -> DataFrame:
    """condition_intervals of each model on the tasks that all of them have."""
    seen = frame.filter(F.col("model").isin(models)).groupBy("task_id").agg(F.count_distinct("model").alias("n"))
    shared = frame.join(seen.filter(F.col("n") == len(models)).select("task_id"), "task_id", "left_semi")
    parts = [condition_intervals(shared.filter(F.col("model") == m), conditions, reference).select(F.lit(i).alias("model_ord"), F.lit(m).alias("model"), "*") for i, m in enumerate(models)]
    return reduce(DataFrame.unionByName, parts)


def failure_intervals(frame: DataFrame, conditions: list[str], labels: list[str]) -> DataFrame:
    """Share of each label in each condition, in percent, with its interval; zeros included."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("label_ord"), F.lit(x).alias("row_label"), (F.col("label") == x).cast("double").alias("v")) for i, x in enumerate(labels)]))
    long = frame.filter(F.col("condition").isin(conditions)).select("condition", "api_name", "ord", each.alias("x")).select("condition", "api_name", "ord", "x.*")
    return intervals(long, ["condition", "label_ord", "row_label"], {"share": F.col("v")}).withColumnRenamed("row_label", "label")


def novelty_intervals(frame: DataFrame, conditions: list[str]) -> DataFrame:
    """Pass rate on new and on modified APIs, in percent, with its interval; frame has is_modified."""
    f = frame.filter(F.col("condition").isin(conditions)).withColumn("novelty", F.when(F.col("is_modified"), "modified").otherwise("new"))
    return intervals(f, ["novelty", "condition"], {"pass1": F.col("passed")})


def arm_intervals(pairs: DataFrame, by: str = "condition") -> DataFrame:
    """Two arms of the same tasks (passed_a, passed_b, api_name, ord) by group: both rates, their
    difference b - a, all in percent with intervals; discordant counts, exact p, Holm over the groups."""
    found = intervals(pairs, [by], {"a": F.col("passed_a"), "b": F.col("passed_b"), "change": F.col("passed_b") - F.col("passed_a")})
    counts = verdicts.paired_summary(pairs, by).select(by, "n", "n01", "n10", "p")
    return verdicts.holm(counts.join(found, by), "p", by)


def interaction_holm(tests: DataFrame, by: str) -> DataFrame:
    """interaction()'s rows with p corrected over all groups."""
    return verdicts.holm(tests, "p", by)


def bypass_table(scored: DataFrame, base: tuple[str, str]) -> DataFrame:
    """Bypass modes by cell (method, condition), over the tasks that every cell has. scored: method,
    condition, task_id, api_name, passed, label, call_check_failed, code (extracted), ord. Share of
    bypasses in percent with its interval, and, against the cell ``base``, the paired difference with
    interval and exact p (null for the base itself)."""
    cells = scored.select("method", "condition").distinct().count()
    full = scored.groupBy("task_id").agg(F.count_distinct("method", "condition").alias("n")).filter(F.col("n") == cells).select("task_id")
    mode = F.when(is_bypass_candidate(F.col("passed"), F.col("label"), F.col("call_check_failed")), bypass_mode(F.col("code"), F.col("api_name")))
    rows = scored.join(full, "task_id", "left_semi").withColumn("mode", mode)
    rows = rows.withColumn("bypass", F.coalesce(F.col("mode").isin("reimplemented", "same_name_reimpl"), F.lit(False)).cast("double"))
    is_base = (F.col("method") == base[0]) & (F.col("condition") == base[1])
    reference = rows.filter(is_base).select("task_id", F.col("bypass").alias("ref"))
    rows = rows.join(reference, "task_id", "left").withColumn("ref", F.when(~is_base, F.col("ref")))
    key = ["method", "condition"]
    counts = rows.groupBy(*key).agg(
        F.count("*").alias("n_tasks"),
        F.count("mode").alias("n_selection_failures"),
        *[F.count_if(F.col("mode") == m).alias(m) for m in ("reimplemented", "same_name_reimpl", "referenced_not_invoked", "empty")],
        F.count_if((F.col("bypass") < 0.5) & (F.col("ref") > 0.5)).alias("n01"),
        F.count_if((F.col("bypass") > 0.5) & (F.col("ref") < 0.5)).alias("n10"),
        F.count("ref").alias("__n"),
    )
    found = intervals(rows, key, {"bypass_pct": F.col("bypass"), "bypass_vs_base": F.col("bypass") - F.col("ref")})
    return counts.join(found, key).withColumn("p", F.when(F.col("__n") > 0, verdicts.mcnemar_p(F.col("n01"), F.col("n10")))).drop("__n")
