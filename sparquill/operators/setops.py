"""Gates, instances, splits, first and last wins, overlays, resume."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def instance(c1: DataFrame, c2: DataFrame, c3: DataFrame, excluded: DataFrame, key: str = "task_id") -> DataFrame:
    """Rows of gate 1 that the other gates hold too, less exclusions; order columns are kept."""
    return c1.join(c2.select(key).distinct(), key, "left_semi").join(c3.select(key).distinct(), key, "left_semi").join(excluded.select(key).distinct(), key, "left_anti")


def in_all(rows: DataFrame, member: str, family: str, n: int) -> DataFrame:
    """Members that every one of the n families holds."""
    return rows.groupBy(member).agg(F.countDistinct(family).alias("k")).filter(F.col("k") == n).select(member)


def in_any(rows: DataFrame, member: str) -> DataFrame:
    """Members of any family."""
    return rows.select(member).distinct()


def first_n(df: DataFrame, by: str | list[str], order: list, n: int) -> DataFrame:
    """First n rows of each group (planned with a group limit before the shuffle)."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rn") <= n)


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """First row of each key."""
    return first_n(df, key, order, 1).drop("rn")


def last_wins(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Last values of each key at the place (``order``) of its first occurrence."""
    last = F.max_by(F.struct(*values), order).alias("v")
    return df.groupBy(key).agg(F.min(order).alias(order), last).select(key, order, "v.*")


def resume(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What is still to do."""
    return wanted.join(done.select(*key), key, "left_anti")


def overlay(layers: list[DataFrame], key: str) -> DataFrame:
    """Union of maps; a later layer wins."""
    tagged = [df.withColumn("layer", F.lit(i)) for i, df in enumerate(layers)]
    out = tagged[0]
    for more in tagged[1:]:
        out = out.unionByName(more)
    return first_n(out, key, [F.desc("layer")], 1).drop("rn", "layer")


def set_difference_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows either set has alone; equal sets give 0 and 0."""
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_a")).crossJoin(b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_b")))


def group_split(keys: DataFrame, by: str, order: Column, share: float) -> DataFrame:
    """First floor(share * n) keys of each group, in shuffled order, train; the rest test."""
    w = Window.partitionBy(by)
    cut = F.floor(F.lit(share) * F.count(F.lit(1)).over(w))
    return keys.withColumn("split", F.when(F.row_number().over(w.orderBy(order)) <= cut, "train").otherwise("test"))


def monotone(sizes: DataFrame, order: str, size: str) -> DataFrame:
    """Whether sizes never grow along the order (a table of a few dozen rows)."""
    return sizes.select((F.col(size) <= F.lag(size).over(Window.orderBy(order))).alias("ok")).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("monotone"))


def derive_exclusions(records: DataFrame, reasons: dict[str, str], rechecks: DataFrame, n: int) -> DataFrame:
    """(task_id, reason): records whose status isn't ok, by reason; and rechecked tasks that failed
    for another cause than errors of the model, where the record is ok."""
    mapping = F.create_map(*[F.lit(x) for kv in reasons.items() for x in kv])
    bad = records.filter("status <> 'ok'").select("task_id", F.coalesce(F.try_element_at(mapping, F.col("status")), F.lit("other")).alias("reason"))
    ok = records.filter("status = 'ok'").select("task_id")
    late = rechecks.filter((~F.col("passed")) & (F.col("n_llm_errors") < n)).join(ok, "task_id", "left_semi").select("task_id", F.lit("c3").alias("reason"))
    return bad.unionByName(late)


def membership(rows: DataFrame, key: str, family: str, families: list[str], kind: str) -> DataFrame:
    """Long to wide: one column a family, empty where absent."""
    return rows.groupBy(key).pivot(family, families).agg(F.min(kind)).na.fill("", subset=[f"`{f}`" for f in families])


def asof(left: DataFrame, right: DataFrame, key: str, cut: str, at: str, version: str, rank: Column) -> DataFrame:
    """For each left row, the greatest version (by rank, not by date) dated before its cut; null if none."""
    best = left.join(right, key).filter(F.col(at) < F.col(cut)).groupBy(key, cut).agg(F.max_by(version, rank).alias(version))
    return left.join(best, [key, cut], "left")


def prefix_anti(df: DataFrame, failed: DataFrame, name: str = "name", prefix: str = "failed") -> DataFrame:
    """Rows whose dotted name is not, and does not lie under, a failed name: exploded prefixes make
    the theta join an equi join."""
    from ..functions.text import dotted_prefixes

    hit = df.select(name, F.explode(dotted_prefixes(F.col(name))).alias(prefix)).join(failed.select(prefix).distinct(), prefix, "left_semi").select(name).distinct()
    return df.join(hit, name, "left_anti")


def neighbours(lines: DataFrame, hits: DataFrame, doc: str, pos: str, reach: int = 3) -> DataFrame:
    """Rows within ``reach`` places of each hit (repeated where contexts overlap): the range join as
    an equi join on exploded places."""
    around = hits.select(doc, F.col(pos).alias("hit"), F.explode(F.sequence(F.col(pos) - reach, F.col(pos) + reach)).alias(pos))
    return around.join(lines, [doc, pos])


def keyed_in_order(wanted: DataFrame, rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The row of each wanted key, in the wanted order (column ``order``); a key without a row raises."""
    found = wanted.join(rows.withColumn("__found", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string"))).cast("boolean")
    return found.filter(F.coalesce("__found", missing)).drop("__found").orderBy(order)


def scored_in_order(predictions: DataFrame, results: DataFrame, key: str, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Results in the order of the predictions, the last of each key; and how many predictions have none."""
    last = results.groupBy(key).agg(F.max_by(F.struct(*[c for c in results.columns if c != key]), order).alias("v"))
    both = predictions.select(key, F.col(order).alias("__at")).join(last, key, "left")
    kept = both.filter("v is not null").select(key, "v.*", "__at").withColumn(order, F.col("__at")).drop("__at")
    return kept.orderBy(order), both.agg(F.count_if(F.col("v").isNull()).alias("unscored"))


def concat_in_order(frames: dict[str, DataFrame], column: str = "model") -> DataFrame:
    """Named frames one after another: name and place in ``column`` and ``<column>_ord``."""
    tagged = [df.select(F.lit(i).alias(f"{column}_ord"), F.lit(name).alias(column), "*") for i, (name, df) in enumerate(frames.items())]
    return reduce(DataFrame.unionByName, tagged)


def restrict(exclusions: DataFrame, instances: list[DataFrame], key: str = "task_id") -> DataFrame:
    """Exclusions of tasks that some instance holds."""
    every = reduce(DataFrame.unionByName, [df.select(key) for df in instances])
    return exclusions.join(every.distinct(), key, "left_semi")


def strict_wide(rows: DataFrame, key: str, column: str, values: list[str], value: str) -> DataFrame:
    """Long to wide, where a repeated (key, column) raises."""
    cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("repeated key")).cast(dict(rows.dtypes)[value])).otherwise(F.first(value))
    return rows.groupBy(key, column).agg(cell.alias("__v")).groupBy(key).pivot(column, values).agg(F.first("__v"))


def stride(df: DataFrame, order: list[str], index: int, n: int) -> DataFrame:
    """Every nth row in an order, from ``index`` on. Rows are ranked within ranges of the first order
    column's quantiles, whose counts give each range its start, so no task sorts all."""
    first = order[0]
    cuts = sorted(set(df.approxQuantile(first, [k / 64 for k in range(1, 64)], 0.001)))
    part = reduce(lambda a, c: a + (F.col(first) > F.lit(c)).cast("int"), cuts, F.lit(0))
    rows = df.withColumn("__part", part)
    starts, seen = {}, 0
    for p, m in sorted(tuple(r) for r in rows.groupBy("__part").count().collect()):  # at most 64
        starts[p] = seen
        seen += m
    start = F.coalesce(*[F.when(F.col("__part") == p, F.lit(at)) for p, at in starts.items()], F.lit(0))
    rank = start + F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return rows.withColumn("__rank", rank).filter(F.col("__rank") % n == index).drop("__part", "__rank")


def distractors(df: DataFrame, group: str, key: str, n: int, seed: int = 7, block: int = 1000) -> DataFrame:
    """(task, other): for each row n others of its group, those next in a seeded order, going round. Large
    groups are parted into ranges of that order, whose counts give each range its start, so no pairs but the
    chosen ones arise and no task holds a group."""
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    sizes = df.groupBy(group).agg(F.count("*").alias("__c"), F.greatest(F.lit(1), F.floor(F.count("*") / block)).alias("__blocks"))
    place = F.conv(F.substring("__h", 1, 8), 16, 10).cast("bigint")
    rows = df.select(group, key, mixed.alias("__h")).join(sizes, group)
    rows = rows.withColumn("__b", F.coalesce(F.shiftright(place * F.col("__blocks"), 32), F.col("__blocks")))  # a null key comes last
    before = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(group, "__b").agg(F.count("*").alias("__n")).select(group, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(group, "__b").orderBy("__h", key)) - 1)
    ranked = ranked.join(starts, [group, "__b"]).select(group, key, "__c", (F.col("__start") + F.col("__r")).alias("__r"))
    steps = F.sequence(F.lit(1), F.least(F.lit(n).cast("bigint"), F.col("__c") - 1))
    asked = ranked.filter("__c > 1").select(group, F.col(key).alias("task"), F.explode(F.transform(steps, lambda i: (F.col("__r") + i) % F.col("__c"))).alias("__r"))
    return asked.join(ranked.select(group, "__r", F.col(key).alias("other")), [group, "__r"]).select("task", "other")


def keep_chance(key: Column, share: float, seed: int = 7) -> Column:
    """A seeded coin for each key: true with probability ``share``."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("bigint") < F.lit(int(share * (1 << 32)))
