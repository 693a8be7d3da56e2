"""Queries over verdict frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import diff, setops, stats
from ..operators import verdicts as V
from .base import CONDITIONS, LABELS, SIX, table, verdicts, verdicts_sql
from .registry import register

R = lambda c: F.round(c, 6)
WIDE_SQL = f"SELECT task_id, max(api_name) AS api_name, avg(passed) FILTER (condition='A') AS a, avg(passed) FILTER (condition='N') AS n, avg(passed) FILTER (condition='R') AS r FROM {verdicts_sql()} GROUP BY task_id HAVING count(DISTINCT condition) = 3"
P_SQL = "CASE WHEN n01 = n10 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range((least(n01, n10) + 1)::BIGINT), lambda i: exp(lgamma(n01 + n10 + 1) - lgamma(i + 1) - lgamma(n01 + n10 - i + 1) - (n01 + n10) * ln(2))))) END"


@register("condition_table", f"""
WITH w AS ({WIDE_SQL}),
s AS (SELECT 'A' AS condition, 0 AS ord, avg(a) AS m, count(*) AS n, count(DISTINCT api_name) AS c, 0 AS n01, 0 AS n10, avg(a) AS base FROM w
  UNION ALL SELECT 'N', 1, avg(n), count(*), count(DISTINCT api_name), sum((n < .5 AND a > .5)::INT), sum((n > .5 AND a < .5)::INT), avg(a) FROM w
  UNION ALL SELECT 'R', 2, avg(r), count(*), count(DISTINCT api_name), sum((r < .5 AND a > .5)::INT), sum((r > .5 AND a < .5)::INT), avg(a) FROM w),
t AS (SELECT *, CASE WHEN ord > 0 THEN {P_SQL} END AS p FROM s),
h AS (SELECT ord, least(1.0, max((2 - rn + 1) * p) OVER (ORDER BY rn)) AS adj FROM (SELECT ord, p, row_number() OVER (ORDER BY p, ord) AS rn FROM t WHERE p IS NOT NULL))
SELECT condition, round(m, 6) AS pass_at_1, n::BIGINT AS n_tasks, c::BIGINT AS n_clusters, round(m - base, 6) AS delta, n01::BIGINT AS n01, n10::BIGINT AS n10,
  round(p, 6) AS p, round(adj, 6) AS p_holm, coalesce(adj <= 0.05, false) AS significant FROM t LEFT JOIN h USING (ord)
""")
def condition_table(spark, sf):
    out = V.condition_table(verdicts(spark, sf), CONDITIONS, "A")
    return out.select("condition", R("pass_at_1").alias("pass_at_1"), "n_tasks", "n_clusters", R("delta").alias("delta"), "n01", "n10", R("p").alias("p"), R("p_holm").alias("p_holm"), F.coalesce("significant", F.lit(False)).alias("significant"))


@register("wide_pivot", f"SELECT task_id, a AS \"A\", n AS \"N\", r AS \"R\" FROM ({WIDE_SQL})")
def wide_pivot(spark, sf):
    return V.wide(verdicts(spark, sf), CONDITIONS)


@register("wide_pivot_missing", f"SELECT task_id, {', '.join(f'avg(passed) FILTER (condition = {c!r}) AS c{c}' for c in SIX)} FROM {verdicts_sql('l_linenumber')} WHERE condition <= '6' GROUP BY task_id HAVING count(DISTINCT condition) = 6")
def wide_pivot_missing(spark, sf):
    w = V.wide(verdicts(spark, sf, "l_linenumber"), SIX)
    return w.select("task_id", *[F.col(f"`{c}`").alias(f"c{c}") for c in SIX])


@register("wide_keep_missing", f"SELECT task_id, {', '.join(f'avg(passed) FILTER (condition = {c!r}) AS c{c}' for c in SIX)} FROM {verdicts_sql('l_linenumber')} GROUP BY task_id")
def wide_keep_missing(spark, sf):
    w = V.wide(verdicts(spark, sf, "l_linenumber"), SIX, complete=False)
    return w.select("task_id", *[F.col(f"`{c}`").alias(f"c{c}") for c in SIX])


COMPOSITION = f"SELECT condition, i::INT AS label_ord, l AS label, round(avg((label = l)::INT), 6) AS share FROM {verdicts_sql()} , (SELECT unnest({LABELS!r}) AS l, unnest(range(5)) AS i) GROUP BY ALL"


@register("failure_composition", COMPOSITION)
def failure_composition(spark, sf):
    return V.composition(verdicts(spark, sf), CONDITIONS, LABELS).withColumn("share", R("share"))


@register("composition_offsets", f"SELECT condition, label, share, round(coalesce(sum(share) OVER (PARTITION BY condition ORDER BY label_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS offset_before FROM ({COMPOSITION})")
def composition_offsets(spark, sf):
    out = V.offsets(V.composition(verdicts(spark, sf), CONDITIONS, LABELS).withColumn("share", R("share")))
    return out.select("condition", "label", "share", R("offset").alias("offset_before"))


@register("cell_summary", f"SELECT library, condition, count(*)::BIGINT AS n, round(avg(passed), 6) AS pass_rate, round(avg(CASE WHEN size % 2 = 0 THEN size / 50.0 END), 6) AS pass_at_5 FROM {verdicts_sql()} GROUP BY 1, 2")
def cell_summary(spark, sf):
    v = verdicts(spark, sf).withColumn("pass_at_5", F.when(F.col("size") % 2 == 0, F.col("size") / 50.0))
    return V.cell_summary(v, ["library", "condition"]).select("library", "condition", "n", R("pass_rate").alias("pass_rate"), R("pass_at_5").alias("pass_at_5"))


@register("label_histogram_map", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS labels FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def label_histogram_map(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").count()
    pairs = F.array_sort(F.collect_list(F.struct("event_type", "count")))
    hist = counts.groupBy("user_id").agg(F.map_from_entries(pairs).alias("m"))
    entries = F.transform(F.array_sort(F.map_entries("m")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return hist.select("user_id", F.array_join(entries, ",").alias("labels"))


@register("novelty_grid", f"""
SELECT d.novelty, d.condition, round(avg(passed), 6) AS mean, count(passed)::BIGINT AS n, count(DISTINCT api_name)::BIGINT AS n_clusters
FROM (SELECT * FROM (VALUES ('new'), ('modified'), ('absent')) a(novelty), (VALUES ('A'), ('N'), ('R')) b(condition)) d
LEFT JOIN (SELECT *, CASE WHEN size % 3 = 0 THEN 'modified' ELSE 'new' END AS novelty FROM {verdicts_sql()}) v ON v.novelty = d.novelty AND v.condition = d.condition GROUP BY 1, 2
""")
def novelty_grid(spark, sf):
    v = verdicts(spark, sf).withColumn("novelty", F.when(F.col("size") % 3 == 0, "modified").otherwise("new"))
    return V.grid(v, ["new", "modified", "absent"], CONDITIONS).withColumn("mean", R("mean"))


ARMS = "(SELECT l_partkey AS task_id, l_returnflag AS condition, max((l_discount >= 0.09)::INT) FILTER (l_linestatus='F') AS a, max((l_discount >= 0.09)::INT) FILTER (l_linestatus='O') AS b FROM lineitem GROUP BY 1, 2 HAVING a IS NOT NULL AND b IS NOT NULL)"


def _arm(spark, sf, status):
    line = table(spark, sf, "lineitem").filter(F.col("l_linestatus") == status)
    return line.groupBy(F.col("l_partkey").alias("task_id"), F.col("l_returnflag").alias("condition")).agg(F.max((F.col("l_discount") >= 0.09).cast("int")).alias("passed"))


@register("paired_arms", f"""
SELECT condition, n, mean_a, mean_b, n01, n10, delta, round({P_SQL}, 6) AS p FROM (SELECT condition, count(*)::BIGINT AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b,
  sum((a = 0 AND b = 1)::INT)::BIGINT AS n01, sum((a = 1 AND b = 0)::INT)::BIGINT AS n10, round(avg(a) - avg(b), 6) AS delta FROM {ARMS} GROUP BY 1)
""")
def paired_arms(spark, sf):
    out = V.paired_summary(V.paired(_arm(spark, sf, "F"), _arm(spark, sf, "O"), ["condition", "task_id"]))
    return out.select("condition", "n", R("mean_a").alias("mean_a"), R("mean_b").alias("mean_b"), "n01", "n10", R("delta").alias("delta"), R("p").alias("p"))


@register("mcnemar", f"SELECT n01::BIGINT AS n01, n10::BIGINT AS n10, round({P_SQL}, 9) AS p FROM (VALUES (0, 0), (5, 5), (1, 9), (9, 1), (400, 470), (0, 7)) v(n01, n10)")
def mcnemar(spark, sf):
    df = spark.createDataFrame([(0, 0), (5, 5), (1, 9), (9, 1), (400, 470), (0, 7)], "n01 long, n10 long")
    return df.select("n01", "n10", F.round(V.mcnemar_p(F.col("n01"), F.col("n10")), 9).alias("p"))


@register("holm_adjust", """
SELECT g, round(p, 9) AS p, round(least(1.0, max((m - rn + 1) * p) OVER (ORDER BY rn)), 9) AS p_holm, least(1.0, max((m - rn + 1) * p) OVER (ORDER BY rn)) <= 0.05 AS significant
FROM (SELECT g, p, row_number() OVER (ORDER BY p, g) AS rn, count(*) OVER () AS m FROM (SELECT p_brand AS g, (min(p_retailprice * 7919) % 1000) / 20000 AS p FROM part GROUP BY 1))
""")
def holm_adjust(spark, sf):
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("g")).agg((F.min(F.col("p_retailprice") * 7919) % 1000 / 20000).alias("p"))
    out = V.holm(p, "p", "g")
    return out.select("g", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"), "significant")


@register("pass_at_k", """
SELECT user_id, n, c, CASE WHEN n - c < 5 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE round(1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - 5.0 / i)), 6) END AS pass_at_5
FROM (SELECT user_id, count(*)::INT AS n, count(*) FILTER (event_type = 'purchase')::INT AS c FROM events GROUP BY 1) WHERE n >= 5
""")
def pass_at_k(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("event_type") == "purchase").cast("int").alias("c")).filter("n >= 5")
    return e.select("user_id", "n", "c", R(X.pass_at_k(F.col("n"), F.col("c"), 5)).alias("pass_at_5"))


@register("cluster_moments", f"SELECT api_name, sum(passed)::DOUBLE AS s, count(*)::BIGINT AS c FROM {verdicts_sql()} GROUP BY 1")
def cluster_moments(spark, sf):
    return V.cluster_moments(verdicts(spark, sf))


@register("jackknife_means", f"SELECT api_name, round((sum(s) OVER () - s) / (sum(c) OVER () - c), 9) AS mean_without FROM (SELECT api_name, sum(passed)::DOUBLE AS s, count(*) AS c FROM {verdicts_sql()} GROUP BY 1)")
def jackknife_means(spark, sf):
    return V.jackknife(V.cluster_moments(verdicts(spark, sf))).withColumn("mean_without", F.round("mean_without", 9))


FAILED = f"(SELECT v.label, o.passed AS fixed FROM {verdicts_sql()} v JOIN {verdicts_sql()} o ON o.task_id = v.task_id AND o.condition = 'N' WHERE v.condition = 'A' AND v.passed = 0)"


def _failed(spark, sf):
    v = verdicts(spark, sf).filter(F.col("condition").isin("A", "N"))
    a = v.groupBy("task_id").agg(F.max(F.when(F.col("condition") == "A", F.col("label"))).alias("label"), F.max(F.when(F.col("condition") == "A", F.col("passed"))).alias("p"), F.max(F.when(F.col("condition") == "N", F.col("passed"))).alias("fixed"))
    return a.filter("p = 0 and fixed is not null").select("label", "fixed")


@register("fixes_with_total", f"SELECT coalesce(label, 'TOTAL') AS \"row\", count(*)::BIGINT AS n, sum(fixed)::BIGINT AS fixed, round(100.0 * sum(fixed) / count(*), 6) AS percent FROM {FAILED} GROUP BY GROUPING SETS ((label), ())")
def fixes_with_total(spark, sf):
    return V.label_counts_with_total(_failed(spark, sf)).withColumn("percent", R("percent"))


@register("fix_groups", f"SELECT CASE WHEN label IN ('WrongSyntax', 'WrongImport') THEN 'form' ELSE 'use' END AS grp, count(*)::BIGINT AS n, sum(fixed)::BIGINT AS fixed FROM {FAILED} GROUP BY 1")
def fix_groups(spark, sf):
    group = F.when(F.col("label").isin("WrongSyntax", "WrongImport"), "form").otherwise("use")
    return _failed(spark, sf).groupBy(group.alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.sum("fixed").alias("fixed"))


BYPASS = f"SELECT * EXCLUDE (label), CASE WHEN condition = 'A' THEN 'base' ELSE 'sft' END AS method, CASE WHEN passed = 1 THEN 'Pass' WHEN label = 'WrongSyntax' THEN label ELSE 'WrongAPISelection' END AS label FROM {verdicts_sql()} WHERE condition IN ('A', 'N')"


@register("bypass_counts", f"""
SELECT method, count(*)::BIGINT AS n_tasks, count(m)::BIGINT AS n_selection_failures, {", ".join(f"count(*) FILTER (m = '{m}')::BIGINT AS {m}" for m in ("reimplemented", "same_name_reimpl", "referenced_not_invoked", "empty"))}, round(100 * avg((coalesce(m, '') IN ('reimplemented', 'same_name_reimpl'))::INT), 6) AS bypass_pct
FROM (SELECT *, CASE WHEN label = 'WrongAPISelection' AND size % 5 > 0 THEN ['empty', 'same_name_reimpl', 'reimplemented', 'referenced_not_invoked'][size % 4 + 1] END AS m, count(*) OVER (PARTITION BY task_id) AS k FROM ({BYPASS})) WHERE k = 2 GROUP BY 1
""")
def bypass_counts(spark, sf):
    v = verdicts(spark, sf).filter(F.col("condition").isin("A", "N"))
    v = v.withColumn("method", F.when(F.col("condition") == "A", "base").otherwise("sft")).withColumn("condition", F.lit("Full"))
    v = v.withColumn("label", F.when(F.col("passed") == 1, "Pass").when(F.col("label") == "WrongSyntax", F.col("label")).otherwise("WrongAPISelection"))
    v = v.withColumn("call_check_failed", (F.col("size") % 5 == 0).cast("int")).withColumn("api_name", F.concat(F.lit("p."), F.replace("api_name", F.lit("#"), F.lit("_"))))
    leaf = F.substring_index("api_name", ".", -1)
    code = F.element_at(F.array(F.lit(" x=1 "), F.concat(F.lit("def "), leaf, F.lit("():\n  pass")), F.lit("other(1, 2)"), F.concat(leaf, F.lit(" = 1"))), F.col("size") % 4 + 1)
    out = stats.bypass_table(v.withColumn("code", code), ("base", "Full"))
    return out.select("method", "n_tasks", "n_selection_failures", "reimplemented", "same_name_reimpl", "referenced_not_invoked", "empty", R("bypass_pct").alias("bypass_pct"))


@register("shared_hit_tasks", f"SELECT task_id FROM {verdicts_sql()} WHERE passed = 1 GROUP BY 1 HAVING count(DISTINCT condition) = 3")
def shared_hit_tasks(spark, sf):
    return V.shared_by_all(verdicts(spark, sf).withColumnRenamed("passed", "hit5"), CONDITIONS)


@register("condition_intervals")
def condition_intervals(spark, sf):
    return stats.condition_intervals(verdicts(spark, sf), CONDITIONS, "A")


@register("failure_intervals")
def failure_intervals(spark, sf):
    return stats.failure_intervals(verdicts(spark, sf), CONDITIONS, LABELS)


@register("novelty_intervals")
def novelty_intervals(spark, sf):
    v = verdicts(spark, sf)
    entries = v.select("api_name", (F.crc32(F.col("api_name").cast("binary")) % 2 == 0).alias("is_modified")).distinct()
    return stats.novelty_intervals(diff.novelty_of(v, entries), CONDITIONS)


@register("arm_intervals")
def arm_intervals(spark, sf):
    api = table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_brand").alias("api_name"), F.col("p_partkey").alias("ord"))
    return stats.arm_intervals(V.paired(_arm(spark, sf, "F"), _arm(spark, sf, "O"), ["condition", "task_id"]).join(api, "task_id"))


@register("cross_backbone")
def cross_backbone(spark, sf):
    v = verdicts(spark, sf)
    two = v.withColumn("model", F.lit("m0")).unionByName(v.filter("size > 10").withColumn("passed", 1 - F.col("passed")).withColumn("model", F.lit("m1")))
    return stats.cross_backbone(two, ["m0", "m1"], CONDITIONS, "A")


@register("method_headline", f"""
SELECT library, round(avg(n), 6) AS none, round(avg(r), 6) AS "full", round(avg(r) - avg(n), 6) AS delta, count(*)::BIGINT AS tasks FROM (
  SELECT library, task_id, avg(passed) FILTER (condition='N') AS n, avg(passed) FILTER (condition='R') AS r FROM {verdicts_sql()} GROUP BY 1, 2 HAVING n IS NOT NULL AND r IS NOT NULL) GROUP BY 1
""")
def method_headline(spark, sf):
    v = verdicts(spark, sf)
    w = V.wide(v, ["N", "R"]).join(v.select("task_id", "library").distinct(), "task_id")
    return w.groupBy("library").agg(R(F.avg("N")).alias("none"), R(F.avg("R")).alias("full"), R(F.avg("R") - F.avg("N")).alias("delta"), F.count("*").alias("tasks"))


@register("headline_extremes", f"SELECT round(max(d), 6) AS most, round(min(d), 6) AS least FROM (SELECT library, avg(passed) FILTER (condition='R') - avg(passed) FILTER (condition='N') AS d FROM {verdicts_sql()} GROUP BY 1)")
def headline_extremes(spark, sf):
    rate = lambda c: F.avg(F.when(F.col("condition") == c, F.col("passed")))
    d = verdicts(spark, sf).groupBy("library").agg((rate("R") - rate("N")).alias("d"))
    return d.agg(R(F.max("d")).alias("most"), R(F.min("d")).alias("least"))


@register("exact_percentiles", "SELECT p_type, round(quantile_cont(p_retailprice, 0.025), 6) AS lo, round(quantile_cont(p_retailprice, 0.975), 6) AS hi FROM part GROUP BY 1")
def exact_percentiles(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(R(F.percentile("p_retailprice", 0.025)).alias("lo"), R(F.percentile("p_retailprice", 0.975)).alias("hi"))


@register("min_max_scale", "SELECT p_partkey, round(CASE WHEN max(p_size) OVER w = min(p_size) OVER w THEN 1.0 ELSE (p_size - min(p_size) OVER w)::DOUBLE / (max(p_size) OVER w - min(p_size) OVER w) END, 6) AS scaled FROM part WINDOW w AS (PARTITION BY p_name)")
def min_max_scale(spark, sf):
    return V.min_max(table(spark, sf, "part"), "p_name", "p_size").select("p_partkey", R("scaled").alias("scaled"))


@register("distinct_flags", "SELECT c_nationkey, count(DISTINCT c_mktsegment)::BIGINT AS segments, bool_or(c_acctbal < 0) AS any_debt, bool_and(c_acctbal > -900) AS all_sound FROM customer GROUP BY 1")
def distinct_flags(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.countDistinct("c_mktsegment").alias("segments"), F.bool_or(F.col("c_acctbal") < 0).alias("any_debt"), F.bool_and(F.col("c_acctbal") > -900).alias("all_sound"))


@register("strict_label_pivot", f"SELECT label, {', '.join(f'count(*) FILTER (condition = {c!r})::BIGINT AS {c.lower()}_n' for c in CONDITIONS)} FROM {verdicts_sql()} GROUP BY 1")
def strict_label_pivot(spark, sf):
    counts = verdicts(spark, sf).groupBy("label", "condition").agg(F.count(F.lit(1)).alias("n"))
    out = setops.strict_wide(counts, "label", "condition", CONDITIONS, "n")
    return out.select("label", *[F.coalesce(F.col(c), F.lit(0)).alias(f"{c.lower()}_n") for c in CONDITIONS])


@register("bootstrap_ci")
def bootstrap_ci(spark, sf):
    return stats.mean_ci(verdicts(spark, sf), ["condition"])


@register("interaction_test")
def interaction_test(spark, sf):
    v = verdicts(spark, sf)
    w = V.wide(v, ["A", "N"]).join(v.select("task_id", "api_name", "library").distinct(), "task_id")
    return stats.interaction(w.select("library", "api_name", (F.crc32(F.col("api_name").cast("binary")) % 2 == 0).alias("is_modified"), (F.col("A") - F.col("N")).alias("diff")), "library", "is_modified")


@register("shared_tasks_all_models", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 5")
def shared_tasks_all_models(spark, sf):
    from ..operators.setops import in_all

    return in_all(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", 5)


@register("adjacent_gap", "SELECT user_id, event_id, coalesce(date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts), -1)::BIGINT AS gap FROM events")
def adjacent_gap(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    second = lambda t: F.unix_seconds(t.cast("timestamp"))
    return table(spark, sf, "events").select("user_id", "event_id", F.coalesce(second(F.col("ts")) - second(F.lag("ts").over(w)), F.lit(-1)).alias("gap"))
