"""Queries over gates, splits, windows, as-of joins, caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import setops as S
from ..sources import files
from .base import table
from .registry import register


def _gates(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "task_id")
    c1 = orders.filter(F.col("o_orderstatus").isin("F", "O"))
    c2 = orders.filter("o_orderpriority <> '5-LOW'").select("task_id")
    c3 = orders.filter("o_totalprice > 50000").select("task_id")
    return c1, c2, c3, orders.filter("task_id % 17 = 0").select("task_id")


GATES = "o_orderstatus IN ('F','O') AND o_orderpriority <> '5-LOW' AND o_totalprice > 50000"


@register("instance_gates", f"SELECT o_orderkey AS task_id, o_custkey FROM orders WHERE {GATES}")
def instance_gates(spark, sf):
    c1, c2, c3, none = _gates(spark, sf)
    return S.instance(c1, c2, c3, none.limit(0)).select("task_id", "o_custkey")


@register("instance_minus_excluded", f"SELECT o_orderkey AS task_id, o_custkey FROM orders WHERE {GATES} AND o_orderkey % 17 <> 0")
def instance_minus_excluded(spark, sf):
    return S.instance(*_gates(spark, sf)).select("task_id", "o_custkey")


@register("union_any_model", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def union_any_model(spark, sf):
    return S.in_any(table(spark, sf, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), "o_custkey")


@register("exclusion_reasons", """
SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'P' THEN 'unstable' ELSE 'other' END AS reason FROM orders WHERE o_orderstatus <> 'O'
UNION ALL SELECT o_orderkey, 'c3' FROM orders WHERE o_orderstatus = 'O' AND o_totalprice <= 20000 AND o_orderkey % 4 < 3
""")
def exclusion_reasons(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "task_id")
    records = o.select("task_id", F.when(F.col("o_orderstatus") == "O", "ok").otherwise(F.col("o_orderstatus")).alias("status"))
    recheck = o.select("task_id", (F.col("o_totalprice") > 20000).alias("passed"), (F.col("task_id") % 4).alias("n_llm_errors"))
    return S.derive_exclusions(records, {"P": "unstable"}, recheck, 3)


@register("overlay_priority", "SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 5 = 0 THEN 'manual' WHEN o_orderkey % 3 = 0 THEN 'derived' ELSE 'released' END AS reason FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def overlay_priority(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"))
    layer = lambda n, reason: ids.filter(F.col("task_id") % n == 0).withColumn("reason", F.lit(reason))
    return S.overlay([layer(2, "released"), layer(3, "derived"), layer(5, "manual")], "task_id")


@register("set_equality_check", "SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus='F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus='O'))::BIGINT AS only_a, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus='O' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus='F'))::BIGINT AS only_b")
def set_equality_check(spark, sf):
    o = table(spark, sf, "orders")
    return S.set_difference_counts(o.filter("o_orderstatus='F'").select("o_custkey"), o.filter("o_orderstatus='O'").select("o_custkey"))


@register("key_set_operations", "SELECT 'both' AS side, count(*)::BIGINT AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'alone', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def key_set_operations(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select("o_custkey")
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return count(c.intersect(o), "both").unionByName(count(c.subtract(o), "alone"))


@register("first_n_per_group", "SELECT user_id, event_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS rn FROM events) WHERE rn <= 3")
def first_n_per_group(spark, sf):
    return S.first_n(table(spark, sf, "events"), "user_id", ["ts", "event_id"], 3).select("user_id", "event_id", "rn")


@register("first_wins", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def first_wins(spark, sf):
    return S.first_wins(table(spark, sf, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@register("last_wins", "SELECT user_id, min(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1")
def last_wins(spark, sf):
    return S.last_wins(table(spark, sf, "events"), "user_id", "event_id", ["event_type", "value"]).withColumn("value", F.round("value", 6))


@register("keyed_join_in_order", "SELECT e.event_id, e.user_id, c.c_name FROM events e JOIN customer c ON c.c_custkey = e.user_id")
def keyed_join_in_order(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    wanted = table(spark, sf, "events").join(c.select("user_id"), "user_id", "left_semi").withColumn("ord", F.col("event_id"))
    return S.keyed_in_order(wanted, c, "user_id").select("event_id", "user_id", "c_name")


@register("scored_in_order", "SELECT event_id, user_id, round(value, 6) AS value FROM (SELECT min(event_id) AS event_id, user_id, arg_max(value, event_id) AS value FROM events GROUP BY 2)")
def scored_in_order(spark, sf):
    e = table(spark, sf, "events").withColumn("ord", F.col("event_id"))
    first = e.groupBy("user_id").agg(F.min("ord").alias("ord"))
    return S.scored_in_order(first, e.select("user_id", "value", "ord"), "user_id")[0].select(F.col("ord").alias("event_id"), "user_id", F.round("value", 6).alias("value"))


@register("restrict_exclusions", "SELECT o_orderkey AS task_id FROM orders WHERE o_orderkey % 17 = 0 AND (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT')")
def restrict_exclusions(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "task_id")
    return S.restrict(o.filter("task_id % 17 = 0").select("task_id"), [o.filter("o_orderstatus = 'F'"), o.filter("o_orderpriority = '1-URGENT'")])


@register("lookup_with_default", "SELECT c_custkey, coalesce(max(o_orderpriority), '') AS best FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def lookup_with_default(spark, sf):
    best = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("best"))
    return table(spark, sf, "customer").select("c_custkey").join(best, "c_custkey", "left").na.fill("", ["best"])


@register("resume_todo", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def resume_todo(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return S.resume(table(spark, sf, "customer").select("c_custkey"), done, ["c_custkey"])


@register("semi_by_library", "SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_discount > 0.09 AND l_quantity > 49)")
def semi_by_library(spark, sf):
    p = table(spark, sf, "part")
    hot = table(spark, sf, "lineitem").filter("l_discount > 0.09 and l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return p.join(p.join(hot, "p_partkey", "left_semi").select("p_brand").distinct(), "p_brand", "left_semi").select("p_partkey")


@register("split_by_group", "SELECT p_brand, p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey::VARCHAR)) <= floor(0.8 * count(*) OVER (PARTITION BY p_brand)) THEN 'train' ELSE 'test' END AS split FROM part")
def split_by_group(spark, sf):
    keys = table(spark, sf, "part").select("p_brand", "p_partkey")
    return S.group_split(keys, "p_brand", F.md5(F.col("p_partkey").cast("string")), 0.8)


@register("stride_shard", "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS r FROM part) WHERE r % 4 = 1")
def stride_shard(spark, sf):
    p = table(spark, sf, "part").withColumn("price", F.col("p_retailprice").cast("double"))
    return S.stride(p, ["price", "p_partkey"], 1, 4).select("p_partkey")


@register("asof_last_before", """
SELECT c.c_custkey, (SELECT max(o_orderdate) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate < TIMESTAMP '1998-06-01') AS last_date FROM customer c
""")
def asof_last_before(spark, sf):
    left = table(spark, sf, "customer").select("c_custkey").withColumn("cut", F.lit("1998-06-01").cast("timestamp_ntz"))
    right = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("at"), F.col("o_orderdate").alias("last_date"))
    return S.asof(left, right, "c_custkey", "cut", "at", "last_date", F.col("last_date")).select("c_custkey", "last_date")


@register("version_argmax", """
SELECT p_brand, arg_max(version, [major, minor]) AS version FROM (SELECT p_brand, p_size // 10 AS major, p_size % 10 * 3 AS minor, (p_size // 10) || '.' || (p_size % 10 * 3) AS version, p_retailprice FROM part) GROUP BY 1
""")
def version_argmax(spark, sf):
    p = table(spark, sf, "part")
    p = p.withColumn("version", F.concat(F.floor(F.col("p_size") / 10), F.lit("."), F.col("p_size") % 10 * 3))
    return p.groupBy("p_brand").agg(F.max_by("version", X.version_key(F.col("version"))).alias("version"))


@register("membership_pivot", "SELECT user_id, coalesce(max('yes') FILTER (event_type='click'), '') AS click, coalesce(max('yes') FILTER (event_type='purchase'), '') AS purchase, coalesce(max('yes') FILTER (event_type='refund'), '') AS refund FROM events GROUP BY 1")
def membership_pivot(spark, sf):
    e = table(spark, sf, "events").withColumn("kind", F.lit("yes"))
    return S.membership(e, "user_id", "event_type", ["click", "purchase", "refund"], "kind")


@register("monotone_sizes", "SELECT bool_and(ok) AS monotone FROM (SELECT coalesce(n <= lag(n) OVER (ORDER BY y), true) AS ok FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1))")
def monotone_sizes(spark, sf):
    return S.monotone(table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n")), "y", "n")


@register("context_lines", """
SELECT a.conv_id, a.turn AS hit, b.turn, length(b.text)::INT AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 3 AND a.turn + 3 WHERE a.role = 'user' AND a.text LIKE '%the%'
""")
def context_lines(spark, sf):
    c = table(spark, sf, "conversations")
    hits = c.filter("role = 'user' and text like '%the%'").select("conv_id", "turn")
    return S.neighbours(c, hits, "conv_id", "turn").select("conv_id", "hit", "turn", F.length("text").alias("n"))


@register("prefix_anti_join", """
WITH u AS (SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) AS host, url FROM pages),
n AS (SELECT page_id, array_to_string(list_reverse(string_split(host, '.')), '.') AS name FROM u)
SELECT page_id FROM n WHERE NOT (name = 'com.example' OR name LIKE 'com.example.%')
""")
def prefix_anti_join(spark, sf):
    host = F.element_at(F.split(F.element_at(F.split("url", "//"), 2), "/"), 1)
    n = table(spark, sf, "pages").select("page_id", F.array_join(F.reverse(F.split(host, r"\.")), ".").alias("name"))
    failed = spark.createDataFrame([("com.example",)], "failed string")
    return S.prefix_anti(n, failed).select("page_id")


CACHE = "(SELECT props AS key, event_type AS model, user_id::VARCHAR AS response, event_id AS created_at FROM events)"


def _fresh(spark, sf):
    return table(spark, sf, "events").select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("event_type").alias("model"), F.when(F.col("event_type") != "view", F.col("user_id").cast("string")).otherwise("").alias("response"), F.col("event_id").alias("created_at"))


FRESH = "(SELECT user_id || ':' || event_type AS key, event_type AS model, CASE WHEN event_type <> 'view' THEN user_id::VARCHAR ELSE '' END AS response, event_id AS created_at FROM events)"


@register("cache_insert_ignore", f"SELECT key, model, response, min(created_at) AS created_at FROM {FRESH} WHERE response <> '' AND key NOT IN (SELECT key FROM {FRESH} WHERE created_at < 100) GROUP BY ALL")
def cache_insert_ignore(spark, sf):
    fresh = _fresh(spark, sf)
    return files.put_cache(fresh.filter("created_at < 100"), fresh).select("key", "model", "response", "created_at")


@register("cache_stats", f"""
SELECT model, count(*)::BIGINT AS entries, coalesce(sum(h), 0)::BIGINT AS hits FROM (SELECT DISTINCT key, model FROM {FRESH} WHERE response <> '')
LEFT JOIN (SELECT user_id || ':' || event_type AS key, count(*) AS h FROM events WHERE value > 50 GROUP BY 1) USING (key) GROUP BY 1
""")
def cache_stats(spark, sf):
    fresh = _fresh(spark, sf)
    log = table(spark, sf, "events").filter("value > 50").select(F.concat_ws(":", "user_id", "event_type").alias("key"))
    return files.cache_report(files.put_cache(fresh.limit(0), fresh), log)


@register("order_by_dimension", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 99 END::INT AS ord FROM orders")
def order_by_dimension(spark, sf):
    dim = spark.createDataFrame([("1-URGENT", 0), ("2-HIGH", 1), ("3-MEDIUM", 2)], "o_orderpriority string, ord int")
    o = table(spark, sf, "orders")
    return o.join(F.broadcast(dim), "o_orderpriority", "left").select("o_orderkey", F.coalesce("ord", F.lit(99)).alias("ord")).orderBy("ord", "o_orderkey")


@register("collect_in_order", "SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY 1")
def collect_in_order(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id")))
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["event_id"].cast("string")), ",").alias("ids"))
