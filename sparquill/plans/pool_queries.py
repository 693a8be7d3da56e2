"""Queries that build a candidate pool from two catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from ..operators import diff
from ..operators import retrieval as R
from ..operators import setops as S
from .base import table
from .registry import register


def _catalogue(spark, sf, new: bool):
    """A catalogue made of parts: old lacks every seventh, new every eleventh; sizes of every fifth differ."""
    p = table(spark, sf, "part")
    p = p.filter(F.col("p_partkey") % (11 if new else 7) != 0)
    size = F.col("p_size") + F.when(F.lit(new) & (F.col("p_partkey") % 5 == 0), 1).otherwise(0)
    param = lambda name, default: F.struct(F.lit(name).alias("name"), default.alias("default"), F.lit("keyword").alias("kind"))
    params = F.array(param("self", F.lit("")), param("size", size.cast("string")), param("kind", F.col("p_type")))
    module = F.when(F.lit(new) & (F.col("p_partkey") % 13 == 0), "moved").otherwise("pkg")
    name = F.concat(module, F.lit("."), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey"))
    return p.select(F.col("p_partkey").alias("ord"), name.alias("name"), name.alias("identity"), F.lit("class").alias("kind"), params.alias("params"), F.col("p_brand").alias("doc"))


def _sql(new: bool) -> str:
    module = "CASE WHEN p_partkey % 13 = 0 THEN 'moved' ELSE 'pkg' END" if new else "'pkg'"
    size = "p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END" if new else "p_size"
    return f"(SELECT p_partkey AS ord, {module} || '.' || replace(p_name, ' ', '_') || '_' || p_partkey AS name, {size} AS size, p_type FROM part WHERE p_partkey % {11 if new else 7} <> 0)"


@register("api_diff_added", f"SELECT name FROM {_sql(True)} WHERE name NOT IN (SELECT name FROM {_sql(False)})")
def api_diff_added(spark, sf):
    return diff.added(_catalogue(spark, sf, False), _catalogue(spark, sf, True)).select("name")


@register("api_diff_modified", f"SELECT n.name FROM {_sql(True)} n JOIN {_sql(False)} o USING (name) WHERE n.size <> o.size OR n.p_type <> o.p_type")
def api_diff_modified(spark, sf):
    return diff.modified(_catalogue(spark, sf, False), _catalogue(spark, sf, True)).select("name")


def _versions(spark, sf):
    """Two catalogues in which each rule of the comparison meets an eighth of the parts."""
    k = F.col("p_partkey") % 8
    param = lambda n, d=None: F.struct(F.lit(n).alias("name"), F.lit(d).cast("string").alias("default"), F.lit("k").alias("kind"))
    doc = F.concat(F.repeat(F.lit("word "), F.lit(20)), F.col("p_partkey").cast("string"))
    leaf = F.concat(F.lit("f"), F.col("p_partkey"))
    plain = F.array(param("x"), param("y"))
    shape = lambda m, p, ps, d: [F.concat(m, F.lit("."), leaf).alias("name"), F.lit("function").alias("kind"), ps.alias("params"), d.alias("doc"), p.alias("path")]
    p = table(spark, sf, "part").withColumnRenamed("p_partkey", "ord").withColumn("p_partkey", F.col("ord"))
    old = p.filter(k != 7).select("ord", *shape(F.lit("pkg"), F.lit("a/old.py"), plain, doc))
    params = F.when(k.isin(0, 3), plain).when(k.isin(4, 6), F.array(param("z"))).otherwise(F.array(param("x"), param("y", "1")))
    text = F.when(k == 5, F.lit("entirely different text that has more than forty characters")).when(k == 6, F.concat(doc, F.lit("!"))).otherwise(doc)
    new = p.select("ord", *shape(F.when(k < 3, "pkg").otherwise("moved"), F.when(k < 2, "a/old.py").otherwise("a/new.py"), params, text))
    return old, new


@register("relocation_cascade", "SELECT p_partkey AS ord, k <> 7 AS is_modified, ['same', 'drift', '', 'loose', 'shape', 'fuzzy', 'added'][k] AS how FROM (SELECT p_partkey, p_partkey % 8 AS k FROM part) WHERE k NOT IN (0, 3)")
def relocation_cascade(spark, sf):
    out = diff.diff_catalogues(*_versions(spark, sf))
    return out.select(F.substring_index("name", ".f", -1).cast("bigint").alias("ord"), "is_modified", "how")


@register("fuzzy_relocation")
def fuzzy_relocation(spark, sf):
    rows = [(1, "a.f", "function", "the quick brown fox jumps over the lazy dog near the river bank"), (2, "a.g", "function", "short")]
    new = [(1, "b.f", "function", "the quick brown fox jumps over the lazy dog near the river banks"), (2, "b.g", "function", "short")]
    kind = "ord int, name string, kind string, doc string"
    return diff.fuzzy_matches(spark.createDataFrame(new, kind), spark.createDataFrame(rows, kind))


THIN = "(length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 40)"


FIRST = "lower(trim(regexp_replace(split_part(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10) || chr(10), 1), '\\s+', ' ', 'g')))"


@register("thin_docs", f"SELECT doc_id FROM documents WHERE {THIN} OR len(list_filter({P.THIN_OPENINGS!r}, lambda p: starts_with({FIRST}, p))) > 0")
def thin_docs(spark, sf):
    return table(spark, sf, "documents").filter(P.is_thin(F.col("text"))).select("doc_id")


HEADS = "(SELECT left(trim(text, ' ' || chr(9) || chr(10) || chr(13)), 400) AS head, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 3 AND head <> '')"


@register("boilerplate_anti", f"SELECT doc_id FROM documents WHERE left(trim(text, ' ' || chr(9) || chr(10) || chr(13)), 400) NOT IN (SELECT head FROM {HEADS})")
def boilerplate_anti(spark, sf):
    d = table(spark, sf, "documents").withColumn("doc", F.col("text"))
    return d.withColumn("head", F.left(X.strip(F.col("doc")), F.lit(400))).join(diff.boilerplate(d).select("head"), "head", "left_anti").select("doc_id")


@register("reject_reasons", f"""SELECT CASE WHEN {THIN} THEN 'thin' WHEN source IN ('src1', 'src2') THEN 'internal' WHEN n_chars > 5000 THEN 'long' ELSE 'kept' END AS reason, count(*)::BIGINT AS n FROM documents GROUP BY 1""")
def reject_reasons(spark, sf):
    d = table(spark, sf, "documents")
    rules = [("thin", F.length(X.strip(F.col("text"))) < 40), ("internal", P.has_internal_module(F.concat(F.lit("a."), "source", F.lit(".f")), ["src1", "src2"])), ("long", F.col("n_chars") > 5000)]
    return d.groupBy(F.coalesce(P.reject_reason(rules), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


RULES = ["private", "deprecated", "type_alias", "undocumented", "thin", "no_source", "plumbing", "vendored", "self_private", "foreign", "internal_module", "pattern_0", "kept"]


@register("quality_filters", f"SELECT p_partkey, {RULES!r}[p_partkey % 13 + 1] AS reason FROM part")
def quality_filters(spark, sf):
    p = table(spark, sf, "part").withColumn("k", (F.col("p_partkey") % 13).cast("int"))
    doc = F.concat(F.lit("Some words on what this does, "), F.col("p_name"), F.lit(" "), F.repeat(F.lit("x"), F.lit(40)))
    pick = lambda default, **cases: F.coalesce(*[F.when(F.col("k") == int(k[1:]), v) for k, v in cases.items()], F.lit(default) if isinstance(default, str) else default)
    empty = F.array().cast("array<struct<name:string>>")
    e = p.select(
        "p_partkey",
        pick("pkg.mod.Thing", _0="pkg.mod._Hidden", _7="pandas.io.clipboard.Thing", _10="pkg.base.Thing", _11="pkg.mod.OldThing").alias("name"),
        pick("class", _2="method").alias("kind"),
        F.when(F.col("k") == 2, empty).otherwise(F.array(F.struct(F.lit("a").alias("name")))).alias("params"),
        F.when(F.col("k").isin(2, 3), "").when(F.col("k") == 1, F.concat(doc, F.lit(" Use that INSTEAD. Deprecated."))).when(F.col("k") == 4, F.concat(F.lit("Common base  class for\n all exceptions "), doc)).when(F.col("k") == 8, F.concat(F.lit(" Internal use only. "), doc)).otherwise(doc).alias("doc"),
        pick("/env/site-packages/pkg/mod.py", _5="/env/site-packages/pkg/mod.SO", _6="/env/site-packages/pkg/_lib/z.py", _9="/env/other/mod.py").alias("path"),
    )
    reason = P.reject_reason(P.catalogue_rules("pkg", patterns=["^Old"]))
    return e.select("p_partkey", F.coalesce(reason, F.lit("kept")).alias("reason"))


@register("suffix_cap", "SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY source, lang) AS n, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE n < 5 OR r <= 3")
def suffix_cap(spark, sf):
    d = table(spark, sf, "documents").withColumn("g", F.concat_ws("/", "source", "lang"))
    return R.suffix_cap(d, "g", "n_chars", "doc_id").select("doc_id")


@register("drop_reasons", "SELECT p_partkey, CASE WHEN p_size = 1 THEN 'file_io' WHEN p_size = 2 THEN 'no_valid_example' WHEN p_size = 3 THEN 'no_implementation' WHEN p_size = 4 THEN 'empty_s_param' WHEN p_size = 5 THEN 'empty_mechanism' ELSE 'kept' END AS reason FROM part")
def drop_reasons(spark, sf):
    p, s = table(spark, sf, "part"), F.col("p_size")
    statuses = F.when(s == 2, F.array(F.lit("failed"))).otherwise(F.array(F.lit("failed"), F.lit("static")))
    long = F.when(s == 3, F.repeat(F.lit("x"), F.lit(12_001))).otherwise("code")
    reason = P.drop_reason(s == 1, statuses, long, F.when(s == 4, 0).otherwise(2), F.when(s == 5, " ").otherwise("m"))
    return p.select("p_partkey", F.coalesce(reason, F.lit("kept")).alias("reason"))


@register("gate_flags", "SELECT user_id, count(*) FILTER (value > 50) >= 3 AS novel, count(*) FILTER (value > 95) >= 1 AS solved FROM events GROUP BY 1")
def gate_flags(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.collect_list(F.col("value") > 50).alias("fails"), F.count_if(F.col("value") > 95).alias("n"))
    return e.select("user_id", P.gate_novel(F.col("fails"), 3).alias("novel"), P.gate_solved(F.col("n")).alias("solved"))


@register("best_path", "SELECT p_brand, arg_min(p_name, [p_size, p_partkey]) AS name FROM part GROUP BY 1")
def best_path(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.min_by("p_name", F.struct("p_size", "p_partkey")).alias("name"))


@register("distractor_sample", """
WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY md5('7:' || p_partkey), p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS c FROM part)
SELECT a.p_partkey AS task, b.p_partkey AS other FROM r a JOIN r b ON a.p_brand = b.p_brand AND (b.r - a.r + a.c) % a.c BETWEEN 1 AND 3
""")
def distractor_sample(spark, sf):
    return S.distractors(table(spark, sf, "part"), "p_brand", "p_partkey", 3)


@register("bernoulli_keep", "SELECT p_partkey FROM part WHERE ('0x' || left(md5('7:' || p_partkey), 8))::BIGINT < 1288490188")
def bernoulli_keep(spark, sf):
    return table(spark, sf, "part").select("p_partkey").filter(S.keep_chance(F.col("p_partkey"), 0.3))
