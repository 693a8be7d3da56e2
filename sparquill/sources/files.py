"""Typed readers and sinks. Row order is data here, so readers can add ``ord``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_order(df: DataFrame, name: str = "ord") -> DataFrame:
    """Dense row numbers in the order of a scan's partitions, from their counts (one number a partition
    on the driver): no shuffle, no single task. Meant for scans, whose partitions come out alike each time."""
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r[0]: r[1] for r in df.groupBy(part.alias("p")).count().collect()}
    starts, seen = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(seen)
        seen += counts.get(p, 0)
    texts = ",".join(map(str, starts or [0]))
    return df.withColumn(name, F.get(F.split(F.lit(texts), ",").cast("array<bigint>"), part) + place)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzipped by suffix; blank lines are skipped and malformed ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a file that may be missing: then no rows."""
    try:
        found = first_present(spark, path)
    except FileNotFoundError:
        return spark.createDataFrame([], schema)
    return read_jsonl(spark, found, schema)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV, with a header unless said otherwise; in text columns empty stays empty and NA or none are plain text."""
    df = spark.read.schema(schema).option("header", header).option("sep", sep).option("nullValue", "").csv(path)
    return df.na.fill("", subset=[n for n, t in df.dtypes if t == "string"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, ord) of a list with one id a line; blank and # lines don't count."""
    lines = with_order(spark.read.text(path)).withColumn("id", F.trim(F.regexp_replace("value", r"\s+$", "")))
    return lines.filter("id <> '' and not startswith(id, '#')").select("id", "ord")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(name, entry) of JSON documents that hold a map of entries."""
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.explode(F.from_json("value", "entries map<string,string>")["entries"]).alias("name", "entry"))


def first_present(spark: SparkSession, *paths: str) -> str:
    """The first path that exists: a released file before a built one. None is an error."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            return path
    raise FileNotFoundError(", ".join(paths))


def freeze_pool(candidates: DataFrame, membership: DataFrame, families: list[str], path: str) -> dict:
    """Write a pool: candidates (name, library, ...) as JSON lines sorted by name with portable paths,
    memberships (name, family, kind) as a wide CSV sorted by name, and a manifest with counts and
    digests, last. Returns the manifest."""
    import json

    from ..functions.text import portable
    from ..operators.setops import membership as wide

    spark = candidates.sparkSession
    rows = portable(candidates).orderBy("name")
    rows.write.mode("overwrite").json(f"{path}/candidates")
    table = candidates.select("name", "library").join(wide(membership, "name", "family", families, "kind"), "name").orderBy("name")
    write_csv(table, f"{path}/membership")
    counts = {r["library"]: r["n"] for r in candidates.groupBy("library").agg(F.count("*").alias("n")).orderBy("library").collect()}
    files = checksums(spark, f"{path}/candidates/*.json").orderBy("path").collect()
    manifest = {"n_candidates": sum(counts.values()), "per_library": counts, "families": families, "sha256": {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in files}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def write_hits(hits: DataFrame, path: str) -> None:
    """Retrieval hits as one CSV of fixed columns, sorted by task and condition."""
    write_csv(hits.select("task_id", "condition", "target_rank", "hit5").orderBy("task_id", "condition"), path)


def write_exclusions(reasons: DataFrame, path: str) -> None:
    """(task_id, reason) as one tab-separated file without a header, sorted by task."""
    reasons.select("task_id", "reason").orderBy("task_id").coalesce(1).write.mode("overwrite").option("sep", "\t").csv(path)


def verdict_rows(records: DataFrame, message: str) -> DataFrame:
    """Result records as verdict rows: an empty label becomes Pass or Unlabelled, passed 0 or 1, and
    whether a failure is the call check's, by its message."""
    passed = F.coalesce(F.col("passed").cast("boolean"), F.lit(False))
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.when(passed, "Pass").otherwise("Unlabelled"))
    failed = ~passed & F.contains(F.coalesce("error", F.lit("")), F.lit(message))
    return records.select("task_id", "api_name", "library", "domain", "difficulty", passed.cast("int").alias("passed"), label.alias("label"), failed.cast("int").alias("call_check_failed"), "pass_at_5")


def read_health(spark: SparkSession, path: str) -> DataFrame:
    """(name) of the subtrees that a catalogue's walk could not read; aborted walks are no lost subtrees."""
    doc = spark.read.text(path, wholetext=True)
    found = F.from_json("value", "health struct<walk_failures:array<string>>")["health"]["walk_failures"]
    return doc.select(F.explode(found).alias("name")).filter(~F.endswith("name", F.lit(" <walk aborted>")))


def read_runs(spark: SparkSession, pattern: str, schema: str, experiments: list[str]) -> DataFrame:
    """Result files of <run>/<cell>/ folders, with run, cell and the cell's method and condition (parted by
    two underscores; a cell without them is a condition) from the path; unknown runs are left out."""
    df = spark.read.schema(schema).json(pattern).withColumn("__p", F.split(F.col("_metadata.file_path"), "/"))
    out = df.withColumn("run", F.element_at("__p", -3)).withColumn("cell", F.element_at("__p", -2)).drop("__p")
    parted = F.contains("cell", F.lit("__"))
    out = out.withColumn("method", F.when(parted, F.substring_index("cell", "__", 1))).withColumn("condition", F.when(parted, F.regexp_replace("cell", "^.*?__", "")).otherwise(F.col("cell")))
    return out.filter(F.substring_index("run", "-", 1).isin(experiments))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Sorted stems of a folder's files; contents aren't read."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(path).select(F.regexp_replace(name, r"\.[^.]*$", "").alias("stem")).distinct().orderBy("stem")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_index(df: DataFrame, path: str) -> None:
    """A vector index: Parquet by domain and condition, so a group's scan reads its own files."""
    df.write.mode("overwrite").partitionBy("domain", "condition").parquet(path)


def put_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows to append: keys the cache lacks, first of each, with a response. Where fresh has columns
    temperature and search, only what was asked at a temperature of 0 or by search is kept."""
    from ..operators.setops import first_wins

    rows = fresh.filter("coalesce(response, '') <> ''")
    if {"temperature", "search"} <= set(fresh.columns):
        rows = rows.filter("coalesce(temperature, 0) <= 0 or coalesce(search, false)")
    return first_wins(rows, ["key"], ["created_at"]).join(cache.select("key"), "key", "left_anti")


def cache_report(cache: DataFrame, log: DataFrame) -> DataFrame:
    """Entries and hits by model; ``log`` has the key of every hit."""
    hits = log.groupBy("key").agg(F.count("*").alias("__hits"))
    rows = cache.join(hits, "key", "left").groupBy("model").agg(F.count("*").alias("entries"), F.coalesce(F.sum("__hits"), F.lit(0)).alias("hits"))
    return rows.orderBy(F.desc("entries"), "model")


def overrides(items: list[str]) -> dict:
    """Nested settings of a dot list, ``a.b=value``, values as JSON where they are."""
    import json

    out: dict = {}
    for item in items:
        path, _, text = item.partition("=")
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        for name in reversed(path.split(".")):
            value = {name: value}
        out = layered(out, value)
    return out


def layered(base: dict, *layers: dict) -> dict:
    """Nested settings; the right-most wins."""
    out = dict(base)
    for layer in layers:
        for k, v in layer.items():
            out[k] = layered(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
