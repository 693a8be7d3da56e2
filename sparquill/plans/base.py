"""Bindings of the driver's tables to the engine's frames, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def verdicts(spark: SparkSession, sf_dir: str, condition: str = "l_returnflag") -> DataFrame:
    """Verdict frame: task, api (cluster), library, condition, passed 0/1, label, ord."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("task_id"), F.col(condition).cast("string").alias("condition"))
    line = line.agg(F.max((F.col("l_discount") >= 0.09).cast("int")).alias("passed"), F.min("l_quantity").cast("int").alias("q"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_brand").alias("api_name"), F.col("p_type").alias("library"), F.col("p_size").alias("size"))
    v = line.join(part, "task_id")
    label = F.when(F.col("passed") == 1, "Pass").otherwise(F.element_at(F.array(*[F.lit(x) for x in LABELS[1:]]), F.pmod("q", F.lit(4)) + 1))
    return v.select("task_id", "api_name", "library", "size", "condition", "passed", label.alias("label"), F.col("task_id").alias("ord"))


LABELS = ["Pass", "WrongSyntax", "WrongImport", "WrongParam", "WrongLogic"]


def verdicts_sql(condition: str = "l_returnflag") -> str:
    """The same frame for DuckDB."""
    return f"""(SELECT task_id, p_brand AS api_name, p_type AS library, p_size AS size, condition, passed,
      CASE WHEN passed = 1 THEN 'Pass' ELSE ['WrongSyntax','WrongImport','WrongParam','WrongLogic'][q % 4 + 1] END AS label
      FROM (SELECT l_partkey AS task_id, {condition}::VARCHAR AS condition,
                   max(CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END) AS passed, trunc(min(l_quantity))::INT AS q
            FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = task_id)"""


CONDITIONS = ["A", "N", "R"]
SIX = ["1", "2", "3", "4", "5", "6"]
