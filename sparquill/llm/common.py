"""What the corpus operators share: table access, word splitting, checkpoints."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the ASCII controls tab to carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text: maximal runs of characters that aren't SEPARATORS; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share, as the cluster names it in
    spark.checkpoint.dir. Only where that is unset (tests in local mode) a temporary folder
    of this machine serves."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="sparquill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing df to the shared checkpoint folder; lost executors cost nothing."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


class Scratch:
    """Tables that one job writes to the shared folder to cut lineage, and deletes when they are
    spent. What a result still reads lazily must not be kept here."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written out."""
        path = f"{self.folder}/{len(self.tables)}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((kept, path))
        return kept

    def drop(self, *spent: DataFrame) -> None:
        """Delete some of the tables."""
        for df in spent:
            delete(self.spark, next(path for kept, path in self.tables if kept is df))

    def close(self) -> None:
        """Delete all."""
        delete(self.spark, self.folder)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared folder."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(to, True)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined with one row a group, without a hot task. Groups of more than a thousandth of
    the rows, of which there are fewer than a thousand, are broadcast; the others are joined by
    shuffle. size: the column of groups with the (greatest possible) number of the group's rows."""
    edge = max(1000, total // 1000)
    hot, cold = groups.filter(F.col(size) > edge), groups.filter(F.col(size) <= edge)
    if hot.isEmpty():
        return rows.join(groups, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers, where the session lets them be larger."""
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 4 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


@contextmanager
def no_cycles():
    """Without the garbage collector, for code that makes no cycles: it would walk the memos again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Memo(dict):
    """What a worker remembers by word. Once full it takes no more, as words seen first are the
    frequent ones, until it has turned away four times its size, when it starts anew."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.away = most, 0

    def keep(self, key, value) -> None:
        """Remember if there is room."""
        if len(self) < self.most:
            self[key] = value
        else:
            self.away += 1
            if self.away > 4 * self.most:
                self.clear()
                self.away = 0
