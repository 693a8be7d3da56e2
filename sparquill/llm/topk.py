"""Exact top-k search by tiles (operator 6).

Queries and shards of the candidates are packed into blocks of rows, whose vectors lie side by
side in one binary value. Blocks are dealt into groups of BLOCKS, numbered from the counts of rows;
every group of queries meets every group of candidates in one task, which holds the queries' blocks
and streams the candidates'. A task multiplies matrices of bounded size and keeps, per tile, only
each query's best by partial selection over the whole tile; its lists are merged as they come. The
tasks' lists are then merged in a tree, FAN groups at a time, by ranks within the query.

Components x are turned into floor(SCALE * x), and scores are integer inner products: exact, by
double-precision products where no sum can pass 2^53, else in 64-bit integers.

Cases: vectors that are null, empty, or hold null or non-finite components, and rows without an
id, take no part; neither do vectors with a scaled component of 2^28 and more, whose scores might
not fit a long; nor do vectors of another length than a query's, for that query; of rows with
one id and one vector all count, each once; a query's own id is no candidate; ties go to the
smaller id; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table

SCALE = 256.0
#: Rows of a block of queries and of a block of candidates; blocks of each that meet in a task.
QUERY_ROWS = 1024
SHARD_ROWS = 4096
BLOCKS = 16
FAN = 8
#: Partitions at most; a task then takes several groups, one after another.
MOST_TASKS = 100_000
LARGEST = float(1 << 28)


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    """(block, dim, ids, vectors): rows packed by dimension; vectors as little-endian int32."""

    def run(batches):
        from pyspark import TaskContext

        part, serial, held = TaskContext.get().partitionId(), 0, {}

        def pack(dim):
            nonlocal serial
            ids, vectors = held.pop(dim)
            serial += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part * (1 << 32) + serial]), pa.array([dim], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([np.concatenate(vectors).tobytes()])],
                names=["block", "dim", "ids", "vectors"],
            )

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = vector.values
                if vec_id is None or values is None or not len(values) or values.null_count:
                    continue
                v = np.floor(SCALE * values.to_numpy(zero_copy_only=False).astype(np.float64))
                if not (np.abs(v) < LARGEST).all():  # false for what isn't finite, too
                    continue
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(vec_id)
                vectors.append(v.astype("<i4"))
                if len(ids) == rows:
                    yield pack(len(v))
        for dim in list(held):
            yield pack(dim)

    return df.filter("vec is not null").mapInArrow(run, "block long, dim int, ids binary, vectors binary")


def _best(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query among flat lists: score downwards, then id."""
    order = np.lexsort((ids, -scores, queries))
    q = queries[order]
    first = np.r_[True, q[1:] != q[:-1]]
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[rank < k]


def _multiply(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def tile(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one tile the k best of each query, as (row of the query, id, score); its own id left out."""
    scores = _multiply(q, c)
    own = qids[:, None] == cids[None, :]
    if len(cids) > k:
        ranked = np.where(own, np.iinfo(np.int64).min, scores)
        edge = np.partition(ranked, len(cids) - k, axis=1)[:, len(cids) - k]
        i, j = np.nonzero((ranked >= edge[:, None]) & ~own)
    else:
        i, j = np.nonzero(~own)
    at = _best(i, cids[j], scores[i, j], k)
    return i[at], cids[j][at], scores[i, j][at]


def search(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest score for every query."""
    small_batches(vectors.sparkSession)
    shape = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vec"))
    n_shards = max(1, -(-vectors.count() // (SHARD_ROWS * BLOCKS)))
    n_queries = max(1, -(-queries.count() // (QUERY_ROWS * BLOCKS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    shards = _blocks(shape(vectors), SHARD_ROWS).withColumn("group", own(n_shards)).select("group", every(n_queries).alias("queries"), "dim", F.lit(1).alias("side"), "ids", "vectors")
    tiles = _blocks(shape(queries), QUERY_ROWS).withColumn("queries", own(n_queries)).select(every(n_shards).alias("group"), "queries", "dim", F.lit(0).alias("side"), "ids", "vectors")

    def run(batches):
        key, held = None, []

        def flush():
            for ids, _, (i, found, scores) in held:
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), key[0], np.int32)), pa.array(ids[i]), pa.array(found), pa.array(scores)], names=["group", "query_id", "vec_id", "score"])

        for batch in batches:
            for row in zip(*(batch.column(n) for n in range(6))):
                here = tuple(x.as_py() for x in row[:3])
                if here != key:
                    yield from flush()
                    key, held = here, []
                ids, block = np.frombuffer(row[4].as_buffer(), "<i8").copy(), np.frombuffer(row[5].as_buffer(), "<i4").reshape(-1, here[2]).copy()
                if row[3].as_py() == 0:
                    held.append((ids, block, (np.zeros(0, np.int64),) * 3))
                    continue
                for n, (qids, q, lists) in enumerate(held):
                    both = [np.concatenate(x) for x in zip(lists, tile(qids, q, ids, block, k))]
                    at = _best(*both, k)
                    held[n] = (qids, q, tuple(x[at] for x in both))
        yield from flush()

    by_task = ["group", "queries", "dim"]
    met = shards.unionByName(tiles).repartition(min(n_shards * n_queries, MOST_TASKS), *by_task).sortWithinPartitions(*by_task, "side")
    lists = met.mapInArrow(run, "group int, query_id long, vec_id long, score long")
    step = n_shards
    while True:
        step = -(-step // FAN)
        by = Window.partitionBy("query_id", "group").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("group", F.col("group") % step).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        if step == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")


def op6_topk_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over the whole of embeddings: queries are the ids divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 50 = 0"), 5)


OP6_SQL = """
WITH v AS (
  SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.id AS query_id, c.id AS vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.id % 50 = 0 AND q.id <> c.id AND len(q.e) = len(c.e))
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
WHERE rank <= 5
"""
