"""Exact vector retrieval within groups, ranks of targets, joined contexts."""

from __future__ import annotations

import tempfile
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def top_k(scored: DataFrame, k: int, query: str = "query_id", chunk: str = "chunk_id") -> DataFrame:
    """Best k rows of each query: score downwards, then id."""
    by = Window.partitionBy(query).orderBy(F.desc("score"), chunk)
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


#: Queries and corpus rows of a group that meet in one task, at most (about); pairs from which on work is dealt out; pairs scored at once.
TASK_QUERIES, TASK_ROWS, TASK_PAIRS, BLOCK_PAIRS = 16_384, 200_000, 1 << 24, 1 << 19
#: Rows that are scored at once.
BLOCK_ROWS = 1024


def _tiles(queries: DataFrame, corpus: DataFrame, on: list[str], fold, kind: str) -> DataFrame:
    """Rows that ``fold`` makes of each task's queries and corpus rows. Both sides have the group's columns
    ``on``, id (long) and emb; queries also at_score and at_id. ``fold(q)`` of a block of queries (id, at_score,
    at_id) gives two functions: one takes the ids of a block of corpus rows and the block's inner products, one
    returns the rows at the end. Queries and rows of a group are dealt out by their counts: rows are copied
    once for each TASK_QUERIES queries, queries once for each part of the rows; the parts are as many as hold
    TASK_ROWS rows each, or as there are cores to keep busy."""
    busy = 3 * corpus.sparkSession.sparkContext.defaultParallelism
    sizes = queries.groupBy(*on).agg(F.count("*").alias("__q")).join(corpus.groupBy(*on).agg(F.count("*").alias("__c")), on)
    nq = F.ceil(F.col("__q") / TASK_QUERIES)
    tasks = F.least(F.ceil(F.col("__q") * F.col("__c") / TASK_PAIRS), F.lit(busy))
    sizes = sizes.select(*on, nq.cast("int").alias("__nq"), F.greatest(F.ceil(F.col("__c") / TASK_ROWS), F.ceil(tasks / nq)).cast("int").alias("__nc"))
    sizes = F.broadcast(sizes) if sizes.count() <= 100_000 else sizes
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    key = F.xxhash64(*[F.col(x).cast("string") for x in on])
    whole = next(f.dataType.elementType.typeName() for f in corpus.schema if f.name == "emb") == "float" == next(f.dataType.elementType.typeName() for f in queries.schema if f.name == "emb")
    vec = F.col("emb") if whole else F.col("emb").cast("array<double>")  # floats are widened in the task
    left = queries.join(sizes, on).select(key.alias("key"), own("__nq").alias("p"), every("__nc").alias("r"), F.lit(0).alias("side"), "id", vec.alias("v"), "at_score", "at_id")
    right = corpus.join(sizes, on).select(key.alias("key"), every("__nq").alias("p"), own("__nc").alias("r"), F.lit(1).alias("side"), "id", vec.alias("v"), F.lit(None).cast("double").alias("at_score"), F.lit(None).cast("long").alias("at_id"))

    def run(batches):
        def side(batch):
            dim = len(batch.column(5)[0])
            v = batch.column(5).flatten().to_numpy().reshape(-1, dim)
            return [batch.column(4).to_numpy(), v, batch.column(6).to_numpy(zero_copy_only=False), batch.column(7).to_numpy(zero_copy_only=False)]

        def opened(held):
            ids, v, score, at = [np.concatenate(x) for x in zip(*held)]
            step = max(1, BLOCK_PAIRS // BLOCK_ROWS)
            return [(v[a : a + step].astype(np.float64), *fold((ids[a : a + step], score[a : a + step], at[a : a + step]))) for a in range(0, len(ids), step)]

        key, held, blocks = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                here = tuple(keys[a][:3])
                if here != key:
                    for _, _, end in blocks:
                        yield from end()
                    key, held, blocks = here, [], []
                if keys[a][3] == 0:
                    held.append([np.array(x) for x in side(batch.slice(a, b - a))])
                    continue
                if held:
                    blocks, held = opened(held), []
                if blocks:
                    ids, v, _, _ = side(batch.slice(a, b - a))
                    for at in range(0, len(ids), BLOCK_ROWS):
                        rows = v[at : at + BLOCK_ROWS].astype(np.float64).T
                        for vectors, take, _ in blocks:
                            take(ids[at : at + BLOCK_ROWS], vectors @ rows)
        for _, _, end in blocks:
            yield from end()

    met = left.unionByName(right).repartition("key", "p", "r").sortWithinPartitions("key", "p", "r", "side")
    return met.mapInArrow(run, kind)


def _shape(df: DataFrame, on: list[str], key: str) -> DataFrame:
    return df.select(*on, F.col(key).cast("long").alias("id"), "emb")


def _same(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal ids in two arrays, pair by pair."""
    order = np.argsort(c, kind="stable")
    low, high = np.searchsorted(c, q, "left", order), np.searchsorted(c, q, "right", order)
    i = np.repeat(np.arange(len(q)), high - low)
    return i, order[np.arange(len(i)) - np.repeat(np.cumsum(high - low) - high, high - low)]


def search(queries: DataFrame, corpus: DataFrame, on: list[str], k: int, digits: int = 9, query: str = "query_id", chunk: str = "chunk_id", apart: bool = False) -> DataFrame:
    """Best k corpus rows of each query within its group, by inner product (rounded to ``digits``) and then
    id: query, chunk, score, rank. apart: a query's own id is no candidate."""

    def fold(q):
        best, who = np.full((len(q[0]), k), -np.inf), np.zeros((len(q[0]), k), np.int64)  # so far, best first

        def take(ids, scores):
            np.round(scores, digits, out=scores)
            if apart:
                scores[_same(q[0], ids)] = -np.inf
            live = np.flatnonzero(scores.max(axis=1) >= best[:, -1])
            if not len(live):
                return
            some, edge = scores[live], best[live, -1]
            if some.shape[1] > k:
                edge = np.maximum(edge, np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k])
            i, j = np.nonzero((some >= edge[:, None]) & (some > -np.inf))
            old = np.nonzero(best[live] > -np.inf)
            i, s, c = np.concatenate([i, old[0]]), np.concatenate([some[i, j], best[live][old]]), np.concatenate([ids[j], who[live][old]])
            at = np.lexsort((c, -s, i))
            i, s, c = i[at], s[at], c[at]
            rank = np.arange(len(i)) - np.searchsorted(i, i)  # ties beyond the kth go
            i, s, c, rank = (x[rank < k] for x in (i, s, c, rank))
            best[live[i], rank], who[live[i], rank] = s, c

        def end():
            i, j = np.nonzero(best > -np.inf)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(q[0][i]), pa.array(who[i, j]), pa.array(best[i, j])], names=[query, chunk, "score"])

        return take, end

    none = {"at_score": F.lit(None).cast("double"), "at_id": F.lit(None).cast("long")}
    found = _tiles(_shape(queries, on, query).withColumns(none), _shape(corpus, on, chunk), on, fold, f"{query} long, {chunk} long, score double")
    return top_k(found, k, query, chunk)


def first_hit(queries: DataFrame, corpus: DataFrame, on: list[str], k: int = 5, digits: int = 9, query: str = "query_id", chunk: str = "chunk_id", label: str = "label", apart: bool = False) -> DataFrame:
    """Rank of the first row with a query's label in its group's whole ranking (null if there is none), and
    whether it is within k. No ranking is sorted: the best match is searched among the label's rows only, and
    the rank is one more than the number of rows that precede it."""

    def fold(q):
        ids, score, at = q[0], q[1][:, None], q[2]
        n = np.zeros(len(ids), np.int64)

        def take(others, scores):
            np.round(scores, digits, out=scores)
            if apart:
                scores[_same(ids, others)] = -np.inf
            n[:] += np.count_nonzero(scores > score, axis=1)
            i, j = np.nonzero(scores == score)
            np.add.at(n, i, others[j] < at[i])

        def end():
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=[query, "n"])

        return take, end

    labelled = lambda df: df.withColumn("__label", F.col(label).cast("string"))
    top = search(labelled(queries), labelled(corpus), [*on, "__label"], 1, digits, query, chunk, apart)
    top = top.select(F.col(query).alias("id"), F.col("score").alias("at_score"), F.col(chunk).alias("at_id"))
    counts = _tiles(_shape(queries, on, query).join(top, "id"), _shape(corpus, on, chunk), on, fold, f"{query} long, n long").groupBy(query).agg((F.sum("n") + 1).cast("int").alias("target_rank"))
    out = queries.select(query).join(counts, query, "left")
    return out.withColumn("hit5", F.coalesce((F.col("target_rank") <= k).cast("int"), F.lit(0)))


def contexts(top: DataFrame, text: str = "text", separator: str = "\n\n---\n\n", query: str = "query_id") -> DataFrame:
    """Texts of a query's best rows, joined in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t"))))
    return top.groupBy(query).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), separator).alias("context"))


def nearest_within(top: DataFrame, radius: float) -> DataFrame:
    """Of the nearest rows of queries (rank 1), those whose distance (for unit vectors) is within the radius."""
    distance = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score")))
    return top.filter("rank = 1").withColumn("distance", distance).filter(F.col("distance") <= radius)


def mmr(df: DataFrame, by: str, n: int, lam: float = 0.5, item: str = "id", quality: str = "quality", emb: str = "emb") -> DataFrame:
    """Maximal marginal relevance over all rows of each group: (by, item, position). Starts at the
    best quality (scaled to [0, 1]), then adds what trades quality against the greatest likeness to
    the chosen; first by item on ties; a group of n rows and less passes whole, by item. A round is
    an argmax of each group over all rows; only the chosen, n a group at most, go from round to round."""
    rows = df.select(F.col(by).alias("g"), F.col(item).alias("i"), F.col(quality).cast("double").alias("q"), F.col(emb).alias("e"), F.monotonically_increasing_id().alias("k"))
    rows = _cut(rows)  # k stays the same from round to round
    groups = rows.groupBy("g").agg(F.count("*").alias("size"), F.min("q").alias("lo"), F.max("q").alias("hi")).withColumnRenamed("g", "h")
    rows = rows.join(groups, F.col("g").eqNullSafe(F.col("h")))
    whole = rows.filter(F.col("size") <= n).withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy("i", "k")))
    scaled = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("q") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    large = rows.filter(F.col("size") > n).select("g", "i", "k", "e", scaled.alias("q"))
    chosen = None
    for position in range(1, n + 1):
        left, gain = large, F.col("q")
        if chosen is not None:
            so_far = chosen.groupBy(F.col("g").alias("h")).agg(F.collect_list("k").alias("ks"), F.collect_list("e").alias("es"))
            left = large.join(so_far, F.col("g").eqNullSafe(F.col("h"))).filter(~F.array_contains("ks", F.col("k")))
            gain = lam * F.col("q") - (1 - lam) * F.array_max(F.transform("es", lambda v: dot(F.col("e"), v)))
        best = left.select("g", F.struct((-gain).alias("loss"), "i", "k", "e").alias("x")).groupBy("g").agg(F.min("x").alias("x"))
        best = best.select("g", "x.i", "x.k", "x.e", F.lit(position).alias("position"))
        chosen = _cut(best if chosen is None else chosen.unionByName(best))
    out = [whole.select("g", "i", "position")] + ([] if chosen is None else [chosen.select("g", "i", "position")])
    return reduce(DataFrame.unionByName, out).select(F.col("g").alias(by), F.col("i").alias(item), "position")


def _cut(df: DataFrame) -> DataFrame:
    """Lineage cut by a checkpoint in the folder that spark.checkpoint.dir names; in local mode, where
    that is unset, in a temporary one."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparquill-"))
    return df.checkpoint(eager=True)


def suffix_cap(df: DataFrame, group: str, quality: str, order: str, cap: int = 3, least: int = 5) -> DataFrame:
    """The best ``cap`` rows of groups of ``least`` and more; smaller groups pass whole. Groups are counted
    before the shuffle, and only the first rows of each partition's groups are ranked."""
    rows = df.withColumn("__g", F.coalesce(F.to_json(F.struct(group)), F.lit("")))
    sizes = rows.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    rows = rows.join(sizes, "__g")
    best = rows.filter(F.col("__n") >= least).withColumn("__r", F.row_number().over(Window.partitionBy("__g").orderBy(F.desc(quality), order))).filter(F.col("__r") <= cap)
    return rows.filter(F.col("__n") < least).unionByName(best.drop("__r")).select(*[F.col(f"`{c}`") for c in df.columns])
