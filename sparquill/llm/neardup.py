"""Near-duplicate detection by a MinHash LSH forest (operator 10).

One pass turns each text into its set of hashed word shingles and keeps only the set's size,
digest and MinHash signature. Rows with equal sets become one class; classes are then put into
TREES orders, each of which reads the signature from another place. Two classes that agree in the
first values of an order share a region of it. The depth adapts to the region: one that holds more
than LEAF classes is split by a longer prefix, and again, up to DEPTHS[-1]; a region still larger,
whose members agree in that many values, is cut into parts that hang together as a tree. Within
these leaves each class picks its FIRST neighbours of most equal values. The picks are confirmed on
the full sets, which joins most of what belongs together. Then every region of the first depth that
still holds several components is gone through whole: what lies outside its largest component is
compared with all of the region, and each pair of two components that may be as similar as asked is
confirmed too, until none is left. So splitting and picking lose no link that matters to a
component, and dense groups don't cost their square. Components come from star contraction on
tables; nothing of the corpus goes to the driver.

A pair of similarity s meets in a region of the first depth, 4, with probability
1 - (1 - s^4)^TREES: 0.99999 for s = 0.85, 0.9998 for s = 0.8, and more through other members of its
group. Two groups of m similar texts each that share a region but aren't linked cost up to m * m
comparisons of 96 bytes, in blocks spread over tasks.

Only what regions share is shuffled, signatures as one byte a value. Tables between the steps are
written to the shared folder and deleted when spent; the result is a checkpoint.

Cases: null and empty texts have no shingles and are linked with nothing, not even with each
other or with other rows of their doc_id; a text of fewer words than a shingle is one shingle; rows
with equal doc_id are one document, whose texts all link it; a null doc_id is never a component's
name: its row's component is null, and the row is kept, unless it is linked with a document that
has an id; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, Scratch, checkpoint, join_groups, no_cycles, small_batches, table

WIDTH = 5
VALUES = 96
TREES = 16
DEPTHS = (4, 6, 9, 14, 24)
LEAF = 256
#: Larger regions are compared in blocks of LEAF rows, each pair of blocks by itself.
WHOLE = 2048
#: Candidates agree in this share of values: at 96 values five deviations below a similarity of 0.85.
NEAR = 0.18
#: Neighbours that each class picks.
FIRST = 3
#: Ids are broadcast up to this many (16 bytes each), and joined by shuffle beyond.
BROADCAST_IDS = 500_000
#: Partners of one class that are confirmed in one task.
PARTNERS = 1024
MEMO_WORDS = 250_000

_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32)[:, None]


class Shingler:
    """Shingle sets of texts; remembers the hashes of words."""

    def __init__(self):
        import xxhash

        self.hash, self.memo = xxhash.xxh64_intdigest, Memo(MEMO_WORDS)

    def shingles(self, text: str | None, width: int = WIDTH) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles (A-Z lower-cased, ASCII separators)."""
        words = (text or "").encode().lower().split()
        memo = self.memo
        try:
            ids = [memo[w] for w in words]
        except KeyError:
            ids = []
            for w in words:
                x = memo.get(w)
                if x is None:
                    x = self.hash(w)
                    memo.keep(w, x)
                ids.append(x)
        w = np.array(ids, np.uint64)
        if not len(w):
            return w
        k = min(width, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for j in range(k):
            h = (h ^ w[j : len(w) - k + 1 + j]) * _MULT[j % 5]
            h ^= h >> np.uint64(29)
        return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least values of the set under VALUES permutations."""
    h = (shingles >> np.uint64(17)).astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 4096):
        x = (h[None, at : at + 4096] ^ _B) * _A
        x ^= x >> np.uint32(15)
        out = np.minimum(out, (x * np.uint32(0x2C1B3C6D)).min(axis=1))
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signed(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n (size of the shingle set), digest and signature (two bytes a value) of every
    document; the last two null for the empty set."""
    small_batches(docs.sparkSession)

    def run(batches):
        import xxhash

        shingler = Shingler()
        for batch in batches:
            ns, digests, sigs = [], [], []
            with no_cycles():
                for text in batch.column(1):
                    h = shingler.shingles(text.as_py(), width)
                    ns.append(len(h))
                    digests.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                    sigs.append(signature(h).astype("<u2").tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n", "digest", "sig"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, n long, digest binary, sig binary")


def _keys(sigs: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """One 64-bit key for the first values of an order."""
    h = np.full(len(sigs), depth, np.uint64)
    for k in range(depth):
        h = (h ^ sigs[:, (k + tree * (VALUES // TREES)) % VALUES].astype(np.uint64)) * _MULT[0]
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _matrix(column: pa.Array, kind: str = "<u2") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, VALUES)


def _first_regions(classes: DataFrame) -> DataFrame:
    """(tree, key, cid): each class in each order at the first depth."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sigs, cids = _matrix(batch.column(1)), batch.column(0)
                for t in range(TREES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sigs), t, np.int16)), pa.array(_keys(sigs, t, DEPTHS[0])), cids], names=["tree", "key", "cid"])

    return classes.select("cid", "sig").mapInArrow(run, "tree short, key long, cid long")


def _deeper(rows: DataFrame, classes: DataFrame, depth: int) -> DataFrame:
    """The same rows with their keys at another depth."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                trees, sigs = batch.column(0).to_numpy(), _matrix(batch.column(2))
                keys = np.zeros(len(sigs), np.int64)
                for t in np.unique(trees):
                    keys[trees == t] = _keys(sigs[trees == t], int(t), depth)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), batch.column(1)], names=["tree", "key", "cid"])

    return rows.select("tree", "cid").join(classes.select("cid", "sig"), "cid").select("tree", "cid", "sig").mapInArrow(run, "tree short, key long, cid long")


def regions(scratch: Scratch, rows: DataFrame, total: int) -> DataFrame:
    """(tree, key, cid, m): the rows of regions of two classes and more, with the region's size."""
    sizes = scratch.keep(rows.groupBy("tree", "key").agg(F.count("*").alias("m")).filter("m > 1"))
    out = scratch.keep(join_groups(rows, sizes, ["tree", "key"], "m", total))
    scratch.drop(sizes)
    return out


def leaves(scratch: Scratch, first: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """(tree, key, part, cid, tie): the members of regions, none much over LEAF. tie marks the member
    of another part that ties a part to it."""
    shape = ["tree", "key", "part", "cid", "tie"]
    rows, out = first, None
    for level, depth in enumerate(DEPTHS):
        small = rows.filter(F.col("m") <= LEAF).select("tree", (F.col("key") + level).alias("key"), F.lit(0).cast("long").alias("part"), "cid", F.lit(False).alias("tie"))
        out = small if out is None else out.unionByName(small)
        large = rows.filter(F.col("m") > LEAF)
        if large.isEmpty():
            return out
        if level + 1 < len(DEPTHS):
            rows = regions(scratch, scratch.keep(_deeper(large, classes, DEPTHS[level + 1])), total)
    # members that agree in all of the last depth: parts, each but the first with the least member of another
    cut = scratch.keep(large.select("tree", (F.col("key") + len(DEPTHS)).alias("key"), F.pmod(F.xxhash64("cid"), F.ceil(F.col("m") / (LEAF // 2))).alias("part"), "cid", F.ceil(F.col("m") / (LEAF // 2)).alias("parts"), F.lit(False).alias("tie")))
    least = cut.groupBy("tree", "key", "part").agg(F.min("cid").alias("cid"), F.first("parts").alias("parts"))
    children = F.sequence(F.col("part") * 8 + 1, F.least(F.col("part") * 8 + 8, F.col("parts") - 1))
    ties = least.filter("part * 8 + 1 < parts").select("tree", "key", F.explode(children).alias("part"), "cid", F.lit(True).alias("tie"))
    return out.unionByName(cut.select(*shape)).unionByName(ties.select(*shape))


def _alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of two blocks' signatures and set sizes: numbers of equal values, and whether each pair may be as similar as asked."""
    if len(a) * len(b) <= 4096:
        same = (a[:, None, :] == b[None, :, :]).sum(axis=2, dtype=np.int16)
    else:
        same = np.zeros((len(a), len(b)), np.int16)
        for x, y in zip(a.T, b.T):
            same += x[:, None] == y[None, :]
    small, large = np.minimum(na[:, None], nb[None, :]), np.maximum(na[:, None], nb[None, :])
    least = int(VALUES * max(0.0, percent / 100 - NEAR))
    return same, (same >= least) & (100 * small >= percent * large)


def _sketched(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with n and sketch (one byte a value) of their class."""

    @F.arrow_udf("binary")
    def low(sigs: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for x in (_matrix(sigs) & 0xFF).astype(np.uint8)] if len(sigs) else [], pa.binary())

    return rows.join(classes.select("cid", "n", low("sig").alias("sketch")), "cid")


def _by_region(batches, keys: int):
    """Runs of rows with equal first ``keys`` columns, as lists of numpy arrays, from sorted batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in range(batch.num_columns)]
        got = [_matrix(c, "u1") if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in columns]
        if held is not None:
            got = [np.concatenate(x) for x in zip(held, got)]
        new = np.zeros(len(got[0]) - 1, bool)
        for column in got[:keys]:
            new |= column[1:] != column[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist()]
        for p, q in zip(edges, edges[1:]):
            yield [x[p:q] for x in got]
        # the last region may go on in the next batch
        held = [x[edges[-1] :] for x in got]
    if held is not None:
        yield held


def _emit(found: list, names: tuple[str, ...]):
    columns = [np.concatenate(x) for x in zip(*found)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=list(names))


def picks(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class and its FIRST neighbours of most equal values, and what ties parts; a < b."""

    def run(batches):
        found, held = [], 0
        for _, _, _, cids, tie, ns, sketches in _by_region(batches, 3):
            if len(cids) < 2:
                continue
            same, ok = _alike(sketches, sketches, ns, ns, percent)
            np.fill_diagonal(ok, False)
            # of equally good neighbours those next in number, so that no class is everyone's pick
            turn = (np.arange(len(cids))[None, :] - np.arange(len(cids))[:, None] - 1) % len(cids)
            rank = np.where(ok, same.astype(np.int64) * len(cids) + (len(cids) - 1 - turn), -1)
            best = np.argsort(-rank, axis=1)[:, :FIRST]
            i, k = np.nonzero(np.take_along_axis(rank, best, 1) >= 0)
            j = best[i, k]
            found.append((cids[i], cids[j], same[i, j].astype(np.int32), tie[i]))
            held += len(i)
            if held > 20_000:
                yield _emit(found, ("cid", "other", "same", "tie"))
                found, held = [], 0
        if held:
            yield _emit(found, ("cid", "other", "same", "tie"))

    spread = members.select("tree", "key", "part", "cid", "tie", "n", "sketch").repartition("tree", "key", "part").sortWithinPartitions("tree", "key", "part")
    rows = spread.mapInArrow(run, "cid long, other long, same int, tie boolean").groupBy("cid", "other").agg(F.max("same").alias("same"), F.max("tie").alias("tie"))
    best = Window.partitionBy("cid").orderBy(F.desc("same"), F.xxhash64("cid", "other"))  # at most FIRST rows a tree
    rows = rows.withColumn("k", F.row_number().over(best)).filter((F.col("k") <= FIRST) | F.col("tie"))
    return rows.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct()


def second_look(scratch: Scratch, first: DataFrame, classes: DataFrame, known: DataFrame, percent: int, total: int) -> DataFrame:
    """(a, b, same): pairs of two components that share a region and may be as similar as asked; a < b.
    Of each region with several components, the members outside the largest are compared with every
    member of another component: what pairs this leaves out are joined already."""
    rows = scratch.keep(first.join(known.withColumnRenamed("node", "cid"), "cid", "left").select("tree", "key", "cid", "m", F.coalesce("component", "cid").alias("c")))
    parts = rows.groupBy("tree", "key", "c").agg(F.count("*").alias("n"), F.first("m").alias("m"))
    largest = parts.groupBy("tree", "key").agg(F.count("*").alias("k"), F.first("m").alias("m"), F.max_by("c", F.struct("n", "c")).alias("main")).filter("k > 1").drop("k")
    largest = scratch.keep(largest)
    apart = join_groups(rows.drop("m"), largest, ["tree", "key"], "m", total)
    members = scratch.keep(_sketched(apart.withColumn("probe", F.col("c") != F.col("main")).drop("main"), classes))
    names, kind = ("a", "b", "same"), "a long, b long, same int"
    shape = ["cid", "c", "probe", "n", "sketch"]

    def compare(x, y):
        """Pairs of a block of probes and a block of members."""
        found = []
        for at in range(0, len(x[0]), 64):
            cids, cs, _, ns, sketches = (v[at : at + 64] for v in x)
            same, ok = _alike(sketches, y[4], ns, y[3], percent)
            i, j = np.nonzero(ok & (cs[:, None] != y[1][None, :]))
            if len(i):
                found.append((np.minimum(cids[i], y[0][j]), np.maximum(cids[i], y[0][j]), same[i, j].astype(np.int32)))
        return found

    def within(batches):
        for region in _by_region(batches, 2):
            rows = region[2:]
            if found := compare([v[rows[2]] for v in rows], rows):
                yield _emit(found, names)

    small = members.filter(F.col("m") <= WHOLE).select("tree", "key", *shape)
    pairs = small.repartition("tree", "key").sortWithinPartitions("tree", "key").mapInArrow(within, kind)
    large = members.filter(F.col("m") > WHOLE)
    if not large.isEmpty():
        blocks = F.ceil(F.col("m") / LEAF)
        block = F.pmod(F.xxhash64("cid"), blocks)
        # every block of probes goes to each block of members
        sides = large.select("tree", "key", block.alias("block"), F.lit(False).alias("side"), *shape).unionByName(
            large.filter("probe").select("tree", "key", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(True).alias("side"), *shape)
        )

        def across(batches):
            key, left = None, None
            for tree, at, block, side, *rows in _by_region(batches, 4):
                if (tree[0], at[0], block[0]) != key:
                    key, left = (tree[0], at[0], block[0]), None
                if not side[0]:
                    left = rows
                elif left is not None and (found := compare(rows, left)):
                    yield _emit(found, names)

        pairs = pairs.unionByName(sides.repartition("tree", "key", "block").sortWithinPartitions("tree", "key", "block", "side").mapInArrow(across, kind))
    out = scratch.keep(pairs.distinct())
    scratch.drop(rows, largest, members)
    return out


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, repeated: bool, width: int) -> DataFrame:
    """(cid, set): the full shingle sets of some classes, as sorted uint64."""

    def run(batches):
        import xxhash

        shingler = Shingler()
        for batch in batches:
            with no_cycles():
                sets = [shingler.shingles(x.as_py(), width).tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["digest", "set"])

    named = classes.join(wanted, "cid", "left_semi").select("cid", "digest", "name")
    few = named.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    names = named.select(F.col("name").alias("doc_id"))
    texts = _texts(docs)
    rows = texts.join(F.broadcast(names) if few else names, "doc_id", "left_semi")
    if not named.filter("name is null").isEmpty():
        rows, repeated = rows.unionByName(texts.filter("doc_id is null")), True
    if not repeated:  # each id has one row
        return rows.select("text").mapInArrow(run, "digest binary, set binary").join(F.broadcast(named.drop("name")) if few else named.drop("name"), "digest").select("cid", "set")
    sets = rows.select("text").mapInArrow(run, "digest binary, set binary").join(F.broadcast(named.drop("name")) if few else named.drop("name"), "digest")
    return sets.select("cid", "set").dropDuplicates(["cid"])


def confirmed(scratch: Scratch, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are as similar as asked. Each set goes to its own group and to those
    of its partners that have more; a group of many partners is dealt out to several tasks."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("d"))
    degree = scratch.keep(degree)
    total = 2 * pairs.count()
    both = join_groups(pairs, degree.select(F.col("cid").alias("a"), F.col("d").alias("da")), ["a"], "da", total)
    both = join_groups(both, degree.select(F.col("cid").alias("b"), F.col("d").alias("db")), ["b"], "db", total)
    first = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    hub, other = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    salt = F.pmod(F.xxhash64("cid"), F.ceil(F.greatest("da", "db") / PARTNERS)).alias("salt")
    dealt = scratch.keep(both.select(hub.alias("hub"), other.alias("cid"), "da", "db").select("hub", "cid", salt))
    route = dealt.select("hub", "salt", "cid", F.lit(1).alias("side")).unionByName(dealt.select("hub", "salt", F.col("hub").alias("cid"), F.lit(0).alias("side")).distinct())

    def run(batches):
        key, own = None, None
        for batch in batches:
            a, b = [], []
            for hub, salt, cid, side, held in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                one = np.frombuffer(held.as_buffer(), np.uint64)
                if side == 0:
                    key, own = (hub, salt), one.copy()
                elif key == (hub, salt):
                    both = len(np.intersect1d(own, one, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(one) - both):
                        a.append(min(hub, cid))
                        b.append(max(hub, cid))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sent = route.join(sets, "cid").select("hub", "salt", "cid", "side", "set").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "side")
    out = scratch.keep(sent.mapInArrow(run, "a long, b long"))
    scratch.drop(degree, dealt)
    return out


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component): for every node of the links (a, b), the smallest node it is connected
    with, by alternating large-star and small-star contraction."""
    scratch = scratch or Scratch(links.sparkSession, "components")
    edges = scratch.keep(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    print_of = F.struct(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h"))
    before = None
    while True:
        now = edges.agg(print_of.alias("p")).first()["p"]
        if now == before:
            ends = edges.unionByName(edges.select(F.col("v").alias("u"), "v"))
            return scratch.keep(ends.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")))
        before, total = now, 2 * now["n"]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).select("u", F.least("u", "m").alias("m"), "d")
        large = scratch.keep(join_groups(both, least, ["u"], "d", total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        small = join_groups(large, least, ["u"], "d", total).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        spent, edges = edges, scratch.keep(small.filter("u <> v").distinct())
        scratch.drop(spent, large)


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs of two components, with these."""
    rows = pairs.join(known.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(known.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    return rows.select("a", "b", "same", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).filter("ca <> cb")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document (see the module)."""
    docs = docs.select("doc_id", "text")
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    rows = scratch.keep(signed(docs, width))
    full = rows.filter("n > 0")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("name"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    classes = scratch.keep(classes.withColumn("cid", F.monotonically_increasing_id()))
    total = TREES * classes.count()
    # documents with several rows: all their texts are linked
    again = scratch.keep(full.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k"), F.min("digest").alias("digest"), F.max("digest").alias("most")).filter("k > 1"))
    repeated, links = not again.isEmpty(), None
    several = again.filter("digest <> most")
    if not several.isEmpty():
        numbers = classes.select("cid", "digest")
        own = full.join(several.select("doc_id", F.col("digest").alias("least")), "doc_id").select("digest", "least").distinct()
        links = own.join(numbers, "digest").select(F.col("cid").alias("a"), F.col("least").alias("digest")).join(numbers.withColumnRenamed("cid", "b"), "digest").select("a", "b").filter("a <> b")
        links = scratch.keep(links)

    def confirm(pairs):
        wanted = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
        return confirmed(scratch, pairs, _sets(docs, classes, wanted, repeated, width), percent)

    first = regions(scratch, _first_regions(classes), total)
    chosen = scratch.keep(picks(_sketched(leaves(scratch, first, classes, total), classes), percent))
    found = confirm(chosen)
    known = components(found if links is None else found.unionByName(links), scratch)
    rest = second_look(scratch, first, classes, known, percent, total)
    scratch.drop(first)
    rest = scratch.keep(rest.join(chosen, ["a", "b"], "left_anti"))
    for best_only in (True, False):  # first the best of each pair of components' pairs, then every pair that still matters
        apart = _apart(rest, known)
        if best_only:
            apart = apart.groupBy(F.least("ca", "cb").alias("p"), F.greatest("ca", "cb").alias("q")).agg(F.max(F.struct("same", "a", "b")).alias("e")).select("e.a", "e.b")
        apart = scratch.keep(apart.select("a", "b"))
        if apart.isEmpty():
            break
        found = confirm(apart)
        if not found.isEmpty():
            known = components(found.unionByName(known.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch)
        if best_only:
            rest = scratch.keep(rest.join(apart, ["a", "b"], "left_anti"))
    # a component's name is its least doc_id
    placed = scratch.keep(classes.select("cid", "digest", "name", "copies").join(known, F.col("cid") == F.col("node"), "left").select("digest", "name", "copies", "component"))
    names = placed.filter("component is not null").groupBy("component").agg(F.min("name").alias("c"), F.count("*").alias("k"))
    linked = join_groups(placed.filter("component is not null"), names, ["component"], "k", total).select("digest", "copies", "c")
    alone = placed.filter("component is null and copies > 1").select("digest", "copies", F.col("name").alias("c"))
    named = scratch.keep(linked.unionByName(alone))
    plain = rows.select("doc_id", "n", "digest")
    met = join_groups(plain, named, ["digest"], "copies", total).select("doc_id", "n", "c")
    few = named.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    keys = named.select("digest")
    unmet = plain.filter("digest is not null").join(F.broadcast(keys) if few else keys, "digest", "left_anti").unionByName(plain.filter("digest is null").select("digest", "doc_id", "n"))
    out = met.unionByName(unmet.select("doc_id", "n", F.col("doc_id").alias("c")))
    # of rows without an id, those stay that no document with one stands for
    kept = F.when(F.col("doc_id").isNull(), F.col("c").isNull()).otherwise(F.col("doc_id") == F.col("c"))
    out = checkpoint(out.select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), kept.alias("kept")))
    scratch.close()
    return out


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents that stay: the one with the smallest id of each component, and all others linked
    with nothing. Rows without an id stay."""
    gone = near_duplicates(docs, percent).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct()
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def op10_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over the whole of documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
