"""Differences between two catalogues: added, modified and moved entries."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import leaf, path_rank, signature_changed, strip


def canonical(entries: DataFrame, key: str = "identity") -> DataFrame:
    """One entry an identity: fewest dots, then the name."""
    dots = F.struct(F.regexp_count("name", F.lit(r"\.")), "name")
    return entries.groupBy(key).agg(F.min_by(F.struct(*[c for c in entries.columns if c != key]), dots).alias("e")).select(key, "e.*")


def added(old: DataFrame, new: DataFrame, key: str = "identity") -> DataFrame:
    """Entries of new whose identity old lacks."""
    return canonical(new, key).join(old.select(key).distinct(), key, "left_anti")


def modified(old: DataFrame, new: DataFrame, key: str = "identity") -> DataFrame:
    """Entries in both whose signature changed; with the old parameters."""
    o = canonical(old, key).select(key, F.col("params").alias("old_params"))
    return canonical(new, key).join(o, key).filter(signature_changed(F.col("old_params"), F.col("params")))


def best_paths(found: DataFrame) -> DataFrame:
    """One row an object, at its best place. Rows are (name, scanned, owner, signature, path, ...); they are
    one object where owner, leaf, signature and path agree."""
    same = [F.coalesce("owner", F.lit("")), leaf(F.col("name")), F.coalesce("signature", F.lit("")), F.coalesce("path", F.lit(""))]
    keyed = [k.alias(f"__k{i}") for i, k in enumerate(same)]
    best = F.min_by(F.struct(*found.columns), path_rank(F.col("name"), F.col("scanned"), F.col("owner"))).alias("x")
    return found.groupBy(*keyed).agg(best).select("x.*")


def with_identity(entries: DataFrame) -> DataFrame:
    """Entries (name, kind, params, path) with ``identity``: leaf, kind, and the source file's name or,
    without a source, the parameters' shape."""
    shape = F.transform("params", lambda p: F.struct(p["name"].alias("n"), p["kind"].alias("k")))
    sourced = F.coalesce("path", F.lit("")) != ""
    parts = F.struct(leaf(F.col("name")).alias("leaf"), F.col("kind").alias("kind"), F.when(sourced, F.substring_index("path", "/", -1)).alias("file"), F.when(~sourced, shape).alias("shape"))
    return entries.withColumn("identity", F.to_json(parts))


def _doc():
    return F.left(strip(F.coalesce("doc", F.lit(""))), F.lit(400))


def _first(df: DataFrame, keys: list) -> DataFrame:
    named = df.select("ord", "name", "params", *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    cols = [f"k{i}" for i in range(len(keys))]
    w = Window.partitionBy(*cols).orderBy("ord")
    return named.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").select(*cols, F.struct("name", "params").alias("old"))


def relocations(lost: DataFrame, found: DataFrame, fuzzy: bool = False) -> DataFrame:
    """For each new entry, the old one it moved from: exact (leaf, kind, parameter shape, text), then
    loose (leaf, kind, text of 40 characters and more), then shape (leaf, kind, two parameters and
    more), else, if asked, by likeness of texts. Texts are stripped and cut to 400 characters. The
    first rule that finds an entry wins; each rule sees an old entry's first row. Columns: name,
    old_name, old_params, how."""
    shape = lambda: F.transform("params", lambda p: F.struct(p["name"].alias("n"), p["kind"].alias("k")))
    rules = [
        ("exact", F.lit(True), [leaf(F.col("name")), F.col("kind"), shape(), _doc()]),
        ("loose", F.length(_doc()) >= 40, [leaf(F.col("name")), F.col("kind"), _doc()]),
        ("shape", F.size("params") >= 2, [leaf(F.col("name")), F.col("kind"), shape()]),
    ]
    out = found.select("name", "kind", "params", "doc")
    hits = []
    for how, guard, keys in rules:
        index = _first(lost.filter(guard), keys).withColumnRenamed("old", f"__{how}")
        cols = [f"k{i}" for i in range(len(keys))]
        out = out.select("*", *[F.when(guard, k).alias(c) for c, k in zip(cols, keys)]).join(index, cols, "left").drop(*cols)
        hits.append((how, F.col(f"__{how}")))
    out = out.select("name", "kind", "doc", F.coalesce(*[h for _, h in hits]).alias("old"), F.coalesce(*[F.when(h.isNotNull(), how) for how, h in hits]).alias("how"))
    shown = ["name", F.col("old")["name"].alias("old_name"), F.col("old")["params"].alias("old_params"), "how"]
    if not fuzzy:
        return out.select(*shown)
    left = out.filter("old is null")
    near = fuzzy_matches(left, lost).join(lost.select(F.col("name").alias("old_name"), F.col("params").alias("old_params")).dropDuplicates(["old_name"]), "old_name")
    moved = left.select("name").join(near, "name", "left").select("name", "old_name", "old_params", F.when(F.col("old_name").isNotNull(), "fuzzy").alias("how"))
    return out.filter("old is not null").select(*shown).unionByName(moved)


def fuzzy_matches(new: DataFrame, old: DataFrame, least: float = 0.92) -> DataFrame:
    """(name, old_name): most alike text within (leaf, kind), by the ratio of matching blocks; texts
    of 40 characters and more, cut to 400. Meant for the residue of the exact rules. Only texts whose
    lengths allow the ratio meet: lengths are put into bands, each joined with its neighbours."""

    @F.arrow_udf("double")
    def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
        from difflib import SequenceMatcher

        def of(x, y):
            m = SequenceMatcher(None, x, y)
            return m.ratio() if m.quick_ratio() >= least else 0.0

        return pa.array([of(x.as_py(), y.as_py()) for x, y in zip(a, b)], pa.float64())

    def key(df, n, d):
        return df.filter(F.length(_doc()) >= 40).select(F.col("name").alias(n), leaf(F.col("name")).alias("leaf"), "kind", _doc().alias(d), *([] if n == "name" else ["ord"]))

    band = lambda d: F.floor(F.ln(F.length(d)) / F.lit(math.log((2 - least) / least))).cast("int")
    left = key(new, "name", "d").withColumn("band", F.explode(F.sequence(band("d") - 1, band("d") + 1)))
    pairs = left.join(key(old, "old_name", "o").withColumn("band", band("o")), ["leaf", "kind", "band"])
    pairs = pairs.filter(2 * F.least(F.length("d"), F.length("o")) >= least * (F.length("d") + F.length("o"))).withColumn("r", ratio("d", "o")).filter(F.col("r") >= least)
    return pairs.groupBy("name").agg(F.max_by("old_name", F.struct("r", -F.col("ord"))).alias("old_name"))


def diff_catalogues(old: DataFrame, new: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(name, is_modified, old_name, how): what is new or has another signature. Catalogues are (ord,
    name, kind, params, doc, path). Entries of an identity that both have are compared; another new
    identity is compared with the old entry of its exact name and kind (how ``drift``), else with
    the one it moved from, where an exact move is no change; else it is added."""
    o, n = with_identity(old), with_identity(new)
    before = canonical(o).select("identity", F.col("name").alias("old_name"), F.col("params").alias("old_params"))
    after = canonical(n)
    same = after.join(before, "identity").filter(signature_changed(F.col("old_params"), F.col("params"))).select("name", F.lit(True).alias("is_modified"), "old_name", F.lit("same").alias("how"))
    fresh = after.join(o.select("identity").distinct(), "identity", "left_anti")
    by_name = old.select("name", "kind", F.col("params").alias("old_params"))
    prior = fresh.join(by_name, ["name", "kind"])
    drift = prior.filter(signature_changed(F.col("old_params"), F.col("params"))).select("name", F.lit(True).alias("is_modified"), F.col("name").alias("old_name"), F.lit("drift").alias("how"))
    rest = fresh.join(prior.select("name"), "name", "left_anti")
    moved = rest.select("name", "params").join(relocations(old, rest, fuzzy), "name")
    resigned = moved.filter((F.col("how") != "exact") & signature_changed(F.col("old_params"), F.col("params"))).select("name", F.lit(True).alias("is_modified"), "old_name", "how")
    gained = moved.filter("how is null").select("name", F.lit(False).alias("is_modified"), F.lit(None).cast("string").alias("old_name"), F.lit("added").alias("how"))
    return same.unionByName(drift).unionByName(resigned).unionByName(gained)


def novelty_of(frame: DataFrame, entries: DataFrame, api: str = "api_name") -> DataFrame:
    """frame with ``is_modified`` of its API; an API that entries (api, is_modified) lack raises."""
    known = frame.join(entries.select(api, "is_modified"), api, "left")
    missing = F.raise_error(F.concat(F.lit("unknown API: "), F.col(api))).cast("boolean")
    return known.withColumn("is_modified", F.coalesce("is_modified", missing))


def boilerplate(entries: DataFrame, least: int = 3) -> DataFrame:
    """First 400 characters of texts that ``least`` entries and more share."""
    head = F.left(F.regexp_replace(F.coalesce("doc", F.lit("")), r"(?U)^\s+|\s+$", ""), F.lit(400))
    return entries.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & (F.col("head") != ""))
