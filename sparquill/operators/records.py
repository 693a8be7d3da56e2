"""Matching and folding of recorded calls, given as JSON texts."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import INFORMATIVE

def match(expected, actual) -> bool:
    """Whether ``actual`` holds all of ``expected``; floats within 1e-6 relative or 1e-9 absolute,
    where the expected side is one; a bool is no number."""
    if isinstance(expected, bool) or isinstance(actual, bool):
        return expected is actual
    if isinstance(expected, dict):
        return isinstance(actual, dict) and all(k in actual and match(v, actual[k]) for k, v in expected.items())
    if isinstance(expected, list):
        return isinstance(actual, list) and len(expected) == len(actual) and all(map(match, expected, actual))
    if isinstance(expected, float):
        return isinstance(actual, int | float) and (math.isclose(expected, actual, rel_tol=1e-6, abs_tol=1e-9) or (expected != expected and actual != actual))
    return type(expected) is type(actual) and expected == actual


def stable(a, b):
    """What two fingerprints agree on; None where nothing is shared. Of dicts the keys that agree, of
    lists of one length each place, {} where it differs."""
    if isinstance(a, dict) and isinstance(b, dict):
        agreed = {k: stable(x, b[k]) for k, x in a.items() if k in b}
        return {k: x for k, x in agreed.items() if x is not None}
    if isinstance(a, list) and isinstance(b, list):
        return None if len(a) != len(b) else [{} if x is None else x for x in map(stable, a, b)]
    if isinstance(a, float) and isinstance(b, int | float) and not isinstance(b, bool):
        return a if math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) else None
    return a if a == b else None


def expected_of(runs: list[list[dict]]) -> tuple[list[dict], str]:
    """Calls of several runs folded to what is stable, and a status: ok where all runs have as many
    calls, unstable where calls were paired by kind, no_calls where the first run has none. A call
    keeps its return where that is informative (never that of a constructor), else its arguments;
    of a subclass only the kind counts. Repeated records count once."""
    first, rest = runs[0], runs[1:]
    if not first:
        return [], "no_calls"
    status = "ok" if all(len(r) == len(first) for r in rest) else "unstable"
    out = {}
    for place, call in enumerate(first):
        kind, now = call.get("kind"), call
        for other in rest:
            if status == "ok":
                now = stable(now, other[place]) or {}
            else:  # of one kind, what agrees most
                now = max((stable(now, c) or {} for c in other if c.get("kind") == kind), key=lambda c: len(json.dumps(c)), default={})
        args, explicit = now.get("args", {}), call.get("args", {}).get("__explicit__")
        if explicit is not None:
            args = {k: v for k, v in args.items() if k in explicit}
        given = now.get("ret", {})
        if kind == "subclass":
            record = {"kind": kind}
        elif kind != "init" and isinstance(given, dict) and not set(INFORMATIVE).isdisjoint(given):
            record = {"kind": kind, "ret": given}
        else:
            record = {"kind": kind, "args": args}
        out.setdefault(json.dumps(record, sort_keys=True), record)
    return list(out.values()), status


def add_all_matched(df: DataFrame, expected: str = "expected", calls: str = "calls", out: str = "matched") -> DataFrame:
    """df with ``out``: whether each expected record (JSON array) has a call (JSON array) that holds
    it; one call may serve several."""

    @F.arrow_udf("boolean")
    def run(e: pa.Array, c: pa.Array) -> pa.Array:
        rows = ((json.loads(x.as_py() or "[]"), json.loads(y.as_py() or "[]")) for x, y in zip(e, c))
        return pa.array([all(any(match(r, call) for call in calls) for r in want) for want, calls in rows], pa.bool_())

    return df.withColumn(out, run(expected, calls))


def expected_records(runs: DataFrame, key: str = "task_id", order: str = "run", calls: str = "calls") -> DataFrame:
    """(key, expected, status): expected_of a task's runs, as JSON."""
    kind = dict(runs.dtypes)[key]

    def fold(k, pdf):
        found, status = expected_of([json.loads(x or "[]") for x in pdf.sort_values(order)[calls]])
        return pd.DataFrame([[k[0], json.dumps(found, sort_keys=True), status]], columns=[key, "expected", "status"])

    return runs.groupBy(key).applyInPandas(fold, f"`{key}` {kind}, expected string, status string")


def code_map(df: DataFrame, column: str, out: str, kind: str, fn) -> DataFrame:
    """df with ``out``: fn of each text, in Arrow batches."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([fn(x.as_py() or "") for x in batch], target)

    target = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[kind]
    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(out, F.arrow_udf(run, kind)(F.col(column)))
