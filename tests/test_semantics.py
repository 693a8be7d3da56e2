"""Micro-fixtures for the operators' traps."""

import hashlib
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparquill.functions import code as C
from sparquill.functions import predicates as P
from sparquill.functions import text as X
from sparquill.operators import diff, records, retrieval, setops, stats, verdicts
from sparquill.plans import registry
from sparquill.sources import files
from sparquill.streaming.resume import follow


def column(spark, expr, *rows):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id int, s string").orderBy("id").select(expr).collect()]


def test_chunks(spark):
    text = [" ".join(["w"] * n) for n in (0, 1, 448, 449, 512, 513, 897)]
    assert column(spark, F.size(X.chunk_words(F.col("s"))), *text) == [0, 1, 1, 2, 2, 2, 3]


def test_pass_at_k(spark):
    df = spark.createDataFrame([(20, 0), (20, 16), (20, 3)], "n int, c int")
    got = [r[0] for r in df.select(X.pass_at_k(F.col("n"), F.col("c"), 5)).collect()]
    assert got[:2] == [0.0, 1.0] and abs(got[2] - 0.600877) < 1e-6


def test_mcnemar_and_holm(spark):
    df = spark.createDataFrame([(0, 0), (5, 5), (1, 9)], "a long, b long")
    assert [round(r[0], 9) for r in df.select(verdicts.mcnemar_p(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 0.021484375]
    out = verdicts.holm(spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.03)], "ord int, p double")).orderBy("ord").collect()
    assert [round(r["p_holm"], 9) for r in out] == [0.04, 0.09, 0.09, 0.09]


def test_wide_drops_gaps_and_averages(spark):
    rows = [("t1", "A", 1), ("t1", "A", 0), ("t1", "B", 1), ("t2", "A", 1), ("t3", "A", 0), ("t3", "B", 0)]
    w = verdicts.wide(spark.createDataFrame(rows, "task_id string, condition string, passed int"), ["A", "B"])
    assert sorted(map(tuple, w.collect())) == [("t1", 0.5, 1.0), ("t3", 0.0, 0.0)]


def test_shares_sum_to_one(spark, sf_dir):
    from sparquill.plans.base import CONDITIONS, LABELS, verdicts as frame

    v = frame(spark, sf_dir)
    shares = verdicts.composition(v, CONDITIONS, LABELS)
    assert all(abs(r["s"] - 1) < 1e-9 for r in shares.groupBy("condition").agg(F.sum("share").alias("s")).collect())
    rates = {r["condition"]: r["m"] for r in v.groupBy("condition").agg(F.avg("passed").alias("m")).collect()}
    assert {r["condition"]: round(r["share"], 9) for r in shares.filter("label = 'Pass'").collect()} == {k: round(x, 9) for k, x in rates.items()}


def test_bca(spark):
    assert stats.bca(np.zeros(4), np.ones(4) * 3)[1:] == (0.0, 0.0)
    assert np.isnan(stats.bca(np.zeros(0), np.zeros(0))[0])
    point, low, high = stats.bca(np.array([1.0, 3, 2, 5, 0, 4]), np.ones(6) * 5)
    assert low < point < high


def test_version_key_and_asof(spark):
    rows = [("p", "1.9", "2020-01-01"), ("p", "1.10", "2020-02-01"), ("p", "2.0rc1", "2020-03-01"), ("p", "1.8.5", "2020-05-01")]
    r = spark.createDataFrame(rows, "package string, version string, day string").filter(~X.is_prerelease(F.col("version")))
    left = spark.createDataFrame([("p", "2020-06-01"), ("p", "2019-01-01")], "package string, cut string")
    out = {x["cut"]: x["version"] for x in setops.asof(left, r, "package", "cut", "day", "version", X.version_key(F.col("version"))).collect()}
    assert out == {"2020-06-01": "1.10", "2019-01-01": None}


def test_prefix_anti(spark):
    names = spark.createDataFrame([("a.b",), ("a.b.c",), ("a.bc",)], "name string")
    assert setops.prefix_anti(names, spark.createDataFrame([("a.b",)], "failed string")).collect() == [("a.bc",)]


def test_split_sizes(spark):
    rows = [("x", 1)] + [("y", i) for i in range(4)] + [("z", i) for i in range(5)]
    out = setops.group_split(spark.createDataFrame(rows, "lib string, k int"), "lib", F.col("k"), 0.8)
    assert {r["lib"]: r["n"] for r in out.groupBy("lib").agg(F.count_if(F.col("split") == "train").alias("n")).collect()} == {"x": 0, "y": 3, "z": 4}


def test_last_wins_keeps_the_first_place(spark):
    rows = [("a", 0, "x"), ("b", 1, "y"), ("a", 2, "z")]
    assert sorted(map(tuple, setops.last_wins(spark.createDataFrame(rows, "k string, ord int, v string"), "k", "ord", ["v"]).collect())) == [("a", 0, "z"), ("b", 1, "y")]


def test_signature_changed(spark):
    kind = "array<struct<name:string,default:string,kind:string>>"
    a, b = [("x", None, "k")], [("x", "1", "k")]
    rows = [(a, a), (a, b), ([("self", None, "k"), *a], a), ([], a), (a, [*a, ("y", None, "k")])]
    df = spark.createDataFrame(rows, f"o {kind}, n {kind}")
    assert [r[0] for r in df.select(X.signature_changed(F.col("o"), F.col("n"))).collect()] == [False, True, False, False, True]


def test_errors_and_bypass(spark):
    assert column(spark, X.exception_type(F.col("s")), "ValueError: a\nKeyError: b", "pkg.MyError: c", "", "My2Error: x") == ["KeyError", "", "", ""]
    assert column(spark, X.stderr_tail(F.col("s")), "a" * 5000 + "\nKeyError") == ["a" * 500]
    codes = ["x=1", "def run():\n  pass", "other(1, 2)", "run = 1; run"]
    assert column(spark, X.bypass_mode(F.col("s"), F.lit("p.run")), *codes) == ["empty", "same_name_reimpl", "reimplemented", "referenced_not_invoked"]


def test_citations(spark):
    text = "doi:10.1000/xyz. arXiv:2101.00001v2, https://doi.org/10.1000/xyz huggingface.co/papers/2101.00001v2 [Smith et al., 2019] 10.1000/bare arxiv.org/abs/1706.03762"
    got = column(spark, X.citations(F.col("s")), text, "none", None)
    assert [(x["kind"], x["value"]) for x in got[0]] == [("arxiv", "2101.00001v2"), ("arxiv", "1706.03762"), ("doi", "10.1000/xyz"), ("author_year", "Smith et al., 2019")]
    assert got[1] == got[2] == []


def test_predicates(spark):
    long = "y" * 60
    assert column(spark, P.is_thin(F.col("s")), "short", "See   other " + long, "TODO  " + long, "abstract\n base  class for " + long, None, f"x {long}\n\ntodo") == [True, False, True, True, True, False]
    assert column(spark, P.is_thin(F.col("s")), "Abstract base\n  class for " + long) == [True]
    assert column(spark, P.is_deprecated(F.col("s")), "will be removed in version 3", "Use x.y instead.", "undeprecated", "Deprecated.", "use\nx instead", None) == [True, True, False, True, False, False]
    assert column(spark, P.is_self_private(F.col("s")), " Internal use only", "internally", "PRIVATE: x", None) == [True, False, True, False]
    assert column(spark, P.is_foreign(F.col("s"), "pkg"), "a\\pkg\\m.py", "a/other.py", None) == [False, True, False]
    assert column(spark, P.is_foreign(F.col("s"), ""), "a/other.py") == [False]
    assert column(spark, P.has_no_source(F.col("s")), None, "a.SO", "a.py") == [True, True, False]
    assert column(spark, P.is_vendored(F.col("s")), "pandas.io.clipboard.f", "pandas.io.clipboards") == [True, False]
    paths = ["/e/site-packages/pkg/_lib/z.py", "/e/pkg/_lib/z.py", "/e/site-packages/pkg/_lib.py", "/e/site-packages/_utils/sub/z.py", None]
    assert column(spark, P.is_plumbing(F.col("s"), F.lit("pkg.sub.f")), *paths) == [True, False, False, False, False]
    assert column(spark, P.is_plumbing(F.col("s"), F.lit("pkg._x.f")), paths[0]) == [False]
    kinds = spark.createDataFrame([("method", 0, None, "a.f"), ("method", 0, " ", "a.f"), ("class", 1, "d", "a.Dict"), ("function", 0, "", "a.f"), ("function", 1, "", "a.Dict")], "kind string, n int, doc string, name string")
    assert [r[0] for r in kinds.select(P.is_type_alias(F.col("kind"), F.col("n"), F.col("doc"), F.col("name"))).collect()] == [True, False, True, True, False]


def test_task_and_example_rules(spark):
    difficulties = ["easy"]
    rows = [("hard", "d", "Foo()", ""), ("easy", " ", "Foo()", ""), ("easy", "use foo", "Foo()", ""), ("easy", "d", "bar()", ""), ("easy", "d", "bar()", "a.Foo"), ("easy", "d", "Foo()", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, level string, told string, solved string, masked string").orderBy("id")
    why = P.task_reject_reason(F.lit("a.Foo"), F.col("level"), F.col("told"), F.col("solved"), F.col("masked"), difficulties)
    assert [r[0] for r in df.select(why).collect()] == ["difficulty", "empty", "names_api", "unused_api", None, None]
    runs = spark.createDataFrame([(True, False, "", ""), (False, True, "", ""), (False, False, "no CUDA device", ""), (False, False, "", "odd"), (False, False, None, None)], "p boolean, t boolean, e string, o string")
    assert [r[0] for r in runs.select(P.example_status(F.col("p"), F.col("t"), F.col("e"), F.col("o"), ["CUDA"], ["odd"])).collect()] == ["executed", "static", "static", "static", "failed"]
    samples = spark.createDataFrame([([True, None],), ([False, None, None],), ([],)], "s array<boolean>")
    assert [tuple(r) for r in samples.select(*P.recheck(F.col("s"))).collect()] == [(True, 1), (False, 2), (False, 0)]
    classes = spark.createDataFrame([("class", "a.ModeEnum", "x", "(self, *args, **kwds)", 0, 0), ("class", "a.Other", "str(object)", "(self, /, *args, **kwargs)", 0, 0), ("class", "a.Other", "x", "(self, *args, **kwds)", 0, 0), (None, "a.ModeEnum", "x", "", 0, 0), ("class", "a.ModeEnum", "x", "(self, *args, **kwds)", 1, 0)], "k string, n string, d string, s string, p int, e int")
    assert [r[0] for r in classes.select(P.is_supported(*map(F.col, "kndspe"))).collect()] == [False, False, True, True, True]


def test_defaults_and_quality(spark):
    values = ["<x at 0x7f00aa11>", "/e/lib/python3.9/site-packages/p/d.txt", "/usr/bin/python3.11", "/scratch/job-12/x", "/var/tmp/abc", "plain 0x12", None]
    assert column(spark, X.normalize_default(F.col("s")), *values) == ["<x at 0xADDR>", "<ENVPATH>", "<ENVPATH>", "<ENVPATH>", "<ENVPATH>", "plain 0x12", None]
    rows = spark.createDataFrame([("abcd", [("self",), ("a",), ("b",)]), ("abcd", [("args",)]), (None, [("a",)])], "d string, p array<struct<name:string>>")
    assert [r[0] for r in rows.select(P.quality_score(F.col("d"), F.col("p"))).collect()] == [8.0, 4.0, 0.0]


def test_labels(spark):
    err = ["AssertionError: Solution did not call target API x", "x\nIndentationError: y", "NameError: name 'pkg' is not defined", "NameError: name 'foo' is not defined\nValueError: z", "KeyError: k"]
    label = lambda code, raw: X.label_of(F.col("s"), F.lit("pkg.foo"), F.lit(code), F.lit(raw))
    assert column(spark, label("foo()", "nonsense"), *err) == ["WrongAPISelection", "WrongSyntax", "WrongImport", "WrongAPISelection", "WrongLogic"]
    assert column(spark, label("x()", "nonsense"), err[4]) == ["WrongAPISelection"]
    for raw, code, stderr, want in [
        ('a {"class": "W_PARAM", "rationale": "r"} b', "foo()", "", "WrongParam"), ('{"class": "W_SHAPE_DTYPE"}', "foo()", "", "WrongShapeDtype"), ('{"class": "W_API", "rationale": "pass-only body"}', "foo()", "", "WrongSyntax"),
        ('{"class": "W_API"}', "foo()", "ImportError: x", "WrongImport"), ('{"class": "W_API"}', "x()", "ImportError: x", "WrongAPISelection"), ('{"class": "W_API", "rationale": "FOO missing"}', "x()", "ImportError: x", "WrongImport"),
        ('{"class": "W_API"}', "foo()", "AssertionError: x", "WrongAPISelection"), ('{"class": "W_API"}', "foo()", "TypeError: x", "WrongImport"), ('{"class": "W_API"}', "x()", "TypeError: x", "WrongAPISelection"),
    ]:
        assert column(spark, label(code, raw), stderr) == [want], raw
    late = X.label_of(F.col("s"), F.lit("pkg.foo"), F.lit("foo()"), F.lit("{}"), F.lit(True))
    assert column(spark, late, "SyntaxError: x") == ["WrongLogic"]


def test_grounding(spark):
    rows = [("see arXiv:2101.00001", "enum", "a.py", ""), ("x" * 51, "function", "a.py", ""), ("x" * 50, "function", "a.py", ""), ("x" * 600, "function", None, ""), ("x" * 200, "plain_class", "a.py", "a\n# b\n" * 10), ("x" * 199, "plain_class", "a.py", "a\n" * 20), ("x" * 600, "dataclass", "a.py", "a\n" * 20)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, d string, r string, p string, c string").orderBy("id")
    assert [r[0] for r in df.select(X.grounding(*map(F.col, "drpc"))).collect()] == ["paper", "source", "docstring", "docstring", "source", "docstring", "docstring"]
    assert column(spark, X.opens_with_stock_phrase(F.col("s")), "\n This Function does", "A function", "this module x", "the module x") == [True, False, True, False]


def test_layers_and_lines(spark):
    rows = [["basic_1", "edge_1", "changed_input_1", "basic_2"], ["basic_1", "basic_2"], ["edge_1", "x"], ["x"], []]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, n array<string>").orderBy("id")
    got = [tuple(r[0]) for r in df.select(X.pick_layers(F.col("n"))).collect()]
    assert got == [("basic_1", ["basic_1", "changed_input_1"], "edge_1"), ("basic_1", ["basic_1", "basic_2"], "basic_2"), ("edge_1", ["edge_1", "x"], "edge_1"), ("x", [], None), (None, [], None)]
    params = spark.createDataFrame([([("a", "int", "1", "d" * 200), ("b", None, None, "")],)], "p array<struct<name:string,type:string,default:string,description:string>>")
    assert params.select(X.parameter_lines(F.col("p")), X.signature_text(F.col("p"))).first()[:] == ("- a: int = 1 — " + "d" * 160 + "\n- b", "(a: int = 1, b)")
    assert column(spark, X.clean_annotation(F.col("s")), "<class 'a.b.C'>", "list[int]", "") == ["C", "list[int]", None]
    assert column(spark, X.return_type(F.col("s"), F.lit(None).cast("string"), F.lit("class"), F.lit("a.B")), "N/A", " int ") == ["a.B", "int"]
    assert column(spark, X.unwrap_solution(F.col("s")), "def solution():\n  x", "y\ndef solution():\n  x", "z") == ["  x", "\n  x", "z"]
    assert column(spark, X.mentions(F.col("s"), F.lit("a.longer")), "the longer one", "a.longer", "long") == [True, True, False]
    deep = spark.createDataFrame([("/x/lib/python3.9/site-packages/p.py", [("/y/lib/python3.12/site-packages/q", 1)])], "a string, b array<struct<p:string,n:int>>")
    assert X.portable(deep).first()[:] == ("<site-packages>/p.py", [("<site-packages>/q", 1)])


def test_intervals(spark):
    rng = np.random.default_rng(5)
    rows = [(t, f"api{t % 7}", c, int(rng.random() < p), t) for t in range(60) for c, p in (("A", 0.3), ("B", 0.6))]
    frame = spark.createDataFrame(rows, "task_id int, api_name string, condition string, passed int, ord int")
    out = {r["condition"]: r for r in stats.condition_intervals(frame, ["A", "B"], "A").collect()}
    value = {(t, c): p for t, _, c, p, _ in rows}
    sums = lambda f: (np.array([sum(f(t) for t in range(60) if t % 7 == k) for k in range(7)], float), np.array([sum(t % 7 == k for t in range(60)) for k in range(7)], float))
    for c in "AB":
        assert np.allclose([out[c]["pass1"], out[c]["pass1_lo"], out[c]["pass1_hi"]], 100 * np.array(stats.bca(*sums(lambda t: value[t, c]))))  # noqa: B023
    assert np.allclose([out["B"]["delta_pct"], out["B"]["delta_pct_lo"], out["B"]["delta_pct_hi"]], 100 * np.array(stats.bca(*sums(lambda t: value[t, "B"] - value[t, "A"]))))
    assert out["A"]["delta_pct"] is None
    pairs = frame.groupBy("task_id", "api_name", "ord").agg(F.max(F.when(F.col("condition") == "A", F.col("passed"))).alias("passed_a"), F.max(F.when(F.col("condition") == "B", F.col("passed"))).alias("passed_b")).withColumn("condition", F.lit("x"))
    arm = stats.arm_intervals(pairs).first()
    assert np.isclose(arm["change"], out["B"]["delta_pct"]) and np.isclose(arm["change_lo"], out["B"]["delta_pct_lo"]) and arm["p_holm"] == arm["p"]
    models = frame.withColumn("model", F.lit("m")).unionByName(frame.filter("task_id < 30").withColumn("model", F.lit("n")))
    assert {r["n_tasks"] for r in stats.cross_backbone(models, ["m", "n"], ["A", "B"], "A").collect()} == {30}


def test_novelty_raises_on_unknown_apis(spark):
    frame, known = spark.createDataFrame([("a",), ("b",)], "api_name string"), spark.createDataFrame([("a", True)], "api_name string, is_modified boolean")
    assert diff.novelty_of(frame.filter("api_name = 'a'"), known).first()["is_modified"]
    with pytest.raises(Exception, match="unknown API: b"):
        diff.novelty_of(frame, known).collect()


def test_mmr_and_cap(spark):
    rows = [("g", i, float(q), v) for i, (q, v) in enumerate([(3, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [0.0, 1.0])])]
    out = retrieval.mmr(spark.createDataFrame(rows, "g string, id int, quality double, emb array<double>"), "g", 2).orderBy("position").collect()
    assert [r["id"] for r in out] == [0, 1] or [r["id"] for r in out] == [0, 2]
    groups = [("a", i, 5, i) for i in range(4)] + [("b", i, 5, i) for i in range(6)]
    capped = retrieval.suffix_cap(spark.createDataFrame(groups, "g string, id int, q int, ord int"), "g", "q", "ord")
    assert {r["g"]: r["n"] for r in capped.groupBy("g").agg(F.count("*").alias("n")).collect()} == {"a": 4, "b": 3}


def test_mmr_query_takes_whole_groups(spark, sf_dir):
    groups = {}
    for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect():
        groups.setdefault(r["label"], []).append((r["vec_id"], float(r["vec_id"] % 7), [float(x) for x in r["embedding"]]))
    assert max(map(len, groups.values())) > 40
    want = {}
    for g, rows in groups.items():
        lo, hi = min(q for _, q, _ in rows), max(q for _, q, _ in rows)
        chosen = rows[:] if len(rows) <= 10 else []
        while len(rows) > 10 and len(chosen) < 10:
            like = lambda e: max((sum(x * y for x, y in zip(e, c, strict=True)) for _, _, c in chosen), default=0.0)  # noqa: E731, B023
            chosen.append(min((r for r in rows if r not in chosen), key=lambda r: (-(r[1] - lo) / (hi - lo) + like(r[2]), r[0])))  # noqa: B023
        want[g] = [i for i, _, _ in chosen]
    got = {}
    for r in registry.queries()["mmr_select"](spark, sf_dir).orderBy("position").collect():
        got.setdefault(r["grp"], []).append(r["id"])
    assert got == want


def test_fuzzy(spark):
    old = "x" * 10 + " the quick brown fox jumps over the lazy dog"
    rows = lambda *d: spark.createDataFrame([(i, f"m.f{i}", "function", x) for i, x in enumerate(d)], "ord int, name string, kind string, doc string")
    assert diff.fuzzy_matches(rows(old + "s"), rows(old)).collect() == [("m.f0", "m.f0")]
    assert diff.fuzzy_matches(rows("short"), rows("short")).collect() == []


def test_records():
    assert records.match(1.0, 1) and not records.match(1, 1.0) and not records.match(1, True)
    assert records.match({"a": 1.0}, {"a": 1.0 + 1e-7, "b": 2}) and not records.match([1], [1, 2])
    assert records.stable({"v": 1, "t": 2}, {"v": 1, "t": 3}) == {"v": 1} and records.stable({"t": 2}, {"t": 3}) == {}
    assert records.stable([1, 2], [1, 3]) == [1, {}] and records.stable([1], [1, 2]) is None and records.stable(1.0, 1) == 1.0


def test_expected_records_choose_what_to_compare():
    call = lambda kind, ret, **args: {"kind": kind, "ret": ret, "args": args}
    f = call("call", {"v": 1}, a=2)
    assert records.expected_of([[f, f], [f, f]]) == ([{"kind": "call", "ret": {"v": 1}}], "ok")
    assert records.expected_of([[call("call", {"type": "x"}, a=1, b=2)], [call("call", {"type": "x"}, a=1, b=3)]]) == ([{"kind": "call", "args": {"a": 1}}], "ok")
    assert records.expected_of([[call("init", {"v": 1}, a=1)]]) == ([{"kind": "init", "args": {"a": 1}}], "ok")
    assert records.expected_of([[call("subclass", {"v": 1})]]) == ([{"kind": "subclass"}], "ok")
    assert records.expected_of([[call("call", {}, a=1, b=2, __explicit__=["b"])]]) == ([{"kind": "call", "args": {"b": 2}}], "ok")
    assert records.expected_of([[call("call", {"v": 1}), call("call", {"v": 2})], [call("call", {"v": 2})]]) == ([{"kind": "call", "args": {}}, {"kind": "call", "ret": {"v": 2}}], "unstable")
    assert records.expected_of([[], [f]]) == ([], "no_calls")


def test_expected_records(spark):
    rows = [("a", 0, '[{"kind": "call", "ret": {"v": 1, "t": 5}}]'), ("a", 1, '[{"kind": "call", "ret": {"v": 1, "t": 6}}]'), ("b", 0, "[]")]
    out = {r["task_id"]: (json.loads(r["expected"]), r["status"]) for r in records.expected_records(spark.createDataFrame(rows, "task_id string, run int, calls string")).collect()}
    assert out == {"a": ([{"kind": "call", "ret": {"v": 1}}], "ok"), "b": ([], "no_calls")}


def test_code():
    assert C.extract_code("```python\nx = 1\n```") == "x = 1"
    assert C.extract_code("<think>a</think>```\ndef solution():\n    return 1\n```") == "    return 1"
    assert C.extract_code("Here it is:\nx = f(1)") == "" and C.extract_code("x = f(1)") == "x = f(1)"
    assert C.extract_code("```python\nbroken(\n```\n```\nlonger = 1\n```\n```bash\nls\n```") == "longer = 1"
    assert C.extract_code("```python\nx = 1\ny = 2") == "x = 1\ny = 2" and C.extract_code("```\nreasoning prose here\n```python\nz = 3\n```") == "z = 3"
    assert C.extract_code("a = 1\n```python\nlonger = 22") == "longer = 22" and C.extract_code("prose only.\n# Complete the following code (x):\nq = 1") == "q = 1"
    assert C.unseed("np.random.seed(3)") == "np.random.seed(None)"
    assert C.parameters("(a, b=2, *, c=None)") == ["a", "b=2", "c=None"] and C.described_parameters("(a: 'T' = 1)") == [("a", "1", "T")]
    assert C.first_call("m.f(1, k=2)", "f") == "m.f(1, k=2)"
    assert C.api_call("g(1)\nm.f(1, k=2, **z)", "x.f") == ("f", {"k": "2"}) and C.api_call("g(k=1)", "x.f") == ("g", {}) and C.api_call("x", "x.f") == (None, {})
    assert C.refers_to("from a import f", "b.f") and not C.refers_to("g.h", "b.f") and C.first_unresolved("import os, zz.y", {"os"}) == "zz.y"
    assert C.reference_call("m.f(1)", "x.f") == "m.f(1)" and C.reference_call("x =", "x.f") == "<unparseable>" and C.reference_call("y", "x.f") == "f(...)"
    assert C.documented_return_type("Returns\n-------\nout : ndarray\n    x") == "ndarray" and C.documented_return_type(":rtype: int") == "int" and C.documented_return_type("x") == ""
    assert C.percent_interval(0.0025, 0.5, 1) == "0.2 [50.0, 100.0]"


def test_sources(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# head\nb\n\na  \n")
    assert [r["id"] for r in files.read_ids(spark, str(tmp_path / "ids.txt")).orderBy("ord").collect()] == ["b", "a"]
    (tmp_path / "x.csv").write_text("k,v\nnone,\nNA,1.5\n")
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "x.csv"), "k string, v double").collect())) == [("NA", 1.5), ("none", None)]
    files.write_jsonl(spark.createDataFrame([(1, "a")], "i int, s string"), str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "i int, s string").collect() == [(1, "a")]
    assert files.layered({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_pool_and_row_order(spark, tmp_path):
    names = spark.createDataFrame([("b.x", "l1", "/v/lib/python3.9/site-packages/x.py"), ("a.y", "l2", None)], "name string, library string, path string")
    member = spark.createDataFrame([("b.x", "m1", "new"), ("a.y", "m2", "modified"), ("b.x", "m2", "new")], "name string, family string, kind string")
    manifest = files.freeze_pool(names, member, ["m1", "m2"], str(tmp_path / "pool"))
    assert manifest["per_library"] == {"l1": 1, "l2": 1} and manifest["n_candidates"] == 2 and manifest["sha256"]
    wide = files.read_csv(spark, str(tmp_path / "pool/membership"), "name string, library string, m1 string, m2 string")
    assert list(map(tuple, files.with_order(wide).orderBy("ord").drop("ord").collect())) == [("a.y", "l2", "", "modified"), ("b.x", "l1", "new", "new")]
    assert files.first_present(spark, str(tmp_path / "no"), str(tmp_path / "pool")) == str(tmp_path / "pool")
    spark.range(0, 1000, 1, 7).write.parquet(str(tmp_path / "r"))
    got = files.with_order(spark.read.parquet(str(tmp_path / "r"))).collect()
    assert sorted(r["ord"] for r in got) == list(range(1000))
    rows = [("t", "a", "l", "d", "e", True, "", None, 1.0), ("u", "a", "l", "d", "e", False, "", "x call check y", None), ("v", "a", "l", "d", "e", None, "WrongLogic", None, None)]
    out = files.verdict_rows(spark.createDataFrame(rows, "task_id string, api_name string, library string, domain string, difficulty string, passed boolean, label string, error string, pass_at_5 double"), "call check").orderBy("task_id").collect()
    assert [(r["passed"], r["label"], r["call_check_failed"]) for r in out] == [(1, "Pass", 0), (0, "Unlabelled", 1), (0, "WrongLogic", 0)]


def test_order_gates_and_overrides(spark, tmp_path):
    wanted = spark.createDataFrame([("b", 0), ("a", 1)], "k string, ord int")
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    assert [r["v"] for r in setops.keyed_in_order(wanted, rows, "k").collect()] == [2.0, 1.0]
    with pytest.raises(Exception, match="no row for a"):
        setops.keyed_in_order(wanted, rows.filter("k = 'b'"), "k").collect()
    scored = spark.createDataFrame([("a", 5, "x"), ("a", 6, "y")], "k string, ord int, v string")
    kept, unscored = setops.scored_in_order(wanted, scored, "k")
    assert [(r["k"], r["v"], r["ord"]) for r in kept.collect()] == [("a", "y", 1)] and unscored.first()[0] == 1
    with pytest.raises(Exception, match="repeated key"):
        setops.strict_wide(spark.createDataFrame([("a", "x", 1), ("a", "x", 2)], "k string, c string, v int"), "k", "c", ["x"], "v").collect()
    places = [("p.api.f", "p.api", "p.core.impl"), ("p.f", "p", "p.core.impl"), ("p.core.f", "p.core", "p.core.impl"), ("p._x.f", "p._x", "p._x.y"), ("q.f", "", "q"), ("q.f", "q", None)]
    found = spark.createDataFrame([(*x, "s", "f.py") for x in places], "name string, scanned string, owner string, signature string, path string")
    assert sorted((r["name"], r["scanned"]) for r in diff.best_paths(found).collect()) == [("p._x.f", "p._x"), ("p.core.f", "p.core"), ("q.f", ""), ("q.f", "q")]
    (tmp_path / "map.json").write_text('{"entries": {}, "health": {"walk_failures": ["a.b", "c <walk aborted>"]}}')
    assert files.read_health(spark, str(tmp_path / "map.json")).collect() == [("a.b",)]
    many = spark.range(5000).withColumn("g", F.lit("x"))
    got = setops.distractors(many, "g", "id", 3).collect()
    assert len(got) == len(set(map(tuple, got))) == 15_000 and all(t != o for t, o in got)
    assert [r["m"] for r in setops.concat_in_order({"n": many.limit(1), "m": many.limit(1)}, "m").orderBy("m_ord").collect()] == ["n", "m"]
    asked = spark.createDataFrame([("k", "r", 0.7, False, 1), ("k", "s", 0.0, False, 2), ("l", "t", 1.0, True, 3), ("m", "", 0.0, True, 4)], "key string, response string, temperature double, search boolean, created_at int")
    assert sorted(r["response"] for r in files.put_cache(asked.limit(0), asked).collect()) == ["s", "t"]
    assert files.overrides(["a.b=1", "a.c=[2]", "d=x"]) == {"a": {"b": 1, "c": [2]}, "d": "x"}
    assert files.read_optional(spark, str(tmp_path / "none.jsonl"), "a int").collect() == []


def test_stream_appends_each_key_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    args = (spark, str(src), "task_id string, n int", str(tmp_path / "out"), str(tmp_path / "cp"), "task_id")
    (src / "a.json").write_text('{"task_id": "a", "n": 1}\n{"task_id": "b", "n": 2}\n')
    follow(*args).awaitTermination()
    (src / "b.json").write_text('{"task_id": "b", "n": 3}\n{"task_id": "c", "n": 4}\n')
    follow(*args).awaitTermination()
    assert sorted(r["task_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_reconcile(spark):
    kind = "array<struct<name:string,type:string,default:string,description:string>>"
    listed, told = [("a", None, "1", None), ("b", "int", None, None)], [("a", "str", "2", "x"), ("a", "float", "3", "y")]
    df = spark.createDataFrame([(listed, told), ([], told)], f"l {kind}, d {kind}")
    first, second = (r[0] for r in df.select(X.reconcile(F.col("l"), F.col("d"))).collect())
    assert [tuple(p) for p in first] == [("a", "float", "1", "y"), ("b", "int", None, None)]
    assert [tuple(p) for p in second] == told


def test_names_and_markers(spark):
    ends = ["", "s", "ed", "ing", "er"]
    assert column(spark, X.leaf_variants(F.col("s")), "pkg.myFunc_two") == [sorted({"myfunctwo", *["myFunc_two" + e for e in ends], *["myfunc two" + e for e in ends]})]
    assert column(spark, X.scenario_result(F.col("s")), "x\n  RESULT_DESC:{\"a\": 1}\nRESULT_DESC:2", "none") == ['{"a": 1}', None]
    assert column(spark, X.strip_thinking(F.col("s")), "<think>a</think> b ", "c</think>d</think>e") == ["b", "d</think>e"]
    assert column(spark, X.first_fence(F.col("s")), "x ```python\na\n``` y", "  b\n", "``````") == ["a", "b", ""]
    assert column(spark, X.parent(F.col("s")), "a.b.c", "a") == ["a.b", ""]
    assert column(spark, X.is_prerelease(F.col("s")), "2.0RC1", "1.2.3", "1.0.post1", "1.0+cu") == [True, False, True, False]
    assert column(spark, X.undefined_name(F.col("s")), "name 'x' is not defined", "NameError: name 'x' is not defined") == [None, "x"]


def test_gates(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "task_id int")
    assert sorted(r[0] for r in setops.instance(ids(1, 2, 3, 4), ids(1, 2, 2, 4), ids(2, 3, 4), ids(4)).collect()) == [2]
    records_ = spark.createDataFrame([(1, "ok"), (2, "unstable"), (3, "ok"), (4, "odd")], "task_id int, status string")
    checks = spark.createDataFrame([(1, False, 0), (3, False, 3), (2, False, 0)], "task_id int, passed boolean, n_llm_errors int")
    assert sorted(map(tuple, setops.derive_exclusions(records_, {"unstable": "unstable_record"}, checks, 3).collect())) == [(1, "c3"), (2, "unstable_record"), (4, "other")]


def test_relocations(spark):
    kind = "ord int, name string, kind string, doc string, params array<struct<name:string,default:string,kind:string>>"
    p = lambda *n: [(x, None, "k") for x in n]
    lost = spark.createDataFrame([(1, "a.f", "function", "d" * 50, p("x")), (2, "a.g", "function", "", p("x", "y")), (3, "a.h", "function", "e" * 50, p("x"))], kind)
    found = spark.createDataFrame([(1, "b.f", "function", "d" * 50, p("x")), (2, "b.g", "function", "new", p("x", "y")), (3, "b.h", "function", "e" * 50, p("z")), (4, "b.k", "function", "", p())], kind)
    assert {r["name"]: (r["old_name"], r["how"]) for r in diff.relocations(lost, found).collect()} == {"b.f": ("a.f", "exact"), "b.g": ("a.g", "shape"), "b.h": ("a.h", "loose"), "b.k": (None, None)}


def test_distractors_follow_in_one_ring_of_the_whole_group(spark):
    groups = {"large": list(range(4999)) + [None], "one": [7], "two": [8, 9], "four": [1, 2, 3, 4]}
    df = spark.createDataFrame([(g, k) for g, keys in groups.items() for k in keys], "g string, k long").repartition(3)
    want = []
    for keys in groups.values():
        ring = sorted(keys, key=lambda k: (k is None, hashlib.md5(f"7:{k}".encode()).hexdigest()))
        want += [(k, ring[(i + step) % len(ring)]) for i, k in enumerate(ring) for step in range(1, min(3, len(ring) - 1) + 1)]
    assert sorted(map(repr, map(tuple, setops.distractors(df, "g", "k", 3).collect()))) == sorted(map(repr, want))


def test_thin_docs_are_told_from_their_heads_and_in_linear_time(spark):
    gap, long = " \n " * 200, "long enough to be no short text, whatever its opening may be"
    texts = [f"{a}{b}{c}" for a in ("", gap, "\u2003\t") for b in ("TODO", "abstract base class for", f"Abstract{gap}base\tclass{gap}for", "Abstract\n\nbase class for", "abstract base class", "x", "") for c in ("", gap, f" {long}", f"{gap}{long}", f"\n\n{long}", gap + "y" * 39)]
    texts += ["a" + " " * 37 + "b", "a" + " " * 38 + "b", "a" + " " * 300 + "b"]

    def thin(text):
        d = text.strip()
        return len(d) < 40 or " ".join(d.split("\n\n")[0].split()).lower().startswith(tuple(P.THIN_OPENINGS))

    assert column(spark, P.is_thin(F.col("s")), *texts) == list(map(thin, texts))
    began = time.monotonic()
    assert column(spark, P.is_thin(F.col("s")), *["x" + " " * 100_000 + long] * 2) == [False, False]
    assert time.monotonic() - began < 30


def test_retrieval_over_blocks_copies_rows_once(spark, monkeypatch):
    n, rng = 3000, np.random.default_rng(5)
    vectors, labels = rng.integers(-2, 3, (n, 3)), [None if i % 50 == 0 else "rare" if i == 7 else f"l{i % 40}" for i in range(n)]
    df = spark.createDataFrame([(i, label, [float(x) for x in v], 0) for i, (label, v) in enumerate(zip(labels, vectors))], "id long, label string, emb array<float>, g int")
    sides = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "chunk_id"), ["g"]
    dealt, plain = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda met, *args: dealt.append(met.count()) or plain(met, *args))
    scores = (vectors @ vectors.T).astype(float)
    np.fill_diagonal(scores, -np.inf)
    rankings = np.argsort(-scores, axis=1, kind="stable")[:, :-1]
    top = retrieval.search(*sides, 5, apart=True)
    assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in top.collect()) == [(q, r + 1, int(c)) for q in range(n) for r, c in enumerate(rankings[q, :5])]
    want = {q: next((r + 1 for r, c in enumerate(rankings[q]) if labels[c] == labels[q] is not None), None) for q in range(n)}
    hits = retrieval.first_hit(*sides, apart=True)
    assert {r["query_id"]: r["target_rank"] for r in hits.collect()} == want
    assert dealt[0] == 2 * n and sum(dealt) < 6 * n
