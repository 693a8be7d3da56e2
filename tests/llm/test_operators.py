"""The corpus operators against libraries, brute force and small edge cases."""

import base64
import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparquill.llm import bpe, license_texts, licenses, mixing, neardup, pii, quality, registry, tokencount, topk, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long, `__w` int, spans int"
LONG = " ".join(random.Random(3).choice(["ab", "cd", "ef", "gh", "ij"]) for _ in range(30_000))


def docs(spark, *texts, ids=None, source="s"):
    """Documents with columns whose names clash with common internal ones."""
    rows = [(i, t, "en", source, len(t or ""), 1, 2) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, KIND)


def samples(sf_dir, n=200):
    return [r[0] or "" for r in duckdb.sql(f"select text from '{sf_dir}/documents.parquet' order by doc_id limit {n}").fetchall()]


def odd_texts():
    rng = random.Random(1)
    kinds = ["abcdefgh", "thequickbrown", "aaaab", "  \n\tab", "é漢字ñ ß", "0123456789", "<>=-_*#/!.", "▁ a", "\x1c\x85　a b"]
    return ["".join(rng.choice(k) for _ in range(rng.randint(0, 60))) for k in kinds for _ in range(300)] + ["", "<s> </s> <|endoftext|>", "a" * 5000, "xyz" * 2000, "a\0b"]


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(name, spark, sf_dir, duck):
    df = registry.queries()[name](spark, sf_dir)
    columns = ", ".join(sorted(df.columns))
    want = sorted(map(repr, duck.execute(f"select {columns} from ({registry.oracle_sql()[name]})").fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect()) == want


# 1
def test_bpe_is_the_library(sf_dir):
    import tiktoken

    with open(bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.codec(bpe.default_ranks(), bpe.default_pattern())
    for text in samples(sf_dir) + odd_texts():
        ids = mine.encode(text)
        assert ids == np.array(library.encode_ordinary(text), "<u4").tobytes(), text[:60]
        assert mine.decode(ids) == text.encode()


def test_bpe_query(spark):
    out = {r["doc_id"]: r for r in bpe.round_trip(docs(spark, "hello world", None, "", "hello world", LONG)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert out[1]["n_tokens"] == out[2]["n_tokens"] == 0 and out[1]["ids_sha256"] == out[2]["decoded_sha256"] == empty
    assert out[0]["ids_sha256"] == out[3]["ids_sha256"] and out[0]["decoded_sha256"] == hashlib.sha256(b"hello world").hexdigest()
    assert out[4]["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    assert bpe.round_trip(docs(spark).limit(0)).collect() == []
    kept = bpe.decode(bpe.encode(docs(spark, "a b"))).withColumn("ids", bpe.ids_array()).first()
    assert kept["decoded"] == b"a b" and len(kept["ids"]) == 2 and kept["__w"] == 1


def test_bpe_encodes_once(spark):
    plan = bpe.round_trip(docs(spark, "a b"))._jdf.queryExecution().executedPlan().toString()
    calls = re.search(r"ArrowEvalPython \[(.*?)\], \[", plan)[1]
    assert calls.count("text#") == 1, calls
    texts, asked = ["a b", "a b", None, "", "a b", "c", "c"], []
    got = list(bpe.copies_once(bpe.pa.array(texts), lambda x: asked.append(x) or x.upper()))
    assert got == [(x or "").upper() for x in texts] and asked[1:] == ["a b", "", "a b", "c"]
    frame = docs(spark, *texts, LONG, LONG)
    want = bpe.decode(bpe.encode(frame)).orderBy("doc_id").collect()
    assert bpe.recode(frame).orderBy("doc_id").collect() == want and len(want) == 9


# 2
def brute_quality(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, sf_dir):
    texts = [*samples(sf_dir, 60), "a b c a b c a b c", "x\ny\nx\n\n  \nx", "", "é😀 & é😀", "one"]
    frame = docs(spark, *texts, None)
    out = {r["doc_id"]: r for r in quality.judge(frame, [0.0] * quality.BUCKETS).collect()}
    for i, text in enumerate([*texts, ""]):
        want = brute_quality(text)
        assert tuple(out[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert out[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and out[i]["kept"] != out[i]["base_failed"]


def test_quality_ratio_by_brute_force(spark):
    good, bad = " ".join(["alpha beta"] * 3 + [f"w{i}" for i in range(60)]), " ".join(f"junk{i} ###" for i in range(60))
    frame = docs(spark, good, good + " end", bad, None)
    ratios = quality.log_ratios(frame, frame.filter("doc_id < 2").select("doc_id"))
    out = {r["doc_id"]: r for r in quality.judge(frame, ratios).collect()}
    assert out[0]["kept"] and not out[2]["kept"] and out[0]["llr"] > 0 > out[2]["llr"] and not out[3]["kept"]
    grams = {r["doc_id"]: r["g"] for r in frame.select("doc_id", quality._grams(quality.words_of(F.col("text"))).alias("g")).collect()}
    raw, trusted = collections.Counter(g for i in grams for g in grams[i]), collections.Counter(g for i in (0, 1) for g in grams[i])
    b, n, m = quality.BUCKETS, sum(raw.values()), sum(trusted.values())
    ratio = lambda g: np.log((trusted[g] + 1) / (m + b)) - np.log((raw[g] + 1) / (n + b))
    assert abs(out[2]["llr"] - np.mean([ratio(g) for g in grams[2]])) < 1e-5
    assert set(quality.log_ratios(frame, frame.limit(0).select("doc_id"))) == {0.0}


# 3
def test_token_counts_are_the_library(sf_dir):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokencount.default_model())
    texts = samples(sf_dir) + odd_texts()
    assert tokencount.counter(tokencount.default_model()).count(texts) == [len(x) for x in library.encode(texts, num_threads=1)]


def test_token_report(spark):
    out = {r["doc_id"]: tuple(r)[1:] for r in tokencount.token_report(docs(spark, None, "", "é", LONG)).collect()}
    assert out[0] == out[1] == (0, 0, False) and out[2][0] == 2 and out[3][2] is True
    assert tokencount.token_report(docs(spark).limit(0)).collect() == []


# 4
def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 5), "en", "hot" if i % 3 else f"s{i % 4}", 1, 1, 2) for i in range(400)] + [(900, None, None, None, None, 1, 2), (901, "", "en", "hot", 0, 1, 2)]
    frame = spark.createDataFrame(rows, KIND)
    sized = mixing.sizes(frame)
    plan = {r["source"]: r for r in mixing.plan(sized).collect()}
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    got = {r["source"] or "": r["n"] for r in mixing.sizes(mixed).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    total = sum(len((r[1] or "").split()) for r in rows)
    for source, r in plan.items():
        if r["weight"]:
            assert 0 <= round(r["weight"] * total) - got[source] < 5  # short by less than one document
    assert mixing.mix(frame.limit(0)).collect() == []
    assert mixing.exponent(spark.createDataFrame([(0.25,)] * 4, "p double")) == 1.0
    shares = [0.9, 0.06, 0.04]
    a = mixing.exponent(spark.createDataFrame([(x,) for x in shares], "p double"), 0.9, 100.0)
    h = lambda a: -sum((w := x**a / sum(y**a for y in shares)) * np.log(w) for x in shares)
    assert h(a) >= 0.9 * np.log(3) > h(a + 1e-6)


# 5
def test_warc(spark, tmp_path):
    html = "<p>é" + "x" * 300
    rows = [(1, "http://a/1", html), (2, "http://a/2\n", html), (3, None, None), (4, "u", ""), (5, "http://b", "other"), (None, "n", html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    manifest = warc.write(pages, one, file_bytes=400, shard_bytes=600)
    warc.write(pages.repartition(3), two, file_bytes=400, shard_bytes=600)
    names = sorted(r["file"] for r in manifest.collect())
    assert len(names) > 1 and all((tmp_path / "one" / n).read_bytes() == (tmp_path / "two" / n).read_bytes() for n in names)
    out = {r["page_id"]: r for r in warc.read(spark, one).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in out.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 2)}
    assert out[2]["payload"] == html.encode() and out[1]["payload"] is None and out[1]["payload_bytes"] == len(html.encode())
    assert out[1]["payload_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    (tmp_path / "one" / names[0]).write_bytes((tmp_path / "two" / names[-1]).read_bytes())
    with pytest.raises(Exception):  # noqa: B017
        warc.read(spark, one).select(F.sum("payload_bytes")).collect()
    warc.write(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").collect() == []
    assert warc.write(pages, f"file://{tmp_path}/least", least=10**6).agg(F.sum("records")).first()[0] == 6
    assert {r["record_type"] for r in warc.read(spark, f"file://{tmp_path}/least").collect()} == {"response"}


def test_warc_shards(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh <>/") for _ in range(n))
    # a third of the rows share an id, a third have none, and one id lies far off
    rows = [(i, f"u{i}", text(400)) for i in range(40)] + [(7, f"v{i}", text(400)) for i in range(40)] + [(None, f"w{i}", text(400)) for i in range(40)] + [(1 << 60, "far", text(90_000)), (-(1 << 62), "low", "x")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    ratio = warc.SHARD_BYTES // warc.FILE_BYTES
    assert ratio >= 8
    folder = f"file://{tmp_path}/shards"
    manifest = warc.write(pages, folder, file_bytes=600, shard_bytes=600 * ratio).collect()
    shards = collections.Counter(m["file"].split("-")[1] for m in manifest)
    assert sum(m["records"] for m in manifest) == len(rows) and len(shards) > 5 and max(shards.values()) > 1  # files roll within shards
    assert max(collections.Counter(m["file"].split("-")[1] for m in manifest for _ in range(m["records"])).values()) < 30
    got = warc.read(spark, folder).collect()
    assert sorted((r["page_id"] or 0, r["url"], r["payload"].decode()) for r in got) == sorted((i or 0, u, h) for i, u, h in rows)
    ways, bounds = warc.shard_bounds(pages.select("page_id", F.length("html").alias("size")), 600 * ratio)
    assert ways > 1 and bounds == sorted(bounds) and [b for b in bounds if b[0] == 7][0][2] > 1


# 6
def test_topk_groups_and_cases(spark, monkeypatch):
    rng = np.random.default_rng(1)
    for name, n in (("QUERY_ROWS", 4), ("SHARD_ROWS", 16), ("BLOCKS", 2)):  # many groups of queries and of shards
        monkeypatch.setattr(topk, name, n)
    vectors = [(i, rng.integers(-2, 3, 6 if i % 3 else 4).astype(float).tolist()) for i in range(400)] + [(50, [1.0] * 6), (50, [1.0] * 6), (401, [1e30] * 6), (402, [2.0**19 + 0.5] * 6)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<double>, rank int")
    got = sorted(map(tuple, topk.search(frame, frame.filter("vec_id % 50 = 0"), 5).collect()))
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in vectors if abs(v[0]) < 1e20]
    rows = collections.defaultdict(list)
    for q, v in good:
        if q % 50 == 0:
            rows[q].append(v)
    want = []
    for q, own in rows.items():  # rows of one id are one query's: the best of all
        best = sorted(((int(v @ c), i) for v in own for i, c in good if i != q and len(c) == len(v)), key=lambda x: (-x[0], x[1]))[:5]
        want += [(q, r + 1, i, score) for r, (score, i) in enumerate(best)]
    assert got == sorted(want)


def test_topk(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, rng.normal(size=8).astype("f4").tolist()) for i in range(300)] + [(300, None), (301, [float("nan")] * 8), (302, [1.0] * 7 + [None]), (303, []), (None, [1.0] * 8)]
    vectors += [(400 + i, vectors[0][1]) for i in range(8)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.search(frame, frame.filter("vec_id % 50 = 0"), 5).collect()))
    good = {i: np.floor(256 * np.array(v, "f4").astype(float)).astype(int) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all()}
    want = [(q, r + 1, c, s) for q in good if q % 50 == 0 for r, (s, c) in enumerate(sorted(((int(good[q] @ good[c]), c) for c in good if c != q), key=lambda x: (-x[0], x[1]))[:5])]
    assert got == sorted(want)
    assert topk.search(frame.limit(0), frame.limit(0), 5).collect() == []


# 7
KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def good(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text) if good(kind, m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_pii_base_spans(spark, sf_dir):
    odd = ["a@b.com_x@d.e 1.2.3.4.5.6.7.8 +1 23 45 67 89 +(1 4111 1111 1111 1111 é😀 x@y.z.w", None, "", "1.2.3.4" * 3 + " 999.1.1.1 0001.002.3.255 a@b +1-----2 12345678901234567890", "1" * 50_000 + "@" + ".a" * 50_000]
    frame = docs(spark, *samples(sf_dir), *odd)
    name = lambda s: F.concat(F.get(F.lit(list(pii.KINDS)), s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])
    got = {r["doc_id"]: r["x"] for r in pii.base_spans(frame, pii.text_of("text"), "b").select("doc_id", F.array_join(F.transform("b", name), ",").alias("x")).collect()}
    for i, text in enumerate([*samples(sf_dir), *odd[:4]]):
        assert got[i] == brute_spans(text or ""), (text or "")[:80]
    assert pii.redact(frame.limit(0)).collect() == []


def test_pii_many_spans_and_overlaps(spark):
    many = " ".join(f"u{i}@example.com, 10.0.{i % 256}.1;" for i in range(4000)) + " é😀"
    both = "x 4111 1111 1111 1111 y +4111 1111 1111 z a@1.2.3.4 w"
    frame = docs(spark, many, both, None, "", ids=[1, None, 2, 2])
    rows = {r["__w"] + (r["doc_id"] or 0): r["text"] for r in pii.redact(frame).collect() if r["text"]}
    assert sorted(rows.values(), key=len)[0] == "x [CARD] y [PHONE] z [EMAIL] w"
    assert sorted(rows.values(), key=len)[1] == " ".join(["[EMAIL], [IP];"] * 4000) + " é😀"


def test_pii_terms_reveal(spark):
    lead = ["near", "with", "upon", "from"]
    texts = [f"{w} quorvex wrote to jo.doe@example.com about {w} matters the {w}" for w in lead] + ["the plain text with the words near and upon"] * 5 + ["Quorvex alone here", None]
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, *texts)).collect()}
    assert all("uorvex" not in out[i] and "[EMAIL]" in out[i] for i in range(4)) and out[9] == " alone here"
    assert out[4] == texts[4] and out[10] is None
    copies = docs(spark, *[texts[0]] * 6)  # copies are one observation
    assert all("quorvex" in r["text"] for r in pii.redact(copies).collect())


def test_pii_terms_reveal_rare_entities(spark):
    plain = ["please write about the matter today"] * 9
    once, twice = "Zebulon please write about z.m@example.com today", "the matter of Okonkwo today {} at 10.1.2.3 please"
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, *plain, once, twice.format("about"), twice.format("write"), "Zebulon", "matter")).collect()}
    assert out[9] == "Zebulon please write about [EMAIL] today" and out[12] == "Zebulon"  # one of two documents
    assert out[10] == "the matter of  today about at [IP] please" and out[13] == "matter"
    lone = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, *plain, once)).collect()}
    assert lone[9] == "Z* please write about [EMAIL] today" and lone[0] == plain[0]


# 8
def test_licenses(spark):
    mine = "You may sublicense, use and share this work, so long as this notice stays."
    texts = ["Copyright (c) 2020 Someone\n\n  YOU MAY sub-licence , use and share this work -- so long as this notice stays", "prose\nLicenced under the Apache License, version 2.0\nmore", None, "", mine + " extra", "(c) me"]
    known = licenses.known_digests(spark, [("Mine", mine), ("Other", mine.upper())])
    out = {r["doc_id"]: r for r in licenses.scan(docs(spark, *texts), known, licenses.known_digests(spark, licenses.NOTICES)).collect()}
    assert [out[i]["license"] for i in range(6)] == ["Mine", None, None, None, None, None]
    assert out[1]["notices"] == "Apache-2.0" and out[2]["canonical_sha256"] == out[5]["canonical_sha256"] == hashlib.sha256(b"").hexdigest()


def test_every_shipped_license_is_found(spark):
    texts = license_texts.short_texts() + license_texts.long_texts()
    noisy = [(i, "Copyright 2024 Some One\n" + t.replace(" ", "  ").upper()) for i, t in texts]
    found = licenses.scan(docs(spark, *[t for _, t in texts + noisy]), licenses.shipped_digests(spark), licenses.known_digests(spark, license_texts.single_notices()))
    got = {r["doc_id"]: r["license"] for r in found.collect()}
    assert [got[k] for k in range(len(got))] == [i for i, _ in texts + noisy]
    assert {i for i, _ in texts} >= {"MIT", "ISC", "Zlib", "Unlicense"} and all(len(d) == 64 for x in license_texts.LONG_DIGESTS.values() for d in x)


def test_license_cases(spark):
    known, line = licenses.shipped_digests(spark), licenses.known_digests(spark, license_texts.single_notices())
    assert licenses.scan(docs(spark).limit(0), known, line).collect() == []
    mit = license_texts.short_texts()[0][1]
    out = licenses.scan(docs(spark, mit, mit, LONG, "SPDX-License-Identifier: MIT", "License: ISC", ids=[1, 1, None, 4, 4]), known, line).collect()
    assert sorted((r["doc_id"] or 0, r["license"] or "", r["notices"]) for r in out) == [(0, "", ""), (1, "MIT", ""), (1, "MIT", ""), (4, "", "ISC,MIT"), (4, "", "ISC,MIT")]


# 9
def test_toxicity_does_not_grow_with_length():
    plain = [f"a plain sentence with word{i}. and another one." for i in range(90)]
    bad = [f"a plain sentence. such zorkish talk {i}." for i in range(10)]
    # some labels are wrong
    model = toxicity.train([*plain, *bad], [int(i % 12 == 0) for i in range(90)] + [1] * 10)
    memo = toxicity.Memo(1000)
    clean = "one more plain sentence. " * 20_000
    assert model.document(clean, memo) == model.document("one more plain sentence.", memo) == model.document("", memo) < 0.5
    assert model.document(clean + "such zorkish talk.", memo) >= 0.5 and [p >= 0.5 for _, _, p in model.sentences("plain. zorkish talk.")] == [False, True]


def test_toxicity_finds_held_out_documents(spark, sf_dir):
    d = dict(duckdb.sql("select doc_id, text from '/root/testdata/sf0.1/documents.parquet'").fetchall())
    labels = duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.1/labels.parquet' order by 1").fetchall()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    model = toxicity.train([d[i] for i, _ in labels if not held(i)], [y for i, y in labels if not held(i)])
    memo = toxicity.Memo(1000)
    wrong = [i for i, y in labels if held(i) and (model.document(d[i], memo) >= 0.5) != (y == 1)]
    assert len(wrong) <= 0.025 * sum(held(i) for i, _ in labels)  # some labels of this table are wrong themselves
    toxic = next(i for i, y in labels if held(i) and y)
    frame = toxicity.locate(toxicity.score(docs(spark, d[toxic], None, ""), model), model).collect()
    assert frame[0]["score"] >= 0.5 and frame[0]["offending"] and frame[1]["score"] == frame[2]["score"] < 0.5 and frame[1]["offending"] == []
    assert toxicity.train([], []).document("x", memo) < 1e-6


# 10
def brute_components(texts, percent=85):
    def shingles(t):
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [(i, len(sets[i]), root(i), root(i) == i) for i in range(len(texts))]


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") + str(rng.randint(0, 500)) for _ in range(300)]

    def edited(n):
        w = list(base)
        for _ in range(n):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        return " ".join(w)

    texts = [edited(n) for n in [0] * 3 + [1, 2, 3, 4, 5, 6, 8, 10, 14] * 5] + [None, "", " \n", "a b c", "A B C", "a b c d", LONG, LONG + " x", LONG.upper()]
    got = lambda: sorted(map(tuple, neardup.near_duplicates(docs(spark, *texts)).collect()))
    want = brute_components(texts)
    assert got() == want
    monkeypatch.setattr(neardup, "LEAF", 8)  # regions are split by longer prefixes, and cut into parts
    monkeypatch.setattr(neardup, "FIRST", 1)
    monkeypatch.setattr(neardup, "WHOLE", 16)  # and compared in blocks
    monkeypatch.setattr(neardup, "PARTNERS", 2)
    assert got() == want
    kept = sorted(r["doc_id"] for r in neardup.drop_near_duplicates(docs(spark, *texts)).collect())
    assert kept == [i for i, _, _, k in want if k]
    assert neardup.near_duplicates(docs(spark).limit(0)).collect() == []


def test_near_duplicates_of_repeated_and_null_ids(spark):
    rng = random.Random(6)
    a, b, c, d = (" ".join(f"{x}{rng.randint(0, 10**6)}" for _ in range(200)) for x in "abcd")
    frame = docs(spark, a, b, a + " x", b + " y", b, c, c, d, d + " z", "", ids=[5, 5, 7, 9, 9, None, 11, None, None, 5])
    out = [(r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame).collect()]
    # both texts of 5 link it; the text of 11 stands for the row without an id, nothing stands for those of d
    by_id = collections.defaultdict(set)
    for i, n, k, kept in out:
        by_id[i].add((n > 0, k, kept))
    assert by_id == {-1: {(True, None, True), (True, 11, False)}, 5: {(True, 5, True), (False, 5, True)}, 7: {(True, 5, False)}, 9: {(True, 5, False)}, 11: {(True, 11, True)}}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)]
    up = {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert dict(map(tuple, neardup.components(spark.createDataFrame(edges, "a long, b long")).collect())) == want


def brute_redact(texts):
    """Personal data masked as the operator's docstring has it, one text after another."""
    import regex

    kinds = list(KINDS)
    words = lambda t: {w for w in regex.split(r"[^\p{L}]+", t.lower()) if len(w) >= pii.LETTERS}
    base = []
    for t in texts:
        spans = [x.split(":") for x in brute_spans(t or "").split(",") if x]
        base.append([(int(a), kinds.index(k), int(b)) for k, a, b in spans])
    rows, mentioned, joint = collections.Counter(t for t, spans in zip(texts, base) if spans), collections.defaultdict(set), collections.defaultdict(set)
    for t, spans in zip(texts, base):
        for a, _, b in spans:
            begin = max(a - pii.CONTEXT, 0)
            left, right = t[begin:a], t[b : b + pii.CONTEXT]
            left = regex.sub(r"^\p{L}+", "", left) if begin else left
            right = regex.sub(r"\p{L}+$", "", right) if len(right) == pii.CONTEXT else right
            mentioned[t[a:b].lower()].add(t)
            for w in words(f"{left} | {right}"):
                joint[t[a:b].lower(), w].add(t)
    holds = collections.Counter(w for t in texts for w in words(t or ""))
    told = {}
    for (entity, w), found in joint.items():
        many = sum(rows[t] for t in mentioned[entity])
        prior = len(mentioned[entity]) / (len(texts) - many + len(mentioned[entity]))
        p = (len(found) + pii.SMOOTHING * prior) / (holds[w] - sum(rows[t] for t in found) + len(found) + pii.SMOOTHING)
        if p > prior:
            told[w] = max(told.get(w, 0), p)
    action = {w: -np.log2(p) for w, p in told.items() if -np.log2(p) <= pii.GENERALISE_BITS}
    out = []
    for t, spans in zip(texts, base):
        every = [(a, k, b, f"[{kinds[k].upper()}]") for a, k, b in spans]
        for remove in (True, False):
            here = sorted(w for w in words(t or "") if w in action and (action[w] <= pii.REMOVE_BITS) == remove)
            if here:
                every += [(m.start(), 4, m.end(), "" if remove else m.group()[0] + "*") for m in regex.finditer(r"(?i)(?<!\p{L})(?:" + "|".join(here) + r")(?!\p{L})", t)]
        done, pieces = 0, []
        for a, _, b, mask in sorted(every):
            pieces += [t[done:a] if a > done else "", mask if a >= done else ""]
            done = max(done, b)
        out.append(t if not every else "".join(pieces) + t[done:])
    return out


def test_pipeline(spark, sf_dir, tmp_path):
    import tiktoken

    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "byte_bpe"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    docs_now, rows = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    columns = docs_now.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs_now.orderBy("doc_id").collect()]
        stage(spark, docs_now, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs_now = spark.read.parquet(f"{tmp_path}/{name}")
        rows = sorted(map(tuple, docs_now.collect()))
        if name == "toxicity":
            known = [r for r in before if labels.get(r[0]) is not None and not held(r[0])]
            model = toxicity.train([r[1] or "" for r in known], [labels[r[0]] for r in known])
            want = [r for r in before if model.document(r[1] or "", toxicity.Memo(10)) < 0.5]
        elif name == "near_duplicates":
            want = [before[i] for i, _, _, k in brute_components([r[1] for r in before], 80) if k]
        elif name == "personal_data":
            texts = brute_redact([r[1] for r in before])
            want = [(r[0], t, r[2], r[3], None if t is None else len(t)) for r, t in zip(before, texts)]
            assert any(t != r[1] for r, t in zip(before, texts))
        elif name == "mixing":
            con = duckdb.connect()
            con.execute(f"create view documents as select * from '{tmp_path}/personal_data/*.parquet'")
            copies = dict(con.execute(f"select doc_id, copies from ({mixing.OP4_SQL})").fetchall())
            want = [r for r in before for _ in range(copies[r[0]])]
        else:
            with open(bpe.default_ranks(), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            ids = [np.array(library.encode_ordinary(r[1] or ""), "<u4") for r in before]
            want = [(r[0], len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r, x in zip(before, ids)]
        assert rows == sorted(want), name
        assert name == "byte_bpe" or docs_now.columns == columns
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == rows


def test_pipeline_of_odd_documents(spark, sf_dir):
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(100_000))
    frame = docs(spark, None, "", "a", "a", long, "mail x@y.org", ids=[1, 2, 3, 3, 4, None]).withColumn("__gone", F.lit(1)).withColumn("__toxicity", F.lit(1))
    for rows in (frame, frame.limit(0)):
        got = rows
        for name, stage in corpus_pipeline.STAGES:
            if rows is not frame and name == "near_duplicates":
                continue  # an empty table has its own test
            got = stage(spark, got, sf_dir)
            assert name == "byte_bpe" or got.columns == corpus_pipeline.COLUMNS
        found = got.collect()
        assert len(found) == (6 if rows is frame else 0) or rows is frame and {r["doc_id"] for r in found} >= {1, 2, 4, None}
