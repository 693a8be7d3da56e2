"""Toxicity by multiple-instance learning (operator 9).

A document is a bag of sentences. A sentence's logit is a bias plus the weights of its words'
features (the lower-cased word and its prefixes of 4, 5 and 6 letters, so that inflected forms
are caught), its probability the logistic of that, and 0 if no feature has a weight; a document's
probability is the noisy-or of its sentences and, once, of a base rate, so that length alone adds
nothing. Only documents carry labels; the weights are fitted to them through the noisy-or, and the
fitted sentence scores then locate the offending sentences.

The model is fitted on the driver, on at most MAX_TRAIN labelled documents (a documented bound:
those whose id hashes lowest; ones of more than MAX_CHARS characters aren't learned from, but are
scored like all others), whatever the size of the corpus, and holds at most MAX_FEATURES weights. Scoring is a map over whole texts without a shuffle.

Cases: null and empty texts have no evidence, so they get the base rate alone; labels that are
null or of unknown documents are left out; several labels of one document count as toxic if any
is; with no toxic or no clean label every score is the share of toxic ones (0 without labels);
repeated rows are scored alike; other columns are kept, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, no_cycles, small_batches, table, text_of

#: Most labelled documents that a model is fitted on, and most characters of each; most weights it has.
MAX_TRAIN = 5000
MAX_CHARS = 50_000
MAX_FEATURES = 2048
PREFIXES = (4, 5, 6)
#: Documents of the sample that a feature must occur in.
MIN_DOCS = 5
ROUNDS = 200
#: Weights below this are dropped between the two descents and at the end.
WEAK = 0.5
MEMO_WORDS = 200_000

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


def features(word: str) -> set[str]:
    """Features of a lower-cased word: itself, and its prefixes marked by a hyphen."""
    return {word} | {word[:k] + "-" for k in PREFIXES if len(word) >= k}


@dataclass
class Model:
    """Weights by feature, the bias of a sentence with any, and the logit of a document without."""

    bias: float = -20.0
    weights: dict[str, float] = field(default_factory=dict)
    base: float = -20.0

    def word(self, word: str) -> float:
        """A word's weight."""
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))

    def sentences(self, text: str, word=None) -> list[tuple[int, int, float]]:
        """Start, end and probability of each sentence that has a word."""
        out, word = [], word or self.word
        for m in SENTENCE.finditer(text):
            words = set(WORD.findall(m.group().lower()))
            if words:
                z = sum(map(word, words))
                out.append((m.start(), m.end(), _logistic(self.bias + z) if z else 0.0))
        return out

    def document(self, text: str, memo: Memo) -> float:
        """Noisy-or of the base rate and the sentences' probabilities."""
        words = set(WORD.findall(text.lower()))
        new = {w: self.word(w) for w in words if w not in memo}
        weight = {w: x for w in words if (x := new[w] if w in new else memo[w])}
        for w, x in new.items():
            memo.keep(w, x)
        clean = math.log1p(-min(_logistic(self.base), 1 - 1e-12))
        if weight:
            clean += sum(math.log1p(-min(p, 1 - 1e-12)) for _, _, p in self.sentences(text, lambda w: weight.get(w, 0.0)))
        return -math.expm1(clean)


def _logistic(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def train(texts: list[str], toxic: list[int]) -> Model:
    """Fit a model to labelled texts."""
    y = np.array(toxic, bool)
    if not len(y) or y.all() or not y.any():
        share = min(float(y.mean()) if len(y) else 0.0, 1 - 1e-9)
        return Model(base=math.log(share / (1 - share)) if share else -50.0)
    # features that mark toxic documents, by the z-score of their log odds ratio
    seen = (Counter(), Counter())
    for text, label in zip(texts, toxic, strict=True):
        seen[int(label)].update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
    n1, n0 = int(y.sum()), int((~y).sum())
    scored = []
    for f, a in seen[1].items():
        c = seen[0][f]
        if a + c >= MIN_DOCS:
            odds = math.log((a + 0.5) / (n1 - a + 0.5)) - math.log((c + 0.5) / (n0 - c + 0.5))
            z = odds / math.sqrt(1 / (a + 0.5) + 1 / (n1 - a + 0.5) + 1 / (c + 0.5) + 1 / (n0 - c + 0.5))
            if z > 3:
                scored.append((-z, f, odds))
    scored.sort()
    weights = {f: max(0.0, odds) / 4 for _, f, odds in scored[:MAX_FEATURES]}
    bias = base = -6.0
    for _ in range(2):  # the second time without the features that the first found weak
        bags = _bags(texts, weights)
        bias, base, weights = _descend(bags, y, weights, bias, base)
        weights = {f: w for f, w in weights.items() if w > WEAK}
    return Model(bias, weights, base)


def _bags(texts: list[str], weights: dict[str, float]):
    """Sentences with a feature: their documents, and (sentence, feature) pairs."""
    index = {f: k for k, f in enumerate(weights)}
    known: dict[str, list[int]] = {}
    doc_of, rows, cols = [], [], []
    for d, text in enumerate(texts):
        for m in SENTENCE.findall(text):
            hits: set[int] = set()
            for w in set(WORD.findall(m.lower())):
                if (got := known.get(w)) is None:
                    got = known[w] = [index[f] for f in features(w) if f in index]
                hits.update(got)
            if hits:
                rows += [len(doc_of)] * len(hits)
                cols += sorted(hits)
                doc_of.append(d)
    return np.array(doc_of, int), np.array(rows, int), np.array(cols, int)


def _descend(bags, y: np.ndarray, weights: dict[str, float], bias: float, base: float) -> tuple[float, float, dict[str, float]]:
    """Minimise the noisy-or's log loss by Adam."""
    doc_of, rows, cols = bags
    w, b, c = np.array(list(weights.values())), bias, base
    moment, square, n = np.zeros(len(w) + 2), np.zeros(len(w) + 2), len(y)
    for t in range(1, ROUNDS + 1):
        z = b + np.bincount(rows, w[cols], len(doc_of))
        s = np.logaddexp(0, c) + np.bincount(doc_of, np.logaddexp(0, z), n)
        ds = np.where(y, -1 / np.expm1(np.clip(s, 1e-9, 500)), 1.0) / n
        dz = ds[doc_of] / (1 + np.exp(-z))
        grad = np.r_[np.bincount(cols, dz[rows], len(w)), dz.sum(), ds.sum() / (1 + np.exp(-c))]
        moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        step = 0.1 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
        w, b, c = w - step[:-2], max(-12.0, b - step[-2]), max(-12.0, c - step[-1])
    return float(b), float(c), dict(zip(weights, w.tolist(), strict=True))


def fit(docs: DataFrame, labels: DataFrame, keep=None, max_train: int = MAX_TRAIN) -> Model:
    """Fit on labelled documents. keep: a column of labels that says which of them may be learned from."""
    known = labels.filter("doc_id is not null and toxic is not null")
    if keep is not None:
        known = known.filter(keep)
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("__y"))
    known = known.orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(max_train)
    # one row a document; at most max_train rows go to the driver
    found = docs.select(F.col("doc_id").alias("__id"), text_of("text").alias("__text")).filter(F.length("__text") <= MAX_CHARS).join(F.broadcast(known), "__id")
    rows = sorted(found.groupBy("__id").agg(F.max("__text").alias("t"), F.first("__y").alias("y")).collect())
    return train([r["t"] for r in rows], [int(r["y"] > 0) for r in rows])


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with column ``out``: the probability that column ``text`` is toxic."""
    memo = Memo(MEMO_WORDS)
    small_batches(df.sparkSession)

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        with no_cycles():
            return pa.array((model.document(x.as_py() or "", memo) for x in texts), pa.float64())

    return df.withColumn(out, toxicity(F.col(text)))


def locate(df: DataFrame, model: Model, text: str = "text", out: str = "offending", least: float = 0.5) -> DataFrame:
    """df with column ``out``: spans (code points, end exclusive) and scores of the offending sentences."""

    @F.arrow_udf("array<struct<start:int,end:int,score:double>>")
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        rows = ([{"start": a, "end": b, "score": p} for a, b, p in model.sentences(x.as_py() or "") if p >= least] for x in texts)
        return pa.array(list(rows), kind)

    return df.withColumn(out, spans(F.col(text)))


def remainder(doc_id):
    """Column: crc32 of an id's text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over the whole of documents; learns from labels with a remainder other than 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id")) != 0)
    return score(docs, model).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
