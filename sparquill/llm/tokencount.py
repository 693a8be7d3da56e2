"""Token counts by rank-synchronous array merging (operator 3).

Counts what a sentencepiece BPE model makes of a text, without building the tokens. The text is
cut into pre-tokens wherever no piece of the vocabulary can span the cut; the pre-tokens that a
batch of rows brings anew are held side by side in one ragged array of symbol ids. Each round
finds every pre-token's lowest-rank pair and merges it in all pre-tokens at once; when no pair
is left, the surviving symbols are counted (a symbol outside the vocabulary counts as its UTF-8
bytes). Where a merge could give rise to a pair of lower rank than its own, only the leftmost
occurrence in a pre-token is merged in that round, so the order is that of the model's own queue.

The model file's normaliser must be the identity (checked); begin and end pieces aren't added and
the strings of control pieces are ordinary text, as in the library.

Cases: null and empty texts have no tokens and no bytes; repeated rows are counted alike; the
frame's other columns are kept, whatever their names; a pre-token of any length is merged in
memory proportional to it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, table

SPACE = "▁"
#: Most pre-tokens a worker remembers, and the length beyond which one isn't remembered.
MEMO_WORDS = 700_000
MEMO_CHARS = 48
#: Symbols merged together in one ragged array.
BATCH_SYMBOLS = 1 << 18


def default_model() -> str:
    """Path of the model that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCounter:
    """Counter for one model file; one per worker process."""

    def __init__(self, path: str):
        import regex
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only models with the identity normaliser and a dummy prefix are supported")
        kind = pb.ModelProto.SentencePiece
        normal = {p.piece: p.score for p in spec.pieces if p.type in (kind.NORMAL, kind.USER_DEFINED)}
        if any(p.type == kind.USER_DEFINED for p in spec.pieces):
            raise ValueError("models with user-defined pieces aren't supported")
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece spans a word's end")
        order = sorted(normal, key=lambda p: -normal[p])
        #: Symbols: every piece, then any other character met as one symbol for each UTF-8 length.
        self.id = {p: k for k, p in enumerate(order)}
        self.n = len(order)
        self.other = {k: self.n + k for k in (1, 2, 3, 4)}
        scores = [normal[p] for p in order]
        ranks = np.zeros(self.n, np.int64)  # equal scores share a rank
        for k in range(1, self.n):
            ranks[k] = ranks[k - 1] + (scores[k] != scores[k - 1])
        keys, made = [], []
        risky = np.zeros(self.n + 5, bool)
        for p, k in self.id.items():
            for cut in range(1, len(p)):
                a, b = self.id.get(p[:cut]), self.id.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * (self.n + 5) + b)
                    made.append(k)
                    for part in (a, b):
                        if ranks[k] <= ranks[part]:
                            risky[part] = True
        by = np.argsort(keys)
        self.keys, self.made = np.array(keys, np.int64)[by], np.array(made, np.int64)[by]
        self.rank = ranks
        self.risky = risky
        self.split = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.words = Memo(MEMO_WORDS)
        self.weight = np.ones(self.n + 5, np.int64)
        for k, s in self.other.items():
            self.weight[s] = k

    def symbols(self, word: str) -> list[int]:
        """A pre-token's characters as symbols."""
        get, other = self.id.get, self.other
        return [s if (s := get(c)) is not None else other[len(c.encode())] for c in word]

    def merged(self, rows: list[list[int]]) -> list[int]:
        """Tokens left of each row of symbols after all merges."""
        width = self.n + 5
        none = np.iinfo(np.int64).max
        counts = np.zeros(len(rows), np.int64)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        sym = np.fromiter((s for r in rows for s in r), np.int64, len(row))
        while len(sym):
            # the rank of each adjacent pair of a row, and the piece it makes
            made = np.full(len(sym), -1)
            if len(sym) > 1 and len(self.keys):
                key = sym[:-1] * width + sym[1:]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                made[:-1] = np.where((self.keys[at] == key) & (row[:-1] == row[1:]), self.made[at], -1)
            rank = np.where(made >= 0, self.rank[made], none)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(sym)])
            least = np.repeat(least, sizes)
            # rows without a pair are finished: count and drop them
            done = least == none
            if done.any():
                np.add.at(counts, row[done], self.weight[sym[done]])
                keep = ~done
                sym, row, made, rank, least = sym[keep], row[keep], made[keep], rank[keep], least[keep]
                if not len(sym):
                    break
            hit = rank == least
            at = np.flatnonzero(hit)
            # of overlapping occurrences the 1st, 3rd, ... of each run of neighbours count
            run = np.r_[0, np.cumsum(np.diff(at) != 1)]
            start = np.r_[0, np.flatnonzero(np.diff(run)) + 1]
            within = np.arange(len(at)) - start[run]
            at = at[within % 2 == 0]
            # a row whose merge may open a lower rank, or mixes pieces of one rank: leftmost only
            head = np.r_[True, row[at][1:] != row[at][:-1]]
            lead = np.flatnonzero(head)[np.cumsum(head) - 1]
            alone = self.risky[made[at]] | (made[at] != made[at[lead]])
            bad = np.zeros(int(row[-1]) + 1, bool)
            bad[row[at][alone]] = True
            at = at[head | ~bad[row[at]]]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, row = sym[keep], row[keep]
        return counts.tolist()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        words, split = self.words, self.split
        cut = [split(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        missing: set[str] = set()
        for ws in cut:
            missing.update(w for w in set(ws) if w not in words)
        new: dict[str, int] = {}
        names, rows, held = [], [], 0
        for w in missing:
            names.append(w)
            rows.append(self.symbols(w))
            held += len(rows[-1])
            if held >= BATCH_SYMBOLS:
                new.update(zip(names, self.merged(rows), strict=True))
                names, rows, held = [], [], 0
        new.update(zip(names, self.merged(rows), strict=True))
        totals = []
        for ws in cut:
            try:
                totals.append(sum(map(words.__getitem__, ws)))
            except KeyError:
                totals.append(sum(words[w] if w in words else new[w] for w in ws))
        for w, n in new.items():
            if len(w) <= MEMO_CHARS:
                words.keep(w, n)
        return totals


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter:
    """The worker's counter for a model file."""
    return PieceCounter(path)


def _blocks(texts, most: int = 4_000_000):
    """Lists of texts of together about ``most`` characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def add_token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """df with column ``out``: the number of tokens of column ``text``."""
    path = path or default_model()

    @F.arrow_udf("bigint")
    def tokens(texts: pa.Array) -> pa.Array:
        run = counter(path).count
        return pa.array([n for block in _blocks(x.as_py() or "" for x in texts) for n in run(block)], pa.int64())

    return df.withColumn(out, tokens(F.col(text)))


def token_report(docs: DataFrame, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    counted = add_token_counts(docs.select("doc_id", "text"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over the whole of documents."""
    return token_report(table(spark, sf_dir, "documents"))
