"""Byte-level BPE encoding and decoding (operator 1).

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary
gives the longest entry at an offset of a pre-token. The encoder walks from longest matches and
backtracks, to the next shorter entry, where two adjacent tokens couldn't both come out of the
merges; whether they can is decided by undoing merges and is memoised for each pair. An offset
that failed once is never tried again, so a pre-token costs time linear in its bytes, however
long it is, and the result is the one that applying the merges in rank order gives.

Cases: a null or empty text has no tokens (zero-length ids); ids that are null decode to zero
bytes; repeated rows are encoded alike; the frame's other columns are kept, whatever their names.
"""

from __future__ import annotations

import base64
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import no_cycles, small_batches, table

#: Most pre-tokens and token pairs a worker remembers: some 70 MB and 20 MB.
MEMO_WORDS = 350_000
MEMO_PAIRS = 200_000
#: Longer pre-tokens (in characters) aren't remembered.
MEMO_CHARS = 48


def default_ranks() -> str:
    """Path of the vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    """The pre-token pattern that goes with the vocabulary."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def rust_classes(pattern: str) -> str:
    """The pattern for the regex module, where \\s also covers U+001C to U+001F, which the
    White_Space property (what tokenizer libraries mean by \\s) doesn't hold."""
    white = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{white}\p{{L}}\p{{N}}]").replace(r"(?!\S)", rf"(?![^{white}])").replace(r"\s+", rf"[{white}]+")


def splitter(pattern: str):
    """Function from a text to its pre-tokens. Texts of the basic plane are split by the standard
    library's engine, which is thrice as fast, over the ranges that the classes have in that plane."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    whole = plane = rust_classes(pattern)
    for name in ("L", "N"):
        runs = regex.findall(rf"\p{{{name}}}+", every)
        ranges = "".join(f"\\u{ord(r[0]):04x}-\\u{ord(r[-1]):04x}" for r in runs)
        plane = plane.replace(rf"?\p{{{name}}}+", f"?[{ranges}]+").replace(rf"\p{{{name}}}", ranges)
    slow, fast = regex.compile(whole).findall, re.compile(plane).findall

    def split(text: str) -> list[str]:
        return fast(text) if text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text) else slow(text)

    return split


class ByteBpe:
    """Encoder and decoder for a rank file; one per worker process."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = splitter(pattern)
        if any(bytes([x]) not in ranks for x in range(256)):
            raise ValueError("the vocabulary lacks some byte")
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length = [len(x) for x in self.bytes_of]
        self.most = max(self.length)
        self.by_text = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.by_text.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        #: the longest token that each token properly begins with
        self.shorter = [next((r for k in range(len(b) - 1, 0, -1) if (r := ranks.get(b[:k])) is not None), -1) for b in self.bytes_of]
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = []
        self.fits: dict[int, bool] = {}
        self.words = Words(self.ids)
        self._undo()

    def _undo(self) -> None:
        """parts: the two tokens whose merge makes each token; pairs: the merges by their parts."""
        for rank, token in enumerate(self.bytes_of):
            found = (rank, rank)
            for cut in range(len(token) - 1, 0, -1):
                a, b = self.ranks.get(token[:cut], rank), self.ranks.get(token[cut:], rank)
                if a < rank and b < rank and self._compatible(a, b):
                    found = (a, b)
                    self.pairs[found] = rank
                    break
            self.parts.append(found)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b standing side by side."""
        limit = 1 << 60
        parts, pairs = self.parts, self.pairs
        while True:
            if pairs.get((a, b), limit) < limit:
                return False
            if a > b:
                limit = a
                a = parts[a][1]
                if a == limit:
                    limit = b + 1
                    b = parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = parts[b][0]
                if b + 1 == limit:
                    limit = a
                    a = parts[a][1]
                    if a == limit:
                        return True

    def ids(self, word: str) -> list[int]:
        """Tokens of one pre-token."""
        text = word if word.isascii() else word.encode().decode("latin-1")
        whole = self.by_text.get(text)
        if whole is not None:
            return [whole]
        n, most, length, shorter, fits, longest = len(text), self.most, self.length, self.shorter, self.fits, self.automaton.iter_long
        # a failed offset is dead; what is left to try at an offset are the shorter tokens there
        tokens, at, last, dead = [], 0, -1, set()
        rank = next(longest(text[:most]))[1]
        while True:
            end = at + length[rank]
            ok = end not in dead
            if ok and last >= 0:
                pair = last << 32 | rank
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) >= MEMO_PAIRS:
                        fits.clear()
                    ok = fits[pair] = self._compatible(last, rank)
            if ok:
                tokens.append(rank)
                if end == n:
                    return tokens
                at, last = end, rank
                rank = next(longest(text[at : at + most]))[1]
                continue
            rank = shorter[rank]
            while rank < 0:
                dead.add(at)
                rank = tokens.pop()
                at -= length[rank]
                last = tokens[-1] if tokens else -1
                rank = shorter[rank]

    def encode(self, text: str) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of a sequence of ids."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Words(dict):
    """Ids of pre-tokens: of those met first, which are the frequent ones, up to MEMO_WORDS of at
    most MEMO_CHARS characters. It starts anew when it has turned away four times as many."""

    def __init__(self, ids):
        super().__init__()
        self.ids, self.away = ids, 0

    def __missing__(self, word: str) -> bytes:
        got = self.ids(word)
        got = struct.pack(f"<{len(got)}I", *got)
        if len(word) <= MEMO_CHARS:
            if len(self) < MEMO_WORDS:
                self[word] = got
            else:
                self.away += 1
                if self.away > 4 * MEMO_WORDS:
                    self.clear()
                    self.away = 0
        return got


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> ByteBpe:
    """The worker's encoder for a rank file."""
    return ByteBpe(path, pattern)


def encode(df: DataFrame, text: str = "text", out: str = "ids_le", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with column ``out``: the token ids of column ``text`` as little-endian uint32 binary."""
    path, pattern = path or default_ranks(), pattern or default_pattern()
    small_batches(df.sparkSession)

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        run = codec(path, pattern).encode
        with no_cycles():
            return pa.array((run(x.as_py() or "") for x in texts), pa.binary())

    return df.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, ids: str = "ids_le", out: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with column ``out``: the bytes that the ids in column ``ids`` stand for."""
    path, pattern = path or default_ranks(), pattern or default_pattern()
    small_batches(df.sparkSession)

    @F.arrow_udf("binary")
    def back(column: pa.Array) -> pa.Array:
        run = codec(path, pattern).decode
        return pa.array((run(x.as_py() or b"") for x in column), pa.binary())

    return df.withColumn(out, back(F.col(ids)))


def copies_once(texts, run):
    """run of each text; of copies that follow each other, as a mixture holds them, once."""
    last, got = None, run("")
    for text in texts:
        text = text.as_py() or ""
        if text != last:
            last, got = text, run(text)
        yield got


def recode(df: DataFrame, text: str = "text", ids: str = "ids_le", out: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with columns ``ids`` and ``out``: the token ids of column ``text``, and the bytes that these
    stand for. decode after encode gives the same, but in one plan it encodes every text twice:
    the call for the bytes holds the call for the ids."""
    path, pattern = path or default_ranks(), pattern or default_pattern()
    small_batches(df.sparkSession)

    @F.arrow_udf("struct<ids:binary,bytes:binary>")
    def both(texts: pa.Array) -> pa.Array:
        own = codec(path, pattern)

        def run(x: str) -> tuple[bytes, bytes]:
            coded = own.encode(x)
            return coded, own.decode(coded)

        with no_cycles():
            rows = list(copies_once(texts, run))
        return pa.StructArray.from_arrays([pa.array([x[k] for x in rows], pa.binary()) for k in range(2)], names=["ids", "bytes"])

    made = both(F.col(text))
    return df.withColumns({ids: made["ids"], out: made["bytes"]})


def ids_array(ids: str = "ids_le"):
    """Column: the ids as an array of integers."""

    @F.arrow_udf("array<int>")
    def unpack(column: pa.Array) -> pa.Array:
        rows = [np.frombuffer(x.as_py() or b"", "<u4").astype("i4") for x in column]
        return pa.array(rows, pa.list_(pa.int32()))

    return unpack(F.col(ids))


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    coded = recode(docs.select("doc_id", "text"), ids="__ids", out="__bytes")
    return coded.select(
        "doc_id",
        (F.length("__ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("__ids", 256).alias("ids_sha256"),
        F.sha2("__bytes", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over the whole of documents."""
    return round_trip(table(spark, sf_dir, "documents"))
