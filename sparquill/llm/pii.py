r"""Personal data by patterns and by information-theoretic sanitisation (operator 7), in DataFrame
functions only.

Base kinds (email, ip, card, phone) are found by patterns and checked (parts of an address, the
Luhn sum, numbers of digits); a match that fails is dropped. Each value found is a protected
entity, however rarely it is mentioned. Around every mention, CONTEXT characters each way give its
context's words. Both counts of p(entity | term) are of documents: those where the term stands in a
context of the entity, and those that hold the term; SMOOTHING documents more mention the entity as
often as the corpus does. What is left to learn about the entity once the term is known is
-log2 p(entity | term) bits. A term that leaves at most REMOVE_BITS is removed, one that leaves at
most GENERALISE_BITS is generalised to its first letter, wherever it stands in the corpus. Copies of
a text are one observation of its entities (documents without the entity count each), and a term
that makes the entity no likelier than the corpus does discloses nothing.

The patterns are written without backtracking over runs, and spans are placed by block-wise sums, so
that n spans cost n to the power 1.5 and the text is read a fixed number of times. Term counts are aggregated before the shuffle. Tables of terms and of documents that
hold them are broadcast up to BROADCAST_ROWS rows, and joined by shuffle beyond.

Cases: null and empty texts have no spans; of overlapping spans the redaction masks the union;
rows of equal doc_id share their terms, each found in its own text; a row with a null doc_id gets
base spans only; other columns are kept by redact, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checkpoint, table, text_of

# possessive runs, begun only at a run's start or where the match before ended
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone", "term")

CONTEXT = 64
SMOOTHING = 0.5
REMOVE_BITS = 0.5
GENERALISE_BITS = 1.0
LETTERS = 3
BROADCAST_ROWS = 200_000
_SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _before(df: DataFrame, values: str, out: str, fold, zero) -> DataFrame:
    """df with column ``out``: for each element of the array column ``values``, the fold of those before
    it. Elements are folded in blocks of the square root of their number, and the blocks' results
    likewise, as an array that grows is copied at every step."""
    kind = dict(df.dtypes)[values][6:-1]
    none = F.array().cast(f"array<{kind}>")

    def running(x: Column) -> Column:
        start = F.struct(F.lit(zero).cast(kind).alias("v"), none.alias("all"))
        return F.aggregate(x, start, lambda a, y: F.struct(fold(a["v"], y).cast(kind).alias("v"), F.concat(a["all"], F.array(a["v"])).alias("all")))

    n = F.size(values)
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(1), n, step), lambda at: running(F.slice(values, at, step))))
    df = df.withColumn("__blocks", blocks)
    df = df.withColumn("__over", running(F.transform("__blocks", lambda b: b["v"]))["all"])
    each = F.zip_with("__blocks", "__over", lambda b, o: F.transform(b["all"], lambda v: fold(o, v).cast(kind)))
    return df.withColumn(out, F.coalesce(F.flatten(each), none)).drop("__blocks", "__over")


def _found(df: DataFrame, text: Column, pattern: Column, kind: int, out: str, worth: Column | None = None) -> DataFrame:
    """df with column ``out``: spans of a pattern's matches: start and end in code points, kind, value.
    worth: a cheap test that texts with a match pass."""
    can = F.regexp_like(text, pattern) if worth is None else worth & F.regexp_like(text, pattern)
    df = df.withColumn("__values", F.when(can, F.regexp_extract_all(text, pattern, F.lit(0))))
    df = df.withColumn("__gaps", F.when(F.size("__values") > 0, F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size("__values")), lambda g: F.length(g))))
    df = df.withColumn("__steps", F.zip_with("__gaps", "__values", lambda g, v: g + F.length(v)))
    df = _before(df, "__steps", "__from", lambda a, b: a + b, 0)
    begins = F.zip_with("__from", "__gaps", lambda a, g: a + g)
    spans = F.zip_with(begins, "__values", lambda at, v: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(v)).alias("end"), v.alias("value")))
    return df.withColumn(out, F.coalesce(spans, F.array().cast(f"array<{_SPAN}>"))).drop("__values", "__gaps", "__steps", "__from")


def base_spans(df: DataFrame, text: Column, out: str) -> DataFrame:
    """df with column ``out``: checked spans of the four base kinds, by start and then kind."""
    digits = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    length = lambda s: F.length(digits(s))
    octets = F.lit(rf"^(?:{OCTET}\.){{3}}{OCTET}$")
    checks = [
        (EMAIL, F.contains(text, F.lit("@")), None),
        (IP, None, lambda s: F.regexp_like(s["value"], octets)),
        (CARD, None, lambda s: length(s).between(12, 19) & F.call_function("luhn_check", digits(s))),
        (PHONE, F.contains(text, F.lit("+")), lambda s: length(s).between(9, 15)),
    ]
    parts = []
    for kind, (pattern, worth, check) in enumerate(checks):
        df = _found(df, text, F.lit(pattern), kind, f"__kind{kind}", worth)
        parts.append(F.col(f"__kind{kind}") if check is None else F.filter(f"__kind{kind}", check))
    return df.withColumn(out, F.array_sort(F.concat(*parts))).drop(*[f"__kind{k}" for k in range(4)])


def _terms_of(text: Column) -> Column:
    """Lower-cased words of letters, LETTERS and longer."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= LETTERS)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def revealing_terms(found: DataFrame, scratch: Scratch, text: str = "text", spans: str = "__base") -> DataFrame:
    """(term, action): terms of the corpus that reveal a protected entity. found: texts with base spans."""
    whole = F.col(text)
    # the row number, not being deterministic, keeps the filter from being pushed into the patterns' work
    held = found.select(whole.alias("t"), F.xxhash64(whole).alias("h"), F.col(spans).alias("all"), F.monotonically_increasing_id().alias("row"))
    held = held.filter(F.size("all") > 0).select("t", "h", "row", F.explode("all").alias("s"))
    s = F.col("s")
    begin = F.greatest(s["start"] - CONTEXT, F.lit(0))
    # words that the context's edge may cut are left out
    left = F.when(begin > 0, F.regexp_replace(F.substring(F.col("t"), begin + 1, s["start"] - begin), r"^\p{L}+", "")).otherwise(F.substring(F.col("t"), F.lit(1), s["start"]))
    right = F.substring(F.col("t"), s["end"] + 1, F.lit(CONTEXT))
    right = F.when(F.length(right) == CONTEXT, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
    terms = _terms_of(F.concat(left, F.lit(" | "), right))
    context = scratch.keep(held.select(F.xxhash64(F.lower(s["value"])).alias("entity"), "h", "row", terms.alias("terms")))
    copies = context.groupBy("h").agg(F.count_distinct("row").alias("rows"))
    seen = context.select("entity", "h", F.explode_outer("terms").alias("term")).distinct()
    seen = scratch.keep(seen.join(copies, "h"))
    docs = found.count()
    entities = seen.select("entity", "h", "rows").distinct().groupBy("entity").agg((F.count("*") / (docs - F.sum("rows") + F.count("*"))).alias("prior"))
    joint = seen.filter("term is not null").groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.sum("rows").alias("rows_both"))
    wanted = joint.select("term").distinct()
    words = found.select(F.explode(F.array_distinct(_terms_of(text_of(whole)))).alias("term"))
    totals = words.groupBy("term").agg(F.count("*").alias("rows_term")).join(_small(wanted), "term", "left_semi")
    n_term = F.col("rows_term") - F.col("rows_both") + F.col("n_both")
    p = (F.col("n_both") + SMOOTHING * F.col("prior")) / (n_term + SMOOTHING)
    told = joint.join(totals, "term").join(entities, "entity").withColumn("p", p).filter(F.col("p") > F.col("prior"))
    told = told.groupBy("term").agg((-F.log2(F.max("p"))).alias("bits")).filter(F.col("bits") <= GENERALISE_BITS)
    return told.select("term", F.when(F.col("bits") <= REMOVE_BITS, "remove").otherwise("generalise").alias("action"))


def _term_spans(df: DataFrame, text: Column, action: str) -> DataFrame:
    """df with the spans of those of column __hits' terms that ask for an action; in one pass for all."""
    names = F.transform(F.filter("__hits", lambda h: h["action"] == action), lambda h: h["term"])
    df = df.withColumn("__pattern", F.when(F.size(names) > 0, F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(names, "|"), F.lit(r")(?!\p{L})"))))
    df = _found(df, text, F.col("__pattern"), 4, f"__{action}", F.col("__pattern").isNotNull())
    put = lambda v: F.lit("") if action == "remove" else F.concat(F.substring(v, 1, 1), F.lit("*"))
    masked = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), put(s["value"]).alias("value"))
    return df.withColumn(f"__{action}", F.transform(f"__{action}", masked)).drop("__pattern")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "spans") -> DataFrame:
    """docs with column ``out``: all spans (start, kind's index in KINDS, end, value) by start and kind;
    a term's value is what takes its place."""
    scratch = Scratch(docs.sparkSession, "disclosure")
    t = text_of(text)
    found = base_spans(docs, t, "__base")
    terms = checkpoint(revealing_terms(found, scratch, text))
    if terms.isEmpty():
        scratch.close()
        return found.withColumnRenamed("__base", out)
    words = docs.select(F.col(doc_id).alias("__id"), F.explode(F.array_distinct(_terms_of(text_of(text)))).alias("term"))
    hits = words.join(_small(terms), "term").groupBy("__id").agg(F.array_sort(F.collect_set(F.struct("term", "action"))).alias("__hits"))
    hits = checkpoint(hits.filter("__id is not null"))
    scratch.close()
    joined = found.join(_small(hits), F.col(doc_id) == F.col("__id"), "left").drop("__id")
    parts = [F.col("__base")]
    for action in ("remove", "generalise"):
        joined = _term_spans(joined, t, action)
        parts.append(F.col(f"__{action}"))
    joined = joined.withColumn(out, F.array_sort(F.concat(*parts)))
    return joined.drop("__base", "__hits", "__remove", "__generalise")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with personal data masked by its kind, and revealing terms removed or generalised."""
    columns = docs.columns
    found = find(docs, doc_id, text, "__spans")
    # pieces are cut from an array of characters: taking them from the text would read it anew for each
    found = found.withColumn("__chars", F.when(F.size("__spans") > 0, F.regexp_extract_all(F.col(text), F.lit("(?s)."), F.lit(0))))
    found = found.withColumn("__ends", F.transform("__spans", lambda s: s["end"]))
    found = _before(found, "__ends", "__done", lambda a, b: F.greatest(a, b), 0)
    take = lambda a, b: F.array_join(F.slice("__chars", a + 1, F.greatest(b - a, F.lit(0))), "")
    mask = lambda s: F.when(s["kind"] == 4, s["value"]).otherwise(F.concat(F.lit("["), F.upper(F.get(F.lit(list(KINDS)), s["kind"])), F.lit("]")))
    pieces = F.zip_with("__spans", "__done", lambda s, done: F.concat(take(done, s["start"]), F.when(s["start"] >= done, mask(s)).otherwise("")))
    found = found.withColumn("__pieces", F.when(F.size("__spans") > 0, pieces))
    rest = F.array_join(F.slice("__chars", F.array_max("__ends") + 1, F.size("__chars")), "")
    clean = F.when(F.size("__pieces") > 0, F.concat(F.array_join("__pieces", ""), rest)).otherwise(F.col(text))
    return found.withColumn(text, clean).select(*[F.col(f"`{c}`") for c in columns])


def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over the whole of documents."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    name = lambda s: F.concat(F.get(F.lit(list(KINDS)), s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])
    base = F.filter("spans", lambda s: s["kind"] < 4)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", name), ",").alias("spans"),
    )
