"""Queries over documents, pages, vectors and small literal tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import text as X
from ..operators import records
from ..operators import retrieval as R
from .base import table
from .registry import register

# white space as Java's (?U)\s has it, for RE2
WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CHUNKS = f"(SELECT doc_id, i // 448 AS chunk, array_to_string(w[i + 1:i + 512], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, len(w), 448)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS w FROM documents)))"


def _chunks(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(X.chunk_words(F.col("text"))).alias("chunk", "text"))


@register("chunk_words", f"SELECT doc_id, chunk::INT AS chunk, length(text)::INT AS n, md5(text) AS digest FROM {CHUNKS}")
def chunk_words(spark, sf):
    return _chunks(spark, sf).select("doc_id", "chunk", F.length("text").alias("n"), F.md5("text").alias("digest"))


@register("chunk_counts", f"SELECT doc_id, count(*)::BIGINT AS chunks FROM {CHUNKS} GROUP BY 1")
def chunk_counts(spark, sf):
    return _chunks(spark, sf).groupBy("doc_id").agg(F.count("*").alias("chunks"))


def _sides(spark, sf):
    """Every tenth embedding as a query, all as corpus; a query's own row is left out of the search."""
    e = table(spark, sf, "embeddings").withColumnRenamed("embedding", "emb").withColumn("domain", F.lit(0))
    return e.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "chunk_id"), ["domain"]


def _top(spark, sf, k):
    return R.search(*_sides(spark, sf), k, apart=True)


SCORED = "(SELECT q.vec_id AS query_id, q.label AS q_label, c.vec_id AS chunk_id, c.label, round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 9) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 10 = 0 AND c.vec_id <> q.vec_id)"


@register("topk_vectors", f"SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM {SCORED}) WHERE rank <= 5")
def topk_vectors(spark, sf):
    return _top(spark, sf, 5).select("query_id", "chunk_id", "rank")


RANKED = f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM {SCORED})"


@register("first_hit_rank", f"SELECT query_id, coalesce(min(r) FILTER (label = q_label), -1)::INT AS target_rank, coalesce((min(r) FILTER (label = q_label) <= 5)::INT, 0) AS hit5 FROM {RANKED} GROUP BY 1")
def first_hit_rank(spark, sf):
    return R.first_hit(*_sides(spark, sf), apart=True).withColumn("target_rank", F.coalesce("target_rank", F.lit(-1)))


@register("nearest_within_radius", f"SELECT query_id, chunk_id FROM {RANKED} WHERE r = 1 AND sqrt(greatest(0, 2 - 2 * score)) <= 1.3")
def nearest_within_radius(spark, sf):
    return R.nearest_within(_top(spark, sf, 1), 1.3).select("query_id", "chunk_id")


@register("retrieved_context", f"SELECT query_id, string_agg('#' || chunk_id, ' | ' ORDER BY r) AS context FROM {RANKED} WHERE r <= 5 GROUP BY 1")
def retrieved_context(spark, sf):
    top = _top(spark, sf, 5).withColumn("text", F.concat(F.lit("#"), "chunk_id"))
    return R.contexts(top, separator=" | ")


@register("shared_hits", f"SELECT q_label, count(*)::BIGINT AS n, sum(h)::BIGINT AS hits FROM (SELECT query_id, q_label, coalesce((min(r) FILTER (label = q_label) <= 5)::INT, 0) AS h FROM {RANKED} GROUP BY 1, 2) GROUP BY 1")
def shared_hits(spark, sf):
    sides = _sides(spark, sf)
    hits = R.first_hit(*sides, apart=True).join(sides[0].select("query_id", F.col("label").alias("q_label")), "query_id")
    return hits.groupBy("q_label").agg(F.count("*").alias("n"), F.sum("hit5").alias("hits"))


@register("mmr_select")
def mmr_select(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), (F.col("vec_id") % 7).cast("double").alias("quality"), F.col("embedding").alias("emb"))
    return R.mmr(e, "grp", 10)


@register("strip_html", "SELECT page_id, left(regexp_replace(html, '<[^>]+>', '', 'g'), 1000) AS text FROM pages")
def strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


def literal(spark, rows):
    return spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id int, s string")


def values(rows):
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({i}, {quote(x)})" for i, x in enumerate(rows)) + ") v(id, s)"


CAMEL = ["LinearLayer", "BatchNorm2d", "relu", "HTTPServerTool", "GPUArray", "AbCdEf", ""]
ERRORS = ["AssertionError: solution did not call target API", "Error404Error: digits", "Traceback\nValueError: x\nKeyError: y", "pkg.CustomError: dotted", "NameError: name 'foo' is not defined", "", "warning\nSyntaxError: bad\nnote Error"]
REPLIES = ["text {\"a\": 1} tail", "no json", "{\"a\": {\"b\": 2}} and {\"c\": 3}", "```json\n{\"k\": []}\n```"]
THINK = ["<think>plan</think>answer", "half</think>rest", "plain", "<think>a</think>b<think>c</think>d"]
DOCS = ["See doi:10.1000/xyz123. and https://doi.org/10.1000/xyz123 (Smith et al., 2019)", "arXiv:2101.00001v2 [1] and huggingface.co/papers/2101.00001v2", "[Jones 1999] text huggingface.co/papers/1706.03762 https://arxiv.org/abs/2005.14165", "nothing 10.1000/bare"]


@register("camel_suffix", f"SELECT id, coalesce(list_filter(regexp_extract_all(s, '[A-Z][a-z]+'), lambda x: length(x) >= 3)[-1], s) AS suffix FROM {values(CAMEL)}")
def camel_suffix(spark, sf):
    return literal(spark, CAMEL).select("id", X.camel_suffix(F.col("s")).alias("suffix"))


@register("exception_type", f"SELECT id, coalesce(regexp_extract_all(s, '(?m)^([A-Z][A-Za-z_]*(?:Interrupt|Warning|Exception|Error))\\b', 1)[-1], '') AS kind FROM {values(ERRORS)}")
def exception_type(spark, sf):
    return literal(spark, ERRORS).select("id", X.exception_type(F.col("s")).alias("kind"))


JUDGED = ['{"class": "W_PARAM", "rationale": "r"}', "prose", '{"class": "W_API", "rationale": "empty stub"}', '{"class": "W_SHAPE_DTYPE"}', '{"class": "W_LOGIC"}', "", '{"class": "odd"}']


@register("label_rules", f"""
SELECT id, CASE WHEN s LIKE '%AssertionError: solution did not call target API%' THEN 'WrongAPISelection' WHEN kind IN ('SyntaxError', 'IndentationError') THEN 'WrongSyntax'
  WHEN regexp_extract(s, 'NameError: name ''([^'']+)'' is not defined', 1) IN ('foo', 'pkg') THEN CASE WHEN kind = 'NameError' THEN 'WrongImport' ELSE 'WrongAPISelection' END
  WHEN j LIKE '%W_PARAM%' THEN 'WrongParam' WHEN j LIKE '%W_SHAPE%' THEN 'WrongShapeDtype' WHEN j LIKE '%stub%' THEN 'WrongSyntax' WHEN j LIKE '%W_LOGIC%' OR id % 2 = 0 THEN 'WrongLogic' ELSE 'WrongAPISelection' END AS label
FROM (SELECT e.id * 10 + j.id AS id, e.s, j.s AS j, coalesce(regexp_extract_all(e.s, '(?m)^([A-Z][A-Za-z_]*(?:Interrupt|Warning|Exception|Error))\\b', 1)[-1], '') AS kind FROM {values(ERRORS)} e, {values(JUDGED).replace("v(id, s)", "j(id, s)")})""".replace("v(id, s) e", "e(id, s)"))
def label_rules(spark, sf):
    rows = [(10 * i + k, e, "x = foo()" if k % 2 == 0 else "x = 1", j) for i, e in enumerate(ERRORS) for k, j in enumerate(JUDGED)]
    df = spark.createDataFrame(rows, "id int, s string, code string, raw string")
    return df.select("id", X.label_of(F.col("s"), F.lit("pkg.foo"), F.col("code"), F.col("raw")).alias("label"))


@register("json_outermost", f"SELECT id, coalesce(nullif(regexp_extract(s, '(?s)\\{{.*\\}}'), ''), 'none') AS j FROM {values(REPLIES)}")
def json_outermost(spark, sf):
    return literal(spark, REPLIES).select("id", F.coalesce(X.outermost_json(F.col("s")), F.lit("none")).alias("j"))


@register("strip_thinking", f"SELECT id, trim(CASE WHEN t LIKE '%</think>%' THEN regexp_replace(t, '(?s)^.*?</think>', '') ELSE t END) AS t FROM (SELECT id, regexp_replace(s, '(?s)<think>.*?</think>\\s*', '', 'g') AS t FROM {values(THINK)})")
def strip_thinking(spark, sf):
    return literal(spark, THINK).select("id", X.strip_thinking(F.col("s")).alias("t"))


CITED = " || ".join(
    f"list_transform({found}, lambda x: {{'kind': '{kind}', 'value': x}})"
    for kind, found in [
        ("arxiv", r"regexp_extract_all(s, '(?i)(?:arxiv:|arxiv\.org/abs/)(\d{4}\.\d{4,5}(?:v\d+)?)', 1)"),
        ("arxiv", r"regexp_extract_all(s, '(?i)huggingface\.co/papers/(\d{4}\.\d{4,5}(?:v\d+)?)', 1)"),
        ("doi", r"list_transform(regexp_extract_all(s, '(?i)(?:doi:|https?://doi\.org/)(10\.\d{4,}/[^\s,)\]>\"'']+)', 1), lambda v: rtrim(v, '.'))"),
        ("author_year", r"regexp_extract_all(s, '[\[(]([A-Z][a-zA-Z\-]+(?: et al\.?)?,?\s*\d{4})[\])]', 1)"),
    ]
)


@register("citations", f"""
SELECT id, (i - 1)::INT AS pos, c[i].kind AS kind, c[i].value AS value FROM (SELECT id, c, unnest(range(1, len(c) + 1)) AS i FROM (
  SELECT id, list_filter(e, lambda x, i: list_position(list_transform(e, lambda y: y.value), x.value) = i) AS c FROM (SELECT id, {CITED} AS e FROM {values(DOCS)})))
""")
def citations(spark, sf):
    return literal(spark, DOCS).select("id", F.posexplode(X.citations(F.col("s"))).alias("pos", "c")).select("id", "pos", "c.kind", "c.value")


@register("json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS page FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("page")).filter("page is not null")


@register("render_knowledge", "SELECT p_partkey, concat_ws(chr(10) || chr(10), CASE WHEN p_size % 2 = 0 THEN p_name END, CASE WHEN p_size > 10 THEN p_brand END, p_type) AS text FROM part")
def render_knowledge(spark, sf):
    parts = [(F.col("p_size") % 2 == 0, F.col("p_name")), (F.col("p_size") > 10, F.col("p_brand")), (F.lit(True), F.col("p_type"))]
    return table(spark, sf, "part").select("p_partkey", X.render_knowledge(parts).alias("text"))


@register("stable_ids", "SELECT doc_id, 'llm_' || left(md5(source || ':' || lang || ':' || left(text, 40)), 12) AS task_id FROM documents")
def stable_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.task_id(F.col("source"), F.col("lang"), F.col("text")).alias("task_id"))


@register("build_prompt", "SELECT p_partkey, CASE WHEN p_size > 25 THEN '# Reference Documentation:' || chr(10) || p_name || chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || p_type || chr(10) || chr(10) || '# Task:' || chr(10) || p_brand || chr(10) || chr(10) || '# Go' AS prompt FROM part")
def build_prompt(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", X.build_prompt(F.col("p_brand"), F.col("p_type"), F.when(F.col("p_size") > 25, F.col("p_name")), "# Go").alias("prompt"))


@register("stderr_tail", "SELECT doc_id, right(regexp_replace(left(text, 4096), '^\\s+|\\s+$', '', 'g'), 500) AS tail FROM documents")
def stderr_tail(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.stderr_tail(F.col("text")).alias("tail"))


ANSWERS = ["```python\nimport os\nprint(os.getcwd())\n```", "Sure!\nx = f(1, b=2)\nprint(x)", "<think>no</think>\n```\ndef solution():\n    return 1\n```", "only prose here", "```py\nbroken(\n```\n```python\nok = 1\n```"]


@register("extract_code")
def extract_code(spark, sf):
    df = records.code_map(literal(spark, ANSWERS), "s", "code", "string", C.extract_code)
    df = records.code_map(df, "code", "names", "array<string>", C.names)
    return records.code_map(df, "code", "unseeded", "string", C.unseed).select("id", "code", "names", "unseeded")


@register("call_match")
def call_match(spark, sf):
    rows = [(1, '[{"v": 1.0}]', '[{"v": 1}]'), (2, '[{"v": 1}]', '[{"v": true}]'), (3, '[{"a": [1, 2]}]', '[{"a": [1, 2], "b": 0}]'), (4, '[{"a": [1]}]', '[{"a": [1, 2]}]'), (5, "[]", "[]")]
    return records.add_all_matched(spark.createDataFrame(rows, "id int, expected string, calls string")).select("id", "matched")


@register("expected_records")
def expected_records(spark, sf):
    rows = [("a", 0, '[{"v": 1, "t": 5}]'), ("a", 1, '[{"v": 1, "t": 6}]'), ("b", 0, "[]"), ("c", 0, '[{"v": 1}, {"v": 2}]'), ("c", 1, '[{"v": 2}]')]
    return records.expected_records(spark.createDataFrame(rows, "task_id string, run int, calls string"))


@register("query_text", "SELECT conv_id, turn, role || chr(10) || coalesce(text, '') AS q FROM conversations")
def query_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.col("role"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("q"))


TIMES = ["2024-01-02T03:04:05", "2024-01-02 03:04:05", "2024/01/02", "never"]


@register("timestamp_formats", f"SELECT id, strftime(try_cast(replace(s, '/', '-') AS TIMESTAMP), '%Y%m%d%H%M%S') AS t FROM {values(TIMES)} WHERE id < 3")
def timestamp_formats(spark, sf):
    parsed = X.parse_timestamp(F.col("s"), ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd"])
    return literal(spark, TIMES).select("id", F.date_format(parsed, "yyyyMMddHHmmss").alias("t")).filter("t is not null")


@register("name_changes", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '- Old signature: (' || p_size || ')' || chr(10) || '- New signature: new' || chr(10) || '- (Exact change not determined — tasks should test new parameter behaviour)'
  WHEN 1 THEN '- New parameters added: c, d' WHEN 2 THEN '- Parameters removed: b' ELSE '- New parameters added: c' || chr(10) || '- Parameters removed: b' || chr(10) || '- Parameter ' || chr(39) || 'a' || chr(39) || ' default changed: ' || chr(39) || p_size || chr(39) || ' → None' END AS changes FROM part
""")
def name_changes(spark, sf):
    param = lambda n, d: F.struct(F.lit(n).alias("name"), d.cast("string").alias("default"))
    k, size, none = F.col("p_partkey") % 4, F.col("p_size"), F.lit(None)
    old = F.array(param("self", none), param("a", size), param("b", none))
    new = F.when(k == 0, old).when(k == 1, F.concat(old, F.array(param("d", none), param("c", none)))).when(k == 2, F.slice(old, 1, 2)).otherwise(F.array(param("a", none), param("c", none)))
    signature = F.concat(F.lit("("), size, F.lit(")"))
    return table(spark, sf, "part").select("p_partkey", X.summarise_changes(signature, old, F.lit("new"), new).alias("changes"))


@register("leaf_variants", """
SELECT p_partkey, array_to_string(list_sort(list_distinct([w, b, replace(lower(w), '_', '')] || list_transform(['s', 'ed', 'ing', 'er'], lambda e: w || e) || list_transform(['s', 'ed', 'ing', 'er'], lambda e: b || e))), ',') AS variants
FROM (SELECT p_partkey, w, lower(replace(w, '_', ' ')) AS b FROM (SELECT p_partkey, replace(p_name, ' ', '_') || '_X' AS w FROM part))
""")
def leaf_variants(spark, sf):
    name = F.concat(F.lit("pkg."), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_X"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.leaf_variants(name), ",").alias("variants"))


@register("chat_rows", "SELECT conv_id, count(*)::BIGINT AS n, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def chat_rows(spark, sf):
    messages = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(messages.alias("messages"))
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return rows.select("conv_id", F.size("messages").cast("long").alias("n"), F.md5(joined).alias("digest"))


@register("shared_path_prefix", "SELECT a.page_id, len(list_filter(range(1, least(len(a.p), len(b.p)) + 1), lambda i: a.p[1:i] = b.p[1:i]))::INT AS shared FROM (SELECT page_id, string_split(url, '/') AS p FROM pages) a JOIN (SELECT page_id, string_split(url, '/') AS p FROM pages) b ON b.page_id = a.page_id + 1")
def shared_path_prefix(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.split("url", "/").alias("p"))
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("p").alias("q"))
    return p.join(nxt, "page_id").select("page_id", X.shared_prefix(F.col("p"), F.col("q")).alias("shared"))


@register("grounding_rule", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'paper' WHEN doc_id % 3 = 0 AND n > 50 THEN 'source'
  WHEN doc_id % 3 = 1 AND n >= 200 AND len(list_filter(string_split_regex(text, '\\r?\\n'), lambda x: NOT regexp_matches(x, '^\\s*(#|$)'))) >= 10 THEN 'source' ELSE 'docstring' END AS grounding
FROM (SELECT *, doc_id % 7 * 100 AS n FROM documents)
""")
def grounding_rule(spark, sf):
    i = F.col("doc_id")
    doc = F.when(i % 5 == 0, F.lit("as in arXiv:2101.00001")).otherwise(F.repeat(F.lit("x"), (i % 7 * 100).cast("int")))
    role = X.api_role(F.when(i % 3 == 0, "function").otherwise("class"), F.when(i % 3 == 1, "odd").otherwise("enum"))
    return table(spark, sf, "documents").select("doc_id", X.grounding(doc, role, F.lit("a.py"), F.col("text")).alias("grounding"))


@register("resampling_seed_order", "SELECT p_brand, string_agg(p_partkey::VARCHAR, ',' ORDER BY md5('7:' || p_partkey), p_partkey) AS shuffled FROM part GROUP BY 1")
def resampling_seed_order(spark, sf):
    p = table(spark, sf, "part")
    ordered = F.array_sort(F.collect_list(F.struct(F.md5(F.concat(F.lit("7:"), "p_partkey")).alias("h"), F.col("p_partkey").alias("k"))))
    return p.groupBy("p_brand").agg(F.array_join(F.transform(ordered, lambda x: x["k"].cast("string")), ",").alias("shuffled"))
