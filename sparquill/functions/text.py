"""Column functions on text, arrays and JSON. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_STRINGS = "array<string>"


def strip(text: Column) -> Column:
    """Without Unicode white space at either end (trim() strips spaces only). A run within is looked at once, from its start."""
    return F.regexp_replace(text, r"(?U)^\s++|\s(?<!\s\s)\s*+\z", "")


def words(text: Column) -> Column:
    """Words between Unicode white space; none for an empty text."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def chunk_words(text: Column, size: int = 512, step: int = 448) -> Column:
    """Windows of ``size`` words that start at every ``step``th word; empty text gives none."""
    w = words(text)
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " "))


def leaf(name: Column) -> Column:
    """Last segment of a dotted name."""
    return F.substring_index(name, ".", -1)


def parent(name: Column) -> Column:
    """A dotted name without its last segment; empty for a bare name."""
    return F.regexp_replace(name, r"\.?[^.]*$", "")


def dotted_prefixes(name: Column) -> Column:
    """The name itself and everything it is nested in."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def camel_suffix(name: Column) -> Column:
    """Last capitalised word of three letters and more, else the name."""
    found = F.filter(F.regexp_extract_all(name, F.lit("[A-Z][a-z]+"), F.lit(0)), lambda x: F.length(x) >= 3)
    return F.coalesce(F.try_element_at(found, F.lit(-1)), name)


def version_key(version: Column) -> Column:
    """Numbers of a version's dot parts ('-' counts as a dot; what isn't a number is 0)."""
    return F.transform(F.split(F.replace(version, F.lit("-"), F.lit(".")), r"\."), lambda p: F.coalesce(F.regexp_replace(p, r"\D", "").try_cast("int"), F.lit(0)))


def is_prerelease(version: Column, marks: str = "a|b|rc|dev|post") -> Column:
    """Whether a version that isn't all digits and dots holds a mark, in either case."""
    low = F.lower(version)
    return F.regexp_like(low, F.lit(marks)) & ~F.regexp_like(F.replace(low, F.lit("."), F.lit("")), F.lit(r"^[0-9]+$"))


def exception_type(stderr: Column) -> Column:
    """Last line-initial exception name of letters and underscores; dotted or lower-case names don't count."""
    found = F.regexp_extract_all(F.coalesce(stderr, F.lit("")), F.lit(r"(?m)^([A-Z][A-Za-z_]*(?:Interrupt|Warning|Exception|Error))\b"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def undefined_name(stderr: Column) -> Column:
    """First name that a NameError calls undefined, else null."""
    return F.nullif(F.regexp_extract(stderr, r"NameError: name '([^']+)' is not defined", 1), F.lit(""))


def stderr_tail(stderr: Column) -> Column:
    """Last 500 characters of what the first 4,096 leave after stripping."""
    return F.right(strip(F.substring(stderr, 1, 4096)), F.lit(500))


def strip_thinking(text: Column) -> Column:
    """Without think blocks, and without what stands before a lone closing tag; stripped."""
    t = F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", "")
    at = F.instr(t, "</think>")
    return strip(F.when(at > 0, F.substr(t, at + len("</think>"))).otherwise(t))


def first_fence(text: Column) -> Column:
    """Code of the first fenced block, else the whole text, stripped."""
    fence = r"(?s)`{3}(?:python)?\n?(.*?)`{3}"
    return strip(F.when(F.regexp_like(text, F.lit(fence)), F.regexp_extract(text, fence, 1)).otherwise(text))


def unwrap_solution(code: Column) -> Column:
    """What follows the header of a function ``solution`` without parameters, if there is one."""
    head = "def solution():"
    at = F.instr(code, head)
    rest = F.substr(code, at + len(head))
    opened = F.when(F.contains(code, F.lit("\n")), F.substr(code, F.instr(code, "\n") + 1)).otherwise("")
    return F.when(at == 1, opened).when(at > 1, rest).otherwise(code)


def outermost_json(text: Column) -> Column:
    """From the first brace to the last; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def strip_tags(html: Column, most: int = 1000) -> Column:
    """Text without tags, cut to ``most`` characters."""
    return F.left(F.regexp_replace(html, "<[^>]+>", ""), F.lit(most))


def _tagged(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value"))


def citations(doc: Column) -> Column:
    """Distinct citations of a docstring: arXiv ids, ids of paper pages, DOIs, author and year; in that
    order, each value once, under the kind that finds it first."""
    number = r"(\d{4}\.\d{4,5}(?:v\d+)?)"
    kinds = [
        ("arxiv", rf"(?i)(?:arxiv:|arxiv\.org/abs/){number}"),
        ("arxiv", rf"(?i)huggingface\.co/papers/{number}"),
        ("doi", r"""(?i)(?:doi:|https?://doi\.org/)(10\.\d{4,}/[^\s,)\]>"']+)"""),
        ("author_year", r"[\[(]([A-Z][a-zA-Z\-]+(?: et al\.?)?,?\s*\d{4})[\])]"),
    ]
    parts = []
    for kind, pattern in kinds:
        found = F.regexp_extract_all(F.coalesce(doc, F.lit("")), F.lit(pattern), F.lit(1))
        if kind == "doi":
            found = F.transform(found, lambda x: F.regexp_replace(x, r"\.+$", ""))
        parts.append(F.transform(found, _tagged(kind)))
    everything = F.concat(*parts)
    return F.filter(everything, lambda x, i: F.array_position(F.transform(everything, lambda y: y["value"]), x["value"]) == i + 1)


def task_id(api: Column, difficulty: Column, description: Column) -> Column:
    """Stable task id."""
    return F.concat(F.lit("llm_"), F.substring(F.md5(F.concat_ws(":", api, difficulty, F.substring(description, 1, 40))), 1, 12))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Probability that k of n samples, c of them right, hold a right one."""
    miss = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1 - F.lit(float(k)) / i))
    return F.when(n - c < k, 1.0).when(c == 0, 0.0).otherwise(1 - miss)


def normalize_default(value: Column) -> Column:
    """A default without what differs from run to run: object addresses, and paths into environments,
    interpreters, job and temporary folders. Null stays null."""
    quoted = r"[^\s'\"]*"
    below = [r"(?:site-packages|lib-dynload)/" + quoted, r"bin/python[\d.]*", r"job-\d+" + quoted]
    paths = "|".join([f"/{quoted}/{x}" for x in below] + [f"/{quoted}tmp{quoted}", "/tmp/[A-Za-z0-9_]{6,}"])
    return F.regexp_replace(F.regexp_replace(value, "0x[0-9a-fA-F]{6,}", "0xADDR"), f"({paths})", "<ENVPATH>")


def signature_changed(old: Column, new: Column) -> Column:
    """Whether parameters (name, default, kind) differ beyond ``self``, defaults compared as
    normalised; from none to some isn't a change."""
    keep = lambda p: F.filter(p, lambda x: x["name"] != "self")
    o, n = keep(old), keep(new)
    same = lambda x, y: x["name"].eqNullSafe(y["name"]) & x["kind"].eqNullSafe(y["kind"]) & normalize_default(x["default"]).eqNullSafe(normalize_default(y["default"]))
    differs = F.exists(F.zip_with(o, n, same), lambda equal: ~equal)
    return F.when((F.size(old) == 0) & (F.size(new) > 0), False).otherwise((F.size(o) != F.size(n)) | differs)


def render_knowledge(parts: list[tuple[Column, Column]]) -> Column:
    """Non-empty components that are switched on, joined by blank lines."""
    return F.concat_ws("\n\n", *[F.when(on & (F.coalesce(text, F.lit("")) != ""), text) for on, text in parts])


def build_prompt(description: Column, context: Column, knowledge: Column, instructions: str = "") -> Column:
    """Prompt of a task: reference documentation if there is any, context, task, instructions."""
    k = F.coalesce(knowledge, F.lit(""))
    lead = F.when(k != "", F.concat(F.lit("# Reference Documentation:\n"), k, F.lit("\n\n---\n\n"))).otherwise("")
    return F.concat(lead, F.coalesce(context, F.lit("")), F.lit("\n\n# Task:\n"), description, F.lit("\n\n" + instructions))


def stable_hash(**parts: Column) -> Column:
    """Cache key: SHA-256 of the named parts as JSON with sorted keys; nulls are kept as null."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}), 256)


def bypass_mode(code: Column, api: Column) -> Column:
    """How a completion, given as its extracted code, gets around its API."""
    code = strip(F.coalesce(code, F.lit("")))
    name = F.concat(F.lit(r"\Q"), leaf(api), F.lit(r"\E\b"))
    own = F.regexp_like(code, F.concat(F.lit(r"(?m)^\s*(?:class|(?:async\s+)?def)\s+"), name))
    word = F.regexp_like(code, F.concat(F.lit(r"\b"), name))
    return F.when(F.length(code) <= 5, "empty").when(own, "same_name_reimpl").when(~word, "reimplemented").otherwise("referenced_not_invoked")


JUDGE_LABELS = {"W_PARAM": "WrongParam", "W_SHAPE_DTYPE": "WrongShapeDtype", "W_LOGIC": "WrongLogic"}


def judge_verdict(raw: Column, mentioned: Column) -> Column:
    """(group, rationale) of a judge's answer, the JSON object in it. Without a group of the known
    four: W_LOGIC where the code mentions the API, else W_API, and no rationale."""
    got = F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")), "class string, rationale string")
    group, said = strip(got["class"]), F.left(strip(F.coalesce(got["rationale"], F.lit(""))), F.lit(240))
    known = F.coalesce(group.isin("W_API", *JUDGE_LABELS), F.lit(False))
    return F.struct(F.when(known, group).when(mentioned, "W_LOGIC").otherwise("W_API").alias("group"), F.when(known, said).otherwise("").alias("rationale"))


def api_label(kind: Column, called: Column, rationale: Column, api: Column) -> Column:
    """Label of a failure that is the API's: selection, import or syntax, by exception and rationale."""
    said, name = F.lower(F.coalesce(rationale, F.lit(""))), F.lower(leaf(api))
    named = (name != "") & F.contains(said, name)
    unresolved = kind.isin("NameError", "ImportError", "ModuleNotFoundError")
    return (
        F.when(kind.isin("SyntaxError", "IndentationError") | F.regexp_like(said, F.lit("empty stub|pass[- ]only")), "WrongSyntax")
        .when(unresolved & (called | named | F.contains(said, F.lit("target api symbol"))), "WrongImport")
        .when(unresolved | ~called | (kind == "AssertionError") | ((kind == "AttributeError") & named), "WrongAPISelection")
        .otherwise("WrongImport")
    )


def label_of(stderr: Column, api: Column, code: Column, raw: Column, timed_out: Column | None = None) -> Column:
    """Failure label: the monitor's assertion, syntax and unresolved names in order, else the judge's
    answer ``raw``. A timeout goes to the judge."""
    err = F.coalesce(stderr, F.lit(""))
    late = F.lit(False) if timed_out is None else F.coalesce(timed_out, F.lit(False))
    kind = F.when(late, "Timeout").otherwise(exception_type(err))
    mentioned = F.contains(F.coalesce(code, F.lit("")), leaf(api))
    name = undefined_name(err)
    symbol = F.coalesce((name == leaf(api)) | (name == F.substring_index(api, ".", 1)), F.lit(False))
    judged = judge_verdict(raw, mentioned)
    by_judge = F.coalesce(*[F.when(judged["group"] == k, v) for k, v in JUDGE_LABELS.items()], api_label(kind, mentioned, judged["rationale"], api))
    return (
        F.when(~late & F.regexp_like(err, F.lit(r"(?i)AssertionError:\s*solution did not call target API")), "WrongAPISelection")
        .when(~late & kind.isin("SyntaxError", "IndentationError"), "WrongSyntax")
        .when(~late & symbol, api_label(kind, F.lit(False), F.lit("target api symbol"), api))
        .otherwise(by_judge)
    )


def parse_timestamp(text: Column, formats: list[str]) -> Column:
    """Time in the first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def summarise_changes(old_signature: Column, old: Column, new_signature: Column, new: Column) -> Column:
    """Lines on parameters (name, default) added, removed and with another default, in this order and
    sorted by name; both signatures if there are none. self and cls don't count."""
    names = lambda p: F.array_distinct(F.transform(F.filter(p, lambda x: ~x["name"].isin("self", "cls")), lambda x: x["name"]))
    last = lambda p, n: F.nullif(F.try_element_at(F.filter(p, lambda x: x["name"] == n), F.lit(-1))["default"], F.lit(""))
    shown = lambda v: F.when(v.isNull(), "None").when(F.contains(v, F.lit("'")) & ~F.contains(v, F.lit('"')), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("\\'")), F.lit("'")))
    listed = lambda text, found: F.when(F.size(found) > 0, F.concat(F.lit(text), F.array_join(F.array_sort(found), ", ")))
    both = F.array_sort(F.array_intersect(names(old), names(new)))
    moved = F.filter(both, lambda n: ~last(old, n).eqNullSafe(last(new, n)))
    lines = F.transform(moved, lambda n: F.concat(F.lit("- Parameter '"), n, F.lit("' default changed: "), shown(last(old, n)), F.lit(" → "), shown(last(new, n))))
    found = F.array_compact(F.concat(F.array(listed("- New parameters added: ", F.array_except(names(new), names(old))), listed("- Parameters removed: ", F.array_except(names(old), names(new)))), lines))
    neither = F.concat(F.lit("- Old signature: "), old_signature, F.lit("\n- New signature: "), new_signature, F.lit("\n- (Exact change not determined — tasks should test new parameter behaviour)"))
    return F.when(F.size(found) > 0, F.array_join(found, "\n")).otherwise(neither)


def leaf_variants(name: Column) -> Column:
    """Sorted spellings of a name's last segment: as it is, as lower-case words, run together, and the
    first two with s, ed, ing and er."""
    word = leaf(name)
    spaced = F.lower(F.replace(word, F.lit("_"), F.lit(" ")))
    ended = [F.concat(w, F.lit(end)) for w in (word, spaced) for end in ("s", "ed", "ing", "er")]
    return F.array_sort(F.array_distinct(F.array(word, spaced, F.lower(F.replace(word, F.lit("_"), F.lit(""))), *ended)))


def reconcile(listed: Column, described: Column) -> Column:
    """Parameters (name, type, default, description) of a list, gaps filled from the last of equal
    name in another; without a list the other as it is."""

    def fill(p):
        other = F.try_element_at(F.filter(described, lambda x: x["name"] == p["name"]), F.lit(-1))
        take = lambda field: F.coalesce(p[field], other[field]).alias(field)
        return F.struct(p["name"].alias("name"), take("type"), take("default"), take("description"))

    return F.when(F.size(listed) > 0, F.transform(listed, fill)).otherwise(described)


def scenario_result(stdout: Column, marker: str = "RESULT_DESC:") -> Column:
    """JSON after the first line that starts with a marker; null if there is none."""
    return F.nullif(F.regexp_extract(stdout, rf"(?m)^\s*{marker}(.*)$", 1), F.lit(""))


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading elements two arrays share."""
    most = F.least(F.size(a), F.size(b))
    upto = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(upto, lambda i: F.slice(a, 1, i) == F.slice(b, 1, i)))


ROLES = ["function", "exception", "enum", "protocol", "dataclass", "namedtuple", "typeddict", "plain_class"]


def api_role(kind: Column, class_role: Column) -> Column:
    """Role of an entry: function unless it is a class, whose unknown roles count as plain."""
    return F.when(kind != "class", "function").when(class_role.isin(ROLES), class_role).otherwise("plain_class")


def grounding(doc: Column, role: Column, path: Column, code: Column, least_code: int = 10, least_source: int = 15) -> Column:
    """What an explanation can rest on: papers that the docstring cites; the source of functions whose
    docstring lets one expect ``least_source`` lines, and of plain classes with a docstring of 200
    characters and ``least_code`` lines of code; else the docstring."""
    n = F.length(F.coalesce(doc, F.lit("")))
    expected = F.when(n > 500, 50).when(n > 200, 25).when(n > 50, 15).otherwise(5)
    lines = F.filter(F.split(F.coalesce(code, F.lit("")), r"\r?\n"), lambda x: ~F.regexp_like(x, F.lit(r"^\s*(#|$)")))
    return (
        F.when(F.size(citations(doc)) > 0, "paper")
        .when((role == "function") & (F.coalesce(path, F.lit("")) != "") & (expected >= least_source), "source")
        .when((role == "plain_class") & (n >= 200) & (F.size(lines) >= least_code), "source")
        .otherwise("docstring")
    )


STOCK_OPENINGS = [f"{a} {b} " for a in ("the", "this") for b in ("class", "component", "enum", "exception", "function", "protocol", "utility")]
STOCK_OPENINGS += [f"this {b} " for b in ("dataclass", "module", "named tuple", "namedtuple", "typed dict", "typeddict")]


def opens_with_stock_phrase(text: Column) -> Column:
    """Whether the first line that isn't blank opens with a stock phrase."""
    first = F.lower(strip(F.substring_index(strip(F.coalesce(text, F.lit(""))), "\n", 1)))
    return F.exists(F.lit(STOCK_OPENINGS), lambda p: F.startswith(first, p))


def holds_any(text: Column, phrases: list[str]) -> Column:
    """Whether a text holds one of some phrases, in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.lit(phrases), lambda p: F.contains(low, p))


def mentions(line: Column, api: Column) -> Column:
    """Whether a line names an API in full, or its leaf of more than four characters."""
    return F.contains(line, api) | (F.contains(line, leaf(api)) & (F.length(leaf(api)) > 4))


def clean_annotation(annotation: Column) -> Column:
    """The bare name of a class or enum shown by its repr; other annotations as they are, empty ones null."""
    inner = F.regexp_extract(strip(annotation), r"^<(?:class|enum) '([^']+)'>$", 1)
    return F.when(inner != "", leaf(inner)).otherwise(F.nullif(annotation, F.lit("")))


def return_type(value: Column, documented: Column, kind: Column, name: Column) -> Column:
    """A stated return type, unless it says nothing; else the documented one; else a class's own name."""
    said = strip(value.cast("string"))
    told = F.when(~F.lower(said).isin("", "null", "unknown", "n/a"), said)
    return F.coalesce(told, documented, F.when(kind == "class", name))


def parameter_lines(params: Column) -> Column:
    """One line for each parameter (name, type, default, description)."""
    some = lambda lead, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(lead), value)).otherwise("")
    line = lambda p: F.concat(F.lit("- "), p["name"], some(": ", p["type"]), F.coalesce(F.concat(F.lit(" = "), p["default"]), F.lit("")), some(" — ", F.left(p["description"], F.lit(160))))
    return F.array_join(F.transform(params, line), "\n")


def signature_text(params: Column) -> Column:
    """A signature of parameters (name, type, default)."""
    some = lambda lead, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(lead), value)).otherwise("")
    return F.concat(F.lit("("), F.array_join(F.transform(params, lambda p: F.concat(p["name"], some(": ", p["type"]), some(" = ", p["default"]))), ", "), F.lit(")"))


def number_examples(codes: Column) -> Column:
    """Code blocks under numbered headings."""
    return F.array_join(F.transform(codes, lambda c, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n```python\n"), c, F.lit("\n```"))), "\n\n")


def pick_layers(names: Column) -> Column:
    """Which of the scenarios that ran, in their order, the three test layers take: (first: one, pair:
    two to compare, last: one); null or empty where there are too few."""
    of = lambda prefix: F.filter(names, lambda n: F.startswith(n, F.lit(prefix)))
    at = lambda xs, k: F.get(xs, F.lit(k))
    basic, changed, edge = of("basic_"), of("changed_input_"), of("edge_")
    pair = (
        F.when((F.size(basic) > 0) & (F.size(changed) > 0), F.array(at(basic, 0), at(changed, 0)))
        .when(F.size(basic) > 1, F.slice(basic, 1, 2))
        .when(F.size(names) > 1, F.slice(names, 1, 2))
        .otherwise(F.array().cast(NO_STRINGS))
    )
    last = F.coalesce(at(edge, 0), at(basic, 1), at(names, 1))
    return F.struct(F.coalesce(at(basic, 0), at(names, 0)).alias("first"), pair.alias("pair"), last.alias("last"))


def join_fragments(*parts: Column) -> Column:
    """Fragments of a script that aren't empty, parted by blank lines."""
    return F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts])


def insert_after(script: Column, marker: str, fragment: Column) -> Column:
    """A script with a fragment after the first marker; unchanged without one."""
    at = F.instr(script, marker)
    cut = at + len(marker)
    return F.when(at > 0, F.concat(F.left(script, cut - 1), F.lit("\n"), fragment, F.substr(script, cut))).otherwise(script)


def portable(df: DataFrame) -> DataFrame:
    """df with the prefixes of installed packages' paths, in any text however deep, made <site-packages>/."""

    def clean(c: Column, kind) -> Column:
        if isinstance(kind, T.StringType):
            return F.regexp_replace(c, r"[\w./~-]*/lib/python3\.\d+/site-packages/", "<site-packages>/")
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: clean(v, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def path_rank(name: Column, scanned: Column, owner: Column) -> Column:
    """Rank of a place where an object was found, least is best: no private segment in the scanned
    module, which holds the defining one, the nearer the better; fewer segments; then by name."""
    parts = lambda x: F.when(F.coalesce(x, F.lit("")) != "", F.split(x, r"\.")).otherwise(F.array().cast(NO_STRINGS))
    scan, own = parts(scanned), parts(owner)
    matched = F.when(F.size(own) > 0, shared_prefix(scan, own)).otherwise(0)
    holds = (F.size(own) == 0) | (matched == F.size(scan))
    private = F.exists(scan, lambda x: F.startswith(x, F.lit("_")))
    return F.struct(private.cast("int").alias("p"), (~holds).cast("int").alias("a"), F.when(holds, -matched).otherwise(0).alias("m"), F.regexp_count(name, F.lit(r"\.")).alias("d"), name.alias("n"))
