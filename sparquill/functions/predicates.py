"""Quality predicates of catalogue entries, as Column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import leaf, strip

#: Openings of texts that come from a base class or a builtin, or say nothing.
THIN_OPENINGS = [
    "todo", "fixme", "xxx:", "note:", "thanks to chatgpt", "str(object=", "dict() -> new empty dictionary",
    "abstract base class for", "base class for protocol classes", "base class for all neural network modules",
    *[f"common base class for all {kind}exceptions" for kind in ("", "non-exit ")],
    *[f"implement {verb}attr(self, name{more})" for verb, more in (("get", ""), ("set", ", value"))],
    "information about how to convert command line strings",
    "helper class that provides a standard way to create an abc",
]
#: Names that libraries take over from the standard library.
ALIASES = sorted(
    "Any Callable ClassVar Dict FrozenSet Generator Generic Iterable Iterator List Literal Mapping NamedTuple Optional Protocol Sequence Set Tuple Type TypedDict TypeVar Union".split()
    + "date datetime time timedelta timezone".split()
)
PLUMBING = ["_compat", "_internal", "_lib", "_utils", "_vendor", "_vendored", "array_api_compat"]
INTERNAL = ["base", "impl", "internals", "main"]
VENDORED = ["pandas.io.clipboard"]
#: Parameters that tell nothing about a callable.
PLAIN_PARAMETERS = ["args", "cls", "kwargs", "self"]
INFORMATIVE = ["a", "cols", "dtype", "dtypes", "exc", "h", "idx", "items", "keys", "len", "r", "s", "shape", "v"]
GENERIC_CONSTRUCTORS = [f"(self, {mid}*args, **{name})" for mid, name in (("", "kwds"), ("", "kwargs"), ("/, ", "kwargs"))]


def is_private(name: Column) -> Column:
    """The last segment starts with an underscore."""
    return F.startswith(leaf(name), F.lit("_"))


def is_deprecated(doc: Column) -> Column:
    """The docstring calls the entry deprecated, announces its removal or names what to use instead."""
    return F.regexp_like(F.coalesce(doc, F.lit("")), F.lit(r"(?i)\bdeprecated\b|will be removed|use .+ instead"))


def is_thin(doc: Column, least: int = 40) -> Column:
    """Short docstring, or one whose first paragraph opens with a stock phrase. Both show in a text's head, if
    that is long enough when stripped; only else is the whole text looked at."""
    doc = F.coalesce(doc, F.lit(""))
    longest = max(map(len, THIN_OPENINGS))
    opening = "^(?:" + "|".join(map(re.escape, THIN_OPENINGS)) + ")"
    first = lambda d: F.lower(strip(F.regexp_replace(F.substring_index(d, "\n\n", 1), r"(?U)\s+", " ")))
    opens = lambda d: F.regexp_like(first(d), F.lit(opening))
    head = strip(F.left(doc, F.lit(4 * max(least, longest))))
    short = (F.length(head) < least) & (F.length(strip(doc)) < least)
    told = F.contains(head, F.lit("\n\n")) | (F.length(first(head)) >= longest)
    return short | F.when(told, opens(head)).otherwise(opens(strip(doc)))


def has_no_source(path: Column) -> Column:
    """No source file, or a compiled one."""
    return path.isNull() | F.regexp_like(F.lower(path), F.lit(r"\.(so|pyd|dll)$"))


def is_vendored(name: Column, prefixes: list[str] = VENDORED) -> Column:
    """The entry lies in a vendored subpackage."""
    return F.exists(F.lit(prefixes), lambda p: F.startswith(name, F.concat(p, F.lit("."))))


def is_self_private(doc: Column) -> Column:
    """The docstring starts by calling the entry private or internal."""
    return F.regexp_like(F.coalesce(doc, F.lit("")), F.lit(r"(?i)^\s*(private|internal)\b"))


def is_foreign(path: Column, package: str) -> Column:
    """The package, if any is named, is no segment of the source path; without a path false."""
    if not package:
        return F.lit(False)
    return F.coalesce(~F.array_contains(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), package), F.lit(False))


def has_internal_module(name: Column, internal: list[str] = INTERNAL) -> Column:
    """Three segments and more, the last but one an internal module's name."""
    s = F.split(name, r"\.")
    return (F.size(s) >= 3) & F.coalesce(F.try_element_at(s, F.lit(-2)).isin(internal), F.lit(False))


def is_plumbing(path: Column, name: Column, internal: list[str] = PLUMBING) -> Column:
    """The source lies in an internal folder below site-packages, and its folders share no segment
    with the public module, none of whose segments is private. Package and leaf don't count."""
    mark = "site-packages/"
    at = F.instr(path, mark)
    folders = lambda x, sep: F.slice(F.split(x, sep), 1, F.size(F.split(x, sep)) - 1)
    inside = folders(F.substr(path, at + len(mark)), "/")
    public = folders(name, r"\.")
    rest = lambda x: F.filter(x, lambda _, i: i > 0)
    found = F.arrays_overlap(inside, F.lit(internal)) & ~F.exists(public, lambda x: F.startswith(x, F.lit("_"))) & ~F.arrays_overlap(rest(inside), rest(public))
    return F.coalesce((at > 0) & found, F.lit(False))


def is_type_alias(kind: Column, n_params: Column, doc: Column, name: Column, aliases: list[str] = ALIASES) -> Column:
    """A function or method with neither parameters nor docstring, or a class with an alias's name."""
    bare = kind.isin("function", "method") & (n_params == 0) & (F.coalesce(doc, F.lit("")) == "")
    return bare | ((kind == "class") & leaf(name).isin(aliases))


def reject_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, else null."""
    return F.coalesce(*[F.when(rule, name) for name, rule in rules])


def drop_reason(has_file_io: Column, statuses: Column, implementation: Column, n_params: Column, mechanism: Column, longest: int = 12_000) -> Column:
    """Why a knowledge record is dropped, else null: rules in order."""
    code = F.when(F.length(implementation) <= longest, implementation).otherwise("")
    return reject_reason(
        [
            ("file_io", has_file_io),
            ("no_valid_example", ~F.exists(statuses, lambda s: s.isin("executed", "static"))),
            ("no_implementation", F.coalesce(code, F.lit("")) == ""),
            ("empty_s_param", n_params == 0),
            ("empty_mechanism", strip(F.coalesce(mechanism, F.lit(""))) == ""),
        ]
    )


def gate_novel(fails: Column, least: int) -> Column:
    """Enough failed samples; fewer samples than asked is an error."""
    enough = F.size(F.filter(fails, lambda x: x)) >= least
    return F.when(F.size(fails) < least, F.raise_error(F.lit("fewer samples than the threshold")).cast("boolean")).otherwise(enough)


def gate_solved(n_passed: Column, least: int = 1) -> Column:
    """Passes reached; a task without a record passes."""
    return F.coalesce(n_passed >= least, F.lit(True))


def quality_score(doc: Column, params: Column) -> Column:
    """Length of the docstring times the number of telling parameters, at least 1."""
    telling = F.filter(params, lambda p: ~p["name"].isin(PLAIN_PARAMETERS))
    return (F.length(F.coalesce(doc, F.lit(""))) * F.greatest(F.lit(1), F.size(telling))).cast("double")


def catalogue_rules(package: str, least: int = 40, internal: list[str] = INTERNAL, patterns: list[str] = ()) -> list[tuple[str, Column]]:
    """All rules for entries (name, kind, params, doc, path), in order: the first that holds is why an entry goes."""
    name, kind, doc, path = map(F.col, ("name", "kind", "doc", "path"))
    return [
        ("private", is_private(name)),
        ("deprecated", is_deprecated(doc)),
        ("type_alias", is_type_alias(kind, F.size("params"), doc, name)),
        ("undocumented", F.coalesce(doc, F.lit("")) == ""),
        ("thin", is_thin(doc, least)),
        ("no_source", has_no_source(path)),
        ("plumbing", is_plumbing(path, name)),
        ("vendored", is_vendored(name)),
        ("self_private", is_self_private(doc)),
        ("foreign", is_foreign(path, package)),
        ("internal_module", has_internal_module(name, internal)),
        *[(f"pattern_{i}", F.regexp_like(leaf(name), F.lit(p))) for i, p in enumerate(patterns)],
    ]


def apply_filters(entries: DataFrame, package: str, **options) -> DataFrame:
    """The entries that no rule rejects."""
    return entries.filter(reject_reason(catalogue_rules(package, **options)).isNull())


def is_informative(keys: Column) -> Column:
    """Whether a fingerprint's keys tell something about its value."""
    return F.coalesce(F.arrays_overlap(keys, F.lit(INFORMATIVE)), F.lit(False))


def without_parameters(params: Column, stop: list[str] = (*PLAIN_PARAMETERS, "*args", "**kwargs")) -> Column:
    """Parameters whose names aren't in a stop list."""
    return F.filter(params, lambda p: ~p["name"].isin(list(stop)))


def example_status(passed: Column, timed_out: Column, stderr: Column, stdout: Column, resource: list[str], library: list[str]) -> Column:
    """executed if it ran, static if only its surroundings stopped it, else failed."""
    blob = F.concat_ws("\n", F.coalesce(stderr, F.lit("")), F.coalesce(stdout, F.lit("")))
    marked = F.exists(F.lit([*resource, *library]).cast("array<string>"), lambda m: F.contains(blob, m))
    return F.when(passed, "executed").when(timed_out | marked, "static").otherwise("failed")


def recheck(samples: Column) -> tuple[Column, Column]:
    """Of sample verdicts: whether any passed, and how many have none."""
    return F.coalesce(F.exists(samples, lambda s: s), F.lit(False)), F.size(F.filter(samples, lambda s: s.isNull()))


def is_supported(kind: Column, name: Column, doc: Column, signature: Column, n_params: Column, n_examples: Column) -> Column:
    """False for classes that only name values: a generic constructor, nothing known, and a name or text that says so."""
    text = strip(F.coalesce(doc, F.lit("")))
    builtin = F.exists(F.lit(["str(", "int(", "float(", "bytes(", "tuple(", "list(", "dict(", "set("]), lambda p: F.startswith(text, p))
    named = F.regexp_like(leaf(name), F.lit("(Name|Enum|Type|Mode)$"))
    generic = strip(F.coalesce(signature, F.lit(""))).isin(GENERIC_CONSTRUCTORS)
    return ~(F.coalesce(kind == "class", F.lit(False)) & generic & (n_params == 0) & (n_examples == 0) & (named | builtin))


def task_reject_reason(api: Column, difficulty: Column, description: Column, reference: Column, masked: Column, difficulties: list[str]) -> Column:
    """Why a proposed task isn't taken, else null."""
    told, solved = strip(F.coalesce(description, F.lit(""))), strip(F.coalesce(reference, F.lit("")))
    code = F.concat(strip(F.coalesce(masked, F.lit(""))), solved)
    return reject_reason(
        [
            ("difficulty", ~F.coalesce(difficulty.isin(difficulties), F.lit(False))),
            ("empty", (told == "") | (solved == "")),
            ("names_api", F.contains(F.lower(told), F.lower(leaf(api)))),
            ("unused_api", ~F.contains(code, api) & ~F.contains(code, leaf(api))),
        ]
    )


def is_bypass_candidate(passed: Column, label: Column, call_check_failed: Column) -> Column:
    """A failure by selection that isn't the call check's."""
    return (passed == 0) & (label == "WrongAPISelection") & (call_check_failed == 0)
