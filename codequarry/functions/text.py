"""Column builders for paths, globs, lines and layers. All of them stay inside Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where str.splitlines() cuts.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

#: Layer to the order in which layers may use each other: only downwards, to a greater or equal number.
LAYERS = {"view": 0, "controller": 1, "middleware": 1, "service": 2, "repository": 3, "model": 4, "config": 5, "utility": 6, "migration": 7, "unknown": -1}

#: Directories that tell a layer.
LAYER_DIRS = {d: layer for layer, dirs in {
    "config": "config",
    "controller": "controllers controller requests request",
    "middleware": "middlewares middleware",
    "migration": "database/migrations migrations migration",
    "model": "models model",
    "repository": "repositories repository",
    "service": "services service",
    "utility": "utils util helpers helper",
    "view": "resources/views views view pages components",
}.items() for d in dirs.split()}

_CODE_DIRS = ("app", "database", "resources", "tests")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a shell glob; * crosses slashes. Valid in Java, Python and RE2."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = pattern.find("]", i + 1 if pattern[i : i + 1] != "!" else i + 2)
            if end < 0:
                out += "\\["
            else:
                inner = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[")
                out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
                i = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def matches_glob(path: Column, patterns: list[str]) -> Column:
    """Whether any of the globs matches the whole path (with forward slashes)."""
    regexes = [glob_regex(p) for p in patterns if p]
    return forward(path).rlike("|".join(f"(?:{r[4:]})" for r in regexes).join(["(?s)", ""])) if regexes else F.lit(False)


def forward(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def parts(path: Column) -> Column:
    """Non-empty parts of a path; a dot is no part."""
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))


def module_of(path: Column) -> Column:
    """First directory; the first two below code directories of frameworks; a file at the root is a module of its own."""
    p = parts(path)
    two = F.concat_ws("/", F.slice(p, 1, 2))
    return F.when(F.size(p) == 0, "root").when(p[0].isin(*_CODE_DIRS) & (F.size(p) >= 3), two).otherwise(F.try_element_at(p, F.lit(1)))


def layer_of(path: Column, custom: dict[str, str] | None = None) -> Column:
    """Layer by the longest directory pattern in the path; unknown layers of custom patterns are ignored."""
    patterns = LAYER_DIRS | {k.lower(): v.lower() for k, v in (custom or {}).items() if v.lower() in LAYERS}
    inside = F.concat(F.lit("/"), F.lower(forward(path)), F.lit("/"))
    ordered = sorted(patterns, key=len, reverse=True)
    # one small expression, which makes `inside` once; a CASE with a branch a pattern outgrows what generated code may hold
    known = F.array(*(F.lit(f"/{p}/") for p in ordered))
    found = F.transform(F.array(inside), lambda s: F.get(F.filter(known, lambda p: F.contains(s, p)), 0))[0]
    return F.coalesce(F.create_map(*(F.lit(x) for p in ordered for x in (f"/{p}/", patterns[p])))[found], F.lit("unknown"))


def layer_order(layer: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in LAYERS.items() for x in kv))[layer], F.lit(-1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1)


def parent(path: Column) -> Column:
    """Directory of a path; a dot for files at the root."""
    p = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(p == "", ".").otherwise(p)


def normalized(path: Column) -> Column:
    """A path without dots, empty parts, and parents that can be resolved."""
    return F.concat_ws("/", F.aggregate(parts(path), F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.concat(acc, F.array(x)))))


def last_segment(name: Column, separator: str = "\\") -> Column:
    return F.substring_index(name, separator, -1)


def lines(content: Column) -> Column:
    """The lines of a text as str.splitlines() gives them: without a last empty one."""
    all_ = F.split(content, LINE_BREAK)
    return F.when(content == "", F.array().cast("array<string>")).when(F.element_at(all_, -1) == "", F.slice(all_, F.lit(1), F.size(all_) - 1)).otherwise(all_)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def kebab(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1-$2"), "([A-Z]+)([A-Z][a-z])", "$1-$2"))


def _directories(path: Column, names: str) -> Column:
    return F.arrays_overlap(F.filter(F.split(path, "/"), lambda x: x != ""), F.array(*(F.lit(n) for n in names.split())))


_TEST_DIRS = "__tests__ fixtures test tests"
_TEST_ENDS = {"contracts": "test.php _test.py _test.rb _spec.rb", "dead_code": "test.php _test.py _test.rs", "hardwiring": "_spec.rb _test.rb _test.py test.php"}


def test_like(path: Column, kind: str = "contracts") -> Column:
    """Whether a path looks like test code. Detectors differ: kind is contracts, dead_code, hardwiring or external."""
    p = F.lower(forward(path))
    if kind == "external":
        return F.lower(path).rlike(r"/test|/spec|/fixture|test_|_test\.|\.spec\.")
    ends = "|".join(re.escape(e) for e in _TEST_ENDS[kind].split())
    return F.contains(stem(p), F.lit("test")) | _directories(p, _TEST_DIRS + (" spec" if kind != "dead_code" else "")) | p.rlike(f"(?:{ends})$")


LANGUAGES = {ext: lang for lang, exts in {"javascript": ".js .jsx", "php": ".php", "python": ".py", "ruby": ".rb", "rust": ".rs", "typescript": ".ts .tsx", "vue": ".vue"}.items() for ext in exts.split()}
UNSUPPORTED = {".cs": "csharp", ".go": "go", ".java": "java", ".kt": "kotlin"}


def language_of(path: Column) -> Column:
    """Language by extension, null if it isn't analysed."""
    return F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[F.lower(suffix(path))]
