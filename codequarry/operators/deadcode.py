"""Dead code: imports, private members and classes that nothing uses.

What one file tells is found by one table function a file; classes meet all that names them in one shuffle.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import text as T
from codequarry.functions.literals import in_globs, stem_of
from codequarry.policy import DeadCodePolicy
from codequarry.session import in_child, map_rows, write_shared
from codequarry.sources import extract as X
from codequarry.sources import tokens as K

FINDING = "file_path string, line int, category string, name string, detail string, confidence string"
LANGUAGES = ("javascript", "php", "python", "rust", "typescript", "vue")
WEB = ("javascript", "typescript", "vue")


def is_test(path: str) -> bool:
    p = path.replace("\\", "/").lower()
    return "test" in stem_of(p) or not {"__tests__", "fixtures", "test", "tests"}.isdisjoint(p.split("/")) or p.endswith(("_test.py", "_test.rs", "test.php"))


def line_at(lines: list[str], no: int) -> str:
    return lines[no - 1] if 0 < no <= len(lines) else ""


# imports

_PREAMBLE = ("#[", "*", "/*", "//", "<?", "declare(", "namespace ", "use ")


def php_body(content: str) -> str:
    """What follows the leading run of opening tag, namespace, imports and comments."""
    lines, start = content.split("\n"), 0
    for i, line in enumerate(lines):
        if line.strip():
            if not line.strip().startswith(_PREAMBLE):
                break
            start = i + 1
    return "\n".join(lines[start:])


def _named(content: str, body: str) -> tuple[set[str], set[str], set[str]]:
    """Words of attributes, of documented types (in lower case) and of the body: what a search for each name would find, in one pass for all."""
    documented = {w.lower() for m in re.finditer(r"(?i)@(?:extends|implements|method|param|property|return|template|throws|var)\b([^\n]*)", content) for w in re.findall(r"\w+", m.group(1))}
    return set(re.findall(r"#\[\s*(\w+)[(:\s]", content)), documented, set(re.findall(r"\w+", body))


def php_imports(path: str, content: str, imports: list[tuple[str, int]], implicit: list[str]) -> Iterator[tuple]:
    lines, body = content.splitlines(), php_body(content)
    ascii_, sets = content.isascii(), None
    aliases = {m.group(1): m.group(2) for m in re.finditer(r"(?m)^\s*use\s+([\w\\]+)\s+as\s+(\w+)\s*;", content)}
    for target, no in imports:
        *_, short = target.split("\\")
        name = aliases.get(target, short)
        line = line_at(lines, no)
        if short in implicit or not re.match(r"\s*use\s+[\w\\]+(?:\s+as\s+\w+)?\s*;", line):
            continue
        # expressions made of names cost more than all the rest, so they are left to texts beyond ASCII, where case isn't told by lower()
        if ascii_ and re.fullmatch(r"\w+", name, re.A):
            sets = sets or _named(content, body)
            if name in re.findall(r"\w+", line) and not (name in sets[0] or name.lower() in sets[1] or name in sets[2]):
                yield path, no, "unused_import", target, f"Import '{target}' (as {name}) not found in file body", "high"
            continue
        word = re.escape(name)
        if not re.search(rf"\b{word}\b", line):
            continue
        attribute = re.search(rf"#\[\s*{word}[(:\s]", content)
        documented = re.search(rf"(?i)@(?:extends|implements|method|param|property(?:-read|-write)?|return|template|throws|var)\b[^\n]*\b{word}\b", content)
        if not (attribute or documented or re.search(rf"\b{word}\b", body)):
            yield path, no, "unused_import", target, f"Import '{target}' (as {name}) not found in file body", "high"


def python_imports(path: str, content: str) -> Iterator[tuple]:
    if (tree := X.parse(content)) is None:
        return
    nodes = list(ast.walk(tree))
    used = {n.id for n in nodes if isinstance(n, ast.Name)}
    lists = [n.value for n in nodes if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) or isinstance(n, ast.AugAssign) and isinstance(n.target, ast.Name) and n.target.id == "__all__"]
    exported = {e.value for v in lists if isinstance(v, ast.List | ast.Tuple | ast.Set) for e in v.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}
    confidence = "low" if path.replace("\\", "/").rsplit("/", 1)[-1] == "__init__.py" else "high"
    for node in nodes:
        if isinstance(node, ast.Import):
            for alias in node.names:
                bound = alias.asname or alias.name.split(".")[0]
                if alias.name != "__future__" and bound not in used:
                    yield path, node.lineno, "unused_import", alias.name, f"Import '{alias.name}' binds '{bound}', which is never referenced", confidence
        elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
            for alias in node.names:
                bound = alias.asname or alias.name
                if alias.name != "*" and bound not in used and bound not in exported:
                    yield path, node.lineno, "unused_import", f"{node.module}.{alias.name}" if node.module else alias.name, f"Import '{bound}' from '{node.module or '.'}' is never referenced", confidence


def rust_imports(path: str, content: str) -> Iterator[tuple]:
    if is_test(path):
        return
    uses, used = K.rust_uses(content)
    for name, target, line in dict.fromkeys(uses):
        if name not in used:
            yield path, line, "unused_import", target, f"Import '{name}' from '{target}' is never referenced", "high"


def web_imports(path: str, content: str, language: str) -> Iterator[tuple]:
    if is_test(path) or path.endswith(".d.ts"):
        return
    blocks, shown = [(content, 0)], ""
    if language == "vue":
        blocks = K.vue_scripts(content)
        shown = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1>", "\n", content)
    for block, offset in blocks:
        bound, used = K.js_imports(block)
        for name, source, line in dict.fromkeys(bound):
            if name in used or shown and (re.search(rf"\b{re.escape(name)}\b", shown) or (k := K.kebab(name)) != name and re.search(rf"<\s*/?\s*{re.escape(k)}\b", shown)):
                continue
            yield path, line + offset, "unused_import", name, f"Import '{name}' from '{source}' is never referenced", "medium" if language == "vue" else "high"


# private members


def _elsewhere(content: str, patterns: list[str], declared: int) -> bool:
    return any(content.count("\n", 0, m.start()) + 1 != declared for p in patterns for m in re.finditer(p, content))


def private_member(path: str, content: str, language: str, kind: str, name: str, no: int) -> tuple | None:
    """The finding for a private method or property that its file never uses."""
    name = name.lstrip("#")
    word, line = re.escape(name), line_at(content.splitlines(), no)
    if kind == "method":
        declared = rf"\bfunction\s+{word}\s*\(|\b(?:abstract|async|final|get|private|protected|public|readonly|set|static)\b[^\n{{;]*\b{word}\s*\(|\b(?:pub(?:\([^)]*\))?\s+)?fn\s+{word}\s*\(|\#{word}\s*\("
        if name.startswith("__") or not re.search(declared, line):
            return None
        uses = [rf"\b{word}\s*\(", rf"(?:\[|array\s*\()\s*(?:\$this|__CLASS__|self::class|static::class)\s*,\s*[\"']{word}[\"']"]
        if language in WEB:
            uses.append(rf"\bthis\.#?{word}\b")
        if language == "rust":
            uses.append(rf"(?:\.\s*|::){word}\s*\(")
        if re.search(rf"\b(?:get|set)\s+{word}\b", line):
            uses += [rf"\bthis\.{word}\b", rf"->{word}\b"]
        return None if _elsewhere(content, uses, no) else (path, no, "unused_method", name, f"'{name}' is private and its file never calls it", "high")
    if language in WEB:
        declared, uses = rf"\b(?:private|protected|public|readonly|static)\b[^\n=;]*\b{word}\b|\#{word}\b", [rf"\bthis\.#?{word}\b"]
    elif language == "rust":
        declared, uses = rf"\b(?:pub(?:\([^)]*\))?\s+)?{word}\s*:", [rf"\.{word}\b(?!\s*\()", rf"\b{word}\s*:"]
    else:
        declared, uses = rf"\b(?:private|protected|public|readonly|static|var)\b[^\n;]*\${word}\b", [rf"->{word}\b", rf"\${word}\b"]
    if not re.search(declared, line) or _elsewhere(content, uses, no):
        return None
    return path, no, "unused_property", name, f"'{name}' is private and its file only declares it", "medium"


def judge(path: str, language: str, content: str, imports: list[tuple[str, int]], private: list[tuple[str, str, int]], implicit: list[str]) -> list[tuple]:
    """Findings of one file, by its imports (target, line) and private members (type, name, line)."""
    out: list[tuple] = []
    if language == "php":
        out += php_imports(path, content, imports, implicit)
    elif language == "python":
        out += python_imports(path, content)
    elif language == "rust":
        out += rust_imports(path, content)
    elif language in WEB:
        out += web_imports(path, content, language)
    return out + [found for x in private if (found := private_member(path, content, language, *x))]


def in_texts(files: DataFrame, policy: DeadCodePolicy | None = None) -> DataFrame:
    """in_file() by what the texts declare themselves: each is extracted and judged in one reading, and moved nowhere."""
    implicit = list((policy or DeadCodePolicy()).attribute_usage_names)

    def work(rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for path, language, content in rows:
            if content is not None:
                found = X.extract_file(path, language, content)
                imports = sorted((line, target) for type_, target, line in found.deps if type_ == "import")
                private = sorted((s[4], s[0], s[1]) for s in found.symbols if s[3] == "private" and s[0] in ("method", "property"))
                out += judge(path, (language or "").lower(), content, [(t, n) for n, t in imports], [(k, name, n) for n, k, name in private], implicit)
        return out

    def run(rows: Iterable[tuple]) -> list[tuple]:
        some = list(rows)
        return in_child(work, some) if X.keeps_names(some) else work(some)

    return map_rows(files.select("path", "language", "content"), run, FINDING)


def in_file(files: DataFrame, symbols: DataFrame, dependencies: DataFrame, policy: DeadCodePolicy | None = None) -> DataFrame:
    """Unused imports and private members. Each file comes once, with its own imports and private members beside its text."""
    policy = policy or DeadCodePolicy()
    implicit = list(policy.attribute_usage_names)
    imports = dependencies.filter("type = 'import'").groupBy(F.col("source_file_id").alias("file_id")).agg(F.sort_array(F.collect_list(F.struct("line", F.col("target_name").alias("target")))).alias("imports"))
    members = symbols.filter("visibility = 'private' and type in ('method', 'property')").groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct(F.col("line_start").alias("line"), "type", "name"))).alias("members"))
    rows = files.filter("content is not null").select("file_id", "path", F.lower("language").alias("language"), "content").join(imports.hint("merge"), "file_id", "left").join(members.hint("merge"), "file_id", "left")

    def work(rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for path, language, content, own, private in rows:
            out += judge(path, language, content, [(x["target"], x["line"]) for x in own or ()], [(x["type"], x["name"], x["line"]) for x in private or ()], implicit)
        return out

    def run(rows: Iterable[tuple]) -> list[tuple]:
        some = list(rows)
        return in_child(work, some) if X.keeps_names(some) else work(some)

    return map_rows(rows.select("path", "language", "content", "imports", "members"), run, FINDING)


# classes

ENTRY_DIRS = "Actions Casts Commands Console Controllers Entities Events Exceptions Hooks Jobs Listeners Mail Middleware Models Notifications Observers Policies Providers Rules Tests bootstrap controllers factories hooks migrations seeders tests"
DYNAMIC_GLOBS = "**/*ServiceProvider.php **/routes/**/*.php **/module.php **/manifest.php **/bootstrap/**/*.php **/Module.php **/Manifest.php **/*.hooks.php **/*.hook.php".split()
_NAME, _PATH = "[A-Z][A-Za-z0-9_]*", r"[A-Z][A-Za-z0-9_]*(?:\\[A-Z][A-Za-z0-9_]*)+"


def dynamic_tokens(content: str) -> set[str]:
    """Classes that hooks, manifests and routes name, in full and short."""
    found = [m for p in (rf"\\?({_PATH})::class\b", rf"\b({_NAME})::class\b", r"\b(?:extends|implements|instanceof|new)\s+\\?([A-Z][A-Za-z0-9_\\]*)\b", rf"[\"'](\\?{_PATH})[\"']") for m in re.findall(p, content)]
    full = {m.lstrip("\\") for m in found}
    return full | {m.rsplit("\\", 1)[-1] for m in full}


_NAMESPACE = re.compile(r"(?m)^\s*namespace\s+([^;]+);")
#: What a use of a class needs, its expression where the name is given in full, and where it is short.
_RUNTIME = (
    ("::class", re.compile(rf"(?<![\w\\])\\?({_PATH})::class\b"), re.compile(rf"(?<![\w\\])({_NAME})::class\b")),
    ("new", re.compile(rf"\bnew\s+\\?({_PATH})\b"), re.compile(rf"\bnew\s+({_NAME})\b")),
    ("#[", re.compile(rf"#\[\s*\\?({_PATH})\b"), re.compile(rf"#\[\s*({_NAME})\b")),
)
_STRING = re.compile(r"[\"']([A-Z][A-Za-z0-9_\\]{2,})[\"']")


def runtime_tokens(content: str) -> set[str]:
    """Classes in constructions, attributes and ::class, with the file's namespace where they have none."""
    full, short = set(), set()
    for word, whole, last in _RUNTIME:
        if word in content:
            full.update(whole.findall(content))
            short.update(last.findall(content))
    m = _NAMESPACE.search(content) if short and "namespace" in content else None
    space = m.group(1).strip() if m else ""
    return full | short | ({f"{space}\\{x}" for x in short} if space else set())


def string_tokens(content: str) -> set[str]:
    """Names of classes that stand in strings; only those of known classes count."""
    return {m.lstrip("\\") for m in _STRING.findall(content)} if "'" in content or '"' in content else set()


#: What a file says of classes: those it declares (token: the full name), and the names it uses, each once a batch, with the least and greatest file that has it.
#: kind is class, used, string or rust (identifiers), target (of a dependency that uses a class) or load (of any other).
FACT = "kind string, token string, low long, high long, name string, path string, language string, type string, line int, candidate boolean"
REFERENCES = ("kind", "token", "low", "high")
CLASSES = ("class", "enum", "interface", "trait")
USES = ("implement", "import", "inherit", "register")
RUST_WORDS = {"class": "struct", "interface": "trait"}


class References:
    """The names that a batch of files uses, with the least and greatest file of each."""

    def __init__(self) -> None:
        self.found: dict[tuple[str, str], tuple[int, int]] = {}

    def add(self, kind: str, token: str, file: int) -> None:
        low, high = self.found.get((kind, token), (file, file))
        self.found[kind, token] = min(low, file), max(high, file)

    def add_tokens(self, path: str, language: str, content: str, file: int, globs: list[str]) -> None:
        if language == "rust":
            for t in set(re.findall(r"\b[A-Z][A-Za-z0-9_]*\b", content)):
                self.add("rust", t, file)
        elif language == "php":
            for t in runtime_tokens(content) | (dynamic_tokens(content) if in_globs(path, globs) else set()):
                self.add("used", t, file)
            for t in string_tokens(content):
                self.add("string", t, file)

    def rows(self) -> list[tuple]:
        return [(*key, *files) for key, files in self.found.items()]


def reference_tokens(files: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """REFERENCES of kind used, string and rust from one reading of each PHP and Rust file."""
    globs = [*DYNAMIC_GLOBS, *(patterns or [])]

    def run(rows: Iterable[tuple]) -> list[tuple]:
        out = References()
        for file, path, language, content in rows:
            out.add_tokens(path, language, content, file, globs)
        return out.rows()

    wanted = files.select("file_id", "path", F.lower("language").alias("language"), "content").filter("language in ('php', 'rust') and content is not null")
    return map_rows(wanted, run, "kind string, token string, low long, high long")


@lru_cache(maxsize=4)
def _declared(line: str) -> set[tuple[str, str]]:
    return {(m.group(1), m.group(2)) for m in re.finditer(r"\b(class|enum|interface|struct|trait)(?=[ \t\n\x0b\f\r]+(\w+))", line)}


def declares(line: str, word: str, name: str) -> bool:
    """Whether the line has the word, then the name. Those of a line are read once, however many classes stand on it."""
    if re.fullmatch(r"\w+", name):
        return (word, name) in _declared(line)
    return re.search(rf"\b{word}[ \t\n\x0b\f\r]+{re.escape(name)}\b", line) is not None


def class_facts(files: DataFrame, policy: DeadCodePolicy | None = None, compat: bool = False) -> DataFrame:
    """FACT of files (file_id, path, language, content): what abandoned_classes() needs of texts and index, from one reading of each text."""
    policy = policy or DeadCodePolicy()
    globs = [*DYNAMIC_GLOBS, *policy.abandoned_dynamic_reference_patterns]
    allowed = _allowed(policy)

    def work(rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        names = References()
        for file, path, language, content in rows:
            if content is None:
                continue
            found, lower = X.extract_file(path, language, content), (language or "").lower()
            names.add_tokens(path, lower, content, file, globs)
            for type_, target, _ in found.deps:
                names.add("target" if type_ in USES else "load", target, file)
            classes = [x for x in found.symbols if x[0] in CLASSES] if lower in allowed else []
            lines = content.splitlines() if classes else []
            for type_, name, space, visibility, start, *_ in classes:
                word = RUST_WORDS.get(type_, type_) if compat or lower == "rust" else type_
                candidate = (lower != "rust" or visibility == "public") and declares(line_at(lines, start), word, name)
                out.append(("class", f"{space}\\{name}" if space else name, file, file, name, path, lower, type_, start, candidate))
        return out + [(*x, None, None, None, None, None, None) for x in names.rows()]

    def run(rows: Iterable[tuple]) -> list[tuple]:
        some = list(rows)
        return in_child(work, some) if X.keeps_names([x[1:] for x in some]) else work(some)

    return map_rows(files.select("file_id", "path", "language", "content"), run, FACT)


def _allowed(policy: DeadCodePolicy) -> list[str]:
    return [x.strip().lower() for x in policy.abandoned_languages if x.strip()]


def _shapes(known: DataFrame) -> DataFrame:
    return known.withColumn("key", F.lower("name")).withColumn("shape", F.transform(F.split("key", "_"), F.length))


def _ends(known: DataFrame, targets: DataFrame) -> DataFrame:
    """(shape, key, a, b): the ends of targets (token, low, high) in each shape of `known`, with the least and greatest file that has them."""
    targets = targets.groupBy(F.lower("token").alias("target")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    shapes = known.select("shape").distinct().withColumn("size", F.expr("aggregate(shape, size(shape) - 1, (n, x) -> n + x)"))
    starts = F.expr("transform(sequence(1, size(shape)), i -> struct(aggregate(slice(shape, 1, i - 1), i, (n, x) -> n + x) AS at, shape[i - 1] AS run))")
    # broadcast: a row for each shape
    cut = targets.crossJoin(F.broadcast(shapes.withColumn("runs", starts))).filter("length(target) >= size").withColumn("tail", F.expr("right(target, size)"))
    cut = cut.select("shape", F.expr("array_join(transform(runs, r -> substring(tail, r.at, r.run)), '_')").alias("key"), "low", "high")
    return cut.groupBy("shape", "key").agg(F.min("low").alias("a"), F.max("high").alias("b"))


def suffix_referenced(names: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(name, file_id) pairs of `names` that end a dependency's target of another file, as SQL's LIKE has it: any case, _ for any sign.

    A name's shape is where its _ stand from the end. Targets are cut to each shape that names have, with _ in the same places, and
    meet names as wholes; of a target, whole or cut, only the least and the greatest source count, so that no key has many rows.
    """
    known = _shapes(names.select("name", "file_id"))
    ends = _ends(known, dependencies.select(F.col("target_name").alias("token"), F.col("source_file_id").alias("low"), F.col("source_file_id").alias("high")))
    return known.join(ends.hint("merge"), ["shape", "key"]).filter("a <> file_id or b <> file_id").select("name", "file_id").distinct()


def _unreferenced(facts: DataFrame, policy: DeadCodePolicy) -> DataFrame:
    """The candidates among classes that no reference names; facts is a written table of FACT.

    All that can name a class ends in its name, so classes and references meet in one shuffle by the last part of a name: a target
    names every class of that name, and so does a string that is a class's full name; other uses name the class that they give in full.
    """
    kinds = ["class", "rust", "string", "target", *(["used"] if "php" in _allowed(policy) else [])]
    met = facts.filter(F.col("kind").isin(kinds)).withColumn("short", F.when(F.col("kind") == "class", F.col("name")).otherwise(T.last_segment(F.col("token"))))
    met = met.repartition("short")  # for both windows
    whole, short = Window.partitionBy("short", "token"), Window.partitionBy("short")
    met = met.withColumn("a_class", F.max(F.expr("kind = 'class'")).over(whole)).withColumn("in_full", F.max(F.expr("kind = 'used'")).over(whole))
    by_name = F.expr("kind = 'target' or kind in ('string', 'used') and token = short or kind = 'string' and a_class")
    met = met.withColumn("by_name", F.max(by_name).over(short))
    rust = lambda c: F.when(F.col("kind") == "rust", F.col(c))
    met = met.withColumn("first", F.min(rust("low")).over(short)).withColumn("last", F.max(rust("high")).over(short))
    left = met.filter("kind = 'class' and candidate and not in_full and not by_name").filter("language <> 'rust' or coalesce(first = low and last = low, true)")
    left = left.filter(~T.test_like(F.col("path"), "dead_code"))
    inside = F.concat(F.lit("/"), T.forward(F.col("path")))
    entry = inside.rlike("/(?:" + "|".join(ENTRY_DIRS.split()) + ")/")
    for pattern in policy.abandoned_entry_patterns:
        entry = entry | (T.matches_glob(F.col("path"), [pattern]) if any(c in pattern for c in "*?[") else F.contains(inside, F.lit(pattern)))
    left = left.filter(~entry).select("name", F.col("token").alias("full"), F.col("low").alias("file_id"), "path", "language", "type", "line")
    left = _shapes(write_shared(left, "unreferenced"))  # their shapes, then they themselves
    ends = _ends(left, facts.filter("kind in ('target', 'load')"))
    return left.join(ends.hint("merge"), ["shape", "key"], "left").filter("coalesce(a = file_id and b = file_id, true)").drop("shape", "key", "a", "b")


def _abandoned(left: DataFrame) -> DataFrame:
    detail = F.concat(F.initcap("type"), F.lit(" '"), "name", F.lit("' has no external references"))
    return left.select(F.col("path").alias("file_path"), F.col("line").cast("int").alias("line"), F.lit("abandoned_class").alias("category"), F.col("full").alias("name"), detail.alias("detail"), F.lit("medium").alias("confidence"))


def abandoned_in_texts(files: DataFrame, policy: DeadCodePolicy | None = None, compat: bool = False) -> DataFrame:
    """abandoned_classes() by what the texts declare themselves: each is read once and moved nowhere."""
    return _abandoned(_unreferenced(write_shared(class_facts(files, policy, compat), "classes"), policy or DeadCodePolicy()))


def abandoned_classes(files: DataFrame, symbols: DataFrame, dependencies: DataFrame, policy: DeadCodePolicy | None = None, compat: bool = False) -> DataFrame:
    """Classes that no other file names.

    compat: look for struct and trait where a class or an interface is declared, whatever the language, as Rust has them.
    """
    policy = policy or DeadCodePolicy()
    allowed = _allowed(policy)
    home = files.select("file_id", "path", F.lower("language").alias("language"))
    classes = symbols.filter(F.col("type").isin(*CLASSES)).join(home.hint("merge"), "file_id").filter(F.col("language").isin(*allowed) if allowed else F.lit(False))
    full = F.when(F.coalesce(F.col("namespace"), F.lit("")) != "", F.concat("namespace", F.lit("\\"), "name")).otherwise(F.col("name"))
    public = F.coalesce(F.expr("language <> 'rust' or lower(visibility) = 'public'"), F.lit(False))
    facts = classes.select(F.lit("class").alias("kind"), full.alias("token"), F.col("file_id").alias("low"), F.col("file_id").alias("high"), "name", "path", "language", "type", F.col("line_start").cast("int").alias("line"), public.alias("candidate"))
    needed = F.when(F.col("type").isin(*USES), "target").otherwise("load")
    targets = dependencies.select(needed.alias("kind"), F.col("target_name").alias("token"), F.col("source_file_id").alias("low"), F.col("source_file_id").alias("high"))
    names = targets.unionByName(reference_tokens(files, policy.abandoned_dynamic_reference_patterns))
    left = _unreferenced(write_shared(facts.unionByName(names, allowMissingColumns=True), "classes"), policy)
    word = F.col("type")
    for a, b in RUST_WORDS.items():
        word = F.when((F.col("type") == a) & (F.lit(True) if compat else F.col("language") == "rust"), b).otherwise(word)
    line = F.get(T.lines(F.col("content")), F.col("line") - 1)
    declared = left.withColumn("word", word).join(files.select("file_id", "content").hint("merge"), "file_id").withColumn("text", line).filter(F.expr(r"text rlike concat('\\b', word, '\\s+\\Q', name, '\\E\\b')"))
    return _abandoned(declared)


def dead_code(files: DataFrame, symbols: DataFrame, dependencies: DataFrame, policy: DeadCodePolicy | None = None, compat: bool = False) -> DataFrame:
    """All findings. files: (file_id, path, language, content)."""
    return in_file(files, symbols, dependencies, policy).unionByName(abandoned_classes(files, symbols, dependencies, policy, compat))
