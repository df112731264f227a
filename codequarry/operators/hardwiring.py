"""Hard-wired values: magic strings, entity names, network addresses, environment reads, literals repeated across files.

One table function reads every file once and yields findings and candidate literals; what needs more than a file, the
repeated literals, is an aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import literals as L
from codequarry.functions import text as T
from codequarry.policy import HardwiringPolicy
from codequarry.session import map_rows, write_shared

LANGUAGES = ("javascript", "php", "python", "ruby", "rust", "typescript", "vue")
FINDING = "file_path string, line int, category string, value string, context string, severity string, confidence string, suggestion string"

_ENTITY_MARK = r"(?:(?:->|::)?getEntityType\s*\(\)|entity_types|espoRaw(?:Target)?Type|in_progress_parent_type|(?:folder|parsed|root)EntityType|relatedEntity(?:Type)?|entity(?:Name|Types?)?|(?:parent|source|target)(?:_type|Entity|Type))"
_MARKED = re.compile(_ENTITY_MARK, re.I)
_BEFORE = re.compile(rf"{_ENTITY_MARK}[^\n]{{0,120}}(?:[!=]==?|\?\?=?|=>?|:)\s*$", re.I)
_AFTER = re.compile(rf"\s*[!=]==?\s*[^\n]{{0,120}}{_ENTITY_MARK}", re.I)
_SQL_WORDS = tuple(f"{w} " for w in "DELETE FROM INSERT JOIN SELECT UPDATE WHERE".split())
_ENV_CALLS = {
    "php": (re.compile(r"\benv\s*\("), re.compile(r"\benv\s*\(\s*[^,]+,\s*.+\)"), "env()", "Use config() instead of env() outside config files."),
    "python": (re.compile(r"\bos\.(?:environ(?:\.get)?|getenv)\s*[(\[]"), re.compile(r"\bos\.(?:environ\.get|getenv)\s*\(\s*[^,]+,\s*.+\)"), "env", "Read the environment in a settings module."),
    "ruby": (re.compile(r"""\bENV(?:\.fetch\s*\(|\s*\[)\s*["'][A-Z][A-Z0-9_]*["']"""), re.compile(r"\bENV\.fetch\s*\(\s*[^,]+,\s*.+\)"), "env", "Read the environment in a config object."),
    "rust": (re.compile(r"\b(?:option_env!\s*\(|(?:std::)?env(?:!\s*\(|::var(?:_os)?\s*\())"), None, "env", "Read the environment in a config layer."),
    "javascript": (re.compile(r"\b(?:import\.meta|process)\.env\b"), re.compile(r"""\b(?:import\.meta|process)\.env(?:\.[A-Z0-9_]+|\s*\[\s*["'][A-Z0-9_]+["']\s*\])\s*(?:\?\?|\|\|)"""), "env", "Read the environment in a typed config module."),
}
_JS_NAME = re.compile(r"\b(?:import\.meta|process)\.env\.([A-Z0-9_]+)\b")


def magic_strings(path: str, content: str, policy: HardwiringPolicy) -> Iterator[tuple]:
    """Candidates; those that are declared as contracts or entities are taken out by joins."""
    if L.in_globs(path, policy.magic_string_skip_path_patterns):
        return
    unwanted = {x.lower() for x in policy.low_signal_literals}
    signal, noise = ([re.compile(p, re.I) for p in x if p] for x in (policy.magic_string_signal_context_regexes, policy.magic_string_noise_context_regexes))
    recent: list[str] = []
    for no, line in L.code_lines(content):
        found = [(m.group(1) or m.group(2), False) for m in L.COMPARED.finditer(line)] + [(m.group(1), True) for m in L.CASE.finditer(line)] if L.quoted(line) else []
        context = "\n".join([*recent, line]) if found else ""
        for value, case in found:
            signalled = not signal or any(p.search(line) or p.search(context) for p in signal)
            plain = L.simple(value.strip()) and not L.compound(value.strip())
            if (L.noise_switch(recent, noise) if case else L.noise_line(line, recent, noise)) or L.styling(line, value) or L.marker_context(value, context) or plain and not signalled:
                continue
            if not L.magic(value, path, policy.magic_string_min_length, unwanted):
                continue
            strong = case or L.compound(value.strip())
            if L.contract_like(path, context, value):
                confidence = "medium" if strong else "low"
            else:
                confidence = "high" if strong else "medium"
            yield path, no, "magic_string", value, line.strip(), "high", confidence, f"Extract {'case label ' * case}'{value}' into a class constant or enum."
        if line.strip():
            recent = [*recent[-2:], line.strip()]


def entity_names(path: str, content: str, policy: HardwiringPolicy) -> Iterator[tuple]:
    """Literals where an entity is meant; a join keeps those that are one."""
    p = L.forward(path)
    low = p.lower()
    if any(d in p for d in ("/Entities/", "/i18n/", "/lang/")) or L.is_entity_noise(p) or "/migrat" in low and ("/migration" in low or "/migrate" in low) or "migration" in L.name_of(p).rsplit(".", 1)[0] or "espo_migration" in low or "Make" in p and "Command" in p:
        return
    need, allow = ([re.compile(x) for x in y if x] for y in (policy.entity_context_require_regexes, policy.entity_context_allow_regexes))
    for no, line in L.code_lines(content):
        if not L.quoted(line) or not need and not _MARKED.search(line):
            continue
        if re.search(r"\bconst\s+\w+\s*=", line) or any(x.search(line) for x in allow) or L.displayed(line) or any(w in line.strip().upper() for w in _SQL_WORDS):
            continue
        found = list(L.LITERAL.finditer(line))
        needed = any(x.search(line) for x in need)
        if len(found) > 2 and not needed:
            continue
        for m in found:
            value = m["text"]
            before = line[max(0, m.start() - 160) : m.start()]
            before = before[max(before.rfind(c) for c in ",;{") + 1 :]
            if needed or _BEFORE.search(before) or _AFTER.match(line[m.end() : m.end() + 120]):
                yield path, no, "hardcoded_entity", value, line.strip(), "high", "high", f"Replace hardcoded entity name '{value}' with {value}::getEntityType() or a domain constant."


def network(path: str, content: str) -> Iterator[tuple]:
    p = L.forward(path)
    if p.startswith("config/") or "/config/" in p:
        return
    for no, line in enumerate(content.splitlines(), 1):
        if L.COMMENT.match(line):
            continue
        for m in L.IP.finditer(line) if line.count(".") > 2 else ():
            if m.group() not in L.BENIGN_IPS:
                yield path, no, "hardcoded_ip_url", m.group(), line.strip(), "medium", "medium", f"Move IP address '{m.group()}' to configuration."
        for m in L.URL.finditer(line) if "://" in line else ():
            url = m.group(1)
            if L.not_runtime(url, line, path) or "config(" in line and "??" not in line:
                continue
            confidence = L.network_confidence(url, line)
            yield path, no, "hardcoded_ip_url", url, line.strip(), "high" if confidence == "high" else "medium", confidence, "Move URL to configuration or environment variable."


def environment(path: str, content: str, language: str, policy: HardwiringPolicy) -> Iterator[tuple]:
    p = L.forward(path)
    if p.startswith("config/") or "/config/" in p or L.is_bootstrap(p) or L.is_config(p) or L.is_test(p) or "testing" in p.lower():
        return
    call, default, value, suggestion = _ENV_CALLS.get(language, _ENV_CALLS["javascript"])
    web = language not in ("php", "python", "ruby")
    if not call.search(content) and not (language == "rust" and _ENV_CALLS["javascript"][0].search(content)):
        return
    allowed = {x.upper() for x in policy.js_env_allow_names}
    for no, line in enumerate(content.splitlines(), 1):
        if L.COMMENT.match(line) or "'env()'" in line or '"env()"' in line:
            continue
        kinds = [(call, default, value, suggestion)]
        if language == "rust":
            kinds.append(_ENV_CALLS["javascript"])
        for call_, default_, value_, suggestion_ in kinds:
            if not call_.search(line):
                continue
            if web and call_ is _ENV_CALLS["javascript"][0] and (m := _JS_NAME.search(line)) and m.group(1).upper() in allowed:
                continue
            if default_ is not None and L.is_command(p) and not default_.search(line):
                continue
            yield path, no, "env_outside_config", value_, line.strip(), "high", "high", suggestion_
            break


def literals(path: str, content: str, policy: HardwiringPolicy) -> Iterator[tuple[str, int]]:
    unwanted = {x.lower() for x in policy.low_signal_literals}
    skip = [re.compile(x) for x in policy.repeated_literal_skip_regexes]
    for no, line in L.code_lines(content):
        for m in L.LITERAL.finditer(line) if L.quoted(line) else ():
            value = m["text"]
            if not L.styling(line, value) and L.repeatable(value, max(2, policy.repeated_literal_min_length), unwanted, policy.repeated_literal_require_compound, skip):
                yield value, no


def entity_types(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(value): names of classes below a directory Entities."""
    return symbols.filter("type = 'class'").join(files.filter(F.col("path").ilike("%/Entities/%")).select("file_id"), "file_id", "left_semi").select(F.col("name").alias("value")).distinct()


def scan(files: DataFrame, policy: HardwiringPolicy | None = None, only: str | None = None) -> DataFrame:
    """Candidates of single files, and rows of category literal, which repeated_literals() takes. files: (path, language, content).

    only: the one category that is wanted; other detectors don't run.
    """
    policy = policy or HardwiringPolicy()
    wanted = lambda category: only in (None, category)

    def run(rows: Iterable[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for path, language, content in rows:
            if content is None or L.is_test(path) or L.in_globs(path, policy.skip_path_patterns):
                continue
            text = L.script_only(path, content)
            if wanted("magic_string"):
                out += magic_strings(path, text, policy)
            if language == "php" and wanted("hardcoded_entity"):
                out += entity_names(path, text, policy)
            if wanted("hardcoded_ip_url"):
                out += network(path, text)
            if wanted("env_outside_config"):
                out += environment(path, text, language, policy)
            if wanted("literal"):
                out += [(path, no, "literal", value, "", "", "", "") for value, no in literals(path, text, policy)]
        return out

    return map_rows(files.filter(F.col("language").isin(*LANGUAGES)).select("path", "language", "content"), run, FINDING)


def repeated_literals(found: DataFrame, policy: HardwiringPolicy | None = None, min_occurrences: int = 3) -> DataFrame:
    """Literals (file_path, line, value) in enough files and directories, as findings at their first place."""
    policy = policy or HardwiringPolicy()
    least = max(min_occurrences, 2, policy.repeated_literal_min_occurrences)
    place = F.struct("file_path", "line")
    counted = found.groupBy("value").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"), F.count_distinct(T.parent(F.col("file_path"))).alias("dirs"))
    counted = counted.filter((F.col("files") >= least) & (F.col("dirs") >= max(1, policy.repeated_literal_min_distinct_dirs)))
    first = Window.partitionBy("value").orderBy("file_path", "line")
    some = found.join(counted.select("value"), "value", "left_semi").withColumn("k", F.row_number().over(first)).filter("k <= 5")
    some = some.groupBy("value").agg(F.sort_array(F.collect_list(place)).alias("at"))
    v = F.trim("value")
    high = v.rlike("^/(?:admin|api|etc|home|opt|srv|var)/")
    medium = v.startswith(".") & (F.col("files") >= 3) & (F.col("dirs") >= 2) | v.rlike("[-._:/]") & (F.col("files") >= 4) & (F.col("dirs") >= 3)
    samples = F.array_join(F.transform("at", lambda x: F.concat(x["file_path"], F.lit(":"), x["line"].cast("string"))), ", ")
    more = F.when(F.col("n") > 5, F.concat(F.lit(" ... and "), (F.col("n") - 5).cast("string"), F.lit(" more"))).otherwise("")
    return counted.join(some, "value").select(
        F.col("at")[0]["file_path"].alias("file_path"), F.col("at")[0]["line"].cast("int").alias("line"), F.lit("repeated_literal").alias("category"), "value",
        F.concat(F.lit("Found in "), F.col("files").cast("string"), F.lit(" files: "), samples, more).alias("context"), F.lit("medium").alias("severity"),
        F.when(high, "high").when(medium, "medium").otherwise("low").alias("confidence"), F.concat(F.lit("Extract repeated literal '"), "value", F.lit("' into a shared constant (appears in "), F.col("files").cast("string"), F.lit(" files).")).alias("suggestion"),
    )


def hardwiring(files: DataFrame, symbols: DataFrame, contracts: DataFrame, policy: HardwiringPolicy | None = None, min_occurrences: int = 3) -> DataFrame:
    """All findings. contracts: (category, value). Files are read once; what is declared is taken out by joins, none of which is broadcast by an estimate."""
    names = entity_types(files, symbols)
    rows = write_shared(scan(files, policy), "scanned").withColumn("_value", T.strip(F.col("value")))
    entity = rows.filter("category = 'hardcoded_entity'").join(names.hint("merge"), "value", "left_semi")
    other = rows.filter("category <> 'hardcoded_entity'")
    magic = F.col("category") == "magic_string"
    open_ = other.filter(F.col("category").isin("magic_string", "literal")).join(contracts.select(F.col("value").alias("_value")).distinct().hint("merge"), "_value", "left_anti")
    open_ = open_.filter(~magic).unionByName(open_.filter(magic).join(names.select(F.col("value").alias("_value")).hint("merge"), "_value", "left_anti").select(*open_.columns))
    rows = other.filter(~F.col("category").isin("magic_string", "literal")).unionByName(entity.select(*rows.columns)).unionByName(open_.select(*rows.columns)).drop("_value")
    return rows.filter("category <> 'literal'").unionByName(repeated_literals(rows.filter("category = 'literal'"), policy, min_occurrences))
