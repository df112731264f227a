"""A small lexer for the languages without a parser here: comments and strings are blanked, everything keeps its place."""

from __future__ import annotations

import re

_STRINGS = r"""'(?:\\.|[^'\\])*(?:'|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)"""
_SKIP = {
    "php": re.compile(rf"//[^\n]*|\#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)|<<<[ \t]*(['\"]?)(\w+)\1\r?\n.*?\n[ \t]*\2\b|{_STRINGS}", re.S),
    "ruby": re.compile(rf"(?m:^=begin\b.*?^=end\b)|\#[^\n]*|{_STRINGS}", re.S),
    "rust": re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|b?r(\#*)".*?"\1|'(?:\\.[^']*|[^'\\\n])'|"(?:\\.|[^"\\])*(?:"|\Z)""", re.S),
    "web": re.compile(rf"//[^\n]*|/\*.*?(?:\*/|\Z)|{_STRINGS.replace('[^', '[^' + chr(92) + 'n')}|`(?:\\.|[^`\\])*(?:`|\Z)", re.S),
}


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def mask(content: str, language: str) -> str:
    """The content with comments and strings as blanks. What template strings substitute stays."""

    def hide(m: re.Match[str]) -> str:
        t = m.group()
        if t[0] != "`":
            return _blank(t)
        out, at = "", 0
        for inner in re.finditer(r"\$\{[^{}]*\}", t):
            out += _blank(t[at : inner.start()]) + " (" + inner.group()[2:-1] + ")"
            at = inner.end()
        return out + _blank(t[at:])

    return _SKIP[language if language in _SKIP else "web"].sub(hide, content)


_PAIRS = {pair: re.compile("[" + re.escape(pair) + "]") for pair in ("{}", "()", "[]")}
_NESTED = re.compile(r"[\"'()\[\]{}]")


def closing(code: str, at: int, pair: str = "{}") -> int:
    """Place of the bracket that closes the one at `at`; the end of the code if none does."""
    depth = 0
    for m in _PAIRS[pair].finditer(code, at):
        depth += 1 if m.group() == pair[0] else -1
        if not depth:
            return m.start()
    return len(code)


def end_before(code: str, at: int) -> int:
    """Where the text before `at` ends, white space left out."""
    while at and code[at - 1].isspace():
        at -= 1
    return at


def line_of(content: str, at: int) -> int:
    return content.count("\n", 0, at) + 1


def split_top(text: str, separator: str = ",") -> list[str]:
    """Parts at separators outside brackets and quotes; empty ones are left out."""
    if not _NESTED.search(text):
        return [p.strip() for p in text.split(separator) if p.strip()]
    parts, depth, start, quote, i = [], 0, 0, "", 0
    while i < len(text):
        c = text[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        elif c == separator and not depth:
            parts.append(text[start:i])
            start = i + 1
        i += 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def kebab(name: str) -> str:
    s = re.sub("([A-Z]+)([A-Z][a-z])", r"\1-\2", re.sub("([a-z0-9])([A-Z])", r"\1-\2", name))
    return s.replace("_", "-").lower()


def rust_paths(path: str) -> list[tuple[str, str]]:
    """(bound name, full path) of what follows `use`, braces expanded."""
    path = path.strip()
    if m := re.fullmatch(r"(.*?)\s+as\s+(\w+)", path, re.S):
        if "{" not in path or path.rstrip()[-1] != "}":
            return [(m.group(2), re.sub(r"\s", "", m.group(1)))]
    start, end = path.find("{"), path.rfind("}")
    if start < 0 or end < start:
        plain = re.sub(r"\s", "", path)
        return [(plain.rsplit("::", 1)[-1], plain)] if plain else []
    head = path[:start].rstrip(": \n\t")
    out = []
    for item in split_top(path[start + 1 : end]):
        if item == "self":
            out.append((head.rsplit("::", 1)[-1], head))
        elif item != "*":
            out += rust_paths(item if not head or item.startswith(("crate::", "self::", "super::")) else f"{head}::{item}")
    return out


RUST_USE = re.compile(r"\buse\s+([^;]+);")


def rust_uses(content: str) -> tuple[list[tuple[str, str, int]], set[str]]:
    """Bound names with targets and lines, and the identifiers that stand outside of use declarations."""
    code = mask(content, "rust")
    bound = [(n, t, line_of(code, m.start())) for m in RUST_USE.finditer(code) for n, t in rust_paths(m.group(1))]
    return bound, set(re.findall(r"(?<![.\w])[A-Za-z_]\w*", RUST_USE.sub(" ", code)))


JS_IMPORT = re.compile(r"""(?m)(?:^|(?<=[;}]))[ \t]*import\s+(?:(type)\s+(?!from\b))?([\w$*{},\s]+?)\s+from\s*(["'])([^"'\n]+)\3|(?:^|(?<=[;}]))[ \t]*import\s*(["'])([^"'\n]+)\5""")
_BRACKET_OR_NAME = re.compile(r"[()\[\]{}]|(?<![\w$#])[A-Za-z_$][\w$]*")


def js_imports(content: str) -> tuple[list[tuple[str, str, int]], set[str]]:
    """Bound names with sources and lines, and the identifiers used elsewhere: neither properties after a dot nor keys of objects."""
    code = mask(content, "web")
    bound, spans = [], []
    for m in JS_IMPORT.finditer(content):
        if not code[m.start() : m.end()].strip().startswith("import"):
            continue
        spans.append(m.span())
        if not m.group(2):
            continue
        clause, line = m.group(2), line_of(content, m.end() - len(m.group().lstrip()))
        line = line_of(content, m.start() + len(m.group()) - len(m.group().lstrip()))
        named = re.search(r"\{([^}]*)\}", clause)
        for item in split_top(re.sub(r"\{[^}]*\}", "", clause)) + (split_top(named.group(1)) if named else []):
            words = re.findall(r"[\w$]+", item)
            if words:
                bound.append((words[-1], m.group(4), line))
    for a, b in reversed(spans):
        code = code[:a] + _blank(code[a:b]) + code[b:]
    used: set[str] = set()
    stack: list[str] = []
    for m in _BRACKET_OR_NAME.finditer(code):
        t = m.group()
        if t in "([{":
            stack.append(t)
        elif t in ")]}":
            if stack:
                stack.pop()
        else:
            if t in used:
                continue
            left = end_before(code, m.start())
            before = code[max(0, left - 3) : left]
            if before[-1:] == "." and before[-3:] != "..." or before[-2:] == "?.":
                continue
            after = code[m.end() : m.end() + 20].lstrip()
            if after[:1] == ":" and stack[-1:] == ["{"] and before[-1:] in ("{", ","):
                continue
            used.add(t)
    return bound, used


def vue_scripts(content: str) -> list[tuple[str, int]]:
    """Inline scripts of a single-file component, with the lines before each."""
    return [(m.group(2), content.count("\n", 0, m.start(2))) for m in re.finditer(r"(?is)<script\b([^>]*)>(.*?)</script>", content) if not re.search(r"\bsrc\s*=", m.group(1)) and m.group(2).strip()]
