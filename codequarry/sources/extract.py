"""Symbols and dependencies of source files: one table function over (path, language, content).

Python has its own parser. The others are read by declarations in code whose comments and strings are blanked, with bodies by
matching brackets (Ruby: by matching `end`).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.session import in_child, map_rows
from codequarry.sources import tokens as K

CONTAINERS = ("class", "enum", "interface", "module", "trait")
METADATA = "struct<class: string, extends: string, implements: array<string>, params: array<string>, return_type: string, has_self: boolean>"
ROW = f"path string, kind string, ord int, type string, name string, namespace string, visibility string, line_start int, line_end int, metadata {METADATA}, home struct<type: string, name: string, line_start: int, ord: int>"


@dataclass
class Found:
    """What a file declares and needs, in the order of the text."""

    symbols: list[tuple] = field(default_factory=list)
    deps: list[tuple[str, str, int]] = field(default_factory=list)

    def symbol(self, type_: str, name: str, start: int, end: int, namespace: str | None = None, visibility: str = "public", **meta) -> None:
        self.symbols.append((type_, name, namespace or None, visibility, start, end, meta))

    def dep(self, type_: str, target: str, line: int) -> None:
        if target:
            self.deps.append((type_, target, line))


# Python


def python_module(path: str) -> tuple[str, str]:
    """(module, package) of a path."""
    parts = [p for p in re.sub(r"\.py$", "", path.replace("\\", "/")).split("/") if p and p != "."]
    if parts[-1:] == ["__init__"]:
        return ".".join(parts[:-1]), ".".join(parts[:-1])
    return ".".join(parts), ".".join(parts[:-1])


def _expr(node: ast.AST | None) -> str | None:
    match node:
        case ast.Name():
            return node.id
        case ast.Attribute():
            owner = _expr(node.value)
            return f"{owner}.{node.attr}" if owner else node.attr
        case ast.Subscript():
            return _expr(node.value)
        case ast.Call():
            return _expr(node.func)
        case ast.Constant(value=str()):
            return node.value
        case ast.Tuple():
            return ", ".join(filter(None, map(_expr, node.elts))) or None
    return None


def _signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
    a = node.args
    params = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)] + [mark + x.arg for mark, x in (("*", a.vararg), ("**", a.kwarg)) if x]
    return {"params": params or None, "return_type": _expr(node.returns)}


@lru_cache(maxsize=1)
def parse(content: str) -> ast.Module | None:
    """The tree of a Python file, for all that read it one after the other."""
    try:
        return ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return None


def keeps_names(rows: list[tuple]) -> bool:
    """Whether there is Python among (path, language, ...): its parser keeps names for as long as the process lives."""
    return any((r[1] or "").lower() == "python" for r in rows)


def python(path: str, content: str) -> Found:
    out = Found()
    if (tree := parse(content)) is None:
        return out
    body = tree.body
    module, package = python_module(path)
    end = lambda n: n.end_lineno or n.lineno
    functions = (ast.AsyncFunctionDef, ast.FunctionDef)
    for node in body:
        if isinstance(node, ast.Import):
            for alias in node.names:
                out.dep("import", alias.name, node.lineno)
        elif isinstance(node, ast.ImportFrom):
            base = node.module or ""
            if node.level:
                above = [p for p in package.split(".") if p]
                base = ".".join([*above[: max(0, len(above) - node.level + 1)], *filter(None, base.split("."))])
            for alias in node.names:
                out.dep("import", base if alias.name == "*" else ".".join(filter(None, (base, alias.name))), node.lineno)
        elif isinstance(node, functions):
            out.symbol("function", node.name, node.lineno, end(node), module, **_signature(node))
        elif isinstance(node, ast.ClassDef):
            out.symbol("class", node.name, node.lineno, end(node), module)
            for base in node.bases:
                out.dep("inherit", _expr(base) or "", node.lineno)
            for child in node.body:
                if isinstance(child, functions):
                    n = child.name
                    seen = "private" if n.startswith("__") and not n.endswith("__") else "protected" if n.startswith("_") else "public"
                    out.symbol("method", n, child.lineno, end(child), module, seen, **{"class": node.name}, **_signature(child))
                elif isinstance(child, ast.Assign | ast.AnnAssign):
                    for target in child.targets if isinstance(child, ast.Assign) else [child.target]:
                        if isinstance(target, ast.Name):
                            out.symbol("property", target.id, child.lineno, end(child), module, **{"class": node.name})
    return out


# PHP

_NAMES = r"\\?[A-Za-z_][\w\\]*"
_PHP_TYPE = re.compile(rf"(?<![\w$>:])(?:(?:abstract|final|readonly)\s+)*(class|interface|trait|enum)\s+([A-Za-z_]\w*)([^{{;]*)\{{")
_PHP_FUNCTION = re.compile(r"((?:\b(?:abstract|final|private|protected|public|readonly|static)\s+)*)\bfunction\s+&?\s*([A-Za-z_]\w*)\s*\(")
_PHP_PROPERTY = re.compile(r"(?:(?<=[;{}\]])|^)\s*((?:(?:private|protected|public|readonly|static|var)\s+)+)(?:\??[\w\\|&]+\s+)?(\$\w+[^;({]*);", re.M)
_PHP_USE = re.compile(r"\buse\s+(?:function\s+|const\s+)?([\w\\]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w\\]+(?:\s+as\s+\w+)?)*|[\w\\]+\{[^}]*\})\s*;")
_PHP_NAMESPACE = re.compile(r"\bnamespace\s+([\w\\]+)\s*[;{]")
_PHP_BASES = {w: re.compile(rf"\b{w}\s+((?:{_NAMES}[\s,]*)+?)(?=\bimplements\b|$)") for w in ("extends", "implements")}
_PHP_NAME = re.compile(_NAMES)
_PHP_REST = re.compile(r"[^{;]*")
_PHP_RETURNS = re.compile(r"\s*:\s*([\w\\|&?\s]+)")
_PHP_LOAD = re.compile(r"\b(?:include|require)(?:_once)?\b([^;]+);", re.I)
_CALLBACK = r"(?:\[|array\s*\()\s*"
_CLASS_STRING = r"[\"']([A-Z][\w\\]+)[\"']"
_PHP_CLASS_STRINGS = (
    re.compile(rf"{_CALLBACK}{_CLASS_STRING}\s*,\s*[\"'][A-Za-z_]\w*[\"']", re.A),
    re.compile(rf"\b(?:(?:class|enum|interface|trait)_exists|is_a|is_subclass_of)\s*\(\s*{_CLASS_STRING}", re.A),
    re.compile(rf"\b\w*?(?:create|get|load|make|resolve)\w*\s*\(\s*{_CLASS_STRING}", re.A),
)
_CALLBACK_TAKERS = set("add_action add_filter add_menu_page add_shortcode add_submenu_page register_activation_hook register_deactivation_hook register_shutdown_function register_uninstall_hook set_error_handler set_exception_handler".split())
_PHP_CALL = re.compile(r"([$A-Za-z_\\][\w$\\]*\s*(?:(?:->|::)\s*[A-Za-z_]\w*)?)\s*\(", re.A)
_SPACE = re.compile(r"\s")
_MEMBER_OF = re.compile("->|::")
_TYPE_WORDS = ("class", "interface", "trait", "enum")
_REGISTERS = ("attach", "bind", "command", "hook", "listen", "observe", "on", "register", "route", "schedule", "subscribe")


def _php_visibility(words: str) -> str:
    return next((w for w in ("private", "protected", "public") if w in words.split()), "unknown")


def _arguments(content: str, at: int) -> str | None:
    """What stands between the parenthesis at `at` and its partner, quotes being passed over."""
    depth, quote, i = 0, "", at
    while i < len(content):
        c = content[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return content[at + 1 : i]
        i += 1
    return None


def php_registrations(content: str, out: Found) -> None:
    """Classes and functions that calls hand to hooks, events, routes and the like."""
    if "(" not in content:
        return
    for m in _PHP_CALL.finditer(content):
        callee = _SPACE.sub("", m.group(1))
        low = callee.lower()
        name = _MEMBER_OF.split(callee)[-1].lower() if "->" in callee or "::" in callee else low.rsplit("\\", 1)[-1]
        if not (name in _CALLBACK_TAKERS or "route::" in low or "router->" in low or "router::" in low or name.startswith(_REGISTERS) or name.endswith(("callback", "handler"))):
            continue
        arguments = K.split_top(_arguments(content, m.end() - 1) or "")
        found: list[str] = []
        for a in arguments:
            found += [x.lstrip("\\") for x in re.findall(r"\b([A-Z][\w\\]+)::class\b", a)]
            if c := re.search(rf"{_CALLBACK}(?:([A-Z][\w\\]+)::class|{_CLASS_STRING})\s*,\s*[\"'][A-Za-z_]\w*[\"']", a):
                found.append((c.group(1) or c.group(2)).lstrip("\\"))
        if name in _CALLBACK_TAKERS:
            found += [f.group(1) for a in arguments[1:] if (f := re.fullmatch(r"[\"']([A-Za-z_]\w*)[\"']", a))]
        for target in dict.fromkeys(found):
            out.dep("register", target, K.line_of(content, m.start()))


def _each(pattern: re.Pattern[str], text: str, *words: str) -> Iterable[re.Match[str]]:
    """All matches of a pattern that needs one of the words, which are looked for first: most texts have few of them."""
    return pattern.finditer(text) if any(w in text for w in words) else ()


def php(path: str, content: str) -> Found:
    out, code = Found(), K.mask(content, "php")
    line = lambda at: K.line_of(content, at)
    spaces = [(m.start(), m.group(1).strip()) for m in _each(_PHP_NAMESPACE, code, "namespace")]
    space = lambda at: next((n for s, n in reversed(spaces) if s < at), None)
    bodies = []
    for m in _each(_PHP_TYPE, code, *_TYPE_WORDS):
        end = K.closing(code, m.end() - 1)
        kind, name, head = m.group(1), m.group(2), m.group(3)
        start = line(m.start())
        bodies.append((m.end(), end, name, kind))
        names = {w: _PHP_NAME.findall((p.search(head) or [""])[0][len(w) :]) for w, p in _PHP_BASES.items()}
        meta = {}
        if kind == "class" and names["extends"]:
            meta["extends"] = names["extends"][-1]
            for x in names["extends"]:
                out.dep("inherit", x, start)
        if kind == "class" and names["implements"]:
            meta["implements"] = names["implements"]
            for x in names["implements"]:
                out.dep("implement", x, start)
        out.symbol(kind, name, start, line(end), space(m.start()), **meta)
    bodies.sort(key=lambda b: b[1] - b[0])
    owner = lambda at: next((b for b in bodies if b[0] <= at < b[1]), None)
    for m in _each(_PHP_FUNCTION, code, "function"):
        close = K.closing(code, m.end() - 1, "()")
        rest = _PHP_REST.match(code, close + 1).group() if close < len(code) else ""
        stop = close + 1 + len(rest)
        end = K.closing(code, stop) if code[stop : stop + 1] == "{" else stop
        meta = {"params": [re.sub(r"\s+", " ", p) for p in K.split_top(content[m.end() : close])] or None}
        if t := _PHP_RETURNS.match(rest):
            meta["return_type"] = t.group(1).strip()
        at = m.start() + len(m.group()) - len(m.group().lstrip())
        home = owner(m.start())
        if home and home[3] in ("class",):
            out.symbol("method", m.group(2), line(at), line(end), space(at), _php_visibility(m.group(1)), **{"class": home[2]}, **meta)
        elif not home:
            out.symbol("function", m.group(2), line(at), line(end), space(at), **meta)
    for m in _each(_PHP_PROPERTY, code, "$") if bodies else ():
        home = owner(m.start(1))
        if home and home[3] == "class":
            for name in re.findall(r"\$(\w+)\s*(?=[=,]|$)", re.sub(r"\[[^\]]*\]|\([^)]*\)", "", m.group(2))):
                out.symbol("property", name, line(m.start(1)), line(m.end()), space(m.start(1)), _php_visibility(m.group(1)), **{"class": home[2]})
    for m in _each(_PHP_USE, code, "use"):
        if owner(m.start()) is None:
            text = m.group(1)
            items = [text.split("{")[0] + x for x in K.split_top(text[text.index("{") + 1 : -1])] if "{" in text else K.split_top(text)
            for item in items:
                out.dep("import", re.split(r"\s+as\s+", item)[0].strip(), line(m.start()))
    for m in _PHP_LOAD.finditer(content) if ".php" in content else ():
        target = "".join(x.strip() for x in re.findall(r"[\"']([^\"']+?\.php)[\"']", m.group(1)))
        out.dep("load", re.sub("/{2,}", "/", target.replace("\\", "/")).lstrip("/"), line(m.start()))
    for pattern in _PHP_CLASS_STRINGS if "'" in content or '"' in content else ():
        for m in _each(pattern, content, "[", "("):
            out.dep("import", m.group(1).lstrip("\\"), line(m.start()))
    php_registrations(content, out)
    return out


# Ruby

_CONSTANT = r"(?:::)?[A-Z]\w*(?:::[A-Z]\w*)*"
_RUBY_CONSTANT = re.compile(rf"(?<![\w:.@$]){_CONSTANT}")
_RUBY_TYPE = re.compile(rf"(module|class)\s+({_CONSTANT})(?:\s*<\s*({_CONSTANT}))?")
_RUBY_DEF = re.compile(r"def\s+(self\.)?([a-zA-Z_]\w*[?!=]?)\s*(?:\(([^)]*)\))?")
_RUBY_LOAD = re.compile(r"(?:require|require_relative|require_dependency)\b")
_RUBY_MIXIN = re.compile(rf"(?:extend|include|prepend)\s*\(?\s*({_CONSTANT})")
_RUBY_CLOSE = re.compile(r"end\b")
_RUBY_ENDED = re.compile(r"\bend\s*$")
_RUBY_ENDLESS = re.compile(r"def\s+\S+(?:\([^)]*\))?\s*=\s")
_RUBY_OPEN = re.compile(r"^\s*(?:begin|case|class|def|for|if|module|unless|until|while)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*(?:if|case|begin|unless)\b")


def ruby(path: str, content: str) -> Found:
    out, code = Found(), K.mask(content, "ruby")
    raw = content.split("\n")
    stack: list[tuple[str, str, int | None, int]] = []  # kind, full name, place among symbols, line
    full = lambda: next((s[1] for s in reversed(stack) if s[0] in ("module", "class")), "")
    for no, line in enumerate(code.split("\n"), 1):
        text = line.strip()
        rest = line
        if m := _RUBY_TYPE.match(text):
            name = m.group(2).lstrip(":")
            whole = name if "::" in name or not full() else f"{full()}::{name}"
            space, _, short = whole.rpartition("::")
            meta = {}
            if m.group(1) == "class" and m.group(3):
                meta["extends"] = m.group(3).lstrip(":")
                out.dep("inherit", meta["extends"], no)
            out.symbol(m.group(1), short, no, no, space, **meta)
            if not _RUBY_ENDED.search(text):
                stack.append((m.group(1), whole, len(out.symbols) - 1, no))
            continue
        if m := _RUBY_DEF.match(text):
            owner = full().rsplit("::", 1)[-1]
            if not m.group(1):
                meta = {"params": K.split_top(m.group(3) or "") or None}
                out.symbol("method" if owner else "function", m.group(2), no, no, full(), **meta, **({"class": owner} if owner else {}))
            if not _RUBY_ENDED.search(text) and not _RUBY_ENDLESS.match(text):
                stack.append(("def", "", len(out.symbols) - 1 if not m.group(1) else None, no))
            rest = text[m.end() :]
        elif _RUBY_LOAD.match(text):
            if t := re.search(r"[\"']([^\"']+)[\"']", raw[no - 1]):
                out.dep("load", t.group(1), no)
            continue
        elif m := _RUBY_MIXIN.match(text):
            out.dep("implement", m.group(1).lstrip(":"), no)
            continue
        else:
            if _RUBY_CLOSE.match(text):
                if stack:
                    kind, _, place, _ = stack.pop()
                    if place is not None:
                        s = out.symbols[place]
                        out.symbols[place] = (*s[:5], no, s[6])
            elif _RUBY_OPEN.search(line) and not _RUBY_ENDED.search(text):
                stack.append(("block", "", None, no))
        for c in _RUBY_CONSTANT.finditer(rest):
            name = c.group().lstrip(":")
            if name != "ENV":
                out.dep("import", name, no)
    return out


# Rust

_BODY_OR_END = re.compile(r"[{;]")
_RUST_ITEM = re.compile(r"(?<!\w)(pub(?:\s*\([^)]*\))?\s+)?(?:(?:async|const|default|extern|unsafe)\s+)*(mod|struct|enum|trait|impl|fn)\b\s*(<[^{;(]*?>)?\s*([A-Za-z_]\w*)?")
_RUST_FIELD = re.compile(r"(?:^|(?<=[,{]))\s*(?:\#\[[^\]]*\]\s*)*(pub(?:\s*\([^)]*\))?\s+)?([a-z_]\w*)\s*:(?!:)", re.M)


def rust(path: str, content: str) -> Found:
    out, code = Found(), K.mask(content, "rust")
    line = lambda at: K.line_of(content, at)
    for m in K.RUST_USE.finditer(code):
        for _, target in K.rust_paths(m.group(1)):
            out.dep("import", target, line(m.start()))
    owners: list[tuple[int, int, str | None, str]] = []
    skip: list[tuple[int, int]] = []
    for m in _RUST_ITEM.finditer(code):
        at, kind, name = m.start(), m.group(2), m.group(4)
        if any(a <= at < b for a, b in skip):
            continue
        seen = "public" if m.group(1) else "private"
        stop = _BODY_OR_END.search(code, m.end())
        brace = stop.start() if stop else len(code)
        end = K.closing(code, brace) if code[brace : brace + 1] == "{" else brace
        inside = code[brace] == "{" if brace < len(code) else False
        if kind == "impl":
            head = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", code[m.start(2) + 4 : brace])).split(" where ")[0]
            names = re.findall(r"\b([A-Z]\w*)\b", head)
            sides = re.split(r"\bfor\b", head)
            if len(sides) > 1:
                trait, target = (re.findall(r"(\w+)\s*$", s.strip()) for s in sides[:2])
                if trait and target:
                    out.dep("implement", trait[0], line(at))
                names = target
            owners.append((brace, end, names[0] if names else None, "impl"))
            continue
        if not name:
            continue
        if kind == "mod":
            out.symbol("module", name, line(at), line(end), None, seen)
            if inside:
                skip.append((brace, end))
        elif kind == "struct":
            out.symbol("class", name, line(at), line(end), None, seen)
            if inside:
                for f in _RUST_FIELD.finditer(code, brace + 1, end):
                    spot = f.start(1) if f.group(1) else f.start(2)
                    out.symbol("property", f.group(2), line(spot), line(spot), name, "public" if f.group(1) else "private")
        elif kind == "enum":
            out.symbol("enum", name, line(at), line(end), None, seen)
        elif kind == "trait":
            out.symbol("interface", name, line(at), line(end), None, seen)
            owners.append((brace, end, name, "trait"))
        elif kind == "fn":
            home = next((o for o in reversed(owners) if o[0] <= at < o[1]), None)
            opening = code.find("(", m.end())
            shut = K.closing(code, opening, "()") if opening >= 0 else m.end()
            stop = _BODY_OR_END.search(code, shut)
            brace = stop.start() if stop else len(code)
            end = K.closing(code, brace) if code[brace : brace + 1] == "{" else brace
            params = K.split_top(content[opening + 1 : shut]) if opening >= 0 else []
            out.symbol("method" if home else "function", name, line(at), line(end), home[2] if home else None, "public" if home and home[3] == "trait" else seen, params=params or None, has_self=any("self" in p for p in params) or None)
            skip.append((brace, end))
    return out


# TypeScript, JavaScript, single-file components

_WEB_DECLARED = re.compile(r"(?<![\w$.])(?:(?:abstract|async|declare|default|export)\s+)*(class|function\b\s*\*?)\s*([A-Za-z_$][\w$]*)")
_WEB_EXPORT = re.compile(r"""(?m)^\s*export\s+(?:type\s+)?(?:\*(?:\s+as\s+\w+)?|\{[^}]*\})\s*from\s*(["'])([^"'\n]+)\1""")
_WEB_LEAD = re.compile(r"[\s;]*(?:@[\w.]+(?:\([^)]*\))?\s*)*")
_WEB_STOP = re.compile(r"[{;\n]")
_WEB_MEMBER = re.compile(r"((?:\b(?:abstract|async|declare|get|override|private|protected|public|readonly|set|static)\s+|\*\s*)*)(\#?[A-Za-z_$][\w$]*)\s*[?!]?\s*(\(|<|[:=;]|$|\n)")


def web(path: str, content: str, offset: int = 0) -> Found:
    out, code = Found(), K.mask(content, "web")
    line = lambda at: K.line_of(content, at) + offset
    marks = [(m.start(), m.group(4) or m.group(6)) for m in K.JS_IMPORT.finditer(content)] + [(m.start(), m.group(2)) for m in _WEB_EXPORT.finditer(content)]
    for at, source in sorted(marks):
        at += len(content[at:]) - len(content[at:].lstrip())
        if code[at : at + 6].strip():
            out.dep("import", source, line(at))
    inside: list[tuple[int, int]] = []
    for m in _WEB_DECLARED.finditer(code):
        if any(a < m.start() < b for a, b in inside):
            continue
        brace = code.find("{", m.end())
        if m.group(1) != "class":
            opening = code.find("(", m.end())
            brace = code.find("{", K.closing(code, opening, "()")) if opening >= 0 else brace
        end = K.closing(code, brace) if brace >= 0 else m.end()
        inside.append((m.start(), end))
        name = m.group(2)
        start = line(m.start(1))
        if m.group(1) != "class":
            out.symbol("function", name, start, line(end))
            continue
        base = re.search(r"\bextends\s+([A-Za-z_$][\w$]*)", code[m.end() : brace])
        out.symbol("class", name, start, line(end), None, "public", **({"extends": base.group(1)} if base else {}))
        at = brace + 1
        while at < end:  # members: each begins where the last one's body or semicolon ended
            f = _WEB_LEAD.match(code, at, end)
            at = f.end()
            f = _WEB_MEMBER.match(code, at, end)
            if not f:
                at = min(x for x in (code.find("\n", at), code.find(";", at), end) if x >= at) + 1
                continue
            word = f.group(2)
            seen = "private" if word[0] == "#" else next((w for w in ("private", "protected") if w in f.group(1)), "public")
            call = f.group(3) in ("(", "<")
            if call:
                opening = code.find("(", f.end() - 1)
                close = K.closing(code, opening, "()")
                stop = _WEB_STOP.search(code, close + 1)
                stop = stop.start() if stop else end
                last = K.closing(code, stop) if code[stop : stop + 1] == "{" else stop
            else:
                last, depth = f.end() - (f.group(3) in ("\n", ";")), 0
                while last < end and (depth or code[last] not in ";\n" or code[last] == "\n" and code[(left := K.end_before(code, last)) - 1 : left] in "=,.([{:|&?+-"):
                    depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(code[last], 0)
                    last += 1
            out.symbol("method" if call else "property", word.lstrip("#"), line(at), line(max(at, last - (not call and last > at))), None, seen, **{"class": name})
            at = last + 1
    return out


def vue(path: str, content: str) -> Found:
    blocks = K.vue_scripts(content)
    return web(path, blocks[0][0], blocks[0][1]) if blocks else Found()


EXTRACTORS = {"javascript": web, "php": php, "python": python, "ruby": ruby, "rust": rust, "typescript": web, "vue": vue}


def extract_file(path: str, language: str, content: str) -> Found:
    """Symbols and dependencies of one file; dependencies come once a (type, target, line)."""
    found = EXTRACTORS[language](path, content) if language in EXTRACTORS else Found()
    found.deps = list(dict.fromkeys(found.deps))
    return found


def homes(symbols: list[tuple]) -> dict[str, dict]:
    """The last container of each name."""
    return {s[1]: {"type": s[0], "name": s[1], "line_start": s[4], "ord": n} for n, s in enumerate(symbols) if s[0] in CONTAINERS}


def extract(files: DataFrame) -> DataFrame:
    """Rows of kind symbol and dependency (name: the target) of files (path, language, content). home: the container of a member's class."""

    def work(rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for path, language, content in rows:
            if content is not None:
                found = extract_file(path, language, content)
                home = homes(found.symbols)
                out += [(path, "symbol", n, *s[:6], s[6], None if s[0] in CONTAINERS else home.get(s[6].get("class"))) for n, s in enumerate(found.symbols)]
                out += [(path, "dependency", n, t, target, None, None, line, line, None, None) for n, (t, target, line) in enumerate(found.deps)]
        return out

    def run(rows: Iterable[tuple]) -> list[tuple]:
        some = list(rows)
        return in_child(work, some) if keeps_names(some) else work(some)

    return map_rows(files.select("path", "language", "content"), run, ROW)


def file_id(path: str = "path"):
    return F.xxhash64(path)


def symbols_of(rows: DataFrame) -> DataFrame:
    """The index's symbols: ids from content, members linked to the last container of their class's name in the file."""
    s = rows.filter("kind = 'symbol'").withColumn("file_id", file_id()).withColumn("symbol_id", F.xxhash64("path", "type", "name", "line_start", "ord"))
    parent = F.when(F.col("home").isNotNull(), F.xxhash64("path", "home.type", "home.name", "home.line_start", "home.ord"))
    return s.withColumn("parent_symbol_id", parent).select("symbol_id", "file_id", "type", "name", "namespace", "visibility", "line_start", "line_end", "parent_symbol_id", "metadata")


def dependencies_of(rows: DataFrame) -> DataFrame:
    d = rows.filter("kind = 'dependency'")
    return d.select(F.xxhash64("path", "type", "name", "line_start", "ord").alias("dep_id"), file_id().alias("source_file_id"), F.col("name").alias("target_name"), "type", F.col("line_start").alias("line"))
