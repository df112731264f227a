"""What a string literal, its line and its path look like: the predicates behind the hard-wired value detectors.

Plain Python, run by the table functions once a file. Word lists are kept as words; `any_of` makes the expressions.
"""

from __future__ import annotations

import re
from fnmatch import translate
from functools import lru_cache
from pathlib import PurePosixPath

#: Detectors ask about a path line by line; files come one after the other, so a few answers are enough.
few = lru_cache(maxsize=64)


def any_of(words: str, before: str = "", after: str = "", flags: int = re.I) -> re.Pattern[str]:
    return re.compile(f"{before}(?:{'|'.join(words.split())}){after}", flags)


#: Values that frameworks, schemas and protocols give a meaning to.
CONVENTIONS = frozenset("""
    address application/json array asc belongsto belongstomany between bigint bool boolean column confirmed created_at currency database
    date datetime decimal delete deleted_at desc development email enum exists false file filled float function get hasmany hasone head id image in
    int integer json jsonb key label local max min morphmany morphto multipart/form-data name no null nullable number numeric object
    options patch percent phone post present private production public put redis relation required s3 sometimes staging status string symbol
    sync testing text text/html text/plain title true type undefined unique updated_at url value varchar virtual yes
""".split())  # fmt: skip

COMPARED = re.compile(r"""(?:[!=]==?)\s*(?:'|")([^'"]+)(?:'|")|(?:'|")([^'"]+)(?:'|")\s*(?:[!=]==?)""")
CASE = re.compile(r"""case\s+(?:'|")([^'"]+)(?:'|")\s*:""")
LITERAL = re.compile(r"""(?P<q>["'])(?P<text>[^"'\n]+)(?P=q)""")
COMMENT = re.compile(r"\s*(?:\*|#|/[/*])")
_COMMENT_OR_STRING = re.compile(r"""'(?:\\.|[^\\'])*(?:'|\\?$)|"(?:\\.|[^\\"])*(?:"|\\?$)|(?<!:)//|\#""")
STARRED = re.compile(r"\s*\*")
_OCTET = r"(?:\d|[1-9]\d|1\d{2}|2[0-4]\d|25[0-5])"
IP = re.compile(rf"(?<![.\d]){_OCTET}(?:\.{_OCTET}){{3}}(?![.\d])")
URL = re.compile(r"""(?:"|')(https?://[^"']+)(?:"|')""")
BENIGN_IPS = {"0.0.0.0", "127.0.0.1", "255.255.255.255"}

_SEMVER = re.compile(r"v?(?:\d+\.){2}\d+(?:[+-][\w.-]+)?", re.I | re.A)
_DATA_NAME = re.compile(r"data-[\w:-]+", re.I | re.A)
_UTILITY = re.compile(r"!?[a-z\d]+(?:[/:-][][a-z\d.%]+)+", re.I)
_UTILITY_HEADS = tuple("""
    -translate- animate bg- border- bottom- cursor- flex- font- grid- h- inset- leading- left- max- mb- min- ml- mr- mt- mx- my- opacity- p- pb- pl-
    pr- pt- px- py- right- rotate- rounded scale- shadow text- top- tracking- translate- w- z-
""".split())  # fmt: skip
_STYLE_LINE = re.compile(r"""\bclass(?:list|name)?\b|class:|class\s*=|dataset\.|add_breadcrumb|setattribute\s*\(\s*["']class["']""")
_LOCALE = re.compile("[a-z]{2}(?:[-_][A-Z]{2})?")
_PROTOCOL = tuple(re.compile(p, f) for p, f in ((r"[a-z][-a-z\d.+]*/[-a-z\d.+]+", re.I), (r"(?:\\x[\da-fA-F]{2}){2,}", 0), ("[-+][A-Z][-A-Z\\d_]+", 0), (r"(?:us-)?ascii|utf8|utf-?\d+|latin-?\d+|iso-\d+-\d+", re.I), (":memory:", 0)))
_SETTING = re.compile(r"[A-Z][A-Z\d_]{2,}")
_HEADER_ENV = any_of("CONTENT HTTP REMOTE REQUEST SERVER", "", r"_[A-Z\d_]+", 0)
_SYMBOL_PATH = re.compile(r"[A-Za-z_]\w*(?:[:.\\][A-Za-z\d_]+)+", re.A)
_SQL = re.compile(r"(?:NOT )?(?:EXISTS|IN)|IS (?:NOT )?NULL|R?LIKE|REGEXP|BETWEEN", re.I)
_SCHEME = re.compile(r"[a-z][-a-z\d+.]*:(?://)?", re.I)
_DASHED = re.compile(r"[a-z\d]+(?:-[a-z\d]+)+", re.I)
_CHARSET = re.compile(r"[\w.-]{3,20}", re.A)
_FILE_NAME = any_of("css csv html? js json php svg txt xml", r"[\w.-]+\.", "", re.I | re.A)
_SLUG = re.compile(r"[a-z\d]+(?:[_-][a-z\d]+)+", re.I)
_CONTRACT_VARIABLE = any_of("""
    act action mode state status screen slug page hook(?:_suffix)? postbox theme_location response(?:\\.code)? transaction_mode
    (?:[a-z]+_)?(?:attr|attribute|backend|cookie|engine|field|format|header|id|key|module|name|option|serializer|setting|type)
""", r"\b", r"\b")  # fmt: skip
_ABOUT = {k: any_of(v, r"\b", r"\b") for k, v in {
    "setting": "configure environment_variable settings? settings_module",
    "header": "cookie environ headers? meta request response scope server",
    "symbol": "app backend check class engine error field id import module package path serializer",
    "sql": "comparator compare operator sql",
    "url": "href location protocol redirect scheme src url",
    "charset": "charset codepage encoding iconv mbstring",
    "page": "act action format hook_suffix id keystr mode page pagenow postbox response\\.code screen slug state tab theme_location view",
}.items()}
_ABOUT_HTTP = any_of("accept charset content[_-] encoding headers? mime", r"\b")
_ABOUT_SCREEN = re.compile(r"\b(?:current_screen|hook_suffix|menu_page|page_hook|page_now|pagenow)\b|screen(?:\.|->)")
_NOISE_MARKS = tuple(f"[{q}{w}{q}]" for w in "key options panel relation storage type".split() for q in "\"'")
_FIELD = r"(?:column(?:name)?|definition|field(?:name|type)?|key|normalizedfield|options?|panel(?:name)?|relation)"
_NOISE_LEFT = re.compile(rf"\${_FIELD}\b\s*[!=]==?", re.I)
_NOISE_RIGHT = re.compile(rf"[!=]==?\s*\${_FIELD}\b", re.I)
_NOISE_SWITCH = re.compile(r"\b(?:match|switch)\s*\([^)]*(?:cap(?:ability)?|column(?:name)?|definition|field(?:name|type)?|headername|key|options?|panel(?:name)?|permission|relation|response\.code|theme_location)\b", re.I)
_INTERACTIVE = tuple(f"/{d}/" for d in "Components Console Pages assets composables frontend resources/js src/js stores".split())
_TOOLS = set("build.rs eslint.config.js gruntfile.js gulpfile.js rakefile rollup.config.js vite.config.js vite.config.ts webpack.config.js".split())
_CONFIGS = set("gemfile jest.config.js jest.config.ts phpunit.xml phpunit.xml.dist playwright.config.js playwright.config.ts".split())

_BENIGN_URLS = tuple("example.com example.net example.org json-schema.org placeholder schema.getpostman.com schemas.xmlsoap.org www.w3.org".split())
_DOC_URLS = tuple("""
    .dtd .xsd /docs/ /documentation/ /forum /forums/ /manual/ /reference/ /release /releases/ /schema/ /schemas/ /support/ developer. docs.
    documentation georss.org json-schema openxmlformats.org purl.org release-notes rssboard.org schema. sitemaps.org w3.org
""".split())  # fmt: skip
_AVATAR_HOSTS = ("gravatar.com", "ui-avatars.com")
_AVATAR_LINE = any_of("avatar cdn embed fallback font gravatar icon oembed provider stylesheet", r"\b", r"\b")
SINK = any_of("""
    api_(?:base|url) authorize axios\\.(?:delete|get|post|put) base_(?:uri|url) callback client\\.(?:delete|get|post|put) curl_(?:exec|init|setopt) download
    endpoint fetch\\s*\\( httpx\\.(?:delete|get|post|put) redirect_uri requests?\\.(?:delete|get|post|put) send token upload urllib\\.request webhook wp_(?:safe_)?remote_(?:get|post)
""", r"\b", r"\b")  # fmt: skip
_REGISTRY = any_of("oembed provider[-_]?map providers?\\s*= registry resolver", r"\b", r"\b")
_HINT = any_of("dns-prefetch preconnect prefetch preload resource_hints?", r"\b", r"\b")
_SHOWN = re.compile(r"\b(?:documentation|esc_attr__\(|esc_html__\(|esc_url\(|esc_url__\(|help|learn more|read more|support|__\(|_e\()\b", re.I)
_IDENTIFIER = re.compile(r"""<generator\b|\$links\s*\[|->link_header\b|\b(?:namespace|profile|schema|uri|xmlns)\b|rel\s*=\s*["']profile["']""", re.I)


def forward(path: str) -> str:
    return path.replace("\\", "/")


@few
def _globs(patterns: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile("|".join(map(translate, patterns)))


def in_globs(path: str, patterns: list[str]) -> bool:
    some = tuple(p for p in patterns if p)
    return bool(some) and _globs(some).match(forward(path)) is not None


@few
def stem_of(path: str) -> str:
    return PurePosixPath(path).stem


@few
def name_of(path: str) -> str:
    return PurePosixPath(forward(path)).name.lower()


@few
def is_test(path: str) -> bool:
    p = forward(path).lower()
    return "test" in stem_of(p) or not {"__tests__", "fixtures", "spec", "test", "tests"}.isdisjoint(p.split("/")) or p.endswith(("_spec.rb", "_test.py", "_test.rb", "test.php"))


@few
def is_tooling(path: str) -> bool:
    return forward(path).startswith("tools/") or name_of(path) in _TOOLS


@few
def is_config(path: str) -> bool:
    return is_tooling(path) or name_of(path) in _CONFIGS or name_of(path).endswith(".gemspec") or forward(path).startswith(("config/", "scripts/", "tools/"))


@few
def is_bootstrap(path: str) -> bool:
    p = forward(path).lower()
    return p.startswith("bootstrap/") or name_of(path) in "config.ru manage.py settings.py settings.py-tpl".split() or not {"bootstrap", "conf", "settings"}.isdisjoint(p.split("/"))


@few
def is_command(path: str) -> bool:
    p = forward(path).lower()
    return p.startswith(("bin/", "scripts/")) or name_of(path) == "manage.py" or not {"cli", "command", "commands", "console", "management"}.isdisjoint(p.split("/"))


@few
def is_entity_noise(path: str) -> bool:
    p = forward(path).lower()
    return p.startswith("scripts/") or "/scripts/" in p or "/database/seeders/" in p or p.endswith("/module.php") or any(w in stem_of(p) for w in ("generator", "mockdata", "seeder", "translation"))


@few
def is_interactive(path: str) -> bool:
    return any(d in forward(path) for d in _INTERACTIVE)


def simple(value: str) -> bool:
    return re.fullmatch("_?[A-Za-z][A-Za-z0-9_]*", value) is not None


def compound(value: str) -> bool:
    return re.search("[-._:/]", value) is not None


def ignorable(value: str) -> bool:
    return len(value) < 2 or not value.strip() or value.lower() in CONVENTIONS or bool(re.match(r"\.\w{1,5}$", value)) or ("_" in value and bool(re.match("[a-z][a-z0-9_]{0,14}$", value))) or bool(re.match(r"[\s\\$]+\d*$", value))


def fragment(value: str) -> bool:
    """Code rather than a value: operators, brackets, or too few letters and digits."""
    if any(x in value for x in "&& || == != => -> :: { } $ < > [ ] ( )".split()):
        return True
    text = value.strip()
    return not text or sum(c.isalnum() for c in text) < 0.55 * len(text) or not any(c.isalnum() for c in text)


def route(value: str) -> bool:
    return value.startswith(("/admin/", "/api/"))


def system_path(value: str) -> bool:
    return value.startswith(("/etc/", "/home/", "/opt/", "/srv/", "/var/"))


def path_like(value: str) -> bool:
    v = value.strip()
    return bool(re.match(r"\s*(?:\.{1,2}/|~?@/)", v)) or v.startswith("/") and not route(v) and not system_path(v) or bool(re.fullmatch(r"(?:[\w.-]+/)+[\w.-]+", v, re.A))


def utility_class(value: str) -> bool:
    v = value.strip()
    return " " not in v and v.count("#") < 2 and _UTILITY.fullmatch(v) is not None and v.startswith(_UTILITY_HEADS)


def data_name(value: str) -> bool:
    return _DATA_NAME.fullmatch(value.strip()) is not None


def styling(line: str, value: str) -> bool:
    return data_name(value) or utility_class(value) and _STYLE_LINE.search(line.lower()) is not None


def protocol(value: str) -> bool:
    return any(p.fullmatch(value.strip()) for p in _PROTOCOL)


def marker_context(value: str, context: str) -> bool:
    """The value is a name that a protocol or another module gave, by what stands around it."""
    v, c = value.strip(), context.lower()
    variable = lambda: _CONTRACT_VARIABLE.search(c) is not None
    about = lambda k: _ABOUT[k].search(c) is not None
    page = _FILE_NAME.fullmatch(v) or _SLUG.fullmatch(v)
    return bool(
        _SETTING.fullmatch(v) and (about("setting") or variable())
        or _HEADER_ENV.fullmatch(v) and (about("header") or variable())
        or _SYMBOL_PATH.fullmatch(v) and about("symbol")
        or _SQL.fullmatch(v) and about("sql")
        or (_SCHEME.fullmatch(v) or v.lower() == "javascript:") and about("url")
        or _DASHED.fullmatch(v) and _ABOUT_HTTP.search(c)
        or _CHARSET.fullmatch(v) and about("charset")
        or page and (_ABOUT_SCREEN.search(c) or variable())
    )


def noise_switch(recent: list[str], noise: list[re.Pattern[str]]) -> bool:
    context = "\n".join(recent[-3:])
    return any(p.search(context) for p in noise) or _NOISE_SWITCH.search(context) is not None


def noise_line(line: str, recent: list[str], noise: list[re.Pattern[str]]) -> bool:
    lower = line.lower()
    return any(p.search(line) for p in noise) or any(m in lower for m in _NOISE_MARKS) or bool(_NOISE_LEFT.search(line) or _NOISE_RIGHT.search(line)) or noise_switch(recent, noise)


def contract_like(path: str, context: str, value: str) -> bool:
    v, c = value.strip(), context.lower()
    return bool(_CONTRACT_VARIABLE.search(c) and _SYMBOL_PATH.fullmatch(v)) or bool(is_interactive(path) and _SLUG.fullmatch(v) and _ABOUT["page"].search(c))


def _low_signal(value: str, shortest: int, unwanted: set[str]) -> bool:
    return len(value) < shortest or value.isdigit() or ignorable(value) or value.lower() in unwanted or data_name(value) or utility_class(value) or _SEMVER.fullmatch(value) is not None or fragment(value) or protocol(value)


def magic(value: str, path: str, shortest: int, unwanted: set[str]) -> bool:
    """A compared literal worth a name of its own."""
    v = value.strip()
    if _low_signal(v, shortest, unwanted) or v[0] == "_" or v[0] in "#.[" and any(c.isalpha() for c in v) or IP.fullmatch(v) or _LOCALE.fullmatch(v) or v.lower() in ("http", "https", "localhost", "utf-8", "xmlhttprequest"):
        return False
    return not (is_tooling(path) and re.fullmatch("[a-z0-9_-]+(?::[a-z0-9_-]+)?", v)) and not (is_interactive(path) and simple(v))


def repeatable(value: str, shortest: int, unwanted: set[str], need_compound: bool, skip: list[re.Pattern[str]]) -> bool:
    """A literal worth counting across files."""
    v = value.strip()
    if _low_signal(v, shortest, unwanted) or any(p.search(v) for p in skip) or path_like(v) or re.fullmatch("[A-Za-z]{1,8}/[A-Za-z]{1,8}", v) or re.fullmatch(r"\s*-\d+\s+[A-Za-z]+\s*", v):
        return route(v) or system_path(v)
    return (compound(v) or not need_compound) and not re.match(r"\s*(?::|@|v-[a-z])", v, re.I)


def strip_comment(line: str) -> str:
    """The line up to a trailing comment; quotes hide what looks like one."""
    if "//" not in line and "#" not in line:
        return line
    for m in _COMMENT_OR_STRING.finditer(line):
        at = m.start()
        if m.group() == "//" or m.group() == "#" and (at == 0 or line[at - 1].isspace()):
            return line[:at]
    return line


@lru_cache(maxsize=1)
def code_lines(content: str) -> list[tuple[int, str]]:
    """(number, line without a trailing comment) of the lines that aren't comments; detectors of a file share them."""
    stripped = ((no, strip_comment(raw)) for no, raw in enumerate(content.splitlines(), 1))
    return [(no, line) for no, line in stripped if not COMMENT.match(line)]


def quoted(line: str) -> bool:
    return "'" in line or '"' in line


def script_only(path: str, content: str) -> str:
    """Of a single-file component, the script alone; other lines become empty."""
    if not path.endswith(".vue"):
        return content
    out, inside = [], False
    for line in content.splitlines():
        s = line.strip()
        edge = s.startswith(("<script", "</script"))
        if edge:
            inside = not s.startswith("</")
        out.append(line if inside and not edge else "")
    return "\n".join(out)


_LINK_TEXTS = ["learn more", "read more", *"documentation esc_attr__( esc_html__( help support __( _e(".split()]


def host_of(url: str) -> str:
    return re.sub("^[a-z]+://", "", url, flags=re.I).split("/")[0].split("?")[0].split("#")[0].lower()


def not_runtime(url: str, line: str, path: str) -> bool:
    """A URL that is documentation, an identifier, or shown to people."""
    u, low, p = url.lower(), line.lower(), forward(path).lower()
    if any(x in u for x in _BENIGN_URLS) or any(x in u for x in _DOC_URLS):
        return True
    if host_of(url).endswith(_AVATAR_HOSTS) and (_AVATAR_LINE.search(line) or any(w in p for w in ("avatar", "embed", "gravatar"))):
        return True
    if _IDENTIFIER.search(line) or _SHOWN.search(line) and not SINK.search(line):
        return True
    return "<a href=" in low and any(w in low for w in _LINK_TEXTS)


def network_confidence(url: str, line: str) -> str:
    if SINK.search(line):
        return "high"
    if _REGISTRY.search(line) or _HINT.search(line):
        return "low"
    host = host_of(url)
    templated = not {"{", "$"}.isdisjoint(url)
    if templated or "localhost" in host or host.endswith(".local"):
        return "high"
    return "low" if any(w in line.lower() for w in ("asset", "font", "href", "origin", "src")) else "medium"


def displayed(line: str) -> bool:
    low = line.lower()
    return any(w in low for w in ("geticon(", "getlabel(", "inertia::render(")) or any(f"{q}{w}{q}" in low for w in "description icon label labelkey placeholder title tooltip".split() for q in "\"'") or re.search(r"""["'](?:examples?|instructions|prompt)["']\s*=>""", low) is not None
