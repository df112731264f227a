import pytest
from codequarry.functions import literals as L
from codequarry.operators import contracts as C
from codequarry.operators import hardwiring as H
from codequarry.policy import HardwiringPolicy
from helpers import code_base

BASE = HardwiringPolicy()


def env(path, text, language):
    return [x[3] for x in H.environment(path, text, language, BASE)]


def magic(path, text):
    return {(x[3], x[6]) for x in H.magic_strings(path, text, BASE)}


def net(path, text):
    return {(x[3], x[6]) for x in H.network(path, text)}


@pytest.mark.parametrize("path,text,language,n", [
    ("app/run.py", "KEY = os.getenv('KEY')", "python", 1), ("app/s/run.rb", 'ENV.fetch("KEY", nil)', "ruby", 1), ("src/run.rs", 'std::env::var("X")', "rust", 1), ("build.rs", 'env::var("X")', "rust", 0), ("tools/b.js", "process.env.X", "javascript", 0),
    ("django/conf/__init__.py", "os.environ.get('X')", "python", 0), ("app/Console/Commands/s.php", "env('A')", "php", 0), ("app/Console/Commands/s.php", "env('A', 'local')", "php", 1), ("src/a.ts", "import.meta.env.MODE", "typescript", 0),
    ("src/a.ts", "process.env.SECRET", "typescript", 1), ("src/a.ts", "// process.env.SECRET", "typescript", 0), ("config/a.php", "env('A')", "php", 0), ("tests/a.py", "os.environ['A']", "python", 0), ("a.php", "x('env()')", "php", 0),
])
def test_environment(path, text, language, n):
    assert len(env(path, text, language)) == n


@pytest.mark.parametrize("text,expected", [
    ("ip = '10.1.2.3'", {("10.1.2.3", "medium")}), ("x = 'M1.937.86.54 10 20'", set()), ("h = '127.0.0.1'", set()), ("v = 1.2.3.4.5", set()), ("$endpoint = 'https://api.acme.local/v1';", {("https://api.acme.local/v1", "high")}),
    ("$a = 'https://www.gravatar.com/avatar/x'; // avatar", set()), ("see 'https://docs.acme.io/x'", set()), ("$links['x'] = 'https://a.io/b';", set()), ("$providers = array('https://publish.acme.io/oembed');", {("https://publish.acme.io/oembed", "low")}),
    ("u = 'https://acme.io/x'", {("https://acme.io/x", "medium")}), ("config('u', 'https://acme.io/x')", set()), ("# 'https://acme.io/x'", set()), ("axios.get('https://acme.io/x')", {("https://acme.io/x", "high")}), ("u = 'http://example.com/x'", set()),
])
def test_network(text, expected):
    assert net("src/a.php", text) == expected


@pytest.mark.parametrize("text,expected", [
    ('if (mode == "release") {', {("release", "medium")}), ("case 'shipped-late':", {("shipped-late", "high")}), ('if (kind === "queue.failed") {', {("queue.failed", "high")}), ('RUBY == "3.0.0"', set()), ('x == "data-controller"', set()), ('t == "image/webp"', set()),
    ("x === '+HTML'", set()), ("charset == 'ISO-8859-1'", set()), ("operator == 'NOT IN'", set()), ("url == 'http://'", set()), ("settings == 'SECRET_KEY'", set()), ("$key === 'whatever-x'", set()), ("x == 'abc'", set()), ("x == '12345'", set()),
    ("// x == 'released'", set()), ("x == 'https'", set()), ("x == '#selector'", set()), ("x == 'created_at'", set()), ("module == 'django.core'", set()), ("y == 'a && b c'", set()),
])
def test_magic(text, expected):
    assert magic("src/mode.php", text) == expected


def test_magic_context_and_contracts():
    assert magic("src/a.php", "switch ($fieldType) {\ncase 'special-one':") == set()
    assert magic("a/assets/x.js", "x === 'editing'") == set()
    assert magic("Gruntfile.js", "x === 'watch:php'") == set()


def test_comment_stripping():
    for line, out in (("a // b", "a "), ("u = 'http://x' # c", "u = 'http://x' "), ("x://y", "x://y"), ('s = "a # b" // c', 's = "a # b" '), ("#x", ""), ("a#b", "a#b"), ("'it\\'s' # z", "'it\\'s' "), ("'open # z", "'open # z")):
        assert L.strip_comment(line) == out, line


def test_script_only():
    assert L.script_only("a.vue", "<template>\nx\n</template>\n<script>\ncode\n</script>") == "\n\n\n\ncode\n"


def test_entities():
    rows = list(H.entity_names("app/a.php", "if ($entityType === 'Order') {}\n$x = 'Order';\n'label' => 'Order', $entityType = 'Order';\nconst A = 'Order';\n$q = \"SELECT 'Order'\"; // entityType\n", BASE))
    assert [(r[1], r[3]) for r in rows] == [(1, "Order")] and not list(H.entity_names("a.php", "$x = 'Order';", BASE))
    assert not list(H.entity_names("app/Entities/a.php", "$entityType === 'Order'", BASE))


def test_whole(spark):
    tree = {f"d{i}/f.py": f"a = 'acme:topic.created'\nb = '/api/v{i % 1}/orders'\nc = 'utf-8'\nd = ':memory:'\n" for i in range(4)} | {"app/Entities/Order.php": "<?php\nclass Order {}\n", "app/x.php": "<?php\nif ($entityType == 'Order') {}\nadd_action('init', 'f'); if ($x == 'init') {} if ($x == 'Order') {}\n"}
    files, symbols, _ = code_base(spark, tree)
    contracts = C.lookup(C.scan(files))
    got = {(r.category, r.value): r for r in H.hardwiring(files, symbols, contracts).collect()}
    assert set(got) == {("repeated_literal", "acme:topic.created"), ("repeated_literal", "/api/v0/orders"), ("hardcoded_entity", "Order")}
    r = got["repeated_literal", "acme:topic.created"]
    assert (r.file_path, r.line, r.confidence) == ("d0/f.py", 1, "medium") and r.context == "Found in 4 files: d0/f.py:1, d1/f.py:1, d2/f.py:1, d3/f.py:1"
    assert got["repeated_literal", "/api/v0/orders"].confidence == "high"


def test_contracts(spark):
    tree = {
        "routes/web.php": "<?php\nRoute::get('/api/users', 'x');\nadd_action('init', 'f');\n$e = env('APP_ENV');\nconfig('app.name');\nregister_post_status('auto-draft');\n$c->bind('tenant.manager');\nregister_block(array('kind' => 1, 'more' => 2));\n",
        "web/router.ts": "router.get('/health', h)\nprocess.env.NODE_ENV; import.meta.env.VITE_URL\ntype A = 'one' | 'two'\ntype B =\n  // note\n  | 'three'\n",
        "web/b.ts": "type C =\n  | 'four'\n  | 'five';\nf(x: 'six' | 'seven')\nconst L = ['eight', 'nine'] as const\nnew CustomEvent('picker:done')\n", "web/controllers/media_picker_controller.js": "<div data-controller=\"modal\" data-action=\"click->short#go x#y\">\n",
        "app/s.py": "os.environ['DEBUG']\nos.getenv('DJANGO_ENV')\n", "app/p.rb": "ENV.fetch('MAX_T', 1)\nENV['SOLID']\n", "tests/t.php": "<?php env('HIDDEN');\n",
    }
    found = C.scan(code_base(spark, tree)[0]).cache()
    values = {}
    for r in C.lookup(found).collect():
        values.setdefault(r.category, set()).add(r.value)
    assert values["routes"] == {"/api/users", "/health"} and values["hooks"] == {"init"} and values["registered_keys"] == {"auto-draft", "tenant.manager"} and values["config_keys"] == {"app.name"}
    assert values["env_keys"] == {"APP_ENV", "NODE_ENV", "VITE_URL", "DEBUG", "DJANGO_ENV", "MAX_T", "SOLID"}
    assert values["symbolic_literals"] == {"kind", "more", "one", "two", "four", "five", "six", "seven", "eight", "nine", "picker:done", "media-picker", "modal", "short", "x"}
    items = C.inventory(found)
    r = items.filter("value = '/api/users'").first()
    assert (r["count"], r.locations[0].file, r.locations[0].line) == (1, "routes/web.php", 2)
    assert {r.category: r["count"] for r in C.summary(items).collect()}["routes"] == 2
    merged = {(r.category, r.value) for r in C.merge_lookup(C.lookup(found), {"routes": [" /new ", ""], "nothing": ["x"]}).collect()}
    assert ("routes", "/new") in merged and not any(c == "nothing" for c, _ in merged)
