from codequarry.operators import deadcode as D
from codequarry.policy import DeadCodePolicy
from helpers import code_base, rows
from pyspark.sql import functions as F


def found(spark, tree, policy=None, compat=False):
    return set(rows(D.dead_code(*code_base(spark, tree), policy, compat), "category", "name"))


def test_python_imports(spark):
    got = rows(D.dead_code(*code_base(spark, {
        "pkg/__init__.py": "from .api import Client\nimport sys\n__all__ = ['Client']\n", "pkg/lazy.py": "from .api import Client\nimport os.path as p, json\nfrom __future__ import annotations\nfrom x import *\ndef f():\n    import re\n    return json\n",
    })), "file_path", "name", "confidence")
    assert got == [("pkg/__init__.py", "sys", "low"), ("pkg/lazy.py", "api.Client", "high"), ("pkg/lazy.py", "os.path", "high"), ("pkg/lazy.py", "re", "high")]


def test_php_imports(spark):
    got = found(spark, {
        "routes/web.php": "<?php\nuse Lib\\Route;\n\nRoute::get('/x');\n", "a.php": "<?php\nuse A\\Gone;\nuse A\\Doc;\nuse A\\Attr;\nuse A\\Other as Alias;\nuse A\\Override;\n/** @method Doc make() */\n#[Attr(1)]\nfunction f() { return Alias::x(); }\n",
    })
    assert got == {("unused_import", "A\\Gone")}


def test_web_imports(spark):
    got = found(spark, {
        "src/a.ts": "import { used, stale } from './x'\nimport type { Shape, Missing } from './y'\nimport * as ns from './z'\nimport './side'\nimport Dflt from './d'\nexport const v: Shape = ns.make(used)\nconst o = { Dflt: 1 }\n",
        "src/b.tsx": "import { Card, Ghost } from './c'\nexport const V = () => <Card a={1} />\n", "src/c.js": "import { Warn, Alt } from './w'\nconst m = { Warn }\nx.Alt()\n", "src/t.d.ts": "import { Q } from './q'\n",
        "src/p.vue": "<template><user-card :x=\"helperA\"/></template>\n<script setup lang=\"ts\">\nimport UserCard from './u.vue'\nimport { helperA, helperB } from './h'\n</script>\n",
    })
    assert got == {("unused_import", x) for x in ("stale", "Missing", "Dflt", "Ghost", "Alt", "helperB")}


RUST_LIB = "use crate::http::{Client, Server};\npub struct Kept { cache: u8, hot: u8 }\npub struct Alone {}\nimpl Kept {\n    fn stale(&self) -> u8 { 1 }\n    fn live(&self, c: Client) -> u8 { self.hot }\n    pub fn go(&self) { self.live(x); }\n}\n"


def test_rust(spark):
    got = found(spark, {"src/lib.rs": RUST_LIB, "src/user.rs": "fn f() { let k: Kept; }\n"})
    assert got == {("unused_import", "crate::http::Server"), ("unused_method", "stale"), ("unused_property", "cache"), ("abandoned_class", "Alone")}


def test_members(spark):
    got = found(spark, {
        "a.php": "<?php\nclass A {\n    private $used;\n    private $idle;\n    private function __construct() { usort($x, array($this, 'by_name')); $this->used = 1; }\n    private function by_name() {}\n    private function never() {}\n}\n$a = new A();\n",
        "b.ts": "class B {\n  #cache = 1\n  #gone = 2\n  private onTap() {}\n  run() { el.on('x', this.onTap); return this.#cache }\n}\n",
    })
    assert got == {("unused_property", "idle"), ("unused_method", "never"), ("unused_property", "gone")}


def test_stale_rows(spark):
    files, symbols, deps = code_base(spark, {"a.php": "<?php\nuse X\\Y;\nclass A {\n    private $p;\n    private function m() {}\n}\n"})
    moved = files.withColumn("content", F.concat(F.lit("<?php\n\n\n"), "content"))
    assert D.dead_code(moved, symbols, deps, DeadCodePolicy(abandoned_languages=["php"])).count() == 0


def test_abandoned_classes(spark):
    tree = {
        "app/Sync.php": "<?php\nnamespace App;\nclass Sync {}\n", "app/x.hooks.php": "<?php\n$h = [Sync::class];\n", "app/Lonely.php": "<?php\nnamespace App;\nclass Lonely {}\ninterface Shy {}\ntrait Quiet {}\n",
        "app/Named.php": "<?php\nnamespace App;\nclass Named {}\n", "app/go.php": "<?php\n$c = 'App\\Named';\n", "app/Jobs/Auto.php": "<?php\nclass Auto {}\n", "app/Ending.php": "<?php\nclass Ending {}\n", "app/imp.php": "<?php\nuse Lib\\SomeEnding;\nSomeEnding::x();\n",
        "app/Ear.php": "<?php\nnamespace App;\nclass Ear {}\n", "app/boot.php": "<?php\nEvent::listen('x', [\\App\\Ear::class, 'run']);\n", "w.ts": "class Never {}\n",
    }
    assert found(spark, tree) == {("abandoned_class", "App\\Lonely"), ("abandoned_class", "App\\Shy"), ("abandoned_class", "App\\Quiet")}
    assert found(spark, tree, compat=True) == {("abandoned_class", "App\\Quiet")}
    assert found(spark, tree, DeadCodePolicy(abandoned_entry_patterns=["app/Lone*"])) == set()


def test_runtime_tokens():
    text = "<?php\nnamespace App\\Demo;\n#[Mark]\nclass X { function f() { new Job(); return \\Lib\\Far::class; } }\n"
    assert D.runtime_tokens(text) == {"Mark", "App\\Demo\\Mark", "Job", "App\\Demo\\Job", "Lib\\Far"}


def test_suffix_like(spark):
    names = spark.createDataFrame([("Foo", 1), ("b_r", 1), ("Own", 3)], "name string, file_id long")
    deps = spark.createDataFrame([("x\\aFOO", 2), ("zbar", 2), ("Own", 3)], "target_name string, source_file_id long")
    assert rows(D.suffix_referenced(names, deps), "name") == [("Foo",), ("b_r",)]


def test_partitions_and_order_do_not_matter(spark):
    files, symbols, deps = code_base(spark, {"src/lib.rs": RUST_LIB, "src/user.rs": "fn f() { let k: Kept; }\n", "a.php": "<?php\nuse A\\Gone;\nclass A {\n    private $idle;\n}\n", "b.py": "import os\n"})
    one = rows(D.dead_code(files.repartition(1), symbols.repartition(1), deps), "category", "name", "line")
    assert one == rows(D.dead_code(files.repartition(7).orderBy(F.desc("path")), symbols.repartition(5), deps.repartition(3)), "category", "name", "line") and len(one) == 8


def test_suffix_references_against_like(spark):
    """All pairs by SQLite's LIKE, which the operator's keys must not lose."""
    import random
    import sqlite3

    from codequarry.operators.deadcode import suffix_referenced

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("aB_c") for _ in range(rng.randint(1, n)))
    names = sorted({(word(5), rng.randint(1, 4)) for _ in range(60)} | {("_", 1), ("__", 2), ("a%b", 3)})
    targets = sorted({(word(8), rng.randint(1, 4)) for _ in range(60)} | {("xa%b", 1), ("xaZb", 1)})
    db = sqlite3.connect(":memory:")
    like = lambda t, n: db.execute("SELECT ? LIKE '%' || replace(?, '%', '\\%') ESCAPE '\\'", (t, n)).fetchone()[0]
    want = {(n, f) for n, f in names if any(g != f and like(t, n) for t, g in targets)}
    got = suffix_referenced(spark.createDataFrame(names, "name string, file_id long"), spark.createDataFrame(targets, "target_name string, source_file_id long"))
    assert {tuple(r) for r in got.collect()} == want and 0 < len(want) < len(names)
