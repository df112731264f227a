"""What keeps queries in proportion to their tables: work on all cores, read once, no estimate that broadcasts."""

import os
import random
import re
import time

import pytest
from codequarry.functions import literals as L
from codequarry.operators import deadcode as D
from codequarry.operators import hardwiring as H
from codequarry.plans import catalog
from codequarry.plans import code_catalog as K
from codequarry.policy import DeadCodePolicy, HardwiringPolicy
from codequarry.session import ROWS_AT_A_TIME, in_child, map_rows
from codequarry.sources import extract as X
from codequarry.sources import tokens as T
from helpers import code_base, rows
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_are_spread(spark):
    """The file of parts is one partition; texts made of it are read by all cores."""
    files = K.part_code(spark, SMALL, K.text("a@.py"), "python", K.text("x = @"))
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert files.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_results_are_handed_over_in_pieces(spark):
    got = map_rows(spark.range(5000).coalesce(1), lambda some: [(len(list(some)),)], "n int").collect()
    assert sum(r.n for r in got) == 5000 and max(r.n for r in got) <= ROWS_AT_A_TIME


@pytest.mark.parametrize(("name", "most"), [("unused_php_imports", 1), ("unused_private_members", 1), ("symbol_parents", 0), ("repeated_literals", 0), ("entity_names", 0), ("abandoned_classes", 0)])
def test_files_are_read_once(spark, name, most):
    """Table functions that are left in the plan: what several parts of a query need has been written."""
    assert plan(catalog.queries()[name](spark, SMALL)).count("MapInArrow") <= most


@pytest.mark.parametrize("name", ["resolver_stages", "symbol_parents"])
def test_estimates_broadcast_nothing(spark, name):
    """The statistics of a compressed file say nothing of the rows' memory."""
    assert "BroadcastExchange" not in plan(catalog.queries()[name](spark, SMALL))


def test_names_that_share_a_long_part(spark):
    """All names share their longest part, and all targets have it: 400 million pairs, of which 20,000 count."""
    n = 20_000
    names = spark.range(n).select(F.format_string("Supplier_%d", "id").alias("name"), F.col("id").alias("file_id"))
    deps = spark.range(n).select(F.format_string("vendor\\supplier#%d", "id").alias("target_name"), (F.col("id") + 1).alias("source_file_id"))
    began = time.time()
    assert D.suffix_referenced(names, deps).count() == n
    assert time.time() - began < 60


def test_suffixes_as_like_has_them(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("aB_x") for _ in range(n))
    names = [(word(rng.randrange(1, 5)), i) for i in range(60)] + [("a\\b_x", 70), ("____", 71), ("%_", 72)]
    deps = [(word(rng.randrange(0, 7)), rng.randrange(60)) for _ in range(80)] + [("za\\bBx", 3), ("é%q", 4)]
    want = {(n, f) for n, f in names for t, s in deps if s != f and re.search("(?s)" + "".join("." if c == "_" else re.escape(c) for c in n.lower()) + r"\Z", t.lower())}
    got = D.suffix_referenced(spark.createDataFrame(names, "name string, file_id long"), spark.createDataFrame(deps, "target_name string, source_file_id long"))
    assert set(rows(got, "name", "file_id")) == want


def test_imports_by_words_as_by_expressions():
    """ASCII texts are read by words, others by an expression a name; a comment in another script changes nothing but the way."""
    rng = random.Random(9)
    pieces = ["new Read();", "/** @property-read Foo $x */", "* @PARAM foo", "#[Bar]", "#[ Baz(1)]", "# [Qux]", "Foo_1", "$read", "@returns Bar", "// x @var  \\A\\Qux|Read", "Read1"]
    for _ in range(300):
        targets = ["A\\" + x for x in ("Read", "Foo", "Bar", "Baz", "Qux", "Foo_1")]
        text = "<?php\n" + "".join(f"use {t}{' as Own' * (i == 1)};\n" for i, t in enumerate(targets)) + "class C {\n" + "\n".join(rng.sample(pieces, 4))
        found = [list(D.php_imports("a.php", t, [(x, i + 2) for i, x in enumerate(targets)], [])) for t in (text, text + "\n// \u4e00")]
        assert found[0] == found[1]


def test_no_expression_for_each_name():
    re.purge()
    for i in range(200):
        list(D.php_imports("a.php", f"<?php\nuse App\\Dep{i};\nclass C {{ }}", [(f"App\\Dep{i}", 2)], []))
    assert len(re._cache) < 40


def test_members_know_their_class(spark):
    _, symbols, _ = code_base(spark, {"a.php": "<?php\nclass K {\n  private $own = 1;\n  function run() {}\n}\nfunction free() {}", "b.py": "class K:\n    x = 1\nclass K:\n    def f(self): pass\n"})
    own = {r.symbol_id: (r.file_id, r.name, r.line_start) for r in symbols.collect()}
    assert len(own) == symbols.count()
    got = {(r.name, own[r.parent_symbol_id][1:] if r.parent_symbol_id is not None else None) for r in symbols.collect()}
    # of two classes of a name, members belong to the last
    assert got == {("K", None), ("own", ("K", 2)), ("run", ("K", 2)), ("free", None), ("x", ("K", 3)), ("f", ("K", 3))}
    assert "Join" not in plan(X.symbols_of(X.extract(spark.createDataFrame([("a.py", "python", "x = 1")], "path string, language string, content string"))))


def test_detectors_share_the_lines(monkeypatch):
    """A line is freed of its comment once, however many detectors read it."""
    seen = []
    strip = L.strip_comment
    monkeypatch.setattr(L, "strip_comment", lambda line: seen.append(line) or strip(line))
    text, policy = "<?php\n$a = 'one-two'; // x\n# y\nif ($kind == 'late-night-3') {", HardwiringPolicy()
    assert len(list(H.magic_strings("a.php", text, policy))) == 1 and not list(H.entity_names("a.php", text, policy))
    assert [v for v, _ in H.literals("a.php", text, policy)] == ["one-two", "late-night-3"]
    assert len(seen) == 4


@pytest.mark.parametrize("category", ["magic_string", "hardcoded_entity", "hardcoded_ip_url", "env_outside_config", "literal"])
def test_one_category_as_of_all(spark, category):
    """A query for one category gets the same rows from the detector alone."""
    texts = {"src/a.php": "<?php\nif ($kind == 'late-night-3') {\n$x = env('A');\n$u = 'https://acme.io/x';\nif ($entityType === 'Order') {", "src/b.ts": "const a = process.env.B_1;\nif (kind === 'x-y-z') {\nconst ip = '10.1.2.3';"}
    files, _, _ = code_base(spark, texts)
    everything = sorted(r for r in H.scan(files).collect() if r.category == category)
    assert everything and sorted(H.scan(files, only=category).collect()) == everything


TREE = {
    "src/a.php": "<?php\nnamespace App;\nuse App\\Dep;\nuse App\\Other;\nuse Lib\\Long as Short;\nclass C {\n  private $lost = 1;\n  private function gone() { return 1; }\n  public function run() { new Dep(); }\n}",
    "pkg/b.py": "import os\nimport sys\nfrom a.b import c\nclass K:\n    def __own(self): return os.name\n", "pkg/odd.py": "def (", "src/c.rs": "use crate::a::{Bee, Cee};\nstruct S { own: i32 }\nfn f() { Bee::new(); }",
    "src/d.ts": "import { ay, bee } from './x';\nclass W {\n  private lost = 1;\n  private gone() { return 1; }\n}\nconsole.log(ay);", "src/e.vue": "<template>\n<user-card/>\n</template><script>\nimport UserCard from './a';\nimport OtherCard from './b';\n</script>",
    "src/f.rb": "class R\nend",
}


def test_texts_tell_what_the_index_tells(spark):
    """One reading of the files finds what the extraction, joined to the files again, finds."""
    files, symbols, dependencies = code_base(spark, TREE)
    want = sorted(D.in_file(files, symbols, dependencies).collect())
    assert {r.category for r in want} == {"unused_import", "unused_method", "unused_property"} and len({r.file_path for r in want}) >= 5
    assert sorted(D.in_texts(files).collect()) == want


@pytest.mark.parametrize("name", ["unused_python_imports", "unused_vue_imports", "unused_private_members", "unused_web_imports", "unused_rust_uses"])
def test_dead_code_moves_no_texts(spark, name):
    got = plan(catalog.queries()[name](spark, SMALL))
    assert got.count("MapInArrow") == 1 and "Join" not in got and got.count("Exchange") == 1  # the one that deals keys


@pytest.mark.parametrize("table", [X.extract, D.in_texts])
def test_names_of_the_parser_go_with_a_child(monkeypatch, table):
    """Python's parser keeps names for as long as its process lives, so workers leave Python files to children."""
    seen, parse = [], X.parse
    monkeypatch.setattr(X, "parse", lambda text: seen.append(text) or parse(text))
    for module in (X, D):
        monkeypatch.setattr(module, "map_rows", lambda df, function, schema: function)

    class Files:
        def select(self, *_):
            return self

    run = table(Files())
    assert len(run([(f"m{i}.py", "python", f"import a{i}\nx = 1") for i in range(50)])) == 50 and not seen
    assert run([("a.rb", "ruby", "class R\nend")]) is not None


def test_a_child_hands_over_rows_and_faults():
    assert in_child(lambda rows: [(os.getpid(), sum(rows))], [1, 2])[0][1] == 3 and in_child(lambda rows: [os.getpid()], [1]) != [os.getpid()]
    assert len(in_child(lambda rows: ["x" * 1000] * 5000, [1])) == 5000
    with pytest.raises(RuntimeError, match="ZeroDivisionError"):
        in_child(lambda rows: [1 // 0], [1])


@pytest.mark.parametrize(("extractor", "text"), [(X.ruby, "require 'a'\nclass R < B\n  include M\n  def go(a, b)\n    x = 'y'\n  end\nend\n" * 20), (X.web, "import a from 'b';\nclass W extends V {\n  private x = 1;\n  go(a) { return 'y'; }\n}\n" * 20)])
def test_extractors_keep_their_expressions(extractor, text):
    extractor("a", text)
    re.purge()
    assert len(extractor("a", text).symbols) >= 40
    assert len(re._cache) <= 3


def test_identifiers_of_a_long_script():
    """What stands before a name is looked at where it is; the text before it isn't copied for each."""
    text = "import { ay } from './x';\n" + "".join(f"f{i}(a.b{i});\n" for i in range(120_000))
    began = time.time()
    bound, used = T.js_imports(text)
    assert bound == [("ay", "./x", 1)] and len(used) == 120_001 and time.time() - began < 8


CLASSES = {
    "app/Sync.php": "<?php\nnamespace App;\nclass Sync {}\n", "app/x.hooks.php": "<?php\n$h = [Sync::class];\n", "app/Lonely.php": "<?php\nnamespace App;\nclass Lonely {}\ninterface Shy {} trait Quiet {} enum Suit {}\nfinal\nclass Apart {}\n",
    "app/Named.php": "<?php\nnamespace App;\nclass Named {}\nclass Short {}\nclass Other {}\n", "lib/Named.php": "<?php\nnamespace Lib;\nclass Named {}\nclass Short {}\nclass Other {}\n", "app/go.php": "<?php\n$c = 'App\\Named';\n$d = 'Nowhere\\Other';\nnew \\Lib\\Short();\n",
    "app/Ending.php": "<?php\nclass Ending {}\nclass A_b {}\n", "app/imp.php": "<?php\nuse Lib\\SomeEnding;\nuse Lib\\xaxB;\n", "app/Own.php": "<?php\nuse Own;\nclass Own {}\nclass Selfish {}\n'Selfish';", "tests/Un.php": "<?php\nclass Un {}", "app/Jobs/Auto.php": "<?php\nclass Auto {}",
    "src/lib.rs": "pub struct Kept {}\npub struct Alone {}\nstruct Hidden {}\npub trait Plain {}\npub enum E {}\nfn f() { let x: Alone; }", "src/user.rs": "fn f() { let k: Kept; }", "src/w.ts": "class Never {}\nexport default class $Odd {}", "pkg/m.py": "class Loose: pass\nclass Base: pass\nclass Sub(Base): pass\n",
}


@pytest.mark.parametrize(("policy", "compat", "least"), [(DeadCodePolicy(), False, 6), (DeadCodePolicy(), True, 2), (DeadCodePolicy(abandoned_languages=["rust", "typescript", "Python "], abandoned_entry_patterns=["src/l*"]), False, 3)])
def test_texts_tell_abandoned_classes(spark, policy, compat, least):
    index = code_base(spark, CLASSES)
    want = sorted(D.abandoned_classes(*index, policy, compat).collect())
    assert sorted(D.abandoned_in_texts(index[0], policy, compat).collect()) == want and len(want) >= least


def test_classes_are_told_by_one_reading(spark, monkeypatch):
    """Texts are read by one table function, and neither they nor their files are joined with what it found."""
    seen, made = [], D.map_rows
    for module in (X, D):
        monkeypatch.setattr(module, "map_rows", lambda df, *more: seen.append(df) or made(df, *more))
    got = plan(catalog.queries()["abandoned_classes"](spark, SMALL))
    assert len(seen) == 1 and "content" not in got and got.count("Join") <= 2


def test_classes_on_their_lines():
    rng = random.Random(6)
    for _ in range(3000):
        line = "".join(rng.choice(["class", "trait", "struct", " ", " ", "\t", "A", "B_1", "$", "é", "(", "\xa0"]) for _ in range(rng.randint(1, 9)))
        for name in ("A", "AA", "B_1", "$A", "A$", "Aé"):
            for word in ("class", "struct"):
                assert D.declares(line, word, name) == (re.search(rf"\b{word}[ \t]+{re.escape(name)}\b", line) is not None)


def test_a_name_of_many_files_has_one_row(spark):
    """Names that a batch of files uses come once, with the least and the greatest file."""
    files = spark.range(500).select(F.col("id").alias("file_id"), F.format_string("src/m%d.rs", "id").alias("path"), F.lit("rust").alias("language"), F.lit("use a::Error;\nfn f() { Error::new(); }").alias("content")).coalesce(1)
    assert rows(D.reference_tokens(files), "kind", "token", "low", "high") == [("rust", "Error", 0, 499)]
