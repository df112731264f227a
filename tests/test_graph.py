import random

from codequarry.functions import text as T
from codequarry.operators import graph as G
from codequarry.operators import resolve as R
from helpers import code_base, rows
from pyspark.sql import functions as F


def edges(spark, pairs):
    return G.fold_edges(spark.createDataFrame([(a, b, "import") for a, b in pairs], "src string, dst string, type string"))


def test_layers_and_modules(spark):
    df = spark.createDataFrame([("app/Http/Middleware/Auth.php",), ("src/models/a.py",), ("x.py",), ("resources/views/a/b.vue",), ("",)], "path string")
    got = df.select(T.layer_of(F.col("path")), T.module_of(F.col("path"))).collect()
    assert [tuple(r) for r in got] == [("middleware", "app/Http"), ("model", "src"), ("unknown", "x.py"), ("view", "resources/views"), ("unknown", "root")]


def test_globs(spark):
    import fnmatch
    import re

    for g in ("*.py", "**/x.php", "a?c", "[ab]*", "[!ab]*", "a[", "a.b"):
        for p in ("a/x.php", "x.php", "abc", "b/c", "c", "a[", "a.b", "axb", "t.py"):
            assert bool(re.match(T.glob_regex(g), p)) == fnmatch.fnmatchcase(p, g), (g, p)


def test_strong_edges(spark):
    df = spark.createDataFrame([("a", "b", "load"), ("b", "a", "inherit"), ("b", "c", "load"), ("b", "c", "import"), ("c", "c", "load")], "src string, dst string, type string")
    folded = G.fold_edges(df)
    assert rows(folded, "src", "dst", "weight") == [("a", "b", 1), ("b", "a", 1), ("b", "c", 2)]
    assert rows(G.strong_edges(folded), "src", "dst") == [("b", "a"), ("b", "c")]


def test_orphans(spark):
    files = spark.createDataFrame([(p,) for p in ("src/index.php", "src/old.php", "src/boot.php", "src/tool.php", "src/alone.php", "app/routes/web.php")], "path string")
    e = edges(spark, [("src/index.php", "src/boot.php"), ("src/old.php", "src/tool.php"), ("app/routes/web.php", "src/tool.php")])
    loads = spark.createDataFrame([("src/index.php",)], "path string")
    assert rows(G.orphan_files(files, e, loads), "path") == [("src/old.php",)]
    assert rows(G.entry_candidates(files, e, loads), "path") == [("app/routes/web.php",), ("src/index.php",)]
    assert rows(G.entry_candidates(files, e, loads, ["src/o*"]), "path") == [("app/routes/web.php",), ("src/index.php",), ("src/old.php",)]


def test_god_classes(spark):
    files = spark.createDataFrame([(1, "app/big.php"), (2, "tests/test_big.py"), (3, "pkg/two.py")], "file_id long, path string")
    sym = [(10, 1, "class", "Big", 1, 280, None), (20, 2, "class", "T", 1, 400, None), (30, 3, "class", "A", 1, 300, None), (31, 3, "class", "B", 301, 600, None)] + [(100 + i, 3, "method", "m", 1, 1, 30) for i in range(15)]
    symbols = spark.createDataFrame(sym, "symbol_id long, file_id long, type string, name string, line_start int, line_end int, parent_symbol_id long")
    deps = lambda t, n: spark.createDataFrame([(f, t) for f in (1, 2, 3) for _ in range(n)], "source_file_id long, type string")
    assert rows(G.god_classes(files, symbols, deps("import", 12)), "name", "method_count") == [("A", 15), ("Big", 0)]
    assert rows(G.god_classes(files, symbols, deps("register", 12)), "name") == [("A",)]


def test_coupling(spark):
    files = spark.createDataFrame([("a/x",), ("b/y",), ("c/z",), ("d/w",)], "path string")
    got = G.coupling(files, edges(spark, [("a/x", "b/y"), ("a/x", "c/z"), ("b/y", "c/z")]))
    assert [tuple(r) for r in got.collect()] == [("a", 0, 2, 1.0), ("b", 1, 1, 0.5), ("c", 2, 0, 0.0), ("d", 0, 0, 0.0)]


def test_components_and_cycles(spark):
    rng = random.Random(5)
    pairs = {(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}") for _ in range(55)}
    pairs = {(a, b) for a, b in pairs if a != b}
    e = edges(spark, sorted(pairs))
    one, many = G.strong_components(e), G.strong_components(e, one_task_up_to=0)
    assert rows(one, "path", "component", "size") == rows(many, "path", "component", "size")
    found = set()

    def walk(path):
        for a, b in pairs:
            if a == path[-1]:
                if b == path[0]:
                    found.add(tuple(path))
                elif b > path[0] and b not in path and len(path) < 6:
                    walk([*path, b])

    for n in {a for a, _ in pairs}:
        walk([n])
    assert {tuple(r.cycle) for r in G.cycles(e, most=10**6, components=one).collect()} == found
    assert G.cycles(e, most=3).count() == min(3, len(found))


def test_giant_component(spark):
    ring = [(f"f{i:03d}", f"f{(i + 1) % 210:03d}") for i in range(210)]
    got = G.cycles(edges(spark, ring), components=G.strong_components(edges(spark, ring))).collect()
    assert len(got) == 1 and got[0].giant and list(got[0].cycle) == [f"f{i:03d}" for i in range(20)]


def test_betweenness(spark):
    files = spark.createDataFrame([(x,) for x in "abcde"], "path string")
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "c")])
    got = {r.path: r.score for r in G.betweenness(files, e).collect()}
    # by hand: c lies between a, b, e and d; b and e each carry half of a's ways to c and to d
    assert got == {"c": 0.25, "b": 0.0833, "e": 0.0833}
    assert G.betweenness(files.limit(2), e).count() == 0
    rng = random.Random(3)
    many = [(f"n{rng.randrange(14):02d}", f"n{rng.randrange(14):02d}") for _ in range(60)]
    e, files = edges(spark, many), spark.createDataFrame([(f"n{i:02d}",) for i in range(14)], "path string")
    assert rows(G.betweenness(files, e), "path", "score") == rows(G.betweenness(files, e, adjacency_up_to=0), "path", "score")


def test_layer_violations(spark):
    e = edges(spark, [("app/models/a.py", "app/controllers/b.py"), ("app/controllers/b.py", "app/models/a.py"), ("x/y.py", "app/controllers/b.py")])
    assert rows(G.layer_violations(e), "source_file", "target_layer") == [("app/models/a.py", "controller")]
    known = spark.createDataFrame([("x/y.py", "Migration")], "path string, layer string")
    assert len(rows(G.layer_violations(e, layers=known), "source_file")) == 2
    assert G.layer_violations(e, excludes=["app/models/*"]).count() == 0


def edge_set(spark, tree, **kw):
    return set(rows(R.resolve(*code_base(spark, tree), **kw), "src", "dst"))


def test_resolve_python_and_php(spark):
    got = edge_set(spark, {
        "pkg/base.py": "class BaseThing: pass\n", "pkg/service.py": "from pkg.base import BaseThing\n", "pkg/deep.py": "import pkg.base.BaseThing.nested\n",
        "wp-admin/includes/class-wp-health.php": "<?php\nclass Health {}\n", "wp-admin/health.php": "<?php\nrequire 'wp-admin/includes/class-wp-health.php';\n",
        "app/A.php": "<?php\nnamespace App;\nclass Alpha {}\n", "app/B.php": "<?php\nuse App\\Alpha;\nclass Beta {}\n", "lib/C.php": "<?php\ninclude 'sub/only-here.php';\n", "lib/sub/only-here.php": "<?php\n", "lib/D.php": "<?php\ninclude 'nly.php';\n", "z/only.php": "<?php\n",
        "one/Twin.php": "<?php\nclass Twin {}\n", "two/Twin.php": "<?php\nclass Twin {}\n", "use.php": "<?php\nuse Twin;\n",
    })
    assert got == {("pkg/service.py", "pkg/base.py"), ("pkg/deep.py", "pkg/base.py"), ("wp-admin/health.php", "wp-admin/includes/class-wp-health.php"), ("app/B.php", "app/A.php"), ("lib/C.php", "lib/sub/only-here.php"), ("lib/D.php", "z/only.php")}


def test_resolve_ruby_and_web(spark):
    got = edge_set(spark, {
        "lib/shop/plugin.rb": "require 'shop/motor'\nmodule Shop\n  class Plugin\n    def x\n      Shop::Motor.new\n    end\n  end\nend\n", "lib/shop/motor.rb": "module Shop\n  class Motor\n  end\nend\n",
        "app/shop/admin/pics.rb": "module Shop\n  module Admin\n    class Pics\n      def y\n        Pic.find\n      end\n    end\n  end\nend\n", "app/shop/pic.rb": "module Shop\n  class Pic\n  end\nend\n",
        "web/main.ts": "import a from './util'\nimport b from '@/deep/thing'\nimport c from './dir'\n", "web/util.ts": "export const q = 1\n", "src/deep/thing.vue": "<script>\n</script>\n", "web/dir/index.js": "1\n",
    }, aliases={"@/": "src/"})
    assert {("lib/shop/plugin.rb", "lib/shop/motor.rb"), ("app/shop/admin/pics.rb", "app/shop/pic.rb"), ("web/main.ts", "web/util.ts"), ("web/main.ts", "src/deep/thing.vue"), ("web/main.ts", "web/dir/index.js")} <= got


def test_resolve_fuzzy(spark):
    tree = {"a/main.js": "import x from '@lib/odd/gadget'\n", "z/gadget.js": "1\n"}
    assert edge_set(spark, tree) == set()
    assert edge_set(spark, tree, fuzzy=True) == {("a/main.js", "z/gadget.js")}


def test_betweenness_takes_every_source(spark):
    """A ring of many files: the score of each is known, and any sample of sources gives other ones."""
    n = 5400
    ring = spark.range(n).select(F.format_string("f%04d", "id").alias("src"), F.format_string("f%04d", (F.col("id") + 1) % 60 + F.floor(F.col("id") / 60) * 60).alias("dst"))
    e = ring.select("src", "dst", F.array(F.lit("import")).alias("types"), F.lit(1).cast("long").alias("weight")).filter("substring(src, 2) % 60 <> 59")
    got = G.betweenness(ring.select(F.col("src").alias("path")), e, top=n).select("path", "score").collect()
    # chains of 60: what is i-th lies between i before it and 59 - i behind
    assert len(got) == n * 58 // 60
    assert {tuple(r) for r in got} == {(f"f{i:04d}", round((i % 60) * (59 - i % 60) / ((n - 1) * (n - 2)), 4)) for i in range(n) if i % 60 not in (0, 59)}


def weighted(seed, n, m):
    rng = random.Random(seed)
    return {(a, b): rng.randrange(1, 4) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b}


def test_adjacency_by_hand():
    """Against all shortest paths, enumerated."""
    import numpy as np

    for seed in range(8):
        edges = weighted(seed, 9, 26)
        graph = G.Adjacency(*(np.array(x, np.int32) for x in zip(*((a, b, w) for (a, b), w in edges.items()))))
        for s in {a for e in edges for a in e}:
            best: dict[int, list] = {}

            def walk(path, length):
                v = path[-1]
                if len(path) > 1 and (v not in best or length <= best[v][0]):
                    best[v] = [length, [*(best[v][1] if v in best and best[v][0] == length else []), path]]
                for (a, b), w in edges.items():
                    if a == v and b not in path:
                        walk([*path, b], length + w)

            walk([s], 0)
            want = dict.fromkeys(best, 0.0)
            for _, paths in best.values():
                for p in paths:
                    for v in p[1:-1]:
                        want[v] += 1 / len(paths)
            seen, got = graph.brandes(int(np.searchsorted(graph.known, s)))
            got = {int(graph.known[v]): x for v, x in zip(seen, got)}
            assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_betweenness_by_groups_of_sources(spark):
    from codequarry import session

    e = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", w) for (a, b), w in weighted(11, 14, 60).items()], "src string, dst string, weight long")
    files = spark.createDataFrame([(f"n{i:02d}",) for i in range(14)], "path string")
    whole = rows(G.betweenness(files, e), "path", "score")
    before = len(session._MADE)
    assert rows(G.betweenness(files, e, adjacency_up_to=0, at_once=70), "path", "score") == whole
    assert len(session._MADE) - before <= 4  # tables of the rounds are gone


def test_strong_ids(spark):
    """Over arrays, with components of many sizes and long chains between them; numbers, names and paths give the same."""
    import numpy as np

    rng = random.Random(7)
    pairs = {(rng.randrange(300), rng.randrange(300)) for _ in range(380)} | {(300 + i, 300 + (i + 1) % 40) for i in range(40)} | {(400 + i, 401 + i) for i in range(30)}
    pairs = sorted((a, b) for a, b in pairs if a != b)
    want = {v: tuple(c) for c in G.tarjan(pairs) for v in c}
    for few in (0, 100, 10**6):
        found = G.strong_ids(440, [(np.array([a for a, _ in x]), np.array([b for _, b in x])) for x in (pairs[::2], pairs[1::2])], few)
        groups: dict[int, list[int]] = {}
        for v, c in enumerate(found.tolist()):
            groups.setdefault(c if c >= 0 else -1 - v, []).append(v)
        assert {v: tuple(g) for g in groups.values() if len(g) > 1 for v in g} == want
    shift = 1 << 40
    e = spark.createDataFrame([(a + shift, b + shift) for a, b in pairs], "src long, dst long")
    names = spark.createDataFrame([(i + shift, f"n{i:03d}") for i in range(440)], "id long, path string")
    by_path = edges(spark, [(f"n{a:03d}", f"n{b:03d}") for a, b in pairs])
    one = rows(G.strong_components(by_path), "path", "component", "size")
    assert rows(G.strong_components(e, names=names), "path", "component", "size") == one == rows(G.strong_components(by_path, tarjan_up_to=0), "path", "component", "size")
    assert rows(G.cycles(e, most=10**6, components=G.strong_components(e, names=names), names=names), "cycle") == rows(G.cycles(by_path, most=10**6, components=G.strong_components(by_path)), "cycle")


def test_components_of_numbers_move_no_paths(spark):
    """Paths come to nodes when components are known; they aren't joined to edges."""
    from codequarry.plans import catalog

    edges_, names = catalog.part_numbers(spark, "/root/testdata/sf0.001")
    assert dict(edges_.dtypes)["src"] == "bigint"
    assert rows(G.strong_components(edges_, names=names), "path", "component", "size") == rows(G.strong_components(catalog.part_edges(spark, "/root/testdata/sf0.001"), one_task_up_to=0), "path", "component", "size")
