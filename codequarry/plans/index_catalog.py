"""Analyses of an index, of scanner output and of rules over the test tables, with SQL that says what must come out.

Expected symbols and dependencies stand as lists below, with @ for a row's number; SQL repeats them for each row of `part`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import literals as L
from codequarry.functions import text as T
from codequarry.operators import findings as N
from codequarry.operators import resolve as R
from codequarry.plans.catalog import Query, _t
from codequarry.plans.code_catalog import key, part_code, pick, size, text
from codequarry.session import map_rows, scratch, write_shared
from codequarry.sources import extract as X
from codequarry.sources import scanners as E
from codequarry.sources import store as S

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# extractors


def _expected(path: str, rows: list[tuple]) -> str:
    """SQL for (path, kind, type, name, namespace, visibility, line) of these rows in each file."""
    q = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    values = ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)
    return f"""SELECT replace('{path}', '@', CAST(p_partkey AS VARCHAR)) AS path, kind, type, replace(name, '@', CAST(p_partkey AS VARCHAR)) AS name, replace(namespace, '@', CAST(p_partkey AS VARCHAR)) AS namespace, visibility, CAST(line AS INTEGER) AS line
FROM part, (VALUES {values}) e(kind, type, name, namespace, visibility, line)"""


def _extracted(spark: SparkSession, d: str, path: str, language: str, content: str) -> DataFrame:
    rows = X.extract(part_code(spark, d, text(path), language, text(content)))
    return rows.select("path", "kind", "type", "name", "namespace", "visibility", F.col("line_start").alias("line"))


def _dep(type_: str, target: str, line: int) -> tuple:
    return "dependency", type_, target, None, None, line


def _sym(type_: str, name: str, namespace: str | None, visibility: str, line: int) -> tuple:
    return "symbol", type_, name, namespace, visibility, line


@query(_expected("pkg/sub/m_@.py", [_sym("class", "Service@", "pkg.sub.m_@", "public", 4), _sym("property", "cache_key", "pkg.sub.m_@", "public", 5), _sym("method", "run", "pkg.sub.m_@", "public", 7), _sym("method", "__own", "pkg.sub.m_@", "private", 9), _sym("method", "_half", "pkg.sub.m_@", "protected", 11), _sym("function", "helper@", "pkg.sub.m_@", "public", 14),
    _dep("import", "pkg.sub.base.Base@", 1), _dep("import", "django.http@", 2), _dep("import", "pkg.up.thing@", 3), _dep("inherit", "Base@", 4)]))
def extract_python(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d, "pkg/sub/m_@.py", "python", 'from .base import Base@\nimport django.http@\nfrom ..up import thing@\nclass Service@(Base@):\n    cache_key = "x"\n\n    def run(self, a: int) -> str:\n        return "x"\n    def __own(self):\n        pass\n    def _half(self):\n        pass\n\ndef helper@(value):\n    return value')


@query("SELECT CASE p_size % 3 WHEN 2 THEN '' ELSE 'x' || p_partkey || CASE p_size % 3 WHEN 0 THEN '.m' ELSE '' END END AS module, p_partkey AS n FROM part WHERE p_size % 3 < 2 UNION ALL SELECT 'p' || p_partkey, p_partkey FROM part WHERE p_size % 3 = 2")
def python_modules(spark: SparkSession, d: str) -> DataFrame:
    """Module names of paths; a package is its folder."""
    path = pick(size(), "x@/m.py", "./x@.py", "p@/__init__.py")
    return _t(spark, d, "part").select(R.module_name(path).alias("module"), F.col("p_partkey").alias("n"))


@query(_expected("src/A@.php", [_sym("class", "A@", "App\\Mod", "public", 5), _sym("property", "own", "App\\Mod", "private", 6), _sym("method", "run", "App\\Mod", "public", 7), _sym("interface", "Face@", "App\\Mod", "public", 9), _sym("trait", "Mix@", "App\\Mod", "public", 10), _sym("enum", "Kind@", "App\\Mod", "public", 11), _sym("function", "free@", "App\\Mod", "public", 12),
    _dep("import", "App\\Dep@", 3), _dep("load", "inc/file@.php", 4), _dep("inherit", "Base@", 5), _dep("implement", "Face@", 5), _dep("register", "boot@", 13), _dep("register", "Reg@", 14), _dep("register", "Mail@", 14), _dep("import", "Pointers@", 15), _dep("import", "Table@", 16)]))
def extract_php(spark: SparkSession, d: str) -> DataFrame:
    """Declarations, includes, callbacks named in arrays and calls, registrations; each dependency once a line."""
    return _extracted(spark, d, "src/A@.php", "php", "<?php\nnamespace App\\Mod;\nuse App\\Dep@;\nrequire_once ABSPATH . 'inc/file@.php';\nabstract class A@ extends Base@ implements Face@ {\n  private $own = 1;\n  public function run(Dep@ $d) { return new Other@(); }\n}\ninterface Face@ {}\ntrait Mix@ {}\nenum Kind@ {}\nfunction free@() {}\nadd_action('init', 'boot@');\nEvent::listen(Reg@::class, Mail@::class);\n$x = array('Pointers@', 'enqueue');\n_get_list_table('Table@'); _get_list_table('Table@');")


@query(_expected("lib/a@.rb", [_sym("module", "Spina", None, "public", 3), _sym("module", "Admin", "Spina", "public", 4), _sym("class", "Plugin@", "Spina::Admin", "public", 5), _sym("method", "run", "Spina::Admin::Plugin@", "public", 7),
    _dep("load", "set@", 1), _dep("load", "engine@", 2), _dep("inherit", "Base@", 5), _dep("implement", "Cms::Concern@", 6), _dep("import", "Image@", 8), _dep("import", "Spina::Media@", 9)]))
def extract_ruby(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d, "lib/a@.rb", "ruby", 'require "set@"\nrequire_relative "engine@"\nmodule Spina\n  module Admin\n    class Plugin@ < Base@\n      include Cms::Concern@\n      def run\n        Image@.find(1)\n        Spina::Media@.new\n      end\n    end\n  end\nend')


@query(_expected("src/a@.rs", [_sym("module", "inner@", None, "private", 2), _sym("class", "Service@", None, "public", 3), _sym("property", "cache", "Service@", "private", 3), _sym("enum", "Kind@", None, "private", 4), _sym("interface", "Runner@", None, "public", 5), _sym("method", "run", "Service@", "public", 8), _sym("function", "helper@", None, "private", 10),
    _dep("import", "crate::http::Client@", 1), _dep("import", "crate::http::Server@", 1), _dep("implement", "Runner@", 6)]))
def extract_rust(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d, "src/a@.rs", "rust", "use crate::http::{Client@, Server@};\nmod inner@;\npub struct Service@ { cache: Cache@ }\nenum Kind@ { A }\npub trait Runner@ {}\nimpl Runner@ for Service@ {}\nimpl Service@ {\n    pub fn run(&self) {}\n}\nfn helper@() {}")


@query(_expected("src/a@.ts", [_sym("class", "Store@", None, "public", 3), _sym("property", "cache", None, "private", 4), _sym("property", "own", None, "private", 5), _sym("method", "flush", None, "private", 6), _sym("method", "run", None, "public", 7), _sym("function", "make@", None, "public", 9), _dep("import", "./b@", 1), _dep("import", "./c@", 2)]))
def extract_typescript(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d, "src/a@.ts", "typescript", "import { b@ } from './b@';\nexport * from './c@';\nexport class Store@ extends Base@ {\n  #cache = new Map();\n  private own = 1;\n  #flush(): void {}\n  run() { return 1; }\n}\nexport function make@() {}")


@query(_expected("src/a@.vue", [_sym("function", "f@", None, "public", 6), _dep("import", "./x@", 4)]))
def extract_vue(spark: SparkSession, d: str) -> DataFrame:
    """The first script, with the lines of the whole file."""
    return _extracted(spark, d, "src/a@.vue", "vue", "<template>\n</template>\n<script>\nimport x@ from './x@';\nexport default {}\nfunction f@() {}\n</script>\n<script>\nfunction g@() {}\n</script>")


@query("SELECT 'src/K' || p_partkey || '.php' AS path, 'run' AS name, 'K' || p_partkey AS parent FROM part UNION ALL SELECT 'src/K' || p_partkey || '.php', 'own', 'K' || p_partkey FROM part UNION ALL SELECT 'src/K' || p_partkey || '.php', 'K' || p_partkey, NULL FROM part UNION ALL SELECT 'src/K' || p_partkey || '.php', 'free', NULL FROM part")
def symbol_parents(spark: SparkSession, d: str) -> DataFrame:
    """Members are linked to their classes as the index stores them."""
    files = part_code(spark, d, text("src/K@.php"), "php", text("<?php\nclass K@ {\n  private $own = 1;\n  function run() {}\n}\nfunction free() {}"))
    symbols = write_shared(X.symbols_of(X.extract(files)).select("symbol_id", "file_id", "name", "parent_symbol_id"), "symbols")
    parents = symbols.select(F.col("symbol_id").alias("parent_symbol_id"), F.col("name").alias("parent"))
    # rows of a file's size: its statistics don't tell how many they are, so they aren't left to be broadcast
    return symbols.join(parents.hint("merge"), "parent_symbol_id", "left").join(files.select("file_id", "path").hint("merge"), "file_id").select("path", "name", "parent")


# scan and store

_EXT = ["py", "php", "rb", "rs", "ts", "tsx", "js", "vue", "go", "java", "kt", "cs", "md"]
_LANG = ["python", "php", "ruby", "rust", "typescript", "typescript", "javascript", "vue"]


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a tree of files in thirteen languages."""
    ext = F.array(*(F.lit(x) for x in _EXT))[(key() % 13).cast("int")]
    return _t(spark, d, "part").select(F.concat(text("dir_@/f."), F.when(size() % 2 == 0, F.upper(ext)).otherwise(ext)).alias("path"), size().cast("long").alias("size"), F.timestamp_seconds(key()).alias("last_modified"), text("x @").alias("content"))


@query(f"SELECT {str(_LANG)}[p_partkey % 13 + 1] AS language, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_partkey % 13 < 8 GROUP BY 1")
def language_detection(spark: SparkSession, d: str) -> DataFrame:
    """Languages by extension, whatever its case; others aren't indexed."""
    return S.language_breakdown(S.files_of(_tree(spark, d)))


@query("SELECT ['go', 'java', 'kotlin', 'csharp'][p_partkey % 13 - 7] AS language, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_partkey % 13 BETWEEN 8 AND 11 GROUP BY 1")
def unsupported_languages(spark: SparkSession, d: str) -> DataFrame:
    return S.unsupported_of(_tree(spark, d))


def _index(spark: SparkSession, d: str) -> S.Index:
    """An index whose files are parts and whose dependencies are lines of orders."""
    index = S.Index(spark, scratch(spark, "index"))
    files = S.files_of(_tree(spark, d))
    index.write("files", files)
    homes = _t(spark, d, "part").select(key().alias("l_partkey"), F.concat(text("dir_@/f."), F.when(size() % 2 == 0, F.upper(F.array(*(F.lit(x) for x in _EXT))[(key() % 13).cast("int")])).otherwise(F.array(*(F.lit(x) for x in _EXT))[(key() % 13).cast("int")])).alias("path"))
    lines = _t(spark, d, "lineitem").join(homes, "l_partkey").withColumn("source_file_id", X.file_id())
    index.write("dependencies", lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("dep_id"), "source_file_id", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target_name"), F.lit("import").alias("type"), F.col("l_linenumber").cast("int").alias("line")))
    return index


@query("SELECT CAST(count(*) FILTER (p_partkey % 13 < 8) AS BIGINT) AS files, (SELECT CAST(count(*) AS BIGINT) FROM lineitem) AS dependencies FROM part")
def index_counts(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    n = lambda t: index.read(t).agg(F.count("*").alias(t))
    return n("files").crossJoin(n("dependencies"))


@query("SELECT 'dir_2/f.' || CASE p_size % 2 WHEN 0 THEN 'RB' ELSE 'rb' END AS path, 's' || l_suppkey AS target_name, CAST(l_linenumber AS INTEGER) AS line FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_partkey = 2")
def index_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A file by its path, and its dependencies."""
    index = _index(spark, d)
    path = _t(spark, d, "part").filter("p_partkey = 2").select(F.when(size() % 2 == 0, "dir_2/f.RB").otherwise("dir_2/f.rb").alias("path")).first()["path"]
    return index.file(path).select("file_id", "path").join(index.dependencies_in(path).withColumnRenamed("source_file_id", "file_id"), "file_id").select("path", "target_name", "line")


@query("SELECT CASE WHEN p_partkey % 13 < 8 AND p_partkey % 5 <> 0 THEN p_partkey END AS n, CAST((SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS BIGINT) AS dependencies FROM part WHERE p_partkey % 13 < 8 AND p_partkey % 5 <> 0")
def index_prune_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Files that are gone (every fifth) take their dependencies with them."""
    index = _index(spark, d)
    files = index.read("files").withColumn("n", F.regexp_extract("path", r"dir_(\d+)/", 1).cast("long"))
    kept = S.prune(files, files.filter("n % 5 <> 0").select("path"))
    gone = files.join(kept.select("path"), "path", "left_anti").select("file_id")
    deps = S.cascade(index.read("dependencies"), "source_file_id", gone).groupBy(F.col("source_file_id").alias("file_id")).agg(F.count("*").alias("dependencies"))
    return kept.join(deps, "file_id", "left").select("n", F.coalesce("dependencies", F.lit(0)).cast("long").alias("dependencies"))


@query("SELECT p_partkey AS file_id, CASE WHEN p_partkey % 3 = 0 THEN 'new ' ELSE 'old ' END || p_partkey AS summary FROM part UNION ALL SELECT p_partkey + 10000000, 'new ' || p_partkey FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 0")
def upsert_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a key replace those there are, others are added."""
    old = _t(spark, d, "part").select(key().alias("file_id"), text("old @").alias("summary"))
    new = _t(spark, d, "part").filter("p_partkey % 3 = 0").select(F.explode(F.when(key() % 2 == 0, F.array(key(), key() + 10000000)).otherwise(F.array(key()))).alias("file_id"), text("new @").alias("summary"))
    return S.upsert(old, new, "file_id")


@query("SELECT 'files' AS name, CAST((SELECT count(*) FROM part) AS VARCHAR) AS value UNION ALL SELECT 'orders', CAST((SELECT count(*) FROM orders) AS VARCHAR)")
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of a run, among those of others."""
    index = S.Index(spark, scratch(spark, "index"))
    index.append_metrics("run-1", {"files": "0"})
    index.append_metrics("run-2", {"files": str(_t(spark, d, "part").count()), "orders": str(_t(spark, d, "orders").count())})
    return S.metrics_of(index.read("metrics"), "run-2").select(F.explode("metrics").alias("name", "value"))


# paths

_PATHS = "CASE p_partkey % 10 WHEN 0 THEN 'tests/a.py' WHEN 1 THEN 'src/latest.py' WHEN 2 THEN 'src/a_spec.rb' WHEN 3 THEN 'spec/a.rb' WHEN 4 THEN 'src/a_test.rs' WHEN 5 THEN 'src/plain.rs' WHEN 6 THEN 'vendor/x/y.php' WHEN 7 THEN 'app/HTTP/Fixtures/z.php' WHEN 8 THEN 'src/Contest.php' ELSE 'build/out.js' END || ''"


@query(f"""WITH p AS (SELECT p_partkey AS n, {_PATHS} AS path FROM part)
SELECT n, path, n % 10 IN (0, 1, 2, 3, 4, 7, 8) AS contracts, n % 10 IN (0, 1, 4, 7, 8) AS dead_code, n % 10 IN (0, 1, 2, 3, 4, 7, 8) AS hardwiring, n % 10 IN (6, 9) AS excluded FROM p""")
def path_filters(spark: SparkSession, d: str) -> DataFrame:
    """Test-like paths, which detectors see differently, and globs, whose star crosses slashes."""
    path = pick(key(), "tests/a.py", "src/latest.py", "src/a_spec.rb", "spec/a.rb", "src/a_test.rs", "src/plain.rs", "vendor/x/y.php", "app/HTTP/Fixtures/z.php", "src/Contest.php", "build/out.js")
    p = F.col("path")
    return _t(spark, d, "part").select(key().alias("n"), path.alias("path")).select("n", "path", *(T.test_like(p, k).alias(k) for k in ("contracts", "dead_code", "hardwiring")), T.matches_glob(p, ["vendor/*.php", "buil[a-d]/?ut.js", "nothing"]).alias("excluded"))


@query("""SELECT p_partkey AS n, p_partkey % 6 = 0 AS command, p_partkey % 6 IN (1, 2) AS config, p_partkey % 6 = 3 AS bootstrap, p_partkey % 6 = 4 AS noise, p_partkey % 6 IN (0, 5) AS interactive FROM part""")
def path_classes(spark: SparkSession, d: str) -> DataFrame:
    """What the detectors take a path for, by the predicates they use."""
    path = pick(key(), "app/Console/c@.php", "config/c@.php", "tools/c@.js", "x@/settings/base.py", "db@/database/seeders/a.php", "web@/assets/a.js")

    def run(rows):
        return [(n, L.is_command(p), L.is_config(p), L.is_bootstrap(p), L.is_entity_noise(p), L.is_interactive(p)) for n, p in rows]

    return map_rows(_t(spark, d, "part").select(key().cast("long").alias("n"), path.alias("path")), run, "n long, command boolean, config boolean, bootstrap boolean, noise boolean, interactive boolean")


# resolving

_STAGES = {3: "Mod::Deep::Name@", 6: "../lib/req@", 7: "lib7/suf@", 8: "inc/p@.php", 9: "wp-admin/q@.php", 10: "../../up/uniq@.php", 12: "./js@"}


@query("""WITH k AS (SELECT p_partkey AS n, p_partkey % 8 AS kind FROM part)
SELECT n AS dep_id, CASE kind WHEN 0 THEN 'sym/n' || n || '.rb' WHEN 1 THEN 'src/lib/req' || n || '.rb' WHEN 2 THEN 'deep/lib7/suf' || n || '.rb' WHEN 3 THEN 'inc/p' || n || '.php' WHEN 4 THEN 'site/wp-admin/q' || n || '.php' WHEN 5 THEN 'far/away/uniq' || n || '.php' WHEN 6 THEN 'src/app/./js' || n || '.tsx' ELSE 'scope/s' || n || '.rb' END AS dst,
CAST(CASE kind WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 7 WHEN 3 THEN 8 WHEN 4 THEN 9 WHEN 5 THEN 10 WHEN 6 THEN 12 ELSE 4 END AS INTEGER) AS stage FROM k""".replace("'src/app/./js'", "'src/app/js'"))
def resolver_stages(spark: SparkSession, d: str) -> DataFrame:
    """Last segment after ::, Ruby's relative and suffix require, PHP's exact, well-known and file-name includes, JavaScript's relative import with an ending, Ruby's scope."""
    part = _t(spark, d, "part")
    n = key()
    home = pick(n, "sym/n@.rb", "src/lib/req@.rb", "deep/lib7/suf@.rb", "inc/p@.php", "site/wp-admin/q@.php", "far/away/uniq@.php", "src/app/js@.tsx", "scope/s@.rb")
    files = part.select((n * 2).alias("file_id"), home.alias("path"), F.when(n % 8 == 6, "typescript").when((n % 8).isin(3, 4, 5), "php").otherwise("ruby").alias("language"), n.alias("n"))
    users = part.select((n * 2 + 1).alias("file_id"), F.concat(pick(n, "u/a@", "src/app/a@", "u/a@", "u/a@", "u/a@", "u/a@", "src/app/a@", "u/a@"), F.when(n % 8 == 6, ".ts").when((n % 8).isin(3, 4, 5), ".php").otherwise(".rb")).alias("path"), F.when(n % 8 == 6, "typescript").when((n % 8).isin(3, 4, 5), "php").otherwise("ruby").alias("language"), n.alias("n"))
    none = F.lit(None).cast("string")
    symbols = files.filter("n % 8 in (0, 7)").select("file_id", F.lit("class").alias("type"), text("Name@", F.col("n").cast("string")).alias("name"), F.when(F.col("n") % 8 == 7, text("Outer@", F.col("n").cast("string"))).otherwise(none).alias("namespace"))
    # a second file has the name of a scoped class, so that the bare name tells none
    twins = users.filter("n % 8 = 7").select("file_id", F.lit("class").alias("type"), text("Here@", F.col("n").cast("string")).alias("name"), F.concat(text("Outer@", F.col("n").cast("string")), F.lit("::Inner")).alias("namespace"))
    shadow = part.filter("p_partkey % 8 = 7").select((n * 2 + 1).alias("file_id"), F.lit("class").alias("type"), text("Name@").alias("name"), F.lit("Elsewhere").alias("namespace"))
    target = pick(n, "Mod::Deep::Name@", "../lib/req@", "lib7/suf@", "inc/p@.php", "wp-admin/q@.php", "../../up/uniq@.php", "./js@", "Name@")
    deps = part.select(n.alias("dep_id"), (n * 2 + 1).alias("source_file_id"), target.alias("target_name"), F.lit("import").alias("type"))
    found = R.resolve(files.drop("n").unionByName(users.drop("n")), symbols.unionByName(twins).unionByName(shadow), deps)
    return found.select("dep_id", "dst", "stage")


# scanners


def _event(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").filter("event_type is not null and user_id is not null and event_id is not null")


def _payload(spark: SparkSession, d: str, template: str, lines: int = 1) -> DataFrame:
    """The template as JSON with a row's event for @e, its user for @u, its type for @t, one of `lines` lines for @l, and a lint's origin for @c; every seventh row is broken off, which gives nothing."""
    out = F.lit(template)
    for mark, value in (("@e", F.col("event_id").cast("string")), ("@u", F.col("user_id").cast("string")), ("@t", F.col("event_type")), ("@l", (F.col("event_id") % lines + 1).cast("string")), ("@c", F.when(F.col("event_id") % 2 == 0, "clippy").otherwise("rustc"))):
        out = F.replace(out, F.lit(mark), value)
    return _event(spark, d).select(F.when(F.col("event_id") % 7 == 6, F.lit("no JSON")).otherwise(out).alias("payload"))


_SHOWN = ["tool", "domain", "category", "rule_id", "severity", "confidence", "file_path", "line", "message", "fingerprint"]
_EVENTS = "WITH e AS (SELECT event_id AS e, user_id AS u, event_type AS t FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND event_id % 7 < 6) "


def _told(tool: str, domain: str, category: str, rule: str, severity: str, confidence: str, path: str, line: str, message: str, mark: str, more: str = "FROM e") -> str:
    return f"SELECT '{tool}' AS tool, '{domain}' AS domain, '{category}' AS category, {rule} AS rule_id, {severity} AS severity, '{confidence}' AS confidence, {path} AS file_path, CAST({line} AS INTEGER) AS line, {message} AS message, {mark} AS fingerprint {more}"


@query(_EVENTS + _told("gitleaks", "security", "secrets", "'rule-' || t", "'high'", "medium", "'app/u' || u || '.py'", "e % 50 + 1", "'Found ' || t", "'fp:' || e", "FROM e"))
def scan_gitleaks(spark: SparkSession, d: str) -> DataFrame:
    rows = _event(spark, d).filter("event_id % 7 < 6").select(F.concat(F.lit("["), F.to_json(F.struct(F.concat(F.lit("rule-"), "event_type").alias("RuleID"), F.concat(F.lit(" Found "), "event_type").alias("Description"), F.concat(F.lit("/root/app/u"), F.col("user_id").cast("string"), F.lit(".py")).alias("File"), (F.col("event_id") % 50 + 1).alias("StartLine"), F.concat(F.lit("fp:"), F.col("event_id").cast("string")).alias("Fingerprint"))), F.lit("]")).alias("payload"))
    return E.gitleaks(rows.union(_payload(spark, d, "no").filter("payload = 'no JSON'")), "/root").select(_SHOWN)


@query(_EVENTS + _told("pip-audit", "security", "sca", "'PYSEC-' || e", "'high'", "high", "''", "1", "'pkg-' || t || ' 1.' || u || ' is affected by PYSEC-' || e", "sha256('pip-audit:{\"id\": \"PYSEC-' || e || '\", \"name\": \"pkg-' || t || '\", \"version\": \"1.' || u || '\"}')"))
def scan_pip_audit(spark: SparkSession, d: str) -> DataFrame:
    return E.pip_audit(_payload(spark, d, '{"dependencies": [{"name": "pkg-@t", "version": "1.@u", "vulns": [{"id": "PYSEC-@e", "aliases": ["CVE-@e"], "fix_versions": ["2"]}]}, {"name": "fine", "version": "1", "vulns": []}]}')).select(_SHOWN)


@query(_EVENTS + _told("osv-scanner", "security", "sca", "'GHSA-' || e", "'high'", "high", "''", "1", "'p' || u || ' 2.0 is affected by GHSA-' || e", "sha256('osv-scanner:{\"id\": \"GHSA-' || e || '\", \"name\": \"p' || u || '\", \"version\": \"2.0\"}')"))
def scan_osv(spark: SparkSession, d: str) -> DataFrame:
    return E.osv_scanner(_payload(spark, d, '{"results": [{"packages": [{"package": {"name": "p@u", "version": "2.0", "ecosystem": "npm"}, "vulnerabilities": [{"id": "GHSA-@e", "summary": "@t"}]}]}]}')).select(_SHOWN)


@query(_EVENTS + _told("phpstan", "quality", "static_analysis", "'rule.' || t", "'medium'", "high", "'src/U' || u || '.php'", "e % 90 + 1", "'Message ' || e", "sha256('phpstan:{\"file\": \"src/U' || u || '.php\", \"line\": ' || (e % 90 + 1) || ', \"message\": \"Message ' || e || '\", \"rule\": \"rule.' || t || '\"}')"))
def scan_phpstan(spark: SparkSession, d: str) -> DataFrame:
    return E.phpstan(_payload(spark, d, '{"files": {"src/U@u.php": {"messages": [{"identifier": "rule.@t", "line": @l, "message": " Message @e "}]}}}', 90)).select(_SHOWN)


@query(_EVENTS + _told("composer-audit", "security", "sca", "'PKSA-' || e", "'medium'", "high", "'composer.lock'", "1", "'acme/' || t || ': Title ' || u", "sha256('composer-audit:{\"id\": \"PKSA-' || e || '\", \"package\": \"acme/' || t || '\"}')") + " UNION ALL "
       + _told("composer-audit", "security", "abandoned_dependency", "'abandoned-package'", "'medium'", "high", "'composer.lock'", "1", "'old/p' || u || ': package is abandoned'", "sha256('composer-audit:{\"package\": \"old/p' || u || '\", \"replacement\": \"new/p\"}')"))
def scan_composer_audit(spark: SparkSession, d: str) -> DataFrame:
    return E.composer_audit(_payload(spark, d, '{"advisories": {"acme/@t": [{"advisoryId": "PKSA-@e", "title": "Title @u", "severity": "MEDIUM"}]}, "abandoned": {"old/p@u": "new/p"}}')).select(_SHOWN)


@query(_EVENTS + _told("npm-audit", "security", "sca", "'10' || e", "'critical'", "high", "'package-lock.json'", "1", "'pkg-' || t || ': Bug ' || u", "sha256('npm-audit:{\"package\": \"pkg-' || t || '\", \"rule\": \"10' || e || '\"}')"))
def scan_npm_audit(spark: SparkSession, d: str) -> DataFrame:
    """The first object among strings and objects tells the advisory."""
    return E.npm_audit(_payload(spark, d, '{"vulnerabilities": {"pkg-@t": {"severity": "Critical", "via": ["other", {"source": 10@e, "title": "Bug @u"}], "isDirect": true}}}')).select(_SHOWN)


@query(_EVENTS + _told("cargo-clippy", "quality", "lint", "'clippy::' || t", "'high'", "high", "'src/u' || u || '.rs'", "e % 70 + 1", "'Lint ' || e", "sha256('cargo-clippy:{\"file\": \"src/u' || u || '.rs\", \"line\": ' || (e % 70 + 1) || ', \"message\": \"Lint ' || e || '\", \"rule_id\": \"clippy::' || t || '\"}')", "FROM e WHERE e % 2 = 0"))
def scan_cargo_clippy(spark: SparkSession, d: str) -> DataFrame:
    """Only clippy's own messages count (every second one here), at their primary place."""
    return E.cargo_clippy(_payload(spark, d, '{"reason": "compiler-message", "message": {"message": "Lint @e", "level": "error", "code": {"code": "@c::@t"}, "spans": [{"file_name": "src/other.rs", "line_start": 1, "is_primary": false}, {"file_name": "src/u@u.rs", "line_start": @l, "is_primary": true}]}}', 70)).select(_SHOWN)


@query(_EVENTS + _told("cargo-deny", "security", "sca", "'RUSTSEC-' || e", "'high'", "high", "'Cargo.lock'", "e % 30 + 1", "'Denied ' || t", "sha256('cargo-deny:{\"advisory_id\": \"RUSTSEC-' || e || '\", \"code\": \"vulnerability\", \"file\": \"Cargo.lock\", \"line\": ' || (e % 30 + 1) || ', \"message\": \"Denied ' || t || '\"}')"))
def scan_cargo_deny(spark: SparkSession, d: str) -> DataFrame:
    return E.cargo_deny(_payload(spark, d, '{"type": "diagnostic", "fields": {"code": "vulnerability", "message": "Denied @t", "severity": "error", "advisory": {"id": "RUSTSEC-@e"}, "labels": [{"file": "Cargo.lock", "line": @l}]}}', 30)).select(_SHOWN)


def _ruff(spark: SparkSession, d: str) -> DataFrame:
    e = _event(spark, d)
    code = F.when(F.col("event_id") % 3 == 0, "S101").when(F.col("event_id") % 3 == 1, "S105").otherwise("S324")
    path = F.concat(F.when(F.col("user_id") % 2 == 0, "app/tests/t").otherwise("app/a"), F.col("user_id").cast("string"), F.lit(".py"))
    message = F.when(F.col("user_id") % 4 == 1, 'Possible hardcoded password assigned to: "token_url"').otherwise("Bad")
    item = F.struct(code.alias("code"), path.alias("filename"), F.struct((F.col("event_id") % 5 + 1).cast("int").alias("row")).alias("location"), message.alias("message"))
    return E.ruff(e.select(F.concat(F.lit("["), F.to_json(item), F.lit("]")).alias("payload")))


_RUFF = """WITH e AS (SELECT CASE event_id % 3 WHEN 0 THEN 'S101' WHEN 1 THEN 'S105' ELSE 'S324' END AS rule_id, CASE user_id % 2 WHEN 0 THEN 'app/tests/t' ELSE 'app/a' END || user_id || '.py' AS file_path, event_id % 5 + 1 AS line, user_id % 4 = 1 AS url, user_id % 2 = 0 AS test FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND event_id IS NOT NULL),
k AS (SELECT DISTINCT rule_id, file_path, line, url FROM e WHERE NOT (rule_id = 'S101' AND test))"""


@query(_RUFF + " SELECT rule_id, file_path, CAST(line AS INTEGER) AS line, CASE WHEN rule_id = 'S105' AND url THEN 'low' WHEN rule_id = 'S101' THEN 'medium' ELSE 'high' END AS severity, file_path || ':' || line || ':' || rule_id AS fingerprint FROM k")
def scanner_refinement(spark: SparkSession, d: str) -> DataFrame:
    """Assertions in tests go, names of addresses aren't passwords, and of a fingerprint one finding stays."""
    return E.refined(_ruff(spark, d)).select("rule_id", "file_path", "line", "severity", "fingerprint")


@query(_RUFF + " SELECT 'ruff' AS tool, CAST((SELECT count(*) FROM e) AS BIGINT) AS raw_finding_count, CAST((SELECT count(*) FROM k) AS BIGINT) AS finding_count, CAST((SELECT count(*) FROM e) - (SELECT count(*) FROM k) AS BIGINT) AS filtered_count")
def scanner_counts(spark: SparkSession, d: str) -> DataFrame:
    raw = _ruff(spark, d)
    return E.counts(raw, E.refined(raw))


# rules

_BASES = ["ServiceProvider", "Vendor\\\\ServiceProvider", "Base", "ServiceProviderX"]


@query("""WITH f AS (SELECT p_partkey AS n, p_partkey % 4 AS base, p_size % 3 AS face, p_size % 5 AS layer FROM part)
SELECT n, CASE WHEN base < 2 THEN 'by-base' WHEN face = 1 THEN 'by-face' WHEN layer = 2 OR layer = 3 THEN 'by-layer' WHEN n % 7 = 1 THEN 'by-hint' END AS rule_id FROM f""")
def structural_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules that look at ancestors, interfaces, layers and type hints elsewhere; the first that holds counts."""
    part = _t(spark, d, "part")
    path = F.when(size() % 5 == 3, text("src/Domain/C@.php")).otherwise(text("src/C@.php"))
    files = part.select(key().alias("file_id"), path.alias("path"), F.lit("php").alias("language"), F.lit("").alias("content"))
    base = pick(key(), F.lit("ServiceProvider"), F.lit("Vendor\\ServiceProvider"), F.lit("Base"), F.lit("ServiceProviderX"))
    face = pick(size(), F.lit("Other"), F.lit("Lib\\Contract"), F.lit("Contractual"))
    dep = lambda kind, target, source=key(): part.select(source.alias("source_file_id"), target.alias("target_name"), F.lit(kind).alias("type"))
    hints = dep("import", text("App\\C@Class"), key() + 1).filter((F.col("source_file_id") - 1) % 7 == 1)
    deps = dep("inherit", base).unionByName(dep("implement", face)).unionByName(hints)
    found = part.select(path.alias("file_path"), F.lit(1).alias("line"), F.lit("abandoned_class").alias("category"), text("App\\C@Class").alias("name"), key().alias("n"))
    layers = part.select(key().alias("file_id"), F.when(size() % 5 == 2, "DOMAIN").otherwise("other").alias("layer"))
    rules = [("by-base", "abandoned_class", [("inherits", {"ancestor": "ServiceProvider"})]), ("by-face", "abandoned_class", [("implements", {"interface": "Contract"})]), ("by-layer", "abandoned_class", [("file_in_layer", {"layer": "domain"})]), ("by-hint", "abandoned_class", [("referenced_as_type_hint", {})])]
    return N.attribute(N.prepare(found, files, deps, layers), rules).select("n", "rule_id")


@query("""SELECT 'rule-' || left(md5('magic_string:src/f' || p_partkey || '.php:v' || p_partkey), 8) AS id, 'src/f' || p_partkey || '.php' AS pattern, 'v' || p_partkey AS substring, 'probationary' AS status FROM part WHERE p_size % 3 = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY p_partkey) = 1""")
def rules_from_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Each false positive becomes a rule on probation for its file and name."""
    verdicts = _t(spark, d, "part").select(text("src/f@.php").alias("file_path"), F.lit(1).alias("line"), F.lit("magic_string").alias("category"), F.lit("").alias("name"), text("v@").alias("value"), pick(size(), F.lit("true_positive"), F.lit("false_positive"), F.lit("needs_context")).alias("verdict"), F.lit("r").alias("reason"))
    r = N.rules_from_verdicts(verdicts)
    return r.select("id", F.col("checks")[0]["params"]["pattern"].alias("pattern"), F.col("checks")[1]["params"]["substring"].alias("substring"), "status")


@query("SELECT DISTINCT domain, n FROM (SELECT CASE p_size % 2 WHEN 0 THEN 'security' ELSE 'quality' END AS domain, p_partkey AS n FROM part) WHERE domain = 'security'")
def domain_filter(spark: SparkSession, d: str) -> DataFrame:
    return N.of_domain(_t(spark, d, "part").select(pick(size(), F.lit("security"), F.lit("quality")).alias("domain"), key().alias("n")))


@query("SELECT p_partkey AS n, (p_size % 4 = 0 OR p_partkey % 3 = 0) AS informational FROM part")
def informational_findings(spark: SparkSession, d: str) -> DataFrame:
    f = _t(spark, d, "part").select(pick(size(), "docs/a@.md", "src/a@.php", "lib/a@.php", "app/a@.php").alias("file_path"), pick(key(), F.lit("known"), F.lit("x"), F.lit("y")).alias("value"), key().alias("n"))
    return N.mark_informational(f, ["docs/*"], ["known"]).select("n", "informational")
