"""The catalogue of analyses over the test tables, each with the SQL that DuckDB runs for comparison.

The test tables hold no source code; adapters present them as files, symbols, dependencies and findings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions import text as T
from codequarry.operators import contracts as C
from codequarry.operators import deadcode as D
from codequarry.operators import findings as N
from codequarry.operators import graph as G
from codequarry.operators import resolve as R
from codequarry.session import write_shared
from codequarry.sources import scanners as E
from codequarry.sources import store as S

Query = Callable[..., DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from codequarry.plans import code_catalog, index_catalog

    return QUERIES | code_catalog.QUERIES | index_catalog.QUERIES


def oracle_sql() -> dict[str, str]:
    from codequarry.plans import code_catalog, index_catalog

    return ORACLE | code_catalog.ORACLE | index_catalog.ORACLE


# adapters

_LAYER = {"ECONOMY": "views", "STANDARD": "controllers", "SMALL": "services", "MEDIUM": "repositories", "LARGE": "models"}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _path(key: Column | str = "p_partkey") -> Column:
    return F.concat(F.lower(F.regexp_replace("p_brand", "#", "")), F.lit("/"), F.lower("p_type"), F.lit("/part_"), F.col(key).cast("string"), F.lit(".py"))


def part_files(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("file_id"), _path().alias("path"), F.lit("python").alias("language"), F.col("p_size").cast("long").alias("size"), "p_type", "p_name")


def part_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """(source_file_id, target_file_id, type): lines of an order that follow each other."""
    line = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    left = line.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("source_file_id"))
    right = line.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("target_file_id"), F.when(F.col("l_returnflag") == "A", "load").when(F.col("l_returnflag") == "R", "inherit").otherwise("import").alias("type"))
    return left.join(right, ["l_orderkey", "l_linenumber"]).select("source_file_id", "target_file_id", "type")


def part_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, type) as paths."""
    names = part_files(spark, d).select("file_id", "path")
    deps = part_dependencies(spark, d)
    deps = deps.join(names.toDF("source_file_id", "src"), "source_file_id").join(names.toDF("target_file_id", "dst"), "target_file_id")
    return deps.select("src", "dst", "type")


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.fold_edges(part_pairs(spark, d))


def part_numbers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(src, dst, type) as numbers of parts, and their paths (id, path)."""
    names = part_files(spark, d).select(F.col("file_id").alias("id"), "path")
    known = names.select("id")
    deps = part_dependencies(spark, d).toDF("src", "dst", "type")
    return deps.join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi"), names


def part_steps(spark: SparkSession, d: str, *steps: tuple[int, str]) -> DataFrame:
    """(src, dst): each part leads to one other part for each (factor, what is added), over all parts."""
    files = part_files(spark, d).select("file_id", "path", "size")
    n = files.count()
    out = None
    for factor, add in steps:
        to = files.select(F.col("path").alias("src"), F.pmod(F.col("file_id") * factor + F.expr(add), F.lit(n)).alias("file_id"))
        one = to.join(files.select("file_id", F.col("path").alias("dst")), "file_id").select("src", "dst")
        out = one if out is None else out.union(one)
    return out.distinct()


_FILES = "files AS (SELECT p_partkey AS file_id, lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || '/part_' || p_partkey || '.py' AS path, lower(replace(p_brand, '#', '')) AS module, p_type, p_size FROM part)"


def _pairs() -> str:
    return f"""{_FILES}, pairs AS (SELECT s.path AS src, t.path AS dst, CASE y.l_returnflag WHEN 'A' THEN 'load' WHEN 'R' THEN 'inherit' ELSE 'import' END AS type
  FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber + 1 = y.l_linenumber JOIN files s ON s.file_id = x.l_partkey JOIN files t ON t.file_id = y.l_partkey)"""


def _edges() -> str:
    return f"{_pairs()}, edges AS (SELECT src, dst, string_agg(DISTINCT type, ',' ORDER BY type) AS types, count(*) AS weight FROM pairs WHERE src <> dst GROUP BY src, dst)"


def _steps(*steps: tuple[int, str]) -> str:
    some = " UNION ".join(f"SELECT s.path AS src, t.path AS dst FROM files s JOIN files t ON t.file_id = (s.file_id * {k} + {add.replace('size', 's.p_size')}) % (SELECT count(*) FROM files)" for k, add in steps)
    return f"{_FILES}, edges AS (SELECT DISTINCT * FROM ({some}) WHERE src <> dst)"


def text_files(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), F.col("n_chars").alias("size"), F.col("text").alias("content"))


def doc_findings(spark: SparkSession, d: str) -> DataFrame:
    """Documents as findings: the text as context, confidence and severity by length."""
    docs = text_files(spark, d)
    size = F.col("size")
    return docs.select(
        F.col("file_id").alias("finding_id"), F.col("path").alias("file_path"), F.pmod("size", F.lit(997)).cast("int").alias("line"),
        F.when(F.col("language") == "en", "magic_string").when(F.col("language") == "de", "unused_import").when(F.col("language") == "fr", "hardcoded_ip_url").otherwise("env_outside_config").alias("category"),
        F.substring_index("content", " ", 1).alias("name"), F.col("content").alias("context"),
        F.when(size < 1000, "low").when(size < 3000, "medium").when(size < 8000, "high").otherwise("unknown").alias("confidence"), F.when(size % 3 == 0, "high").when(size % 3 == 1, "medium").otherwise("low").alias("severity"),
    )


_FINDINGS = """findings AS (SELECT doc_id AS finding_id, source || '/' || lang || '/' || doc_id AS file_path, CAST(n_chars % 997 AS INTEGER) AS line,
  CASE lang WHEN 'en' THEN 'magic_string' WHEN 'de' THEN 'unused_import' WHEN 'fr' THEN 'hardcoded_ip_url' ELSE 'env_outside_config' END AS category,
  split_part(text, ' ', 1) AS name, text AS context, CASE WHEN n_chars < 1000 THEN 'low' WHEN n_chars < 3000 THEN 'medium' WHEN n_chars < 8000 THEN 'high' ELSE 'unknown' END AS confidence,
  CASE n_chars % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM documents)"""


# index


@query("SELECT lang AS language, count(*) AS n FROM documents GROUP BY lang")
def language_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return S.language_breakdown(text_files(spark, d))


@query(f"WITH {_FILES} SELECT path, CAST(count(l.l_partkey) AS BIGINT) AS symbol_count FROM files f LEFT JOIN lineitem l ON l.l_partkey = f.file_id GROUP BY path")
def symbol_count_left_join(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes(part_files(spark, d), _t(spark, d, "lineitem").select(F.col("l_partkey").alias("file_id"))).select("path", "symbol_count")


def order_classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as files, orders as classes, lines as methods and, by flag, as dependencies."""
    files = _t(spark, d, "customer").select(F.col("c_custkey").alias("file_id"), F.concat(F.lit("src/"), F.lower("c_mktsegment"), F.lit("/customer_"), F.col("c_custkey").cast("string"), F.lit(".php")).alias("path"), F.lit("php").alias("language"))
    none = F.lit(None).cast("long")
    classes = _t(spark, d, "orders").select(F.col("o_orderkey").alias("symbol_id"), F.col("o_custkey").alias("file_id"), F.lit("class").alias("type"), F.concat(F.lit("Order"), F.col("o_orderkey").cast("string")).alias("name"), F.lit(1).alias("line_start"), (F.floor(F.col("o_totalprice") / 1000) + 1).cast("int").alias("line_end"), none.alias("parent_symbol_id"))
    lines = _t(spark, d, "lineitem")
    methods = lines.select((-F.col("l_orderkey") - 1).alias("symbol_id"), none.alias("file_id"), F.lit("method").alias("type"), F.lit("m").alias("name"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.col("l_orderkey").alias("parent_symbol_id"))
    deps = lines.join(_t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("source_file_id")), "l_orderkey").select("source_file_id", F.when(F.col("l_returnflag") == "A", "load").otherwise("import").alias("type"))
    return files, classes.unionByName(methods), deps


@query("SELECT 'Order' || o_orderkey AS name, 'src/' || lower(c_mktsegment) || '/customer_' || c_custkey || '.php' AS path, CAST((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS BIGINT) AS method_count FROM orders JOIN customer ON c_custkey = o_custkey")
def classes_with_metrics(spark: SparkSession, d: str) -> DataFrame:
    files, symbols, _ = order_classes(spark, d)
    return G.classes_with_metrics(files, symbols).select("name", "path", "method_count")


@query("""WITH m AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), dep AS (SELECT o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'A' GROUP BY 1),
c AS (SELECT 'Order' || o_orderkey AS name, 'src/' || lower(c_mktsegment) || '/customer_' || c_custkey || '.php' AS file_path, coalesce(m.n, 0) AS method_count, coalesce(dep.n, 0) AS dependency_count, CAST(floor(o_totalprice / 1000) AS BIGINT) AS line_count, k.n AS class_count
  FROM orders o JOIN customer ON c_custkey = o_custkey JOIN k ON k.o_custkey = o.o_custkey LEFT JOIN m ON m.l_orderkey = o_orderkey LEFT JOIN dep ON dep.o_custkey = o.o_custkey)
SELECT name, file_path, CAST(method_count AS BIGINT) AS method_count, CAST(dependency_count AS BIGINT) AS dependency_count, line_count FROM c WHERE method_count >= 10 OR (class_count <= 1 AND dependency_count >= 3 AND line_count >= 100)""")
def god_classes(spark: SparkSession, d: str) -> DataFrame:
    return G.god_classes(*order_classes(spark, d), min_methods=10, min_deps=3, min_lines=100)


@query(f"WITH {_FILES} SELECT lower(p_type) AS layer, CAST(count(*) AS BIGINT) AS n, md5(string_agg(path, ',' ORDER BY path)) AS paths FROM files GROUP BY 1")
def envelopes_by_layer(spark: SparkSession, d: str) -> DataFrame:
    files = part_files(spark, d)
    items = S.envelopes_by_layer(files, files.select("file_id", F.lower("p_type").alias("architectural_layer"), F.col("p_name").alias("summary")))
    return items.select("layer", F.size("items").cast("long").alias("n"), F.md5(F.array_join(F.transform("items", lambda x: x["path"]), ",")).alias("paths"))


# graph


@query(f"WITH {_edges()} SELECT * FROM edges")
def edge_fold(spark: SparkSession, d: str) -> DataFrame:
    return part_edges(spark, d).withColumn("types", F.array_join("types", ","))


@query(f"WITH {_edges()} SELECT * FROM edges WHERE types <> 'load'")
def strong_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.strong_edges(part_edges(spark, d)).withColumn("types", F.array_join("types", ","))


@query(f"""WITH {_edges()}, p AS (SELECT DISTINCT split_part(src, '/', 1) AS a, split_part(dst, '/', 1) AS b FROM edges WHERE split_part(src, '/', 1) <> split_part(dst, '/', 1)),
m AS (SELECT DISTINCT module FROM files), c AS (SELECT module, (SELECT count(*) FROM p WHERE b = module) AS ca, (SELECT count(*) FROM p WHERE a = module) AS ce FROM m)
SELECT module, CAST(ca AS BIGINT) AS afferent, CAST(ce AS BIGINT) AS efferent, CASE WHEN ca + ce > 0 THEN round_even(CAST(ce AS DOUBLE) / (ca + ce), 3) ELSE 0.0 END AS instability FROM c""")
def coupling_metrics(spark: SparkSession, d: str) -> DataFrame:
    return G.coupling(part_files(spark, d), part_edges(spark, d))


_ONE = ((31, "size"),)
_NO_IMPORTERS = f"WITH {_steps(*_ONE)}, o AS (SELECT path, p_size % 3 = 0 AS entry FROM files WHERE path NOT IN (SELECT dst FROM edges) AND path IN (SELECT src FROM edges)) SELECT path FROM o WHERE "


def _stepping(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, edges from each part to one other, and the files that load (every third size)."""
    files = part_files(spark, d)
    return files, G.fold_edges(part_steps(spark, d, *_ONE).withColumn("type", F.lit("import"))), files.filter("size % 3 = 0").select("path")


@query(_NO_IMPORTERS + "NOT entry")
def orphan_files(spark: SparkSession, d: str) -> DataFrame:
    return G.orphan_files(*_stepping(spark, d))


@query(_NO_IMPORTERS + "entry")
def entry_candidates(spark: SparkSession, d: str) -> DataFrame:
    return G.entry_candidates(*_stepping(spark, d))


@query(f"""WITH {_edges()}, l(kind, layer, n) AS (VALUES ('ECONOMY', 'view', 0), ('STANDARD', 'controller', 1), ('SMALL', 'service', 2), ('MEDIUM', 'repository', 3), ('LARGE', 'model', 4))
SELECT src AS source_file, a.layer AS source_layer, dst AS target_name, b.layer AS target_layer, a.layer || ' -> ' || b.layer || ' (reversed dependency)' AS violation
FROM edges JOIN files s ON s.path = src JOIN files t ON t.path = dst JOIN l a ON a.kind = s.p_type JOIN l b ON b.kind = t.p_type WHERE a.n > b.n""")
def layer_violations(spark: SparkSession, d: str) -> DataFrame:
    return G.layer_violations(part_edges(spark, d), custom={k.lower(): {"views": "view", "controllers": "controller", "services": "service", "repositories": "repository", "models": "model"}[v] for k, v in _LAYER.items()})


@query(f"WITH {_edges()} SELECT CAST(n AS BIGINT) AS node_count, CAST(e AS BIGINT) AS edge_count, round_even(e / (n * CAST(n - 1 AS DOUBLE)), 6) AS density FROM (SELECT count(*) AS n FROM files), (SELECT count(*) AS e FROM edges)")
def graph_density(spark: SparkSession, d: str) -> DataFrame:
    return G.density(part_files(spark, d), part_edges(spark, d))


_TWO = ((31, "size"), (17, "7"))


@query(f"""WITH RECURSIVE {_steps(*_TWO)}, e AS (SELECT src, dst FROM edges),
p(root, last, path, n) AS (SELECT src, dst, [src, dst], 2 FROM e WHERE src < dst UNION ALL SELECT root, e.dst, list_append(path, e.dst), n + 1 FROM p JOIN e ON e.src = p.last WHERE n < 6 AND e.dst > root AND NOT list_contains(path, e.dst))
SELECT array_to_string(path, ' ') AS cycle, CAST(n AS INTEGER) AS length FROM p JOIN e ON e.src = p.last AND e.dst = p.root""")
def cycles_bounded(spark: SparkSession, d: str) -> DataFrame:
    """All cycles of up to six files where each part leads to two others."""
    return G.cycles(part_steps(spark, d, *_TWO), most=1 << 30).select(F.array_join("cycle", " ").alias("cycle"), "length")


@query()
def cycles_giant(spark: SparkSession, d: str) -> DataFrame:
    """The graph of all lines: its giant component comes as one row with its first files, cycles of others up to the report's cap."""
    edges, names = part_numbers(spark, d)
    edges = write_shared(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    return G.cycles(edges, components=G.strong_components(edges, names=names), names=names).select(F.array_join("cycle", " ").alias("cycle"), "length", "giant")


@query(f"""WITH RECURSIVE {_steps(*_ONE)},
r(a, b) AS (SELECT src, dst FROM edges UNION SELECT r.a, edges.dst FROM r JOIN edges ON edges.src = r.b), s AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a)
SELECT a AS path, min(b) AS component, CAST(count(*) AS BIGINT) AS size FROM s GROUP BY a HAVING count(*) > 1""")
def scc_members(spark: SparkSession, d: str) -> DataFrame:
    """Strong components where each part leads to one other."""
    return G.strong_components(part_steps(spark, d, *_ONE).withColumn("types", F.array(F.lit("import"))))


@query()
def scc_members_lines(spark: SparkSession, d: str) -> DataFrame:
    """Strong components of the graph of all lines, whose closure is too large for SQL."""
    edges, names = part_numbers(spark, d)
    return G.strong_components(edges, names=names)


@query()
def betweenness_topk(spark: SparkSession, d: str) -> DataFrame:
    edges, names = part_numbers(spark, d)
    return G.betweenness(part_files(spark, d), G.fold_edges(edges), names=names)


# resolving

_WORD2 = "split_part(p_name, ' ', 2)"


@query(f"""WITH {_FILES}, k AS (SELECT p_name || f.p_size AS key, min(path) AS path FROM part JOIN files f ON file_id = p_partkey GROUP BY 1 HAVING count(DISTINCT path) = 1) SELECT p_partkey AS dep_id, k.path FROM part JOIN k ON k.key = p_name || p_size""")
def name_resolution_unique(spark: SparkSession, d: str) -> DataFrame:
    files = part_files(spark, d)
    name = F.concat("p_name", F.col("size").cast("string"))
    keys = R.unique_keys(files.select(name.alias("key"), "path"))
    return files.select(F.col("file_id").alias("dep_id"), name.alias("key")).join(keys, "key").select("dep_id", "path")


@query(f"""WITH {_FILES}, m AS (SELECT DISTINCT replace(regexp_replace(path, '/part_.*$', ''), '/', '.') AS module FROM files), t AS (SELECT file_id, replace(regexp_replace(path, '[.]py$', ''), '/', '.') || '.Thing.method' AS target FROM files),
h AS (SELECT file_id, target, module, row_number() OVER (PARTITION BY file_id ORDER BY length(module) DESC) AS n FROM t JOIN m ON target = module OR starts_with(target, module || '.'))
SELECT file_id AS dep_id, module FROM h WHERE n = 1""")
def dotted_prefix_resolution(spark: SparkSession, d: str) -> DataFrame:
    files = part_files(spark, d)
    modules = files.select(F.translate(T.parent(F.col("path")), "/", ".").alias("module")).distinct()
    target = F.concat(R.module_name(F.col("path")), F.lit(".Thing.method"))
    tried = files.select(F.col("file_id").alias("dep_id"), F.posexplode(R.prefixes(target)).alias("at", "module"))
    first = Window.partitionBy("dep_id").orderBy("at")
    return tried.join(modules, "module").withColumn("n", F.row_number().over(first)).filter("n = 1").select("dep_id", "module")


@query(f"""WITH {_FILES}, w AS (SELECT p_partkey AS dep_id, CASE WHEN p_size % 2 = 0 THEN lower(p_type) || '/part_' || p_partkey || '.py' ELSE 'part_' || (p_partkey + 1) || '.py' END AS wanted FROM part),
h AS (SELECT dep_id, min(path) AS path, count(*) AS n FROM w JOIN files ON path = wanted OR suffix(path, '/' || wanted) GROUP BY dep_id) SELECT dep_id, path FROM h WHERE n = 1""".replace("OR suffix(path, '/' || wanted)", "OR regexp_replace(path, '^[^/]*/', '') = wanted OR regexp_replace(path, '^.*/', '') = wanted"))
def suffix_resolution(spark: SparkSession, d: str) -> DataFrame:
    files = part_files(spark, d)
    keys = R.unique_keys(files.select(F.explode(R.suffixes(F.col("path"))).alias("key"), "path"))
    wanted = F.when(F.col("size") % 2 == 0, F.concat(F.lower("p_type"), F.lit("/part_"), F.col("file_id").cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("part_"), (F.col("file_id") + 1).cast("string"), F.lit(".py")))
    return files.select(F.col("file_id").alias("dep_id"), wanted.alias("key")).join(keys, "key").select("dep_id", "path")


@query(f"""WITH {_FILES}, s AS (SELECT file_id, path, 'Part' || file_id AS name, replace(regexp_replace(path, '[.]py$', ''), '/', '.') AS module FROM files),
d AS (SELECT row_number() OVER (ORDER BY 1) AS x, y.* FROM (SELECT p_partkey AS dep_id, p_partkey AS source, CASE p_size % 4 WHEN 0 THEN 'Part' || (p_partkey + 1) WHEN 1 THEN 'Nowhere\\Part' || (p_partkey + 2) WHEN 2 THEN 'missing.module' ELSE (SELECT module FROM s WHERE s.file_id = p_partkey % 100 + 1) || '.member' END AS target FROM part) y),
h AS (SELECT dep_id, source, path, 1 AS stage FROM d JOIN s ON target = name UNION ALL SELECT dep_id, source, path, 2 FROM d JOIN s ON target LIKE '%\\\\%' ESCAPE '\\' AND split_part(target, '\\', 2) = name UNION ALL SELECT dep_id, source, path, 5 FROM d JOIN s ON target = module || '.member')
SELECT h.dep_id, f.path AS src, h.path AS dst, CAST(h.stage AS INTEGER) AS stage FROM h JOIN files f ON f.file_id = h.source WHERE f.path <> h.path""")
def resolver_priority(spark: SparkSession, d: str) -> DataFrame:
    files = part_files(spark, d)
    symbols = files.select("file_id", F.lit("class").alias("type"), F.concat(F.lit("Part"), F.col("file_id").cast("string")).alias("name"), F.lit(None).cast("string").alias("namespace"))
    modules = files.select(F.col("file_id").alias("_m"), R.module_name(F.col("path")).alias("module"))
    key, kind = F.col("file_id"), F.col("size") % 4
    deps = files.withColumn("_m", F.col("file_id") % 100 + 1).join(modules, "_m", "left")
    target = F.when(kind == 0, F.concat(F.lit("Part"), (key + 1).cast("string"))).when(kind == 1, F.concat(F.lit("Nowhere\\Part"), (key + 2).cast("string"))).when(kind == 2, "missing.module").otherwise(F.concat("module", F.lit(".member")))
    deps = deps.select(key.alias("dep_id"), key.alias("source_file_id"), target.alias("target_name"), F.lit("import").alias("type"))
    return R.resolve(files, symbols, deps).select("dep_id", "src", "dst", "stage")


@query("""WITH names AS (SELECT s_suppkey AS file_id, 'Supplier_' || s_suppkey AS name FROM supplier), targets AS (SELECT DISTINCT 'vendor\\supplier#' || s_suppkey AS target, s_suppkey + 1 AS source FROM supplier WHERE s_nationkey % 2 = 0)
SELECT file_id, name FROM names WHERE NOT EXISTS (SELECT 1 FROM targets WHERE lower(target) LIKE '%' || lower(name) AND source <> file_id)""")
def abandoned_anti_join(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier")
    names = s.select(F.col("s_suppkey").alias("file_id"), F.concat(F.lit("Supplier_"), F.col("s_suppkey").cast("string")).alias("name"))
    deps = s.filter(F.col("s_nationkey") % 2 == 0).select(F.concat(F.lit("vendor\\supplier#"), F.col("s_suppkey").cast("string")).alias("target_name"), (F.col("s_suppkey") + 1).alias("source_file_id"))
    return names.join(D.suffix_referenced(names, deps), ["name", "file_id"], "left_anti").select("file_id", "name")


_LINES = "lines AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, path, no, line), lines counted from 1."""
    return text_files(spark, d).filter("content is not null").select("file_id", "path", F.posexplode(F.split("content", "\n")).alias("no", "line")).withColumn("no", F.col("no") + 1)


# findings


@query(f"WITH {_FINDINGS} SELECT finding_id, category, confidence FROM findings WHERE confidence IN ('medium', 'high') AND category IN ('magic_string', 'unused_import')")
def confidence_filter(spark: SparkSession, d: str) -> DataFrame:
    return N.by_confidence(doc_findings(spark, d), "medium", {"magic_string", "unused_import"}).select("finding_id", "category", "confidence")


_RULES = [
    ("r1", "magic_string", [("file_glob", {"pattern": "src1*/en/*"})]),
    ("r2", "magic_string", [("context_contains", {"substring": "$$$"})]),
    ("r3", "unused_import", [("name_contains", {"substring": "er"}), ("file_glob", {"pattern": "src?/de/*"})]),
    ("r4", "hardcoded_ip_url", [("source_regex", {"pattern": "[0-9]{3}"})]),
    ("r5", "magic_string", [("file_glob", {"pattern": "src1?/*"})]),
    ("r6", "env_outside_config", [("no_such_check", {"x": "y"})]),
]
_ATTRIBUTED = f"""WITH {_FINDINGS}, a AS (SELECT finding_id, category, CASE category
  WHEN 'magic_string' THEN CASE WHEN file_path SIMILAR TO 'src1.*/en/.*' THEN 'r1' WHEN contains(context, '$$$') THEN 'r2' WHEN file_path SIMILAR TO 'src1./.*' THEN 'r5' END
  WHEN 'unused_import' THEN CASE WHEN contains(name, 'er') AND file_path SIMILAR TO 'src./de/.*' THEN 'r3' END
  WHEN 'hardcoded_ip_url' THEN CASE WHEN regexp_matches(context, '[0-9]{{3}}') THEN 'r4' END END AS rule_id FROM findings) """


def _attributed(spark: SparkSession, d: str) -> DataFrame:
    f = doc_findings(spark, d)
    return N.attribute(N.prepare(f.withColumn("content", F.col("context"))), _RULES)


@query(_ATTRIBUTED + "SELECT finding_id, category FROM a WHERE rule_id IS NULL")
def rule_filter(spark: SparkSession, d: str) -> DataFrame:
    return _attributed(spark, d).filter("rule_id is null").select("finding_id", "category")


@query(_ATTRIBUTED + "SELECT finding_id, category, rule_id FROM a WHERE rule_id IS NOT NULL")
def rule_attribution(spark: SparkSession, d: str) -> DataFrame:
    return _attributed(spark, d).filter("rule_id is not null").select("finding_id", "category", "rule_id")


@query("""WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 4 WHEN 0 THEN 'probationary' WHEN 1 THEN 'active' WHEN 2 THEN 'stale' ELSE 'disabled' END AS status, CAST(o_custkey % 3 AS INTEGER) AS hits, CAST(o_custkey % 9 AS INTEGER) AS misses, o_orderstatus = 'F' AS hit FROM orders)
SELECT id, CASE WHEN status = 'disabled' THEN status WHEN hit AND status = 'stale' THEN 'active' WHEN hit AND status = 'probationary' AND hits + 1 >= 2 THEN 'active' WHEN NOT hit AND misses + 1 >= 8 AND status IN ('active', 'stale') THEN 'disabled' WHEN NOT hit AND misses + 1 >= 5 AND status = 'active' THEN 'stale' ELSE status END AS status,
  CAST(CASE WHEN status <> 'disabled' AND hit THEN hits + 1 ELSE hits END AS INTEGER) AS hit_count, CASE WHEN status <> 'disabled' AND hit THEN 'run-7' ELSE '' END AS last_hit_run, CAST(CASE WHEN status = 'disabled' THEN misses WHEN hit THEN 0 ELSE misses + 1 END AS INTEGER) AS miss_streak FROM r""")
def rule_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    kind = F.col("o_orderkey") % 4
    rules = o.select(F.col("o_orderkey").cast("string").alias("id"), F.when(kind == 0, "probationary").when(kind == 1, "active").when(kind == 2, "stale").otherwise("disabled").alias("status"), (F.col("o_custkey") % 3).cast("int").alias("hit_count"), F.lit("").alias("last_hit_run"), (F.col("o_custkey") % 9).cast("int").alias("miss_streak"))
    return N.lifecycle(rules, o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("id")), "run-7")


@query("""WITH e AS (SELECT event_id, 'S' || (100 + user_id % 12) AS code, 'app/user_' || user_id || '.py' AS filename, CAST(event_id % 50 + 1 AS INTEGER) AS line, event_type || ' event' AS message FROM events)
SELECT 'ruff' AS tool, code AS rule_id, CASE WHEN code IN ('S105', 'S106', 'S107') THEN 'high' ELSE 'medium' END AS severity, filename AS file_path, line, message, filename || ':' || line || ':' || code AS fingerprint FROM e""")
def external_normalise(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    item = F.struct(F.concat(F.lit("S"), (100 + F.col("user_id") % 12).cast("string")).alias("code"), F.concat(F.lit("app/user_"), F.col("user_id").cast("string"), F.lit(".py")).alias("filename"), F.struct((F.col("event_id") % 50 + 1).cast("int").alias("row")).alias("location"), F.concat("event_type", F.lit(" event")).alias("message"))
    payloads = e.select(F.concat(F.lit("["), F.to_json(item), F.lit("]")).alias("payload"))
    return E.ruff(payloads).select("tool", "rule_id", "severity", "file_path", "line", "message", "fingerprint")


@query(f"WITH {_FINDINGS} SELECT file_path, line, category, severity FROM findings WHERE category IN ('hardcoded_ip_url', 'env_outside_config') ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, file_path, line, name LIMIT 10")
def security_top10(spark: SparkSession, d: str) -> DataFrame:
    return N.security_top(doc_findings(spark, d).withColumn("value", F.col("name"))).select("file_path", "line", "category", "severity")


@query(f"""WITH {_FINDINGS}, t AS (SELECT *, regexp_replace(file_path, '/[^/]*$', '') AS dir, row_number() OVER (PARTITION BY category, regexp_replace(file_path, '/[^/]*$', '') ORDER BY file_path, line) AS turn FROM findings),
p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY turn, md5(dir || ':42'), file_path, line) AS pick FROM t) SELECT finding_id, category FROM p WHERE pick <= 20""")
def review_sample(spark: SparkSession, d: str) -> DataFrame:
    return N.stratified_sample(doc_findings(spark, d)).select("finding_id", "category")


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (quality = 0) AS BIGINT) AS true_positive, CAST(count(*) FILTER (quality = 1 AND toxic = 0) AS BIGINT) AS false_positive, CAST(count(*) FILTER (quality = 1 AND toxic = 1) AS BIGINT) AS needs_context FROM labels")
def verdict_tally(spark: SparkSession, d: str) -> DataFrame:
    return N.verdict_tally(_t(spark, d, "labels").select(F.when(F.col("quality") == 0, "true_positive").when(F.col("toxic") == 0, "false_positive").when(F.col("toxic") == 1, "needs_context").alias("verdict")))


@query(f"WITH {_LINES}, x AS (SELECT doc_id, CAST(n_chars % 40 + 1 AS BIGINT) AS at FROM documents) SELECT l.path AS file_path, x.at AS line, l.no, l.line AS text FROM x JOIN lines l ON l.doc_id = x.doc_id AND l.no BETWEEN x.at - 5 AND x.at + 5")
def code_context_band(spark: SparkSession, d: str) -> DataFrame:
    f = text_files(spark, d).select(F.col("path").alias("file_path"), (F.col("size") % 40 + 1).alias("line"))
    lines = text_lines(spark, d).select("path", F.col("no").cast("long").alias("no"), F.col("line").alias("text"))
    return N.context_lines(f, lines).select("file_path", "line", "no", "text")


@query("""WITH a AS (SELECT o_orderkey AS path, CAST(o_custkey AS DOUBLE) AS mtime FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS path, CAST(o_custkey AS DOUBLE) + (o_orderkey % 3) * 0.75 AS mtime FROM orders WHERE o_orderkey % 7 <> 0)
SELECT path, CASE WHEN b.mtime IS NULL THEN 'new' WHEN a.mtime IS NULL THEN 'pruned' WHEN abs(a.mtime - b.mtime) < 1.0 THEN 'unchanged' ELSE 'changed' END AS state FROM a FULL JOIN b USING (path)""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").cast("double").alias("mtime"))
    return S.snapshot_diff(o.filter("path % 5 <> 0"), o.filter("path % 7 <> 0").withColumn("mtime", F.col("mtime") + (F.col("path") % 3) * 0.75))


_METRICS = f"""WITH {_edges()}, l(kind, n) AS (VALUES ('ECONOMY', 0), ('STANDARD', 1), ('SMALL', 2), ('MEDIUM', 3), ('LARGE', 4)),
v AS (SELECT count(*) AS n FROM edges JOIN files s ON s.path = src JOIN files t ON t.path = dst JOIN l a ON a.kind = s.p_type JOIN l b ON b.kind = t.p_type WHERE a.n > b.n),
steps AS (SELECT DISTINCT s.path AS src, t.path AS dst FROM files s JOIN files t ON t.file_id = (s.file_id * 31 + s.p_size) % (SELECT count(*) FROM files) WHERE s.path <> t.path),
o AS (SELECT count(*) AS n FROM files WHERE path NOT IN (SELECT dst FROM steps) AND path IN (SELECT src FROM steps) AND p_size % 3 > 0), w AS (SELECT count(*) AS n FROM documents WHERE lang = 'fr')"""


def _metric_row(spark: SparkSession, d: str) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(layer_violations(spark, d), "violations").crossJoin(n(G.without_importers(*_stepping(spark, d)).filter("not entry"), "orphans")).crossJoin(n(doc_findings(spark, d).filter("category = 'hardcoded_ip_url'"), "hardwiring"))


@query(_METRICS + " SELECT CAST(v.n AS BIGINT) AS violations, CAST(o.n AS BIGINT) AS orphans, CAST(w.n AS BIGINT) AS hardwiring, CAST(v.n * 12 + o.n * 2 + w.n AS DOUBLE) AS score FROM v, o, w")
def metric_vector(spark: SparkSession, d: str) -> DataFrame:
    return _metric_row(spark, d).withColumn("score", N.score({k: N.SCORE[k] for k in ("violations", "orphans", "hardwiring")}))


@query(_METRICS + " SELECT v.n > 0 OR o.n > 1 AS accepted, CAST(v.n * 12 + o.n * 2 + w.n AS DOUBLE) AS b_score, CAST(v.n // 2 * 12 + (o.n - o.n // 2) * 2 + w.n AS DOUBLE) AS a_score FROM v, o, w")
def pareto_gate(spark: SparkSession, d: str) -> DataFrame:
    before = _metric_row(spark, d)
    after = before.select(F.expr("violations div 2").alias("violations"), F.expr("orphans - orphans div 2").alias("orphans"), "hardwiring")
    return N.pareto(before, after, ["violations", "orphans", "hardwiring"])


@query("SELECT DISTINCT category, value FROM (SELECT 'routes' AS category, event_type AS value FROM events UNION ALL SELECT 'hooks', trim(p_type) FROM part WHERE trim(p_type) <> '' UNION ALL SELECT 'env_keys', trim(p_brand) FROM part WHERE trim(p_brand) <> '')")
def contract_merge(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    patch = p.select(F.lit("hooks").alias("category"), F.concat(F.lit(" "), "p_type").alias("value")).union(p.select(F.lit("env_keys"), F.concat("p_brand", F.lit(" ")))).union(p.select(F.lit("no_such_field"), F.col("p_name")))
    return C.merge_lookup(_t(spark, d, "events").select(F.lit("routes").alias("category"), F.col("event_type").alias("value")), patch)
