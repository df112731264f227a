"""Names in dependencies to files: a chain of lookups as one set of equi-joins.

Every dependency is exploded to candidate keys (stage, key); key tables say which file a key means, and where several files share a
key that needs one, it means none. The lowest stage with a hit wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import text as T

NAMED = ("class", "enum", "function", "interface", "module", "trait")
JS_ENDS = (".ts", ".tsx", ".js", ".jsx", ".vue")


def unique_keys(keys: DataFrame) -> DataFrame:
    """(key, path) of keys that mean one file only."""
    return keys.groupBy("key").agg(F.min("path").alias("path"), F.max("path").alias("other")).filter("path = other").select("key", "path")


def symbol_keys(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(key, path): names and qualified names that tell one file."""
    s = symbols.filter(F.col("type").isin(*NAMED)).join(files.select("file_id", "path", "language").hint("merge"), "file_id")
    joint = F.when(F.col("language") == "python", ".").when(F.col("language") == "ruby", "::").otherwise("\\")
    full = F.when(F.coalesce(F.col("namespace"), F.lit("")) != "", F.concat("namespace", joint, "name"))
    return unique_keys(s.select("path", F.explode(F.array_compact(F.array("name", full))).alias("key")))


def module_name(path: Column) -> Column:
    """Dotted module of a Python file, null for others; a package is its directory."""
    dotted = F.array_join(T.parts(F.regexp_replace(path, r"\.py$", "")), ".")
    return F.when(path.endswith(".py"), F.nullif(F.regexp_replace(dotted, r"(^|\.)__init__$", ""), F.lit("")))


def prefixes(name: Column) -> Column:
    """A dotted name and its shorter prefixes, longest first."""
    p = F.split(name, r"\.")
    return F.transform(F.sequence(F.size(p), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(p, F.lit(1), n), "."))


def suffixes(path: Column) -> Column:
    """A path and what remains of it after each slash."""
    p = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "/"))


def _scopes(namespaces: Column, name: Column) -> Column:
    """Names in the enclosing scopes of a file's namespaces: longest namespace first, parts dropped from its end."""
    def inner(ns: Column) -> Column:
        p = F.filter(F.split(ns, "::"), lambda x: x != "")
        return F.transform(F.sequence(F.size(p), F.lit(1), F.lit(-1)), lambda n: F.concat(F.array_join(F.slice(p, F.lit(1), n), "::"), F.lit("::"), name))

    usable = F.filter(namespaces, lambda x: F.size(F.filter(F.split(x, "::"), lambda y: y != "")) > 0)
    return F.flatten(F.transform(usable, inner))


def _stage(n: int, keys: Column, table: str) -> Column:
    """Candidates of one stage, in order: keys is an array, null or empty where the stage doesn't apply."""
    return F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k, i: F.struct(F.lit(n).alias("stage"), i.alias("at"), F.lit(table).alias("table"), k.alias("key")))


ENDINGS = {".py": (5,), ".rb": (6, 7), ".php": (8, 9, 10, 11)}


def candidates(deps: DataFrame, aliases: dict[str, str] | None = None, endings: set[str] | None = None) -> DataFrame:
    """deps (dep_id, src, namespaces, target) with one row a candidate: (stage, at, table, key).

    endings: those of ENDINGS that files have; the stages of others can only tell files that aren't there, so they are left out.
    """
    t = F.col("target")
    folder = T.parent(F.col("src"))
    clean = T.strip(t)
    slashed = T.forward(clean)
    relative = slashed.rlike(r"^\.\.?/")
    below = lambda p: F.when(folder == ".", p).otherwise(F.concat(folder, F.lit("/"), p))
    rb = F.when(relative, below(slashed)).otherwise(F.regexp_replace(slashed, "^/+", ""))
    rb = F.when(slashed != "", T.normalized(F.when(rb.endswith(".rb"), rb).otherwise(F.concat(rb, F.lit(".rb")))))
    php = F.regexp_replace(slashed, "^/+", "")
    php = F.when(php.endswith(".php"), php)
    js = clean
    for alias, mapped in reversed(list((aliases or {}).items())):
        js = F.when(clean.startswith(alias), F.concat(F.lit(mapped), F.substring(clean, len(alias) + 1, 1 << 30))).otherwise(js)
    js = F.when(js.rlike(r"^\.\.?/"), F.array_join(T.parts(below(js)), "/")).otherwise(js)
    js = F.nullif(F.regexp_replace(T.forward(js), "/+$", ""), F.lit(""))
    ends = F.concat(*(F.array(F.concat(js, F.lit(e))) for e in JS_ENDS), *(F.array(F.concat(js, F.lit(f"/index{e}"))) for e in JS_ENDS))
    js = F.when(js.isNotNull(), F.when(T.suffix(js) != "", F.array(js)).otherwise(ends))
    plain = ~t.rlike("[/.]") & (t != "")
    idle = {n for e, some in ENDINGS.items() if endings is not None and e not in endings for n in some}
    stages = [
        _stage(1, F.array(t), "symbol"),
        _stage(2, F.when(F.contains(t, F.lit("\\")), F.array(T.last_segment(t))), "symbol"),
        _stage(3, F.when(F.contains(t, F.lit("::")), F.array(T.last_segment(t, "::"))), "symbol"),
        _stage(4, F.when(plain & ~F.contains(t, F.lit("::")), _scopes(F.col("namespaces"), t)), "symbol"),
        _stage(5, prefixes(t), "module"),
        _stage(6, F.when(rb.isNotNull(), F.array(rb)), "path"),
        _stage(7, F.when(rb.isNotNull(), F.array(rb)), "suffix"),
        _stage(8, F.when(php.isNotNull(), F.array(php)), "path"),
        _stage(9, F.when(php.rlike("^(?:wp-|class-|IXR/)"), F.array(php)), "ending"),
        _stage(10, F.when(php.isNotNull(), F.array(T.file_name(php))), "name"),
        _stage(11, F.when(php.isNotNull(), F.array(php)), "ending"),
        _stage(12, js, "path"),
    ]
    stages = [x for n, x in enumerate(stages, 1) if n not in idle]
    return deps.withColumn("c", F.explode(F.concat(*stages))).select("dep_id", "src", "target", "c.*")


def resolve(files: DataFrame, symbols: DataFrame, dependencies: DataFrame, aliases: dict[str, str] | None = None, fuzzy: bool = False) -> DataFrame:
    """(dep_id, src, dst, type, stage) of the dependencies (dep_id, source_file_id, target_name, type) that are told to be files.

    Loops are dropped. A Python module means all its files. No join is left to be broadcast: sizes estimated from compressed files are far too small.
    """
    names = files.select("file_id", "path", "language")
    spaces = symbols.filter(F.col("type").isin(*NAMED)).join(names.filter("language = 'ruby'").hint("merge"), "file_id")
    spaces = spaces.select("file_id", F.when(F.coalesce(F.col("namespace"), F.lit("")) != "", F.col("namespace")).when(F.col("type") == "module", F.col("name")).alias("ns")).groupBy("file_id").agg(F.collect_set("ns").alias("ns"))
    spaces = spaces.select("file_id", F.transform(F.array_sort(F.transform("ns", lambda x: F.struct((-F.length(x)).alias("l"), x.alias("n")))), lambda x: x["n"]).alias("namespaces"))
    deps = dependencies.select("dep_id", F.col("source_file_id").alias("file_id"), F.col("target_name").alias("target"), "type").join(names.select("file_id", F.col("path").alias("src")).hint("merge"), "file_id").join(spaces.hint("merge"), "file_id", "left")
    there = {r.e for r in names.select(F.regexp_extract("path", r"(\.(?:py|rb|php))$", 1).alias("e")).distinct().collect()}  # four rows at most
    wanted = candidates(deps, aliases, there)
    endings = wanted.filter("`table` = 'ending'").select("key").distinct()
    paths = names.select("path").withColumn("name", T.file_name(F.col("path")))
    # an ending need not begin at a slash. One with a slash ends in a whole file name, which is joined on; for the others, names are
    # compared by up to 8 of their last signs, and then in full
    deep = endings.filter(F.contains("key", F.lit("/"))).withColumn("name", T.file_name(F.col("key"))).join(paths.hint("merge"), "name").filter(F.col("path").endswith(F.col("key"))).select("key", "path")
    tails = paths.select("name").distinct().select("name", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("name"), F.lit(8))), lambda k: F.right(F.col("name"), k))).alias("tail"))
    flat = endings.filter(~F.contains("key", F.lit("/"))).withColumn("tail", F.right(F.col("key"), F.lit(8))).join(tails.hint("merge"), "tail").filter(F.col("name").endswith(F.col("key"))).select("key", "name")
    ends = deep.union(flat.join(paths.hint("merge"), "name").select("key", "path"))
    php, rb = ".php" in there, ".rb" in there
    tables = {
        "symbol": symbol_keys(files, symbols),
        "module": paths.select(module_name(F.col("path")).alias("key"), "path").filter("key is not null"),
        "path": paths.select(F.col("path").alias("key"), "path"),
        "suffix": unique_keys(paths.select(F.explode(suffixes(F.col("path"))).alias("key"), "path")),
        "name": unique_keys(paths.select(T.file_name(F.col("path")).alias("key"), "path")),
        "ending": unique_keys(ends),
    }
    unused = (set() if php else {"ending", "name"}) | (set() if rb else {"suffix"}) | (set() if ".py" in there else {"module"})
    known = None
    for table, rows in tables.items():
        if table in unused:
            continue
        rows = rows.select(F.lit(table).alias("table"), "key", F.col("path").alias("dst"))
        known = rows if known is None else known.unionByName(rows)
    hits = wanted.join(known.hint("merge"), ["table", "key"]).withColumn("first", F.min(F.struct("stage", "at")).over(Window.partitionBy("dep_id")))
    hits = hits.filter(F.struct("stage", "at") == F.col("first")).select("dep_id", "src", "dst", "stage")
    if fuzzy:
        open_ = deps.join(hits.select("dep_id").distinct(), "dep_id", "left_anti").filter(F.contains("target", F.lit("/"))).withColumn("clean", F.regexp_replace("target", "^[@./]+", ""))
        by_stem = open_.withColumn("stem", T.last_segment(F.col("clean"), "/")).join(paths.withColumn("stem", T.stem(F.col("path"))), "stem").select("dep_id", "src", F.col("path").alias("dst"), F.lit(13).alias("stage"))
        rest = open_.join(by_stem.select("dep_id").distinct(), "dep_id", "left_anti").filter(F.length("clean") > 3)
        inside = rest.join(paths, F.contains(F.col("path"), F.col("clean"))).withColumn("n", F.row_number().over(Window.partitionBy("dep_id").orderBy("path"))).filter("n <= 5").select("dep_id", "src", F.col("path").alias("dst"), F.lit(14).alias("stage"))
        hits = hits.unionByName(by_stem).unionByName(inside)
    return hits.filter("src <> dst").join(dependencies.select("dep_id", "type").hint("merge"), "dep_id").select("dep_id", "src", "dst", "type", "stage").distinct()
