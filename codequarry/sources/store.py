"""The index of a code base as Parquet: files, symbols, dependencies, envelopes, metrics. Mutations are anti-joins and rewrites.

A table is a folder of versions; the last one that was written whole counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import text as T
from codequarry.sources import extract as X

FILES = "file_id long, path string, language string, size long, last_modified timestamp, content string"
DEPENDENCIES = "dep_id long, source_file_id long, target_name string, type string, line int"
ENVELOPES = "file_id long, summary string, architectural_layer string, decision_points array<string>, state_mutations array<string>, side_effects array<string>, business_rules array<string>"
METRICS = "run_id string, metric_name string, metric_value string"
EXCLUDED = ["vendor", "node_modules", "storage", "public/build", "public/vendor", "bootstrap/cache", "dist", "build", "coverage", "__pycache__", "venv", "target"]


def scan_tree(spark: SparkSession, root: str, exclude: list[str] = EXCLUDED, output_dir: str | None = None) -> DataFrame:
    """All files below root: (path, size, last_modified, content), path relative to root.

    Hidden directories and files, excluded directory names, excluded paths (patterns with a slash) and output_dir are left out; the
    filters are on the path alone, so contents of other files aren't read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^/+", "/")
    head = "/" + root.removeprefix("file:").strip("/") + "/"
    rows = raw.withColumn("path", F.regexp_replace(base, "^" + _quote(head), ""))
    simple = [e for e in exclude if "/" not in e]
    inside = F.concat(F.lit("/"), F.col("path"))
    keep = ~F.arrays_overlap(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), F.array(*(F.lit(s) for s in simple))) | (F.size(F.split("path", "/")) == 1) if simple else F.lit(True)
    keep = keep & ~inside.rlike(r"/\.")
    for e in [e for e in exclude if "/" in e] + ([output_dir.removeprefix(head).strip("/")] if output_dir and output_dir.startswith(head) else []):
        keep = keep & ~F.col("path").startswith(e.rstrip("/") + "/")
    return rows.filter(keep).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), F.expr("make_valid_utf8(cast(content as string))").alias("content"))


def _quote(s: str) -> str:
    return "\\Q" + s + "\\E"


def files_of(tree: DataFrame) -> DataFrame:
    """The files of analysed languages, with ids."""
    rows = tree.withColumn("language", T.language_of(F.col("path"))).filter("language is not null")
    return rows.select(X.file_id().alias("file_id"), "path", "language", "size", "last_modified", "content")


def unsupported_of(tree: DataFrame) -> DataFrame:
    """(language, n) of source files in languages that aren't analysed."""
    lang = F.create_map(*(F.lit(x) for kv in T.UNSUPPORTED.items() for x in kv))[F.lower(T.suffix(F.col("path")))]
    return tree.select(lang.alias("language")).filter("language is not null").groupBy("language").agg(F.count("*").alias("n")).orderBy("language")


def language_breakdown(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")


def snapshot_diff(discovered: DataFrame, indexed: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(path, state): new, pruned, unchanged (times less than `tolerance` seconds apart) or changed. Both sides: (path, mtime in seconds)."""
    both = discovered.select("path", F.col("mtime").alias("now")).join(indexed.select("path", F.col("mtime").alias("then")), "path", "full_outer")
    state = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "pruned").when(F.abs(F.col("now") - F.col("then")) < tolerance, "unchanged").otherwise("changed")
    return both.select("path", state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new`, and the others of `old`."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def cascade(children: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Children without those of the files (file_id) that are gone."""
    return children.join(gone.select(F.col("file_id").alias(key)).distinct(), key, "left_anti").select(*children.columns)


def prune(files: DataFrame, keep: DataFrame) -> DataFrame:
    """Files whose path is in `keep` (path)."""
    return files.join(keep.select("path").distinct(), "path", "left_semi")


def envelopes_by_layer(files: DataFrame, envelopes: DataFrame) -> DataFrame:
    """(layer, items): the envelopes of each layer by path."""
    rows = envelopes.join(files.select("file_id", "path"), "file_id")
    return rows.groupBy(F.col("architectural_layer").alias("layer")).agg(F.sort_array(F.collect_list(F.struct("path", "summary"))).alias("items"))


def metrics_of(metrics: DataFrame, run_id: str) -> DataFrame:
    """One row, a map of the run's metrics; the last of a name by value."""
    return metrics.filter(F.col("run_id") == run_id).groupBy("metric_name").agg(F.max("metric_value").alias("v")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric_name", "v")))).alias("metrics"))


class Index:
    """The tables of one code base below a folder."""

    TABLES = {"files": FILES, "symbols": f"symbol_id long, file_id long, type string, name string, namespace string, visibility string, line_start int, line_end int, parent_symbol_id long, metadata {X.METADATA}", "dependencies": DEPENDENCIES, "envelopes": ENVELOPES, "metrics": METRICS}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self, table: str) -> list[str]:
        """Folders of the table's whole versions, oldest first."""
        fs, p = self._fs(f"{self.folder}/{table}")
        if not fs.exists(p):
            return []
        names = sorted(f.getPath().getName() for f in fs.listStatus(p))
        return [f"{self.folder}/{table}/{n}" for n in names if n.startswith("v") and fs.exists(self._fs(f"{self.folder}/{table}/{n}/_SUCCESS")[1])]

    def exists(self, table: str) -> bool:
        return bool(self.versions(table))

    def read(self, table: str) -> DataFrame:
        if table == "metrics":
            fs, p = self._fs(f"{self.folder}/metrics")
            return self.spark.read.parquet(f"{self.folder}/metrics") if fs.exists(p) else self.spark.createDataFrame([], METRICS)
        found = self.versions(table)
        return self.spark.read.parquet(found[-1]) if found else self.spark.createDataFrame([], self.TABLES[table])

    def write(self, table: str, rows: DataFrame) -> None:
        """Write the next version. The one before stays for those that still read it, older ones go."""
        found = self.versions(table)
        n = int(found[-1].rsplit("v", 1)[1]) + 1 if found else 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/v{n:08d}")
        for old in found[:-1]:
            fs, p = self._fs(old)
            fs.delete(p, True)

    def file(self, path: str) -> DataFrame:
        return self.read("files").filter(F.col("path") == path)

    def symbols_in(self, path: str) -> DataFrame:
        """By line; in bulk, join on file_id instead."""
        return self.read("symbols").join(self.file(path).select("file_id"), "file_id", "left_semi").orderBy("line_start")

    def dependencies_in(self, path: str) -> DataFrame:
        return self.read("dependencies").join(self.file(path).select(F.col("file_id").alias("source_file_id")), "source_file_id", "left_semi").orderBy("line")

    def append_metrics(self, run_id: str, values: dict[str, str]) -> None:
        self.spark.createDataFrame([(run_id, k, v) for k, v in values.items()], METRICS).write.mode("append").parquet(f"{self.folder}/metrics")

    def reset(self) -> None:
        for table in self.TABLES:
            fs, p = self._fs(f"{self.folder}/{table}")
            fs.delete(p, True)

    def update(self, files: DataFrame) -> dict[str, int]:
        """Index a tree's files: only new and changed ones are read and parsed, rows of gone and changed ones go."""
        seconds: Column = F.unix_micros("last_modified") / 1e6
        old = self.read("files")
        states = snapshot_diff(files.select("path", seconds.alias("mtime")), old.select("path", seconds.alias("mtime"))).cache()
        n = {r.state: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
        fresh = files.join(states.filter("state in ('new', 'changed')"), "path", "left_semi").select(*old.columns)
        gone = old.join(states.filter("state in ('pruned', 'changed')"), "path", "left_semi").select("file_id")
        rows = X.extract(fresh).persist()
        symbols = cascade(self.read("symbols"), "file_id", gone).unionByName(X.symbols_of(rows))
        deps = cascade(self.read("dependencies"), "source_file_id", gone).unionByName(X.dependencies_of(rows))
        envelopes = cascade(self.read("envelopes"), "file_id", gone)
        kept = old.join(states.filter("state = 'unchanged'"), "path", "left_semi").select(*old.columns).unionByName(fresh)
        for table, df in (("symbols", symbols), ("dependencies", deps), ("envelopes", envelopes), ("files", kept)):
            self.write(table, df)
        rows.unpersist()
        states.unpersist()
        return {s: n.get(s, 0) for s in ("new", "changed", "unchanged", "pruned")}
