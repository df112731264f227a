"""A small code base as DataFrames."""

from codequarry.sources import extract as X
from codequarry.sources import store as S
from pyspark.sql import functions as F

LANGUAGE = {"py": "python", "php": "php", "rb": "ruby", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "vue": "vue"}


def code_base(spark, tree):
    """(files, symbols, dependencies) of {path: text}."""
    rows = [(p, LANGUAGE.get(p.rsplit(".", 1)[-1], "other"), t) for p, t in tree.items()]
    files = spark.createDataFrame(rows, "path string, language string, content string").select(X.file_id().alias("file_id"), "path", "language", F.length("content").cast("long").alias("size"), F.lit(None).cast("timestamp").alias("last_modified"), "content")
    found = X.extract(files).cache()
    return files, X.symbols_of(found), X.dependencies_of(found)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


__all__ = ["S", "code_base", "rows"]
