"""Continuous indexing: new and changed files of a tree, as they come, into the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codequarry.functions import text as T
from codequarry.session import scratch
from codequarry.sources import extract as X
from codequarry.sources import store as S

BINARY = "path string, modificationTime timestamp, length long, content binary"


def upsert_batch(index: S.Index, files: DataFrame) -> None:
    """Replace these files and what hangs on them. A batch that is repeated after a failure gives the same index."""
    files = files.persist()
    rows = X.extract(files).persist()
    gone = files.select("file_id")
    index.write("symbols", S.cascade(index.read("symbols"), "file_id", gone).unionByName(X.symbols_of(rows)))
    index.write("dependencies", S.cascade(index.read("dependencies"), "source_file_id", gone).unionByName(X.dependencies_of(rows)))
    index.write("envelopes", S.cascade(index.read("envelopes"), "file_id", gone))
    index.write("files", S.upsert(index.read("files"), files, "path"))
    rows.unpersist()
    files.unpersist()


def watch(spark: SparkSession, root: str, index: S.Index, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Start the query; trigger: of writeStream, available files once by default. Deletions are for Index.update to see."""
    head = "/" + root.removeprefix("file:").strip("/") + "/"
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^\\Q" + head + "\\E", "")
    tree = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), F.expr("make_valid_utf8(cast(content as string))").alias("content"))
    files = S.files_of(tree.filter(~F.concat(F.lit("/"), T.forward(F.col("path"))).rlike(r"/\.")))
    run = files.writeStream.option("checkpointLocation", checkpoint or scratch(spark, "reindex")).trigger(**(trigger or {"availableNow": True}))
    return run.foreachBatch(lambda batch, _: upsert_batch(index, batch)).start()
