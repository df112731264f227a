"""Passages that repeat across documents, by suffix arrays built column by column.

A document is a sequence of words (parted by ASCII white space). A passage of `length` words or more repeats if it also occurs in
another document.

1. Anchors: of each `length` consecutive words, the least hash of anchor_words(length) consecutive ones (winnowing). Two occurrences of a
   passage share their anchors, so a passage can only repeat where an anchor occurs in two documents. An anchor has two fifths of the
   words of a passage, so that short formulas which many documents share make no bucket of unlike contexts.
2. Contexts: all words that a passage of `length` words around such an anchor may take. Equal contexts of one anchor become one, with
   the least and the greatest of their documents.
3. The contexts that share an anchor meet in one bucket, where the Burrows-Wheeler transform of the collection of all contexts
   is built together with its longest common prefixes: in each round every context inserts one symbol, from its last word to its first
   (Bauer, Cox, Rosone 2011; Cox, Garofalo, Rosone, Sciortino 2016). The place of a new suffix follows from the place of its tail; the
   columns are then rewritten in one sequential pass. Where neighbours have `length` words in common and documents differ,
   the passage repeats. A bucket has a bounded number of words, so its columns are rewritten in the worker's memory; with `external`
   they go through sequential files in the shared folder after each round (the README has what that costs).
4. Hot anchors, with more than `HOT` unlike contexts: a passage takes more words at the anchor's left or right, so such contexts meet where they share
   the anchor and half of these, in two windows a context. Windows still hot are widened to `length` words, which are passages as they are.
   So a bucket has at most HOT contexts beyond BUCKET_SYMBOLS, however many documents share an anchor.
5. Ranges of words are put back on the documents and merged.

Defined results: null and empty texts and texts of fewer than `length` words have no passages; rows without doc_id are ignored; rows that
share a doc_id are one document, a passage that only repeats within one isn't reported; passages that touch or overlap
are one range; texts of any length are read whole. Other columns are ignored. Words are compared by 32 bits of their hash, anchors by 64.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm._text import U64, Words, mix, raw, slices, slide
from codequarry.session import scratch, ship, write_shared

LENGTH, BUCKET_SYMBOLS, HOT = 50, 400_000, 4_000
_TOP = 2**64 - 1


def anchor_words(length: int) -> int:
    return max(1, 2 * length // 5)


def anchors(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (among all words) of the anchors, and the hashes from every position on."""
    grams, _ = words.grams(anchor_words(length))
    width = length - anchor_words(length) + 1
    least = slide(grams, width, np.minimum, _TOP)
    total = len(grams)
    least[np.arange(total) + length > words.bounds[1:][words.doc]] = 0  # no whole passage begins here
    most = slide(least[::-1], width, np.maximum, 0)[::-1]  # of the windows that begin at most width - 1 before
    return np.flatnonzero((most == grams) & (grams > 0)), grams


def _anchors(length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                at, grams = anchors(words, length)
                row = words.doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), part.column("doc_id").take(pa.array(row)), pa.array((at - words.bounds[:-1][row]).astype(np.int32))], ["anchor", "doc_id", "place"])

    return find


def _contexts(length: int):
    before, after = length - anchor_words(length), length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                symbols = np.maximum((words.hash >> U64(32)).astype(np.uint32), 1)
                places = part.column("places")
                row = np.repeat(np.arange(part.num_rows), np.diff(places.offsets.to_numpy()))
                flat = places.flatten()
                place, anchor = flat.field("place").to_numpy().astype(np.int64), flat.field("anchor")
                use = place + anchor_words(length) <= words.count[row]
                row, place, anchor = row[use], place[use], anchor.filter(pa.array(use))
                first = np.maximum(place - before, 0)
                last = np.minimum(place + after, words.count[row])
                begin = words.bounds[:-1][row]
                size = last - first
                index = np.repeat(begin + first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                offsets = np.concatenate([[0], np.cumsum(size) * 4]).astype(np.int32)
                context = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(symbols[index].tobytes())])
                yield pa.RecordBatch.from_arrays([anchor, context, part.column("doc_id").take(pa.array(row)), pa.array(first.astype(np.int32)), pa.array((place - first).astype(np.int32))], ["anchor", "context", "doc_id", "first", "at"])

    return cut


class Files:
    """The columns of a bucket between two rounds, as sequential files in a folder that executors share."""

    def __init__(self, folder: str):
        self.system, self.path = fs.FileSystem.from_uri(f"{folder.rstrip('/')}/{uuid.uuid4().hex}")
        self.system.create_dir(self.path)

    def through(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        """Write the columns one after the other, and read them again."""
        for k, column in enumerate(columns):
            with self.system.open_output_stream(f"{self.path}/{k}") as out:
                out.write(memoryview(np.ascontiguousarray(column)).cast("B"))
        back = []
        for k, column in enumerate(columns):
            with self.system.open_input_stream(f"{self.path}/{k}") as rows:
                back.append(np.frombuffer(rows.readall(), column.dtype))
        return back

    def delete(self) -> None:
        self.system.delete_dir(self.path)


def build(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, files: Files | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """BWT and common prefixes of a collection of strings of symbols above 0, by rounds of one symbol a string.

    Returns, in the order of the suffixes: the symbol before each (0: none), the common prefix with the suffix before it,
    the string and the offset of each. With `files`, the columns go through them after each round. The first entries are the empty suffixes, in the order of the strings.
    """
    count = len(starts)
    key = np.arange(count, dtype=U64)  # first symbol, and the place of the tail; of the empty suffixes: 0, and the string
    prefix = np.zeros(count, np.min_scalar_type(int(sizes.max(initial=0))))  # no prefix is longer than the longest string
    before = np.zeros(count, np.uint32)
    owner = np.arange(count, dtype=np.int32)
    offset = sizes.astype(np.int32).copy()
    place = np.arange(count)
    low = U64(0xFFFFFFFF)
    for step in range(1, int(sizes.max(initial=0)) + 1):
        live = np.flatnonzero(sizes >= step)
        symbol = text[starts[live] + sizes[live] - step]
        before[place[live]] = symbol
        new = (symbol.astype(U64) << U64(32)) | place[live].astype(U64)
        order = np.argsort(new)
        live, new = live[order], new[order]
        at = np.searchsorted(key, new)
        total = len(key)
        to = np.insert(key, at, new)  # keys by the places of before this round
        where = at + np.arange(len(at))
        fresh = np.zeros(len(to), bool)
        fresh[where] = True
        changed = fresh.copy()
        changed[np.minimum(where + 1, len(to) - 1)] = True
        changed[0] = False
        changed = np.flatnonzero(changed)
        same = changed[(to[changed] >> U64(32)) == (to[changed - 1] >> U64(32))]
        same = same[to[same] >> U64(32) > U64(0)]
        longer = np.insert(prefix, at, 0)
        longer[changed] = 0
        if len(same):
            a, b = (to[same - 1] & low).astype(np.int64) + 1, (to[same] & low).astype(np.int64)
            longer[same] = _range_min(prefix, a, b).astype(np.int64) + 1
        moved = np.arange(total, dtype=np.int64) + np.cumsum(np.bincount(at, minlength=total + 1))[:total]
        heads = to >> U64(32)
        tails = (to & low).astype(np.int64)
        inner = heads > U64(0)
        tails[inner] = moved[tails[inner]]
        key = (heads << U64(32)) | tails.astype(U64)
        prefix = longer
        before = np.insert(before, at, 0)
        owner = np.insert(owner, at, live.astype(np.int32))
        offset = np.insert(offset, at, (sizes[live] - step).astype(np.int32))
        place = moved[place]
        place[live] = where
        if files:
            key, prefix, before, owner, offset = files.through([key, prefix, before, owner, offset])
            before = before.copy()
    return before, prefix, owner, offset


def _range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of x[a..b], both ends included."""
    level = np.floor(np.log2(b - a + 1)).astype(np.int64)
    out = np.zeros(len(a), x.dtype)
    table, size = x, 1
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            table = np.minimum(table[: len(table) - size], table[size:])
            size *= 2
        mine = np.flatnonzero(level == k)
        out[mine] = np.minimum(table[a[mine]], table[b[mine] - size + 1])
    return out


def repeats(contexts: list[tuple[bytes, int, int]], length: int, folder: str | None = None) -> list[list[tuple[int, int]]]:
    """Ranges of words of each context (words as 32-bit symbols, least and greatest document) that repeat across documents."""
    sizes = np.array([len(c) // 4 for c, _, _ in contexts])
    text = np.frombuffer(b"".join(c for c, _, _ in contexts), np.uint32)
    files = Files(folder) if folder else None
    _, prefix, owner, offset = build(text, np.cumsum(sizes) - sizes, sizes, files)
    if files:
        files.delete()
    first = np.flatnonzero(prefix < length)
    low, high = (np.array(x)[owner] for x in zip(*((a, b) for _, a, b in contexts), strict=True))
    group = np.cumsum(prefix < length) - 1
    across = np.minimum.reduceat(low, first) != np.maximum.reduceat(high, first)
    hit = np.flatnonzero(across[group] & (sizes[owner] - offset >= length))
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    hit = hit[np.lexsort((offset[hit], owner[hit]))]
    for o, s in zip(owner[hit].tolist(), offset[hit].tolist(), strict=True):
        ranges = out[o]
        if ranges and s <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], s + length)
        else:
            ranges.append((s, s + length))
    return out


def _bucket(length: int, folder: str | None):
    """Contexts come sorted by bucket; whole buckets are gathered to about BUCKET_SYMBOLS words."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({r[1:3]: r for r in rows}.values())  # a hot context can come by several windows
        found = repeats([(c, a, b) for _, _, _, c, a, b in rows], length, folder)
        flat = [(rows[i][1], rows[i][2], a, b) for i, ranges in enumerate(found) for a, b in ranges]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["anchor", "context_hash", "from_word", "to_word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        symbols = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "anchor", "context_hash", "context", "low", "high")), strict=True):
                if symbols >= BUCKET_SYMBOLS and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, symbols = [], 0
                rows.append(row)
                symbols += len(row[3]) // 4
        if rows:
            yield solve(rows)

    return run


def extras(span: int) -> list[int]:
    """By how many words windows are wider than the anchor: half of what a passage has besides it, then all, where a window is a passage."""
    return sorted({(span + 1) // 2, span})


def offsets(span: int, extra: int) -> list[int]:
    """How many words a window begins before the anchor, so that every passage around the anchor holds one of them."""
    return sorted({*range(0, extra, span - extra + 1), extra})


def _windows(length: int, extra: int):
    """Each context with every window of the anchor and `extra` words more that it holds."""
    wide, before = anchor_words(length) + extra, offsets(length - anchor_words(length), extra)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, bounds = raw(batch.column("context"))
            symbols, bounds = data.view(np.uint32) if len(data) else np.zeros(0, np.uint32), bounds // 4
            at, size, anchor = batch.column("at").to_numpy().astype(np.int64), np.diff(bounds), batch.column("anchor").to_numpy()
            for b in before:
                use = np.flatnonzero((at >= b) & (at - b + wide <= size))
                if not len(use):
                    continue
                start = bounds[use] + at[use] - b
                key = mix(anchor[use].view(U64) + U64(b))
                for k in range(wide):
                    key = key * U64(0x9E3779B97F4A7C15) + symbols[start + k].astype(U64)
                names = ["anchor", "context_hash", "low", "high"]
                yield pa.RecordBatch.from_arrays([pa.array(mix(key).view(np.int64)), *(batch.column(c).take(pa.array(use)) for c in names), pa.array((at[use] - b).astype(np.int32))], ["bucket", *names, "from_word"])

    return cut


_WINDOW = "bucket long, anchor long, context_hash long, low long, high long, from_word int"


def split(rows: DataFrame, length: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Contexts of hot anchors: (bucket, anchor, context_hash, context, low, high) of buckets of at most `hot` contexts, and ranges that need none.

    Windows go without their contexts, a few numbers each; a context is in a bucket once, as a window's place in it is part of the bucket.
    """
    half, span = extras(length - anchor_words(length))[0], length - anchor_words(length)
    wide = write_shared(rows.mapInArrow(_windows(length, half), _WINDOW), "windows")
    size = wide.groupBy("bucket").agg(F.count("*").alias("n"), F.min("low").alias("least"), F.max("high").alias("most")).filter("least <> most")
    size = write_shared(size.select("bucket", "n"), "window_sizes")
    wanted = wide.join(size.filter(F.col("n") <= hot).select("bucket"), "bucket").select("bucket", "anchor", "context_hash")
    some = wanted.join(rows.select("anchor", "context_hash", "context", "low", "high"), ["anchor", "context_hash"]).select("bucket", "anchor", "context_hash", "context", "low", "high")
    large = wide.join(size.filter(F.col("n") > hot).select("bucket"), "bucket", "left_semi").select("anchor", "context_hash").distinct()
    whole = write_shared(rows.join(large, ["anchor", "context_hash"], "left_semi").mapInArrow(_windows(length, span), _WINDOW), "windows")
    shared = whole.groupBy("bucket").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least <> most").select("bucket")
    places = whole.join(shared, "bucket", "left_semi").select("anchor", "context_hash", "from_word").distinct()
    # windows of a context that overlap or touch are one range
    near = Window.partitionBy("anchor", "context_hash").orderBy("from_word")
    new = F.when(F.col("from_word") > F.lag("from_word").over(near) + length, 1).otherwise(0)
    ranges = places.withColumn("new", new).withColumn("range", F.sum("new").over(near)).groupBy("anchor", "context_hash", "range").agg(F.min("from_word").alias("from_word"), (F.max("from_word") + length).alias("to_word"))
    return some, ranges.select("anchor", "context_hash", "from_word", "to_word")


def repeated_passages(documents: DataFrame, length: int = LENGTH, hot: int = HOT, external: bool = False) -> DataFrame:
    """(doc_id, start_word, end_word) of the passages of at least `length` words that other documents share; end_word is excluded.

    external: the columns of each bucket go through files of the shared folder in each round, instead of staying in the worker's memory.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    found = write_shared(docs.mapInArrow(_anchors(length), "anchor long, doc_id long, place int"), "anchors")
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low <> high").select("anchor")
    places = found.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place")).alias("places"))
    contexts = docs.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(_contexts(length), "anchor long, context binary, doc_id long, first int, at int")
    contexts = write_shared(contexts.withColumn("context_hash", F.xxhash64("context", "at")), "contexts")
    crowded = write_shared(contexts.select("anchor", "context_hash").distinct().groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("anchor"), "hot_anchors")
    busy = crowded.limit(1).count() > 0
    merged = lambda rows: rows.groupBy("anchor", "at", "context_hash", "context").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    parts = merged(contexts.join(crowded, "anchor", "left_anti") if busy else contexts).select(F.col("anchor").alias("bucket"), "anchor", "context_hash", "context", "low", "high")
    direct = None
    if busy:
        some, direct = split(write_shared(merged(contexts.join(crowded, "anchor", "left_semi")), "hot_contexts"), length, hot)
        parts = parts.unionByName(some)
    parts = parts.repartition("bucket").sortWithinPartitions("bucket")
    ranges = parts.mapInArrow(_bucket(length, scratch(spark, "columns") if external else None), "anchor long, context_hash long, from_word int, to_word int")
    if direct is not None:
        ranges = ranges.unionByName(direct)
    spans = contexts.select("anchor", "context_hash", "doc_id", "first").join(ranges, ["anchor", "context_hash"])
    spans = spans.select("doc_id", (F.col("first") + F.col("from_word")).alias("start_word"), (F.col("first") + F.col("to_word")).alias("end_word")).distinct()
    sorted_ = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(sorted_.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(reach.isNull() | (F.col("start_word") > reach), 1).otherwise(0))
    marked = marked.withColumn("passage", F.sum("new").over(sorted_.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "passage").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).select("doc_id", "start_word", "end_word")


def oracle(length: int = LENGTH) -> str:
    return f"""
WITH w AS (SELECT DISTINCT doc_id, [x FOR x IN regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+') IF x <> ''] AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - {length} + 1)) AS i FROM w WHERE len(ws) >= {length}),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + {length}], ' ')) AS h FROM p),
r AS (SELECT h FROM h GROUP BY h HAVING count(DISTINCT doc_id) > 1),
s AS (SELECT DISTINCT doc_id, i FROM h WHERE h IN (SELECT h FROM r)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {length} THEN 0 ELSE 1 END AS new FROM s),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS passage FROM g)
SELECT doc_id, CAST(min(i) AS INTEGER) AS start_word, CAST(max(i) + {length} AS INTEGER) AS end_word FROM k GROUP BY doc_id, passage"""
