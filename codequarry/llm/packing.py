"""Bulk-synchronous best-fit packing of documents into sequences of a fixed number of words.

Documents longer than a sequence are cut into whole sequences and a rest. In each round all pieces that wait and all gaps are range-sorted
by size together, a piece before a gap of its size. Each range is swept by its own task: a gap takes the nearest smaller piece that no other
gap between them takes, as a closing bracket takes the last open one, so that a piece gets its successor among the gaps, or the next one where several
pieces want it. What a range can't match by itself has a rank there, among its gaps or among its pieces; the driver matches
ranges of ranks from the counts of each range (two numbers a range), and a join of ranks settles these conflicts across ranges. Brackets match in one way
only, so the result doesn't depend on how many ranges there are. Then the gaps shrink, and the round is repeated; where
nothing fits any more, new sequences are opened for what is left. Once all that waits fits one task (`task_rows`), that task does the remaining rounds.

The rounds move numbers alone, (size, document, piece) or (gap, sequence); texts are written in pieces, moved to their places and then to their
sequences, and are compressed on the way, each piece by itself.

Defined results: null, empty and blank texts have no words and take no room, they don't appear; a null doc_id is kept;
repeated rows are packed as often as they come; equal sizes go by doc_id and piece; texts of any length are cut, none is dropped; other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm._text import SPACES, raw, slices
from codequarry.session import remove, scratch, ship, write_shared

CAPACITY, TASK_ROWS, RANGE_ROWS = 2048, 65_536, 1_000_000
_STATE = "kind int, value int, a long, b int, number long, sequence long, offset int"
_SWEPT = "part int, state int, rank long, " + _STATE
PIECE, GAP, PLACED = 0, 1, 2
_CODEC = pa.Codec("zstd")


def word_bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a column, first byte and byte after the last of each word, and the first word of each row (and the end)."""
    data, offsets = raw(column)
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SPACES[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:n]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return data, start, end, np.searchsorted(start, offsets)


def packed(text: bytes) -> bytes:
    """The text compressed, after its length."""
    return len(text).to_bytes(8, "little") + _CODEC.compress(text, asbytes=True)


def unpacked(value: bytes) -> bytes:
    return _CODEC.decompress(value[8:], int.from_bytes(value[:8], "little"), asbytes=True)


def _cut(capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, start, end, bounds = word_bounds(part.column("text"))
                count = np.diff(bounds)
                pieces = -(-count // capacity)
                row = np.repeat(np.arange(part.num_rows), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = bounds[row] + piece * capacity
                size = np.minimum(bounds[row + 1] - first, capacity)
                view = memoryview(data)
                texts = [packed(bytes(view[a:b])) for a, b in zip(start[first].tolist(), end[first + size - 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(texts, pa.binary())], ["doc_id", "piece", "size", "packed"])

    return cut


def brackets(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces and gaps in order: places of matched pieces, and of their gaps; places of gaps and of pieces that stay open."""
    step = np.where(kind == PIECE, 1, -1)
    after = np.cumsum(step)
    level = np.where(kind == PIECE, after, after + 1)  # a piece and its gap lie on one level
    order = np.argsort(level, kind="stable")
    same = (level[order[1:]] == level[order[:-1]]) & (kind[order[:-1]] == PIECE) & (kind[order[1:]] == GAP) if len(order) > 1 else np.zeros(0, bool)
    at = np.flatnonzero(same)
    piece, gap = order[at], order[at + 1]
    open_ = np.ones(len(kind), bool)
    open_[piece] = open_[gap] = False
    left = np.flatnonzero(open_)
    return piece, gap, left[kind[left] == GAP], left[kind[left] == PIECE]


def joined(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Of ranges in order, (range, open gaps, open pieces): runs (run, length, piece's range, piece's last rank, gap's range, gap's first rank).

    The gaps of a range come before its pieces; a gap takes the last open piece, so piece ranks fall as gap ranks rise.
    """
    runs, stack = [], []
    for part, gaps, pieces in counts:
        done = 0
        while done < gaps and stack:
            where, n = stack.pop()
            k = min(n, gaps - done)
            runs.append((len(runs), k, where, n - 1, part, done))
            done += k
            if n > k:
                stack.append((where, n - k))
        if pieces:
            stack.append((part, pieces))
    return runs


def _columns(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    return {c: table.column(c).fill_null(-(2**63) if c == "a" else 0).to_numpy() for c in ("kind", "value", "a", "b", "number", "sequence")}


def _rows(kind: int, value, a, b, number, sequence, offset) -> list[pa.Array]:
    n = len(value)
    as_ = lambda x, t: pa.array(np.broadcast_to(np.asarray(x), n).astype(t))
    return [as_(kind, np.int32), as_(value, np.int32), as_(a, np.int64), as_(b, np.int32), as_(number, np.int64), as_(sequence, np.int64), as_(offset, np.int32)]


def _sweep(capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A range in order to its matches (state 0) and to what stays open (state 1), with ranks by kind."""
    names = [x.split()[0] for x in _SWEPT.split(", ")]

    def out(part: int, state: int, rank: np.ndarray, columns: list[pa.Array]) -> pa.RecordBatch:
        n = len(rank)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, state, np.int32)), pa.array(rank.astype(np.int64)), *columns], names)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        part, c = TaskContext.get().partitionId(), _columns(found)
        piece, gap, gaps, pieces = brackets(c["kind"])
        free, size, sequence = c["value"][gap], c["value"][piece], c["sequence"][gap]
        yield out(part, 0, np.zeros(len(piece)), _rows(PLACED, size, c["a"][piece], c["b"][piece], c["number"][piece], sequence, capacity - free))
        yield out(part, 0, np.zeros(len(gap)), _rows(GAP, free - size, sequence, 0, 0, sequence, 0))
        for kind, at in ((GAP, gaps), (PIECE, pieces)):
            yield out(part, 1, np.arange(len(at)), _rows(kind, c["value"][at], c["a"][at], c["b"][at], c["number"][at], c["sequence"][at], 0))

    return sweep


def finish(c: dict[str, np.ndarray], capacity: int, opened: int) -> list[tuple[np.ndarray, ...]]:
    """All remaining rounds over pieces and gaps: (number, size, sequence, offset) of what each round places."""
    is_piece = c["kind"] == PIECE
    order = np.lexsort((c["number"], c["b"], c["a"], c["value"]))
    order = order[is_piece[order]]
    value, number = c["value"][order].astype(np.int64), c["number"][order]
    free, sequence = c["value"][~is_piece].astype(np.int64), c["sequence"][~is_piece]
    placed = []
    while len(value):
        use = np.flatnonzero(free >= value[0])
        free, sequence = free[use], sequence[use]
        if not len(free):
            more = -(-int(value.sum()) // capacity)
            free, sequence, opened = np.full(more, capacity, np.int64), np.arange(opened, opened + more), opened + more
        by = np.lexsort((sequence, free))
        free, sequence = free[by], sequence[by]
        both, kind = np.concatenate([value, free]), np.concatenate([np.zeros(len(value), int), np.ones(len(free), int)])
        place = np.lexsort((kind, both))  # stable: pieces and gaps keep their own orders
        piece, gap, _, _ = brackets(kind[place])
        p, g = place[piece], place[gap] - len(value)
        placed.append((number[p], value[p], sequence[g], capacity - free[g]))
        free[g] -= value[p]
        left = np.ones(len(value), bool)
        left[p] = False
        value, number = value[left], number[left]
    return placed


def _finish(capacity: int, opened: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        for number, _, sequence, offset in finish(_columns(found), capacity, opened) if found else ():
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(sequence.astype(np.int64)), pa.array(offset.astype(np.int32))], ["number", "sequence", "offset"])

    return rounds


def _round(state: DataFrame, ranges: int, capacity: int, path: str) -> tuple[DataFrame, int]:
    """One round over waiting pieces and gaps: the next state, with what was placed, and how many pieces were. What the sweep found is in `path`."""
    spark = state.sparkSession
    keys = ["value", "kind", F.col("a").asc_nulls_first(), "b", "number"]
    state.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).mapInArrow(_sweep(capacity), _SWEPT).write.parquet(path)
    swept = spark.read.parquet(path)
    per = swept.groupBy("part").agg(F.count_if((F.col("state") == 1) & (F.col("kind") == GAP)).alias("gaps"), F.count_if((F.col("state") == 1) & (F.col("kind") == PIECE)).alias("pieces"), F.count_if(F.col("kind") == PLACED).alias("placed")).collect()
    runs = joined(sorted((r["part"], r["gaps"], r["pieces"]) for r in per))
    columns = ["kind", "value", "a", "b", "number", "sequence", "offset"]
    done = swept.filter("state = 0").select(columns)
    count = sum(r["placed"] for r in per) + sum(r[1] for r in runs)
    if not runs:
        return done.unionByName(swept.filter("state = 1").select(columns)), count
    # two runs a range at most
    table = spark.createDataFrame(runs, "run long, length long, piece_part int, piece_last long, gap_part int, gap_first long")
    open_ = swept.filter("state = 1")
    inside = F.broadcast(table.select("run", "length", F.col("piece_part").alias("part"), "piece_last"))
    pieces = open_.filter(F.col("kind") == PIECE).alias("p").join(inside.alias("r"), F.expr("p.part = r.part and p.rank <= r.piece_last and p.rank > r.piece_last - r.length"), "left").select("p.*", "r.run", F.expr("r.piece_last - p.rank").alias("at"))
    inside = F.broadcast(table.select("run", "length", F.col("gap_part").alias("part"), "gap_first"))
    gaps = open_.filter(F.col("kind") == GAP).alias("g").join(inside.alias("r"), F.expr("g.part = r.part and g.rank >= r.gap_first and g.rank < r.gap_first + r.length"), "left").select("g.*", "r.run", F.expr("g.rank - r.gap_first").alias("at"))
    both = pieces.filter("run is not null").select("run", "at", F.col("value").alias("size"), "a", "b", "number").join(gaps.filter("run is not null").select("run", "at", F.col("value").alias("free"), "sequence"), ["run", "at"])
    made = F.explode(F.array(
        F.struct(F.lit(PLACED).alias("kind"), F.col("size").alias("value"), "a", "b", "number", "sequence", (F.lit(capacity) - F.col("free")).cast("int").alias("offset")),
        F.struct(F.lit(GAP).alias("kind"), (F.col("free") - F.col("size")).alias("value"), F.col("sequence").alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("number"), "sequence", F.lit(0).alias("offset")),
    ))
    rest = pieces.unionByName(gaps).filter("run is null").select(columns)
    return done.unionByName(both.select(made.alias("m")).select("m.*")).unionByName(rest), count


def place(pieces: DataFrame, capacity: int = CAPACITY, task_rows: int = TASK_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(number, sequence, offset) of pieces (number, doc_id, piece, size)."""
    spark = pieces.sparkSession
    waiting, volume = pieces.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    gaps = opened = -(-volume // capacity)
    long = lambda x: F.lit(x).cast("long")
    fresh = lambda first, n: spark.range(first, first + n).select(F.lit(GAP).alias("kind"), F.lit(capacity).alias("value"), F.col("id").alias("a"), F.lit(0).alias("b"), long(0).alias("number"), F.col("id").alias("sequence"), F.lit(0).alias("offset"))
    state = pieces.select(F.lit(PIECE).alias("kind"), F.col("size").alias("value"), F.col("doc_id").alias("a"), F.col("piece").alias("b"), "number", long(0).alias("sequence"), F.lit(0).alias("offset")).unionByName(fresh(0, opened))
    out = None
    while waiting + gaps > task_rows and waiting:
        swept = scratch(spark, "swept")
        state, placed = _round(state, max(-(-(waiting + gaps) // range_rows), int(spark.conf.get("spark.sql.shuffle.partitions"))), capacity, swept)
        state = write_shared(state, "round")
        remove(spark, swept)
        some = state.filter(F.col("kind") == PLACED).select("number", "sequence", "offset")
        out = some if out is None else out.unionByName(some)
        waiting -= placed
        least, volume = state.filter(F.col("kind") == PIECE).agg(F.min("value"), F.coalesce(F.sum("value"), F.lit(0))).first()
        state = state.filter((F.col("kind") == PIECE) | (F.col("kind") == GAP) & (F.col("value") >= (least or capacity + 1)))
        gaps = state.filter(F.col("kind") == GAP).count()
        if waiting and not gaps:
            gaps = -(-volume // capacity)
            state, opened = state.unionByName(fresh(opened, gaps)), opened + gaps
    last = state.coalesce(1).mapInArrow(_finish(capacity, opened), "number long, sequence long, offset int")
    return last if out is None else out.unionByName(last)


def _pieces(documents: DataFrame, capacity: int) -> DataFrame:
    cut = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(capacity), "doc_id long, piece int, size int, packed binary")
    return write_shared(cut.withColumn("number", F.monotonically_increasing_id()), "pieces")


def _placed(pieces: DataFrame, capacity: int, task_rows: int, range_rows: int) -> DataFrame:
    return write_shared(place(pieces.select("number", "doc_id", "piece", "size"), capacity, task_rows, range_rows), "placed")


def pack(documents: DataFrame, capacity: int = CAPACITY, task_rows: int = TASK_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, piece, start_word, n_words, sequence, offset): words start_word.. of a document go to `offset` of a sequence."""
    ship(documents.sparkSession)
    pieces = _pieces(documents, capacity)
    found = pieces.select("number", "doc_id", "piece", "size").join(_placed(pieces, capacity, task_rows, range_rows), "number")
    return found.select("doc_id", F.col("piece").cast("long").alias("piece"), (F.col("piece").cast("long") * capacity).alias("start_word"), F.col("size").cast("long").alias("n_words"), "sequence", F.col("offset").cast("long").alias("offset"))


def sequences(documents: DataFrame, capacity: int = CAPACITY, task_rows: int = TASK_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(sequence, n_words, doc_ids, pieces, text): what pack() says, made: pieces (offset, doc_id, piece, start_word, n_words) by offset, their texts parted by empty lines.

    A sequence has at most `capacity` words, so a group is never large.
    """
    ship(documents.sparkSession)
    pieces = _pieces(documents, capacity)
    found = pieces.join(_placed(pieces, capacity, task_rows, range_rows), "number")
    one = F.struct("offset", "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start_word"), F.col("size").alias("n_words"), "packed")
    rows = found.groupBy("sequence").agg(F.sort_array(F.collect_list(one)).alias("p"))
    fields = lambda x: F.struct(*(x[c].alias(c) for c in ("offset", "doc_id", "piece", "start_word", "n_words")))
    n = F.aggregate("p", F.lit(0), lambda s, x: s + x["n_words"])
    rows = rows.select("sequence", n.alias("n_words"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("p", fields).alias("pieces"), F.transform("p", lambda x: x["packed"]).alias("text"))
    return rows.mapInArrow(_texts, "sequence long, n_words int, doc_ids array<long>, pieces array<struct<offset: int, doc_id: long, piece: int, start_word: long, n_words: int>>, text string")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [b"\n\n".join(map(unpacked, x)).decode() for x in part.column("text").to_pylist()]
            yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def best_fit_decreasing(sizes: list[int], capacity: int) -> int:
    """Sequences that sequential best-fit decreasing needs."""
    gaps: list[int] = []
    opened = 0
    for size in sorted(sizes, reverse=True):
        at = bisect_left(gaps, size)
        if at < len(gaps):
            gap = gaps.pop(at)
        else:
            gap, opened = capacity, opened + 1
        insort(gaps, gap - size)
    return opened
