"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel edit distance.

Texts are compared in lower case with white space runs as one blank, items and documents by the same Arrow functions, which
take each character by itself. An item of m characters may occur in a document with
k = floor(error_rate * m) edits; cut into k + 1 pieces, one of them then occurs unchanged. An Aho-Corasick automaton of
all pieces finds their exact hits in one pass over a text; around each, Myers' algorithm computes the least edit distance
of the item to any substring. Of these places only those are verified where enough of the item's Q-grams occur: k edits change at
most k * Q of them, so that items which share a sentence cost little. Nothing within the budget is missed, and nothing beyond it is reported.

The benchmark goes to executors only in parts of at most `part_chars` characters, whatever its size; each part is
one automaton and, beyond the first, one more pass over the documents.

Defined results: null and empty texts and items never match, nor do items without letters or digits; rows without doc_id or
item_id are ignored; rows that repeat give one result row each (doc_id, item_id), with the least distance. Pieces of
less than one character can't arise, as k < m. Texts of any length are searched whole. Other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm._text import slices
from codequarry.session import ship

ERROR_RATE, PART_CHARS, Q = 0.08, 8_000_000, 5
# RE2's \s is ASCII; other white space is named
_BLANKS = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def normalised(texts: pa.Array) -> pa.Array:
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), _BLANKS, " "))


def normal(text: str) -> str:
    return normalised(pa.array([text]))[0].as_py()


def pieces(item: str, error_rate: float) -> list[tuple[str, int]]:
    """The floor(error_rate * m) + 1 pieces of an item, of nearly equal length, with their offsets."""
    n = int(error_rate * len(item)) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(item[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


def alphabet(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def distance_within(masks: dict[str, int], m: int, text: str, most: int) -> int:
    """Least edit distance of the pattern to any substring of the text; most + 1 if that is larger (Myers 1999, any length)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        ph = ph << 1 & full
        mh = mh << 1 & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
    return min(best, most + 1)


def automaton(items: list[tuple[int, str]], error_rate: float):
    import ahocorasick

    found: dict[str, list[tuple[int, int]]] = {}
    for at, (_, item) in enumerate(items):
        for piece, offset in pieces(item, error_rate):
            found.setdefault(piece, []).append((at, offset))
    auto = ahocorasick.Automaton()
    for piece, where in found.items():
        auto.add_word(piece, (len(piece), where))
    auto.make_automaton()
    return auto


def leaks(text: str, auto, items: list[tuple[int, str]], masks: list[dict[str, int]], error_rate: float) -> dict[int, int]:
    """Least distance by place in `items`, of those that occur within their budget."""
    regions: dict[int, list[tuple[int, int]]] = {}
    for end, (length, where) in auto.iter(text):
        for at, offset in where:
            m = len(items[at][1])
            k = int(error_rate * m)
            begin = end - length + 1 - offset
            regions.setdefault(at, []).append((max(0, begin - k), begin + m + k))
    out = {}
    seen: dict[tuple[int, int], set[str]] = {}
    for at, spans in regions.items():
        m = len(items[at][1])
        k = int(error_rate * m)
        spans.sort()
        merged = [list(spans[0])]
        for a, b in spans[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        least = m - Q + 1 - k * Q  # as many of its Q-grams an occurrence still has
        grams = [items[at][1][i : i + Q] for i in range(m - Q + 1)]
        best = k + 1
        for a, b in merged:
            there = seen.get((a, b))
            if there is None:
                there = seen[a, b] = {text[i : i + Q] for i in range(max(a, 0), min(b, len(text)) - Q + 1)}
            if sum(map(there.__contains__, grams)) >= least:
                best = min(best, distance_within(masks[at], m, text[a:b], k))
        if best <= k:
            out[at] = best
    return out


def _scan(shared, error_rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        if not items:
            return
        auto = automaton(items, error_rate)
        masks = [alphabet(t) for _, t in items]
        for batch in batches:
            for part in slices(batch, "text"):
                texts = normalised(part.column("text"))
                rows = [(doc, items[at][0], d, len(items[at][1])) for doc, text in zip(part.column("doc_id").to_pylist(), texts.to_pylist(), strict=True) if text for at, d in leaks(text, auto, items, masks, error_rate).items()]
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "distance", "item_chars"), r, strict=True)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("item_chars", pa.int32())]))

    return scan


def contaminated(documents: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, item_chars) for each benchmark item within its error budget in a document."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text <> ''")
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text rlike '[\\\\p{L}\\\\p{N}]'")
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = chars // part_chars + 1
    out = None
    for i in range(parts):
        some = tests if parts == 1 else tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i)
        rows = some.collect()
        texts = normalised(pa.array([r.text for r in rows], pa.string())).to_pylist()
        shared = spark.sparkContext.broadcast(sorted({(r.item_id, t) for r, t in zip(rows, texts, strict=True) if t}))
        found = docs.mapInArrow(_scan(shared, error_rate), "doc_id long, item_id long, distance int, item_chars int")
        out = found if out is None else out.union(found)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.min_by("item_chars", "distance").alias("item_chars"))
