"""Near-duplicate documents by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its word bigrams (lower case, punctuation ignored). Every unit of weight of a
bigram owns a Poisson process of points in time, and each point falls on one of the signature's components; a
component's value is its earliest point. The weights 0, 1, 2, ... are discretised in dyadic intervals [0,1), [1,2),
[2,4), [4,8), ..., each with one process, whose points fall on one of its levels each by a hash; a document
takes the points below its weight. Two documents share a component's point with the probability of their weighted
Jaccard similarity, sum(min)/sum(max). Only points before a horizon that fills the signature are ever made, so the
work for a text is one hash a distinct bigram and some thousand points.

Signatures are cut in bands. In each bucket every document is linked to the least doc_id and to a predecessor.
Links whose ends aren't joined yet are verified by exact weighted Jaccard similarity on the texts; verified links
make groups (connected components). Where a bucket's members aren't in one group then, ever more of them, in an
order by hash that is another one in each band, are linked to all members of other groups, until no pair of a bucket
is left that is neither joined nor verified. So a bucket costs what it has members if they are alike, and at most all
its pairs if they aren't.

Defined results: null, empty and wordless texts, and rows without doc_id, belong to no group. Rows that share
a doc_id are one document; of a group of equals the least doc_id is kept. Texts of any length are compared whole. Exact copies (same words in the same order) are grouped without banding.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm._text import NON_WORD, U64, Words, mix, slices
from codequarry.session import checkpoint, ship, write_shared

BANDS, ROWS, THRESHOLD = 42, 6, 0.7
_LOW = U64(2**48 - 1)


def multisets(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bigram, count) of every distinct bigram of every text, sorted; one word alone is its own bigram."""
    grams, ok = words.grams(2)
    single = words.count[words.doc] == 1 if len(words.doc) else np.zeros(0, bool)
    grams = np.where(single, mix(words.hash), grams)
    use = ok | single
    key = np.sort((words.doc[use].astype(U64) << U64(48)) | (grams[use] >> U64(16)))
    if not len(key):
        return np.zeros(0, np.int64), key, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> U64(48)).astype(np.int64), key & _LOW, count


def signatures(row: np.ndarray, gram: np.ndarray, count: np.ndarray, rows: int, m: int) -> np.ndarray:
    """A row of m 64-bit values for each of `rows` multisets; 0 where a multiset is empty."""
    least = np.full((rows, m), np.inf)
    total = np.bincount(row, count, rows)
    horizon = np.divide(np.log(m) + 2, total, out=np.zeros(rows), where=total > 0)
    roots = np.ceil(np.log2(count)).astype(np.int64) + 1 if len(count) else count  # intervals that begin below the weight
    unit = np.repeat(np.arange(len(row)), roots)
    root = np.arange(len(unit)) - np.repeat(np.cumsum(roots) - roots, roots)
    width = np.where(root > 0, 1 << np.maximum(root - 1, 0), 1)
    low = np.where(root > 0, width, 0)
    owner, weight = row[unit], count[unit]
    seed = mix(gram[unit] * U64(64) + root.astype(U64))
    todo = np.flatnonzero(total > 0)
    while len(todo):
        wanted = np.zeros(rows, bool)
        wanted[todo] = True
        live = np.flatnonzero(wanted[owner])
        time, k = np.zeros(len(live)), 0
        while len(live):
            h = mix(seed[live] + U64(k * 0x9E3779B97F4A7C15 % 2**64))
            time = time - np.log(((h >> U64(11)).astype(np.float64) + 0.5) / 2**53) / (m * width[live])
            early = time <= horizon[owner[live]]
            live, time, h = live[early], time[early], h[early]
            g = mix(h)
            taken = low[live] + (g >> U64(32)).astype(np.int64) % width[live] < weight[live]
            np.minimum.at(least, (owner[live[taken]], ((g[taken] & U64(0xFFFFFFFF)) % U64(m)).astype(np.int64)), time[taken])
            k += 1
        todo = todo[np.isinf(least[todo]).any(1)]
        least[todo] = np.inf
        horizon[todo] *= 2
    return np.where(np.isinf(least), U64(0), mix(least.view(U64)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"), NON_WORD, lower=True)
            sig = signatures(*multisets(words), words.rows, BANDS * ROWS)
            some = np.flatnonzero(words.count)
            band = np.zeros((words.rows, BANDS), U64)
            for i in range(ROWS):
                band = band * U64(0x9E3779B97F4A7C15) + sig[:, i::ROWS]
            place = np.arange(len(words.doc)) - words.bounds[:-1][words.doc]
            ordered = mix(words.hash + mix(place.astype(U64)))
            sums = np.add.reduceat(np.append(ordered, U64(0)), words.bounds[:-1])[some] if len(some) else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(some)), pa.array(sums.view(np.int64)), pa.array(words.count[some]), pa.FixedSizeListArray.from_arrays(pa.array(mix(band)[some].ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))],
                ["doc_id", "words_hash", "n_words", "bands"],
            )


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both)) if len(a[1]) or len(b[1]) else 0.0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (leader, salt), the leader's own first."""
    leader, own = None, (np.zeros(0, U64), np.zeros(0, np.int64))
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"), NON_WORD, lower=True)
            row, gram, count = multisets(words)
            bounds = np.searchsorted(row, np.arange(words.rows + 1))
            out: tuple[list, list, list] = ([], [], [])
            for i, (doc, to) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("leader").to_pylist(), strict=True)):
                mine = gram[bounds[i] : bounds[i + 1]], count[bounds[i] : bounds[i + 1]]
                if doc == to:
                    leader, own = to, mine
                elif leader == to:
                    for to_list, value in zip(out, (doc, to, overlap(mine, own)), strict=True):
                        to_list.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["a", "b", "similarity"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for every node of edges (a, b), the least node it is connected with. Alternating stars.

    A star's least node comes by an aggregation and a join back, which large stars don't put on one task.
    """
    edges = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = pairs.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = checkpoint(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())
        last = state


def verified(links: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, similarity) of links (a, b), each text of a going to the leader b's place; large stars are spread over salts.

    Merge joins whatever the size: the work is in proportion to the texts of linked documents.
    """
    links = links.join(links.groupBy("b").agg(F.ceil(F.count("*") / 500).alias("salts")), "b")
    salted = links.select(F.col("a").alias("doc_id"), F.col("b").alias("leader"), F.pmod(F.xxhash64("a"), "salts").alias("salt"))
    rows = write_shared(salted.union(salted.select(F.col("leader"), F.col("leader"), F.col("salt")).distinct()), "pairs")
    texts = docs.join(rows.hint("merge"), "doc_id").select("leader", "salt", "doc_id", "text")
    texts = texts.repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("doc_id") != F.col("leader"), "doc_id")
    return texts.mapInArrow(_verify, "a long, b long, similarity double")


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Members of groups of near-duplicates: (doc_id, group_id, keep). group_id is the group's least doc_id, which is kept."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    signed = write_shared(docs.mapInArrow(_sign, "doc_id long, words_hash long, n_words long, bands array<long>"), "signatures")
    exact = write_shared(signed.groupBy("words_hash", "n_words").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "copies")
    firsts = signed.join(exact.select(F.col("rep").alias("doc_id"), "words_hash", "n_words"), ["doc_id", "words_hash", "n_words"], "left_semi")
    own = firsts.select("doc_id", F.posexplode("bands").alias("band", "value"))
    sizes = own.groupBy("band", "value").agg(F.count("*").alias("size"), F.min("doc_id").alias("leader")).filter("size > 1")
    inside = own.join(sizes, ["band", "value"]).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / 1000)))
    near = Window.partitionBy("band", "value", "salt").orderBy("doc_id")  # about a thousand rows of a bucket, however many it has
    inside = write_shared(inside.select("doc_id", "band", "value", "size", "leader", F.lag("doc_id").over(near).alias("previous")), "buckets")
    links = inside.filter("doc_id > leader").select(F.col("doc_id").alias("a"), F.explode(F.array_distinct(F.array("leader", F.coalesce("previous", "leader")))).alias("b")).filter("a <> b")
    links = write_shared(links.groupBy("a", "b").agg(F.count("*").alias("votes")), "links")
    linked = links.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    docs = write_shared(docs.join(linked.hint("merge"), "doc_id", "left_semi"), "linked")  # the corpus is moved once, later rounds move linked texts alone
    best = Window.partitionBy("a").orderBy(F.desc("votes"), "b")
    done, labels = None, None
    for step in range(3):  # the likeliest link of each document, again for those not joined yet, then all others
        open_ = links
        if labels is not None:
            open_ = links.join(done.select("a", "b"), ["a", "b"], "left_anti")
            la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
            open_ = open_.join(la, "a", "left").join(lb, "b", "left").filter("coalesce(la, a) <> coalesce(lb, b)")
        if step < 2:
            open_ = open_.withColumn("n", F.row_number().over(best)).filter("n = 1")
        found = write_shared(verified(open_.select("a", "b"), docs), "verified")
        done = found if done is None else done.union(found)
        labels = components(done.filter(F.col("similarity") >= threshold).select("a", "b"))
    # links are all pairs of buckets of up to three
    crowds = inside.filter("size > 3").select("doc_id", "band", "value", F.xxhash64("band", "doc_id").alias("place"))
    bucket, leaders = ["band", "value"], 1
    while True:
        # those who led are through: every later member of their buckets is joined with them or verified against them
        crowds = crowds.select("doc_id", "band", "value", "place").join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        open_ = crowds.groupBy(bucket).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select(bucket)
        crowds = write_shared(crowds.join(open_, bucket, "left_semi"), "crowds")
        if not crowds.limit(1).count():
            break
        # each task keeps the first few of a bucket before they meet
        first = F.row_number().over(Window.partitionBy(*bucket).orderBy("place", "doc_id"))
        leading = write_shared(crowds.withColumn("n", first).filter(F.col("n") <= leaders).select(*bucket, F.col("doc_id").alias("other"), F.col("place").alias("at"), F.col("label").alias("group")), "leading")
        pairs = crowds.join(leading, bucket).filter("(place > at or place = at and doc_id > other) and label <> group").select(F.greatest("doc_id", "other").alias("a"), F.least("doc_id", "other").alias("b")).distinct()
        found = write_shared(verified(pairs.join(done.select("a", "b"), ["a", "b"], "left_anti"), docs), "verified")
        done = done.union(found)
        joined = found.filter(F.col("similarity") >= threshold).select("a", "b")
        if joined.limit(1).count():
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(joined))
        crowds = crowds.join(leading.select(*bucket, F.col("other").alias("doc_id")), [*bucket, "doc_id"], "left_anti")
        leaders *= 4
    groups = exact.join(labels, exact["rep"] == labels["node"], "left").select("words_hash", "n_words", "copies", F.col("label"), F.coalesce("label", "rep").alias("group_id"))
    groups = groups.filter("copies > 1 or label is not null").select("words_hash", "n_words", "group_id")
    members = signed.select("doc_id", "words_hash", "n_words").join(groups, ["words_hash", "n_words"])
    return members.select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("keep")).distinct()
