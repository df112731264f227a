"""Language identification as inference of a multilingual mixture.

Each language has a multinomial over hashed byte 4-grams, fitted on a bounded sample of labelled documents
(`sample` a language). A document's words are drawn from a mixture of languages: the likelihood of a word under a
language is the product over its n-grams, and expectation-maximisation estimates the proportions. The set of languages starts
whole; the least language goes as long as that improves the penalised likelihood (BIC: half of log(words) a proportion),
so that a text in one language has one. Whole texts are used, all documents of a batch at once.

A document is accepted if its main language explains at least `share` of its words, and its words are as likely as words of its
languages are: mean log likelihood (a word's being that of its n-grams on average, so that its length doesn't count) no more than `TAIL`
standard deviations below what held-out labelled documents have, a deviation being that of words over the square root of how many
different words there are, and that of documents. So what has no words, is scattered
over languages, or is in none of them (another language, letter junk) goes; neither rule hangs on the number of languages.

Defined results: null, empty and letterless texts have no language (lang_id null, empty arrays, accepted false); rows
without doc_id are kept, with doc_id null; repeated rows repeat; other columns are ignored; texts of any length are read whole. Equal
proportions: the language first in the alphabet. Without any labelled row nothing can be told and no document is accepted. A language with
fewer than `LEAST_HELD` held-out documents has no floor of likelihood.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm._text import NON_WORD, Words, slices
from codequarry.session import ship, write_shared

SAMPLE, SHARE, BITS, GRAM = 300, 0.5, 16, 4
ROUNDS, CLOSE = 8, 1e-3  # rounds between two looks for what has converged, and how little a proportion then moves in a round
MOST_ROUNDS = 400
TAIL, LEAST_HELD = 6.0, 8
#: Languages, log probabilities by n-gram and language, and by language: mean of words' log likelihood, its variance, that of documents' means.
Model = tuple[list[str], np.ndarray, np.ndarray]


def language_words(column: pa.Array) -> Words:
    """Words of letters; what holds a digit is left out."""
    return Words(column, NON_WORD, lower=True).without_digits()


def ngrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the words with a blank at either side, and the word of each."""
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = words.end - words.start + 2
    at = np.cumsum(length) - length
    text = np.full(int(length.sum()) + GRAM - 1, 32, np.uint32)
    owner = np.repeat(np.arange(len(length)), length)
    inner = np.arange(len(owner)) - at[owner]
    letters = (inner > 0) & (inner < length[owner] - 1)
    text[: len(owner)][letters] = words.data[words.start[owner[letters]] + inner[letters] - 1]
    code = np.zeros(len(owner), np.uint32)
    for j in range(GRAM):
        code = (code << np.uint32(8)) | text[j : j + len(owner)]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    use = inner < np.maximum(length[owner] - GRAM + 1, 1)
    return code[use].astype(np.int64), owner[use]


def _count(languages: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << BITS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words = language_words(part.column("text"))
                gram, word = ngrams(words)
                place = np.array([languages.index(x) for x in part.column("lang").to_pylist()], np.int64)
                total += np.bincount(place[words.doc[word]] * (1 << BITS) + gram, minlength=total.size).reshape(total.shape)
        lang, gram = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(gram), pa.array(total[lang, gram])], ["lang", "gram", "n"])

    return count


def _likely(languages: list[str], table: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of held-out documents: mean and variance of the words' log likelihood under the document's own language."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = language_words(part.column("text"))
                gram, word = ngrams(words)
                place = np.array([languages.index(x) for x in part.column("lang").to_pylist()], np.int64)
                some = np.flatnonzero(words.count)
                value = np.bincount(word, table[gram, place[words.doc[word]]], len(words.doc)) / np.bincount(word, minlength=len(words.doc)) if len(word) else np.zeros(0)
                mean = _by_doc(value, words.bounds, some) / np.maximum(words.count, 1)
                square = _by_doc(value**2, words.bounds, some) / np.maximum(words.count, 1)
                yield pa.RecordBatch.from_arrays([pa.array(place[some]), pa.array(mean[some]), pa.array((square - mean**2)[some]), pa.array(1 / different(words)[some])], ["lang", "mean", "variance", "part"])

    return measure


def different(words: Words) -> np.ndarray:
    """How many words of each text count as independent: (sum of counts)^2 / sum of squared counts; 0 without words."""
    key = np.sort((words.doc.astype(np.uint64) << np.uint64(48)) | (words.hash >> np.uint64(16)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    squares = np.bincount((key[first] >> np.uint64(48)).astype(np.int64), np.diff(np.append(first, len(key))).astype(float) ** 2, words.rows)
    return np.divide(words.count.astype(float) ** 2, squares, out=np.zeros(words.rows), where=squares > 0)


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """From `sample` labelled documents a language, chosen by hash; every fourth of them is held out for the floors of likelihood.

    One job ranks the labelled rows of all languages (each task keeps the first `sample` of a language, so that a hot one is no load), and
    one reads the chosen texts; what is broadcast for that are `sample` ids a language.
    """
    ship(documents.sparkSession)
    labelled = documents.filter("doc_id is not null and lang is not null and lang <> ''").select(F.col("doc_id").cast("long").alias("_id"), F.col("lang").alias("_lang"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id"))
    ranked = labelled.withColumn("_rank", place).filter(F.col("_rank") <= sample).collect()
    languages = sorted({r["_lang"] for r in ranked})
    if not languages:
        return languages, np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 3))
    chosen = documents.sparkSession.createDataFrame(sorted({(r["_id"], r["_lang"], r["_rank"] % 4 == 0) for r in ranked}), "_id long, _lang string, held boolean")
    wanted = documents.filter("text is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("lang").alias("_lang"), "text")
    texts = wanted.join(F.broadcast(chosen.groupBy("_id", "_lang").agg(F.max("held").alias("held"))), ["_id", "_lang"]).select("text", F.col("_lang").alias("lang"), "held")
    texts = write_shared(texts, "labelled_texts")
    counts = texts.filter("not held").select("text", "lang").mapInArrow(_count(languages), "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((1 << BITS, len(languages)))
    table[counts["gram"].to_numpy(np.int64), counts["lang"].to_numpy(np.int64)] = counts["n"]
    table += 0.1
    table = np.log(table / table.sum(0)).astype(np.float32)
    seen = texts.filter("held").select("text", "lang").mapInArrow(_likely(languages, table), "lang long, mean double, variance double, part double")
    seen = seen.groupBy("lang").agg(F.count("*").alias("n"), F.avg("mean").alias("mean"), F.avg("variance").alias("words"), F.var_pop("mean").alias("all"), F.avg(F.col("variance") * F.col("part")).alias("own")).collect()
    floors = np.tile([-np.inf, 0.0, 0.0], (len(languages), 1))
    for r in seen:
        if r["n"] >= LEAST_HELD:
            floors[r["lang"]] = r["mean"], r["words"], max(r["all"] - r["own"], (0.05 * r["mean"]) ** 2)
    return languages, table, floors


def _by_doc(values: np.ndarray, bounds: np.ndarray, some: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype)
    if len(some):
        out[some] = np.add.reduceat(values, bounds[:-1][some], 0)
    return out


def mixtures(words: Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each language in each text (rows of zeros where there are no words), and mean over its words of the log likelihood an n-gram."""
    n_lang, rows = table.shape[1], words.rows
    pi = np.zeros((rows, n_lang), np.float32)
    score = np.zeros(rows)
    gram, word = ngrams(words)
    if not len(word) or not n_lang:
        return pi, score
    first = np.flatnonzero(np.diff(word, prepend=-1))
    columns = np.ascontiguousarray(table.T)
    like = np.stack([np.add.reduceat(columns[k][gram], first) for k in range(n_lang)])  # a row a language: long rows are what numpy is fast at
    top = like.max(0)
    like = np.exp(like - top)
    some = np.flatnonzero(words.count)

    def em(active: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log likelihood (without the words' tops) of these documents; those that have converged wait for the others."""
        p = (active / active.sum(1, keepdims=True)).T.astype(np.float32)
        value = np.zeros(len(docs))
        open_ = np.arange(len(docs))
        for done in range(0, MOST_ROUNDS, ROUNDS):
            count = words.count[docs[open_]]
            begin = np.cumsum(count) - count
            mine = like if len(open_) == len(some) else like[:, np.repeat(words.bounds[:-1][docs[open_]] - begin, count) + np.arange(count.sum())]
            q = p[:, open_]
            for _ in range(ROUNDS):
                joint = [mine[k] * np.repeat(q[k], count) for k in range(n_lang)]
                total = np.maximum(sum(joint), np.float32(1e-30))
                last, q = q, (np.stack([np.add.reduceat(j / total, begin) for j in joint]) / count).astype(np.float32)
            p[:, open_] = q
            moving = np.abs(q - last).max(0) > CLOSE
            still = np.flatnonzero(~moving if done + ROUNDS < MOST_ROUNDS else np.ones(len(open_), bool))
            if len(still):
                total = np.maximum(sum(mine[k] * np.repeat(q[k], count) for k in range(n_lang)), np.float32(1e-30))
                value[open_[still]] = np.add.reduceat(np.log(total), begin)[still]
            open_ = open_[moving]
            if not len(open_):
                break
        return p.T, value

    active = np.ones((len(some), n_lang), np.float32)
    p, fitted = em(active, some)
    open_ = np.arange(len(some))
    for _ in range(n_lang - 1):
        least = np.where(active[open_] > 0, p[open_], np.inf).argmin(1)
        fewer = active[open_].copy()
        fewer[np.arange(len(open_)), least] = 0
        q, likelihood = em(fewer, some[open_])
        better = likelihood + 0.5 * np.log(words.count[some[open_]]) >= fitted[open_]
        open_, q, likelihood, fewer = open_[better], q[better], likelihood[better], fewer[better]
        if not len(open_):
            break
        active[open_], p[open_], fitted[open_] = fewer, q, likelihood
    pi[some] = p * active
    mixed = sum(like[k] * np.repeat(pi[some, k], words.count[some]) for k in range(n_lang))
    each = (np.log(np.maximum(mixed, np.float32(1e-30))) + top) / np.diff(np.append(first, len(word)))
    score = _by_doc(each, words.bounds, some) / np.maximum(words.count, 1)
    return pi, score


def accepts(words: Words, pi: np.ndarray, score: np.ndarray, floors: np.ndarray, share: float) -> np.ndarray:
    """Which texts have a main language, and are as likely as texts in their languages are."""
    if not pi.shape[1]:
        return np.zeros(words.rows, bool)
    weight = np.where(pi > 0, pi, 0)
    expected, own, among = (np.where(pi > 0, weight * np.where(np.isinf(floors[:, k]), -1e30, floors[:, k]), 0).sum(1) for k in range(3))
    deviation = np.sqrt(own / np.maximum(different(words), 1) + among)
    return (pi.max(1) >= share) & (score >= expected - TAIL * deviation)


def _infer(shared, share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table, floors = shared.value
        for batch in batches:
            for part in slices(batch, "text", 500_000):
                words = language_words(part.column("text"))
                pi, score = mixtures(words, table)
                main = pi.argmax(1) if len(languages) else np.zeros(words.rows, np.int64)
                told = (pi.max(1) if len(languages) else np.zeros(words.rows)) > 0
                row, lang = np.nonzero(pi > 0)
                bounds = pa.array(np.searchsorted(row, np.arange(words.rows + 1)).astype(np.int32))
                names = pa.array(languages, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        names.take(pa.array(np.where(told, main, 0), mask=~told)),
                        pa.ListArray.from_arrays(bounds, names.take(pa.array(lang))),
                        pa.ListArray.from_arrays(bounds, pa.array(pi[row, lang].astype(np.float64).round(4))),
                        pa.array(score),
                        pa.array(told & accepts(words, pi, score, floors, share)),
                    ],
                    ["doc_id", "lang_id", "languages", "proportions", "log_likelihood", "accepted"],
                )

    return infer


def identify(documents: DataFrame, sample: int = SAMPLE, share: float = SHARE, model: Model | None = None) -> DataFrame:
    """(doc_id, lang_id, languages, proportions, log_likelihood an n-gram, accepted), a row for each row of the input."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or fit(documents, sample))
    schema = "doc_id long, lang_id string, languages array<string>, proportions array<double>, log_likelihood double, accepted boolean"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_infer(shared, share), schema)


def _filter(shared, share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table, floors = shared.value
        for batch in batches:
            for part in slices(batch, "text", 500_000):
                words = language_words(part.column("text"))
                yield part.filter(pa.array(accepts(words, *mixtures(words, table), floors, share)))

    return keep


def keep_accepted(documents: DataFrame, sample: int = SAMPLE, share: float = SHARE, model: Model | None = None) -> DataFrame:
    """The rows that identify() accepts, with all their columns, in one pass over the texts."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or fit(documents, sample))
    return documents.mapInArrow(_filter(shared, share), documents.schema)
