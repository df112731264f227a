"""Each operator against a brute-force version, and its edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from codequarry.llm import bagminhash, chat_format, decontaminate, language_id, media, packing, pii, quality, suffix_dedup, url_filter
from codequarry.llm._text import NON_WORD, Words
from pyspark.sql import functions as F

SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti to it st".split(), "de": "ein ich sch ung keit der ver ge zu pf tz lich und che".split(), "xx": "qa wö kli zzu vyx gnu jib".split()}


def sentence(rng, n, lang="en"):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def docs(spark, texts, **more):
    """Documents with columns that clash with the operators' own."""
    rows = [(i, t, "en", "s", 0 if t is None else len(t), "x", 1.5, [7]) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leader string, size double, places array<int>")


ODD = {100: None, 101: "", 102: "   \n\t ", 103: "!!! ??", 104: "one", 105: "é" * 50_000, 106: "a b " * 30_000}
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def empty(spark):
    return spark.createDataFrame([], EMPTY)


# 1


def test_words_hash_equal_words_alike():
    w = Words(pa.array(["ab cd", None, "xx ab", "é cd é"]))
    assert w.count.tolist() == [2, 0, 2, 3] and w.hash[0] == w.hash[3] and w.hash[1] == w.hash[5] and w.hash[4] == w.hash[6] and len(set(w.hash.tolist())) == 4


def test_build_is_the_transform_of_the_collection():
    rng = random.Random(3)
    strings = [[rng.randint(1, 3) for _ in range(rng.randint(1, 9))] for _ in range(40)] + [[1, 2, 1, 2, 1, 2]] * 3
    text = np.array([x for s in strings for x in s], np.uint32)
    sizes = np.array([len(s) for s in strings])
    before, prefix, owner, offset = suffix_dedup.build(text, np.cumsum(sizes) - sizes, sizes)
    suffixes = sorted((tuple(s[i:]) + ((0, k),) if False else tuple((x, 0) for x in s[i:]) + ((0, k),), k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
    assert [(k, i) for _, k, i in suffixes] == list(zip(owner.tolist(), offset.tolist(), strict=True))
    assert [strings[k][i - 1] if i else 0 for _, k, i in suffixes] == before.tolist()
    common = lambda a, b: len(list(itertools.takewhile(lambda p: p[0] == p[1] and p[0][0] > 0, zip(a, b, strict=False))))
    assert [0, *(common(a[0], b[0]) for a, b in itertools.pairwise(suffixes))] == prefix.tolist()


def brute_repeats(texts, length):
    where = defaultdict(set)
    words = {d: t.split() for d, t in texts.items() if t}
    for d, w in words.items():
        for i in range(len(w) - length + 1):
            where[tuple(w[i : i + length])].add((d, i))
    hit = {x for s in where.values() if len({d for d, _ in s}) > 1 for x in s}
    out = set()
    for d in words:
        cover = sorted(i for x, i in hit if x == d)
        while cover:
            end, start = cover[0] + length, cover[0]
            while cover and cover[0] <= end:
                end = cover.pop(0) + length
            out.add((d, start, end))
    return out


def test_repeated_passages_of_over_255_words(spark):
    rng = random.Random(255)
    shared = sentence(rng, 310)
    texts = {i: sentence(rng, 20 * i) + " " + shared + " " + sentence(rng, 15) for i in range(1, 4)} | {9: sentence(rng, 400), 10: " ".join(shared.split()[:290])}
    got = {tuple(r) for r in suffix_dedup.repeated_passages(docs(spark, texts), 300).collect()}
    assert got == {tuple(x) for x in brute_repeats(texts, 300)} and {d for d, _, _ in got} == {1, 2, 3}


@pytest.mark.parametrize("length", [12, 50])
def test_repeated_passages(spark, length):
    rng = random.Random(length)
    shared = [sentence(rng, length + k) for k in (0, 0, 1, 7, 30, 200)]
    texts = {i: " ".join(sentence(rng, rng.randint(0, 90)) + " " + rng.choice(shared) * rng.randint(0, 1) for _ in range(4)) for i in range(40)}
    texts |= {50: texts[3], 51: texts[3], 52: sentence(rng, 300), 53: " ".join([sentence(rng, 20)] * 9)} | ODD
    df = docs(spark, texts)
    got = {tuple(r) for r in suffix_dedup.repeated_passages(df.union(df.filter("doc_id < 5")), length).collect()}
    assert got == brute_repeats(texts, length) and any(d == 50 for d, _, _ in got) and not any(d in (52, 53) for d, _, _ in got)
    assert suffix_dedup.repeated_passages(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [1, 3])
def test_repeated_passages_of_hot_anchors(spark, hot):
    """Formulas shared by many documents, shorter and longer than a passage, with all anchors taken as hot."""
    rng = random.Random(61)
    formulas = [sentence(rng, n) for n in (25, 38, 49, 52, 80)]
    twins = [f"{sentence(rng, 15)} {formulas[1]} {sentence(rng, 15)}", f"{formulas[2]} {sentence(rng, 4)}"]
    texts = {i: f"{sentence(rng, rng.randint(0, 60))} {formulas[i % 5]} {sentence(rng, rng.randint(0, 60))}" for i in range(60)}
    texts |= {70 + i: f"{sentence(rng, 30)} {twins[i % 2]} {sentence(rng, 30)}" for i in range(5)} | ODD
    df = docs(spark, texts)
    null = df.selectExpr("cast(null as long)", *df.columns[1:])
    got = {tuple(r) for r in suffix_dedup.repeated_passages(df.union(null), 50, hot=hot).collect()}
    assert got == brute_repeats(texts, 50) and {d for d, _, _ in got} >= {70, 71, 3, 4}


def test_repeated_passages_through_files(spark):
    rng = random.Random(62)
    shared = sentence(rng, 60)
    texts = {i: f"{sentence(rng, 20)} {shared} {sentence(rng, 9)}" for i in range(4)}
    got = {tuple(r) for r in suffix_dedup.repeated_passages(docs(spark, texts), external=True).collect()}
    assert got == brute_repeats(texts, 50) and len(got) == 4


# 2


def brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_distance():
    rng = random.Random(1)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (90, 120))
        assert decontaminate.distance_within(decontaminate.alphabet(p), len(p), t, 1000) == min(brute_distance(p, t), len(p))


def damage(rng, text, edits):
    for _ in range(edits):
        i, kind = rng.randrange(1, len(text) - 1), rng.randrange(3)
        text = text[:i] + ("" if kind == 0 else rng.choice("aeiou")) + text[i + (kind < 2) :]
    return text


def test_contaminated(spark):
    rng = random.Random(2)
    items = {i: sentence(rng, rng.randint(15, 50)).capitalize() + "." for i in range(12)} | {90: None, 91: "", 92: " .. "}
    texts = {}
    for d in range(60):
        i = rng.randrange(12)
        edits = rng.randint(0, int(0.12 * len(items[i])))
        texts[d] = f"{sentence(rng, 30)} {damage(rng, items[i], edits)}  {sentence(rng, 20)}".replace(" ", "\n " if d % 5 == 0 else " ")
    texts |= {70: sentence(rng, 400)} | ODD
    bench = spark.createDataFrame([(k, v, "clash") for k, v in items.items()], "item_id long, text string, doc_id string")
    df = docs(spark, texts)
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(df.union(df), bench).collect()}
    want = {}
    for d, t in texts.items():
        for i, item in items.items():
            p = decontaminate.normal(item or "")
            if t and any(c.isalnum() for c in p) and len(t) < 5000:
                x = brute_distance(p, decontaminate.normal(t))
                if x <= int(decontaminate.ERROR_RATE * len(p)):
                    want[d, i] = x
    assert got == want and len(want) > 20
    parts = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(df, bench, part_chars=500).collect()}
    assert parts == want
    assert decontaminate.contaminated(empty(spark), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


# 3


def test_languages_held_out(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, 120, lang), lang) for i, lang in enumerate(["en", "de", "xx"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.filter("doc_id < 60"))
    half = [(500 + k, sentence(rng, 100, "en") + " " + sentence(rng, 60, "de"), "en") for k in range(10)]
    odd = [(i + 900, t, None) for i, t in ODD.items()] + [(None, sentence(rng, 50, "de"), "de")]
    test = spark.createDataFrame([r for r in rows if r[0] >= 60] + half + odd, df.schema).withColumn("accepted", F.lit("clash"))
    got = {r.doc_id: r for r in language_id.identify(test, model=model).collect()}
    assert len(got) == 60 + 10 + len(odd)
    assert np.mean([got[i].lang_id == lang and list(got[i].languages) == [lang] for i, _, lang in rows if i >= 60]) > 0.95
    for i in range(500, 510):
        assert sorted(got[i].languages) == ["de", "en"] and abs(dict(zip(got[i].languages, got[i].proportions, strict=True))["en"] - 100 / 160) < 0.06
    for i in (1000, 1001, 1002, 1003):
        assert got[i].lang_id is None and not got[i].accepted and list(got[i].languages) == []
    kept = {r.doc_id for r in language_id.keep_accepted(test, model=model).collect()}
    assert kept == {i for i, r in got.items() if r.accepted} and None in kept
    assert language_id.identify(empty(spark)).count() == 0
    assert not any(r.accepted for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect())


def test_mixture_is_the_maximum():
    """EM on one text against a search over proportions."""
    rng = np.random.default_rng(0)
    table = np.log(rng.dirichlet(np.ones(1 << language_id.BITS), 2).T + 1e-9).astype(np.float32)
    words = language_id.language_words(pa.array(["abc defg hij klmno pq rs tuvw a1b2 7 xyz " * 3]))
    gram, word = language_id.ngrams(words)
    like = np.array([[table[gram[word == w], k].sum() for k in (0, 1)] for w in range(len(words.start))])
    grid = np.linspace(0, 1, 1001)
    with np.errstate(divide="ignore"):
        value = [np.logaddexp(np.log(p) + like[:, 0], np.log(1 - p) + like[:, 1]).sum() for p in grid]
    penal = np.array([max(value[0], value[-1]), max(value) - 0.5 * np.log(len(like))])
    pi, _ = language_id.mixtures(words, table)
    best = grid[int(np.argmax(value))] if penal[1] > penal[0] else float(value[-1] > value[0])
    assert abs(pi[0, 0] - best) < 0.05


# 4


def test_archives_round_trip(spark, tmp_path):
    rows = [(f"m{i}", bytes([i % 256]) * (i * 37)) for i in range(40)] + [("m1", b"again"), ("null", None), ("ü/ö.bin", b"\x00\xff")]
    df = spark.createDataFrame(rows, "member string, payload binary").repartition(3)
    assert media.write_archives(df, f"file://{tmp_path}/a") == len(rows)
    for size in ("300", "100000000"):
        got = media.read_archives(spark, f"file://{tmp_path}/a", rangeBytes=size)
        assert sorted((r.member, bytes(r.payload), r.error) for r in got.collect()) == sorted((m, p or b"", None) for m, p in rows)
    (tmp_path / "b").mkdir()
    assert media.read_archives(spark, f"file://{tmp_path}/b").count() == 0


def test_archives_members_fail_alone(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for i in range(5):
            z.writestr(f"m{i}", b"payload %d" % i * 50)
        at = z.getinfo("m2").header_offset
    data = bytearray((tmp_path / "x.zip").read_bytes())
    data[at + 40] ^= 255
    (tmp_path / "x.zip").write_bytes(data)
    (tmp_path / "junk.zip").write_bytes(b"no archive")
    (tmp_path / "empty.zip").write_bytes(b"")
    got = {(r.archive, r.member): r for r in media.read_archives(spark, f"file://{tmp_path}", waitSeconds="0").collect()}
    assert got["x.zip", "m2"].payload is None and "checksum" in got["x.zip", "m2"].error and got["x.zip", "m2"].attempts == 3
    assert all(got["x.zip", f"m{i}"].error is None for i in (0, 1, 3, 4)) and got["junk.zip", ""].error and got["empty.zip", ""].error


def test_retry_reopens(tmp_path):
    reader = media.MediaReader({"path": f"file://{tmp_path}", "waitSeconds": "0"})
    calls = iter([OSError("gone"), ValueError("cut"), b"ok"])

    def read():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert reader.retried(read) == (b"ok", 3, None)


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é"), (2, "u", None), (2, "u", ""), (None, "u", "x")], "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.size, r.error) for r in media.pages_through_archives(pages).collect()))
    assert got == [(0, 1, None), (1, 5, None), (2, 0, None), (2, 0, None)]
    assert media.pages_through_archives(pages.limit(0)).count() == 0


# 5


def test_quality_held_out(spark):
    rng = random.Random(6)
    junk = lambda: " ".join(w.upper() + "!!" if rng.random() < 0.7 else w + "%%%" for w in sentence(rng, rng.randint(20, 80)).split())
    texts = {i: junk() if i % 3 == 0 else sentence(rng, rng.randint(30, 120)).replace(" th", ". th") for i in range(600)}
    df = docs(spark, texts | {i + 1000: t for i, t in ODD.items()})
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(0, 0, 0), (9999, 1, 0), (None, 1, 0), (5, None, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, labels).collect()}
    assert len(got) == len(texts) + len(ODD) and all(0 <= r.probability <= 1 for r in got.values())
    assert np.mean([got[i].keep == (i % 3 > 0) for i in range(300, 600)]) > 0.95
    ordered = sorted(got.values(), key=lambda r: r.score)
    assert all(a.probability <= b.probability + 1e-12 for a, b in itertools.pairwise(ordered))
    one = quality.classify(df, labels.filter("quality = 1")).collect()
    assert all(r.probability is None and r.keep for r in one)
    assert quality.classify(empty(spark), labels).count() == 0


def test_normal_equations_and_kernel():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, len(quality.STATISTICS))), rng.integers(0, 2, 300)
    f = quality.Features(x.mean(0), x.std(0), 5.0, 4000)
    z = f(x)[:, 1:]
    s = (x - x.mean(0)) / x.std(0)
    kernel = np.exp(-((s[:40, None] - s[None, :40]) ** 2).sum(2) / (2 * 25))
    assert np.abs(z[:40] @ z[:40].T - kernel).max() < 0.1
    f = quality.Features(x.mean(0), x.std(0), 5.0, 16)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[a:b].astype(np.float32).tolist(), pa.list_(pa.float32())), pa.array(y[a:b], pa.int32())], ["x", "quality"]) for a, b in ((0, 100), (100, 300))]
    parts = [np.frombuffer(r.column(0)[0].as_buffer()) for b in batches for r in quality.sums(f)(iter([b]))]
    whole = f(x.astype(np.float32).astype(float))
    assert np.allclose(sum(parts).reshape(18, 17), np.vstack([whole.T @ whole, y @ whole]))


def test_isotonic_against_all_partitions():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n, k = rng.integers(1, 5, 7).astype(float), 7
        good = np.array([rng.integers(0, m + 1) for m in n], float)
        best = None
        for cut in itertools.product((0, 1), repeat=k - 1):
            block = np.concatenate([[0], np.cumsum(cut)])
            rate = np.array([good[block == b].sum() / n[block == b].sum() for b in block])
            if (np.diff(rate) >= 0).all():
                loss = (n * (good / n - rate) ** 2).sum()
                best = loss if best is None else min(best, loss)
        rates = quality.isotonic(n, good)
        assert abs((n * (good / n - rates) ** 2).sum() - best) < 1e-9 and (np.diff(rates) >= 0).all()


# 6


def test_viterbi_against_all_segmentations():
    rng = random.Random(9)
    weights = pii.train()
    for _ in range(60):
        n = 6
        spans = [(i, j, rng.randrange(len(pii.TYPES)), [0, 1] if rng.random() < 0.6 else [0]) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1) if rng.random() < 0.5]
        w = weights + np.array([rng.uniform(-4, 4) for _ in pii.TYPES])[:, None] * np.eye(1, len(pii.FEATURES))
        value = lambda chosen: sum(sum(w[t, x] for x in f) for _, _, t, f in chosen)
        best = max((value(c) for r in range(n + 1) for c in itertools.combinations(spans, r) if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(c, 2))), default=0)
        got = pii.viterbi(n, spans, w)
        mine = sum(max(sum(w[t, x] for x in f) for i, j, t, f in spans if (i, j, t) == g) for g in got)
        assert abs(mine - max(best, 0)) < 1e-9


def test_entities_held_out():
    rng, weights = random.Random(77), pii.train()
    hit = wrong = missed = 0
    for _ in range(200):
        text, gold = pii._made(rng)
        found = {(a, b, k) for k, a, b in pii.find(text, weights)}
        hit, wrong, missed = hit + len(found & set(gold)), wrong + len(found - set(gold)), missed + len(set(gold) - found)
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


def test_entities_and_redaction(spark):
    texts = {1: "write to ann.b@mail.example.com, or +1 (212) 555-0147.", 2: 'token = "' + "0af3" * 10 + '" from 10.20.30.40###', 3: "in 2024 we had 3.14 and 1,200 of v1.2.3", 4: "card 4539578763621486\nnext"} | ODD
    df = docs(spark, texts)
    got = {r.doc_id: {(e.type, texts[r.doc_id][e.start : e.end]) for e in r.entities} for r in pii.personal_data(df).collect()}
    assert got == {1: {("email", "ann.b@mail.example.com"), ("phone", "+1 (212) 555-0147")}, 2: {("secret", "0af3" * 10), ("ip", "10.20.30.40")}, 4: {("card", "4539578763621486")}}
    clean = pii.redact(df)
    assert clean.columns == df.columns
    out = {r.doc_id: r.text for r in clean.collect()}
    assert out[1] == "write to <email>, or <phone>." and out[4] == "card <card>\nnext" and out[100] is None and out[3] == texts[3]
    assert pii.personal_data(empty(spark)).count() == 0 and pii.redact(empty(spark)).count() == 0


# 7


def test_urls(spark):
    import re

    urls = ["http://www.cheap-pills.example.com/a", "https://spam.example.org", "https://spamming.example.org", "http://freebet.com/free", "http://a.com/free/bets?x=win", "http://a.com/FREE-free", "", None, "casino", "http://x.com/pills_cheap", "a" * 100_000 + "/porn"]
    pages = spark.createDataFrame([(i, u, "h", True) for i, u in enumerate(urls)] + [(None, "xxx", "h", True), (0, urls[0], "h", True)], "page_id long, url string, html string, rejected boolean")
    got = [(r.url, r.strict_hits, r.soft_hits, r.rejected) for r in url_filter.judge_urls(pages).collect()]
    has = lambda term, u: re.search(f"(?:^|[^a-z0-9]){re.escape(term)}(?:$|[^a-z0-9])", (u or "").lower()) is not None
    want = []
    for u in [*urls, "xxx", urls[0]]:
        a, b = sum(has(t, u) for t in url_filter.STRICT), sum(has(t, u) for t in url_filter.SOFT)
        want.append((u, a, b, a > 0 or b > 1))
    assert Counter(got) == Counter(want) and url_filter.judge_urls(pages.limit(0)).count() == 0


# 8


def test_signatures_are_unbiased():
    rng = random.Random(8)
    vocabulary = [sentence(rng, 1) + str(i) for i in range(300)]
    base = [rng.choice(vocabulary[: 40 if k % 2 else 300]) for k in range(400)]
    texts = [" ".join(base)] + [" ".join(w if rng.random() > p else rng.choice(vocabulary) for w in base) for p in (0.05, 0.2, 0.4, 0.7)] + [" ".join(base[:150]), " ".join(base * 3)]
    row, gram, count = bagminhash.multisets(Words(pa.array(texts), NON_WORD, lower=True))
    m = 4096
    sig = bagminhash.signatures(row, gram, count, len(texts), m)
    sets = [(gram[row == i], count[row == i]) for i in range(len(texts))]
    assert max(count) > 2
    for a, b in itertools.combinations(range(len(texts)), 2):
        j = bagminhash.overlap(sets[a], sets[b])
        assert abs((sig[a] == sig[b]).mean() - j) < 4.5 * np.sqrt(j * (1 - j) / m) + 2e-3


def test_near_duplicates(spark):
    rng = random.Random(10)
    texts, planted = {}, []
    for g in range(30):
        base = sentence(rng, rng.randint(40, 200)).split()
        for k in range(rng.choice([1, 1, 2, 5])):
            words = [w if rng.random() > 0.03 else sentence(rng, 1) for w in base] if k else base
            texts[rng.randrange(10**6) + 1000] = " ".join(words)
    texts |= {5: "Same text, here.", 6: "same TEXT here", 7: "other words there"} | ODD
    df = docs(spark, texts)
    out = bagminhash.near_duplicates(df.union(df.filter("doc_id = 5")))
    got = {r.doc_id: r.group_id for r in out.collect()}
    row, gram, count = bagminhash.multisets(Words(pa.array(list(texts.values())), NON_WORD, lower=True))
    ids, sets = list(texts), [(gram[row == i], count[row == i]) for i in range(len(texts))]
    for a, b in itertools.combinations(range(len(ids)), 2):
        if len(sets[a][0]) and bagminhash.overlap(sets[a], sets[b]) >= bagminhash.THRESHOLD:
            planted.append((ids[a], ids[b]))
    together = [got.get(a) is not None and got.get(a) == got.get(b) for a, b in planted]
    assert len(planted) > 20 and np.mean(together) >= 0.95
    assert set(got) <= {x for p in planted for x in p} and not set(got) & {100, 101, 102, 103}
    assert got[5] == got[6] == 5 and all(g <= d for d, g in got.items())
    groups = defaultdict(list)
    for r in out.collect():
        groups[r.group_id].append(r.keep)
    assert all(sum(k) == 1 for k in groups.values())
    assert bagminhash.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_large_uneven_families(spark):
    rng = random.Random(12)
    vocabulary = [sentence(rng, 1) + str(i) for i in range(2000)]
    base, texts = rng.sample(vocabulary, 90), {}
    for k in range(1100):
        p = 0 if k == 600 else rng.choice([0.06, 0.08, 0.1])
        texts[k] = " ".join(w if rng.random() > p else rng.choice(vocabulary) for w in base)
    ids, column = list(texts), pa.array(list(texts.values()))
    row, gram, count = bagminhash.multisets(Words(column, NON_WORD, lower=True))
    grams, place = np.unique(gram, return_inverse=True)
    weight = np.zeros((len(ids), len(grams)), np.uint8)
    weight[row, place] = count
    (signed,) = bagminhash._sign(iter([pa.RecordBatch.from_arrays([pa.array(ids), column], ["doc_id", "text"])]))
    bands = np.array(signed.column("bands").to_pylist())
    near, group = 0, np.arange(len(ids))
    for i in range(len(ids)):
        both = np.minimum(weight[i], weight[:i]).sum(1, dtype=np.int64)
        close = np.flatnonzero((both / (weight[i].sum(dtype=np.int64) + weight[:i].sum(1, dtype=np.int64) - both) >= bagminhash.THRESHOLD) & (bands[:i] == bands[i]).any(1))
        near += len(close)
        for g in set(group[close]) - {group[i]}:
            low, high = sorted((g, group[i]))
            group[group == high] = low
    want = {ids[i]: min(ids[j] for j in np.flatnonzero(group == group[i])) for i in range(len(ids)) if (group == group[i]).sum() > 1}
    assert near > 1000 and len(want) > 700
    got = {r.doc_id: r.group_id for r in bagminhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == want


def test_components(spark):
    rng = random.Random(11)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    label = {}
    for a, b in pairs:
        if a != b:
            x, y = label.get(a, a), label.get(b, b)
            for n in {*label, a, b}:
                if label.get(n, n) in (x, y):
                    label[n] = min(x, y)
    got = {r.node: r.label for r in bagminhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == label


# 9


def check_packing(rows, counts, capacity):
    room, words = defaultdict(list), defaultdict(list)
    for r in rows:
        room[r.sequence].append((r.offset, r.offset + r.n_words))
        words[r.doc_id].append((r.start_word, r.start_word + r.n_words))
    for spans in [*room.values(), *words.values()]:
        spans.sort()
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans))
    assert all(s[-1][1] <= capacity and s[0][0] == 0 for s in room.values())
    assert {d: sum(b - a for a, b in s) for d, s in words.items()} == {d: n for d, n in counts.items() if n}
    return len(room)


@pytest.mark.parametrize("capacity", [50, 512])
def test_packing(spark, capacity):
    rng = random.Random(12)
    texts = {i: "w " * min(int(rng.expovariate(1 / 60)), 2000) for i in range(800)} | {1000 + i: "x " * 25 for i in range(100)} | ODD
    rows = packing.pack(docs(spark, texts), capacity).collect()
    counts = {i: len((t or "").split()) for i, t in texts.items()}
    used = check_packing(rows, counts, capacity)
    pieces = [min(capacity, n - a) for n in counts.values() for a in range(0, n, capacity)]
    assert used <= packing.best_fit_decreasing(pieces, capacity) * 1.03 + 1
    assert packing.pack(empty(spark), capacity).count() == 0


def test_packing_repeated_rows(spark):
    df = docs(spark, {1: "a b c", 2: "d e"})
    rows = packing.pack(df.union(df).union(df.withColumn("doc_id", F.lit(None).cast("long"))), 10).collect()
    assert len(rows) == 6 and sum(r.n_words for r in rows) == 15
    room = defaultdict(int)
    for r in rows:
        room[r.sequence] += r.n_words
    assert max(room.values()) <= 10 and len(room) == 2


def rounds_by_definition(pieces, capacity):
    """{piece: (sequence, offset)}: in each round, over all pieces and gaps by size, a gap takes the last piece that waits."""
    waiting, opened = sorted(pieces, key=lambda p: (p[0], p[1])), -(-sum(s for s, _ in pieces) // capacity)
    gaps, out = [(capacity, q) for q in range(opened)], {}
    while waiting:
        gaps = [g for g in gaps if g[0] >= waiting[0][0]]
        if not gaps:
            more = -(-sum(s for s, _ in waiting) // capacity)
            gaps, opened = [(capacity, opened + i) for i in range(more)], opened + more
        line = sorted([(s, 0, key) for s, key in waiting] + [(f, 1, (q,)) for f, q in gaps])
        stack, waiting, gaps = [], [], []
        for value, kind, key in line:
            if kind == 0:
                stack.append((value, key))
            elif stack:
                size, piece = stack.pop()
                out[piece] = key[0], capacity - value
                gaps.append((value - size, key[0]))
            else:
                gaps.append((value, key[0]))
        waiting = stack
    return out


@pytest.mark.parametrize("task_rows", [10**6, 40])
def test_packing_against_rounds_by_definition(spark, task_rows):
    rng = random.Random(30)
    for sizes in ([rng.randint(1, 60) for _ in range(300)], [20] * 90, [30] * 31 + [1] * 200, [rng.choice([7, 13, 50, 120]) for _ in range(150)]):
        want = rounds_by_definition([(min(50, n - a), (d, a // 50)) for d, n in enumerate(sizes) for a in range(0, n, 50)], 50)
        rows = packing.pack(docs(spark, ["w " * n for n in sizes]), 50, task_rows=task_rows, range_rows=30).collect()
        assert {(r.doc_id, r.piece): (r.sequence, r.offset) for r in rows} == want


def test_brackets_and_their_joints():
    rng = random.Random(8)
    for _ in range(200):
        kind = np.array([rng.randint(0, 1) for _ in range(rng.randint(0, 40))], int)
        stack, want = [], {}
        for i, k in enumerate(kind.tolist()):
            if k == packing.PIECE:
                stack.append(i)
            elif stack:
                want[stack.pop()] = i
        piece, gap, _, _ = packing.brackets(kind)
        assert dict(zip(piece.tolist(), gap.tolist(), strict=True)) == want
        cuts = sorted(rng.choices(range(len(kind) + 1), k=3))
        counts, places, found = [], {}, {}
        for part, (a, b) in enumerate(itertools.pairwise([0, *cuts, len(kind)])):
            p, g, gaps, pieces = packing.brackets(kind[a:b])
            found |= dict(zip((p + a).tolist(), (g + a).tolist(), strict=True))
            counts.append((part, len(gaps), len(pieces)))
            places[part] = (gaps + a).tolist(), (pieces + a).tolist()
        for _, k, p, last, g, first in packing.joined(counts):
            found |= {places[p][1][last - i]: places[g][0][first + i] for i in range(k)}
        assert found == want


def test_sequences_hold_their_texts(spark):
    texts = {1: "a  b\nc", 2: "d " * 25, 3: "e", 4: "  f\t g "} | ODD
    df = docs(spark, texts).withColumn("sequence", F.lit("clash"))
    rows = packing.sequences(df.union(df), 10).collect()
    made = Counter()
    for r in rows:
        words = r.text.split()
        assert len(words) == r.n_words <= 10 and list(r.doc_ids) == [p.doc_id for p in r.pieces]
        for p in r.pieces:
            own = texts[p.doc_id].split()[p.start_word : p.start_word + p.n_words]
            assert words[p.offset : p.offset + p.n_words] == own
            made[p.doc_id] += p.n_words
    assert made == {d: 2 * len(t.split()) for d, t in texts.items() if t and t.split()}
    assert packing.sequences(empty(spark), 10).count() == 0


# 10


def brute_repair(roles):
    """Least cost over all ways, by search over (turn, state)."""
    import heapq

    heap, done = [(0, 0, "start")], set()
    while heap:
        cost, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(roles) and state == "assistant":
            return cost
        for r in chat_format.NEXT[state]:
            heapq.heappush(heap, (cost + chat_format.INSERT, i, r))
        if i < len(roles):
            own = chat_format.ALIAS.get(roles[i])
            change = chat_format.RELABEL if own else chat_format.RELABEL_UNKNOWN
            for r in chat_format.NEXT[state]:
                heapq.heappush(heap, (cost + (0 if r == own else change), i + 1, r))
            if state != "start":
                heapq.heappush(heap, (cost + chat_format.MERGE + (0 if state == own else change), i + 1, state))
    return None


def legal(roles):
    state = "start"
    for r in roles:
        if r not in chat_format.NEXT[state]:
            return False
        state = r
    return state == "assistant"


def test_repair_against_search():
    for n in range(1, 6):
        for roles in itertools.product(("system", "user", "assistant", "tool"), repeat=n):
            cost, steps = chat_format.repair(list(roles))
            assert cost == brute_repair(roles) and [t for _, _, t in steps if t is not None] == list(range(n))
            assert legal(chat_format.render(steps, ["x"] * n)[0])


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "Human", "a"), (2, 1, "user", "b"), (2, 2, "gpt", None), (3, 0, None, "?"), (None, 0, "user", "lost"), (1, 1, "assistant", "yo"), (4, None, "user", ""), (4, 0, "assistant", "z" * 100_000)]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "conv_id long, turn long, role string, text string, turns string, cost int")
    got = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1].cost == 0 and got[1].text == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>\n"
    assert got[2].cost == 1 and list(got[2].edits) == ["merge user 1"] and got[2].text.startswith("<|user|>\na\nb\n<|end|>\n")
    assert got[3].cost == 4 and got[4].cost == 0 and len(got[4].text) > 100_000
    assert chat_format.format_chats(df.limit(0)).count() == 0
