"""Planted and odd cases of decontamination, language identification and personal data, against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from codequarry.llm import bagminhash, decontaminate, language_id, pii, quality
from codequarry.llm._text import ROWS, Words, slices
from test_operators import ODD, brute_distance, damage, docs, sentence

# 2


def test_case_and_white_space_are_folded_alike(spark):
    item = "\u039f\u0394\u03a5\u03a3\u03a3\u0395\u03a5\u03a3 \u0130STANBUL STRASSE \u00df \u01c5 " * 3
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None)], "item_id long, text string")
    df = docs(spark, {5: f"before {item} after", 6: "nothing of it"}).union(docs(spark, {7: item}).selectExpr("cast(null as long)", *docs(spark, {}).columns[1:]))
    got = decontaminate.contaminated(df, bench).collect()
    assert [(r.doc_id, r.item_id, r.distance) for r in got] == [(5, 1, 0)]


def test_items_that_share_a_sentence():
    rng = random.Random(12)
    shared = sentence(rng, 12)
    items = [(i, decontaminate.normal(f"{shared} {sentence(rng, 14)}")) for i in range(25)]
    auto, masks = decontaminate.automaton(items, 0.08), [decontaminate.alphabet(t) for _, t in items]
    text = decontaminate.normal(f"{sentence(rng, 10)} {damage(rng, items[3][1], 5)} {shared} {sentence(rng, 10)} {damage(rng, items[9][1], 30)}")
    want = {at: d for at, (_, t) in enumerate(items) if (d := brute_distance(t, text)) <= int(0.08 * len(t))}
    assert decontaminate.leaks(text, auto, items, masks, 0.08) == want and 3 in want


# 3


def _world(seed=1, n_lang=3):
    rng = np.random.default_rng(seed)
    table = np.log(rng.dirichlet(np.full(1 << language_id.BITS, 0.3), n_lang).T + 1e-9).astype(np.float32)
    words = language_id.language_words(pa.array(["abc defg hij klmno pq rs tuvw xyz bcd", "one", "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam", "abc defg hij klmno lorem ipsum dolor"]))
    return table, words


def test_set_of_languages_against_all_subsets():
    """BIC of what elimination ends with, against the best of all sets with long EM."""
    for seed in range(6):
        table, words = _world(seed)
        gram, word = language_id.ngrams(words)
        like = np.array([[table[gram[word == w], k].sum() for k in range(3)] for w in range(len(words.start))], np.float64)
        pi, _ = language_id.mixtures(words, table)
        for d in range(words.rows):
            mine = like[words.doc == d]

            def value(subset, mine=mine):
                own, p = mine[:, subset], np.full(len(subset), 1 / len(subset))
                for _ in range(3000):
                    joint = np.log(p + 1e-300) + own
                    p = np.exp(joint - np.logaddexp.reduce(joint, 1)[:, None]).mean(0)
                return np.logaddexp.reduce(np.log(p + 1e-300) + own, 1).sum() - 0.5 * np.log(len(own)) * (len(subset) - 1)

            best = max(value(list(s)) for r in (1, 2, 3) for s in itertools.combinations(range(3), r))
            assert value(list(np.flatnonzero(pi[d] > 0))) > best - 0.75  # elimination is greedy
            assert abs(pi[d].sum() - 1) < 1e-3


def test_what_is_in_no_language_goes(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, 120, lang), lang) for i, lang in enumerate(["en", "de"] * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert language_id.fit(df.union(df))[0] == model[0] and np.isfinite(model[2]).all()
    new = [(1000 + i, sentence(rng, 80, "en" if i % 2 else "de")) for i in range(40)]
    long = [(1100 + i, " ".join(x for x in sentence(rng, 400, "en").split() if len(x) > 4)) for i in range(10)]
    foreign = [(2000 + i, sentence(rng, 80, "xx")) for i in range(20)]
    junk = [(3000 + i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(60))) for i in range(20)]
    both = [(4000, sentence(rng, 80, "en") + " " + sentence(rng, 70, "de"))]
    test = spark.createDataFrame(new + long + foreign + junk + both + both, "doc_id long, text string")
    got = {r.doc_id: r.accepted for r in language_id.identify(test, model=model).collect()}
    assert all(got[i] for i, _ in new + long + both)
    assert not any(got[i] for i, _ in foreign + junk)
    assert sorted(r.doc_id for r in language_id.keep_accepted(test, model=model).collect()) == sorted(i for i, _ in new + long + both + both)


def test_scattered_over_languages_goes():
    table, words = _world()
    pi = np.array([[0.4, 0.3, 0.3], [0.5, 0.5, 0], [1, 0, 0], [0, 0, 0]])
    floors = np.array([[-7.0, 1.0, 0.1], [-np.inf, 0, 0], [-7.0, 1.0, 0.1]])
    assert language_id.accepts(words, pi, np.array([-7.0, -7.0, -7.0, 0]), floors, 0.5).tolist() == [False, True, True, False]
    assert language_id.accepts(words, pi, np.array([-7.0, -99.0, -20.0, 0]), floors, 0.5).tolist() == [False, True, False, False]  # no floor, no rejection by it


def test_equal_proportions_and_convergence():
    table, words = _world(3, 2)
    same = np.concatenate([table[:, :1], table[:, :1]], 1)
    pi, _ = language_id.mixtures(words, same)
    assert (pi.argmax(1) == 1).all() or (pi.max(1) > 0).all()
    slow = language_id.mixtures(words, table)[0]
    rounds = language_id.ROUNDS
    try:
        language_id.ROUNDS = 200
        assert np.abs(language_id.mixtures(words, table)[0] - slow).max() < 0.02
    finally:
        language_id.ROUNDS = rounds


# 5, 8: numbers of rows


def test_more_rows_than_a_key_holds():
    batch = pa.record_batch([pa.array(["same text again"] * (ROWS + 500))], ["text"])
    parts = list(slices(batch, "text"))
    assert sum(p.num_rows for p in parts) == ROWS + 500 and max(p.num_rows for p in parts) <= ROWS
    assert len({tuple(x) for p in parts for x in quality.statistics(p.column(0)).tolist()}) == 1
    assert all(len(np.unique(bagminhash.multisets(Words(p.column(0)))[1])) == 2 for p in parts)


# 8


def test_template_families_find_their_twins(spark):
    """Documents of one template, alike below the threshold, with planted pairs above it: no pair of a bucket is passed over."""
    rng = random.Random(88)
    frame = sentence(rng, 160).split()
    texts, twins = {}, set()
    for i in range(300):
        own = list(frame)
        for at in rng.sample(range(160), 24):
            own[at] = f"v{rng.randrange(10**6)}"
        texts[2 * i] = " ".join(own)
        if i % 2:
            for at in rng.sample(range(160), 8):
                own[at] = f"w{rng.randrange(10**6)}"
            texts[2 * i + 1] = " ".join(own)
            twins.add((2 * i, 2 * i + 1))
    df = docs(spark, texts)
    null = df.limit(3).selectExpr("cast(null as long)", *df.columns[1:])
    group = {r.doc_id: r.group_id for r in bagminhash.near_duplicates(df.union(null)).collect()}
    multi = {}
    for i, t in texts.items():
        multi[i] = bagminhash.multisets(Words(pa.array([t])))[1:]
    above = {(a, b) for a, b in twins if bagminhash.overlap(multi[a], multi[b]) >= bagminhash.THRESHOLD}
    assert len(above) > 100 and None not in group
    assert np.mean([a in group and group[a] == group.get(b) for a, b in above]) >= 0.97


# 6

BY_HAND = [
    ("Please email Karin at karin.holm@posteo.example.org before Friday.", {"karin.holm@posteo.example.org"}),
    ("Server 192.168.14.7 refused the connection at 09:15 on 2021-04-03.", {"192.168.14.7"}),
    ("My SSN is 078-05-1120 and my old one is void.", {"078-05-1120"}),
    ("Pay to GB82WEST12345698765432 within 30 days.", {"GB82WEST12345698765432"}),
    ("Visa 4012 8888 8888 1881 was declined.", {"4012 8888 8888 1881"}),
    ("Ring +44 207 9460 958 or write.", {"+44 207 9460 958"}),
    ("export API_KEY=sk_9fK2mQ7tLw3xZp8RbV5nYc1D", {"sk_9fK2mQ7tLw3xZp8RbV5nYc1D"}),
    ('password = "correcthorsebatterystaple"', {"correcthorsebatterystaple"}),
    ("passwd: Summer!2019 worked", {"Summer!2019"}),
    ("Mrs. Eleanor Rigby picked up the rice.", {"Eleanor Rigby"}),
    ("Dear Jonas Becker, thank you.", {"Jonas Becker"}),
    ("Name: Priya Natarajan", {"Priya Natarajan"}),
    ("We moved to 742 Evergreen Terrace last spring.", {"742 Evergreen Terrace"}),
    ("Treffpunkt: Lindenstra\u00dfe 44, zweiter Stock", {"Lindenstra\u00dfe 44"}),
    ("Version 3.11.4 fixed 120 bugs in 14 days; see section 2.3.", set()),
    ("Dear Sir or Madam, the token economy grew by 12.5 % in 2020.", set()),
    ("He said the password was long and the secret safe.", set()),
    ("Chapter 12, page 345: The Street of Crocodiles.", set()),
]


def test_entities_of_sentences_written_by_hand():
    weights = pii.train()
    hit = wrong = missed = 0
    for text, gold in BY_HAND:
        found = {text[a:b] for _, a, b in pii.find(text, weights)}
        hit, wrong, missed = hit + len(found & gold), wrong + len(found - gold), missed + len(gold - found)
    assert hit >= 13 and wrong <= 1, (hit, wrong, missed)


def test_stretches_lose_nothing():
    """The stretches' entities against one lattice over the whole text."""
    rng, weights = random.Random(5), pii.train()
    texts = [t for t, _ in BY_HAND] + [pii._made(rng)[0] for _ in range(150)] + [sentence(rng, 200) + " Dear Ada Lovelace, " + sentence(rng, 100)]
    for text in texts + [" ".join(rng.sample(texts, 6)) for _ in range(20)]:
        tokens = pii.tokenize(text, 0, len(text))
        whole = [(pii.TYPES[t], tokens[i][0], tokens[j - 1][1]) for i, j, t in pii.viterbi(len(tokens), pii.lattice(text, tokens), weights)]
        assert pii.find(text, weights) == whole


def test_likelihood_against_all_segmentations_and_differences():
    rng = np.random.default_rng(2)
    spans = [(i, j) for i in range(5) for j in range(i + 1, min(5, i + 3) + 1)]
    x = rng.normal(size=(len(spans), 4))
    w, gold = rng.normal(size=4), [0, 5]
    assert all(spans[a][1] <= spans[b][0] for a, b in itertools.pairwise(gold))
    apart = lambda c: all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations([spans[k] for k in c], 2))
    total = np.logaddexp.reduce([sum((x @ w)[k] for k in c) for r in range(6) for c in itertools.combinations(range(len(spans)), r) if apart(c)])
    value, gradient = pii.likelihood(w, 5, spans, x, gold)
    assert abs(value - ((x @ w)[gold].sum() - total)) < 1e-9
    for k in range(4):
        step = np.eye(4)[k] * 1e-6
        assert abs((pii.likelihood(w + step, 5, spans, x, gold)[0] - pii.likelihood(w - step, 5, spans, x, gold)[0]) / 2e-6 - gradient[k]) < 1e-5


def test_ties_take_fewer_tokens():
    weights = np.ones((len(pii.TYPES), 1))
    assert pii.viterbi(3, [(0, 3, 0, [0]), (1, 3, 0, [0])], weights) == [(1, 3, 0)]
    assert pii.viterbi(3, [(1, 3, 0, [0]), (0, 3, 0, [0])], weights) == [(1, 3, 0)]
    assert pii.viterbi(4, [(0, 4, 1, [0, 0]), (0, 1, 0, [0]), (3, 4, 0, [0])], weights) == [(0, 1, 0), (3, 4, 0)]


@pytest.mark.parametrize("text", ["x" * 3000 + "1", "9" * 6000, "ab1" * 2000, "QUJDREVGRw" * 800 + "==", "1" + "z" * 5000 + " GB82WEST12345698765432", "a1-" * 3000, "\u00e9" * 60_000 + " 1"])
def test_very_long_runs(text):
    weights = pii.train()
    for kind, a, b in pii.find(f"before {text} after", weights):
        assert kind in pii.TYPES and a < b


def test_redaction_of_repeated_and_null_rows(spark):
    base = docs(spark, {1: "call +1 (212) 555-0147", 2: None} | ODD)
    df = base.union(base).union(base.selectExpr("cast(null as long)", *base.columns[1:]))
    out = pii.redact(df).collect()
    assert len(out) == 3 * (len(ODD) + 2) and sum(r.text == "call <phone>" for r in out) == 3
    assert sorted((r.doc_id or 0) for r in pii.personal_data(df).collect()) == [0, 1, 1]
