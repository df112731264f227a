"""The pipeline's stages against what the operators decide, on planted cases."""

import random

import corpus_pipeline
from pyspark.sql import Row
from codequarry.llm import bagminhash, decontaminate, language_id, packing, pii
from test_operators import ODD, check_packing, sentence


def test_stages(spark, tmp_path):
    rng = random.Random(20)
    items = [(i, sentence(rng, 30)) for i in range(3)]
    texts = {i: sentence(rng, rng.randint(40, 150), "en" if i % 2 else "de") for i in range(60)}
    texts[200], texts[201] = texts[1], texts[1] + " th"
    texts[202] = f"{sentence(rng, 40)} {items[1][1]} {sentence(rng, 10)}"
    texts[203] = sentence(rng, 40) + " mail me: jo.x@mail1.example.com " + sentence(rng, 10)
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in (texts | ODD).items()] + [(None, sentence(rng, 30), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sd, stages = str(tmp_path), dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "packing"]

    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    a = stages["language_id"](spark, docs, sd)
    assert a.columns == docs.columns and ids(a) == {r.doc_id for r in language_id.identify(docs).filter("accepted").collect()} and ids(docs) - ids(a) <= set(ODD)
    b = stages["near_dedup"](spark, a, sd)
    dropped = {r.doc_id for r in bagminhash.near_duplicates(a).filter("not keep").collect()}
    assert ids(a) - ids(b) == dropped == {200, 201} and b.columns == docs.columns
    c = stages["decontamination"](spark, b, sd)
    assert ids(b) - ids(c) == {202} == ids(decontaminate.contaminated(b, spark.read.parquet(f"{sd}/benchmark.parquet"))) and None in ids(c)
    d = stages["pii"](spark, c, sd)
    out = {r.doc_id: r for r in d.collect()}
    assert set(out) == ids(c) and "<email>" in out[203].text and out[203].n_chars == len(out[203].text) and d.columns == docs.columns
    assert pii.personal_data(d).count() == 0
    last = [Row(sequence=r.sequence, **p.asDict()) for r in corpus_pipeline.run(spark, sd).collect() for p in r.pieces]
    counts = {i: len(r.text.split()) for i, r in out.items()}
    check_packing(last, counts, packing.CAPACITY)
