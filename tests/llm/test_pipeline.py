"""The pipeline's stages against brute force on the smallest tables."""

import zlib
from collections import defaultdict

import numpy as np

from tabloom.llm import feistel_pii, ppm_language
from tabloom.llm.queries import secret_key, tokenizer_file
from tests.llm.test_corpus_operators import brute_components, shingles


def test_pipeline_is_its_stages_by_brute_force(spark, data):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet")
    names, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    model = ppm_language.language_model(docs)
    accepted = ppm_language.identify(docs, model).where(f"lang_pred <> 'und' and score >= 0.5 and bits_per_byte <= 8")
    want = {r.doc_id: texts[r.doc_id] for r in accepted.select("doc_id").collect()}
    assert all(any(c.isalpha() for c in t) for t in want.values()) and len(want) > 0.95 * len(texts)
    want = {i: want[i] for i, (_, c) in brute_components(want.items()).items() if c == i}
    items = [q for q in (shingles(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()) if q]
    want = {i: t for i, t in want.items() if not any(100 * len(q & shingles(t)) >= 75 * len(q) for q in items)}
    want = {i: feistel_pii.scan(t, secret_key(spark))[0] for i, t in want.items()}
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, data)
        assert step.columns == names, name
    kept = {r.doc_id: r for r in step.collect()}
    assert {i: r.text for i, r in kept.items()} == want and all(r.n_chars == len(r.text) for r in kept.values())
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, data).collect():
        pieces[r.doc_id].append(r)
    t = Tokenizer.from_file(tokenizer_file())
    assert pieces.keys() == want.keys()
    for i, text in want.items():
        ids, at = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_pipeline_of_nothing(spark, data):
    import corpus_pipeline

    step = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, data)
    assert step.count() == 0


def test_noise_goes_and_texts_stay(spark, data):
    import base64
    import random

    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    rng = random.Random(3)
    noise = [(10**6 + i, base64.b64encode(rng.randbytes(600)).decode(), None, "s", 800) for i in range(20)]
    kept = corpus_pipeline.language(spark, docs.unionByName(spark.createDataFrame(noise, docs.schema)), data)
    ids = {r.doc_id for r in kept.collect()}
    assert not any(i >= 10**6 for i in ids) and len(ids) > 0.95 * docs.count()


def test_rows_without_an_id_and_repeated_rows(spark, data):
    import corpus_pipeline

    text = lambda w: " ".join(f"{w}{i}" for i in range(30))
    item = next(r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() if len(shingles(r.text)) > 8)
    leak = f"{text('before')} {item} {text('after')}"
    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    docs = make([
        (None, text("lone")), (None, text("other")), (None, text("other")), (None, text("shared")), (8, text("shared")),
        (3, text("twice")), (3, text("twice")), (3, text("twice") + " more"), (4, text("one")), (4, text("two")), (2, text("two")),
    ])
    kept = corpus_pipeline.near_duplicates(spark, docs, data)
    assert kept.columns == docs.columns
    # of the copies under id 3 any may stay: they share it
    found = sorted(((r.doc_id or 0, r.text.removesuffix(" more")) for r in kept.collect()))
    assert found == [(0, text("lone")), (0, text("other")), (2, text("two")), (3, text("twice")), (4, text("one")), (8, text("shared"))]
    left = corpus_pipeline.benchmark_leaks(spark, make([(None, leak), (None, text("lone")), (5, leak), (5, text("one")), (6, leak)]), data)
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, text("lone")), (5, text("one"))]
