"""A long pre-token in every document, and ties between texts of one document."""

from __future__ import annotations

import random

import sentencepiece

from lotlens.llm import queries, token_counts, toxicity


def test_a_long_pre_token_in_all_documents_is_broadcast(spark) -> None:
    model, rng = queries.piece_model(), random.Random(2)
    rule, name = "-" * 60, "q" * 50 + "é" * 20
    rows = [(i, f"{rule} {name} {rng.random()} word{i} {rule}") for i in range(400)] + [(400, rule * 90_000), (401, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    top = token_counts.frequent_pre_tokens(docs, model, "text")
    split = token_counts.PieceCounter.of(model).pre_tokens
    long = {p for _, t in rows[:400] for p in split(t) if len(p) > token_counts.SHORT}
    assert len(long) >= 2 and all(top[token_counts.entry(p)] == token_counts.PieceCounter.of(model).count([p])[0] for p in long)
    assert max(map(len, top)) <= 34
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, model).collect()}
    assert got == {i: len(sp.encode(t or "")) for i, t in rows}


def test_each_rare_pre_token_is_counted_once(spark, monkeypatch) -> None:
    model = queries.piece_model()
    docs = spark.createDataFrame([(i, f"one two{i % 3} three") for i in range(3000)], "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = token_counts.token_counts(docs, model, entries=0).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(sp.encode(f"one two{i % 3} three")) for i in range(3000)}


def test_training_doesnt_depend_on_the_order_of_rows(spark) -> None:
    rng = random.Random(8)
    rows = [(i % 150, " ".join(rng.choices(["a", "b", "c", "vile"] if i % 3 else ["a", "b", "c"], k=12)), "en") for i in range(300)]
    marks = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)], "doc_id long, toxic int")
    one, two = (sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(spark.createDataFrame(x, "doc_id long, text string, lang string").repartition(n), marks).collect()) for x, n in ((rows, 2), (rows[::-1], 5)))
    assert one == two
