"""A text of several megabytes, and one of a single word of a megabyte, through every operator."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import sentencepiece
import xxhash

from lotlens.llm import class_lm, exact_dedup, kn_quality, mixing, nbest, near_copies, queries, simhash_bk, substring_dedup, suffix_array, token_counts, toxicity


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefgho", k=rng.randint(2, 8))) for _ in range(3000)]
    long = " ".join(rng.choices(vocab, k=450_000))
    assert len(long) > 2_500_000
    passage = long[1_000_000:1_000_900]
    return [(1, long, "en", "a"), (2, f"{passage} tail", "en", "a"), (3, "x" * 1_000_000, "en", "b"), (4, "short one", "en", "b"), (5, long + " again", "en", "a")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)


def test_duplicates(docs, rows) -> None:
    exact = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs).collect()}
    assert all(exact[i]["text_sha256"] == hashlib.sha256(re.sub(r"\s", "", t).encode()).hexdigest() and exact[i]["kept"] for i, t, *_ in rows)
    words = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.substring_duplicates(docs).collect()}
    n = len(rows[0][1].split())
    assert words[1] == (n, n) and words[5] == (n + 1, n) and words[2][1] > 100 and words[3] == (1, 0)
    spans = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_array.byte_duplicates(docs).collect()}
    size = len(rows[0][1])
    assert spans[1] == (size, 0, 0) and spans[5] == (size + 6, size, 1) and spans[2] == (905, 900, 1) and spans[3] == (1_000_000, 0, 0)
    assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()) == [1, 2, 3, 4]


def test_counts_and_scores(spark, docs, rows) -> None:
    model = queries.piece_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    wanted = {i: len(sp.encode(t)) for i, t, *_ in rows if i != 3}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs.where("doc_id <> 3"), model).collect()} == wanted
    assert {r["doc_id"]: r["n_pieces"] for r in nbest.encode(docs.where("doc_id <> 3"), model, n=2).collect()} == wanted
    quality = {r["doc_id"]: r["n_words"] for r in kn_quality.quality(docs).collect()}
    assert quality == {i: len(t.split()) for i, t, *_ in rows}
    scores = {r["doc_id"]: r["n_tokens"] for r in class_lm.score_documents(docs).collect()}
    assert scores == {i: n + 1 for i, n in quality.items()}
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash_bk.simhash_groups(docs).collect()}
    assert prints[3] == f"{xxhash.xxh64_intdigest(b'x' * 1_000_000, 42):016x}"
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == len(rows) and mixing.replicated(docs).count() <= len(rows)
