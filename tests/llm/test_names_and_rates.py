"""Inputs whose columns have the names that operators use inside, repeated ids, and large rates."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lotlens.llm import exact_dedup, kn_quality, mixing, near_copies
from lotlens.llm.common import stored

INSIDE = ["__id", "__own", "__row", "__sha", "__n", "__own_sha", "__own_n", "__source", "__rate", "__copies", "__copy", "__order", "__u", "__least", "__cdf", "__chunk", "node", "row", "same", "ID", "h", "slot", "level", "name", "best"]


def test_stages_take_columns_of_their_own_names(spark, sf_dir) -> None:
    texts = [" ".join(f"w{i * k % 97}x{i}" for i in range(70)) for k in range(1, 9)]
    base = spark.createDataFrame([(i, t, "en", "a" if i % 2 else "b", len(t)) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, lang string, source string, n_chars long")
    docs = base.select("*", *[F.lit(7).alias(c) for c in INSIDE])
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        base, docs = stored(stage(spark, base, sf_dir)), stored(stage(spark, docs, sf_dir))
        assert docs.count() == base.count() > 0, name
        if i < 4:
            assert docs.columns[5:] == INSIDE and docs.where(" and ".join(f"`{c}` = 7" for c in INSIDE)).count() == docs.count(), name


def test_repeated_ids_of_different_texts_keep_one_row_of_each_text(spark) -> None:
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b)], "doc_id long, text string")
    for drop in (near_copies.drop_near_copies, exact_dedup.drop_exact_duplicates):
        assert sorted(map(tuple, drop(docs).collect())) == [(1, a), (5, b)]
    langs = docs.withColumn("lang", F.lit("en"))
    assert kn_quality.keep_quality(langs).count() == kn_quality.quality(langs).where("kept").count()


def test_distributions_sum_as_poisson(spark) -> None:
    rates = [0.01, 0.7, 3.0, 55.5, 4000.0]
    got = {r["rate"]: r for r in mixing.distributions(spark.createDataFrame([(str(x), x) for x in [*rates, 0.0]], "source string, rate double")).collect()}
    assert sorted(got) == rates
    for x in rates:
        cum = 0.0
        for k in range(got[x]["least"] + len(got[x]["cdf"])):
            cum += math.exp(k * math.log(x) - x - math.lgamma(k + 1))
            if k >= got[x]["least"]:
                assert got[x]["cdf"][k - got[x]["least"]] == pytest.approx(cum, abs=1e-9)


def test_large_rates_give_large_counts(spark, monkeypatch) -> None:
    docs = spark.createDataFrame([(i, "s", "t") for i in range(3)], "doc_id long, source string, text string")
    for entries in (mixing.BROADCAST_ENTRIES, 0):
        monkeypatch.setattr(mixing, "BROADCAST_ENTRIES", entries)
        counts = [r["__copies"] for r in mixing.replicated(docs, epochs=1e10).collect()]
        assert len(counts) == 3 and all(abs(n - 1e10) < 6e5 for n in counts)
    monkeypatch.setattr(mixing, "CHUNK", 7)
    copies = Counter((r["doc_id"], r["__copy"]) for r in mixing.mix(docs, epochs=20.0).collect())
    wanted = {r["doc_id"]: r["__copies"] for r in mixing.replicated(docs, epochs=20.0).collect()}
    assert copies == Counter((i, k) for i, n in wanted.items() for k in range(1, n + 1))
