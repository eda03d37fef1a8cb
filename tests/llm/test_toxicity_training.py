"""Training on all labelled rows: shards, their average, and the features by loops."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np

from lotlens.llm import toxicity


def test_training_takes_every_labelled_row(spark, monkeypatch) -> None:
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    rows = [(i, f"{'vile' if i % 2 else 'kind'} w{i % 1200}", "en") for i in range(6600)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(6600)], "doc_id long, toxic int")
    model, _ = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), marks)
    crc = lambda text: zlib.crc32(text.encode())
    learnt = Counter(w for i, text, _ in rows if crc(str(i)) % 5 and crc(f"keep{i}") % 5 for w in text.split())
    assert model.rows.tolist() == sorted({crc(w) % toxicity.BUCKETS for w, n in learnt.items() if n >= 3})


def test_shards_are_averaged_whatever_the_order_of_tasks(spark, monkeypatch) -> None:
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["a", "b", "c"], k=12) + ["vile"] * (i % 3 == 0)), "en") for i in range(300)]
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    found = lambda x, n: sorted((r["doc_id"], r["score"], r["predicted"]) for r in toxicity.toxicity(spark.createDataFrame(x, "doc_id long, text string, lang string").repartition(n), marks).collect())
    whole = found(rows, 2)
    monkeypatch.setattr(toxicity, "SHARD", 24)  # eight shards
    one = found(rows, 2)
    assert one == found(rows[::-1], 5) and one != whole
    assert all(p == (i % 3 == 0) for i, _, p in one)


def test_features_are_maxima_over_all_windows(monkeypatch) -> None:
    model, rng = toxicity.TextCNN(np.arange(40)), np.random.default_rng(3)
    model.values[: toxicity._DENSE] = rng.normal(0, 1, (toxicity._DENSE, toxicity.DIM))
    taps, out, b, bias = model._dense()
    for n in (0, 1, 2, 30):
        words = rng.integers(0, 60, n)  # some have no vector of their own
        x = np.array([model.values[toxicity._DENSE + 1 + w] if w < 40 else np.zeros(toxicity.DIM) for w in words] + [np.zeros(toxicity.DIM)] * 3).reshape(-1, toxicity.DIM)
        features, row = [], 0
        for k in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                features.append(max(sum(float(x[t + j] @ taps[row + j * toxicity.FILTERS + f]) for j in range(k)) for t in range(n + 1)))
            row += k * toxicity.FILTERS
        for piece in (1 << 16, 7):
            monkeypatch.setattr(toxicity, "PIECE", piece)
            assert abs(model.logit(words) - float(np.tanh(np.array(features) + b) @ out + bias[0])) < 1e-4
