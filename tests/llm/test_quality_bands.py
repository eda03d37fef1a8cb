"""The character model against direct counts, and the bands against planted junk."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from lotlens.llm import char_model, kn_quality
from lotlens.llm.common import read


def direct(texts: list[str], order: int = char_model.ORDER) -> dict[str, float]:
    """Interpolated probability of each n-gram's last character, by definition."""
    padded = [" " * (order - 1) + t for t in texts]
    orders = {order: Counter(t[i : i + order] for t in padded for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])
    lower: dict[str, float] = {}
    for k in range(1, order + 1):
        n = Counter(orders[k].values())
        y, cut = n[1] / max(n[1] + 2 * n[2], 1), []
        for i in (1, 2, 3):
            d = i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0
            cut.append(d if 0 < d < i else 0.5)
        total, mass = Counter(), Counter()
        for g, c in orders[k].items():
            total[g[:-1]] += c
            mass[g[:-1]] += cut[min(c, 3) - 1]
        lower = {g: (c - cut[min(c, 3) - 1]) / total[g[:-1]] + mass[g[:-1]] / total[g[:-1]] * (lower[g[1:]] if k > 1 else 1 / len(orders[1])) for g, c in orders[k].items()}
    return lower


def test_character_model_against_direct_counts(spark) -> None:
    rng = random.Random(3)
    texts = {lang: ["".join(rng.choices(letters, k=rng.randint(1, 300))) for _ in range(8)] for lang, letters in (("a", "abc de."), (None, "жщ中文\U0001f600 "), ("b", "***$"))}
    rows = [(lang, t) for lang, ts in texts.items() for t in ts]
    got = char_model.probabilities(char_model.stored(char_model.ngram_counts(spark.createDataFrame(rows, "lang string, text string")))).collect()
    for lang, ts in texts.items():
        found = {"".join(chr(r["gram"] >> s & (1 << 21) - 1) for s in (42, 21, 0)): r["p"] for r in got if r["slot"] == char_model.slot(lang)}
        assert found == pytest.approx(direct(ts), rel=1e-9)


def test_verdict_against_direct_bands(spark, sf_dir) -> None:
    docs = read(spark, sf_dir, "documents")
    got = {r["doc_id"]: r for r in kn_quality.quality(docs).collect()}
    by_lang = defaultdict(list)
    for r in docs.collect():
        by_lang[r["lang"]].append((r["doc_id"], r["text"] or ""))
    p = direct([t for some in by_lang.values() for _, t in some])
    for some in by_lang.values():
        scores = {i: -sum(math.log10(p[padded[k : k + 3]]) for k in range(len(t))) / len(t) for i, t in some if t for padded in ["  " + t]}
        bins = sorted(math.floor(round(x, 9) / kn_quality.BIN) for x in scores.values())
        q1, mid, q3 = (bins[math.ceil(len(bins) * x) - 1] * kn_quality.BIN for x in (0.25, 0.5, 0.75))
        low = mid - kn_quality.BAND * max(mid - q1, kn_quality.LEAST_SPREAD)
        high = mid + kn_quality.BAND * max(q3 - mid, kn_quality.LEAST_SPREAD) + kn_quality.BIN
        for i, x in scores.items():
            assert got[i]["logppl"] == pytest.approx(x, abs=1e-8)
            assert (got[i]["low"], got[i]["high"]) == pytest.approx((low, high), abs=1e-6)
            assert got[i]["kept"] == (not got[i]["base_failed"] and low - 1e-7 <= x <= high + 1e-7)


def test_rare_ngrams_score_as_frequent_ones_do(spark, sf_dir, monkeypatch) -> None:
    docs = read(spark, sf_dir, "documents")
    order = lambda: sorted(((r["doc_id"], r["kept"], r["logppl"]) for r in kn_quality.quality(docs).collect()), key=repr)
    whole = order()
    monkeypatch.setattr(char_model, "FREQUENT", 500)
    few = order()
    assert [x[:2] for x in few] == [x[:2] for x in whole] and [x[2] for x in few] == pytest.approx([x[2] for x in whole], abs=1e-8)


def test_more_languages_than_64_have_their_own_band(spark) -> None:
    docs = spark.createDataFrame([(i, f"text of {i} " * 30, f"l{i}") for i in range(80)], "doc_id long, text string, lang string")
    got = kn_quality.quality(docs).collect()
    assert len(got) == 80 and all(r["low"] <= r["logppl"] <= r["high"] for r in got)


def test_bands_reject_planted_junk_and_keep_clean_documents(spark) -> None:
    rng = random.Random(5)
    parts = ["".join(rng.choices("aeiourstnlмир", k=rng.randint(2, 4))) for _ in range(40)]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 3)))
    words = lambda: [word() for _ in range(rng.randint(150, 250))]
    clean = [" ".join(words()) for _ in range(240)]
    junk = [" ".join(w + rng.choice(["***", "$$$", "###", "%%%"]) for w in words()) for _ in range(10)] + [" ".join(w.upper() + "!!" for w in words()) for _ in range(10)]
    junk += [" ".join("".join(rng.choices("qxzjwkvbghfd", k=rng.randint(3, 8))) for _ in range(200)) for _ in range(10)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in kn_quality.quality(docs).where("kept").collect()}
    assert sum(i in kept for i in range(240)) >= 0.9 * 240
    assert sum(i in kept for i in range(240, 270)) <= 3
