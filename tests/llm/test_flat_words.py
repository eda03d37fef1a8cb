"""Texts of a batch are split and encoded at once, not word by word."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from lotlens.llm import class_lm

ODD = ["", " ", "a", " a  b ", "\t\n", "A\x0bB\x0cC\rD\x1cE\x85F G\xa0H", "x ", " x", "\x00 y", "É Ç ÉÉÉÉ", "\x1c\x1d\x1e\x1f z", "Q" * 50 + " q", "one two one three two ONE"]


def split(text: str) -> list[bytes]:
    return text.encode().lower().split()


def batch(texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


@pytest.mark.parametrize("size", [1, 20, 1_000_000])
def test_words_and_their_places_are_those_of_single_texts(size: int, monkeypatch) -> None:
    monkeypatch.setattr(class_lm, "PIECE", size)
    items = [b"", b"a", b"one", b"x"]
    got = [r for p in class_lm.pieces([batch(ODD)]) for r in class_lm.encode(p, pa.array(items, pa.binary()), np.arange(4), 3).to_pylist()]
    assert [r["doc_id"] for r in got] == list(range(len(ODD)))
    for r, t in zip(got, ODD, strict=True):
        words = [*split(t), b""]
        assert r["n_tokens"] == len(words)
        assert np.frombuffer(r["items"], "<u2").tolist() == [items.index(w) if w in items else class_lm.suffix_item(w, 3) for w in words]
        assert {w["word"]: w["at"] for w in r["words"]} == {w: [i for i, x in enumerate(words) if x == w] for w in words if w not in items}


def test_long_words_are_named_by_their_digest() -> None:
    for words in ([], [b"a", b"b"], [b"a", b"q" * 41, b"b" * 40, "é".encode() * 30]):
        assert class_lm._entries(pa.array(words, pa.binary())).to_pylist() == [class_lm.entry(w) for w in words]


def test_encoding_takes_few_times_as_long_as_splitting() -> None:
    rng = random.Random(4)
    names = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(60_000)]
    b = batch([" ".join(names[int(60_000 * rng.random() ** 2)] for _ in range(500)) for _ in range(1000)])
    items = sorted({n.encode() for n in names[:3000]})

    def least(f) -> float:
        took = []
        for _ in range(3):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    plain = least(lambda: [split(t) for t in b.column("text").to_pylist()])
    # Word by word it took more than 20 times as long.
    assert least(lambda: class_lm.encode(b, pa.array([b"", *items], pa.binary()), np.arange(len(items) + 1), 8191)) < 12 * plain
