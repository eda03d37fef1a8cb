"""What the second best segmentation of a pre-token loses, without a search of its lattice."""

from __future__ import annotations

import random

import public_tokenizers
import pytest

from lotlens.llm.nbest import Lattice


@pytest.fixture(scope="module")
def lattice() -> Lattice:
    return Lattice(str(public_tokenizers.path("piece_bpe_32k.model")))


def test_the_nearest_other_segmentation_is_read_off_the_pieces(lattice: Lattice) -> None:
    rng = random.Random(5)
    words = [" " + "".join(rng.choices("etaoinshrdlucéü界7-Zq", k=rng.randint(1, 9))) for _ in range(3000)] + [" ", "ab", " a", "  ", " the", "\n", " zz"]
    pre = [p for w in words for p in lattice.counter.pattern.findall(w)]
    known = 0
    for p, ids in zip(pre, lattice.counter.encode(pre), strict=True):
        text = p.replace(" ", "▁")
        score, loss = lattice.nearly(text, ids)
        whole, real = lattice.beside(text, ids)
        assert score == whole and (loss == real if loss < lattice.far else real >= loss)
        known += loss < lattice.far
    assert 1000 < known < len(pre)


def test_lattices_are_searched_only_where_a_text_needs_them(lattice: Lattice, monkeypatch) -> None:
    asked: list[str] = []
    beside = Lattice.beside
    monkeypatch.setattr(Lattice, "beside", lambda self, text, ids: asked.append(text) or beside(self, text, ids))
    rng = random.Random(6)
    text = " ".join("".join(rng.choices("etaoinshrdlu", k=7)) for _ in range(500))
    assert len(lattice.nbest(text, 4)[0]) == 4 and not asked
    assert all(isinstance(ids, bytes) for _, _, ids in lattice.young.values())
