"""The pipeline's near-duplicate stage against all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
from lotlens.llm import near_copies


def sets(text: str | None) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def test_stage_against_all_pairs(spark, sf_dir) -> None:
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    rows: list[tuple] = []
    for g in range(30):
        base = rng.choices(vocab, k=rng.randint(60, 300))
        for copy in range(rng.randint(1, 5)):
            text = list(base)
            for _ in range(copy * len(base) // rng.choice([40, 60, 90])):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(text), "s"))
    hub = rng.choices(vocab, k=200)
    rows += [(1000 + i, " ".join([*hub[:i], "x", *hub[i:]]), "s") for i in range(60)]
    rows += [(7, " ".join(rng.choices(vocab, k=90)), "other text of a doc_id"), (None, " ".join(hub), "s"), (None, None, "s"), (2000, " ", "s"), (None, "lone", "s"), (2001, "ONE two", "s"), (2002, "one  two", "s")]
    found = [sets(r[1]) for r in rows]
    root = list(range(len(rows)))

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root[top(i)] = top(j)
    least: dict[int, tuple] = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), (True, 0)), (r[0] is None, r[0] or 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == sorted(least.values())


def test_all_likely_cross_component_pairs_are_given() -> None:
    rng = random.Random(6)
    sigs = [bytes(rng.choices(range(3), weights=(8, 1, 1), k=96)) for _ in range(40)]
    group = sorted((i % 4, i, rng.getrandbits(64) if i % 3 else 5) for i in range(40))
    share = lambda i, j: sum(x == y for x, y in zip(sigs[i], sigs[j], strict=True)) / 96
    for radius in (64, 26):
        shard = near_copies.Unconnected(radius)
        got = [tuple(sorted(p)) for c, i, fp in group for p in shard.step(i, fp, c, sigs[i])]
        wanted = {tuple(sorted((i, j))) for c, i, x in group for d, j, y in group if c < d and (x ^ y).bit_count() <= radius and share(i, j) >= near_copies.LIKELY}
        assert sorted(got) == sorted(wanted) and 0 < len(wanted) < 600


def test_each_text_is_linked_to_a_leader_within_the_radius() -> None:
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = [rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(200)]
    shard, linked = near_copies.Leaders(12), {}
    for i, fp in enumerate(fps):
        linked |= {b: a for a, b in shard.step(i, fp, i, bytes(96))}
    assert all((fps[a] ^ fps[b]).bit_count() <= 12 for b, a in linked.items())
    assert len(fps) - len(linked) == sum(map(len, shard.leaders.values())) <= 30


def test_shares_of_minhash_values_follow_similarity() -> None:
    rng = random.Random(8)
    values = [rng.getrandbits(64) for _ in range(1400)]
    parts = near_copies.np.array(values, near_copies.np.uint64)
    a, b = near_copies.signature(parts[:1000])[1], near_copies.signature(parts[100:1100])[1]
    assert abs(near_copies.likely(a, [b, a])[0] - 900 / 1100) < 0.17 and near_copies.likely(a, [a])[0] == 1


def test_a_large_group_of_unlike_texts_gives_only_its_links() -> None:
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(200)]
    texts = [[*base[:164], *(rng.getrandbits(64) for _ in range(36))] for _ in range(150)]  # alike by 0.69
    texts += [[*texts[3][:-4], *(rng.getrandbits(64) for _ in range(4))], [*texts[9][:-2], *(rng.getrandbits(64) for _ in range(2))], texts[9][:-1]]
    parts = [near_copies.np.unique(near_copies.np.array(t, near_copies.np.uint64)) for t in texts]
    shard, plain, given, before = near_copies.Unconnected(64), near_copies.Unconnected(64), [], []
    for i, x in enumerate(parts):
        sig = near_copies.signature(x)[1]
        given += shard.step(i, 0, i, sig, near_copies.known(x))
        before += plain.step(i, 0, i, sig)
    assert len(before) > 8000
    assert given == [(3, 150), (9, 151), (9, 152)]  # 151 and 152 are connected by 9


def test_long_texts_are_known_by_a_sample() -> None:
    rng = random.Random(10)
    base = [rng.getrandbits(64) for _ in range(9000)]
    found = near_copies.Known(0.8)
    for shared in (9000, 8100, 6500, 9000):
        values = near_copies.np.unique(near_copies.np.array([*base[:shared], *(rng.getrandbits(64) for _ in range(9000 - shared))][: 1800 if len(found.texts) == 3 else None], near_copies.np.uint64))
        sketch = near_copies.known(values)
        assert len(sketch) <= 8 * (near_copies.KNOWN + 1)
        found.add(sketch)
    ok, whole = found.similar(0, [1, 2, 3])
    assert ok.tolist() == [True, False, False] and not whole.any()
    assert [x.tolist() for x in found.similar(3, [3])] == [[True], [True]]


def test_heavy_shards_against_all_pairs(spark, sf_dir, monkeypatch) -> None:
    monkeypatch.setattr(near_copies, "HEAVY", 1)
    test_stage_against_all_pairs(spark, sf_dir)
