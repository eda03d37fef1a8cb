"""Training-data operators against brute force, on documents with nulls, repeats, ties and odd texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from lotlens.llm import class_lm, common, components, exact_dedup, kn_quality, mixing, nbest, queries, simhash_bk, substring_dedup, suffix_array, token_counts, toxicity
from lotlens.llm.repeats import Grams, segments

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, kept string, h int, seed string"


def documents(seed: int = 0, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(80)]
    prose = lambda k: " ".join(rng.choices(vocab, k=k))
    passage, rows = prose(60), []
    for i in range(n):
        text = prose(rng.randint(1, 150))
        if i % 5 == 0:
            text = f"{text}\n{passage} {prose(9)}."
        if i % 7 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1]
        if i % 11 == 0 and rows and rows[0][1]:
            text = rows[0][1].replace(" ", "\n", 2) + " x"
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None]), "clash", 1, "s"))
    odd = [None, "", " \t\n", "one", "One  one ONE", "ab " * 150, "x" * 400, "é" * 120 + "中文字 😀" * 12, "## $$ %% | <>", "a\x00b \x1c     c", "A" * 9000, "\r\n\r\n", "▁ ▁▁ x"]
    rows += [(n + i, t, "en", "b", None, None, None) for i, t in enumerate(odd)]
    rows += [rows[3], rows[3], (None, "no id " + passage, "en", "b", "k", 2, "s"), (None, "no id " + passage, "en", "b", "k", 2, "s"), (4, passage, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x: object) -> str:
    return repr(x)


def same(found, wanted: list[tuple]) -> None:
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(wanted, key=key)


# Exact deduplication

def norm(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize(("block", "mod"), [(4096, None), (7, None), (5, 3)])
def test_exact_duplicates(docs, rows, block, mod) -> None:
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    wanted = []
    for text, members in groups.items():
        members.sort(key=lambda m: m[:3])
        wanted += [(m[3], members[0][3], len(members), i == 0, hashlib.sha256(text.encode()).hexdigest()) for i, m in enumerate(members)]
    got = exact_dedup.exact_duplicates(docs, block_chars=block, hash_mod=mod).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    same(got, wanted)


def test_dropping_exact_duplicates_keeps_one_row_of_each_text(docs, rows, none) -> None:
    got = exact_dedup.drop_exact_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(norm(r["text"]) for r in got.collect()) == sorted({norm(r[1]) for r in rows})
    assert exact_dedup.drop_exact_duplicates(none).count() == 0


# SentencePiece

def all_segmentations(lattice: nbest.Lattice, text: str, library: list[int]) -> list[tuple[float, tuple[int, ...]]]:
    """Every segmentation; characters in pieces that the library doesn't put there cost."""
    taken, at = set(), 0
    spelt = []
    for i in library:
        size = lattice.lengths[i]
        spelt = [] if size else [*spelt, i]
        if size or len(spelt) == len(text[at].encode()):
            taken.add((at, at + (size or 1)))
            at, spelt = at + (size or 1), []
    out = []

    def walk(at: int, score: float, ids: tuple[int, ...]) -> None:
        if at == len(text):
            out.append((score, ids))
            return
        alone = False
        for j in range(at + 1, len(text) + 1):
            found = lattice.pieces.get(text[at:j])
            if found:
                alone = alone or j == at + 1
                walk(j, score + found[1] - (0 if (at, j) in taken else lattice.leave * (j - at)), (*ids, found[0]))
        if not alone:
            spelt = text[at].encode()
            walk(at + 1, score + lattice.byte_score * len(spelt) - (0 if (at, at + 1) in taken else lattice.leave), (*ids, *(lattice.byte_ids[b] for b in spelt)))

    walk(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])


def test_nbest_is_the_best_of_all() -> None:
    lattice, rng = nbest.Lattice.of(queries.piece_model()), random.Random(5)
    sp = lattice.counter.sp
    for _ in range(150):
        text = "".join(rng.choices("abther. ,\n(é中'1", k=rng.randint(1, 9)))
        every = all_segmentations(lattice, (" " + text).replace(" ", "▁"), sp.encode(text))
        got, alike = lattice.nbest(text, 5)
        assert got[0][1].tolist() == sp.encode(text)
        assert [s * nbest.UNIT for s, _ in got] == [s for s, _ in every[:5]]
        assert len({tuple(ids.tolist()) for _, ids in got}) == len(got)
        assert alike and all(lattice.decode(ids.tolist()) == text for _, ids in got)
        for score, ids in got:
            assert (score * nbest.UNIT, tuple(ids.tolist())) in every


def test_the_best_segmentation_is_the_librarys(spark, sf_dir, docs, rows) -> None:
    model = queries.piece_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for table in (docs, common.read(spark, sf_dir, "documents")):
        texts = [r["text"] or "" for r in table.collect()]
        found = nbest.encode(table, model, n=2).select(F.get("best", F.lit(0))["ids"].alias("ids"), F.get("best", F.lit(1))["ids"].alias("second")).collect()
        assert sorted(r["ids"] for r in found) == sorted(sp.encode(texts))
        assert all(r["ids"] != r["second"] for r in found)


def test_encoding_round_trip(docs, rows, none) -> None:
    model = queries.piece_model()
    out = nbest.encode(docs, model, n=3)
    best = out.select("doc_id", F.col("best")[0]["ids"].alias("ids"))
    back = sorted(((r["doc_id"], r["text"]) for r in nbest.decode(best, model).collect()), key=key)
    assert back == sorted(((r[0], (r[1] or "").replace("▁", " ")) for r in rows), key=key)
    digests = nbest.encode(docs, model, n=3, digests=True)
    assert digests.where("not decodes").count() == 0
    assert nbest.encode(none, model).count() == 0
    assert all(a["score"] >= b["score"] for r in out.collect() for a, b in zip(r["best"], r["best"][1:], strict=False))


# Substrings

def test_substring_duplicates(docs, rows, none) -> None:
    w = substring_dedup.WINDOW
    split = [[x for x in WORD.findall(r[1] or "")] for r in rows]
    count = Counter(tuple(s[i : i + w]) for s in split for i in range(len(s) - w + 1))
    wanted = []
    for r, s in zip(rows, split, strict=True):
        gone = [False] * len(s)
        for i in range(len(s) - w + 1):
            if count[tuple(s[i : i + w])] > 1:
                gone[i : i + w] = [True] * w
        left = " ".join(x for x, g in zip(s, gone, strict=True) if not g)
        wanted.append((r[0], len(s), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    for wide in (None, 2):
        same(substring_dedup.substring_duplicates(docs, wide=wide), wanted)
    assert substring_dedup.substring_duplicates(none).count() == 0
    assert set(substring_dedup.substring_duplicates(docs, digests=False).columns) == {"doc_id", "n_words", "n_removed", "kept"}


def test_byte_duplicates(docs, rows, none) -> None:
    w = suffix_array.WINDOW
    least: dict[bytes, float] = {}
    data = [((math.inf if r[0] is None else r[0]), (r[1] or "").encode()) for r in rows]
    for i, b in data:
        for k in range(len(b) - w + 1):
            least[b[k : k + w]] = min(least.get(b[k : k + w], math.inf), i)
    wanted = []
    for r, (i, b) in zip(rows, data, strict=True):
        gone = [False] * len(b)
        for k in range(len(b) - w + 1):
            if least[b[k : k + w]] < i:
                gone[k : k + w] = [True] * w
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        wanted.append((r[0], len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    for wide in (None, 2):
        same(suffix_array.byte_duplicates(docs, wide=wide), wanted)
    assert suffix_array.byte_duplicates(none).count() == 0


def test_suffix_array_of_random_and_periodic_texts() -> None:
    rng = random.Random(3)
    for _ in range(600):
        s = rng.choices(range(rng.choice([1, 2, 3, 9])), k=rng.randint(0, 50))
        s = s * 3 if rng.random() < 0.3 else s
        assert suffix_array.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_automaton_counts_places() -> None:
    rng = random.Random(4)
    for _ in range(100):
        texts = [(rng.choices(range(3), k=rng.randint(1, 14)), rng.randint(1, 3)) for _ in range(4)]
        shard = substring_dedup.SuffixAutomaton()
        for t, weight in texts:
            shard.add(t, weight)
        shard.close()
        for t, _ in texts:
            for w in (1, 2, 4):
                want = [sum(weight * sum(u[j : j + w] == t[i : i + w] for j in range(len(u) - w + 1)) for u, weight in texts) for i in range(len(t) - w + 1)]
                assert list(shard.stream(t, w)) == want


def test_equal_windows_have_equal_seeds() -> None:
    rng = np.random.default_rng(1)
    s = rng.integers(0, 2**63, 400, dtype=np.uint64)
    two = np.concatenate([s[:150], s[37:97], s[200:]])
    both = np.concatenate([s, s[:3], two, s[:0], s[:20]])
    seeds: dict = defaultdict(dict)
    for v, t, p, n in zip(*(x.tolist() for x in segments(Grams(both), np.array([400, 3, len(two), 0, 20]), 20, 6)), strict=True):
        seeds[t] |= {p + i: v for i in range(n)}
    assert {t: sorted(x) for t, x in seeds.items()} == {0: list(range(381)), 2: list(range(len(two) - 19)), 4: [0]}
    assert all(seeds[2][150 + i] == seeds[0][37 + i] for i in range(41)) and seeds[4][0] == seeds[0][0]
    assert len(segments(Grams(s[:5]), np.array([5]), 6, 6)[0]) == 0


# Mixing

def test_mixing_follows_the_distribution(spark, docs, rows, none) -> None:
    by = {r["__source"]: r["__rate"] for r in mixing.mix(docs).select(F.col("source").alias("__source"), "__rate").distinct().collect()}
    chars = Counter()
    for r in rows:
        chars[r[3]] += len(r[1] or "")
    assert by == {s: pytest.approx(sum(chars.values()) / 3 / n) for s, n in chars.items()}
    got = Counter((r["doc_id"], r["text"]) for r in mixing.mix(docs).collect())
    times = Counter((r[0], r[1]) for r in rows)
    for r in rows:
        u = int(hashlib.md5(f"mix-1|{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        rate, k, cum = by[r[3]], 0, 0.0
        while cum + math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) <= u:
            cum += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            k += 1
        assert got[(r[0], r[1])] == k * times[(r[0], r[1])]
    assert mixing.mix(none).count() == 0
    only = mixing.mix(docs, weights={"b": 1.0}, epochs=3.0)
    assert {r["source"] for r in only.collect()} == {"b"}
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("source"), F.lit("t").alias("text"))
    assert mixing.mix(many, epochs=900.0).count() == pytest.approx(3_600_000, rel=0.01)


# Language model

def test_scores(docs, rows, none) -> None:
    toks = lambda t: [w.lower() for w in (t or "").encode().split()] + [b""]
    train: Counter = Counter()
    for r in rows:
        if common.fold(r[0]) != 1:
            train.update(toks(r[1]))
    n, v = sum(train.values()), len(train)
    got = class_lm.score_documents(docs).collect()
    assert len(got) == len(rows)
    wanted = sorted(((r[0], common.fold(r[0]) == 1, len(toks(r[1])), sum(w in train for w in toks(r[1])), n, round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(r[1])), 6)) for r in rows), key=key)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=key) == wanted
    assert all(r["score"] < 0 for r in got)
    assert class_lm.score_documents(none).count() == 0


def test_rare_words_score_as_frequent_ones_do(docs, monkeypatch) -> None:
    found = lambda: sorted(((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in class_lm.score_documents(docs).collect()), key=key)
    whole = found()
    monkeypatch.setattr(class_lm, "FREQUENT", 5)
    assert found() == whole


def test_scores_and_probabilities_by_definition(spark, docs, rows, monkeypatch) -> None:
    """Few items, so that most words get their class by the second step."""
    tables: dict = {}
    for name in ("clustered", "word_classes"):
        real = getattr(class_lm, name)
        monkeypatch.setattr(class_lm, name, lambda *x, real=real, name=name: tables.setdefault(name, real(*x)))
    got = class_lm.score_documents(docs, item_words=20).collect()
    toks = lambda t: [w.lower() for w in (t or "").encode().split()] + [b""]
    train = [toks(r[1]) for r in rows if common.fold(r[0]) != 1]
    n = Counter(w for t in train for w in t)
    top = [w for w, _ in sorted(((w, k) for w, k in n.items() if w and len(w) <= class_lm.SHORT), key=lambda x: (-x[1], x[0]))[:20]]
    classes, pairs, rising = tables["clustered"]
    assert len(rising) > 1 and all(a < b for a, b in zip(rising, rising[1:], strict=False))
    of = {b"": 0} | {w: int(classes[i + 1]) for i, w in enumerate(top)}
    second = {r["word"]: (r["n"], r["class"]) for r in tables["word_classes"].collect()}
    assert {bytes(w): k for w, (k, _) in second.items()} == {w: k for w, k in n.items() if w and w not in of}
    first = lambda w: of[w] if w in of else int(classes[class_lm.suffix_item(w, 20)])
    f = lambda x: x * math.log(max(x, 1.0))
    for w in sorted(second)[:25]:
        before, after = Counter(), Counter()
        for t in train:
            c = [0, *[first(x) for x in t], 0]
            for i, x in enumerate(t):
                if x == w:
                    before[c[i]] += 1
                    after[c[i + 2]] += 1
        gain = lambda c: sum(f(pairs[a, c] + k) - f(pairs[a, c]) for a, k in before.items()) + sum(f(pairs[c, b] + k) - f(pairs[c, b]) for b, k in after.items()) - 2 * (f(pairs[:, c].sum() + n[w]) - f(pairs[:, c].sum()))
        assert gain(second[w][1]) == pytest.approx(max(gain(c) for c in range(1, class_lm.CLASSES)), abs=1e-6)
    of |= {bytes(w): c for w, (_, c) in second.items()}
    final = lambda w: of[w] if w in of else int(classes[class_lm.suffix_item(w, 20)])
    size, tri = class_lm.CLASSES, Counter()
    for t in train:
        c = [0, 0, *map(final, t)]
        tri.update(zip(c, c[1:], c[2:], strict=False))
    two, one, context, pair_context = Counter(), Counter(), Counter(), Counter()
    for (a, b, c), k in tri.items():
        two[b, c] += k
        one[c] += k
        context[a, b] += k
        pair_context[b] += k
    total, members = sum(one.values()), Counter(of[w] for w in n)

    def p(a, b, c):
        low = (one[c] + 0.5) / (total + 0.5 * size)
        middle = (two[b, c] + class_lm.PRIOR * low) / (pair_context[b] + class_lm.PRIOR)
        return (tri[a, b, c] + class_lm.PRIOR * middle) / (context[a, b] + class_lm.PRIOR)

    emission = lambda w, c: (n[w] + 0.5) / (one[c] + 0.5 * (members[c] + 1))
    for a, b in [(0, 0), (0, 5), (3, 7), *list(context)[:10]]:
        assert sum(p(a, b, c) for c in range(size)) == pytest.approx(1)
    for c in set(of.values()):
        assert sum(emission(w, c) for w in n if of[w] == c) + 0.5 / (one[c] + 0.5 * (members[c] + 1)) == pytest.approx(1)
    wanted = []
    for r in rows:
        t = toks(r[1])
        c = [0, 0, *map(final, t)]
        wanted.append((r[0], round(sum(math.log10(p(*c[i : i + 3])) + math.log10(emission(w, c[i + 2])) for i, w in enumerate(t)), 5)))
    found = sorted(((r["doc_id"], r["score"]) for r in got), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    wanted.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert [i for i, _ in found] == [i for i, _ in wanted] and [x for _, x in found] == pytest.approx([x for _, x in wanted], abs=1e-4)


def test_exchange_raises_the_likelihood() -> None:
    rng = np.random.default_rng(2)
    items, size = 40, 5
    seq = np.concatenate([[0], *[[1 + 2 * rng.integers(0, 19), 2 + 2 * rng.integers(0, 19)] for _ in range(3000)]])
    classes = np.concatenate(([0], 1 + np.arange(items - 1) // 2 % (size - 1)))

    def counted(c):
        left, right = np.zeros((items, size)), np.zeros((items, size))
        np.add.at(left, (seq[1:], c[seq[:-1]]), 1)
        np.add.at(right, (seq[:-1], c[seq[1:]]), 1)
        return left, right

    measure = lambda c: class_lm.likelihood(class_lm.class_pairs(c, counted(c)[0]))
    now = classes
    for _ in range(3):
        now = class_lm.exchange(now, *counted(now))
    assert measure(now) > measure(classes) and now[0] == 0


# Quality rules

def test_rule_counts(docs, rows, none) -> None:
    got = kn_quality.quality(docs)
    wanted = []
    for r in rows:
        text = r[1] or ""
        words = WORD.findall(text)
        three = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if three[tuple(words[i : i + 3])] > 1 for k in range(3)}
        seen, again = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        wanted.append((r[0], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed))
    same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), wanted)
    for r in got.collect():
        assert r["kept"] == (not r["base_failed"] and r["logppl"] is not None and r["low"] <= r["logppl"] <= r["high"])
    assert kn_quality.quality(none).count() == 0
    assert kn_quality.keep_quality(docs).columns == docs.columns
    assert kn_quality.keep_quality(docs).count() == got.where("kept").count()


# SimHash

def fp(text: str | None) -> int:
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(len(w) - 2, 1))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("shard", [1024, 3])
def test_simhash_groups(docs, rows, none, shard) -> None:
    prints = [fp(r[1]) for r in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)].append(r[0])
    wanted = [(r[0], f"{prints[i]:016x}", min(least[top(i)], default=None)) for i, r in enumerate(rows)]
    same(simhash_bk.simhash_groups(docs, max_shard=shard), wanted)
    assert simhash_bk.simhash_groups(none).count() == 0


def test_bk_tree_finds_all_within() -> None:
    rng = random.Random(7)
    base = rng.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(300)})
    tree = simhash_bk.BKTree()
    for x in fps:
        tree.add(x)
    for q in fps[:50]:
        assert set(tree.within(q, 3)) == {x for x in fps if (x ^ q).bit_count() <= 3}


def test_components_of_chains_and_stars(spark) -> None:
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (-5, 200), (200, -5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(40)}, -5: -5, 200: -5}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# Toxicity

def test_toxicity_is_learned(spark, none) -> None:
    rng, vocab = random.Random(9), [f"w{i}" for i in range(300)]
    data, labels = [], []
    for i in range(900):
        words = rng.choices(vocab, k=rng.randint(5, 80))
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["nasty", "vile"]))
        data.append((i, " ".join(words), rng.choice(["en", "de"]), "s"))
        labels.append((i, int(toxic)))
    data += [(1000, None, None, None), (1001, "", "en", None), (1000, "w1 " * 70_000 + "vile", "en", None), (None, "vile", "xx", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").withColumn("toxic", F.lit(7))
    marks = spark.createDataFrame([*labels, (1, None), (5000, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs.withColumn("lang", F.lit("zz")), marks).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in held)
    assert toxicity.toxicity(none, marks).count() == 0
    assert toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == len(data)


# Token counts

def test_token_counts(docs, rows, none) -> None:
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    wanted = [(r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or "")), len(sp.encode(r[1] or "")) > 50) for r in rows]
    for entries in (10, 100_000):
        same(token_counts.token_counts(docs, queries.piece_model(), limit=50, entries=entries), wanted)
    assert token_counts.token_counts(none, queries.piece_model()).count() == 0


def test_pre_tokens_add_up_to_the_library(spark) -> None:
    p, rng = token_counts.PieceCounter.of(queries.piece_model()), random.Random(11)
    for _ in range(3000):
        text = "".join(rng.choices(" ab,.\n²é▁()'#\r\t中0\0<s>", k=rng.randint(0, 14)))
        assert sum(p.count(p.pre_tokens(text))) == len(p.sp.encode(text)), text
