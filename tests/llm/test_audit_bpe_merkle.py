"""Filter audit, BPE by queries and Merkle manifests against plain loops, the tokenizer's library and SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lotlens.llm import filter_audit, merkle, sql_bpe
from lotlens.llm.queries import ORACLE_SQL, QUERIES

RANKS = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_merkle_manifest"])
def test_same_as_sql(name: str, spark, sf_dir: str) -> None:
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    found, wanted = QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    names = sorted(found.columns)
    assert sorted(tuple(r) for r in found.select(*names).collect()) == sorted(wanted.select(*names).fetchall())


# Filter audit.


def failing(text: str) -> set[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    rules = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text)}
    return {k for k, v in rules.items() if v}


def audited(docs: list[tuple], labels: list[tuple]) -> dict[tuple, tuple]:
    """By loops over documents and orders."""
    first: dict[str, int] = {}
    for i, _, text in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    out = {}
    for part in {s or "" for _, s, _ in docs}:
        rows = []
        for i, s, text in docs:
            if (s or "") == part:
                bad = failing(text or "") | ({"E"} if i is not None and first[text or ""] < i else set())
                rows.append((bad, any(d == i and q == 1 for d, q, _ in labels if i is not None), any(d == i and t == 1 for d, _, t in labels if i is not None)))
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, kept = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                fails = sum(f in r[0] for r in rows)
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(kept), len(gone), fails - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f]
                left = kept
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[key[1][key[2] - 1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_by_loops(spark) -> None:
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["Upper", "ÀB", "#x", "a|b", "é"]
    texts: list[str | None] = [None, "", " \t\n", "A" * 50, "# " * 300, "same word " * 150, " x" * 250]
    texts += [" ".join(r.choices(vocabulary[: r.choice([3, 200, 405])], k=r.choice([10, 199, 200, 400]))) for _ in range(50)]
    docs = [(i, r.choice([None, "", "s1", "s1", "s1", "ß"]), r.choice(texts)) for i in range(150)]
    docs += [(None, "s1", texts[20]), (None, "s1", texts[20]), (7, "again", docs[7][2])]
    labels = [(i, r.choice([None, 0, 1]), r.choice([None, 0, 1])) for i in range(-3, 120)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3).selectExpr("*", "1 as mask", "2 as first", "'x' as part")
    found = filter_audit.filter_audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(x)[:3]: tuple(x)[3:] for x in found} == audited(docs, labels)
    assert len(found) == 600 * len({s or "" for _, s, _ in docs})


def test_audit_of_nothing(spark) -> None:
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert filter_audit.filter_audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_words_in_pieces(monkeypatch) -> None:
    monkeypatch.setattr(filter_audit, "PIECE", 7)
    for text in (b"", b"   ", b"one two  three\x0bfour" * 5, b"averyveryverylongword short averyveryverylongword"):
        assert filter_audit._words(text) == (len(text.split()), len(set(text.split())))


def test_many_parts_leave_the_task_in_turns(spark, monkeypatch) -> None:
    rows = spark.range(5000).selectExpr("cast(id % 1700 as string) as part", "cast(id % 128 as int) as mask").coalesce(1)
    monkeypatch.setattr(filter_audit, "HELD", 100)
    found = filter_audit.subset_counts(rows)
    assert found.count() == 1700 * 32
    assert found.where("subset = 0").selectExpr("sum(n)", "sum(good)", "sum(toxic)").first()[:] == rows.selectExpr("count(*)", "sum(mask div 32 % 2)", "sum(mask div 64)").first()[:]
    assert found.where("subset = 5").selectExpr("sum(n)").first()[0] == rows.where("mask & 5 = 0").count()


def test_packed_rows_keep_their_part() -> None:
    masks = np.array([3, 1, 0, 2] * 50, np.int32)
    parts, begin, everything, sets = filter_audit.packed(["b", "a", "c", "a"] * 50, masks, 2)
    assert parts == ["a", "b", "c"] and list(begin) == [0, 2, 3]
    assert int(np.bitwise_count(everything).sum()) == 200 and [int(np.bitwise_count(s).sum()) for s in sets] == [100, 100]


# Byte-level BPE.


def library() -> tiktoken.Encoding:
    import base64

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "\n\n  \t x", "a" * 3001, "=" * 777, "ab" * 900, "don't I'LL we've", "naïve ﬁ ß Ünï", "日本語のテキスト、改行\r\n", "🙂👩‍👩‍👧 ​﻿", "<|endoftext|> <s>", "12345678901234567890", "\x00\x01", "xyzzyx" * 40, "aaab" * 99, " " * 500 + "end"]


def coded(spark, texts: list):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "0 as ids", "1 as decoded")
    return sql_bpe.decode(sql_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)


def test_bpe_as_the_library(spark, sf_dir: str) -> None:
    enc = library()
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    found = {r["doc_id"]: r for r in coded(spark, [*texts, None]).collect()}
    assert found[len(texts)]["ids"] == b"" and found[len(texts)]["decoded"] == b""
    for i, text in enumerate(texts):
        assert list(np.frombuffer(found[i]["ids"], "<u4")) == enc.encode_ordinary(text), text[:50]
        assert bytes(found[i]["decoded"]) == text.encode()


def test_bpe_of_random_ranks() -> None:
    """Vocabularies whose merges have no order of training, so that ``calm`` decides."""
    r = random.Random(9)
    for _ in range(6):
        tokens = list({bytes(r.choices(b"abc", k=r.randint(2, 5))) for _ in range(60)})
        r.shuffle(tokens)
        ranks = {t: i for i, t in enumerate([*(bytes([b]) for b in range(256)), *tokens])}
        coder, enc = sql_bpe.Coder(ranks, r"\S+|\s+"), tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        texts = ["".join(r.choices("abc ", weights=[4, 4, 4, 1], k=r.randint(0, 120))) for _ in range(30)] + ["a" * k for k in range(1, 40)]
        for text, ids in zip(texts, coder.encode(iter(texts)), strict=True):
            assert list(np.frombuffer(ids, "<u4")) == enc.encode_ordinary(text), text


def test_bpe_in_small_pieces(spark, monkeypatch) -> None:
    """A text of more matches than are held, a table of words that is emptied, decoding in several queries."""
    enc = library()
    coder = sql_bpe.Coder({t: i for t, i in enc._mergeable_ranks.items()}, public_tokenizers.PATTERN)
    monkeypatch.setattr(sql_bpe, "CHUNK", 11)
    monkeypatch.setattr(sql_bpe, "BYTES", 20)
    monkeypatch.setattr(sql_bpe, "KNOWN", 15)
    monkeypatch.setattr(sql_bpe, "TOKENS", 7)
    texts = ["", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "", "kurz", "strawberries tangerines " * 20, " "]
    ids = list(coder.encode(iter(texts)))
    assert [list(np.frombuffer(x, "<u4")) for x in ids] == [enc.encode_ordinary(t) for t in texts]
    assert list(coder.decode(iter(ids))) == [t.encode() for t in texts]


def test_bpe_refuses_what_it_lacks(spark) -> None:
    with pytest.raises(ValueError, match="lack the bytes"):
        sql_bpe.Coder({b"a": 0}, ".")
    coder = sql_bpe.Coder({bytes([b]): b for b in range(256)}, ".")
    with pytest.raises(ValueError, match="no token 999"):
        list(coder.decode(iter([np.array([1, 999], "<u4").tobytes()])))


def test_bpe_of_nothing(spark) -> None:
    assert coded(spark, []).count() == 0


# Merkle manifest.


def hexed(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row: tuple, lower: bool) -> str:
    fields = list(row)
    if lower and fields[4] is not None:
        fields[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in fields[4])
    return hexed(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def proofs(docs: list[tuple]) -> list[tuple]:
    """By a tree of lists. docs: doc_id, source, lang, n_chars, text."""
    trees: dict = {}
    for d in docs:
        trees.setdefault(d[2], []).append((d[0] is not None, d[0] or 0, leaf_of(d, False), d))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))

    def up(nodes: list[str]) -> list[list[str]]:
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([hexed(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    levels = {t: up([x[2] for x in sorted(trees[t], key=lambda x: x[:3])]) for t in order}
    above = up([levels[t][-1][0] for t in order])
    out = []
    for place, t in enumerate(order):
        for pos, (_, _, leaf, d) in enumerate(sorted(trees[t], key=lambda x: x[:3])):
            node = leaf_of(d, zlib.crc32(str("" if d[0] is None else d[0]).encode()) % 3 == 0)
            proof = []
            for tower, at in ((levels[t], pos), (above, place)):
                for level in tower[:-1]:
                    begin = at - at % 8
                    left, right = level[begin:at], level[at + 1 : begin + 8]
                    proof += left + right
                    node = hexed(*left, node, *right)
                    at //= 8
            out.append((d[0], leaf, levels[t][-1][0], above[-1][0], hexed(*proof), node, node == above[-1][0]))
    return sorted(out, key=repr)


def corpus(n: int, langs: list, seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    text = lambda: r.choice([None, "", "ÀÉ Mixed CASE " * r.randint(0, 4), "".join(r.choices("abcDEF é", k=9))])
    return [(i if r.random() > 0.02 else None, r.choice([None, "", "s"]), r.choice(langs), r.choice([None, 0, 12345]), text()) for i in range(n)]


SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


@pytest.mark.parametrize(("n", "langs", "levels", "top"), [(1, ["en"], 4, 4096), (9, [None, "", "a", "ß", "z"], 4, 4096), (700, ["en", "en", "de", None], 1, 40), (700, ["en"], 1, 3), (600, [f"l{i}" for i in range(200)], 1, 9), (300, ["x", "y"], 2, 2)])
def test_manifest_by_lists(spark, n: int, langs: list, levels: int, top: int) -> None:
    """Blocks of 8 or 64 and few nodes for the driver make several rounds, and subroots that are reduced as one tree."""
    docs = corpus(n, langs)
    if n > 100:
        docs += docs[:5] + [(docs[8][0], "other", *docs[8][2:])]
    d = spark.createDataFrame(docs, SCHEMA).repartition(5).selectExpr("*", "1 as tree", "2 as pos", "3 as node")
    found = merkle.manifest(d, levels=levels, top=top)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == proofs(docs)


def test_manifest_of_nothing(spark) -> None:
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_changed_byte_changes_the_root(spark) -> None:
    docs = corpus(60, ["en", "de"])
    roots = {merkle.manifest(spark.createDataFrame(x, SCHEMA)).first()["root"] for x in (docs, docs[::-1], [(*docs[0][:4], "other"), *docs[1:]])}
    assert len(roots) == 2


def test_tampering_shows_where_letters_change(spark, sf_dir: str) -> None:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    of = {r["doc_id"]: r for r in merkle.manifest(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        touched = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None and re.search("[A-Z]", r["text"])
        assert of[r["doc_id"]]["verified"] == (not touched)
