"""The pipeline's stages, each against a plain version on its own input, and queries against SQL."""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from lotlens.llm import kn_quality, queries
from lotlens.llm.common import read, stored


def norm(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def kept_of_near_copies(rows: list) -> list[int]:
    """The smallest doc_id of each group that a Jaccard similarity of 0.8 between five-word shingles connects, by all pairs."""
    words = [(r["text"] or "").lower().split() for r in rows]
    found = [frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset() for w in words]
    root = list(range(len(rows)))

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r["doc_id"]), r["doc_id"])
    return sorted(least.values())


def replicated(rows: list) -> list[int]:
    """doc_ids by inverting each source's Poisson distribution at the row's number."""
    chars = Counter()
    for r in rows:
        chars[r["source"]] += len(r["text"] or "")
    out = []
    for r in rows:
        rate = sum(chars.values()) / len(chars) / chars[r["source"]]
        u = int(hashlib.md5(f"mix-1|{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        k, cum = 0, 0.0
        while cum + math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) <= u:
            cum += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            k += 1
        out += [r["doc_id"]] * k
    return sorted(out)


def test_stages(spark, sf_dir) -> None:
    """Each stage on what its predecessor kept; the verdict of the quality rules is held against direct counts in test_quality_bands."""
    docs = read(spark, sf_dir, "documents")
    columns = docs.columns
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = stored(stage(spark, docs, sf_dir))
        rows = docs.collect()
        ids = sorted(r["doc_id"] for r in rows)
        if i < 4:
            assert docs.columns == columns, name
        if name == "quality rules":
            verdict = {r["doc_id"]: r["kept"] for r in kn_quality.quality(read(spark, sf_dir, "documents")).collect()}
            assert ids == sorted(k for k, kept in verdict.items() if kept) and 0.5 * len(before) < len(ids) < len(before)
        elif name == "exact dedup":
            assert sorted(norm(r["text"]) for r in rows) == sorted({norm(r["text"]) for r in before})
        elif name == "simhash near-dedup":
            assert ids == kept_of_near_copies(before)
        elif name == "mixing sources to target weights":
            assert ids == replicated(before)
        else:
            digest = lambda t: hashlib.sha256(np.array(sp.encode(t), "<i4").tobytes()).hexdigest()
            assert sorted((r["doc_id"], r["best"][0]["ids_sha256"]) for r in rows) == sorted((r["doc_id"], digest(r["text"])) for r in before)
            assert all(r["decodes"] for r in rows)


def test_run_gives_the_rows_of_the_last_stage(spark, sf_dir) -> None:
    assert corpus_pipeline.run(spark, sf_dir).where("decodes").count() > 0


def test_stages_take_odd_rows(spark, sf_dir) -> None:
    rows = [(None, None, None, None, None, "k"), (1, "", "en", "a", 0, None), (1, "", "en", "a", 0, None), (2, "word " * 60, None, "a", 1, "x"), (3, " ".join(f"w{i}" for i in range(80)), "en", None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, sf_dir))
    assert empty.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(name, spark, sf_dir) -> None:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    found, wanted = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLE_SQL[name])
    order = sorted(found.columns)
    assert order == sorted(wanted.columns)
    assert sorted((tuple(r[c] for c in order) for r in found.collect()), key=repr) == sorted((tuple(r[wanted.columns.index(c)] for c in order) for r in wanted.fetchall()), key=repr)
