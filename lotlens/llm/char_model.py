"""Modified Kneser-Ney over the characters of a whole corpus.

An n-gram of ORDER characters is packed into one long, 21 bits a code point, so
counts, contexts and suffixes are exact. All n-grams of all documents are
counted in Spark and stay tables, without a bound on entries or languages; a
row per language is the only thing that joins broadcast.

Scored texts are the counted ones, so each of their n-grams has its own
probability and no weight of a lower order has to be looked up. The most
frequent n-grams, FREQUENT at most, go to every task as sorted arrays of hash
and logarithm; all others find theirs by a join. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

ORDER, CHAR_BITS = 3, 21
#: Bound of the broadcast n-grams. Results don't depend on it.
FREQUENT = 1_000_000
#: Characters that are packed at a time.
PIECE = 1_000_000


def slot(lang: str | None) -> int:
    """The language's key; null is a language of its own."""
    return xxhash.xxh64_intdigest(b"" if lang is None else b"=" + lang.encode("utf-8", "surrogatepass")) - (1 << 63)


def packed(text: str) -> Iterator[np.ndarray]:
    """The n-gram that ends at each character, in pieces; spaces stand before the text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.concatenate((np.full(ORDER - 1, 32, "<u4"), c)).astype(np.int64)
    for lo in range(0, len(c) - ORDER + 1, PIECE):
        size = min(PIECE, len(c) - ORDER + 1 - lo)
        out = c[lo : lo + size]
        for i in range(1, ORDER):
            out = out << CHAR_BITS | c[lo + i : lo + i + size]
        yield out


def hashes(at: int, grams: np.ndarray) -> np.ndarray:
    h = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(at & (1 << 64) - 1)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return (h * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """docs: lang, text. Returns slot, gram, h, n over every character of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        sizes: dict[int, int] = {}

        def sent(at: int) -> pa.RecordBatch:
            gram, n = np.unique(np.concatenate(held.pop(at)), return_counts=True)
            sizes.pop(at)
            columns = [np.full(len(gram), at, np.int64), gram, hashes(at, gram), n]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["slot", "gram", "h", "n"])

        for batch in batches:
            for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                at = slot(lang)
                for piece in packed(t.as_py() or ""):
                    held.setdefault(at, []).append(piece)
                    sizes[at] = sizes.get(at, 0) + len(piece)
                    if sizes[at] >= PIECE:
                        yield sent(at)
                    elif sum(sizes.values()) >= 2 * PIECE:  # many languages
                        yield sent(max(sizes, key=sizes.get))
        for at in list(held):
            yield sent(at)

    return docs.select("lang", "text").mapInArrow(run, "slot long, gram long, h long, n long").groupBy("slot", "gram", "h").agg(F.sum("n").alias("n"))


def _discounts(grams: DataFrame) -> DataFrame:
    """slot, d1, d2, d3, symbols: a row per language."""
    cut = grams.groupBy("slot").agg(*[F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count("*").alias("symbols"))
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))

    def discount(i: int) -> Column:  # 0.5 where the counts of counts can't tell
        d = i - (i + 1) * y * F.try_divide(f"n{i + 1}", f"n{i}")
        return F.when((F.col(f"n{i}") > 0) & (d > 0) & (d < i), d).otherwise(0.5)

    return cut.select("slot", "symbols", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])


def probabilities(counts: DataFrame) -> DataFrame:
    """slot, gram, h, n, p: interpolated probability of each n-gram's last character after the others.

    counts: stored slot, gram, h, n. Lower orders count in how many contexts an n-gram is found.
    """

    def last(k: int) -> Column:
        return F.col("gram").bitwiseAND(F.lit((1 << CHAR_BITS * k) - 1).cast("long"))

    by_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        by_order[k] = stored(by_order[k + 1].select("slot", last(k).alias("gram")).groupBy("slot", "gram").agg(F.count("*").alias("n")))
    lower = None
    for k in range(1, ORDER + 1):
        own = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        grams = by_order[k].join(F.broadcast(_discounts(by_order[k])), "slot").withColumns({"d": own, "before": F.shiftright("gram", CHAR_BITS)}).drop("d1", "d2", "d3")
        sums = grams.groupBy("slot", "before").agg(F.sum("n").alias("all_n"), F.sum("d").alias("all_d"))
        grams = grams.join(F.broadcast(sums) if k == 1 else sums, ["slot", "before"])  # order 1 has one context a language
        kept, backoff = (F.col("n") - F.col("d")) / F.col("all_n"), F.col("all_d") / F.col("all_n")
        if k == 1:
            p = grams.withColumn("p", kept + backoff / F.col("symbols"))
        else:
            p = grams.withColumn("low", last(k - 1)).join(lower, ["slot", "low"]).withColumn("p", kept + backoff * F.col("lower"))
        p = stored(p.select(*by_order[k].columns, "p"))
        lower = p.select("slot", F.col("gram").alias("low"), F.col("p").alias("lower"))
    return p


class Model:
    """logs: the n-grams that aren't in the arrays, as h, logp. keys, values: sorted hashes and logarithms of the most frequent ones."""

    def __init__(self, logs: DataFrame, keys: np.ndarray, values: np.ndarray) -> None:
        self.logs, self.keys, self.values = logs, keys, values


def fit(docs: DataFrame) -> Model:
    """docs: lang, text."""
    logs = stored(probabilities(stored(ngram_counts(docs))).select("h", F.floor(F.log2("n") * 16).cast("int").alias("bin"), F.log10("p").alias("logp")))
    least, total = None, 0
    for r in logs.groupBy("bin").count().orderBy(F.desc("bin")).collect():  # 1024 rows at most
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["bin"]
    top = logs.where(F.lit(False) if least is None else F.col("bin") >= least).select("h", "logp").toArrow()
    keys, values = top["h"].to_numpy(), top["logp"].to_numpy()
    order = np.argsort(keys)
    return Model(logs.where(F.lit(True) if least is None else F.col("bin") < least).select("h", "logp"), keys[order], values[order])


def known(text: str, at: int, keys: np.ndarray, values: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Characters, the frequent n-grams' sum of logarithms, hashes and counts of all other n-grams."""
    n, total, rare, counts = 0, 0.0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for grams in packed(text):
        g, f = np.unique(grams, return_counts=True)
        h = hashes(at, g)
        n += len(grams)
        if len(keys):
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[place] == h
            total += float((values[place[hit]] * f[hit]).sum())
            h, f = h[~hit], f[~hit]
        rare.append(h)
        counts.append(f)
    return n, total, np.concatenate(rare), np.concatenate(counts)
