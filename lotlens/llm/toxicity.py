"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed to embeddings; filters of several widths slide over the whole
text; each filter's maximum feeds a logistic output. The score sees the text
only. Thresholds by language are calibrated on labelled rows kept from training.

Training takes every labelled row of the other folds, whole. A round deals all
rows anew to shards of some SHARD rows by a hash; a task goes through a shard's
rows one by one, from the model of the round's beginning, and what its shards
changed is averaged by parameter: dense ones over all shards, a word's vector
over those that moved it. Changes are summed as whole numbers, so that the order
of tasks doesn't matter. The driver holds the model, whose size ``BUCKETS``
bounds, never rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_column, plain, stored

#: Rows that a task learns from in a row before shards are averaged.
SHARD = 4096
BUCKETS, DIM, FILTERS, WIDTHS, EPOCHS = 1 << 20, 8, 8, (1, 2, 3), 8
#: A word needs so many training texts for a vector of its own.
LEAST = 3
RATE = 0.08
#: Words of a text that are taken at once.
PIECE = 1 << 16
#: Units of a change and of a logit that are summed or counted as whole numbers.
_MOVE, _GROWN, _CELL = 2.0**32, 2.0**24, 1024
#: Rows of the model's array: filters' weights by width, place and filter, then those of the output, biases of filters, the output's; after them a row of zeros for all other words.
_TAPS, _FEATURES = FILTERS * sum(WIDTHS), FILTERS * len(WIDTHS)
_DENSE = -(-(_TAPS * DIM + 2 * _FEATURES + 1) // DIM)
_FEATURE = np.array([i * FILTERS + f for i, k in enumerate(WIDTHS) for _ in range(k) for f in range(FILTERS)])
_SHIFT = np.array([j for k in WIDTHS for j in range(k) for _ in range(FILTERS)])
_TOKEN = re.compile(r"[^\W_]+")


class Hashed:
    """Buckets of words; a bounded cache."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        seen, out = self.seen, []
        for w in _TOKEN.findall(text.lower()):
            if (k := seen.get(w)) is None:
                k = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
                if len(seen) < 200_000:
                    seen[w] = k
            out.append(k)
        return np.array(out, np.int64)


class TextCNN:
    def __init__(self, buckets: np.ndarray | None = None, seed: int = 7) -> None:
        """buckets: those of words with a vector of their own, sorted."""
        rng = np.random.default_rng(seed)
        self.rows = np.zeros(0, np.int64) if buckets is None else buckets
        self.values = np.zeros((_DENSE + 1 + len(self.rows), DIM), np.float32)
        taps, out, _, _ = self._dense()
        taps[:], out[:] = rng.normal(0, 0.5, taps.shape), rng.normal(0, 0.3, out.shape)
        self.values[_DENSE + 1 :] = 0.1 * rng.standard_normal((len(self.rows), DIM), np.float32)
        self.sums: np.ndarray | None = None  # AdaGrad's, while it learns
        self.slope, self.shift = 1.0, 0.0
        self.table: np.ndarray | None = None

    def _dense(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Views of the filters' weights, the output's, the filters' biases and the output's."""
        rest = self.values[_TAPS:_DENSE].reshape(-1)
        return self.values[:_TAPS], rest[:_FEATURES], rest[_FEATURES : 2 * _FEATURES], rest[2 * _FEATURES :][:1]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def embedded(self, buckets: np.ndarray) -> np.ndarray:
        """Rows of ``values`` by word."""
        if self.table is None:
            self.table = np.full(BUCKETS, _DENSE, np.int32)
            self.table[self.rows] = np.arange(_DENSE + 1, len(self.values))
        return self.table[buckets]

    def forward(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pooled features, the place of each one's maximum, and the padded word rows. at: rows of self.values."""
        taps, _, b, _ = self._dense()
        wide = max(WIDTHS)
        at = np.concatenate((at, np.full(wide, _DENSE, at.dtype)))
        windows = len(at) - wide + 1
        best, place, every = np.full(_FEATURES, -np.inf, np.float32), np.zeros(_FEATURES, np.int64), np.arange(FILTERS)
        for lo in range(0, windows, PIECE):  # very long texts in pieces that overlap
            n = min(PIECE, windows - lo)
            y, row = taps @ self.values[at[lo : lo + n + wide - 1]].T, 0
            for i, k in enumerate(WIDTHS):
                z = y[row : row + FILTERS, :n]
                for j in range(1, k):
                    z = z + y[row + j * FILTERS : row + (j + 1) * FILTERS, j : j + n]
                row += k * FILTERS
                here, own = z.argmax(axis=1), slice(i * FILTERS, (i + 1) * FILTERS)
                top = z[every, here]
                place[own], best[own] = np.where(top > best[own], here + lo, place[own]), np.maximum(best[own], top)
        return np.tanh(best + b), place, at

    def logit(self, buckets: np.ndarray) -> float:
        h, _, _ = self.forward(self.embedded(buckets))
        _, out, _, bias = self._dense()
        return float(h @ out + bias[0])

    def score(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -30, 30))))

    def learn(self, buckets: np.ndarray, label: int, weight: float) -> None:
        """A step of AdaGrad."""
        h, place, at = self.forward(self.embedded(buckets))
        taps, out, _, bias = self._dense()
        d = (1 / (1 + np.exp(-np.clip(float(h @ out + bias[0]), -30, 30))) - label) * weight
        if abs(d) < 1e-3:
            return
        back, rows = d * out * (1 - h * h), at[place[_FEATURE] + _SHIFT]
        g = back[_FEATURE][:, None]
        to_words, to_taps = g * taps, g * self.values[rows]
        grad = np.concatenate((to_taps.reshape(-1), d * h, back, [d])).astype(np.float32)
        dense, seen = (x[:_DENSE].reshape(-1)[: len(grad)] for x in (self.values, self.sums))
        seen += grad * grad
        dense -= RATE * grad / np.sqrt(seen)
        own = rows > _DENSE
        at, grad = (rows[own][:, None] * DIM + np.arange(DIM)).reshape(-1), to_words[own].reshape(-1)
        vectors, seen = self.values.reshape(-1), self.sums.reshape(-1)
        np.add.at(seen, at, grad * grad)
        np.subtract.at(vectors, at, RATE * grad / np.sqrt(seen[at]))

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> None:
        """Platt scaling with the slope kept positive: gradient steps on two numbers."""
        if len(set(labels.tolist())) < 2:
            return
        share = counts / counts.sum()
        center = float(share @ logits)
        scale = max(float(np.sqrt(share @ (logits - center) ** 2)), 1e-3)
        x, a, b = (logits - center) / scale, 1.0, 0.0
        for _ in range(2000):
            e = share * (1 / (1 + np.exp(-(a * x + b))) - labels)
            a, b = max(a - 0.3 * ((e * x).sum() + 1e-3 * a), 1e-2), b - 0.3 * e.sum()
        self.slope, self.shift = a / scale, b - a * center / scale


def _word_lists(b: pa.RecordBatch) -> list[np.ndarray]:
    column = b.column("words")
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, lang, toxic, kept and words of all rows that may be learnt from, one a document."""
    mine = fold_column(F.col("doc_id")) != 0
    marked = labels.where(F.col("toxic").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(mine & F.col("toxic").isin(0, 1))
    src = plain(docs, id_col, lang_col, text_col).toDF("doc_id", "lang", "text").where(mine).select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Labels grow as documents do, so neither is broadcast. Of several rows of a document the least text counts, then the least language.
    found = src.join(marked.hint("merge"), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "toxic")).alias("row")).select("doc_id", "row.*")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Hashed()
        for b in batches:
            columns = [b.column(c) for c in ("doc_id", "lang", "toxic")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([words(t.as_py()).astype(np.int32) for t in b.column("text")], pa.list_(pa.int32()))], ["doc_id", "lang", "toxic", "words"])

    rows = found.mapInArrow(cut, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang string, toxic int, words array<int>")
    return stored(rows.withColumn("kept", F.crc32(F.concat(F.lit("keep"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0))


def _own_buckets(rows: DataFrame) -> np.ndarray:
    """Buckets that ``LEAST`` texts hold, sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for words in _word_lists(b):
                n[np.unique(words)] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    counted = stored(rows.select("words").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).select("bucket"))
    return np.sort(counted.toArrow()["bucket"].to_numpy()).astype(np.int64)


def _learn_round(rows: DataFrame, model: TextCNN, weights: tuple[float, float], number: int, shards: int) -> None:
    """The model after all rows were learnt from, each once."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def moved(now: TextCNN) -> pa.RecordBatch:
        at = np.flatnonzero((now.sums != shared.value.sums).any(axis=1))
        by = np.rint((now.values[at].astype(np.float64) - shared.value.values[at]) * _MOVE).astype(np.int64)
        grown = np.rint((np.sqrt(now.sums[at], dtype=np.float64) - np.sqrt(shared.value.sums[at], dtype=np.float64)) * _GROWN).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *map(pa.array, by.T), *map(pa.array, grown.T)], ["row", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now = None, None
        for b in batches:
            for own, toxic, words in zip(b.column("shard").to_pylist(), b.column("toxic").to_pylist(), _word_lists(b), strict=True):
                if own != shard:
                    if now is not None:
                        yield moved(now)
                    shard, now = own, copy(shared.value)
                    now.values, now.sums = now.values.copy(), now.sums.copy()
                now.learn(words, toxic, weights[toxic])
        if now is not None:
            yield moved(now)

    names = [f"{c}{i}" for c in "mg" for i in range(DIM)]
    key = F.xxhash64(F.lit(number), "doc_id")
    dealt = rows.select(F.pmod(key, F.lit(shards)).alias("shard"), key.alias("key"), "doc_id", "toxic", "words").repartition(2 * shards, "shard").sortWithinPartitions("shard", "key", "doc_id")
    changes = dealt.mapInArrow(run, f"row int, {', '.join(f'{c} long' for c in names)}").groupBy("row").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names])
    found = stored(changes.select("row", *[(F.col(c) / F.col("n") / F.lit(_MOVE if c[0] == "m" else _GROWN)).cast("float").alias(c) for c in names])).toArrow()
    for b in found.to_batches():
        at, means = b.column("row").to_numpy(), np.stack([b.column(c).to_numpy() for c in names], axis=1)
        model.values[at] += means[:, :DIM]
        model.sums[at] = (np.sqrt(model.sums[at]) + means[:, DIM:]) ** 2
    shared.destroy()


def _thresholds(cells: DataFrame, model: TextCNN) -> dict[str, float]:
    """The cut with the greatest F1, midway between neighbours, of each language with both labels. cells: lang, cell, n, hits."""
    down = Window.partitionBy("lang").orderBy(F.desc("cell"))
    f1 = 2 * F.sum("hits").over(down) / (F.sum("n").over(down) + F.sum("hits").over(Window.partitionBy("lang")))
    cuts = cells.select("lang", "cell", "n", "hits", f1.alias("f1"), F.lead("cell").over(down).alias("next"))
    best = cuts.groupBy("lang").agg(F.max_by(F.struct("cell", "next"), F.struct("f1", "cell")).alias("cut"), F.sum("n").alias("n"), F.sum("hits").alias("hits")).where("hits > 0 and hits < n")
    return {lang: model.score((cell if below is None else (cell + below + 1) / 2) / _CELL) for lang, (cell, below) in best.select("lang", "cut").collect()}  # a row a language


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[TextCNN, dict[str, float]]:
    """Returns the model and the thresholds by language, for those whose rows hold both labels.

    Rows whose crc32(doc_id as text) mod 5 is 0 are never looked at. Of several labels of a document the greatest
    counts; null labels don't. Of several texts of a document the least counts. A fifth of the rows is kept from training, for calibration and thresholds.
    """
    rows = _labelled(docs, labels, id_col, text_col, lang_col)
    n = {(r["kept"], r["toxic"]): r["count"] for r in rows.groupBy("kept", "toxic").count().collect()}
    zeros, ones = n.get((False, 0), 0), n.get((False, 1), 0)
    model = TextCNN()
    if ones + zeros:
        learnt = rows.where(~F.col("kept"))
        model = TextCNN(_own_buckets(learnt))
        model.sums = np.full_like(model.values, 1e-3)
        weights = tuple(0.5 * (ones + zeros) / max(c, 1) for c in (zeros, ones))
        for number in range(EPOCHS):
            _learn_round(learnt, model, weights, number, -(-(ones + zeros) // SHARD))
        model.sums = None
    if not any(kept for kept, _ in n):
        return model, {}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [int(np.floor(shared.value.logit(words) * _CELL)) for words in _word_lists(b)]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("toxic"), pa.array(cells, pa.int32())], ["lang", "toxic", "cell"])

    cells = rows.where("kept").select("lang", "toxic", "words").mapInArrow(placed, "lang string, toxic int, cell int")
    cells = stored(cells.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "cell").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits")))
    shared.destroy()
    by_cell = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).orderBy("cell").toArrow()  # the model's output bounds its cells
    at, n, hits = (by_cell[c].to_numpy() for c in ("cell", "n", "hits"))
    logits, counts = np.tile((at + 0.5) / _CELL, 2), np.concatenate((n - hits, hits))
    model.calibrate(logits[counts > 0], np.repeat([0.0, 1.0], len(at))[counts > 0], counts[counts > 0])
    return model, _thresholds(cells, model)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, score, predicted, threshold and flagged (by language); one row per input row.

    Null texts count as empty and are scored like any text without words. A null language, or one without
    labelled rows, has the threshold 0.5. Without labels all scores are equal. Other columns are ignored.
    """
    model, thresholds = train(docs, labels, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = plain(docs, id_col, lang_col, text_col).toDF("doc_id", "lang", "text").select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Hashed()
        for b in batches:
            scores = [shared.value.score(shared.value.logit(cut(t.as_py()))) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(scores, pa.float64())], ["doc_id", "lang", "score"])

    scored = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang string, score double")
    edges = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]) if thresholds else None
    edge = F.coalesce(F.try_element_at(edges, F.coalesce("lang", F.lit(""))), F.lit(0.5)) if thresholds else F.lit(0.5)
    return scored.select("doc_id", (fold_column(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), edge.alias("threshold"), (F.col("score") >= edge).alias("flagged"))
