"""Quality rules: simple counts, and perplexity bands of a modified Kneser-Ney model.

One model counts the characters of the whole corpus (``char_model``), so that a
document that changes its language isn't improbable for that alone. Each language
has its own band of perplexities, from the histogram of all its documents'
log-perplexities: the median, less and plus ``BAND`` times the distance to the
quartile on that side. Documents outside are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import char_model
from .common import WORD, free_names, plain, stored

#: Width of a band in spreads, least spread in log10, and width of a histogram's bins.
BAND, LEAST_SPREAD, BIN = 4.0, 0.005, 0.001
MIN_WORDS, MAX_REPEATED = 50, 0.5
SYMBOLS = frozenset("#*$%&|<>")


def _repeats(words: list[str]) -> int:
    """Words in 3-word windows found twice or more in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
    _, which, count = np.unique(pairs[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[which] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[hit + k] = True
    return int(covered.sum())


def rule_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), _repeats(words)


def bands(perplexities: DataFrame, width: float = BAND) -> DataFrame:
    """slot, low, high: a language's least and greatest log-perplexity. perplexities: slot, logppl; null logppl doesn't count.

    From the whole histogram, whose bins are bounded: the median, and as spread on either side the distance to the
    quartile, LEAST_SPREAD at least.
    """
    bins = perplexities.where("logppl is not null").groupBy("slot", F.floor(F.col("logppl") / BIN).alias("bin")).count()
    of = Window.partitionBy("slot")  # a row per bin
    share = bins.select("slot", "bin", (F.sum("count").over(of.orderBy("bin")) / F.sum("count").over(of)).alias("share"))
    q = share.groupBy("slot").agg(*[(F.min(F.when(F.col("share") >= x, F.col("bin"))) * BIN).alias(name) for x, name in ((0.25, "q1"), (0.5, "mid"), (0.75, "q3"))])
    spread = lambda d: F.greatest(d, F.lit(LEAST_SPREAD))
    return q.select("slot", (F.col("mid") - width * spread(F.col("mid") - F.col("q1"))).alias("low"), (F.col("mid") + width * spread(F.col("q3") - F.col("mid")) + BIN).alias("high"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: float = BAND) -> DataFrame:
    """Returns doc_id, __row (a hash of lang and text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, logppl,
    low, high, kept; one row per input row.

    Null texts count as empty: no words, base_failed, logppl null. Every language, null too, has a band of its own. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    src = plain(docs, id_col, lang_col, text_col).toDF("doc_id", "lang", "text").select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = char_model.fit(src.select(F.lit(None).cast("string").alias("lang"), "text"))
    whole = char_model.slot(None)
    shared = spark.sparkContext.broadcast((model.keys, model.values))
    id_type = src.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = shared.value
        for b in batches:
            found, at, chars, logs, rare, counts = [], [], [], [], [], []
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                text = t.as_py()
                found.append(rule_counts(text))
                at.append(char_model.slot(lang))
                n, total, h, f = char_model.known(text, whole, keys, values)
                for column, x in zip((chars, logs, rare, counts), (n, total, h, f), strict=True):
                    column.append(x)
            own = np.array(found, np.int64).reshape(-1, len(names))
            ends = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64())) for x in (rare, counts)]
            columns = [b.column("doc_id"), b.column("__row"), pa.array(at, pa.int64()), pa.array(chars, pa.int64()), pa.array(logs, pa.float64()), *lists]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(own[:, i], pa.int64()) for i in range(len(names))], ["doc_id", "__row", "slot", "chars", "logs", "rare", "counts", *names])

    rows = src.withColumn("__row", F.xxhash64("lang", "text")).mapInArrow(run, f"doc_id {id_type}, __row long, slot long, chars long, logs double, rare array<long>, counts array<long>, {', '.join(f'{n} long' for n in names)}")
    rows = stored(rows.withColumn("__at", F.monotonically_increasing_id()))
    others = rows.select("__at", F.explode(F.arrays_zip("rare", "counts")).alias("r")).select("__at", F.col("r.rare").alias("h"), F.col("r.counts").alias("f"))
    others = others.join(model.logs, "h").groupBy("__at").agg(F.sum(F.col("f") * F.col("logp")).alias("others"))
    logppl = F.when(F.col("chars") > 0, F.round(-(F.col("logs") + F.coalesce("others", F.lit(0.0))) / F.col("chars"), 9))
    scored = stored(rows.drop("rare", "counts").join(others, "__at", "left").select("doc_id", "__row", "slot", *names, logppl.alias("logppl")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > F.lit(round(100 * MAX_REPEATED)) * F.col("n_words"))
    judged = scored.join(F.broadcast(stored(bands(scored, width))), "slot", "left").withColumn("base_failed", failed)  # a row per language
    inside = F.coalesce(F.col("logppl").between(F.col("low"), F.col("high")), F.lit(False))
    return judged.select("doc_id", "__row", *names, "base_failed", "logppl", "low", "high", (~F.col("base_failed") & inside).alias("kept"))


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: float = BAND) -> DataFrame:
    """The input rows that ``quality`` keeps, with all their columns; repeated rows stay repeated."""
    own, theirs, row = free_names(docs, "own", "id", "row")
    kept = quality(docs, id_col, text_col, lang_col, width).where("kept").select(F.col("doc_id").alias(theirs), F.col("__row").alias(row))
    keyed = docs.withColumn(own, F.xxhash64(F.col(f"`{lang_col}`").cast("string"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    return keyed.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col(theirs)) & (F.col(own) == F.col(row)), "left_semi").drop(own)


def perplexity(logppl: float) -> float:
    return math.pow(10.0, logppl)
