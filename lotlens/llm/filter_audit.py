"""What each filter removes, alone and behind the others, in every order: a packed bitmap index.

A document fails a filter or not, carries a label or not, and belongs to a part.
Per batch of a partition the rows are laid out by part, each part from a new
word of 64 bits on, and every filter and label becomes one NumPy bitset in that
layout; a part is a range of words. For each subset of the filters the rows that
pass it are what AND-NOT leaves of the part, and popcounts say how many they are
and how many of them carry a label. These counts are sums over partitions, and
all that an order of the filters asks for is a difference of two of them: what
stands before a step and what stands after it.

So the work is one pass over the rows with 2^filters operations on bitsets, and
what leaves a task is a row for each part and subset; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, plain, stored

# The filters' letters, their symbols and limits.
FILTERS = "ABCDE"
SYMBOLS, LEAST_WORDS = b"#$%&*|", 200
LABELS = ("good", "toxic")
#: Bytes of a text whose words are held at once, and parts whose counts a task holds.
PIECE, HELD = 1 << 20, 50_000
_UPPER, _INNER, _SPACE = bytes(range(65, 91)), bytes(range(128, 192)), SPACE.encode()


def _words(text: bytes) -> tuple[int, int]:
    """Words and distinct words; no more of a text than PIECE is split at once."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        words = text[at:end].split()  # of bytes: at the six characters that part words
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def fails(text: bytes) -> int:
    """The filters A to D that a text fails, as bits from the least on."""
    n, distinct = _words(text)
    upper, points = len(text) - len(text.translate(None, _UPPER)), len(text.translate(None, _INNER))
    return (n < LEAST_WORDS) | (100 * distinct < 50 * n) << 1 | (100 * upper > 2 * points) << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask: one row per document; bits 0 to 4 are the filters A to E that it fails, then the labels it carries.

    E: an equal text (by SHA-256) has a smaller id. A null id is neither smaller nor larger than any. Of several
    labels of one id each counts that any row has; rows of one id that repeat all get them. Null texts are empty, null parts ''.
    """
    src = plain(docs, id_col, text_col, part_col).toDF("doc_id", "text", "part")
    id_type = src.schema["doc_id"].dataType.simpleString()
    keyed = src.select("doc_id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), F.col("text").cast("binary").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = pa.array([fails(t.as_py()) for t in b.column("text")], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("sha"), mask], ["doc_id", "part", "sha", "mask"])

    rows = stored(keyed.mapInArrow(run, f"doc_id {id_type}, part string, sha binary, mask int"))
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    carried = plain(labels, id_col, "quality", "toxic").toDF("doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(
        (F.max((F.col("quality") == 1).cast("int")) * 32).alias("good"), (F.max((F.col("toxic") == 1).cast("int")) * 64).alias("toxic")
    )
    repeats = F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    joined = rows.join(first, "sha", "left").select("doc_id", "part", (F.col("mask") + repeats).alias("mask"))
    of = carried.withColumnRenamed("doc_id", "labelled")
    return joined.join(of, joined["doc_id"] == of["labelled"], "left").select("part", (F.col("mask") + F.coalesce("good", F.lit(0)) + F.coalesce("toxic", F.lit(0))).alias("mask"))


def packed(parts: list[str], masks: np.ndarray, bits: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The index of a batch: its parts, the word where each begins, the bitset of all rows and one bitset per bit of the masks."""
    names, codes = np.unique(np.array(parts, dtype=object), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    sizes = np.bincount(codes, minlength=len(names))
    words = -(-sizes // 64)
    begin = np.concatenate([[0], np.cumsum(words)[:-1]])
    place = np.repeat(begin * 64 - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(masks))
    flat = np.zeros((bits + 1, int(words.sum()) * 64), np.bool_)
    flat[0, place] = True
    for k in range(bits):
        flat[k + 1, place] = masks[order] >> k & 1
    sets = np.packbits(flat, axis=1).view(np.uint64)
    return list(names), begin, sets[0], sets[1:]


def popcounts(begin: np.ndarray, all_rows: np.ndarray, sets: np.ndarray, filters: int) -> np.ndarray:
    """Per part, subset of the filters and (rows, rows of each label): how many pass every filter of the subset."""
    out = np.empty((len(begin), 1 << filters, 1 + len(sets) - filters), np.int64)
    left = np.empty((1 << filters, len(all_rows)), np.uint64)
    left[0] = all_rows
    for subset in range(1 << filters):
        if subset:
            last = subset.bit_length() - 1
            left[subset] = left[subset & ~(1 << last)] & ~sets[last]  # AND-NOT with what the smaller subset left
        for k, label in enumerate([all_rows, *sets[filters:]]):
            out[:, subset, k] = np.add.reduceat(np.bitwise_count(left[subset] & label).astype(np.int64), begin)
    return out


def subset_counts(rows: DataFrame, filters: int = len(FILTERS), labels: tuple[str, ...] = LABELS) -> DataFrame:
    """part, subset, n, and n of each label: rows of the part that pass all filters of the subset (bits). rows: part, mask."""
    names = ["n", *labels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def rows_of() -> pa.RecordBatch:
            counts = np.stack(list(held.values())).reshape(-1, len(names))
            subset = np.tile(np.arange(1 << filters, dtype=np.int32), len(held))
            part = pa.array([p for p in held for _ in range(1 << filters)], pa.string())
            return pa.RecordBatch.from_arrays([part, pa.array(subset), *[pa.array(counts[:, k]) for k in range(len(names))]], ["part", "subset", *names])

        for b in batches:
            if not b.num_rows:
                continue
            found, begin, everything, sets = packed(b.column("part").to_pylist(), b.column("mask").to_numpy(), filters + len(labels))
            for part, counts in zip(found, popcounts(begin, everything, sets, filters), strict=True):
                held[part] = held[part] + counts if part in held else counts
            if len(held) > HELD:
                yield rows_of()
                held.clear()
        if held:
            yield rows_of()

    schema = "part string, subset int, " + ", ".join(f"{n} long" for n in names)
    return rows.select("part", "mask").mapInArrow(run, schema).groupBy("part", "subset").agg(*[F.sum(n).alias(n) for n in names])


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: each order of the filters, each step.

    counts: as ``subset_counts`` gives them. shapley is the sum over all orders of what the step's filter removes there:
    a subset stands before the filter in as many orders as its own and the others' permutations. No counts give no rows.
    """
    k, full = len(filters), (1 << len(filters)) - 1
    steps = [(order, i, order[i]) for order in permutations(range(k)) for i in range(k)]
    before = [sum(1 << f for f in order[:i]) for order, i, _ in steps]
    own = [1 << f for _, _, f in steps]
    # One row per part: the counts of its subsets, in order of the subset; of fixed length.
    of_part = counts.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))), lambda s: F.struct(s["n"].alias("n"), s["good"].alias("good"), s["toxic"].alias("toxic"))).alias("c"))
    shapley = []
    for f in range(k):
        terms = [(factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()), s) for s in range(full + 1) if not s >> f & 1]
        shapley.append(sum((F.lit(w).cast("long") * (F.col("c")[s]["n"] - F.col("c")[s | 1 << f]["n"]) for w, s in terms), F.lit(0).cast("long")))
    summed = of_part.withColumn("shapley", F.array(*shapley))
    at = summed.select("part", "c", "shapley", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("i")).select(
        "part", "c", "shapley",
        F.element_at(F.lit(["".join(filters[f] for f in order) for order in permutations(range(k))]), F.expr(f"i div {k} + 1").cast("int")).alias("filter_order"), (F.col("i") % k + 1).cast("int").alias("step"),
        F.get(F.lit(before), F.col("i")).alias("before"), F.get(F.lit(own), F.col("i")).alias("own"), F.get(F.lit([f for _, _, f in steps]), F.col("i")).alias("f"),
    )
    n = lambda subset, what="n": F.get(F.col("c"), subset)[what]
    after, alone, others = F.col("before") + F.col("own"), n(F.lit(0)) - n(F.col("own")), F.lit(full) - F.col("own")
    removed = n(F.col("before")) - n(after)
    return at.select(
        "part", "filter_order", "step", n(after).alias("kept"), removed.alias("removed"), (alone - removed).alias("redundant"), (n(others) - n(F.lit(full))).alias("unique_fails"),
        *[(n(F.col("before"), what) - n(after, what)).alias(f"{what}_lost") for what in LABELS], F.get(F.col("shapley"), F.col("f")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of five filters over whole texts: under 200 words; under half of the words distinct; over 2 % capitals; a symbol; an equal text with a smaller id.

    An empty table gives no rows; other columns are ignored. Nulls and repeats are as ``failures`` says.
    """
    return audit(subset_counts(failures(docs, labels, id_col, text_col, part_col)))
