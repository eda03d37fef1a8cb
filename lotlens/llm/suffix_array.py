"""Suffix-array deduplication with a linear grouping construction.

The suffix array is built without renaming: suffixes are grouped by their
longest Lyndon prefix. Groups begin as first symbols and are processed from the
highest down; each suffix of a group points to the nearest suffix on its left
that is in a lower group, its previous smaller one, and those pointed to move
up, right behind the group they leave: their prefix has grown by the group's.
When all groups are processed their order is final, and the order within them
follows from one pass over the array that is being made: each suffix in it
places the suffixes whose Lyndon prefix ends where it begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain
from .repeats import Bundle, Grams, Symbols, covered, keyed, spans, with_spans

WINDOW, GRAM = 50, 20
_rng = np.random.default_rng(50)
BYTE_HASH = _rng.integers(1, 2**63, 256, dtype=np.uint64)


def hashed_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_HASH[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(t) for t in texts], np.int64)


def suffix_array(s: list[int]) -> list[int]:
    """The starts of all suffixes of s, smallest suffix first."""
    size = len(s)
    # Groups are numbers; above and below link them by rank. Group 0 holds the end of the text, below all symbols.
    first = {c: g + 1 for g, c in enumerate(sorted(set(s)))}
    count = len(first) + 1
    below, above = list(range(-1, count - 1)), [*range(1, count), -1]
    group = [first[c] for c in s]
    members: list[list[int]] = [[] for _ in range(count)]
    members[0].append(size)
    for i, g in enumerate(group):
        members[g].append(i)
    live = [len(m) for m in members]
    length, previous, ready = [1] * size, [-1] * size, [False] * count

    def raised(some: list[int], g: int) -> None:
        """A new group right above g for some of its members."""
        new, up = len(members), above[g]
        members.append(some)
        live.append(len(some))
        ready.append(False)
        below.append(g)
        above.append(up)
        above[g] = below[up] = new
        live[g] -= len(some)
        for p in some:
            group[p] = new

    at = count - 1
    while at > 0:
        if live[at]:
            inside = members[at]
            if live[at] != len(inside):
                inside = [i for i in inside if group[i] == at]
            inside.sort()
            ready[at] = True
            pointed: dict[int, int] = {}
            for i in inside:
                p = i - 1
                while p >= 0 and ready[group[p]]:
                    p = previous[p]
                previous[i] = p
                if p >= 0:
                    pointed[p] = pointed.get(p, 0) + 1
            grown = length[inside[0]]
            if len(pointed) == 1:
                for p, times in pointed.items():
                    length[p] += grown * times
                    if live[group[p]] > 1:  # alone it stays: there is nothing to move past
                        raised([p], group[p])
            elif pointed:
                moved: dict[tuple[int, int], list[int]] = {}
                for p, times in pointed.items():
                    length[p] += grown * times
                    moved.setdefault((-times, group[p]), []).append(p)
                for (_, g), some in sorted(moved.items()):
                    if len(some) < live[g]:
                        raised(some, g)
        at = below[at]
    place, free = 0, [0] * len(members)
    at = 0
    while at >= 0:
        free[at] = place
        place += live[at]
        at = above[at]
    # last, before: the suffixes whose prefix ends at a place, as a chain.
    last, before = [-1] * (size + 1), [-1] * size
    for i, n in enumerate(length):
        before[i] = last[i + n]
        last[i + n] = i
    out = [size] * (size + 1)
    for k in range(size + 1):
        i = last[out[k]]
        while i >= 0:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            i = before[i]
    return out[1:]


def _order(right: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the records' right contexts, and of their left ones, from one suffix array over words of 8 bytes.

    right, left: a row of words per record. In the text each context stands behind a mark, which is less than all words.
    """
    words, names = np.unique(np.concatenate((right, left)), return_inverse=True)
    names = names.reshape(2 * len(right), -1) + 1
    width = names.shape[1] + 1
    text = np.concatenate((names, np.zeros((len(names), 1), names.dtype)), axis=1).reshape(-1)
    array = np.array(suffix_array(text.tolist()), np.int64)
    record = array[array % width == 0] // width
    return record[record < len(right)], record[record >= len(right)] - len(right)


def _common(order: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """How many bytes each context in the order shares with the one before it; -1 for the first."""
    ordered = contexts[order]
    differ = ordered[1:] != ordered[:-1]
    return np.concatenate(([-1], np.where(differ.any(axis=1), differ.argmax(axis=1), contexts.shape[1])))


def judge(bundle: Bundle) -> np.ndarray:
    """Per window the smallest doc_id that holds it.

    A record is a place of the seed in a text, with up to WINDOW - GRAM bytes to its right, and as many to its left, read
    backward. A window holds d bytes of the right context and WINDOW - GRAM - d of the left one. In the suffix array
    contexts that share d bytes stand next to each other, so windows are equal if no neighbour with fewer common bytes
    parts them, on both sides.
    """
    reach, words = WINDOW - GRAM, -(-(WINDOW - GRAM) // 8)
    size = 8 * words
    data = np.frombuffer(b"".join(bundle.contents), np.uint8)
    lengths = bundle.n + WINDOW - 1
    begin = np.cumsum(lengths) - lengths
    flat = np.cumsum(bundle.n) - bundle.n
    # Places of each text's seed, in all texts at once: no gram crosses a border.
    owner = np.repeat(np.arange(len(lengths)), lengths)
    hit = np.flatnonzero(Grams(BYTE_HASH[data]).all(GRAM).view(np.int64) == bundle.keys[owner[: len(data) - GRAM + 1]])
    of = owner[hit]
    place = hit - begin[of]
    inside = place + GRAM <= lengths[of]
    of, place = of[inside], place[inside]
    # A window belongs to the first place of the seed in it.
    before = np.where(np.concatenate(([True], of[1:] != of[:-1])), -1, np.concatenate(([-1], place[:-1])))
    lo, hi = np.maximum(before + 1, place - reach), np.minimum(place, bundle.n[of] - 1)
    span = np.arange(size)
    to_right = place[:, None] + GRAM + span
    to_left = place[:, None] - 1 - span
    right = np.where((to_right < lengths[of][:, None]) & (span < reach), data[np.minimum(begin[of][:, None] + to_right, len(data) - 1)], 0).astype(np.uint8)
    left = np.where((to_left >= 0) & (span < reach), data[np.maximum(begin[of][:, None] + to_left, 0)], 0).astype(np.uint8)
    by_right, by_left = _order(right.view(">u8").astype(np.uint64), left.view(">u8").astype(np.uint64))
    common_right, common_left = _common(by_right, right), _common(by_left, left)
    _, seed = np.unique(bundle.seeds, return_inverse=True)
    values = np.repeat(bundle.least, bundle.n)
    rank = np.empty((2, len(of)), np.int64)
    for d in range(reach + 1):
        at = place - (reach - d)
        some = np.flatnonzero((at >= lo) & (at <= hi))
        if not len(some):
            continue
        rank[0, by_right] = np.cumsum(common_right < d)
        rank[1, by_left] = np.cumsum(common_left < reach - d)
        r, x, s = rank[0, some], rank[1, some], seed[of[some]]
        order = np.lexsort((s, x, r))
        r, x, s = r[order], x[order], s[order]
        first = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (x[1:] != x[:-1]) | (s[1:] != s[:-1]))))
        low = np.minimum.reduceat(bundle.least[of[some[order]]], first)
        values[(flat[of] + at)[some[order]]] = np.repeat(low, np.diff(np.append(first, len(order))))
    return values


def _cut(data: bytes, ranges: list[tuple[int, int]]) -> list[bytes]:
    return [data[a:b] for a, b in ranges]


SYMBOLS = Symbols(WINDOW, GRAM, hashed_bytes, _cut, same_document=False)


def byte_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: int | None = None, digests: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, and kept_sha256, or with digests=False kept: the bytes left.

    A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller doc_id. Rows with
    the same doc_id don't take from each other; a null id is greater than all others. Null and empty texts have no
    bytes; doc_id must be an integer. Empty tables give no rows; other columns are ignored.
    """
    rows = keyed(plain(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")))
    found = spans(rows, SYMBOLS, judge, lambda value: value < F.col("doc_id"), **({} if wide is None else {"wide": wide}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(4)]
            for t, r in zip(b.column("text"), b.column("spans"), strict=True):
                data = t.as_py().encode("utf-8", "surrogateescape")
                kept, n_spans = data, 0
                if r.is_valid:
                    gone = covered(len(data), r.values.to_numpy(), WINDOW)
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    n_spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) > 0).sum())
                for column, x in zip(out, (len(data), len(data) - len(kept), n_spans, hashlib.sha256(kept).hexdigest() if digests else kept), strict=True):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string() if digests else pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, t) for x, t in zip(out, types, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digests else "kept"])

    return with_spans(rows, found).mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {'kept_sha256 string' if digests else 'kept binary'}")
