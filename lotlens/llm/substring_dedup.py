"""Substring deduplication by suffix automata of reference shards.

The reference is the corpus itself, so it grows with the input and can't be
broadcast. A shard is a bundle of the candidate texts of some seeds, of bounded
size; it is turned into one suffix automaton, and goes by shuffle to the very
texts that can match it. Each of these is streamed through the automaton; the
matching statistic at a word is the longest run of words up to it that the
shard holds, and the state of its last W words tells how often they occur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain
from .repeats import Bundle, Symbols, covered, keyed, spans, with_spans

WINDOW, GRAM = 35, 8


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    split = [t.split() for t in texts]
    digest = {w: xxhash.xxh3_64_intdigest(w) for w in set(chain.from_iterable(split))}
    sizes = np.array([len(x) for x in split], np.int64)
    return np.fromiter(map(digest.__getitem__, chain.from_iterable(split)), np.uint64, int(sizes.sum())), sizes


def _cut(text: bytes, ranges: list[tuple[int, int]]) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[a:b]) for a, b in ranges]


class SuffixAutomaton:
    """Of several sequences; counts the places at which each state's runs end, by the sequences' weights."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def add(self, sequence: list[int], weight: int) -> None:
        step, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            found = step[last].get(c)
            if found is not None and length[found] == length[last] + 1:
                last = found
            else:
                if found is None:
                    new, p = self._state(length[last] + 1, 0, {}), last
                    while p >= 0 and c not in step[p]:
                        step[p][c] = new
                        p = link[p]
                else:
                    new, p = -1, last
                if p >= 0:
                    q = step[p][c]
                    if length[q] != length[p] + 1:
                        copy = self._state(length[p] + 1, link[q], dict(step[q]))
                        while p >= 0 and step[p].get(c) == q:
                            step[p][c] = copy
                            p = link[p]
                        link[q] = copy
                        q = copy
                    if new >= 0:
                        link[new] = q
                    else:
                        new = q
                last = new
            self.count[last] += weight

    def close(self) -> None:
        """Every run also ends where the longer runs that it is a suffix of end."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def stream(self, sequence: list[int], window: int) -> Iterator[int]:
        """For each place from the window's first full one on, how often the last ``window`` symbols occur."""
        step, link, length = self.next, self.link, self.length
        at, matched = 0, 0
        for i, c in enumerate(sequence):
            while at > 0 and c not in step[at]:
                at = link[at]
                matched = length[at]
            if c in step[at]:
                at, matched = step[at][c], matched + 1
            while at and length[link[at]] >= window:
                at = link[at]
                matched = length[at]
            if i >= window - 1:
                yield self.count[at] if matched >= window else 0


def judge(bundle: Bundle) -> np.ndarray:
    """Per window how many places of the corpus hold it, 2 for more."""
    ids: dict[bytes, int] = {}
    texts = [[ids.setdefault(w, len(ids)) for w in content.split(b" ")] for content in bundle.contents]
    shard = SuffixAutomaton()
    for words, weight in zip(texts, bundle.weight.tolist(), strict=True):
        shard.add(words, weight)
    shard.close()
    counts = np.fromiter((c for words in texts for c in shard.stream(words, WINDOW)), np.int64, int(bundle.n.sum()))
    return np.minimum(counts, 2)


SYMBOLS = Symbols(WINDOW, GRAM, hashed_words, _cut, same_document=True, pieces=(7, 1))


def substring_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: int | None = None, digests: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, and kept_sha256, or with digests=False kept: the words left, joined by a space.

    A window of 35 consecutive words is removed wherever its words also start anywhere else, in the same document or
    another; repeated rows are different places. Words are judged on the input. Null and empty texts have no words;
    null ids stay null; doc_id must be an integer. Empty tables give no rows; other columns are ignored.
    """
    rows = keyed(plain(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")))
    found = spans(rows, SYMBOLS, judge, lambda value: value > 1, **({} if wide is None else {"wide": wide}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, kept = [], [], []
            for t, r in zip(b.column("text"), b.column("spans"), strict=True):
                words = t.as_py().encode("utf-8", "surrogateescape").split()
                n.append(len(words))
                if r.is_valid:
                    gone = covered(len(words), r.values.to_numpy(), WINDOW)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(n[-1] - len(words))
                joined = b" ".join(words)
                kept.append(hashlib.sha256(joined).hexdigest() if digests else joined.decode("utf-8", "surrogateescape"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256" if digests else "kept"])

    return with_spans(rows, found).mapInArrow(run, f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digests else 'kept'} string")
