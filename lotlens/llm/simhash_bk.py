"""SimHash near-duplicates, found by BK-trees over shards of fingerprints.

A BK-tree hangs every fingerprint below its parent by their integer Hamming
distance; a search within the radius follows only the edges whose distance
differs from the query's by the radius at most.

Any two fingerprints within radius r agree in at least one of r + 1 bit
blocks. A shard is the set of distinct fingerprints that hold one value in one
block, so every link lies within some shard, and a shard's tree goes only to
the fingerprints of that shard, by shuffle: the trees of all shards together
grow with the input and so aren't broadcast. A shard above ``max_shard`` is
split by the blocks of its remaining bits, again and again: of the fingerprints
that agree in all but b bits there are 2**b at most. A shard emits the links of
a spanning forest, not all pairs; copies of one fingerprint count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, stored, text_of
from .components import components

BITS, SHINGLE, SEED = 64, 3, 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the shingles' XXH64 values; no word: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - shingle + 1, 1)
    ends = ends[min(shingle, len(words)) - 1 :][:last].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends, strict=True)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # very long texts in pieces
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a signed long. One row per input row; null text counts as empty."""
    src = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, fp: int) -> None:
        if self.root is None:
            self.root = (fp, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ fp).bit_count()
            child = node[1].get(d)
            if child is None:
                node[1][d] = (fp, {})
                return
            node = child

    def within(self, fp: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (value ^ fp).bit_count()
            if d <= radius:
                found.append(value)
            if children:
                for k in range(d - radius, d + radius + 1):
                    if k in children:
                        todo.append(children[k])
        return found


def shard_links(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """(fp, root) of each fingerprint that the shard's tree links to others; roots are of the shard only."""
    tree, parent = BKTree(), {fp: fp for fp in fps}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for fp in fps:
        for other in tree.within(fp, radius):
            a, b = top(fp), top(other)
            parent[max(a, b)] = min(a, b)
        tree.add(fp)
    return [(fp, top(fp)) for fp in fps if top(fp) != fp]


def _split(free: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(free, parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, radius: int = 3, max_shard: int = 1024) -> DataFrame:
    """fps: distinct fp. Returns u, v: links that connect all fingerprints which a chain of steps of ``radius`` bits or fewer connects."""
    parts = radius + 1
    free = {0: list(range(BITS))}
    todo = fps.select("fp", F.lit(0).alias("path"))
    ready = None
    while True:
        children = {p * parts + i + 1: [x for x in bits if x not in set(block)] for p, bits in free.items() for i, block in enumerate(_split(bits, parts))}
        todo = todo.select("fp", F.explode(F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda i: F.col("path") * parts + i)).alias("path"))
        masks = F.create_map(*[F.lit(x) for p, bits in children.items() for x in (p, _signed((1 << BITS) - 1 - sum(1 << b for b in bits)))])
        keyed = stored(todo.select("fp", F.col("path").cast("int").alias("path"), F.col("fp").bitwiseAND(F.element_at(masks, F.col("path").cast("int"))).alias("key")))
        sizes = keyed.groupBy("path", "key").count()
        hot = stored(sizes.where(F.col("count") > max_shard).select("path", "key"))
        small = keyed.join(stored(sizes.where(F.col("count").between(2, max_shard)).select("path", "key")), ["path", "key"], "left_semi")
        ready = small if ready is None else ready.unionByName(small)
        if hot.isEmpty():
            break
        todo, free = keyed.join(hot, ["path", "key"], "left_semi").select("fp", "path"), children

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(groups: list[np.ndarray]) -> pa.RecordBatch:
            out = [x for g in groups for x in shard_links([int(v) for v in g.view(np.uint64)], radius)]
            both = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], ["u", "v"])

        held: list[np.ndarray] = []
        at = None
        for b in batches:
            path, key, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("path", "key", "fp"))
            if not len(fp):
                continue
            cuts = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
            pieces = np.split(fp, cuts)
            if at == (path[0], key[0]):
                pieces[0] = np.concatenate([held.pop(), pieces[0]])
            done = held + pieces[:-1]
            held, at = [pieces[-1]], (path[-1], key[-1])
            yield made(done)
        if held:
            yield made(held)

    return ready.repartition("path", "key").sortWithinPartitions("path", "key", "fp").mapInArrow(run, "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, max_shard: int = 1024, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id; one row per input row.

    component_id is the smallest doc_id that links of ``radius`` bits or fewer reach, the document itself
    included (null ids count only where no other is there). Texts without a word share the fingerprint zero,
    which links like any other. Null texts count as empty; empty tables give no rows; other columns are ignored.
    """
    found = stored(fingerprints(plain(docs, id_col, text_col), id_col, text_col, shingle))
    own = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(own.select("fp"), radius, max_shard))
    placed = stored(own.join(roots, own["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = stored(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = stored(placed.join(least, "root").select("fp", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.join(by_fp, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
