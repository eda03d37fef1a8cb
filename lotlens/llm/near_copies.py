"""Near copies by SimHash of five-word shingles, checked by exact Jaccard similarity.

Texts of Jaccard similarity 0.8 have fingerprints some 10 of 64 bits apart and
need a wide radius, at which bits in common no longer part the corpus. Shards
therefore hold the fingerprints whose MinHash agrees in one of BANDS bands of
WIDTH values: a pair at 0.8 misses all bands with a probability of 3e-6. A
BK-tree searches each shard, and every link is held against the shingles.

Links are made in two rounds, and a task holds neither a shard nor its pairs. In
the first the tree holds leaders: a text is linked to its nearest leader within
the radius, or is a leader itself, so that a large group of near copies costs a
look at a few leaders for each. Texts come in the order of their distance to the
shard's middle, the fingerprint of most of its bits, so that the text that others
are copies of leads. A pair is only given if the MinHash values that it shares
let its similarity be LIKELY or more; at 0.8 that misses a pair with a
probability of 1e-6. In the second the shards give all pairs within
the radius that the checked links of the first have not connected: components
come from the smallest on, and the largest only looks for the others. Texts of a
shard of more than HEAVY rows bring their shingles along, so that of such a shard
only links are given, and none that those before it make needless.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of
from .components import components
from .simhash_bk import SEED, BKTree, fingerprint

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
BANDS, WIDTH = 24, 4
#: Share of the MinHash values, of which a byte is kept, that a pair needs.
LIKELY = 0.6
#: Rows of a shard above which its texts are compared by their shingles, and shingles that a text is known by.
HEAVY, KNOWN = 64, 2048
#: How much lower the similarity of longer texts may be in the shingles that they are known by: at 0.8 that misses a pair with a probability of 1e-6.
SLACK = 0.06
#: Pairs that a task gathers before it sends them on.
SENT = 100_000
_RANDOM = np.random.default_rng(SEED)
_MULTIPLIERS = _RANDOM.integers(1, 1 << 63, BANDS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 values of the text's shingles, as ``fingerprint`` cuts them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), SEED) for i in range(max(len(words) - size + 1, 1))], np.uint64))


def signature(values: np.ndarray) -> tuple[list[int], bytes]:
    """A key for each band, and a byte of each MinHash value."""
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(values), 4096):  # very long texts in pieces
        h = values[lo : lo + 4096, None] * _MULTIPLIERS
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        np.minimum(least, h.min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(least[i : i + WIDTH].tobytes()) - (1 << 63) for i in range(0, len(least), WIDTH)], least.astype(np.uint8).tobytes()


def likely(own: bytes, others: list[bytes]) -> np.ndarray:
    """Shares of the MinHash values that a text has in common with others."""
    both = np.frombuffer(b"".join(others), np.uint8).reshape(len(others), len(own))
    return (both == np.frombuffer(own, np.uint8)).mean(axis=1)


def known(values: np.ndarray) -> bytes:
    """A number of bits and those of the values in which these low bits are zero, KNOWN at most: all values with 0 bits, a sample of a long text's."""
    bits = 0
    while len(values) > KNOWN:
        bits += 1
        values = values[values & np.uint64((1 << bits) - 1) == 0]
    return np.concatenate([np.array([bits], np.uint64), values]).tobytes()


class Known:
    """Texts of a shard by their known shingles, numbered as they come."""

    def __init__(self, similarity: float) -> None:
        self.similarity, self.columns = similarity, {}
        self.bits: list[int] = []
        self.sizes: list[np.ndarray] = []
        self.texts: list[np.ndarray] = []

    def add(self, sketch: bytes) -> int:
        values = np.frombuffer(sketch, np.uint64)
        self.bits.append(int(values[0]))
        self.sizes.append(np.array([np.count_nonzero(values[1:] & np.uint64((1 << b) - 1) == 0) for b in range(24)]))
        self.texts.append(np.array([self.columns.setdefault(x, len(self.columns)) for x in values[1:].tolist()], np.int64))
        return len(self.texts) - 1

    def similar(self, own: int, others: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Of each other text whether it may have the similarity to a text, and whether all shingles of both tell it."""
        marks = np.zeros(len(self.columns), np.int64)
        marks[self.texts[own]] = 1
        upto = np.concatenate([[0], np.cumsum(marks[np.concatenate([self.texts[i] for i in others])])])
        ends = np.cumsum([len(self.texts[i]) for i in others])
        both = upto[ends] - upto[np.concatenate([[0], ends[:-1]])]
        bits = np.maximum(self.bits[own], [self.bits[i] for i in others])
        either = self.sizes[own][bits] + np.array([self.sizes[i] for i in others])[np.arange(len(others)), bits] - both
        share = np.where(either > 0, both / np.maximum(either, 1), 1.0)
        return share >= np.where(bits > 0, self.similarity - SLACK, self.similarity), bits == 0


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


class Leaders:
    """Links of each text of a shard to the leader within the radius that is most like it."""

    def __init__(self, radius: int) -> None:
        self.radius, self.tree, self.leaders = radius, BKTree(), defaultdict(list)

    def step(self, node: int, fp: int, component: int, sig: bytes) -> list[tuple[int, int]]:
        near = [x for f in self.tree.within(fp, self.radius) for x in self.leaders[f]]
        if near:
            share = likely(sig, [s for _, s in near])
            if share.max() >= LIKELY:
                return [(near[int(share.argmax())][0], node)]
        if fp not in self.leaders:
            self.tree.add(fp)
        self.leaders[fp].append((node, sig))
        return []


class Unconnected:
    """The likely pairs within the radius of a shard's texts whose components differ; a component's texts come one behind another.

    Where texts are known by their shingles, the pairs that have the similarity, without those of components that such pairs have connected.
    """

    def __init__(self, radius: int, similarity: float = SIMILARITY) -> None:
        self.radius, self.tree, self.nodes, self.known = radius, BKTree(), defaultdict(list), Known(similarity)
        self.component: int | None = None
        self.own: list[tuple[int, int, bytes, int | None]] = []
        self.joined: dict[int, int] = {}

    def top(self, component: int) -> int:
        while (above := self.joined.get(component, component)) != component:
            self.joined[component] = self.joined.get(above, above)
            component = above
        return component

    def step(self, node: int, fp: int, component: int, sig: bytes, sketch: bytes | None = None) -> list[tuple[int, int]]:
        if component != self.component:
            for other, x, s, i in self.own:
                if x not in self.nodes:
                    self.tree.add(x)
                self.nodes[x].append((other, s, self.component, i))
            self.component, self.own = component, []
        number = None if sketch is None else self.known.add(sketch)
        self.own.append((node, fp, sig, number))
        near = [x for f in self.tree.within(fp, self.radius) for x in self.nodes[f]]
        if not near:
            return []
        near = [near[i] for i in np.flatnonzero(likely(sig, [x[1] for x in near]) >= LIKELY).tolist()]
        if number is None or not near:
            return [(x[0], node) for x in near]
        pairs = []
        for (other, _, of, _), ok, whole in zip(near, *(x.tolist() for x in self.known.similar(number, [x[3] for x in near])), strict=True):
            if ok and (a := self.top(of)) != (b := self.top(component)):
                pairs.append((other, node))
                if whole:
                    self.joined[a] = b
        return pairs


def _by_shard(rows: DataFrame, links: Callable[[int], Leaders | Unconnected], radius: int, order: list[str]) -> DataFrame:
    """rows: band, key, node, fp, component, sig, and known where texts are compared by it. Returns u, v."""
    given = ["band", "key", "node", "fp", "component", "sig", *(["known"] if "known" in rows.columns else [])]

    def told(out: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1), pa.int64()), pa.array(pairs.max(axis=1), pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for b in batches:
            out: list[tuple[int, int]] = []
            for band, key, node, fp, component, *sketches in zip(*[b.column(c).to_pylist() for c in given], strict=True):
                if at != (band, key):
                    at, shard = (band, key), links(radius)
                out += shard.step(node, fp & (1 << 64) - 1, component, *sketches)
                if len(out) > SENT:
                    yield told(out)
                    out = []
            yield told(out)

    return rows.repartition("band", "key").sortWithinPartitions("band", "key", *order).mapInArrow(run, "u long, v long").distinct()


def middles(dealt: DataFrame) -> DataFrame:
    """band, key, middle: a bit is 1 if most fingerprints of the shard have it. dealt: band, key, fp."""
    ones = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    bit = [F.when(F.col(f"b{i}") * 2 > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(0) for i in range(64)]
    return dealt.groupBy("band", "key").agg(F.count("*").alias("n"), *ones).select("band", "key", reduce(lambda a, b: a.bitwiseOR(b), bit).alias("middle"))


def _known(texts: DataFrame) -> DataFrame:
    """node, known. texts: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 512):  # up to 16 KB a text
                part = b.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([known(shingles(x.as_py())) for x in part.column("text")], pa.binary())], ["node", "known"])

    return texts.select("node", "text").mapInArrow(run, "node long, known binary")


def _checked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose texts have the similarity. texts: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [jaccard(shingles(x.as_py()), shingles(y.as_py())) >= similarity for x, y in zip(b.column("left"), b.column("right"), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    left, right = (texts.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("u", "left"), ("v", "right")))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "left", "right").mapInArrow(run, "u long, v long")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row of each group that links of the similarity connect, with all its columns: the one with the smallest id.

    Null ids come last; of rows that share the smallest id one stays. Null texts count as empty, and texts without a
    word are copies of each other; texts under five words are one shingle. Empty tables give no rows.
    """
    rows = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), text_of(docs, text_col).alias("text")).withColumn("node", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for t in b.column("text"):
                text = t.as_py()
                values = shingles(text)
                for column, x in zip(out, (xxhash.xxh3_128_digest(values.tobytes()), fingerprint(text, SHINGLE), *signature(values)), strict=True):
                    column.append(x)
            columns = [pa.array(out[0], pa.binary()), pa.array(np.array(out[1], np.uint64).view(np.int64), pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("node"), *columns], ["node", "same", "fp", "bands", "sig"])

    prints = stored(rows.select("node", "text").mapInArrow(run, "node long, same binary, fp long, bands array<long>, sig binary"))
    # Texts of the same shingles are one node.
    first = stored(prints.groupBy("same").agg(F.min(F.struct("node", "fp", "bands", "sig")).alias("f")).select("same", "f.*"))
    dealt = first.select("node", "fp", "sig", F.posexplode("bands").alias("band", "key"))
    shards = dealt.groupBy("band", "key").count().where("count > 1").select("band", "key")
    dealt = stored(dealt.join(shards, ["band", "key"], "left_semi"))
    texts = rows.select("node", "text")
    central = dealt.join(middles(dealt), ["band", "key"]).withColumn("far", F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))))
    links = stored(_checked(stored(_by_shard(central.withColumn("component", F.col("node")), Leaders, radius, ["far", "node"])), texts, similarity))
    placed = dealt.join(components(links), "node", "left").withColumn("component", F.coalesce("root", "node"))
    sizes = placed.where("root is not null").groupBy("component").agg(F.count("*").alias("size"))
    sized = placed.join(sizes, "component", "left").select("band", "key", "node", "fp", "sig", "component", F.coalesce("size", F.lit(1)).alias("size"))
    # Shards of one component have no pairs to give.
    mixed = sized.groupBy("band", "key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).where("a <> b").select("band", "key", (F.col("n") > HEAVY).alias("heavy"))
    open_rows = stored(sized.join(mixed, ["band", "key"]))
    sketches = _known(texts.join(open_rows.where("heavy").select("node").distinct(), "node", "left_semi")).withColumn("heavy", F.lit(True))
    more = _checked(stored(_by_shard(open_rows.join(sketches, ["node", "heavy"], "left"), partial(Unconnected, similarity=similarity), radius, ["size", "component", "node"])), texts, similarity)
    roots = components(links.unionByName(more))
    groups = first.select("same", F.col("node").alias("first")).join(roots.withColumnRenamed("node", "first"), "first", "left").select("same", F.coalesce("root", "first").alias("component"))
    placed = prints.select("node", "same").join(groups, "same").join(rows.select("node", "id"), "node")
    kept = placed.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("least")).select(F.col("least.node").alias("node"))
    return rows.join(kept, "node", "left_semi").select("row.*")
