"""Windows of symbols that documents repeat: what substring and suffix-array deduplication share.

A window of W symbols is routed by its seed: the least hash among its k-grams.
Equal windows have equal seeds, so windows with different seeds need no
comparison. Windows next to each other mostly share their seed; a run of them is
a segment, about one for every (W - k) / 2 symbols, and the symbols that its
windows cover are its text.

1. ``seeded``: every segment goes to its seed, with a hash of its text. Where a
   batch of documents repeats a seed, only one row for each different text goes;
   the others wait, dealt by their place, so that a seed that a third of all
   documents hold brings a few rows a batch to one task.
2. ``met``: a seed whose segments all have one text needs no comparison: whole
   texts are equal there, which two 64-bit hashes tell, of seed and text. The
   texts of all other repeated seeds are to be compared, each different one once.
3. ``contents``: the text of one segment for each of these is cut from its document.
4. ``judged``: texts go by seed, in bundles of bounded size, to the operator's own
   comparison, which alone tells which windows of different texts are equal. A
   seed with more than WIDE texts, which would outgrow a task, is cut into pieces
   by where its windows hold the seed; a piece goes by the symbols that all its
   windows share.
5. ``spans``: what was found, joined to all segments of these texts, as ranges of
   each document's symbols.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Texts of a seed above which it is cut; bytes of a bundle; segments that a task gathers before it sends them on; symbols that are hashed at a time.
WIDE, BUNDLE, SENT, SLICE = 20_000, 128_000, 1_000_000, 1_000_000
_NULL_ID = 2**63 - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Kinds of rows: a segment, one that stands for several of its batch, one of those that wait; a text to compare, a seed's only text.
_ONE, _SUMMARY, _WAITING, _TEXT, _ONLY, _GONE = range(6)
#: Where the weight stands in ``at``.
_WEIGHT = 41


@dataclass(frozen=True)
class Symbols:
    """window, k: in symbols. hashed: texts -> (hashes of all symbols, symbols of each text). cut: (text, from, to) -> those symbols' text, for each range."""

    window: int
    k: int
    hashed: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    cut: Callable[[bytes, list[tuple[int, int]]], list[bytes]]
    #: Whether a second place in the same document counts.
    same_document: bool
    #: How many places of the seed a piece of a large group takes, and a piece of a piece; the last is 1.
    pieces: tuple[int, ...] = (8, 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Grams:
    """Hashes of any run of symbols: polynomials modulo 2**64, from prefix sums."""

    def __init__(self, symbols: np.ndarray) -> None:
        size = len(symbols)
        powers = np.full(size + 1, _BASE)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        self.sums = np.zeros(size + 1, np.uint64)
        np.cumsum(symbols * powers[:-1], out=self.sums[1:])
        self.back = np.full(size + 1, _UNBASE)
        self.back[0] = 1
        np.cumprod(self.back, out=self.back)

    def all(self, k: int) -> np.ndarray:
        """Of the k symbols from each place on."""
        size = len(self.sums) - k
        return _mix((self.sums[k:] - self.sums[:size]) * self.back[:size]) if size > 0 else self.sums[:0]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64) * _BASE)


def segments(grams: Grams, sizes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """seed, text number, start in the text and number of windows of each segment. sizes: symbols of each text, which stand one behind another."""
    low, span, width = grams.all(k), 1, window - k + 1
    if len(low) < width:
        return low[:0], *np.zeros((3, 0), np.int64)
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if rest := width - span:
        low = np.minimum(low[:-rest], low[rest:])
    begin = np.cumsum(sizes) - sizes
    long = np.flatnonzero(sizes >= window)
    opens = np.concatenate(([True], low[1:] != low[:-1]))
    opens[begin[long]] = True
    ends = begin[long] + sizes[long] - window + 1  # behind the last window of each text
    opens[ends[ends < len(opens)]] = True
    start = np.flatnonzero(opens)
    n = np.diff(np.append(start, len(low)))
    owner = np.searchsorted(begin + sizes, start, side="right")  # the text that the place is in
    inside = start + window <= (begin + sizes)[np.minimum(owner, len(sizes) - 1)]
    inside &= owner < len(sizes)
    start, n, owner = start[inside], n[inside], owner[inside]
    if len(n) and n.max() > window:  # periodic text
        pieces = -(-n // window)
        which = np.repeat(np.arange(len(n)), pieces)
        offset = (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
        start, n, owner = start[which] + offset, np.minimum(n[which] - offset, window), owner[which]
    return low[start], owner, start - begin[owner], n


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, r, text; null text as empty, a null id as the largest long. Rows that share an id are told apart by r, a hash of
    their text, which is 0 where ids don't repeat. Rows equal in both share r: their windows are the same places' twice."""
    rows = docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    again = stored(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return rows.select("doc_id", F.lit(0).cast("long").alias("r"), "text")
    return rows.join(again.withColumn("several", F.lit(True)), "doc_id", "left").select("doc_id", F.when(F.col("several"), F.xxhash64("text")).otherwise(0).alias("r"), "text")


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded size together; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield at, i
            at, size = i, 0
        size += len(t)
    yield at, len(texts)


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def seeded(rows: DataFrame, symbols: Symbols) -> DataFrame:
    """seed, cid (hash of the text), doc_id, r, at: the segments. rows: ``keyed``.

    at holds, from the highest bit: how many segments of its batch a row stands for, start, n windows (7 bits), whether
    the document holds the seed twice (1), and kind (2).
    """
    twice = symbols.same_document

    def sent(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        seed, cid, doc, r, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(seed, kind="stable")
        new = np.concatenate(([True], seed[order][1:] != seed[order][:-1]))
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        if twice:
            several = np.bincount(group) > 1
        else:
            several = np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first)
        some = order[several[group]]
        some = some[np.lexsort((doc[some], cid[some], seed[some]))]
        at[some] |= _WAITING
        if len(some):
            lead = np.flatnonzero(np.concatenate(([True], (seed[some][1:] != seed[some][:-1]) | (cid[some][1:] != cid[some][:-1]))))
            count = np.diff(np.append(lead, len(some)))
            lead = some[lead]
            seed, cid, doc, r = (np.concatenate((x, x[lead])) for x in (seed, cid, doc, r))
            at = np.concatenate((at, at[lead] & ~3 | _SUMMARY))
            at[-len(lead) :] += count - 1 << _WEIGHT
        columns = [seed.view(np.int64), cid.view(np.int64), doc, r, at]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["seed", "cid", "doc_id", "r", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            texts, ids, own = _bytes(b.column("text")), b.column("doc_id").to_numpy(), b.column("r").to_numpy()
            for lo, hi in _slices(texts):
                hashes, sizes = symbols.hashed(texts[lo:hi])
                grams = Grams(hashes)
                seed, owner, start, n = segments(grams, sizes, symbols.window, symbols.k)
                if not len(seed):
                    continue
                place = start + (np.cumsum(sizes) - sizes)[owner]
                again = np.zeros(len(seed), np.int64)
                if twice:  # windows of one segment may be equal where its seed stands twice
                    every = np.sort(grams.all(symbols.k))
                    again = np.isin(seed, every[1:][every[1:] == every[:-1]]).astype(np.int64)
                held.append((seed, grams.of(place, place + n + symbols.window - 1), ids[lo:hi][owner], own[lo:hi][owner], 1 << _WEIGHT | start << 10 | n << 3 | again << 2))
                size += len(seed)
                if size > SENT:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)

    return rows.mapInArrow(run, "seed long, cid long, doc_id long, r long, at long")


_MET = "kind int, seed long, cid long, doc_id long, r long, at long, weight long, least long"


def met(found: DataFrame, symbols: Symbols) -> DataFrame:
    """kind, seed, cid, doc_id, r, at, weight, least. Of repeated seeds: segments that go or wait, the texts to compare, and texts that are their seed's only one."""
    twice = symbols.same_document

    def told(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        rows = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.lexsort((rows[1], rows[0]))
        seed, cid, doc, r, at = (x[order] for x in rows)
        weight, at = at >> _WEIGHT, at & (1 << _WEIGHT) - 1
        rows = [seed, cid, doc, r, at, weight]
        waits = at & 3 == _WAITING
        out = [(_WAITING, np.flatnonzero(waits), doc)]
        at_row = np.flatnonzero(~waits)
        if len(at_row):
            s, c, d = seed[at_row], cid[at_row], doc[at_row]
            new = np.concatenate(([True], s[1:] != s[:-1]))
            text = new | np.concatenate(([True], c[1:] != c[:-1]))
            first, group, lead = np.flatnonzero(new), np.cumsum(new) - 1, np.flatnonzero(text)
            least = np.minimum.reduceat(d, first)
            any_of = lambda x: np.logical_or.reduceat(x, first)
            summary, inner = any_of(at[at_row] & 3 == _SUMMARY), any_of(at[at_row] & 4 > 0)
            if twice:
                repeated = (np.add.reduceat(weight[at_row], first) > 1) | inner
            else:
                repeated = (least != np.maximum.reduceat(d, first)) | summary
            several = repeated & ((np.bincount(group[lead]) > 1) | inner)
            only = repeated & ~several
            plain = at[at_row] & 3 == _ONE
            out.append((_GONE, at_row[plain & only[group] & (twice | (d > least[group]))], doc))
            out.append((_ONE, at_row[plain & several[group]], doc))
            total, lowest = weight.copy(), doc.copy()
            total[at_row[lead]] = np.add.reduceat(weight[at_row], lead)
            lowest[at_row[lead]] = np.minimum.reduceat(d, lead)
            rows[5] = total
            out.append((_TEXT, at_row[lead[several[group[lead]]]], lowest))
            out.append((_ONLY, at_row[lead[(only & summary)[group[lead]]]], lowest))
        kind = np.concatenate([np.full(len(i), k, np.int32) for k, i, _ in out])
        index = np.concatenate([i for _, i, _ in out])
        columns = [pa.array(kind), *[pa.array(x[index], pa.int64()) for x in rows], pa.array(np.concatenate([x[i] for _, i, x in out]), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["kind", "seed", "cid", "doc_id", "r", "at", "weight", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            part = [b.column(c).to_numpy() for c in ("seed", "cid", "doc_id", "r", "at")]
            cut = int(np.searchsorted(part[0], part[0][-1]))  # rows come sorted; the last seed may go on
            if cut:
                held.append(tuple(x[:cut] for x in part))
                yield told(held)
                held = []
            elif held and held[-1][0][-1] != part[0][0]:
                yield told(held)
                held = []
            held.append(tuple(x[cut:] for x in part))
        if held:
            yield told(held)

    dealt = F.when(F.col("at").bitwiseAND(F.lit(3)) == _WAITING, F.xxhash64("doc_id", "at")).otherwise(F.col("seed"))
    return found.repartition(dealt).sortWithinPartitions("seed").mapInArrow(run, _MET)


def _digest(content: bytes) -> int:
    x = xxhash.xxh3_64_intdigest(content)
    return x - (1 << 64) if x >> 63 else x


def contents(rows: DataFrame, texts: DataFrame, symbols: Symbols) -> DataFrame:
    """seed, cid, content, n, weight, least of the texts of ``met``, cut from the document that each names."""
    item = F.struct("seed", "cid", "at", "weight", "least")
    wanted = texts.groupBy("doc_id", "r").agg(F.collect_list(item).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("wanted")
            flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
            at = flat.field("at").to_numpy()
            start, n = at >> 10, at >> 3 & 127
            ranges = list(zip(start.tolist(), (start + n + symbols.window - 1).tolist(), strict=True))
            parts, lo = [], 0
            for text, hi in zip(_bytes(b.column("text")), ends.tolist(), strict=True):
                parts += symbols.cut(text, ranges[lo:hi])
                lo = hi
            columns = [flat.field("seed"), flat.field("cid"), pa.array(parts, pa.binary()), pa.array(n.astype(np.int32)), flat.field("weight"), flat.field("least")]
            yield pa.RecordBatch.from_arrays(columns, ["seed", "cid", "content", "n", "weight", "least"])

    return rows.join(wanted, ["doc_id", "r"]).select("text", "wanted").mapInArrow(run, "seed long, cid long, content binary, n int, weight long, least long")


@dataclass
class Bundle:
    """Different texts of some seeds: all texts of each."""

    seeds: np.ndarray
    #: The hash of the k-gram that each text's windows hold.
    keys: np.ndarray
    contents: list[bytes]
    #: Windows of each text.
    n: np.ndarray
    weight: np.ndarray
    least: np.ndarray


#: The value of every window of a bundle, text by text.
Judge = Callable[[Bundle], np.ndarray]
_JUDGED = "seed long, cid long, ranges array<struct<a:int,b:int,value:long>>"


def _bundles(texts: DataFrame, symbols: Symbols, judge: Judge) -> DataFrame:
    """seed, cid, ranges (a, b, value): the windows from a to b - 1 of a text have that value. One row per text, without
    the ranges that remove nothing anywhere. texts: seed, cid, content, n, weight, least, key; a text may have several equal rows."""
    names = ("seed", "cid", "content", "n", "weight", "least", "key")

    def told(held: list[tuple]) -> pa.RecordBatch:
        merged = {(row[0], row[1]): row for row in held}
        seed, cid, content, n, weight, least, key = zip(*merged.values(), strict=True)
        seed, cid, n, weight, least, key = (np.array(x, np.int64) for x in (seed, cid, n, weight, least, key))
        values = judge(Bundle(seed, key, list(content), n, weight, least))
        begin = np.cumsum(n) - n
        cut = np.concatenate(([True], values[1:] != values[:-1]))
        cut[begin] = True
        a = np.flatnonzero(cut)
        owner = np.repeat(np.arange(len(n)), n)[a]
        size = np.diff(np.append(a, len(values)))
        useful = values[a] > 1 if symbols.same_document else (weight[owner] > 1) | (values[a] < least[owner])
        a, owner, size = a[useful], owner[useful], size[useful]
        own, each = np.unique(owner, return_counts=True)
        ranges = pa.StructArray.from_arrays([pa.array((a - begin[owner]).astype(np.int32)), pa.array((a - begin[owner] + size).astype(np.int32)), pa.array(values[a])], ["a", "b", "value"])
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(each))).astype(np.int32)), ranges)
        return pa.RecordBatch.from_arrays([pa.array(seed[own]), pa.array(cid[own]), listed], ["seed", "cid", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if size > BUNDLE and row[0] != held[-1][0]:
                    yield told(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield told(held)

    return texts.select(*names).repartition("seed").sortWithinPartitions("seed").mapInArrow(run, _JUDGED)


def anchors(hashes: np.ndarray, k: int, key: int, n: int) -> np.ndarray:
    """The first place of the key's k-gram in each of the n windows of a text."""
    places = np.flatnonzero(Grams(hashes).all(k).view(np.int64) == key)
    return places[np.searchsorted(places, np.arange(n))]


def _cut(texts: DataFrame, symbols: Symbols, step: int) -> DataFrame:
    """Texts cut into pieces of windows that hold the seed at like places: wseed, wcid, content, n, weight, least; seed and cid of the text, at (the piece's first window)."""
    w, k = symbols.window, symbols.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("seed", "cid", "content", "n", "weight", "least", "key")
        for b in batches:
            out: list[list] = [[] for _ in range(10)]
            for seed, cid, content, n, weight, least, key in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                anchor = anchors(symbols.hashed([content])[0], k, key, n)
                part = (anchor - np.arange(n)) // step
                edges = np.concatenate(([0], np.flatnonzero((part[1:] != part[:-1]) | (anchor[1:] != anchor[:-1])) + 1, [n])).tolist()
                for lo, hi in zip(edges, edges[1:], strict=False):
                    p, q = int(anchor[lo]), int(part[lo])
                    core, piece = symbols.cut(content, [(p - q * step, p - (q + 1) * step + 1 + w), (lo, hi - 1 + w)])
                    wseed = _digest(b"%d %d %d " % (key, step, q) + core)
                    for column, x in zip(out, (wseed, _digest(piece), piece, hi - lo, weight, least, seed, cid, lo, key), strict=True):
                        column.append(x)
            types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["wseed", "wcid", "content", "n", "weight", "least", "seed", "cid", "at", "key"])

    return texts.mapInArrow(run, "wseed long, wcid long, content binary, n int, weight long, least long, seed long, cid long, at int, key long")


def judged(texts: DataFrame, symbols: Symbols, judge: Judge, wide: int = WIDE, steps: tuple[int, ...] | None = None) -> DataFrame:
    """seed, cid, ranges, one row per text at most. texts: stored seed, cid, content, n, weight, least, and key, the hash of the k-gram that is the seed."""
    steps = symbols.pieces if steps is None else steps
    columns = ["seed", "cid", "content", "n", "weight", "least", "key"]
    many = stored(texts.groupBy("seed").count().where(F.col("count") > wide).select("seed")) if steps else None
    if many is None or many.isEmpty():
        return _bundles(texts, symbols, judge)
    pieces = stored(_cut(texts.join(many, "seed", "left_semi"), symbols, steps[0]))
    once = pieces.groupBy("wseed", "wcid").agg(F.first("content").alias("content"), F.first("n").alias("n"), F.sum("weight").alias("weight"), F.min("least").alias("least"), F.first("key").alias("key"))
    values = stored(judged(stored(once.withColumnsRenamed({"wseed": "seed", "wcid": "cid"}).select(*columns)), symbols, judge, wide, steps[1:])).withColumnsRenamed({"seed": "wseed", "cid": "wcid"})
    moved = F.transform("ranges", lambda x: F.struct((x["a"] + F.col("at")).alias("a"), (x["b"] + F.col("at")).alias("b"), x["value"].alias("value")))
    back = pieces.select("wseed", "wcid", "seed", "cid", "at").join(values, ["wseed", "wcid"]).select("seed", "cid", moved.alias("ranges")).groupBy("seed", "cid").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    return _bundles(texts.join(many, "seed", "left_anti").select(*columns), symbols, judge).unionByName(back)


def spans(rows: DataFrame, symbols: Symbols, judge: Judge, removes: Callable[[Column], Column], wide: int = WIDE) -> DataFrame:
    """doc_id, r, spans: ranges of windows (from * 2**32 + to) for whose value ``removes`` holds. rows: ``keyed``."""
    found = stored(met(seeded(rows, symbols), symbols), "kind")
    of = lambda *kinds: found.where(F.col("kind").isin(*kinds))
    texts = stored(contents(rows, of(_TEXT), symbols).withColumn("key", F.col("seed")))
    start, n = F.shiftright("at", 10), F.shiftright("at", 3).bitwiseAND(F.lit(127))
    value = F.lit(2).cast("long") if symbols.same_document else F.col("least")
    only = of(_ONLY).select("seed", "cid", F.array(F.struct(F.lit(0).alias("a"), n.cast("int").alias("b"), value.alias("value"))).alias("ranges"))
    values = stored(judged(texts, symbols, judge, wide).unionByName(only))
    hit = of(_ONE, _WAITING).select("seed", "cid", "doc_id", "r", start.alias("start")).join(values, ["seed", "cid"])
    own = F.transform(F.filter("ranges", lambda x: removes(x["value"])), lambda x: F.shiftleft(F.col("start") + x["a"], 32) + F.col("start") + x["b"])
    compared = hit.select("doc_id", "r", own.alias("own")).where(F.size("own") > 0)
    gone = of(_GONE).select("doc_id", "r", F.array(F.shiftleft(start, 32) + start + n).alias("own"))
    return stored(compared.unionByName(gone).groupBy("doc_id", "r").agg(F.flatten(F.collect_list("own")).alias("spans")))


def with_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows and their spans; null where a row has none. The largest long is a null id again."""
    return rows.join(found, ["doc_id", "r"], "left").select(F.nullif("doc_id", F.lit(_NULL_ID)).alias("doc_id"), "text", "spans")


def covered(size: int, ranges: np.ndarray, window: int) -> np.ndarray:
    """Which of ``size`` symbols the windows of the ranges (from * 2**32 + to) cover."""
    edge = np.bincount(ranges >> 32, minlength=size + 1) - np.bincount((ranges & 0xFFFFFFFF) + (window - 1), minlength=size + 1)
    return np.cumsum(edge[:-1]) > 0
