"""Language-model scoring by a class-based n-gram model.

Exchange clustering assigns every word of the training documents to a class;
log p(w_i) is the sum of a class transition, log p(c_i | c_{i-2}, c_{i-1}), and
a word emission, log p(w_i | c_i).

The vocabulary stays a table: it grows with the corpus. Clustering has two steps.
The first works on items, whose number is bounded: the ITEM_WORDS most frequent
words, and SUFFIXES groups of all other words by their last characters. A round
counts in Spark how often each item stands before and after each class, and then
moves each item to the class that raises the likelihood of the class bigrams
most; counts of its neighbours are those at the round's beginning, so a round
after which the likelihood isn't higher is undone. The second step takes every
other word out of its group and moves it, by the classes around its own
occurrences, in the same way.

Documents are kept as sequences of items, two bytes a token, with the other
words beside them, so that texts are split twice only; then as sequences of
classes. Classes and counts of the FREQUENT most frequent words go to every task,
where a long word has a digest in its place; all other words find theirs by a
join, once per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, plain, stored

CLASSES, ROUNDS = 64, 3
ITEM_WORDS, SUFFIXES = 8191, 2048
#: Bound of the broadcast vocabulary, and the bytes above which a word has a digest there.
FREQUENT, SHORT = 200_000, 40
#: Distinct words a task gathers before it sends them on, and documents that Spark hands it at once: rows of places are large.
FLUSH, ROWS = 250_000, 2048
#: Bytes of text that are split at once.
PIECE = 4_000_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Strength of the lower order in a transition's probability.
PRIOR = 20.0
END = b""
#: Stands in a sequence of classes for a word whose class isn't known yet.
_OPEN = 255


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches with texts of ``PIECE`` bytes at most, or one row."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("text")).to_numpy(), dtype=np.int64)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z in lower case, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    parts = lists.flatten().cast(pa.binary())
    some = pc.greater(pc.binary_length(parts), 0)  # white space at either end leaves an empty part
    before = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False), dtype=np.int64)))
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64)))
    return parts.filter(some), np.diff(before[ends])


def suffix_item(word: bytes, item_words: int = ITEM_WORDS) -> int:
    return 1 + item_words + zlib.crc32(word[-3:]) % SUFFIXES


def suffix_items(words: pa.Array, item_words: int) -> np.ndarray:
    tails = pc.binary_slice(words, -3).dictionary_encode()
    return np.fromiter((suffix_item(t, item_words) for t in tails.dictionary.to_pylist()), np.int64, len(tails.dictionary))[tails.indices.to_numpy()]


def entry(word: bytes) -> bytes:
    """What stands for a word in the broadcast vocabulary; no word holds a space."""
    return word if len(word) <= SHORT else b" " + xxhash.xxh3_128_digest(word)


def _entries(words: pa.Array) -> pa.Array:
    long = pc.greater(pc.binary_length(words), SHORT)
    return pc.replace_with_mask(words, long, pa.array(map(entry, words.filter(long).to_pylist()), pa.binary()))


def _summed(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """docs: train rows with text. Returns word (binary, END included), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0
        for b in pieces(batches):
            counts = words_of(b.column("text"))[0].value_counts()
            held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
            size, ends = size + len(counts), ends + b.num_rows
            if size > 2 * FLUSH:
                held = [_summed(held)]
                size = held[0].num_rows
                if size > FLUSH:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if ends:
            held.append(pa.table({"word": pa.array([END], pa.binary()), "n": pa.array([ends], pa.int64())}))
            yield from _summed(held).to_batches()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(vocab: DataFrame, bound: int) -> list[tuple[bytes, int]]:
    """``entry`` and n of the most frequent words, the end not among them: ``bound`` at most, whole bins of n; the most frequent first."""
    words = vocab.where(F.length("word") > 0).withColumn("bin", F.floor(F.log2("n") * 64).cast("int"))
    least, total = None, 0
    for r in words.groupBy("bin").count().orderBy(F.desc("bin")).collect():  # 4096 rows at most
        total += r["count"]
        if total > bound:
            break
        least = r["bin"]
    if least is None:
        return []

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(entry, b.column("word").to_pylist()), pa.binary()), b.column("n")], ["word", "n"])

    top = words.where(F.col("bin") >= least).select("word", "n").mapInArrow(named, "word binary, n long").toArrow()
    return sorted(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(pairs: np.ndarray) -> float:
    """What the class bigrams add to the log-likelihood."""
    return float(_f(pairs).sum() - _f(pairs.sum(axis=0)).sum() - _f(pairs.sum(axis=1)).sum())


def class_pairs(classes: np.ndarray, left: np.ndarray) -> np.ndarray:
    """How often a class (column) stands behind a class (row)."""
    pairs = np.zeros((left.shape[1], left.shape[1]))
    np.add.at(pairs.T, classes, left)
    return pairs


def exchange(classes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One round of exchange clustering: each item in turn goes to the class that gives the greatest likelihood.

    left, right: items by classes, how often a class stands before, after an item. Item 0, the end, keeps class 0.
    """
    size = left.shape[1]
    classes, weight = classes.copy(), left.sum(axis=1)
    pairs = class_pairs(classes, left)
    mass = np.bincount(classes, weight, size)
    members = np.bincount(classes, minlength=size)
    for item in np.argsort(-weight, kind="stable"):
        own, n = classes[item], weight[item]
        if item == 0 or n == 0 or members[own] == 1:
            continue
        l, r = left[item], right[item]
        pairs[:, own] -= l
        pairs[own, :] -= r
        mass[own] -= n
        np.maximum(pairs, 0, out=pairs)
        some_l, some_r = np.flatnonzero(l), np.flatnonzero(r)
        gain = (_f(pairs[some_l] + l[some_l, None]) - _f(pairs[some_l])).sum(axis=0) + (_f(pairs[:, some_r] + r[some_r]) - _f(pairs[:, some_r])).sum(axis=1) - 2 * (_f(mass + n) - _f(mass))
        gain[0] = -np.inf
        to = int(gain.argmax()) if gain.max() > gain[own] + 1e-9 else own
        pairs[:, to] += l
        pairs[to, :] += r
        mass[to] += n
        members[own] -= 1
        members[to] += 1
        classes[item] = to
    return classes


def _cells(rows: DataFrame, column: str, counts, size: int) -> np.ndarray:
    """Sums over all rows of what ``counts`` makes of a batch: an array of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, np.int64)
        for b in batches:
            values = [x.as_buffer() for x in b.column(column)]
            for lo in range(0, len(values), 512):  # bounded pieces
                counts(out, values[lo : lo + 512])
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out[at], pa.int64())], ["cell", "n"])

    cells = rows.select(column).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(size)
    found[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return found


def _item_counts(rows: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shared, size = rows.sparkSession.sparkContext.broadcast(classes), len(classes) * CLASSES

    def counts(out: np.ndarray, values: list) -> None:
        seq = np.concatenate([[0], *[np.frombuffer(x, "<u2").astype(np.int64) for x in values]])  # the end stands before every text
        c = shared.value[seq]
        out[:size] += np.bincount(seq[1:] * CLASSES + c[:-1], minlength=size)
        out[size:] += np.bincount(seq[:-1] * CLASSES + c[1:], minlength=size)

    found = _cells(rows, "items", counts, 2 * size)
    return found[:size].reshape(-1, CLASSES), found[size:].reshape(-1, CLASSES)


def clustered(rows: DataFrame, item_words: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of the items, the class pairs, and the likelihoods that rose. rows: items of the training documents."""
    classes = np.concatenate(([0], 1 + np.arange(item_words + SUFFIXES) % (CLASSES - 1)))
    best, rising = None, []
    for k in range(ROUNDS + 1):
        left, right = _item_counts(rows, classes)
        pairs = class_pairs(classes, left)
        now = likelihood(pairs)
        if rising and now <= rising[-1]:
            break
        best, rising = (classes, pairs), [*rising, now]
        if k < ROUNDS:
            classes = exchange(classes, left, right)
    return *best, rising


def best_classes(counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The class of each word that raises the likelihood most. counts: words by cells, how often a word has a class before it (cell) or after it (CLASSES + cell)."""
    table, mass = np.concatenate((pairs, pairs.T)), _f(pairs.sum(axis=0))
    base = _f(table)
    once = _f(table + 1) - base
    out = np.zeros(len(counts), np.int64)
    for lo in range(0, len(counts), 1000):
        part = counts[lo : lo + 1000]
        owner, cell = np.nonzero(part)
        k = part[owner, cell]
        more = k > 1
        gain = once[cell]
        gain[more] = _f(table[cell[more]] + k[more, None]) - base[cell[more]]
        n = part[:, :CLASSES].sum(axis=1)
        total = np.add.reduceat(gain, np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))), axis=0) - 2 * (_f(pairs.sum(axis=0)[None] + n[:, None]) - mass[None])
        total[:, 0] = -np.inf
        out[lo : lo + 1000] = total.argmax(axis=1)
    return out


class _Batch:
    """A batch's items and words as flat arrays."""

    def __init__(self, b: pa.RecordBatch) -> None:
        items, lists = b.column("items"), b.column("words")
        self.size = b.num_rows
        texts = items.to_pylist()
        self.seq = np.frombuffer(b"".join(texts), "<u2")
        self.length = np.fromiter(map(len, texts), np.int64, self.size) // 2
        self.start = np.cumsum(self.length) - self.length
        self.doc = np.repeat(np.arange(self.size), self.length)
        values = lists.flatten()
        self.word, self.at = values.field("word"), values.field("at")
        self.doc_of_word = np.repeat(np.arange(self.size), lists.value_lengths().to_numpy())
        self.times = self.at.value_lengths().to_numpy().astype(np.int64)
        #: Places of all words' tokens among all tokens, word by word.
        self.place = self.at.flatten().to_numpy() + np.repeat(self.start[self.doc_of_word], self.times)
        coded = self.word.dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy()


def _parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Bounded parts of batches, whose flat arrays are large."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _listed(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def _binaries(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def word_classes(rows: DataFrame, classes: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """word, n, class of all words that aren't items. rows: items and words of the training documents."""
    shared = rows.sparkSession.sparkContext.broadcast((classes.astype(np.uint8), pairs))
    cells = 2 * CLASSES

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value[0]
        for b in _parts(batches):
            x = _Batch(b)
            if not len(x.code):
                continue
            flat = np.zeros(len(x.seq) + x.size + 1, np.int64)  # the end stands before every text, and behind the last
            flat[np.arange(len(x.seq)) + x.doc + 1] = of[x.seq]
            at = x.place + x.doc[x.place] + 1
            code = np.repeat(x.code.astype(np.int64), x.times) * cells
            key, n = np.unique(np.concatenate((code + flat[at - 1], code + CLASSES + flat[at + 1])), return_counts=True)
            sizes = np.bincount(key // cells, minlength=len(x.words))
            yield pa.RecordBatch.from_arrays([x.words, _listed(sizes, pa.array(key % cells, pa.int32())), _listed(sizes, pa.array(n, pa.int32()))], ["word", "cell", "n"])

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by word; the last word of a batch may go on in the next."""
        last, held = None, np.zeros(cells, np.int64)

        def told(names: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
            n = counts[:, :CLASSES].sum(axis=1)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(n, pa.int64()), pa.array(best_classes(counts, shared.value[1]), pa.int32())], ["word", "n", "class"])

        for b in batches:
            words = b.column("word").to_pylist()
            if not words:
                continue
            new = np.fromiter((w != before for w, before in zip(words, [last, *words[:-1]], strict=True)), bool, len(words))
            index = np.cumsum(new)  # 0 is the word that goes on
            names = [last, *[w for w, own in zip(words, new.tolist(), strict=True) if own]]
            owner = np.repeat(index, b.column("cell").value_lengths().to_numpy())
            counts = np.bincount(owner * cells + b.column("cell").flatten().to_numpy(), b.column("n").flatten().to_numpy(), len(names) * cells).reshape(-1, cells).astype(np.int64)
            counts[0] += held
            first = 0 if last is not None else 1
            if len(names) - 1 > first:
                yield told(names[first:-1], counts[first:-1])
            last, held = names[-1], counts[-1]
        if last is not None:
            yield told([last], held[None])

    sent = rows.select("items", "words").mapInArrow(contexts, "word binary, cell array<int>, n array<int>")
    return sent.repartition("word").sortWithinPartitions("word").mapInArrow(assigned, "word binary, n long, class int")


class ClassModel:
    """transitions: log10 p(c | a, b). spread: log10 of an emission's denominator, by class."""

    def __init__(self, trigrams: np.ndarray, members: np.ndarray) -> None:
        """trigrams: counts by class. members: different words of each class."""
        mass = trigrams.sum(axis=(0, 1))
        one = (mass + 0.5) / (mass.sum() + 0.5 * CLASSES)
        two = trigrams.sum(axis=0)
        two = (two + PRIOR * one) / (two.sum(axis=1, keepdims=True) + PRIOR)
        three = (trigrams + PRIOR * two[None]) / (trigrams.sum(axis=2, keepdims=True) + PRIOR)
        self.transitions = np.log10(three)
        self.spread = np.log10(mass + 0.5 * (members + 1))

    def sequence(self, classes: np.ndarray) -> float:
        """What transitions and the emissions' denominators add to the text's log10 probability."""
        c = np.concatenate(([0, 0], classes))
        return float((self.transitions[c[:-2], c[1:-1], c[2:]] - self.spread[c[2:]]).sum())


def trigram_counts(rows: DataFrame) -> np.ndarray:
    """rows: classes of the training documents."""

    def counts(out: np.ndarray, values: list) -> None:
        for x in values:
            c = np.concatenate(([0, 0], np.frombuffer(x, np.uint8).astype(np.int64)))
            np.add.at(out, (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], 1)

    return _cells(rows, "classes", counts, CLASSES**3).reshape(CLASSES, CLASSES, CLASSES)


def encode(b: pa.RecordBatch, known: pa.Array, number: np.ndarray, item_words: int) -> pa.RecordBatch:
    """``encoded`` of a batch, all texts at once. known, number: the items' words and numbers."""
    words, n = words_of(b.column("text"))
    length = n + 1
    start = np.cumsum(length) - length
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(words)) + doc  # an end stands behind every text
    found = pc.index_in(words, value_set=known)
    other = found.is_null()
    seq = np.zeros(len(words) + len(n), np.int64)
    seq[at] = number[found.fill_null(0).to_numpy()]
    mask = other.to_numpy(zero_copy_only=False)
    coded = words.filter(other).dictionary_encode()
    code, doc, at = coded.indices.to_numpy().astype(np.int64), doc[mask], at[mask]
    seq[at] = suffix_items(coded.dictionary, item_words)[code]
    # Places of a document's other words, word by word.
    key = doc * len(coded.dictionary) + code
    order = np.argsort(key, kind="stable")
    code, doc, at, key = code[order], doc[order], at[order], key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    listed = _listed(np.diff(first, append=len(key)), pa.array(at - start[doc], pa.int32()))
    structs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(code[first])), listed], ["word", "at"])
    held = [fold(x) == 1 for x in b.column("doc_id").to_pylist()]
    columns = [pa.array(held, pa.bool_()), pa.array(length), _binaries(2 * length, seq.astype("<u2")), _listed(np.bincount(doc[first], minlength=len(n)), structs)]
    return pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "held_out", "n_tokens", "items", "words"])


def encoded(src: DataFrame, items: dict[bytes, int], item_words: int) -> DataFrame:
    """row, doc_id, held_out, n_tokens, items (in order, two bytes each), words: those that aren't items, each with its places. src: doc_id, text."""
    shared = src.sparkSession.sparkContext.broadcast((pa.array(list(items), pa.binary()), np.fromiter(items.values(), np.int64, len(items))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield encode(b, *shared.value, item_words)

    id_type = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, items binary, words array<struct<word:binary,at:array<int>>>").withColumn("row", F.monotonically_increasing_id())


def classified(rows: DataFrame, classes: np.ndarray, logs: np.ndarray, frequent: dict[bytes, tuple[float, int]], table: DataFrame, end_known: bool) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, logs (of the counts and a half), classes (a byte a token). rows: stored ``encoded``; logs: of the items; table: word, n, class."""
    # The last log and class stand for all words that aren't frequent.
    named = (pa.array(list(frequent), pa.binary()), np.array([*[log for log, _ in frequent.values()], 0.0]), np.array([*[c for _, c in frequent.values()], _OPEN], np.uint8))
    shared, last = rows.sparkSession.sparkContext.broadcast((classes.astype(np.uint8), logs, named)), len(logs) - 1
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, item_logs, (entries, entry_logs, entry_classes) = shared.value
        for b in _parts(batches):
            x = _Batch(b)
            own = x.seq <= last
            n_known = np.bincount(x.doc, own, x.size).astype(np.int64) - (not end_known)
            total = np.bincount(x.doc[own], item_logs[x.seq[own]], x.size)
            found = of[x.seq]
            met = pc.index_in(_entries(x.words), value_set=entries).fill_null(len(entries)).to_numpy()[x.code]
            of_word, log = entry_classes[met], entry_logs[met]
            named = of_word != _OPEN
            n_known += np.bincount(x.doc_of_word[named], x.times[named], x.size).astype(np.int64)
            total += np.bincount(x.doc_of_word[named], x.times[named] * log[named], x.size)
            group = found[x.place[np.cumsum(x.times) - x.times]]  # the class of the word's group
            found[x.place] = np.repeat(of_word, x.times)
            open_words = np.flatnonzero(~named)
            take = pa.array(open_words, pa.int64())
            rare = pa.StructArray.from_arrays([x.word.take(take), x.at.take(take), pa.array(x.times[open_words], pa.int32()), pa.array(group[open_words], pa.int32())], ["word", "at", "f", "own"])
            columns = [pa.array(n_known), pa.array(total), _binaries(x.length, found), _listed(np.bincount(x.doc_of_word[open_words], minlength=x.size), rare)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("row", "doc_id", "held_out", "n_tokens")], *columns], ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "classes", "rare"])

    part = stored(rows.mapInArrow(resolved, f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, logs double, classes binary, rare array<struct<word:binary,at:array<int>,f:int,own:int>>"))
    met = part.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(table, "word", "left")
    filled = met.groupBy("row").agg(
        F.collect_list(F.struct("at", F.coalesce("class", "own").alias("class"))).alias("fills"), F.sum(F.col("f") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("f"))).alias("known")
    )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column("classes").to_pylist()
            length = np.fromiter(map(len, data), np.int64, len(data))
            found = np.frombuffer(b"".join(data), np.uint8).copy()
            fills = b.column("fills")
            values = fills.flatten()
            at = values.field("at")
            start = np.repeat(np.cumsum(length) - length, fills.value_lengths().fill_null(0).to_numpy())
            times = at.value_lengths().to_numpy()
            found[at.flatten().to_numpy() + np.repeat(start, times)] = np.repeat(values.field("class").to_numpy(), times)
            names = ["doc_id", "held_out", "n_tokens", "n_known", "logs"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], _binaries(length, found)], [*names, "classes"])

    joined = part.drop("rare").join(filled, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), (F.col("logs") + F.coalesce("more", F.lit(0.0))).alias("logs"), "classes", "fills")
    return joined.mapInArrow(whole, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, logs double, classes binary")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_words: int = ITEM_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row.

    The model learns from rows whose crc32(doc_id as text) mod 5 is not 1; a null id hashes as empty text. Null
    texts count as empty: one token, the end. A word that no training row has gets the class of its last characters.
    Where there is no training row every word is unknown, and classes are equally likely. Empty tables give no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(before), ROWS) if int(before) > 0 else ROWS))
    try:
        return _scored(docs, id_col, text_col, item_words)
    finally:
        spark.conf.set(_BATCH, before)


def _scored(docs: DataFrame, id_col: str, text_col: str, item_words: int) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    src = plain(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    vocab = stored(vocabulary(src.where(~held)))
    sums = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct"), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("n"))), F.lit(0)).alias("ends")).first()
    total, distinct, ends = sums["total"], sums["distinct"], sums["ends"]
    top = most_frequent(vocab, max(FREQUENT, item_words))
    own = [(w, n) for w, n in top if not w.startswith(b" ")][:item_words]
    items = {END: 0} | {w: i + 1 for i, (w, _) in enumerate(own)}
    rows = stored(encoded(src, items, item_words))
    training = rows.where("not held_out")
    classes, pairs, _ = clustered(training, item_words)
    table = stored(word_classes(training, classes, pairs))
    logs = np.log10(np.concatenate(([ends], [n for _, n in own], np.zeros(item_words - len(own)))) + 0.5)
    frequent = frequent_classes(table, {w: n for w, n in top[:FREQUENT] if w not in items})
    scored = stored(classified(rows, classes, logs, frequent, table, ends > 0))
    members = np.bincount(classes[list(items.values())], minlength=CLASSES).astype(float) - (0 if ends else np.eye(CLASSES)[0])
    for r in table.groupBy("class").count().collect():  # a row a class
        members[r["class"]] += r["count"]
    model = sc.broadcast(ClassModel(trigram_counts(scored.where("not held_out")), members))

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq = [model.value.sequence(np.frombuffer(x.as_buffer(), np.uint8)) for x in b.column("classes")]
            names = ["doc_id", "held_out", "n_tokens", "n_known", "logs"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(seq, pa.float64())], [*names, "seq"])

    out = scored.mapInArrow(sequences, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, logs double, seq double")
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(total + 0.5 * (distinct + 1))))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("logs") + F.col("seq")).alias("score"))


def frequent_classes(table: DataFrame, wanted: dict[bytes, int]) -> dict[bytes, tuple[float, int]]:
    """``entry`` -> (log10 of count and a half, class) of the wanted words, a bounded number."""
    if not wanted:
        return {}
    least = min(wanted.values())

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(entry, b.column("word").to_pylist()), pa.binary()), b.column("n"), b.column("class")], ["word", "n", "class"])

    found = table.where(F.col("n") >= least).mapInArrow(named, "word binary, n long, class int").toArrow()
    return {w: (float(np.log10(n + 0.5)), c) for w, n, c in zip(found["word"].to_pylist(), found["n"].to_pylist(), found["class"].to_pylist(), strict=True) if w in wanted}
