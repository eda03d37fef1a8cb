"""Token counts from pieces counted once per distinct pre-token.

A pre-token is a run of the meta space followed by characters of one kind. Two
characters are of one kind if pieces of the vocabulary join them, directly or
through others: letters are, marks and line ends mostly aren't joined to them.
No piece holds a meta space after another character. So no merge crosses the
border of a pre-token, and a document's count is the sum of its pre-tokens'
counts; ``PieceCounter`` refuses a model for which that is untrue.

The most frequent pre-tokens, found over all documents, go to every task with
their counts: a table bounded in entries, and in size, as a long pre-token has a
digest of 128 bits in it. All others meet their documents' frequencies by
shuffle, where each distinct one is counted once; none of them is frequent
enough to crowd a task.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, stored

#: Bounds of the broadcast table, in entries, and of what a task proposes for it. Pre-tokens of more code points than SHORT have a digest in their place.
FREQUENT, PROPOSED, SHORT = 400_000, 120_000, 32
#: Stands in front of a pre-token without a meta space, to keep that which encoding adds away from it.
_GUARD = "\n"


class PieceCounter:
    """Counts of SentencePiece pieces per pre-token, for models that keep all spaces and add one in front."""

    loaded: dict[str, PieceCounter] = {}

    def __init__(self, model: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.sp.serialized_model_proto())
        norm = proto.normalizer_spec
        if any(re.search("[^▁]▁", p.piece) for p in proto.pieces) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or any(p.type == 4 for p in proto.pieces):
            raise ValueError("this model's pieces cross the borders of pre-tokens")

        others = self._other_kinds([p.piece for p in proto.pieces if p.type == 1])
        kinds = f"[{''.join(map(re.escape, sorted(others)))}]+" if others else "(?!)"
        self.pattern = re.compile(f" *{kinds}| *[^ {kinds[1:-2]}]+| +" if others else " *[^ ]+| +")
        self.guard = len(self.sp.encode(_GUARD))
        if any(_GUARD in p.piece for p in proto.pieces):
            raise ValueError("this model joins line ends to other characters")

    @staticmethod
    def _other_kinds(pieces: list[str]) -> set[str]:
        """Characters that no chain of pieces joins to the letter a."""
        near: dict[str, set[str]] = {}
        for piece in pieces:
            bare = piece.lstrip("▁")
            for a, b in zip(bare, bare[1:], strict=False):
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        joined, todo = {"a"}, ["a"]
        while todo:
            for c in near.get(todo.pop(), set()) - joined:
                joined.add(c)
                todo.append(c)
        return ({c for piece in pieces for c in piece} | {_GUARD}) - joined - {"▁"}

    @classmethod
    def of(cls, model: str) -> PieceCounter:
        """One per Python worker."""
        if model not in cls.loaded:
            cls.loaded[model] = cls(model)
        return cls.loaded[model]

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens of the text behind the space that the model adds; a meta space in a text is a space to the model."""
        return self.pattern.findall(" " + text.replace("▁", " ")) if text else []

    def encode(self, pre_tokens: list[str]) -> list[list[int]]:
        """Encoding puts a meta space in front, so the pre-token's first space is left to it; a lone space is one piece."""
        guard, space = self.guard, [self.sp.piece_to_id("▁")]
        encoded = self.sp.encode([p[1:] if p[0] == " " else _GUARD + p for p in pre_tokens], num_threads=1)
        return [(x or space) if p[0] == " " else x[guard:] for p, x in zip(pre_tokens, encoded, strict=True)]

    def count(self, pre_tokens: list[str]) -> list[int]:
        return list(map(len, self.encode(pre_tokens)))


def entry(pre_token: str) -> str:
    """What stands for a pre-token in the broadcast table; a digest begins with a character that no pre-token has there."""
    return pre_token if len(pre_token) <= SHORT else f"\0\0{xxhash.xxh3_128_hexdigest(pre_token.encode('utf-8', 'surrogatepass'))}"


def frequent_pre_tokens(docs: DataFrame, model: str, text_col: str, entries: int = FREQUENT) -> dict[str, int]:
    """``entry`` and number of pieces of the most frequent pre-tokens of all documents, ``entries`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        split = PieceCounter.of(model).pre_tokens
        for b in batches:
            for t in b.column(0):
                seen.update(split(t.as_py()))
            if len(seen) > 20 * PROPOSED:  # keeps the task's memory bounded
                seen = Counter(dict(heapq.nlargest(10 * PROPOSED, seen.items(), key=itemgetter(1))))
        top = [(p, n) for p, n in heapq.nlargest(PROPOSED, seen.items(), key=itemgetter(1)) if n > 1]
        long = [p for p, _ in top if len(p) > SHORT]
        pieces = dict(zip(long, PieceCounter.of(model).count(long), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([entry(p) for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64()), pa.array([pieces.get(p) for p, _ in top], pa.int64())], ["pre", "n", "pieces"])

    proposed = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("text <> ''").mapInArrow(run, "pre string, n long, pieces long")
    merged = stored(proposed.groupBy("pre").agg(F.sum("n").alias("n"), F.first("pieces").alias("pieces")).withColumn("bin", F.floor(F.log2("n") * 64).cast("int")))
    least, total = None, 0
    for r in merged.groupBy("bin").count().orderBy(F.desc("bin")).collect():  # 4096 rows at most
        total += r["count"]
        if total > entries:
            break
        least = r["bin"]
    top = merged.where(F.lit(False) if least is None else F.col("bin") >= least).select("pre", "pieces").toArrow()
    pre, pieces = top["pre"].to_pylist(), top["pieces"].to_pylist()
    short = [p for p, c in zip(pre, pieces, strict=True) if c is None]
    return dict(zip(short, PieceCounter.of(model).count(short), strict=True)) | {p: c for p, c in zip(pre, pieces, strict=True) if c is not None}


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, entries: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one row per input row, repeated rows included.

    Null and empty texts have no tokens. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    src = plain(docs, id_col, text_col).toDF("doc_id", "text")
    known = spark.sparkContext.broadcast(frequent_pre_tokens(src, model, "text", entries))
    keyed = src.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    row = f"doc_id {id_type}, h long, pre string, n long, n_bytes long, docs int"

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document a row with what the frequent pre-tokens add up to, and one per rare pre-token. The first has a pre-token that no text has, its own key, to spread the rows."""
        counts, split = known.value, PieceCounter.of(model).pre_tokens
        for b in batches:
            ids, texts, hashes = b.column("doc_id"), b.column("text"), b.column("h").to_pylist()
            at, pre, n, size, one = [], [], [], [], []
            for i, t in enumerate(texts):
                text = t.as_py()
                total = 0
                for p, m in Counter(split(text)).items():
                    if (c := counts.get(p if len(p) <= SHORT else entry(p))) is None:
                        at.append(i), pre.append(p), n.append(m), size.append(0), one.append(0)
                    else:
                        total += c * m
                at.append(i), pre.append(f"\0{hashes[i]}"), n.append(total), size.append(len(text.encode("utf-8", "surrogatepass"))), one.append(1)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(take), b.column("h").take(take), pa.array(pre, pa.string()), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(one, pa.int32())], ["doc_id", "h", "pre", "n", "n_bytes", "docs"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by pre-token, all of one in one task: each distinct one is counted once."""
        pieces = PieceCounter.of(model)
        last, last_pieces = None, 0
        for b in batches:
            pre, one, n = b.column("pre").to_pylist(), b.column("docs").to_pylist(), b.column("n").to_pylist()
            runs = [(p, len(list(g))) for p, g in groupby(p for p, o in zip(pre, one, strict=True) if not o)]
            begun = bool(runs) and runs[0][0] == last  # counted at the end of the batch before
            counts = ([last_pieces] if begun else []) + pieces.count([p for p, _ in runs[begun:]])
            if runs:
                last, last_pieces = runs[-1][0], counts[-1]
            each = iter([c for c, (_, m) in zip(counts, runs, strict=True) for _ in range(m)])
            tokens = [m if o else m * next(each) for m, o in zip(n, one, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(tokens, pa.int64()), b.column("n_bytes"), b.column("docs")], ["doc_id", "h", "tokens", "n_bytes", "docs"])

    rows = keyed.mapInArrow(frequencies, row).repartition("pre").sortWithinPartitions("pre")
    sums = rows.mapInArrow(counted, f"doc_id {id_type}, h long, tokens long, n_bytes long, docs int").groupBy("doc_id", "h").agg(F.sum("tokens").alias("tokens"), F.sum("n_bytes").alias("bytes"), F.sum("docs").alias("docs"))
    each = sums.select("doc_id", F.expr("bytes div docs").alias("n_bytes"), F.expr("tokens div docs").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("long"), "docs")))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
