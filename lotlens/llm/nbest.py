"""N-best SentencePiece segmentation, and decoding.

Over the lattice of all pieces of a text, forward Viterbi scores say exactly
how well each place can be reached from the start. A search backward from the
end that takes the hypothesis with the best sum of its own score and that
heuristic therefore completes segmentations in order of their scores.

No piece crosses the border of a pre-token (see ``token_counts``), so the
lattice of a text is a chain of the lattices of its pre-tokens. Each pre-token is searched by
itself, and kept in a cache of two bounded generations. For the n best of the
whole text only the n - 1 pre-tokens with the least loss between best and second
best can differ from their best: any other change loses to n texts already
found. The same search runs over that short chain.

Scores are kept as whole numbers of 2**-20, so sums are exact and segmentations
of equal score tie exactly.

Models of type unigram are used with their own scores. A BPE model has ranks
for scores; they are read as Zipf's law: log p = -log(rank + 1) - log(H). As no
scores of single pieces give the segmentation that its merges make, an arc that
the merges don't take costs LEAVE for each of its characters, more than any
change of pieces gains. So the best segmentation is the one that the library
gives, and the next are those that leave it for the fewest characters. Two is the
fewest; what that costs a pre-token is read off its pieces, and the lattice of one
that can't be left so cheaply is searched only where a text has too few that can.
Characters without a piece are spelt in byte pieces, each below the least score.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from array import array
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain
from .token_counts import PieceCounter

BYTE_PENALTY, UNIT = 10.0, 1 << 20
#: Entries of a generation of the cache, and the longest pre-token that it takes.
CACHE, CACHE_CHARS = 400_000, 64

Path = tuple[float, tuple[int, ...]]
_FIRST, _SECOND, _THIRD = itemgetter(0), itemgetter(1), itemgetter(2)


class Lattice:
    """The pieces of one model, and searches over them."""

    loaded: dict[str, Lattice] = {}

    def __init__(self, model: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        self.counter = PieceCounter.of(model)
        self.split = self.counter.pre_tokens
        proto.ParseFromString(PieceCounter.of(model).sp.serialized_model_proto())
        normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
        if proto.trainer_spec.model_type == 2:
            harmonic = sum(1 / (r + 1) for r in range(len(normal)))
            normal = [(i, piece, -math.log(r + 1) - math.log(harmonic)) for r, (i, piece, _) in enumerate(normal)]
        normal = [(i, piece, float(round(score * UNIT))) for i, piece, score in normal]
        #: piece -> (id, score); None for what only begins pieces.
        self.pieces: dict[str, tuple[int, float] | None] = {piece[:k]: None for _, piece, _ in normal for k in range(1, len(piece))}
        self.pieces |= {piece: (i, score) for i, piece, score in normal}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_score = min(s for _, _, s in normal) - round(BYTE_PENALTY * UNIT)
        self.lengths = [len(p.piece) if p.type == 1 else 0 for p in proto.pieces]
        #: What a character off the merges' path costs: a character has four bytes at most.
        self.leave = 1 - 4 * self.byte_score if proto.trainer_spec.model_type == 2 else 0.0
        #: Scores of arcs off the path by piece (minus infinity for what only begins pieces), and on it by id.
        self.off_path = {piece: -math.inf if found is None else found[1] - self.leave * len(piece) for piece, found in self.pieces.items()}
        self.on_path = [0.0] * len(proto.pieces)
        for i, _, score in normal:
            self.on_path[i] = score
        #: What it costs to take a piece of two characters apart, by id; minus infinity for pieces of bytes, beside which ``beside`` looks.
        self.apart = [math.inf if p.type == 1 else -math.inf for p in proto.pieces]
        for i, piece, score in normal:
            if len(piece) == 2:
                self.apart[i] = score - sum(self._off(c) for c in piece)
        self.single = [n == 1 for n in self.lengths]
        #: Leaving the path for three characters or more costs this at least: no character has more than one piece of the path.
        self.far = 3 * (self.leave + min(s for _, _, s in normal))
        self.text_of = [p.piece.replace("▁", " ").encode() if p.type == 1 else b"" for p in proto.pieces]
        for b, i in self.byte_ids.items():
            self.text_of[i] = bytes([b])
        #: pre-token -> score, what the second best loses (``far`` if that isn't known, but is as much or more), ids of four bytes each.
        self.young: dict[str, tuple[float, float, bytes]] = {}
        self.old: dict[str, tuple[float, float, bytes]] = {}
        self.several: dict[tuple[str, int], list[Path]] = {}

    @classmethod
    def of(cls, model: str) -> Lattice:
        """One per Python worker."""
        if model not in cls.loaded:
            cls.loaded[model] = cls(model)
        return cls.loaded[model]

    def _off(self, char: str) -> float:
        """The score of a character off the merges' path."""
        alone = self.off_path.get(char, -math.inf)
        return alone if alone > -math.inf else self.byte_score * len(char.encode("utf-8", "surrogatepass")) - self.leave

    def path(self, pre: str, ids: list[int]) -> list[int]:
        """Where the library's piece at each place of a pre-token ends; 0 where none begins."""
        ends, at, k = [0] * len(pre), 0, 0
        while at < len(pre):
            size = self.lengths[ids[k]]
            k += 1 if size else len(pre[at].encode("utf-8", "surrogatepass"))
            ends[at] = at + (size or 1)
            at = ends[at]
        return ends

    def arcs(self, text: str, path: list[int]) -> tuple[list[float], list[list[tuple[int, float, tuple[int, ...]]]]]:
        """Forward Viterbi scores, and the arcs (start, score, ids) that end at each place. path: the library's; empty if leaving it costs nothing."""
        size, known, leave = len(text), self.pieces, self.leave
        best, into = [-math.inf] * (size + 1), [[] for _ in range(size + 1)]
        best[0] = 0
        for i in range(size):
            at, alone, end = best[i], False, path[i] if path else 0
            for j in range(i + 1, size + 1):
                found = known.get(text[i:j], 0)
                if found == 0:
                    break
                if found is not None:
                    alone = alone or j == i + 1
                    score = found[1] if j == end else found[1] - leave * (j - i)
                    into[j].append((i, score, found[:1]))
                    if at + score > best[j]:
                        best[j] = at + score
            if not alone:
                spelt = tuple(self.byte_ids[b] for b in text[i].encode("utf-8", "surrogatepass"))
                score = self.byte_score * len(spelt) - (0 if end == i + 1 else leave)
                into[i + 1].append((i, score, spelt))
                best[i + 1] = max(best[i + 1], at + score)
        return best, into

    def search(self, text: str, n: int, path: list[int]) -> list[Path]:
        """The n best segmentations of a text with meta spaces, best first: backward A-star.

        Of equal hypotheses the latest goes first, so that a text of equal characters, whose segmentations mostly tie,
        is followed to its start instead of everywhere at once.
        """
        best, into = self.arcs(text, path)
        agenda = [(-best[-1], 0, len(text), 0, ())]
        found: list[Path] = []
        tick = 0
        while agenda and len(found) < n:
            _, _, at, score, tail = heapq.heappop(agenda)
            if at == 0:
                ids: list[int] = []
                while tail:
                    ids.extend(tail[0])
                    tail = tail[1]
                found.append((score, tuple(ids)))
                continue
            for start, s, ids in into[at]:
                tick -= 1
                heapq.heappush(agenda, (-(best[start] + s + score), tick, start, s + score, (ids, tail)))
        return found

    def beside(self, text: str, ids: list[int]) -> tuple[float, float]:
        """Score of the library's segmentation, which is the best, and what the second best loses (infinite if there is none).

        left holds at each place the best score of those that have left the library's path before it.
        """
        size, known, on, none = len(text), self.off_path, self.on_path, -math.inf
        left = [none] * (size + 1)
        score, end, k = 0.0, 0, 0
        for i in range(size):
            char = text[i]
            alone = known.get(char, none)
            if i == end:  # a place of the path: here it can be left
                piece = self.lengths[ids[k]]
                end = i + (piece or 1)
                if piece:
                    own = on[ids[k]]
                    k += 1
                else:
                    spelt = len(char.encode("utf-8", "surrogatepass"))
                    own = self.byte_score * spelt
                    k += spelt
                at, to = score, end
                score += own
                if left[i] + own > left[end]:
                    left[end] = left[i] + own
            else:
                at, to = left[i], 0
                if at == none:
                    continue
            if alone == none:
                if to != i + 1:
                    other = at + self.byte_score * len(char.encode("utf-8", "surrogatepass")) - self.leave
                    if other > left[i + 1]:
                        left[i + 1] = other
            for j in range(i + 1, size + 1):
                found = known.get(text[i:j])
                if found is None:
                    break
                if j != to and at + found > left[j]:
                    left[j] = at + found
        return score, score - left[size]

    def nearly(self, text: str, ids: list[int]) -> tuple[float, float]:
        """Score of the library's segmentation, and what the second best loses if it leaves it for two characters: a piece of two taken apart, or two of one made one. Else ``far``."""
        loss = min(map(self.apart.__getitem__, ids))
        if loss == -math.inf:
            return self.beside(text, ids)
        if sum(map(self.single.__getitem__, ids)) > 1:
            at = 0
            for a, b in zip(ids, ids[1:], strict=False):
                if self.single[a] and self.single[b] and (both := self.off_path.get(text[at : at + 2], -math.inf)) > -math.inf:
                    loss = min(loss, self.on_path[a] + self.on_path[b] - both)
                at += self.lengths[a]
        return sum(map(self.on_path.__getitem__, ids)), min(loss, self.far)

    def _looked_up(self, pre_tokens: list[str]) -> None:
        """Brings the pre-tokens into the young generation, whatever their length; ``nbest`` removes the long ones."""
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        new = []
        for pre in pre_tokens:
            if (found := self.old.get(pre)) is None:
                new.append(pre)
            else:
                self.young[pre] = found
        for pre, ids in zip(new, self.counter.encode(new) if self.leave else new, strict=True):
            text = pre.replace(" ", "▁")
            if self.leave:
                self.young[pre] = (*self.nearly(text, ids), array("i", ids).tobytes())
            else:
                found = self.search(text, 2, [])
                self.young[pre] = (found[0][0], found[0][0] - found[1][0] if len(found) > 1 else math.inf, array("i", found[0][1]).tobytes())

    def _resolved(self, pre: str, found: tuple[float, float, bytes]) -> float:
        """What the second best really loses."""
        _, loss = self.beside(pre.replace(" ", "▁"), np.frombuffer(found[2], np.int32).tolist())
        if loss != self.far and pre in self.young:
            self.young[pre] = (found[0], loss, found[2])
        return loss

    def _several(self, pre: str, n: int) -> list[Path]:
        found = self.several.get((pre, n))
        if found is None:
            found = self.search(pre.replace(" ", "▁"), n, self.path(pre, self.counter.encode([pre])[0]) if self.leave else [])
            if len(pre) <= CACHE_CHARS:
                if len(self.several) >= CACHE // 4:
                    self.several.clear()
                self.several[pre, n] = found
        return found

    def nbest(self, text: str, n: int) -> tuple[list[tuple[float, np.ndarray]], bool]:
        """The n best segmentations of a whole text, best first, and whether all of them decode to one text, that of the first.

        An empty text has one segmentation, without pieces.
        """
        pre = self.split(text)
        each = list(map(self.young.get, pre))
        if None in each:
            missing = list(dict.fromkeys(p for p, e in zip(pre, each, strict=True) if e is None))
            self._looked_up(missing)
            each = [e or self.young[p] for p, e in zip(pre, each, strict=True)]
            for p in missing:
                if len(p) > CACHE_CHARS:
                    del self.young[p]
        total = sum(map(_FIRST, each))
        parts = list(map(_THIRD, each))
        ids = np.frombuffer(b"".join(parts), np.int32)
        if n == 1 or not pre:
            return [(total / UNIT, ids)], True
        loss = np.fromiter(map(_SECOND, each), np.float64, len(each))
        if self.leave and np.count_nonzero(loss < self.far) < min(n - 1, len(loss)):
            for i in np.flatnonzero(loss == self.far).tolist():
                loss[i] = self._resolved(pre[i], each[i])
        few = [int(i) for i in np.sort(self._least(loss, min(n - 1, len(loss)))) if loss[i] < math.inf]
        # The chain of the places that may change: a hypothesis is the choice at each of them from the last on.
        choices = [self._several(pre[i], n) for i in few]
        agenda, picked, tick = [(0, 0, len(few), ())], [], 0
        while agenda and len(picked) < n:
            lost, _, at, tail = heapq.heappop(agenda)
            if at == 0:
                picked.append((lost, tail))
                continue
            for k, (score, _) in enumerate(choices[at - 1]):
                tick += 1
                heapq.heappush(agenda, (lost + choices[at - 1][0][0] - score, tick, at - 1, (k, *tail)))
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4)
        out, alike = [], True
        for lost, picks in picked:
            pieces, at = [], 0
            for c, (i, k) in enumerate(zip(few, picks, strict=True)):
                changed, own = choices[c][k][1], ids[ends[i] - len(parts[i]) // 4 : ends[i]].tolist()
                if list(changed) != own:
                    pieces += [ids[at : ends[i] - len(own)], np.array(changed, np.int32)]
                    at = int(ends[i])
                    alike = alike and self.bytes_of(changed) == self.bytes_of(own)
            out.append(((total - lost) / UNIT, np.concatenate([*pieces, ids[at:]]) if pieces else ids))
        return out, alike

    @staticmethod
    def _least(loss: np.ndarray, k: int) -> np.ndarray:
        """Places of the k least values, the first of equal ones."""
        edge = np.partition(loss, k - 1)[k - 1]
        return np.concatenate((np.flatnonzero(loss < edge), np.flatnonzero(loss == edge)))[:k]

    def bytes_of(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.text_of.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        """The text, without the space that encoding put in front."""
        return self.bytes_of(ids).decode("utf-8", "surrogatepass")[1:]


def encode(docs: DataFrame, model: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_pieces, score (of the best segmentation), best: array of (score, n_pieces, ids), best first.

    One row per input row. With ``digests`` instead of ids each has ids_sha256 (ids as 4 bytes, little-endian) and
    text_sha256 (of its decoded text), and the row has decodes: all of them decode to the text. A text may have
    fewer than n segmentations; null counts as empty, and an empty text has one, of no pieces. Meta spaces in a
    text are spaces to the model, and decode to spaces. Empty tables give no rows; other columns are ignored.
    """
    src = plain(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    item = "score:double,n_pieces:int," + ("ids_sha256:string,text_sha256:string" if digests else "ids:array<int>")
    item_type = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int32()), *([("ids_sha256", pa.string()), ("text_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32()))])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.of(model)
        for b in batches:
            for at in range(0, b.num_rows, 256):  # rows of ids are large
                part = b.slice(at, 256)
                rows, decodes = [], []
                for t in part.column("text"):
                    text = t.as_py()
                    found, alike = lattice.nbest(text, n)
                    if digests:
                        back = lattice.decode(found[0][1].tolist())
                        decodes.append(alike and back == text.replace("▁", " "))
                        texts = [back if alike else lattice.decode(ids.tolist()) for _, ids in found]
                        same = hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()
                        rows.append([{"score": score, "n_pieces": len(ids), "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest(), "text_sha256": same if text is back else hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()} for (score, ids), text in zip(found, texts, strict=True)])
                    else:
                        rows.append([{"score": score, "n_pieces": len(ids), "ids": ids} for score, ids in found])
                columns = [part.column("doc_id"), pa.array([r[0]["n_pieces"] for r in rows], pa.int32()), pa.array([r[0]["score"] for r in rows], pa.float64()), pa.array(rows, item_type)]
                names = ["doc_id", "n_pieces", "score", "best"]
                if digests:
                    columns.append(pa.array(decodes, pa.bool_()))
                    names.append("decodes")
                yield pa.RecordBatch.from_arrays(columns, names)

    return src.mapInArrow(run, f"doc_id {id_type}, n_pieces int, score double, best array<struct<{item}>>" + (", decodes boolean" if digests else ""))


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id, text of each row's ids; null ids decode to null."""
    src = plain(encoded, id_col, ids_col).toDF("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.of(model)
        for b in batches:
            texts = [None if x is None else lattice.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")
