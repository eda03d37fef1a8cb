"""Byte-level BPE by DuckDB's recursive queries, one database in each Python worker.

Spark deals out the texts; within a partition the distinct matches of the
pattern that a worker hasn't met become rows of (word, position, width, token),
one a byte. The recursive query joins neighbours with the table of merges and
contracts each word's pair of least rank, the leftmost first, until no word has
a pair left. A step also contracts what that order must come to anyway: all
pairs of that rank, where whatever can be made of the merged token ranks behind
it (``calm``), and calm pairs whose halves nothing that ranks before them can
take (``sure``), given the bytes beside them: these are the same in any order.
A word that is a token as a whole is taken as it is.

Decoding joins the rows (position, token) of many texts with the vocabulary and
aggregates their bytes in order; the tokens' widths tell where a text ends.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain

#: Matches that are looked up together, characters of new words that a query takes and steps that it goes, entries and bytes of each half of a worker's table of words, and tokens that a query decodes.
CHUNK, BYTES, STEPS, KNOWN, KNOWN_BYTES, TOKENS = 300_000, 3 << 17, 16, 180_000, 24 << 20, 300_000

#: The rows of each word after its last step; ``done`` if no pair is left. behind, ahead: the bytes beside a token, -1 at a word's ends.
_CONTRACT = f"""
WITH RECURSIVE t(word, step, pos, width, tok, behind, ahead) AS (
  SELECT word, 0, pos, width, tok, behind, ahead FROM start
  UNION ALL
  (WITH beside AS (SELECT *, lead(tok) OVER w AS tok2, lead(width) OVER w AS width2, lead(ahead) OVER w AS ahead2 FROM t WHERE step < {STEPS} WINDOW w AS (ORDER BY pos)),
   pairs AS MATERIALIZED (SELECT t.*, m.id, calm, m.l = m.r AS twin, calm AND m.id < coalesce(x.id, 2147483647) AND m.id < coalesce(y.id, 2147483647) AS sure
      FROM beside t LEFT JOIN merges m ON ahead >= 0 AND m.l = t.tok AND m.r = t.tok2 LEFT JOIN leftward x ON x.tok = t.tok AND x.beside = t.behind LEFT JOIN rightward y ON y.tok = t.tok2 AND y.beside = t.ahead2),
   low AS (SELECT word, min(id::BIGINT << 32 | pos) AS low FROM pairs WHERE id IS NOT NULL GROUP BY word),
   found AS (SELECT p.*, coalesce(sure OR id = low >> 32 AND (calm OR pos = low & 4294967295), false) AS fits FROM pairs p JOIN low USING (word)),
   runs AS (SELECT *, max(CASE WHEN NOT fits OR NOT twin THEN pos + width WHEN behind < 0 THEN pos END) OVER (ORDER BY pos) AS run FROM found),
   hits AS (SELECT *, fits AND (NOT twin OR (pos - run) // width % 2 = 0) AS hit FROM runs),
   chosen AS (SELECT *, lag(hit, 1, false) OVER (ORDER BY pos) AS gone FROM hits)
   SELECT word, step + 1, pos, CASE WHEN hit THEN width + width2 ELSE width END, CASE WHEN hit THEN id ELSE tok END, behind, CASE WHEN hit THEN ahead2 ELSE ahead END FROM chosen WHERE NOT gone)
), l AS (SELECT word, max(step) AS step FROM t GROUP BY word)
SELECT word, pos, width, tok, behind, ahead, step < {STEPS} AS done FROM t JOIN l USING (word, step) ORDER BY pos"""

#: All pairs of tokens that together are a token; calm: no pair with the merged token ranks before it.
_MERGES = """
WITH m AS (SELECT x.id AS l, y.id AS r, t.id FROM (SELECT id, hex, unnest(range(1, length(hex) // 2)) AS cut FROM vocabulary) t
  JOIN vocabulary x ON x.hex = left(t.hex, 2 * cut) JOIN vocabulary y ON y.hex = substr(t.hex, 2 * cut + 1)),
later AS (SELECT part, min(id) AS id FROM (SELECT l AS part, id FROM m UNION ALL SELECT r, id FROM m) GROUP BY part)
SELECT l, r, m.id, m.id < coalesce(later.id, 2147483647) AS calm FROM m LEFT JOIN later ON later.part = m.id"""

#: The least rank that takes a token from its left (right), where that side ends (begins) with a byte.
_BESIDE = {
    "leftward": "SELECT r AS tok, ('0x' || right(hex, 2))::INT AS beside, min(m.id) AS id FROM merges m JOIN vocabulary v ON v.id = l GROUP BY ALL",
    "rightward": "SELECT l AS tok, ('0x' || left(hex, 2))::INT AS beside, min(m.id) AS id FROM merges m JOIN vocabulary v ON v.id = r GROUP BY ALL",
}

_DECODE = "SELECT string_agg(hex, '' ORDER BY pos) AS hex FROM token JOIN vocabulary ON vocabulary.id = token.id"


class Coder:
    """A worker's database of one rank file, and the words it has encoded."""

    loaded: dict[tuple[str, str], Coder] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import duckdb
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the ranks lack the bytes {missing[:5]}")
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.db.register("given", pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [b.hex() for b in ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.db.unregister("given")
        self.db.execute(f"CREATE TABLE merges AS {_MERGES}")
        for side, query in _BESIDE.items():
            self.db.execute(f"CREATE TABLE {side} AS {query}")
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.widths[list(ranks.values())] = [len(b) for b in ranks]
        #: Words that are tokens as they are; the words met of late, and those before them, of which the ones met again move up.
        self.tokens = {t: i.to_bytes(4, "little") for b, i in ranks.items() if (t := b.decode(errors="replace")).encode() == b}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def of(cls, ranks: str, pattern: str) -> Coder:
        """One per Python worker. ranks: the path of the rank file."""
        if (ranks, pattern) not in cls.loaded:
            with open(ranks, "rb") as f:
                cls.loaded[ranks, pattern] = cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)
        return cls.loaded[ranks, pattern]

    def contracted(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words of a byte at least: a recursive query goes STEPS steps, the next takes up the words that aren't done."""
        raw, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        behind, ahead = np.empty(len(raw), np.int32), np.empty(len(raw), np.int32)
        behind[1:], ahead[:-1] = raw[:-1], raw[1:]
        behind[ends - sizes], ahead[ends - 1] = -1, -1
        state = pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": np.arange(len(raw), dtype=np.int32), "width": np.ones(len(raw), np.int32), "tok": self.byte[raw], "behind": behind, "ahead": ahead})
        out = [b""] * len(words)
        while state.num_rows:
            self.db.register("start", state)
            after = self.db.sql(_CONTRACT).to_arrow_table()
            self.db.unregister("start")
            word, done = after["word"].to_numpy(), after["done"].to_numpy()
            ids = after["tok"].to_numpy()[done].astype("<u4").tobytes()
            found, first = np.unique(word[done], return_index=True)  # in order, as positions are
            bounds = np.append(first, len(ids) // 4)
            for w, a, b in zip(found.tolist(), (4 * bounds[:-1]).tolist(), (4 * bounds[1:]).tolist(), strict=True):
                out[w] = ids[a:b]
            state = after.filter(pa.array(~done)).drop_columns(["done"])
        return out

    def _keep(self, found: dict[str, bytes]) -> None:
        self.known.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values()))

    def learn(self, met: set[str]) -> None:
        """Sees that the table has all these words. Where its newer half would outgrow its bounds, it becomes the older one, and what was that goes."""
        new = met - self.known.keys()
        if len(self.known) + len(new) > KNOWN or self.held > KNOWN_BYTES:
            self.known, self.older, self.held, new = {}, self.known, 0, met
        self._keep({w: self.older[w] for w in new & self.older.keys()})
        self._keep({w: self.tokens[w] for w in (new - self.known.keys()) & self.tokens.keys()})
        todo, size = [], 0
        for word in new - self.known.keys():
            todo.append(word)
            size += len(word)
            if size > BYTES:
                self._keep(dict(zip(todo, self.contracted([w.encode() for w in todo]), strict=True)))
                todo, size = [], 0
        if todo:
            self._keep(dict(zip(todo, self.contracted([w.encode() for w in todo]), strict=True)))

    def encode(self, texts: Iterator[str]) -> Iterator[bytes]:
        """The ids of each text, little-endian and of 32 bits each; CHUNK matches are held at once, of one text or of many."""
        waiting: list[tuple[bool, list[str]]] = []  # does the text end here, its matches
        n, parts = 0, []

        def flush() -> Iterator[bytes]:
            nonlocal n, parts, waiting
            self.learn(set().union(*(words for _, words in waiting)))
            look = self.known.__getitem__
            for ends, words in waiting:
                parts.append(b"".join(map(look, words)))
                if ends:
                    yield b"".join(parts)
                    parts = []
            waiting, n = [], 0

        for text in texts:
            words: list[str] = []
            for match in self.pattern.finditer(text) if len(text) > CHUNK else (self.pattern.findall(text),):
                if isinstance(match, list):
                    words = match
                    continue
                words.append(match[0])
                if len(words) >= CHUNK:
                    waiting.append((False, words))
                    words = []
                    yield from flush()
            waiting.append((True, words))
            n += len(words)
            if n >= CHUNK or len(waiting) >= CHUNK:
                yield from flush()
        yield from flush()

    def decode(self, packed: Iterator[bytes]) -> Iterator[bytes]:
        """The bytes of each text's ids; an id that the vocabulary lacks is an error."""
        waiting: list[tuple[bool, np.ndarray]] = []
        n, parts = 0, []

        def flush() -> Iterator[bytes]:
            nonlocal n, parts, waiting
            ids = np.concatenate([x for _, x in waiting]) if waiting else np.empty(0, np.uint32)
            found = [b""] * len(waiting)
            if len(ids):
                sizes = [len(x) for _, x in waiting]
                if (lost := ids[(ids >= len(self.widths)) | (self.widths[np.minimum(ids, len(self.widths) - 1)] == 0)]).size:
                    raise ValueError(f"the vocabulary has no token {lost[0]}")
                token = pa.table({"pos": np.arange(len(ids), dtype=np.int32), "id": ids.astype(np.int32)})
                self.db.register("token", token)
                try:
                    whole = bytes.fromhex(self.db.sql(_DECODE).fetchall()[0][0])
                finally:
                    self.db.unregister("token")
                bounds = np.concatenate([[0], np.cumsum(self.widths[ids])])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
                found = [whole[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            for (last, _), piece in zip(waiting, found, strict=True):
                parts.append(piece)
                if last:
                    yield b"".join(parts)
                    parts = []
            waiting, n = [], 0

        for raw in packed:
            ids = np.frombuffer(raw, "<u4")
            for at in range(0, max(len(ids), 1), TOKENS):
                piece = ids[at : at + TOKENS]
                waiting.append((at + TOKENS >= len(ids), piece))
                n += len(piece)
                if n >= TOKENS or len(waiting) >= TOKENS:
                    yield from flush()
        yield from flush()


def _mapped(df: DataFrame, ranks: str, pattern: str, column: str, kind: str) -> DataFrame:
    """doc_id and what the coder's method ``kind`` makes of ``column``; batches out end where their bytes are many."""
    rest = [c for c in df.columns if c != column] + ([column] if kind == "decode" else [])
    made = "ids" if kind == "encode" else "decoded"
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest) + f", {made} binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(ranks, pattern)
        for b in batches:
            begin, held, size = 0, [], 0
            for out in getattr(coder, kind)(x.as_py() for x in b.column(column)):
                held.append(out)
                size += len(out)
                if size > 16 << 20 or begin + len(held) == b.num_rows:
                    part = b.slice(begin, len(held))
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pa.array(held, pa.binary())], [*rest, made])
                    begin, held, size = begin + len(held), [], 0

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian, 32 bits each): as the library encodes ordinary text with these ranks, special strings being text.

    One row per input row. Null and empty texts have no ids. Empty tables give no rows; other columns are ignored.
    """
    src = plain(docs, id_col, text_col).toDF("doc_id", "text")
    return _mapped(src.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), ranks, pattern, "text", "encode")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The rows of ``encode`` with decoded, the bytes that their ids stand for. An id outside of the vocabulary is an error."""
    return _mapped(encoded, ranks, pattern, "ids", "decode")
