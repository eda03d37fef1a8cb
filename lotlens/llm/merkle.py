"""A Merkle manifest of a dataset: blocks reduced where they lie, a small upper tree on the driver.

Leaves are hashed by Spark's own SHA-256 and placed by a sort over ranges: a
row's place in its tree is its place in its range and the rows of the ranges
before. Every ``BLOCK`` consecutive nodes of a tree are reduced by one task to
the node ``LEVELS`` levels above them. That is repeated until ``TOP`` nodes are
left, which go to the driver; it builds the tree above them and broadcasts for
each the path to the root. Where even the subroots are more than ``TOP``, they
become the nodes of one tree first and are reduced in the same way.

Then the paths come down again, a round at a time: a block's nodes get theirs
from the block's, at last the leaves, whose tasks finish each row's proof and
fold its leaf, or what tampering made of it, along the original siblings. A path
is text: runs of siblings ``left|right`` parted by ``/``, those within the tree,
then ``;``, the subroot, ``;`` and those above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import plain, stored

# Nodes of a run, and of how many rows one is tampered with.
ARITY, TAMPERED = 8, 3
#: Levels that a task climbs at once, and nodes that go to the driver (their paths are about 2 kB each).
LEVELS, TOP = 4, 4096
#: The tree of subroots; trees by lang are named '-' (null) or '=' and the lang, which keeps null first and the order of the bytes.
_ROOT = "*"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, id_col: str = "doc_id", columns: tuple[str, ...] = ("source", "lang", "n_chars", "text"), tree_col: str = "lang", text_col: str = "text") -> DataFrame:
    """doc_id, tree, leaf, and tampered: the leaf with A-Z lower-cased in the text where 3 divides the id's crc32, else null. A null id counts as empty text."""
    src = plain(docs, id_col, *columns).toDF("doc_id", *[f"c{i}" for i in range(len(columns))])
    lower = F.translate(F.col(f"c{columns.index(text_col)}").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tree = F.col(f"c{columns.index(tree_col)}").cast("string")
    hashed = lambda change: F.sha2(F.concat(_field(F.col("doc_id")), *[_field(lower if change and c == text_col else F.col(f"c{i}")) for i, c in enumerate(columns)]), 256)
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % TAMPERED == 0
    return src.select("doc_id", F.coalesce(F.concat(F.lit("="), tree), F.lit("-")).alias("tree"), hashed(False).alias("leaf"), F.when(chosen, hashed(True)).alias("tampered"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """With n, the rows of the same tree, and pos, the row's place among them by ``order``, from 0 on.

    Sorted by ranges, of which none needs to hold a whole tree: rows that tie in all of ``order`` are dealt out, too.
    """
    keys = ["tree", *order]
    spread = rows.repartitionByRange(*keys, F.rand(13)).sortWithinPartitions(*keys)
    mid = F.monotonically_increasing_id()  # the range, and in its last 33 bits the place in it
    kept = stored(spread.select(*rows.columns, F.shiftright(mid, 33).alias("range"), mid.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    runs = kept.groupBy("tree", "range").agg(F.min("at").alias("from"), F.count("*").alias("rows"))
    before = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most a row for each range
    shift = runs.select("tree", "range", F.sum("rows").over(Window.partitionBy("tree")).alias("n"), (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("from")).alias("shift"))
    return kept.join(shift, ["tree", "range"]).select(*rows.columns, "n", (F.col("at") + F.col("shift")).alias("pos"))


def climb(nodes: list[str], levels: int | None = None) -> list[list[str]]:
    """The levels from the nodes on: ``levels`` above them, or until one node is left."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + ARITY]) for i in range(0, len(out[-1]), ARITY)])
    return out


def siblings(levels: list[list[str]], pos: int) -> str:
    """Those of the node at ``pos`` below the last of the levels, as a path's runs."""
    runs = []
    for nodes in levels[:-1]:
        first = pos - pos % ARITY
        runs.append(f"{''.join(nodes[first:pos])}|{''.join(nodes[pos + 1 : first + ARITY])}")
        pos //= ARITY
    return "/".join(runs)


def joined(*runs: str) -> str:
    return "/".join(r for r in runs if r)


def fold(node: str, runs: str) -> str:
    for run in runs.split("/") if runs else ():
        left, _, right = run.partition("|")
        node = digest(left, node, right)
    return node


def _in_blocks(rows: DataFrame, levels: int) -> DataFrame:
    """With block; the nodes of each together and in order, in one task."""
    size = ARITY**levels
    return rows.withColumn("block", F.floor(F.col("pos") / size).cast("long")).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The columns of one block after the other; its rows may come in several batches."""
    held: dict[str, list] = {}
    for b in batches:
        columns = {name: b.column(name).to_pylist() for name in b.schema.names}
        keys = list(zip(columns["tree"], columns["block"], strict=True))
        cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for begin, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if begin == end:
                continue
            part = {name: values[begin:end] for name, values in columns.items()}
            if held and (held["tree"][0], held["block"][0]) == keys[begin]:
                for name, values in part.items():
                    held[name] += values
            else:
                if held:
                    yield held
                held = part
    if held:
        yield held


def reduced(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """tree, n, pos, node of the nodes ``levels`` above; a tree of one block ends in its root. nodes: the same columns."""
    size = ARITY**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            n = block["n"][0]
            top = climb(block["node"], levels if n > size else None)[-1][0]
            yield pa.RecordBatch.from_arrays([pa.array(block["tree"][:1]), pa.array([-(-n // size)], pa.int64()), pa.array(block["block"][:1], pa.int64()), pa.array([top])], ["tree", "n", "pos", "node"])

    return _in_blocks(nodes, levels).select("tree", "n", "pos", "node", "block").mapInArrow(run, "tree string, n long, pos long, node string")


def upper_tree(nodes: list[tuple[str, int, str]]) -> tuple[str, dict[tuple[str, int], str]]:
    """The root, and the path of each of a few nodes (tree, pos, node)."""
    trees: dict[str, list[str]] = {}
    for tree, _, node in sorted(nodes):
        trees.setdefault(tree, []).append(node)
    levels = {tree: climb(found) for tree, found in trees.items()}
    order = sorted(trees, key=str.encode)
    above = climb([levels[tree][-1][0] for tree in order])
    paths = {}
    for place, tree in enumerate(order):
        up, subroot = siblings(above, place), levels[tree][-1][0]
        for pos in range(len(trees[tree])):
            within = siblings(levels[tree], pos)
            # Of the tree of subroots, all runs lie above them.
            paths[tree, pos] = f";;{joined(within, up)}" if tree == _ROOT else f"{within};{subroot};{up}"
    return above[-1][0], paths


def descended(nodes: DataFrame, paths: DataFrame | dict[tuple[str, int], str], levels: int = LEVELS) -> DataFrame:
    """tree, pos, path of each node, from those of the nodes ``levels`` above: a broadcast dict, or rows tree, pos, path."""
    size = ARITY**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            inner, of_block = _inner(block, levels, size, known.value if known else None)
            within, subroot, above = of_block.split(";")
            out = []
            for i in range(len(inner[0])):
                own = siblings(inner, i)
                out.append(f";;{joined(own, above)}" if block["tree"][0] == _ROOT else f"{joined(own, within)};{subroot};{above}")
            k = len(out)
            yield pa.RecordBatch.from_arrays([pa.array(block["tree"][-k:]), pa.array(block["pos"][-k:], pa.int64()), pa.array(out)], ["tree", "pos", "path"])

    rows, known = _with_paths(nodes, paths, levels, [])
    return rows.mapInArrow(run, "tree string, pos long, path string")


def _with_paths(nodes: DataFrame, paths: DataFrame | dict[tuple[str, int], str], levels: int, more: list[str]) -> tuple:
    """The nodes in blocks; where paths are rows, the block's own stands in front of its nodes."""
    columns = ["tree", "n", "pos", "node", *more]
    rows = _in_blocks(nodes.select(*columns), levels)
    if isinstance(paths, dict):
        return rows.withColumn("path", F.lit(None).cast("string")), nodes.sparkSession.sparkContext.broadcast(paths)
    size = ARITY**levels
    whole = nodes.select(*columns).withColumns({"block": F.floor(F.col("pos") / size).cast("long"), "path": F.lit(None).cast("string")})
    heads = paths.select("tree", F.col("pos").alias("block"), "path", F.lit(-1).cast("long").alias("pos"))
    both = whole.unionByName(heads, allowMissingColumns=True)
    return both.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos"), None


def _inner(block: dict[str, list], levels: int, size: int, known: dict[tuple[str, int], str] | None) -> tuple[list[list[str]], str]:
    """The block's levels, and the path of its top."""
    if known is None:
        of_block = block["path"][0]
        nodes, n = block["node"][1:], block["n"][1]
    else:
        of_block = known[block["tree"][0], block["block"][0]]
        nodes, n = block["node"], block["n"][0]
    return climb(nodes, levels if n > size else None), of_block


def manifest(docs: DataFrame, id_col: str = "doc_id", columns: tuple[str, ...] = ("source", "lang", "n_chars", "text"), tree_col: str = "lang", levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; one row per input row.

    A leaf is the hash of the id and the columns, each ``-`` if null, else its bytes' number, a colon and the value.
    Within a tree null ids come first, rows of one id by their leaves; rows equal in both are interchangeable. Null is a
    tree of its own, beside that of the empty string. A sole row is its own proof: no siblings, the hash of nothing. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = stored(placed(leaves(docs, id_col, columns, tree_col), "doc_id", "leaf").withColumnRenamed("leaf", "node"))
    rounds: list[tuple[DataFrame, DataFrame | None]] = [(rows, None)]  # the nodes of a round; the trees' places in that of subroots, where it joined them
    nodes = stored(reduced(rows, levels))
    while (many := nodes.agg(F.count("*").alias("nodes"), F.max("n").alias("n")).first())["nodes"] > top:
        if many["n"] > 1:
            rounds.append((nodes, None))
            nodes = stored(reduced(nodes, levels))
            continue
        subroots = stored(placed(nodes.select(F.lit(_ROOT).alias("tree"), F.col("tree").alias("of"), "node"), "of"))
        rounds.append((nodes, subroots))
        nodes = subroots.select("tree", "n", "pos", "node")
    found = [(r["tree"], r["pos"], r["node"]) for r in nodes.select("tree", "pos", "node").collect()]  # TOP rows at most
    root, paths = upper_tree(found) if found else ("", {})
    known: DataFrame | dict[tuple[str, int], str] = paths
    for below, subroots in reversed(rounds[1:]):
        if subroots is not None:
            if isinstance(known, dict):
                known = spark.createDataFrame([(t, p, x) for (t, p), x in known.items()], "tree string, pos long, path string")
            theirs = subroots.select("of", "pos", F.col("node").alias("subroot")).join(known.select("pos", "path"), "pos")
            known = stored(theirs.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), F.concat(F.lit(";"), "subroot", F.lit(";"), F.substring_index("path", ";", -1)).alias("path")))
        else:
            known = stored(descended(below, known, levels))
    return _finished(rows, known, root, levels)


def _finished(rows: DataFrame, paths: DataFrame | dict[tuple[str, int], str], root: str, levels: int) -> DataFrame:
    size, id_type = ARITY**levels, rows.schema["doc_id"].dataType.simpleString()
    arrow_id = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal arrow_id

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal arrow_id
            for b in batches:
                arrow_id = b.schema.field("doc_id").type
                yield b

        for block in _blocks(watched()):
            inner, of_block = _inner(block, levels, size, known.value if known else None)
            k = len(inner[0])
            within, subroot, above = of_block.split(";")
            rest = joined(within, above)
            after = rest.replace("|", "").replace("/", "")
            proof, folded = [], []
            for i, (leaf, tampered) in enumerate(zip(inner[0], block["tampered"][-k:], strict=True)):
                own = siblings(inner, i)
                proof.append(digest(own.replace("|", "").replace("/", ""), after))
                folded.append(fold(fold(leaf if tampered is None else tampered, own), rest))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block["doc_id"][-k:], arrow_id), pa.array(inner[0]), pa.array([subroot] * k), pa.array([root] * k), pa.array(proof), pa.array(folded), pa.array([f == root for f in folded])],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    blocks, known = _with_paths(rows, paths, levels, ["doc_id", "tampered"])
    return blocks.mapInArrow(run, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
