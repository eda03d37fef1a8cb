"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of fixed size. The distinct blocks are sorted by hash
and text, and named by integers that increase along that order. Adjacent names
of a document are paired, the distinct pairs are sorted and named in the same
way, and so on until each document has one name; ``(levels, name)`` is equal for
two documents if and only if their blocks are.

Only the naming of level 0 moves text: distinct blocks, combined before the
shuffle. Documents find the name of a block by its 64-bit hash; hashes that
several different blocks share are found by counting and joined by the block
itself, so that no two texts ever get one identity. All other joins move
integers between tables in the shared folder, and adaptive execution splits
their hot keys (a block or pair that a third of all documents hold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free_names, plain, stored

BLOCK_CHARS = 4096
_NONE = -(2**63)


def normalised(text: Column) -> Column:
    """The text without the characters ``[\\x20\\x09-\\x0D]``."""
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def _sorted_names(distinct: DataFrame, keys: list[str], sign: int = 1) -> DataFrame:
    """Name each distinct key: names increase (with sign -1, decrease below zero) along the order of all keys, which are dealt out by ranges."""
    place = F.monotonically_increasing_id()
    return distinct.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys, (place if sign > 0 else -1 - place).alias("name"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, hash_mod: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns ``(rows, identity)``.

    rows: doc_id, sha (SHA-256 of the normalised text), n_chars and copies, one row per different
    (doc_id, normalised text, length); copies counts the input rows that it stands for.
    identity: doc_id, sha, level, name. ``hash_mod`` narrows the block hash, for tests of its collisions.
    """
    src = plain(docs, id_col, text_col).toDF("doc_id", "text")
    norm = src.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), normalised(F.col("text")).alias("norm")
    )

    def hashed(block: Column) -> Column:
        return F.xxhash64(block) if hash_mod is None else F.pmod(F.xxhash64(block), F.lit(hash_mod))

    cut = norm.select(
        "doc_id", "n_chars", F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))).alias("blocks"),
    )
    rows = stored(cut.select("doc_id", "sha", "n_chars", F.transform("blocks", hashed).alias("hashes")))
    blocks = cut.select(F.explode("blocks").alias("block")).select(hashed(F.col("block")).alias("hb"), "block")
    parts = rows.select("doc_id", "sha", F.size("hashes").cast("long").alias("n"), F.posexplode("hashes").alias("pos", "hb"))
    by_hash = stored(blocks.distinct().groupBy("hb").agg(F.count("*").alias("same")))
    clash = by_hash.where("same > 1").select("hb")
    # Of blocks whose hash no other block has, the hash alone gives the place.
    named = parts.join(stored(_sorted_names(by_hash.where("same = 1").select("hb"), ["hb"])), "hb").select("doc_id", "sha", "n", "pos", "name")
    if not clash.isEmpty():
        exact = stored(_sorted_names(blocks.join(clash, "hb", "left_semi").distinct(), ["hb", "block"], -1))
        again = cut.select("doc_id", "sha", F.size("blocks").cast("long").alias("n"), F.posexplode("blocks").alias("pos", "block")).withColumn("hb", hashed(F.col("block")))
        named = named.unionByName(again.join(clash, "hb", "left_semi").join(exact, ["hb", "block"]).select("doc_id", "sha", "n", "pos", "name"))
    named = stored(named)
    level, done = 0, []
    while True:
        done.append(named.where("n = 1").select("doc_id", "sha", F.lit(level).alias("level"), "name"))
        rest = named.where("n > 1")
        if rest.isEmpty():
            break
        level += 1
        half = F.col("pos") % 2
        pairs = stored(
            rest.groupBy("doc_id", "sha", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
                F.min(F.when(half == 0, F.col("name"))).alias("a"), F.coalesce(F.min(F.when(half == 1, F.col("name"))), F.lit(_NONE)).alias("b")
            )
        )
        names = stored(_sorted_names(pairs.select("a", "b").distinct(), ["a", "b"]))
        named = stored(pairs.join(names, ["a", "b"]).select("doc_id", "sha", F.ceil(F.col("n") / 2).cast("long").alias("n"), "pos", "name"))
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    return rows.groupBy("doc_id", "sha", "n_chars").agg(F.count("*").alias("copies")), identity.distinct()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, hash_mod: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when equal without ``[\\x20\\x09-\\x0D]``; null counts as empty. The row with the most
    code points in the original text, then the smallest doc_id (null last), stays. Of rows that repeat in
    doc_id, text and length exactly one stays. An empty table gives no rows; other columns are ignored.
    """
    rows, identity = identities(docs, id_col, text_col, block_chars, hash_mod)
    same = (F.col("r.doc_id").eqNullSafe(F.col("i.doc_id"))) & (F.col("r.sha") == F.col("i.sha"))
    full = stored(rows.alias("r").join(identity.alias("i"), same).select("r.doc_id", "r.sha", "r.n_chars", "r.copies", "level", "name"))
    order = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    best = stored(full.groupBy("level", "name").agg(F.min(order).alias("best"), F.sum("copies").alias("group_size")))
    first = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_chars") == -F.col("best.shorter"))
    return full.join(best, ["level", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", "n_chars", F.lower(F.hex("sha")).alias("text_sha256"), first.alias("first"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")
    ).select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("copy") == 1)).alias("kept"), "text_sha256", "n_chars")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with all their columns. Rows equal in doc_id, normalised text and length count as one row, of which any one stays."""
    theirs, sha, n, own_sha, own_n = free_names(docs, "id", "sha", "n", "own_sha", "own_n")
    found = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(theirs), F.unhex("text_sha256").alias(sha), F.col("n_chars").alias(n))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = docs.withColumns({own_sha: F.unhex(F.sha2(normalised(text), 256)), own_n: F.length(text).cast("long")})
    kept = keyed.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col(theirs)) & (F.col(own_sha) == F.col(sha)) & (F.col(own_n) == F.col(n)), "left_semi")
    return kept.dropDuplicates([id_col, own_sha, own_n]).select(*[F.col(f"`{c}`") for c in docs.columns])
