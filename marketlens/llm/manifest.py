"""Merkle manifest of a dataset: a tree per source over its rows, and a tree over the sources.

Rows are reduced to leaf hashes where they are read; only ids and hashes are moved from then on.  A range-partitioned
sort and one row of counts per partition and source give each leaf its position in its source.  ``BLOCK`` consecutive
leaves (aligned: a power of ``FAN``) are a block, whatever the size of their source, so a hot source is many blocks.
Executors run DuckDB over whole blocks, some thousand rows of Arrow at a time: per level one query that joins each run
of ``FAN`` nodes by ordered string_agg and hashes the result with sha256.  What a block comes to is a node of the next
round; rounds go on in Spark until every source has one node, and the same rounds over the sources give the root.  On
the way back each round's blocks meet the proof of their own node (the siblings left and right of it, level by level)
and hand it on to their nodes; for the rows themselves the last queries hash the proof and fold it.

Defined results: a null column counts as ``-``, an empty one as ``0:``; null ids come first in their source and draw
like an empty id; equal rows are leaves one behind the other; very long texts are hashed whole; a null source is a
source of its own, before the others; an empty table gives no row; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.llm.common import ascii_lower, discard, residue, stored
from marketlens.llm.warc import placed

#: Children of a node; levels of a block.
FAN, LEVELS = 16, 2
BLOCK = FAN**LEVELS
#: Rows of Arrow, at least, that one set of level queries takes where there are more; whole blocks only.
ROWS = 16384
#: Columns of a leaf, in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
NODE = ["tree", "pos", "size", "hash"]
UP = "tree string, pos bigint, size bigint, hash string"
PATH = f"{UP}, lefts array<string>, rights array<string>, subroot string, root string"
PROVED = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def leaf_hash(columns: list[Column]) -> Column:
    """SHA-256 of the columns, each as its UTF-8 byte count, a colon and its text, or ``-``."""
    shown = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown)), 256)


def leaves(docs: DataFrame, present: Column | None = None) -> DataFrame:
    """(tree, doc_id, hash, present) of each row.  A source is a tree: its name behind a 1, or 0 for the null source, so
    that bytes give the order of sources.  ``present`` is the row's leaf as it is now, by default the same."""
    source, leaf = F.col("`source`"), leaf_hash([F.col(f"`{c}`") for c in FIELDS])
    return docs.select(F.coalesce(F.concat(F.lit("1"), source), F.lit("0")).alias("tree"), F.col("`doc_id`").cast("bigint").alias("doc_id"), leaf.alias("hash"), (leaf if present is None else present).alias("present"))


def tampered() -> Column:
    """The leaf of a row of the table that was tampered with: A-Z lower-cased in texts of one row in five."""
    text = F.when(residue(F.col("`doc_id`"), 5) == 0, ascii_lower(F.col("`text`"))).otherwise(F.col("`text`"))
    return leaf_hash([text if c == "text" else F.col(f"`{c}`") for c in FIELDS])


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place in their tree in the given order, and ``size``, how many rows the tree has."""
    rows = placed(rows, ["tree", *order])
    runs = rows.groupBy("part", "tree").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    # One row per tree and partition of the sort; rows meet theirs by both, so no tree is one key.
    whole = W.partitionBy("tree")
    runs = runs.select("part", "tree", F.min("first").over(whole).alias("first"), F.sum("n").over(whole).alias("size"))
    return rows.join(runs, ["part", "tree"]).withColumn("pos", F.col("place") - F.col("first")).drop("part", "place", "first")


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole blocks, about ``ROWS`` rows each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < ROWS:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        tree, block = rows["tree"], rows["block"]
        new = pc.or_(pc.not_equal(tree[1:], tree[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy()
        if len(ends := new.nonzero()[0]):
            cut = int(ends[-1]) + 1
            yield rows.slice(0, cut)
            held = rows.slice(cut).to_batches()
    if sum(map(len, held)):
        yield pa.Table.from_batches(held)


class Levels:
    """One DuckDB database of a task, with the tables of a block's levels."""

    def __init__(self):
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})

    def load(self, rows: pa.Table) -> None:
        """Tables n0, n1, ... of nodes, and r0, r1, ... of the runs that they make; a tree of one node makes none."""
        self.db.register("given", rows)
        self.db.execute("CREATE OR REPLACE TEMP TABLE n0 AS SELECT tree, block, pos, size, hash FROM given WHERE pos >= 0")
        for k in range(LEVELS):
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE r{k} AS SELECT tree, block, pos // {FAN} pos, any_value(size) size, string_agg(hash, '' ORDER BY pos) hashes FROM n{k} GROUP BY tree, block, pos // {FAN}")
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE n{k + 1} AS SELECT tree, block, pos, (size + {FAN - 1}) // {FAN} size, CASE WHEN size > 1 THEN sha256(hashes) ELSE hashes END hash FROM r{k}")

    def sides(self) -> str:
        """SQL of each node's siblings: l0, r0, l1, r1, ... (null where the tree is one node already)."""
        at = lambda k: f"64 * (given.pos // {FAN**k} % {FAN})"
        cut = [f"CASE WHEN r{k}.size > 1 THEN substr(r{k}.hashes, 1, {at(k)}) END l{k}, CASE WHEN r{k}.size > 1 THEN substr(r{k}.hashes, {at(k)} + 65) END r{k}" for k in range(LEVELS)]
        met = [f"JOIN r{k} ON r{k}.tree = given.tree AND r{k}.pos = given.pos // {FAN ** (k + 1)}" for k in range(LEVELS)]
        return f"SELECT given.*, {', '.join(cut)} FROM given {' '.join(met)} WHERE given.pos >= 0"

    def roots(self) -> pa.Table:
        return self.db.sql(f"SELECT tree, pos, size, hash FROM n{LEVELS}").to_arrow_table()

    def paths(self) -> pa.Table:
        """Each node's siblings in its block, then those of its block's own node."""
        own = lambda s: f"list_filter([{', '.join(f'{s}{k}' for k in range(LEVELS))}], lambda x: x IS NOT NULL)"
        return self.db.sql(
            f"SELECT s.tree, s.pos, s.size, s.hash, list_concat({own('l')}, o.lefts) lefts, list_concat({own('r')}, o.rights) rights, o.subroot, o.root FROM ({self.sides()}) s JOIN (SELECT * FROM given WHERE pos < 0) o USING (tree, block)"
        ).to_arrow_table()

    def proofs(self) -> pa.Table:
        """Each row's proof as one hash, and the root that the proof gives from the row as it is now."""
        deepest = self.db.execute("SELECT coalesce(max(len(lefts)), 0) FROM given WHERE pos < 0").fetchone()[0]
        outer = "array_to_string(list_transform(range(1, len(lefts) + 1), lambda i: lefts[i] || rights[i]), '')"
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE outer_ AS SELECT tree, block, lefts, rights, subroot, root, {outer} sides FROM given WHERE pos < 0")
        inner = " || ".join(f"coalesce(l{k} || r{k}, '')" for k in range(LEVELS))
        rows = f"SELECT s.tree, s.block, s.doc_id, s.hash, sha256({inner} || o.sides) proof, s.present f, {', '.join(f'l{k}, r{k}' for k in range(LEVELS))} FROM ({self.sides()}) s JOIN outer_ o USING (tree, block)"
        for k in range(LEVELS):
            rows = f"SELECT * REPLACE (CASE WHEN l{k} IS NULL THEN f ELSE sha256(l{k} || f || r{k}) END AS f) FROM ({rows})"
        for i in range(1, deepest + 1):
            rows = f"SELECT q{i}.* REPLACE (CASE WHEN len(lefts) < {i} THEN f ELSE sha256(lefts[{i}] || f || rights[{i}]) END AS f) FROM ({rows}) q{i} JOIN outer_ USING (tree, block)"
        return self.db.sql(f"SELECT doc_id, hash leaf, o.subroot, o.root, proof proof_sha256, f folded_root FROM ({rows}) JOIN outer_ o USING (tree, block)").to_arrow_table()


def _by_blocks(rows: DataFrame, result: str, read: str) -> DataFrame:
    """``rows``, dealt by blocks, through the level queries; ``read`` names what is taken from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = None
        for some in whole_blocks(batches):
            levels = levels or Levels()
            levels.load(some)
            yield from getattr(levels, read)().to_batches()

    if "block" not in rows.columns:
        rows = rows.withColumn("block", F.floor(F.col("pos") / BLOCK))
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(run, result)


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """Node tables from ``nodes`` up to the one in which every tree is one node; all but the first are written tables."""
    out = [nodes.select(*NODE)]
    while len(out) == 1 or (out[-1].agg(F.max("size")).first()[0] or 0) > 1:
        out.append(stored(_by_blocks(out[-1], UP, "roots"), "nodes"))
    return out


def _with_outer(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes and, before each block's nodes, a row with the path of the block's own node (in ``above``)."""
    below = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
    head = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "lefts", "rights", "subroot", "root")
    return below.unionByName(head, allowMissingColumns=True)


def descend(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """Paths of the nodes of the lowest of ``tables``, from the paths of the nodes above the highest."""
    for nodes in reversed(tables):
        above = stored(_by_blocks(_with_outer(nodes, above), PATH, "paths"), "paths")
    return above


def manifest(docs: DataFrame, present: Column | None = None) -> DataFrame:
    """A row per row of ``docs``: its leaf, its source's subroot, the root, its proof's hash, the root that the proof gives
    from the leaf ``present`` (by default its own), and whether that is the root."""
    rows = stored(positions(leaves(docs, present), ["doc_id", "hash"]), "leaves")
    trees = rounds(rows)
    names = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    sources = stored(positions(names, ["name"]), "sources")
    forest = rounds(sources)
    none = F.array().cast("array<string>")
    top = forest[-1].select("tree", "pos", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    met = descend(forest[:-1], top).join(sources.select("pos", "name"), "pos")
    above = met.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "lefts", "rights", F.col("hash").alias("subroot"), "root")
    proved = _by_blocks(_with_outer(rows, descend(trees[1:-1], above)), PROVED, "proofs")
    discard(*trees[2:-1], *forest[1:-1])
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))
