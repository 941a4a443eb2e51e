"""Near copies of documents: pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A text's node is the hash of its words (equal words, equal node).  Nodes of different texts are brought together twice:

* by SimHash, as in :mod:`simhash`: band keys of the fingerprints, pivot distance tables that discard, bits that
  verify, which loses no two fingerprints within 4 bits;
* by MinHash bands, as most pairs at 0.8 differ in more bits: ``BANDS`` keys of ``ROWS`` minima each.  A pair at
  similarity s shares no key with probability (1 - s ** ROWS) ** BANDS, 1.3e-7 at 0.8, the same for every size of the
  table.  Sizes and fingerprints discard pairs.

The shingles of both texts decide about every pair of either kind, so no link is a guess.

A MinHash key's nodes are paired first with the next ``NEXT`` of the key and with its ``HUBS`` middle nodes: those whose
fingerprints are nearest to the bits that most of the key's have.  Copies that were changed in different places are
further from each other than from what they were made of, so the middle connects them.  What these pairs connect
needs no further comparison; afterwards all pairs of a key that are not yet connected are compared, which for large
groups that share a key without a link is the product of their sizes.

Defined results: texts without words are copies of each other; a text of fewer than five words is one shingle; a
component is every text reached over links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from marketlens.llm import simhash
from marketlens.llm.common import ASCII_LOWER, byte_values, slices, stored
from marketlens.llm.components import components

SHINGLE, SEED = 5, 42
ROWS, BANDS = 5, 40
#: Fingerprints of a pair at 0.8 differ in about 10 bits (12 for the shortest texts), of unrelated ones in 32.
RADIUS = 28
NEXT, HUBS = 1, 2

_random = np.random.default_rng(17)
_flip = _random.integers(0, 2**64, (ROWS * BANDS, 1), dtype=np.uint64)
_times = _random.integers(0, 2**64, (ROWS * BANDS, 1), dtype=np.uint64) | np.uint64(1)
_fold = _random.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_band = _random.integers(0, 2**64, BANDS, dtype=np.uint64)


def shingles(line: bytes) -> np.ndarray:
    """Distinct hashes of the shingles of words joined by single blanks, sorted."""
    if not line:
        return np.empty(0, np.uint64)
    ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line))
    digest = xxhash.xxh64_intdigest
    starts = [0, *(ends[: max(0, len(ends) - SHINGLE)] + 1).tolist()]
    stops = ends[min(SHINGLE, len(ends)) - 1 :].tolist()
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], np.uint64))


def band_keys(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return np.empty(0, np.int64)
    low = np.full(ROWS * BANDS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 512):
        low = np.minimum(low, ((h[None, at : at + 512] ^ _flip) * _times).min(axis=1))
    return ((low.reshape(BANDS, ROWS) * _fold).sum(axis=1, dtype=np.uint64) + _band).view(np.int64)


def fingerprint(h: np.ndarray) -> int:
    if not len(h):
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h)).view(np.int64)[0])


def _line(text: bytes) -> bytes:
    return b" ".join(text.translate(ASCII_LOWER).split())


@F.arrow_udf(LongType())
def _node(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(_line(t), SEED) for t in byte_values(texts)], np.uint64).view(np.int64))


@F.arrow_udf(ArrayType(LongType()))
def _set(texts: pa.Array) -> pa.Array:
    return pa.array([shingles(_line(t)).view(np.int64) for t in byte_values(texts)], pa.list_(pa.int64()))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys, number of shingles and fingerprint of each text (node, t)."""
    for batch in slices(batches, "t"):
        keys, sizes, fps = [], [], []
        for text in byte_values(batch["t"]):
            h = shingles(_line(text))
            keys.append(band_keys(h))
            sizes.append(len(h))
            fps.append(fingerprint(h))
        offsets = np.cumsum([0] + [len(k) for k in keys])
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), lists], names=["node", "n", "fp", "keys"])



def _possible(n: np.ndarray, fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of places sizes and fingerprints allow (the smaller set has 0.8 of the larger at least)."""
    na, nb = n[a].astype(np.int64), n[b].astype(np.int64)
    return (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)) & (np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= RADIUS)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut between keys (the first column)."""
    have = None
    for batch in batches:
        new = [batch[x].to_numpy() for x in names]
        have = new if have is None else [np.concatenate([x, y]) for x, y in zip(have, new)]
        cut = int(np.searchsorted(have[0], have[0][-1])) if len(have[0]) else 0
        if cut:
            yield [x[:cut] for x in have]
            have = [x[cut:] for x in have]
    if have is not None and len(have[0]):
        yield have


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.empty((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


def _middle(fp: np.ndarray) -> np.ndarray:
    """Places of the ``HUBS`` fingerprints nearest to the majority of each bit."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1)
    most = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(fp)).view(np.uint64)[0]
    return np.argsort(np.bitwise_count(fp.view(np.uint64) ^ most), kind="stable")[:HUBS]


def _first_pairs(following: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, n, fp in _runs(batches, ["key", "node", "n", "fp"]):
            found = [np.empty((2, 0), np.int64)]
            for d in range(1, following + 1):
                at = np.flatnonzero(key[d:] == key[:-d])
                if not len(at):
                    break
                found.append(np.stack([at, at + d])[:, _possible(n, fp, at, at + d)])
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            for begin, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                if end - begin > following + 1:
                    hubs = begin + _middle(fp[begin:end])
                    a, b = np.repeat(hubs, end - begin), np.tile(np.arange(begin, end), len(hubs))
                    a, b = a[a != b], b[a != b]
                    found.append(np.stack([a, b])[:, _possible(n, fp, a, b)])
            at = np.concatenate(found, axis=1)
            yield _pairs(node[at[0]], node[at[1]])

    return run


def _other_pairs(following: int):
    """Pairs of a key that are not connected yet (by component) and were not among the next ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, n, fp, part in _runs(batches, ["key", "node", "n", "fp", "part"]):
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            for begin, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                if (part[begin:end] == part[begin]).all():
                    continue
                for i in range(begin, end - following - 1):
                    at = np.arange(i + following + 1, end)
                    at = at[part[at] != part[i]]
                    at = at[_possible(n, fp, np.full(len(at), i), at)]
                    if len(at):
                        yield _pairs(np.full(len(at), node[i]), node[at])

    return run


def simhash_pairs(fps: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes (node, fp) that connect all whose fingerprints are equal or linked within the radius.

    A fingerprint's nodes are paired with its least one, and linked fingerprints by their least ones.
    """
    least = stored(fps.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    end = lambda c: least.select(F.col("fp").alias(f"{c}_"), F.col("node").alias(c))
    near = simhash.near_links(least.select("fp")).select(F.col("a").alias("a_"), F.col("b").alias("b_")).join(end("a"), "a_").join(end("b"), "b_")
    equal = fps.join(least.select("fp", F.col("node").alias("least")), "fp").where(F.col("node") != F.col("least")).select(F.col("least").alias("a"), F.col("node").alias("b"))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionAll(equal)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (node, t) have a similarity of 0.8 or more (shared shingles to all: 9 s >= 4 (a + b))."""
    pairs = stored(pairs.distinct(), "pairs")
    met = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stored(texts.join(met, "node", "left_semi").select("node", _set("t").alias("s")), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(9 * shared >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")


def near_copies(docs: DataFrame, text: str, key: str, following: int = NEXT) -> DataFrame:
    """(key, component_id): for every row of ``docs`` the smallest key of its group of near copies.  Keys are unique."""
    rows = stored(docs.select(F.col(f"`{key}`").alias("k"), _node(F.col(f"`{text}`")).alias("node")), "nodes")
    least = stored(rows.groupBy("node").agg(F.min("k").alias("first")), "distinct")
    # One text of each node: that of its smallest key.
    own = docs.select(F.col(f"`{key}`").alias("first"), F.col(f"`{text}`").alias("t"))
    texts = own.join(least, "first").select("node", "t")
    marked = stored(texts.mapInArrow(_keyed, "node bigint, n int, fp bigint, keys array<bigint>"), "keys")
    keyed = marked.select(F.explode("keys").alias("key"), "node", "n", "fp")
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > 1), "shared")
    ordered = lambda x: x.repartition("key").sortWithinPartitions("key", "node")
    by_bands = ordered(keyed.join(shared, "key", "left_semi")).mapInArrow(_first_pairs(following), "a bigint, b bigint")
    links = stored(verified(simhash_pairs(marked.select("node", "fp")).unionAll(by_bands), texts), "links")
    parts = stored(components(links), "parts")
    # Next ones and two middle nodes are all pairs of a key of three.
    large = shared.where(F.col("rows") > max(following, HUBS) + 1)
    if large.head(1):
        rest = keyed.join(large, "key", "left_semi").join(parts, "node", "left").select("key", "node", "n", "fp", F.coalesce("component", "node").alias("part"))
        more = verified(ordered(rest).mapInArrow(_other_pairs(following), "a bigint, b bigint"), texts)
        parts = stored(components(links.unionAll(more)), "parts")
    joined = least.join(parts, "node", "left").withColumn("root", F.coalesce("component", "node"))
    component = stored(joined.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    return rows.join(joined.join(component, "root").select("node", "component_id"), "node").select(F.col("k").alias(key), "component_id")
