"""SimHash near-duplicates, with pivot distance tables for the Hamming search.

A text's fingerprint takes one bit per column of its shingles' 64-bit hashes: set if set in over half of them.
Distinct fingerprints are brought together by bands: the 64 bits are cut in ``m`` blocks, two fingerprints
within ``RADIUS`` bits agree in at least ``m - RADIUS`` of them, so each combination of that many blocks is a
key and no pair is lost.  ``m`` follows the number of fingerprints, which keeps the expected bucket small at
every size.  Within a bucket each fingerprint has a row of a pivot table: its distances to ``PIVOTS`` reference
fingerprints.  By the triangle inequality a pair whose rows differ by more than the radius in any coordinate is
discarded; only the survivors are verified on the bits.  A bucket gives a spanning forest of its links, never
all pairs.  Buckets of more than ``BUCKET`` fingerprints are cut in blocks, and every pair of blocks becomes a
bucket of its own.

Defined results: null and empty texts have fingerprint 0 and link like any other; equal rows share a
fingerprint; the component is the smallest id reached (null ids are never the smallest; null if a component
has no other); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import ASCII_LOWER, byte_values, slices, stored
from marketlens.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
PIVOTS = 16
BUCKET = 16384
#: Fingerprints that a bucket may hold on average before the next number of blocks is taken.
MEAN_BUCKET = 64
#: Groups up to this size are compared by shifting the sorted rows, larger ones by covering.
SMALL = 128

_reference = np.random.default_rng(7).integers(0, 2**64, PIVOTS, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with a bigint column ``out``: the fingerprint's 64 bits as a signed integer."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            yield pa.array(np.array([fingerprint(t, shingle) for t in byte_values(batch)], np.uint64).view(np.int64), pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(out, F.arrow_udf(run, "bigint")(F.col(f"`{text}`")))


def _near(a: np.ndarray, ta: np.ndarray, b: np.ndarray, tb: np.ndarray, radius: int) -> np.ndarray:
    """Indices at which a and b (or the single value b) are within the radius: pivot rows first, then the bits."""
    at = np.arange(len(a))
    one = len(b) == 1
    for k in range(0, PIVOTS, 4):
        x, y = ta[at, k : k + 4].astype(np.int16), tb[:, k : k + 4] if one else tb[at, k : k + 4]
        at = at[(np.abs(x - y.astype(np.int16)) <= radius).all(axis=1)]
        if not len(at):
            return at
    return at[np.bitwise_count(a[at] ^ (b if one else b[at])) <= radius]


def _settled(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index linked to each of n indices by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        m = np.minimum(label[a], label[b])
        if (m == label[a]).all() and (m == label[b]).all():
            break
        np.minimum.at(label, label[a], m)
        np.minimum.at(label, label[b], m)
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        while (nxt := label[label]).tobytes() != label.tobytes():
            label = nxt
    return label


def links(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each run of equal keys (rows sorted by key)."""
    n = len(fps)
    if n < 2:
        return fps[:0], fps[:0]
    pivots = np.bitwise_count(fps[:, None] ^ _reference[None, :])
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(begin, n))
    sources, targets = [], []
    small = np.flatnonzero(np.repeat(size <= SMALL, size))
    k, f, t = keys[small], fps[small], pivots[small]
    for d in range(1, min(SMALL, int(size[size <= SMALL].max(initial=1)))):
        same = np.flatnonzero(k[d:] == k[:-d])
        if not len(same):
            break
        at = same[_near(f[same], t[same], f[same + d], t[same + d], radius)]
        sources.append(small[at])
        targets.append(small[at + d])
    for s, c in zip(begin[size > SMALL], size[size > SMALL]):
        rest = np.arange(s, s + c)
        while len(rest):
            root, rest = rest[0], rest[1:]
            front = [root]
            while front and len(rest):
                x = front.pop()
                hit = _near(fps[rest], pivots[rest], fps[x : x + 1], pivots[x : x + 1], radius)
                front += rest[hit].tolist()
                sources.append(rest[hit])
                targets.append(np.full(len(hit), x))
                rest = np.delete(rest, hit)
    if not sources:
        return fps[:0], fps[:0]
    label = _settled(n, np.concatenate(sources), np.concatenate(targets))
    at = np.flatnonzero(label != np.arange(n))
    return fps[at], fps[label[at]]


def _link_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(k, f):
            a, b = links(k, f.view(np.uint64), radius)
            pairs = np.unique(np.stack([a.view(np.int64), b.view(np.int64)]), axis=1) if len(a) else np.empty((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch["key"].to_numpy()])
            fps = np.concatenate([fps, batch["fp"].to_numpy()])
            # The last key may go on in the next batch (a bucket is bounded by BUCKET rows).
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield out(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield out(keys, fps)

    return run


def bands(fps: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """(key, fp): a row for each combination of blocks in which two near fingerprints must agree."""
    m = radius + 1
    while m < 16 and count > MEAN_BUCKET << (64 * (m - radius) // m):
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    masks = []
    for some in combinations(range(m), m - radius):
        bits = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in some)
        masks.append(bits - (1 << 64) if bits >> 63 else bits)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(x).cast("long"))) for i, x in enumerate(masks)])
    return fps.select("fp", F.explode(keys).alias("key"))


def split_large(rows: DataFrame, most: int = BUCKET) -> DataFrame:
    """Buckets of more than ``most`` fingerprints as buckets of pairs of blocks."""
    large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most)
    if not large.head(1):
        return rows
    large = stored(large, "large")
    parts = F.ceil(F.col("n") / F.lit(most // 2)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts)
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    cut = rows.join(large, "key").withColumn("i", own).withColumn("j", other)
    cut = cut.select("fp", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"))
    return rows.join(large, "key", "left_anti").select("fp", "key").unionAll(cut)


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough to connect all that are within the radius."""
    rows = split_large(bands(fps, fps.count(), radius))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_link_batches(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``."""
    rows = stored(fingerprints(docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")), "t", "fp", shingle).select("k", "fp"), "fingerprints")
    least = stored(rows.groupBy("fp").agg(F.min("k").alias("first")), "distinct")
    parts = stored(components(near_links(least.select("fp"), radius)), "parts")
    joined = least.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    # A third of all fingerprints may be one component: the minimum is taken before the rows meet.
    # Written first, so that a component's rows can be split among tasks where they meet it.
    component = stored(joined.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    known = joined.join(component, "root").select("fp", "component_id")
    return rows.join(known, "fp").select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
