"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates.

Features are hashed word unigrams and bigrams, and hashed n-grams of word shapes (case, digits, the marks
themselves, "same as the word before"), as square-rooted counts scaled to unit length.  A score is the
sigmoid of one sparse dot product.  Labels, language, source and id are never features.

Training reads at most ``MAX_ROWS`` labelled documents (a documented bound of the fit; a hash of the id picks
them).  They are dealt by hash to ``SHARDS`` tasks; each runs per-coordinate updates over its rows in hash
order for ``EPOCHS`` passes, and the weights are averaged, so the driver holds a few arrays of fixed size.
Scoring covers every row in one pass without a shuffle.

Defined results: null and empty texts get the sigmoid of the bias; without any usable label all scores are
0.5; several labels of one id count as their mean (1 from one half); labels without a document are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import residue, slices

BITS = 18
MASK = (1 << BITS) - 1
#: Labelled rows that a fit reads at most, rows of a shard, passes over them.
MAX_ROWS, SHARD_ROWS, EPOCHS = 8192, 1024, 10
ALPHA, BETA, L1, L2 = 4.0, 1.0, 0.001, 0.0
THRESHOLD = 0.3

_tokens = re.compile(r"\w+|[^\w\s]+").findall
_MEMO = 100_000


class Hasher:
    """Turns texts into sparse unit vectors; remembers the hash and shape of words it has met."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def _code(self, word: str) -> int:
        if len(self.memo) > _MEMO:
            self.memo.clear()
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if not (word[0].isalnum() or word[0] == "_"):
            shape = 16 + h % 200
        elif word.isdigit():
            shape = 4
        elif any(c.isdigit() for c in word):
            shape = 5
        elif len(word) > 1 and word.isupper():
            shape = 3
        elif word[0].isupper():
            shape = 2
        else:
            shape = 1
        self.memo[word] = out = h << 8 | shape
        return out

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = _tokens(text)
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.float32)
        memo, code = self.memo, self._code
        codes = np.array([memo.get(w) or code(w) for w in words], np.uint64)
        h, s = codes >> np.uint64(8), codes & np.uint64(255)
        s[1:] |= (h[1:] == h[:-1]).astype(np.uint64) << np.uint64(8)
        k = np.uint64(0x9E3779B97F4A7C15)
        grams = [h, h[:-1] * np.uint64(31) + h[1:] + np.uint64(1 << 40), s + np.uint64(2 << 40), (s[:-1] << np.uint64(9) | s[1:]) + np.uint64(3 << 40), (s[:-2] << np.uint64(18) | s[1:-1] << np.uint64(9) | s[2:]) + np.uint64(4 << 40)]
        index, count = np.unique((np.concatenate(grams) * k) >> np.uint64(64 - BITS), return_counts=True)
        value = np.sqrt(count.astype(np.float32))
        return index.astype(np.int32), value / np.float32(np.sqrt(count.sum()))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one is the bias) after per-coordinate follow-the-regularised-leader updates."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = np.array([1 << BITS])
    for _ in range(epochs):
        for index, value, label in rows:
            i, x = np.concatenate([index, bias]), np.concatenate([value, [1.0]])
            w = np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)


def _vector_udf():
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = Hasher()
        for batch in slices(batches):
            rows = [hasher.vector(t.as_py() or "") for t in batch]
            yield pa.StructArray.from_arrays([pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary())], names=["i", "x"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<i:binary,x:binary>")


def _fit_shard(shard: pa.Table) -> pa.Table:
    rows = sorted(zip(shard["order"].to_pylist(), shard["i"].to_pylist(), shard["x"].to_pylist(), shard["label"].to_pylist()))
    w = ftrl([(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32), y) for _, i, x, y in rows])
    return pa.table({"w": pa.array([w.tobytes()], pa.binary()), "n": pa.array([len(rows)], pa.int64())})


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", folds: int = 5, max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights from the labelled documents outside the held-out fold (crc32 of the id modulo ``folds`` is 0)."""
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("double").alias("y")).dropna().where(residue(F.col("k"), folds) != 0)
    known = known.groupBy("k").agg((F.avg("y") >= 0.5).cast("double").alias("label"))
    n = known.count()
    shards = max(1, min(n, max_rows) // SHARD_ROWS)
    # The ids of smallest hash, max_rows at most and a few bytes each: small enough to broadcast at any corpus size.
    some = F.broadcast(known.orderBy(F.xxhash64("k"), "k").limit(max_rows))
    vectors = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(some, "k").select("k", "label", _vector_udf()("t").alias("v"))
    each = vectors.groupBy("k").agg(F.min(F.struct("label", "v")).alias("r"))
    dealt = each.select(F.pmod(F.xxhash64("k"), F.lit(shards)).alias("shard"), F.xxhash64(F.col("k"), F.lit(1)).alias("order"), "r.label", "r.v.i", "r.v.x")
    parts = dealt.groupBy("shard").applyInArrow(_fit_shard, "w binary, n bigint").collect()
    total = sum(s.n for s in parts)
    if not total:
        return np.zeros((1 << BITS) + 1, np.float32)
    return (sum(np.frombuffer(s.w, np.float32).astype(np.float64) * s.n for s in sorted(parts, key=lambda s: s.w)) / total).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a double column ``out``: the probability of label 1 of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, hasher = shared.value, Hasher()
        for batch in slices(batches):
            dots = np.array([w[i] @ x for i, x in (hasher.vector(t.as_py() or "") for t in batch)], np.float64)
            yield pa.array(1 / (1 + np.exp(-(dots + float(w[-1])))), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(out, F.arrow_udf(run, "double")(F.col(f"`{text}`")))
