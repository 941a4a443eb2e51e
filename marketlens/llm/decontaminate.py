"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Normal form: A-Z lower-cased, every ASCII character that is neither letter nor digit a separator, words
joined by one blank.  A benchmark item gives its windows of ``width`` consecutive words (an item of fewer
words, but not none, is one window).  Each window enters the automaton once, framed by blanks, with the
items that hold it.  Every document is normalised and scanned once; match ends are turned into word
numbers, and word numbers into offsets in the original text where a caller asks for spans.

The automaton holds the benchmark, not the corpus.  Windows are built by Spark tasks, one row for each different
one.  Their size is measured: beyond ``block_bytes`` they are dealt to several automata of that size, each broadcast,
used for one scan of the documents, and dropped before the next; a document's hits of all blocks meet again in one
aggregation.

Defined results: null and empty texts have no words and are never contaminated; items without words or
with a null text match nothing; an item of null id hits words but is not among the items found; repeated rows get equal values; an item that is there several times
counts once; other columns stay as they are, and an input column of the result's name is replaced; a very long text is
scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from marketlens.llm.common import byte_values, discard, slices, stored

#: Words of a window.
WIDTH = 13
#: Bytes of framed patterns and of their items' ids that one automaton may hold (it is broadcast to every worker).
BLOCK_BYTES = 8 << 20
#: A-Z to a-z, ASCII letters and digits and all bytes of non-ASCII characters kept, the rest blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_words = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+").finditer

HITS = "struct<n_words:bigint,hit_words:array<int>,items:array<string>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(pattern, items) of (i, t): each different framed window, with the ids of the items that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            found = {}
            for item, text in zip(batch["i"].to_pylist(), byte_values(batch["t"])):
                words = words_of(text)
                for k in range(max(1, len(words) - width + 1) if words else 0):
                    found[b" " + b" ".join(words[k : k + width]) + b" ", item] = None
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.binary()), pa.array([i for _, i in found], pa.string())], names=["pattern", "item"])

    return benchmark.mapInArrow(run, "pattern binary, item string").groupBy("pattern").agg(F.array_sort(F.collect_set("item")).alias("items"))


class Scanner:
    """The automaton of one block."""

    def __init__(self, patterns: dict[str, list[str]]):
        self.machine = ahocorasick.Automaton()
        for key, items in patterns.items():
            self.machine.add_word(key, (len(key), key.count(" ") - 1, items))
        if patterns:
            self.machine.make_automaton()

    def scan(self, text: bytes) -> tuple[int, np.ndarray, list[str]]:
        """Number of words, the numbers of the words inside a match (ascending) and the ids of the items found."""
        words = words_of(text)
        if not words or not len(self.machine):
            return len(words), np.empty(0, np.int32), []
        line = b" " + b" ".join(words) + b" "
        found = list(self.machine.iter(line.decode("latin-1")))
        if not found:
            return len(words), np.empty(0, np.int32), []
        # Word number at an offset: blanks up to there.
        starts = np.array([end - size + 1 for end, (size, _, _) in found])
        first = np.searchsorted(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), starts)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + np.array([n for _, (_, n, _) in found]), -1)
        return len(words), np.flatnonzero(np.cumsum(edge[:-1])).astype(np.int32), sorted({i for _, (_, _, items) in found for i in items})


def _scan_udf(patterns):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(patterns.value)
        for batch in slices(batches):
            rows = [scanner.scan(t) for t in byte_values(batch)]
            yield pa.StructArray.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.string()))],
                names=["n_words", "hit_words", "items"],
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "hits", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, hit_words (word numbers from 0) and items (ids found)."""
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).dropna(subset=["t"])
    patterns = stored(windows(items, width), "windows")
    ids = F.aggregate("items", F.lit(0).cast("long"), lambda n, i: n + F.octet_length(i))
    size = patterns.agg(F.coalesce(F.sum(F.octet_length("pattern") + ids), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // block_bytes))

    def block(b: int):
        """The patterns of a block, about ``block_bytes`` of them, for every worker."""
        rows = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b).collect()
        return sc.broadcast({bytes(r.pattern).decode("latin-1"): r["items"] for r in rows})

    if blocks == 1:
        return docs.withColumn(out, _scan_udf(block(0))(F.col(f"`{text}`")))
    names = [c for c in docs.columns if c != out]
    rows = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("t"), F.monotonically_increasing_id().alias("uid")), "documents")
    found = []
    for b in range(blocks):
        shared = block(b)
        scanned = rows.select("uid", _scan_udf(shared)("t").alias("h")).select("uid", "h.*")
        found.append(stored(scanned if b == 0 else scanned.where(F.size("hit_words") > 0), "hits"))
        shared.destroy()
    discard(patterns)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # A row per block at most for each document.
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    met = every.groupBy("uid").agg(F.max("n_words").alias("n_words"), union("hit_words"), union("items"))
    return rows.join(met, "uid").select("row.*", F.struct("n_words", "hit_words", "items").alias(out))


def contaminated(hits: str = "hits"):
    """The contract's rule: at least one hit word, and hit words at least a twentieth of all words."""
    n = F.size(F.col(hits)["hit_words"])
    return (n > 0) & (F.lit(20) * n >= F.col(hits)["n_words"])


def spans_in_text(text: str, hit_words: list[int]) -> list[tuple[int, int]]:
    """Runs of hit words as character ranges of the original text."""
    at = [m.span() for m in _words(text)] if len(hit_words) else []
    out: list[tuple[int, int]] = []
    last = -2
    for w in hit_words:
        if w == last + 1:
            out[-1] = (out[-1][0], at[w][1])
        else:
            out.append(at[w])
        last = w
    return out


@F.arrow_udf(ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType())))
def spans(texts: pa.Array, hit_words: pa.Array) -> pa.Array:
    """Runs of hit words as character ranges of the original texts."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([[{"start": a, "end": b} for a, b in spans_in_text(t or "", h or [])] for t, h in zip(texts.to_pylist(), hit_words.to_pylist())], kind)
