"""Suffix dedup: a logarithmic family of sampled suffix arrays, and removal of long repeats.

A byte goes if a ``length``-byte string that covers it also starts anywhere else, in the same text or another.

Sorting every suffix of a corpus costs more than the corpus is worth here (the README has figures), so the
arrays hold the suffixes that :mod:`segments` picks: any repeat of ``length`` bytes meets at one of them.  Equal texts
are indexed once; a text that is there twice goes whole.  A batch of texts gives an array of (key, segment hash, places)
rows: the places that a segment has in the texts that a task turns over at once are one row, so what stands in very
many texts is counted, joined and shuffled as a few rows.  What a slice loses comes together again by slice, and each text
gets its ranges merged in one row, not a row for every place.  :class:`LevelFamily` keeps the keys of earlier batches, with their counts, as levels of geometrically growing
size: a new batch is matched against every level for keys met before, and two levels of equal rank merge into one of
the next rank.  The number of batches follows the size of the texts.

Keys met twice lead to marks: a segment whose bytes occur twice (by a 64-bit hash under a 64-bit key) is removed whole;
segments that share a key but not all bytes are compared window by window, by groups of a key, and for keys with more
than ``HOT`` different segments by counting window hashes across tasks, so that no group is gathered anywhere.  Windows
are compared by 64-bit hashes under their key: with n windows of a key, two different ones agree by chance about once
in 2^65 / n^2.

Texts are identified by 96 bits of hash.
Defined results: null and empty texts have no bytes and lose none; texts shorter than ``length`` lose none;
repeated rows are copies of each other and lose every byte (from ``length`` bytes on); a very long text is cut in runs
of 262144 windows, whose segments are shorter at the cuts and compared window by window there; other columns stay as
they are, and an input column of the result's name is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import byte_values, discard, slices, stored
from marketlens.llm.segments import LENGTH, segments

#: Bytes of texts in a batch, and batches at least and at most.
BATCH_SIZE, LEAST_BATCHES, MOST_BATCHES = 256 << 20, 2, 64
#: Different segments of a key up to which one task compares them (some MB of text, as segments are short).
HOT = 16384
#: Rows that a task works on at a time.
PIECE = 1024
TEXT = ["t1", "t2"]
PLACE = [*TEXT, "lo", "hi"]


def _named(docs: DataFrame, text: str) -> DataFrame:
    """The texts with the two hashes that name them."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumn("t", t).withColumn("t1", F.xxhash64("t")).withColumn("t2", F.hash("t"))


def suffix_arrays(texts: DataFrame, length: int, batches: int) -> DataFrame:
    """(batch, slice, key, seg, n, t1, t2, lo, hi, more) rows, each slice of a task's texts sorted by key.

    A row is all ``n`` places of a segment in the slice: the first one in columns, the others in ``more`` (null if none).
    A slice is named by its first text.
    """
    names = ["batch", "slice", "key", "seg", "n", *PLACE, "more"]

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(arrow, "t"):
            if not part.num_rows:
                continue
            found = [segments(t, length) for t in byte_values(part["t"])]
            n = np.array([len(f[0]) for f in found], np.int64)
            key, seg, lo, hi = (np.concatenate([f[i] for f in found]) for i in range(4))
            t1, t2 = (np.repeat(part[c].to_numpy(), n) for c in TEXT)
            own = (t1 % batches).astype(np.int32)
            order = np.lexsort((seg, key, own))
            own, key, seg, *place = (c[order] for c in (own, key, seg, t1, t2, lo.astype(np.int32), hi.astype(np.int32)))
            new = np.append(True, (own[1:] != own[:-1]) | (key[1:] != key[:-1]) | (seg[1:] != seg[:-1]))[: len(own)]
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(own))).astype(np.int32)
            others = pa.StructArray.from_arrays([pa.array(c[~new]) for c in place], names=PLACE)
            more = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n - 1)), pa.int32()), others, mask=pa.array(n == 1))
            name = np.full(len(first), part["t1"][0].as_py(), np.int64)
            columns = [own[first], name, key[first], seg[first], n, *(c[first] for c in place)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), more], names=names)

    place = "t1:bigint, t2:int, lo:int, hi:int"
    return texts.select("t", *TEXT).mapInArrow(run, f"batch int, slice bigint, key bigint, seg bigint, n int, {place.replace(':', ' ')}, more array<struct<{place}>>")


class LevelFamily:
    """Levels of keys with their counts; the rank of a level grows by one when two of a rank merge."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Keys of ``batch`` that occur twice in it or in any level; ``batch`` becomes a level of rank 0.

        A batch is reduced to a row per key before it is dealt out, so a key that is everywhere is one row too.
        """
        own = stored(batch.groupBy("key").agg(F.sum("n").alias("n")), "level")
        found = own.where(F.col("n") > 1).select("key")
        for _, level in self.levels:
            found = found.unionAll(own.select("key").join(level.select("key"), "key", "left_semi"))
        matched = stored(found.distinct(), "matched")
        self.levels.append((0, own))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, b), (_, a) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, stored(a.unionByName(b).groupBy("key").agg(F.sum("n").alias("n")), "level")))
            discard(a, b)
        return matched

    def drop(self) -> None:
        discard(*(level for _, level in self.levels))
        self.levels = []


def _marked(length: int):
    """Rows of places: for each text that they name, the byte ranges of its segments, merged."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            if not batch.num_rows:
                continue
            others = batch["more"].flatten()
            t1, t2, lo, hi = (np.concatenate([batch[c].to_numpy(), others.field(c).to_numpy()]).astype(np.int64) for c in PLACE)
            order = np.lexsort((lo, t2, t1))
            t1, t2, a, b = t1[order], t2[order], lo[order], hi[order] + length
            text = np.cumsum(np.append(0, (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])))
            # The furthest end so far, texts apart.
            upto = np.maximum.accumulate(text << 32 | b)
            opens = np.flatnonzero(np.append(True, text[1:] << 32 | a[1:] > upto[:-1]))
            ranges = a[opens] << 32 | upto[np.append(opens[1:] - 1, len(a) - 1)] & 0xFFFFFFFF
            first = np.flatnonzero(np.append(True, text[opens[1:]] != text[opens[:-1]]))
            at = opens[first]
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(opens)), pa.int32()), pa.array(ranges))
            yield pa.RecordBatch.from_arrays([pa.array(t1[at]), pa.array(t2[at].astype(np.int32)), lists], names=[*TEXT, "ranges"])

    return run


def _cut(length: int):
    """For each text, the bytes of the segments to compare."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "hot", "full", "t1", "t2", "lo", "bytes"]
        kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in slices(arrow, "t"):
            out: list[tuple] = []
            for text, t1, t2, rows in zip(byte_values(batch["t"]), batch["t1"].to_pylist(), batch["t2"].to_pylist(), batch["rows"].to_pylist()):
                out += [(r["key"], r["hot"], r["full"], t1, t2, r["lo"], text[r["lo"] : r["hi"] + length]) for r in rows]
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return run


CUT = "key bigint, hot boolean, full boolean, t1 bigint, t2 int, lo int, bytes binary"


def _window_hashes(data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of each string, and how many windows each has."""
    n = np.array([len(d) - length + 1 for d in data], np.int64)
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(d[p : p + length]) for d, k in zip(data, n.tolist()) for p in range(k)), np.uint64, int(n.sum())), n


def _compare(length: int):
    """Rows sorted by key: ranges of windows that another segment of the same key has as well."""

    def ranges(t: pa.Table) -> pa.RecordBatch:
        hashes, n = _window_hashes(t["bytes"].to_pylist(), length)
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        mixed = hashes * np.uint64(0x9E3779B97F4A7C15) + t["key"].to_numpy().view(np.uint64)[row]
        _, which, count = np.unique(mixed, return_inverse=True, return_counts=True)
        twice = (count[which] > 1) & ~t["full"].to_numpy(zero_copy_only=False)[row]
        before = np.append(False, twice[:-1]) & np.append(False, row[1:] == row[:-1])
        after = np.append(twice[1:], False) & np.append(row[1:] == row[:-1], False)
        a, b = np.flatnonzero(twice & ~before), np.flatnonzero(twice & ~after)
        start = np.cumsum(n) - n
        r = row[a]
        lo = t["lo"].to_numpy()[r]
        return pa.RecordBatch.from_arrays(
            [pa.array(t["t1"].to_numpy()[r]), pa.array(t["t2"].to_numpy()[r]), pa.array(lo + a - start[r], pa.int32()), pa.array(lo + b - start[r] + length, pa.int32())],
            names=["t1", "t2", "a", "b"],
        )

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in arrow:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            if not t.num_rows:
                continue
            # The last key may go on in the next batch; it has HOT rows at most.
            keys = t["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            for at in range(0, cut, PIECE):
                # Pieces end between keys.
                lo, hi = int(np.searchsorted(keys, keys[at])), cut if at + PIECE >= cut else int(np.searchsorted(keys, keys[at + PIECE]))
                if lo < hi:
                    yield ranges(t.slice(lo, hi - lo))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield ranges(rest)

    return run


def _spread(length: int):
    """A row for each window of hot keys' segments."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in arrow:
            for at in range(0, whole.num_rows, PIECE):
                t = whole.slice(at, PIECE)
                hashes, n = _window_hashes(t["bytes"].to_pylist(), length)
                row = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                columns = {c: pa.array(t[c].to_numpy(zero_copy_only=False)[row]) for c in ("key", "full", "t1", "t2")}
                yield pa.RecordBatch.from_arrays(
                    [columns["key"], pa.array(hashes.view(np.int64)), columns["full"], columns["t1"], columns["t2"], pa.array((t["lo"].to_numpy()[row] + step).astype(np.int32))],
                    names=["key", "h", "full", "t1", "t2", "p"],
                )

    return run


def repeats(texts: DataFrame, length: int = LENGTH, batches: int | None = None) -> DataFrame:
    """(t1, t2, ranges): byte ranges to remove from each distinct text, in arrays of start << 32 | end.

    They may overlap, and a text has more than one row where its ranges come from several slices of work.
    """
    one = stored(texts.groupBy(*TEXT).agg(F.first("t").alias("t"), F.count("*").alias("copies")).where(F.octet_length("t") >= length), "texts")
    if batches is None:
        size = one.agg(F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0)).alias("n")).first().n
        batches = max(LEAST_BATCHES, min(MOST_BATCHES, -(-size // BATCH_SIZE)))
    rows = stored(suffix_arrays(one, length, batches), "suffixes", "batch")
    family = LevelFamily()
    found = [family.add(rows.where(F.col("batch") == b).select("key", "n")) for b in range(batches)]
    matched = found[0]
    for more in found[1:]:
        matched = matched.unionAll(more)
    family.drop()
    # Each key once on the right; a crowded key's rows on the left can be split among tasks.
    met = stored(rows.drop("batch").join(stored(matched.distinct(), "matched"), "key"), "met")
    discard(rows, *found)

    place = F.struct(*PLACE)
    kinds = stored(met.groupBy("key", "seg").agg(F.sum("n").alias("n"), F.min(place).alias("at")), "kinds")
    twice = met.join(kinds.where(F.col("n") > 1).select("key", "seg"), ["key", "seg"])
    places = twice.select("slice", *PLACE, "more").repartition("slice").sortWithinPartitions("slice")
    whole = places.drop("slice").mapInArrow(_marked(length), "t1 bigint, t2 int, ranges array<bigint>")
    several = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where(F.col("kinds") > 1)
    open_ = kinds.join(several, "key").select("key", (F.col("kinds") > HOT).alias("hot"), (F.col("n") > 1).alias("full"), "at.*")
    asked = open_.groupBy(*TEXT).agg(F.collect_list(F.struct("key", "hot", "full", "lo", "hi")).alias("rows"))
    cut = stored(one.join(asked, TEXT).select("t", *TEXT, "rows").mapInArrow(_cut(length), CUT), "cut")
    part = cut.where(~F.col("hot")).repartition("key").sortWithinPartitions("key").mapInArrow(_compare(length), "t1 bigint, t2 int, a int, b int")
    spread = cut.where("hot").mapInArrow(_spread(length), "key bigint, h bigint, full boolean, t1 bigint, t2 int, p int")
    twice = spread.groupBy("key", "h").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key", "h")
    hot = spread.where(~F.col("full")).join(twice, ["key", "h"]).select(*TEXT, F.col("p").alias("a"), (F.col("p") + length).alias("b"))
    copied = one.where(F.col("copies") > 1).select(*TEXT, F.lit(0).alias("a"), F.octet_length("t").alias("b"))
    packed = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    single = part.unionAll(hot).unionAll(copied).select(*TEXT, F.array(packed).alias("ranges"))
    marks = stored(whole.unionAll(single), "marks")
    discard(met, kinds, cut, one)
    return marks


def _keep_udf(digest: bool):
    kind = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,%s>" % ("kept_sha256:string" if digest else "kept:binary")

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ranges in batches:
            out: list[tuple] = []
            ends, packed_all = ranges.offsets.to_numpy(), ranges.values.to_numpy()
            for i in range(len(texts)):
                text = (texts[i].as_py() or "").encode()
                removed = spans = 0
                kept = text
                if ends[i] < ends[i + 1]:
                    packed = np.sort(packed_all[ends[i] : ends[i + 1]])
                    a, b = packed >> 32, np.maximum.accumulate(packed & 0xFFFFFFFF)
                    opens = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
                    starts, stops = a[opens], np.append(b[opens[1:] - 1], b[-1])
                    edges = [0, *np.stack([starts, stops], 1).ravel().tolist(), len(text)]
                    kept = b"".join(text[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2))
                    removed, spans = len(text) - len(kept), len(starts)
                out.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest() if digest else kept))
            columns = list(zip(*out)) or [()] * 4
            yield pa.StructArray.from_arrays(
                [*(pa.array(list(c), pa.int64()) for c in columns[:3]), pa.array(list(columns[3]), pa.string() if digest else pa.binary())], names=["n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"]
            )

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def dedup(docs: DataFrame, text: str = "text", out: str = "dedup", digest: bool = False, length: int = LENGTH, batches: int | None = None) -> DataFrame:
    """``docs`` with a struct column ``out``: n_bytes, n_removed, n_spans and the kept bytes (or their SHA-256)."""
    names = docs.columns
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != out]).alias("row"), F.col(f"`{text}`").alias("text_"))
    named = _named(body, "text_").drop("text_")
    marks = repeats(_named(docs.select(F.col(f"`{text}`").alias("x")), "x"), length, batches)
    ranges = marks.groupBy(*TEXT).agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    joined = named.join(ranges, TEXT, "left")
    return joined.select("row", _keep_udf(digest)("t", "ranges").alias(out)).select("row.*", out)
