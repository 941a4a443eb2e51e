"""Grids of tokens: columns by overlap, fused columns, cells, label binding, compaction of the x axis, medoid clusters.

A grid is a page; its tokens are rows (grid, row, x0, x1, text).  What a step needs of a whole page is first reduced to
what the page's geometry bounds (distinct intervals, columns, labels), so a page of many rows is no long task; the
tokens themselves are only grouped by cell or joined back by their interval or column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marketlens.functions.cells import once
from marketlens.operators import placing
from marketlens.operators.ranks import middles, with_middles
from marketlens.operators.recognition import colour_distance, header_roles, header_row
from marketlens.operators.rounds import settled

# Overlap that joins a token to a column; when a column is two, by rows with two cells and their gaps.
OVERLAP, FUSED_ROWS, FUSED_SHARE, FUSED_SPREAD = 0.5, 2, 0.3, 0.35
# Pixels kept around a column, distance below which two ranges are one, drawn gap in glyph widths.
COLUMN_PAD, MERGE_GAP, DRAWN_GAP_GLYPHS = 3, 12, 2.0
# Fixed value: score below which a word of a thin band is not read.
WORD_SCORE = 0.42
# When two status cells are alike.
SHAPE_MERGE, SHAPE_NEVER, WIDTH_TOLERANCE, COLOUR_DISTANCE = 0.955, 0.86, 0.14, 42
#: Pairs of labels and columns up to which a page is bound in one fold.
PAGE_PAIRS = 1024
#: Cells of a grid that can become medoids in one round, cells compared at once, and the parts that a grid's cells are dealt to.
LEADERS, COMPARED, SHARES = 4096, 256, 32

_SPAN = "struct<a:double,b:double>"


def _first_index(items: Column, test) -> Column:
    """The place (from 0) of the first item that passes ``test``; null if none does."""
    return F.array_min(F.transform(items, lambda x, i: F.when(test(x), i)))


def token_columns(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``col``, their column's number from the left in their grid (null without an interval).

    In order of x0 (then x1) a token joins the first column whose span so far it overlaps by half of the narrower of the
    two, and widens it; else it starts a column.  Equal intervals always meet in one column, so only a page's distinct
    ones are folded; and only intervals that touch can interact, so each island of them is folded by itself.
    """
    given = tokens.where(F.col("x0").isNotNull() & F.col("x1").isNotNull())
    intervals = given.groupBy("grid", "x0", "x1").agg(F.count("*").alias("n"))
    along = W.partitionBy("grid").orderBy("x0", "x1")  # distinct intervals of a page
    reach = F.max("x1").over(along.rowsBetween(W.unboundedPreceding, -1))
    intervals = intervals.withColumn("apart", F.coalesce(F.col("x0") >= reach, F.lit(True)).cast("int"))
    islands = intervals.withColumn("island", F.sum("apart").over(along)).groupBy("grid", "island").agg(F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("xs"))
    entry = lambda x: F.struct(x["x0"].cast("double").alias("a"), x["x1"].cast("double").alias("b"))
    start = F.struct(F.array().cast(f"array<{_SPAN}>").alias("spans"), F.array().cast("array<int>").alias("homes"))

    def joined(state: Column, e: Column, home: Column) -> Column:
        wider = F.transform(state["spans"], lambda s, i: F.when(i == home, F.struct(F.least(s["a"], e["a"]).alias("a"), F.greatest(s["b"], e["b"]).alias("b"))).otherwise(s))
        spans = F.when(home.isNull(), F.concat(state["spans"], F.array(e))).otherwise(wider)
        return F.struct(spans.cast(f"array<{_SPAN}>").alias("spans"), F.concat(state["homes"], F.array(F.coalesce(home, F.size(state["spans"])))).cast("array<int>").alias("homes"))

    def step(state: Column, x: Column) -> Column:
        def of(e: Column) -> Column:
            shared = lambda s: F.least(e["b"], s["b"]) - F.greatest(e["a"], s["a"])
            home = _first_index(state["spans"], lambda s: once(shared(s), lambda o: (o > 0) & (o >= OVERLAP * F.least(e["b"] - e["a"], s["b"] - s["a"]))))
            return once(home, lambda h: joined(state, e, h))

        return once(entry(x), of)

    folded = islands.withColumn("homes", F.aggregate("xs", start, step)["homes"])
    each = folded.select("grid", "island", F.inline(F.arrays_zip("xs", "homes"))).select("grid", "island", "xs.x0", "xs.x1", F.col("homes").alias("home"))
    return _numbered(tokens, each, ["island", "home"])


def _numbered(tokens: DataFrame, intervals: DataFrame, key: list[str]) -> DataFrame:
    """``tokens`` with the numbers, from the left, of the columns (``key``) of their intervals."""
    columns = intervals.groupBy("grid", *key).agg(F.min("x0").alias("c0"), F.max("x1").alias("c1"))
    order = W.partitionBy("grid").orderBy("c0", "c1", *key)  # columns of a page
    columns = columns.select("grid", *key, (F.row_number().over(order) - 1).alias("col"))
    return tokens.join(intervals.join(columns, ["grid", *key]).select("grid", "x0", "x1", "col"), ["grid", "x0", "x1"], "left")


def fused_cuts(tokens: DataFrame) -> DataFrame:
    """(grid, col, cut): columns that are two, and where.

    Of each row with several tokens the middle of its widest gap is a vote; the upper median of the votes is the cut if
    at least two rows and 30 % of the column's vote, and the votes lie within 35 % of its width.
    """
    along = W.partitionBy("grid", "col", "row").orderBy("x0", "x1")  # tokens of one cell
    before = F.lag("x1").over(along)
    gaps = tokens.where("col is not null").withColumns({"gap": F.col("x0") - before, "at": before + (F.col("x0") - before) / 2})
    votes = settled(gaps.groupBy("grid", "col", "row").agg(F.min("x0").alias("c0"), F.max("x1").alias("c1"), F.max_by("at", F.struct("gap", -F.col("x0"))).alias("at")))
    whole = votes.groupBy("grid", "col").agg(F.count("*").alias("n_rows"), F.count("at").alias("votes"), (F.max("at") - F.min("at")).alias("spread"), (F.max("c1") - F.min("c0")).alias("width"))
    able = whole.where(_is_fused())
    return able.join(middles(votes, ["grid", "col"], "at").select("grid", "col", F.col("upper").alias("cut")), ["grid", "col"]).select("grid", "col", "cut")


def _is_fused() -> Column:
    """Whether the votes of a column (n_rows, votes, spread, width) make it two."""
    return (F.col("votes") >= FUSED_ROWS) & (F.col("votes") >= FUSED_SHARE * F.col("n_rows")) & (F.col("spread") <= FUSED_SPREAD * F.col("width"))


def split_fused(tokens: DataFrame) -> DataFrame:
    """``tokens`` (see :func:`token_columns`) with fused columns split at their cut and all columns numbered anew."""
    cut = tokens.join(fused_cuts(tokens), ["grid", "col"], "left")
    side = cut.withColumn("side", F.coalesce((F.col("x0") + F.col("x1")) / 2 >= F.col("cut"), F.lit(False)).cast("int"))
    # An interval is on one side of its column's cut, so intervals decide again.
    intervals = side.where("col is not null").groupBy("grid", "x0", "x1").agg(F.min("col").alias("fused"), F.min("side").alias("side"))
    return _numbered(tokens.drop("col"), intervals, ["fused", "side"])


def cells(tokens: DataFrame) -> DataFrame:
    """(grid, col, row, x0, x1, text, n_tokens): what each column holds on each row, its tokens from left to right."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda t: t["text"])  # tokens of one cell
    return tokens.where("col is not null").groupBy("grid", "col", "row").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_join(texts, " ").alias("text"), F.count("*").alias("n_tokens"))


def split_cells(tokens: DataFrame, small: bool) -> DataFrame:
    """The :func:`cells` of ``tokens`` (see :func:`token_columns`) after :func:`split_fused`, from tokens dealt once by cell.

    Only cells of several tokens vote on a cut or are gathered, and only grids with a cut are numbered anew.  ``small`` says
    that no grid has more than ``ranks.SMALL`` tokens.
    """
    along = W.partitionBy("grid", "col", "row").orderBy("x0", "x1")  # tokens of one cell
    given = tokens.where("col is not null").withColumns({"nth": F.row_number().over(along), "n": F.count("*").over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "before": F.lag("x1").over(along)})
    met = settled(given)
    gaps = met.where("nth > 1").withColumns({"gap": F.col("x0") - F.col("before"), "at": F.col("before") + (F.col("x0") - F.col("before")) / 2})
    votes = gaps.groupBy("grid", "col", "row").agg(F.max_by("at", F.struct("gap", -F.col("x0"))).alias("at"))
    wide = met.groupBy("grid", "col").agg(F.count_if(F.col("nth") == 1).alias("n_rows"), (F.max("x1") - F.min("x0")).alias("width"), (F.max("n") > 1).alias("several")).where("several")
    votes = settled(with_middles(votes, ["grid", "col"], "at", small))
    cast = votes.groupBy("grid", "col").agg(F.count("at").alias("votes"), (F.max("at") - F.min("at")).alias("spread"), F.max("upper").alias("cut"))
    cuts = settled(cast.join(wide, ["grid", "col"]).where(_is_fused()).select("grid", "col", "cut"))
    side = F.coalesce((F.col("x0") + F.col("x1")) / 2 >= F.col("cut"), F.lit(False))
    sides = met.join(cuts.select("grid").distinct(), "grid", "left_semi").join(cuts, ["grid", "col"], "left").withColumn("side", side.cast("int"))
    spans = sides.groupBy("grid", "col", "side").agg(F.min("x0").alias("c0"), F.max("x1").alias("c1"), F.max("cut").alias("cut"))
    number = F.row_number().over(W.partitionBy("grid").orderBy("c0", "c1", "col", "side")) - 1  # columns of a page
    # A row per column of a grid with a cut: its number, and the one of what stands right of its cut.
    new = spans.withColumn("number", number).groupBy("grid", "col").agg(F.max("cut").alias("cut"), *[F.max(F.when(F.col("side") == i, F.col("number"))).alias(name) for i, name in enumerate(("left_", "right_"))])
    placed = met.join(new, ["grid", "col"], "left").withColumn("col", F.coalesce(F.when(side, F.col("right_")).otherwise(F.col("left_")), F.col("col")))
    alone = placed.where("n = 1").select("grid", "col", "row", "x0", "x1", F.coalesce("text", F.lit("")).alias("text"), F.lit(1).cast("bigint").alias("n_tokens"))
    return alone.unionByName(cells(placed.where("n > 1")))


def columns_of(tokens: DataFrame) -> DataFrame:
    """(grid, col, c0, c1): the spans of the columns."""
    return tokens.where("col is not null").groupBy("grid", "col").agg(F.min("x0").alias("c0"), F.max("x1").alias("c1"))


def overlapping(labels: DataFrame, columns: DataFrame) -> DataFrame:
    """Labels (grid, label, x0, x1, ...) with each column of their grid that they overlap, and how far its centre is.

    One label row and the columns of a page meet by the page, a bounded number on both sides.
    """
    met = labels.join(columns, "grid").where(F.least("x1", "c1") > F.greatest("x0", "c0"))
    return met.withColumn("distance", F.abs((F.col("c0") + F.col("c1")) / 2 - (F.col("x0") + F.col("x1")) / 2))


def bind_one_to_one(pairs: DataFrame) -> DataFrame:
    """(grid, label, col): each label takes the nearest column that no label before it has taken.

    ``pairs`` are (grid, label, score, x0, col, distance); labels go by score, then from the left, then by name; of equally
    near columns the left one is taken.  A page of at most ``PAGE_PAIRS`` pairs is one row that is folded in that order;
    larger ones are bound in rounds (see :func:`_bound_in_rounds`), with the same result.
    """
    given = pairs.where("grid is not null and col is not null").select("grid", "label", F.struct((-F.col("score")).alias("minus"), "x0", "label").alias("turn"), "col", "distance")
    large = settled(given.groupBy("grid").agg(F.count("*").alias("n")).where(F.col("n") > PAGE_PAIRS).select("grid"))
    if large.isEmpty():
        return _bound_by_page(given)
    return _bound_by_page(given.join(large, "grid", "left_anti")).unionByName(_bound_in_rounds(given.join(large, "grid", "left_semi")))


def _bound_by_page(given: DataFrame) -> DataFrame:
    """The binding of pages of a bounded number of pairs, each page's in one fold."""
    kinds = dict(given.dtypes)
    turns = given.groupBy("grid").agg(F.array_sort(F.collect_list(F.struct("turn", "distance", "col"))).alias("turns"))  # PAGE_PAIRS at most

    def step(bound: Column, p: Column) -> Column:
        label, col = p["turn"]["label"], p["col"]
        done = F.exists(bound, lambda b: b["label"].eqNullSafe(label) | (b["col"] == col))
        return F.when(done, bound).otherwise(F.concat(bound, F.array(F.struct(label.alias("label"), col.alias("col")))))

    bound = F.aggregate("turns", F.array().cast(f"array<struct<label:{kinds['label']},col:{kinds['col']}>>"), step)
    return turns.select("grid", F.inline(bound))


def _bound_in_rounds(given: DataFrame) -> DataFrame:
    """Every label asks for its nearest column, every column keeps the first of those that ask, and the others strike it off.

    As all columns prefer labels in the same order, what stands when no one is refused is what one pass in that order
    gives; a round deals pairs by label and by column, never by page.
    """
    left = settled(given)
    while True:
        asked = left.groupBy("grid", "label").agg(F.min_by(F.struct("turn", "col"), F.struct("distance", "col")).alias("a")).select("grid", "label", "a.turn", "a.col")
        kept = asked.groupBy("grid", "col").agg(F.min_by("label", "turn").alias("first"))
        answered = settled(asked.join(kept, ["grid", "col"]).select("grid", "label", "col", (F.col("label") != F.col("first")).alias("refused")))
        refused = answered.where("refused").select("grid", "label", "col")
        if refused.isEmpty():
            return answered.select("grid", "label", "col")
        left = settled(left.join(refused, ["grid", "label", "col"], "left_anti"))


def by_size(clusters: DataFrame) -> DataFrame:
    """``clusters`` (grid, cluster, members, ...) with ``place``: largest first in their grid, equal ones by their first cell."""
    return placing.ranked(clusters, "grid", [F.desc("members"), "cluster"], "place")


def thin_band_roles(words: DataFrame, pages: DataFrame, columns: DataFrame, scale: float) -> DataFrame:
    """(grid, row, col, role): the header found in thin bands of a page before it is cropped, and the columns it names.

    ``words`` (grid, row, x0, x1, text, score) are the best readings of the words in bands around a page's rows, in band
    pixels (``scale`` of them for one of the page), ``pages`` (grid, n_rows), ``columns`` (grid, col, c0, c1) those located on
    the page.  The topmost early row with enough labels is the header; pages of fewer than three rows have none, nor is
    the last row one.  Each label, best score first, names the column that it overlaps whose centre is nearest and that
    is still free.  A sort arrow behind a label is no part of it; readings of low score and unknown texts are no labels.
    """
    early = words.join(pages.where("n_rows >= 3"), "grid").where((F.col("row") < F.col("n_rows") - 1) & (F.col("score") >= WORD_SCORE))
    labels = header_roles(early.withColumn("plain", F.regexp_replace("text", "[▲▼]$", "")), "plain").where("role is not null")
    labels = settled(labels.select("grid", "row", "x0", "x1", "role", "score"))
    named = labels.join(header_row(labels), ["grid", "row"]).join(columns, "grid")
    a, b = F.col("x0") / scale, F.col("x1") / scale
    over = F.least(b, F.col("c1")) - F.greatest(a, F.col("c0"))
    distance = F.abs((F.col("c0") + F.col("c1")) / 2 - (a + b) / 2)
    pairs = named.where(over > 0).select("grid", F.struct("row", "x1", "role", "x0", "score").alias("label"), "score", "x0", "col", distance.alias("distance"))
    return bind_one_to_one(pairs.distinct()).select("grid", F.col("label.row").alias("row"), "col", F.col("label.role").alias("role"))


def kept_spans(columns: DataFrame, pages: DataFrame, scale: float = 1.0) -> DataFrame:
    """(grid, s0, s1, d0, d1): the parts of each page's width that are kept, and where they are drawn, side by side.

    ``columns`` (grid, c0, c1) are the columns worth reading, ``pages`` (grid, width, glyph).  Padded columns that come
    within the merging distance are one part; parts are drawn from the left with a gap that ends a token between them, a
    running sum of the widths before.
    """
    pad, near = max(1.0, COLUMN_PAD * scale), max(2.0, MERGE_GAP * scale)
    ranges = columns.join(pages, "grid").select("grid", "glyph", F.greatest(F.lit(0.0), F.col("c0") - pad).alias("a"), F.least(F.col("width").cast("double"), F.col("c1") + pad).alias("b"))
    along = W.partitionBy("grid").orderBy("a", "b")  # columns of a page
    reach = F.max("b").over(along.rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.withColumn("opens", F.coalesce(F.col("a") > reach + near, F.lit(True)).cast("int")).withColumn("part", F.sum("opens").over(along))
    parts = ranges.groupBy("grid", "part").agg(F.min("a").alias("s0"), F.max("b").alias("s1"), F.max("glyph").alias("glyph"))
    gap = F.greatest(F.lit(near), F.ceil(F.col("glyph") * DRAWN_GAP_GLYPHS).cast("double"))
    before = F.coalesce(F.sum(F.col("s1") - F.col("s0") + gap).over(W.partitionBy("grid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return parts.withColumn("d0", gap + before).select("grid", "s0", "s1", "d0", (F.col("d0") + F.col("s1") - F.col("s0")).alias("d1"))


def within(points: DataFrame, spans: DataFrame, x: str, lo: str, hi: str, width: float = 128.0) -> DataFrame:
    """``points`` with the span of their grid (disjoint ones) that holds ``x``, null if none does.

    Spans are cut in bins of ``width`` and points go by theirs, so a page is many keys and nothing is compared but a
    point and the few spans of its bin.
    """
    bin_of = lambda c: F.floor(c / width)
    cut = spans.withColumnRenamed("grid", "grid_").withColumn("bin_", F.explode(F.sequence(bin_of(F.col(lo)), bin_of(F.col(hi)))))
    inside = (F.col("grid") == F.col("grid_")) & (bin_of(F.col(x)) == F.col("bin_")) & F.col(x).between(F.col(lo), F.col(hi))
    return points.join(cut, inside, "left").drop("grid_", "bin_")


def to_compact(points: DataFrame, spans: DataFrame, x: str = "x", out: str = "cx") -> DataFrame:
    """``points`` with their place on the compacted page; null where the page was not kept."""
    met = within(points, spans, x, "s0", "s1")
    return met.withColumn(out, F.col("d0") + F.col(x) - F.col("s0")).drop("s0", "s1", "d0", "d1")


def to_source(points: DataFrame, spans: DataFrame, x: str = "x", out: str = "sx", zoom: float = 1.0) -> DataFrame:
    """``points`` of a compacted page, enlarged ``zoom`` times, with their place on the page; between parts x itself counts."""
    met = within(points.withColumn("at_", F.col(x) / zoom), spans, "at_", "d0", "d1")
    return met.withColumn(out, F.coalesce(F.col("s0") + F.col("at_") - F.col("d0"), F.col("at_"))).drop("at_", "s0", "s1", "d0", "d1")


def worth_reading(cells_: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """(grid, col, why): the columns that are worth reading at full size.

    ``cells_`` are (grid, col, x0, x1, glyphs, marks, glyph): a row per cell with its counts of full-height glyphs and of
    separators.  ``header`` (grid, col, role) is what a header names; where it names the status and a price, nothing else
    is guessed.  The leftmost column of short numbers is always kept, as it numbers the rows.
    """
    share = lambda cond: F.avg(cond.cast("int"))
    g = cells_.groupBy("grid", "col").agg(
        F.count("*").alias("n"), F.min("x0").alias("c0"), (F.max("x1") - F.min("x0") <= 10 * F.max("glyph")).alias("narrow"), share(F.col("glyphs").between(1, 3)).alias("short"),
        share(F.col("marks") > 0).alias("marked"), share(F.col("glyphs") == 8).alias("eight"), share(F.col("glyphs").between(2, 5)).alias("word"),
    )
    named = header.select("grid", "col", "role") if header is not None else g.select("grid", "col", F.lit(None).cast("string").alias("role")).where("false")
    read = named.where(F.col("role").isin("status", "list", "orig", "sold", "conc", "mls", "mt"))
    sure = read.groupBy("grid").agg((F.max((F.col("role") == "status").cast("int")) * F.max(F.col("role").isin("list", "sold", "orig").cast("int")) == 1).alias("decisive"))
    first = g.where((F.col("n") >= 3) & (F.col("short") >= 0.9)).groupBy("grid").agg(F.min_by("col", F.struct("c0", "col")).alias("index_col"))
    g = g.join(first, "grid", "left").join(sure, "grid", "left").join(read.groupBy("grid", "col").agg(F.min("role").alias("role")), ["grid", "col"], "left")
    shape = F.when(F.col("marked") >= 0.8, "money?").when(F.col("eight") >= 0.6, "mls?").when((F.col("word") >= 0.8) & F.col("narrow"), "status?")
    why = F.coalesce("role", F.when(F.col("col") == F.col("index_col"), "index?"), F.when(~F.coalesce("decisive", F.lit(False)), shape))
    return g.select("grid", "col", why.alias("why")).where("why is not null")


def _padded(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as the rows of a matrix, filled up with zeros, and their lengths (a list with a null counts as none)."""
    rows = [np.array([np.nan if x is None else x for x in v], np.float64) if v is not None else np.array([np.nan]) for v in column.to_pylist()]
    size = np.array([len(r) for r in rows], np.int64)
    out = np.zeros((len(rows), int(size.max(initial=0))))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, size


class _Cells:
    """Status cells in columns: ids, widths, colours, vectors, with what every comparison of vectors needs."""

    def __init__(self, ids, width, colour, colour_size, vector, size):
        self.ids, self.width, self.colour, self.colour_size, self.vector, self.size = ids, width, colour, colour_size, vector, size
        self.sum = vector.sum(axis=1)
        self.power = np.maximum((vector * vector).sum(axis=1) - self.sum * self.sum / np.maximum(size, 1), 0)

    @classmethod
    def read(cls, batch: pa.RecordBatch):
        number = lambda c: np.array([np.nan if x is None else float(x) for x in batch[c].to_pylist()])
        return cls(np.array(batch["cell"].to_pylist(), object), number("width"), *_padded(batch["colour"]), *_padded(batch["vector"]))

    def take(self, at) -> _Cells:
        return _Cells(self.ids[at], self.width[at], self.colour[at], self.colour_size[at], self.vector[at], self.size[at])

    def joined(self, other: _Cells) -> _Cells:
        wide = lambda x, n: np.pad(x, ((0, 0), (0, n - x.shape[1])))
        both = lambda x, y: np.concatenate([wide(x, max(x.shape[1], y.shape[1])), wide(y, max(x.shape[1], y.shape[1]))])
        flat = lambda x, y: np.concatenate([x, y])
        return _Cells(flat(self.ids, other.ids), flat(self.width, other.width), both(self.colour, other.colour), flat(self.colour_size, other.colour_size), both(self.vector, other.vector), flat(self.size, other.size))

    def __len__(self) -> int:
        return len(self.ids)


def _alike(a: _Cells, b: _Cells) -> np.ndarray:
    """Whether two status cells look like one code (each of ``a`` against each of ``b``): widths agree, and shapes alone or
    shapes and colours."""
    n, k = min(a.vector.shape[1], b.vector.shape[1]), min(a.colour.shape[1], b.colour.shape[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.sqrt(np.outer(a.power, b.power))
        shape = a.vector[:, :n] @ b.vector[:, :n].T - np.outer(a.sum, b.sum / np.maximum(b.size, 1))
        shape = np.round(np.where(scale < 1e-10, 0.0, shape / scale), 9)
        apart = sum(((a.colour[:, i, None] - b.colour[None, :, i]) ** 2 for i in range(k)), np.zeros(shape.shape))
        near = (np.sqrt(apart) <= COLOUR_DISTANCE) & (a.colour_size[:, None] == b.colour_size[None, :])
        wide = np.abs(a.width[:, None] - b.width[None, :]) / np.maximum(a.width[:, None], b.width[None, :]) > WIDTH_TOLERANCE
        return ~wide & (a.size[:, None] == b.size[None, :]) & ((shape >= SHAPE_MERGE) | ((shape >= SHAPE_NEVER) & near))


def _by_key(batches: Iterator[pa.RecordBatch], names: list[str], rows: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of batches that are sorted by key, none of more than ``rows`` rows or of two keys."""
    for batch in batches:
        key = list(zip(*[batch[c].to_pylist() for c in names]))
        at = 0
        while at < len(key):
            end = at + 1
            while end < len(key) and end - at < rows and key[end] == key[at]:
                end += 1
            yield key[at], batch.slice(at, end - at)
            at = end


def _medoids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of cells sorted by grid and cell those that are unlike all medoids before them in their grid."""
    of, kept = None, None
    for key, part in _by_key(batches, ["grid"], COMPARED):
        if key != of:
            of, kept = key, None
        cells_ = _Cells.read(part)
        free = np.ones(len(cells_), bool) if kept is None else ~_alike(cells_, kept).any(axis=1)
        at = np.flatnonzero(free)
        like = _alike(cells_.take(at), cells_.take(at))
        new: list[int] = []
        for i in range(len(at)):
            if not like[i, new].any():
                new.append(i)
        kept = cells_.take(at[new]) if kept is None else kept.joined(cells_.take(at[new]))
        yield part.take(pa.array(at[new], pa.int64()))


def _settled_cells(kind: pa.DataType):
    """Cells with the first medoid that they are like; sorted by grid and share, its medoids before its cells (``turn``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, kept = None, None
        for key, part in _by_key(batches, ["grid", "share"], COMPARED):
            if key != of:
                of, kept = key, _Cells.read(part.slice(0, 0))
            turn = part["turn"].to_numpy()
            here = int(np.searchsorted(turn, 1))
            if here:
                kept = kept.joined(_Cells.read(part.slice(0, here)))
            part = part.slice(here)
            if not len(part):
                continue
            cells_ = _Cells.read(part)
            like = _alike(cells_, kept)
            # A medoid is its own cluster, whatever its vector.
            like |= cells_.ids[:, None] == kept.ids[None, :]
            home = pa.array([kept.ids[i] if hit else None for i, hit in zip(like.argmax(axis=1) if len(kept) else [0] * len(part), like.any(axis=1))], kind)
            yield pa.RecordBatch.from_arrays([*[part[c] for c in ("grid", "cell", "width", "colour", "vector")], home], names=["grid", "cell", "width", "colour", "vector", "cluster"])

    return run


def first_fit(cells_: DataFrame) -> DataFrame:
    """(grid, cell, cluster): status cells by the first cluster, in order of cells, whose first cell they are like.

    A cluster is named by its first cell, its medoid.  In rounds: the earliest ``LEADERS`` unsettled cells of each grid are
    taken in order, those unlike the ones before them are medoids, and every unsettled cell joins the earliest medoid it
    is like.  All cells before a taken one are settled, so a round decides what one pass in order would.  Cells are dealt
    by grid and a hash, each part with the medoids of its grid, and compared a block at a time.  Where few cells are alike
    every cell is compared with every medoid before it, which is the product of their numbers.  ``cells_`` are (grid, cell,
    width, colour, vector).
    """
    fields = ["grid", "cell", "width", "colour", "vector"]
    tasks = F.lit(SHARES)
    rest = settled(cells_.select(*fields))
    schema = ", ".join(f"`{name}` {kind}" for name, kind in rest.dtypes)
    cell = dict(rest.dtypes)["cell"]
    kind = to_arrow_type(rest.schema["cell"].dataType)
    done = []
    while True:
        earliest = rest.withColumn("nth_", F.row_number().over(W.partitionBy("grid").orderBy("cell"))).where(F.col("nth_") <= LEADERS).drop("nth_")
        new = settled(earliest.repartition("grid").sortWithinPartitions("grid", "cell").mapInArrow(_medoids, schema))
        dealt = rest.select(*fields, F.lit(1).alias("turn"), F.pmod(F.xxhash64("cell"), tasks).cast("int").alias("share"))
        shown = new.select(*fields, F.lit(0).alias("turn"), F.explode(F.sequence(F.lit(0), tasks - 1)).alias("share"))
        ordered = dealt.unionByName(shown).repartition("grid", "share").sortWithinPartitions("grid", "share", "turn", "cell")
        met = settled(ordered.select(*fields, "turn", "share").mapInArrow(_settled_cells(kind), f"{schema}, cluster {cell}"))
        done.append(met.where("cluster is not null").select("grid", "cell", "cluster"))
        rest = met.where("cluster is null").drop("cluster")
        if rest.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def centred(cells_: DataFrame, clusters: DataFrame) -> DataFrame:
    """(grid, cluster, members, colour, spread): each cluster's mean colour and how far its farthest member's is."""
    met = cells_.select("grid", "cell", "colour").join(clusters, ["grid", "cell"])
    whole = lambda i: F.floor(F.avg(F.col("colour")[i].cast("decimal(20,6)")).cast("double") + 0.5).cast("double")
    mean = met.groupBy("grid", "cluster").agg(F.count("*").alias("members"), F.array(*[whole(i) for i in range(3)]).alias("mean"))
    far = met.join(mean, ["grid", "cluster"]).groupBy("grid", "cluster", "members", "mean").agg(F.max(colour_distance(F.col("colour"), F.col("mean"))).alias("spread"))
    return far.withColumnRenamed("mean", "colour")
