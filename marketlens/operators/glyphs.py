"""Glyphs of a token: segments of its projection brought to a known number, components and holes of its raster.

Everything is column expressions over one token's or glyph's arrays, so nothing is shuffled: a segment is a struct
(x, w), a raster is an array of values row by row, a run is a struct (y, a, b) of pixels a to b - 1 of a line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.cells import once

# By how many segments a count may be off, how far a cut's place counts against its ink, gap that joins parts.
MOST_OFF, LEAST_SPLIT, OFF_CENTRE, JOINED_GAP = 4, 4, 1.5, 2
# Ink level of a glyph's raster for holes, and the pixels of a hole at least.
HOLE_LEVEL, HOLE_PIXELS = 0.40, 3

_SEGMENTS = "array<struct<x:int,w:int>>"
_RUNS = "array<struct<y:int,a:int,b:int,label:int>>"


def _segment(x: Column, w: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), w.cast("int").alias("w"))


def _repeat(n: Column, start: Column, step) -> Column:
    """``start`` after ``n`` steps (none if n is not positive)."""
    return F.aggregate(F.array_repeat(F.lit(0), F.greatest(n, F.lit(0))), start, lambda state, _: step(state))


def _stretches(flags: Column, breaks=None) -> Column:
    """Structs (a, b) of the half-open stretches of true flags; ``breaks`` tells at which indices a new one must start."""
    new = (lambda i: F.lit(False)) if breaks is None else breaks

    def of(f: Column) -> Column:
        at = lambda i: F.coalesce(F.get(f, i), F.lit(False))
        places = F.when(F.size(f) > 0, F.sequence(F.lit(0), F.size(f) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: at(i) & (~at(i - 1) | new(i)))
        ends = F.filter(places, lambda i: at(i) & (~at(i + 1) | new(i + 1)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), (b + 1).alias("b")))

    return once(flags, of)


def raw_segments(projection: Column, least: Column | int) -> Column:
    """Stretches of inked columns, at least ``least`` wide."""
    each = F.transform(_stretches(F.transform(projection, lambda v: v > 0)), lambda s: _segment(s["a"], s["b"] - s["a"]))
    return F.filter(each, lambda s: s["w"] >= least).cast(_SEGMENTS)


def merge_closest(segments: Column, target: Column) -> Column:
    """``segments`` with the closest neighbours joined, the leftmost of equally close ones first, until ``target`` are left."""

    def step(state: Column) -> Column:
        gap = lambda s, i: F.get(state, i + 1)["x"] - s["x"] - s["w"]
        k = F.array_min(F.transform(F.slice(state, F.lit(1), F.size(state) - 1), lambda s, i: F.struct(gap(s, i).alias("gap"), i.alias("i"))))["i"]
        first = lambda k: F.get(state, k)["x"]
        joined = lambda k: F.array(_segment(first(k), F.get(state, k + 1)["x"] + F.get(state, k + 1)["w"] - first(k)))
        return once(k, lambda k: F.concat(F.slice(state, F.lit(1), k), joined(k), F.slice(state, k + 3, F.size(state)))).cast(_SEGMENTS)

    return _repeat(F.size(segments) - F.greatest(target, F.lit(1)), segments, step)


def split_widest(segments: Column, projection: Column, least: Column | int, target: Column) -> Column:
    """``segments`` with the widest cut in two until there are ``target``, or until it is too narrow to cut.

    A run is first sized by the middle width of the others: it probably holds k glyphs, so its cuts are expected at the
    k-ths of its width, and a column counts by its ink and by its distance from the nearest of those.
    """

    def step(state: Column) -> Column:
        widest = F.array_min(F.transform(state, lambda s, i: F.struct((-s["w"]).alias("minus"), i.alias("i"))))["i"]
        return once(widest, lambda i: once(F.get(state, i), lambda run: once(parts_in(state, i, run), lambda k: cut(state, i, run, k)))).cast(_SEGMENTS)

    def parts_in(state: Column, widest: Column, run: Column) -> Column:
        others = F.array_sort(F.transform(F.filter(state, lambda s, i: i != widest), lambda s: s["w"]))
        usual = F.get(others, F.floor((F.size(state) - 1) / 2).cast("int"))
        k = once(usual, lambda u: F.coalesce(F.when(u > 0, F.floor(run["w"] / u + 0.5)), F.lit(2)))
        return F.greatest(F.lit(2), F.least(k, F.greatest(F.lit(2), target - F.size(state) + 1)))

    def cut(state: Column, widest: Column, run: Column, k: Column) -> Column:
        places = F.sequence(run["x"] + F.floor(run["w"] * 0.25).cast("int"), run["x"] + F.floor(run["w"] * 0.75).cast("int"))
        off = lambda x: F.array_min(F.transform(F.sequence(F.lit(1), k.cast("int") - 1), lambda i: F.abs(x - run["x"] - run["w"] * i / k)))
        best = F.array_min(F.transform(places, lambda x: F.struct((F.get(projection, x) + off(x) * OFF_CENTRE).alias("cost"), x.alias("x"))))["x"]
        parts = once(best, lambda c: F.array(_segment(run["x"], c - run["x"]), _segment(c, run["x"] + run["w"] - c)))
        return once(parts, lambda p: split(state, widest, run, p))

    def split(state: Column, widest: Column, run: Column, parts: Column) -> Column:
        fits = (run["w"] >= F.lit(2) * least) & F.forall(parts, lambda s: s["w"] >= least)
        made = F.concat(F.slice(state, F.lit(1), widest), parts, F.slice(state, widest + 2, F.size(state)))
        return F.when(F.coalesce(fits, F.lit(False)), made).otherwise(state)

    return _repeat(target - F.size(segments), segments, step)


def grouped_parts(boxes: Column, least_area: Column | int, target: Column) -> Column:
    """Segments from the boxes of components (structs with x, w, area): small ones dropped, those that touch or nearly do
    joined, then brought down to ``target``; null if there are too few or far too many."""
    kept = F.array_sort(F.transform(F.filter(boxes, lambda b: b["area"] >= least_area), lambda b: _segment(b["x"], b["w"])))

    def step(state: Column, b: Column) -> Column:
        last = F.try_element_at(state, F.lit(-1))
        end = last["x"] + last["w"]
        wider = F.concat(F.slice(state, F.lit(1), F.greatest(F.size(state) - 1, F.lit(0))), F.array(_segment(last["x"], F.greatest(end, b["x"] + b["w"]) - last["x"])))
        return F.when(F.coalesce(end - b["x"] >= -JOINED_GAP, F.lit(False)), wider).otherwise(F.concat(state, F.array(b))).cast(_SEGMENTS)

    groups = F.aggregate(kept, F.array().cast(_SEGMENTS), step)
    n = F.size(groups)
    return F.when(n == target, groups).when((n > target) & (n <= target + MOST_OFF), merge_closest(groups, target))


def digit_segments(projection: Column, least: Column | int, target: Column, parts: Column | None = None) -> Column:
    """A struct (segments, method): ``target`` segments of a token, from its projection as it is, merged or split, or else
    from its components (``parts``, see :func:`grouped_parts`); method says which, or that it failed."""
    kind = f"struct<segments:{_SEGMENTS},method:string>"

    def of(raw: Column) -> Column:
        n = F.size(raw)
        merged = F.when((n > target) & (n <= target + MOST_OFF), merge_closest(raw, target)).otherwise(raw)
        return once(merged, lambda m: F.when((F.size(m) >= F.greatest(F.lit(LEAST_SPLIT), target - MOST_OFF)) & (F.size(m) < target), split_widest(m, projection, least, target)).otherwise(m))

    def named(raw: Column, fitted: Column) -> Column:
        method = F.when(F.size(raw) == target, "projection").when(F.size(fitted) == target, "projection-adjusted")
        if parts is not None:
            method = F.coalesce(method, F.when(F.size(parts) == target, "cc-fallback"))
        chosen = fitted if parts is None else F.when(F.coalesce(method == "cc-fallback", F.lit(False)), parts).otherwise(fitted)
        return F.struct(chosen.alias("segments"), F.coalesce(method, F.lit("projection-failed")).alias("method")).cast(kind)

    pair = once(raw_segments(projection, least), lambda raw: F.struct(raw.alias("raw"), of(raw).alias("fitted")))
    return once(pair, lambda p: named(p["raw"], p["fitted"]))


def runs(raster: Column, width: int, inked) -> Column:
    """The runs of pixels that pass ``inked``, line by line."""
    along = _stretches(F.transform(raster, inked), lambda i: i % width == 0)
    return F.transform(along, lambda s: F.struct(F.floor(s["a"] / width).cast("int").alias("y"), (s["a"] % width).cast("int").alias("a"), (s["b"] - s["a"] + s["a"] % width).cast("int").alias("b")))


def components(raster_runs: Column) -> Column:
    """Boxes (x, y, w, h, area) of the 4-connected components of a raster's runs.

    Runs are taken line by line; one that touches runs of the line before takes the least of their labels, and all runs of
    those labels become one component.
    """

    def step(state: Column, r: Column) -> Column:
        met = F.transform(F.filter(state, lambda s: (s["y"] == r["y"] - 1) & (s["a"] < r["b"]) & (r["a"] < s["b"])), lambda s: s["label"])
        of = lambda s, label: F.struct(s["y"].alias("y"), s["a"].alias("a"), s["b"].alias("b"), label.cast("int").alias("label"))
        all_ = lambda met, own: F.concat(F.transform(state, lambda s: F.when(F.array_contains(met, s["label"]), of(s, own)).otherwise(s)), F.array(of(r, own)))
        return once(met, lambda met: once(F.coalesce(F.array_min(met), F.size(state)), lambda own: all_(met, own))).cast(_RUNS)

    labelled = F.aggregate(raster_runs, F.array().cast(_RUNS), step)

    def box(rs: Column) -> Column:
        x, y = F.array_min(F.transform(rs, lambda s: s["a"])), F.array_min(F.transform(rs, lambda s: s["y"]))
        w, h = F.array_max(F.transform(rs, lambda s: s["b"])) - x, F.array_max(F.transform(rs, lambda s: s["y"])) - y + 1
        return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), F.aggregate(rs, F.lit(0), lambda n, s: n + s["b"] - s["a"]).alias("area"))

    boxes = lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda s: s["label"])), lambda label: box(F.filter(all_, lambda s: s["label"] == label)))
    return F.transform(F.array(labelled), boxes)[0]


def holes(raster: Column, width: int, inked, least: int = HOLE_PIXELS) -> Column:
    """How many background regions of at least ``least`` pixels do not reach the raster's edge."""
    height = F.floor(F.size(raster) / width)
    inner = lambda b: (b["x"] > 0) & (b["y"] > 0) & (b["x"] + b["w"] < width) & (b["y"] + b["h"] < height) & (b["area"] >= least)
    return F.size(F.filter(components(runs(raster, width, lambda v: ~inked(v))), inner))


def features(raster: Column, width: int, inked) -> Column:
    """A struct (holes, upper, lower): holes of a glyph's raster and the inked share of its halves."""
    n = F.size(raster)
    half = (F.floor(F.floor(n / width) / 2) * width).cast("int")
    share = lambda part: F.aggregate(part, F.lit(0.0), lambda s, v: s + inked(v).cast("double")) / F.greatest(F.size(part), F.lit(1))
    return F.struct(holes(raster, width, inked).alias("holes"), share(F.slice(raster, F.lit(1), half)).alias("upper"), share(F.slice(raster, half + 1, F.greatest(n - half, F.lit(0)))).alias("lower"))
