"""Row shading of grey images: scanline levels, shaded bands, and their pixels brought to the page's levels.

An image is a set of pixels as rows (grid, y, level, ...; a level is 0 to 255, and further columns are kept).  Every
figure is taken from a histogram, which tasks count before anything is shuffled; a histogram has at most 256 rows, so
its window is bounded whatever the size of the image, and a page's scanlines are at most as many as the image is high.
Pixels of null grid, y or level belong to no histogram and stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Shares of a scanline and of glyphs, how much darker a shaded scanline is, the least height of a band at
# scale 1, and the least contrasts of a band and of the page.
LEVEL_SHARE, GLYPH_SHARE, LEAST_DELTA, LEAST_HEIGHT, LEAST_CONTRAST, LEAST_PAGE_CONTRAST = 0.5, 0.02, 12, 3, 20, 40

_MID, _DARK, _LIGHT = LEVEL_SHARE, GLYPH_SHARE, 1 - GLYPH_SHARE


def histogram(pixels: DataFrame, by: list[str], level: str = "level") -> DataFrame:
    """(by..., level, n)."""
    return pixels.groupBy(*by, F.col(level).alias("level")).agg(F.count("*").alias("n"))


def at_ranks(hist: DataFrame, by: list[str], ranks: dict[str, Column]) -> DataFrame:
    """(by..., n_all, one column for each of ``ranks``): the level at a rank (from 1, an expression of n_all)."""
    run = hist.withColumn("upto", F.sum("n").over(W.partitionBy(*by).orderBy("level").rowsBetween(W.unboundedPreceding, 0)))
    run = run.withColumn("n_all", F.sum("n").over(W.partitionBy(*by)))
    return run.groupBy(*by).agg(F.first("n_all").alias("n_all"), *[F.min(F.when(F.col("upto") >= r, F.col("level"))).alias(name) for name, r in ranks.items()])


def nearest_rank(share: float) -> Column:
    """The nearest rank of a share of ``n_all`` values: halves go up, and the least rank is 1."""
    return F.greatest(F.lit(1), F.floor(F.col("n_all") * F.lit(float(share)) + 0.5))


def percentiles(hist: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by..., n_all, one column for each of ``shares``): nearest-rank percentiles of each group's histogram."""
    return at_ranks(hist, by, {name: nearest_rank(p) for name, p in shares.items()})


def shaded_bands(pixels: DataFrame, scale: float = 1.0) -> DataFrame:
    """(grid, y, height, band_bg, band_fg, page_bg, page_fg, factor, inverted): bands of shaded scanlines worth rescaling.

    A scanline is shaded if its median level is darker than the median of all scanlines by ``LEAST_DELTA``; scanlines
    that follow each other are a band.  Thin bands, bands without text and pages of little contrast are left out.  A
    page of mostly shaded rows has none.  ``scale`` is the pixels of the image for one of its source.
    """
    seen = pixels.select("grid", "y", "level").where("grid is not null and y is not null and level is not null")
    lines = histogram(seen, ["grid", "y"])
    level = percentiles(lines, ["grid", "y"], {"level": _MID}).select("grid", "y", "level")
    page = at_ranks(histogram(level, ["grid"]), ["grid"], {"page_bg": F.floor(F.col("n_all") / 2) + 1}).select("grid", "page_bg")
    marked = level.join(page, "grid").select("grid", "y", "page_bg", (F.col("level") <= F.col("page_bg") - LEAST_DELTA).alias("shaded"))
    dark = marked.where("shaded")
    order = W.partitionBy("grid").orderBy("y")  # scanlines of a page
    run = dark.withColumn("run", F.col("y") - F.row_number().over(order))
    span = run.groupBy("grid", "run", "page_bg").agg(F.min("y").alias("top"), F.count("*").alias("height")).where(F.col("height") >= LEAST_HEIGHT * scale)
    ink = lines.join(marked.where("not shaded").select("grid", "y"), ["grid", "y"]).groupBy("grid", "level").agg(F.sum("n").alias("n"))
    ink = percentiles(ink, ["grid"], {"page_fg": _DARK}).select("grid", "page_fg")
    inside = lines.join(run.join(span.select("grid", "run"), ["grid", "run"]).select("grid", "y", "run"), ["grid", "y"]).groupBy("grid", "run", "level").agg(F.sum("n").alias("n"))
    inside = percentiles(inside, ["grid", "run"], {"band_bg": 0.5, "dark": _DARK, "light": _LIGHT})
    found = span.join(inside, ["grid", "run"]).join(ink, "grid").where(F.col("page_bg") - F.col("page_fg") >= LEAST_PAGE_CONTRAST)
    inverted = F.col("light") - F.col("band_bg") > F.col("band_bg") - F.col("dark")
    found = found.withColumn("inverted", inverted).withColumn("band_fg", F.when(inverted, F.col("light")).otherwise(F.col("dark")))
    contrast = F.abs(F.col("band_bg") - F.col("band_fg"))
    return found.where(contrast >= LEAST_CONTRAST).select("grid", F.col("top").alias("y"), "height", "band_bg", "band_fg", "page_bg", "page_fg", ((F.col("page_bg") - F.col("page_fg")) / contrast).alias("factor"), "inverted")


def flattened(pixels: DataFrame, bands: DataFrame) -> DataFrame:
    """``pixels`` with ``flat``: levels inside a band rescaled so that its fill and its glyphs have the page's levels."""
    of = bands.select("grid", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("height") - 1)).alias("y"), F.struct("band_fg", "page_fg", "factor", "inverted").alias("_band"))
    b = F.col("_band")
    apart = F.when(b["inverted"], b["band_fg"] - F.col("level")).otherwise(F.col("level") - b["band_fg"])
    new = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(b["page_fg"] + apart * b["factor"] + 0.5)))
    return pixels.join(of, ["grid", "y"], "left").withColumn("flat", F.when(b.isNull(), F.col("level")).otherwise(new).cast("int")).drop("_band")


def upscaled(pixels: DataFrame, factor: int) -> DataFrame:
    """Pixels (grid, y, x, ...) each turned into a square of ``factor`` by ``factor`` equal ones."""
    step = F.sequence(F.lit(0), F.lit(factor - 1))
    return pixels.withColumn("_dy", F.explode(step)).withColumn("_dx", F.explode(step)).withColumns({"y": F.col("y") * factor + F.col("_dy"), "x": F.col("x") * factor + F.col("_dx")}).drop("_dy", "_dx")


def cropped(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels (grid, y, x, ...) inside a box of their grid (grid, box, top, bottom, left, right; half-open), from its corner."""
    inside = (F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom")) & (F.col("x") >= F.col("left")) & (F.col("x") < F.col("right"))
    return pixels.join(boxes, "grid").where(inside).withColumns({"y": F.col("y") - F.col("top"), "x": F.col("x") - F.col("left")}).drop("top", "bottom", "left", "right")
