"""Queries of row shading: a supplier's shipments as an image (a scanline a month, a pixel a line, its level the quantity)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import shading
from marketlens.plans.catalogue import _table, query

#: Percentile of a histogram table: cumulative counts, then the least level at the rank.
_RANK = lambda p: f"greatest(1, floor(t * CAST({p} AS DOUBLE) + 0.5))"
_AT = lambda rank, name: f"min(level) FILTER (WHERE u >= {rank}) AS {name}"

_PIXELS = "X AS (SELECT l_suppkey grid, year(l_shipdate) * 12 + month(l_shipdate) y, CAST(l_quantity * 5 AS INT) AS level FROM lineitem)"
_BANDS = f"""{_PIXELS}, H AS (SELECT grid, y, level, count(*) n FROM X GROUP BY ALL),
U AS (SELECT *, sum(n) OVER (PARTITION BY grid, y ORDER BY level) u, sum(n) OVER (PARTITION BY grid, y) t FROM H),
S AS (SELECT grid, y, {_AT(_RANK(0.5), 'level')} FROM U GROUP BY 1, 2), G AS (SELECT grid, list(level ORDER BY level)[count(*) // 2 + 1] page_bg FROM S GROUP BY 1),
M AS (SELECT grid, y, page_bg, level <= page_bg - 12 AS dark FROM S JOIN G USING (grid)), R AS (SELECT grid, y, page_bg, y - row_number() OVER (PARTITION BY grid ORDER BY y) r FROM M WHERE dark),
B AS (SELECT grid, r, page_bg, min(y) y, count(*) height FROM R GROUP BY 1, 2, 3 HAVING count(*) >= 3),
PH AS (SELECT grid, level, sum(n) n FROM H JOIN M USING (grid, y) WHERE NOT dark GROUP BY 1, 2), PU AS (SELECT *, sum(n) OVER (PARTITION BY grid ORDER BY level) u, sum(n) OVER (PARTITION BY grid) t FROM PH),
P AS (SELECT grid, {_AT(_RANK(0.02), 'page_fg')} FROM PU GROUP BY 1),
BH AS (SELECT B.grid, r, level, sum(n) n FROM B JOIN H ON H.grid = B.grid AND H.y BETWEEN B.y AND B.y + height - 1 GROUP BY ALL), BU AS (SELECT *, sum(n) OVER (PARTITION BY grid, r ORDER BY level) u, sum(n) OVER (PARTITION BY grid, r) t FROM BH),
BL AS (SELECT grid, r, {_AT(_RANK(0.5), 'band_bg')}, {_AT(_RANK(0.02), 'dark')}, {_AT(_RANK(0.98), 'light')} FROM BU GROUP BY 1, 2),
F AS (SELECT *, light - band_bg > band_bg - dark AS inverted, CASE WHEN light - band_bg > band_bg - dark THEN light ELSE dark END AS band_fg FROM B JOIN BL USING (grid, r) JOIN P USING (grid) WHERE page_bg - page_fg >= 40),
A AS (SELECT grid, y, height, band_bg, band_fg, page_bg, page_fg, CAST(page_bg - page_fg AS DOUBLE) / abs(band_bg - band_fg) factor, inverted FROM F WHERE abs(band_bg - band_fg) >= 20)"""


def image(spark, sf_dir):
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grid"), month.alias("y"), (F.col("l_quantity") * 5).cast("int").alias("level"))


@query(
    f"""WITH {_PIXELS}, H AS (SELECT grid, level, count(*) n FROM X GROUP BY ALL), U AS (SELECT *, sum(n) OVER (PARTITION BY grid ORDER BY level) u, sum(n) OVER (PARTITION BY grid) t FROM H)
SELECT grid, CAST(max(t) AS BIGINT) n_all, {_AT(_RANK(0.02), 'dark')}, {_AT(_RANK(0.5), 'middle')}, {_AT(_RANK(0.98), 'light')} FROM U GROUP BY 1"""
)
def level_percentiles(spark, sf_dir):
    return shading.percentiles(shading.histogram(image(spark, sf_dir), ["grid"]), ["grid"], {"dark": 0.02, "middle": 0.5, "light": 0.98})


@query(f"WITH {_BANDS} SELECT * FROM A")
def shaded_bands(spark, sf_dir):
    return shading.shaded_bands(image(spark, sf_dir))


@query(
    f"""WITH {_BANDS}, L AS (SELECT X.grid, X.y, level, A.y IS NOT NULL AS banded, CASE WHEN A.y IS NULL THEN level ELSE greatest(0, least(255, floor(page_fg + CASE WHEN inverted THEN band_fg - level ELSE level - band_fg END * factor + 0.5))) END flat
 FROM X LEFT JOIN A ON A.grid = X.grid AND X.y BETWEEN A.y AND A.y + height - 1)
SELECT grid, y, count(*) n_pixels, CAST(sum(level) AS BIGINT) before, CAST(sum(flat) AS BIGINT) after, count(*) FILTER (WHERE level <> flat) changed FROM L GROUP BY 1, 2"""
)
def flattened_scanlines(spark, sf_dir):
    """All scanlines after their bands are brought to the page's levels."""
    pixels = image(spark, sf_dir)
    flat = shading.flattened(pixels, shading.shaded_bands(pixels))
    return flat.groupBy("grid", "y").agg(F.count("*").alias("n_pixels"), F.sum("level").alias("before"), F.sum("flat").alias("after"), F.count_if(F.col("level") != F.col("flat")).alias("changed"))
