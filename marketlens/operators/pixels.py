"""Raster steps of the recognition layer as Arrow functions over binary image columns.

A raster is a struct (width, height, pixels: one byte per pixel, row by row, 0 is ink).  Each image is a bounded
unit; everything after tokens exist is DataFrame work (see recognition and grids).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from marketlens.operators.ranks import middles

# Template size, weights of the structural comparison.
GLYPH_W, GLYPH_H = 24, 32
HOLES, DENSITY, BALANCE, ASPECT = 0.4, 0.2, 0.2, 0.2

_RUN = ArrayType(StructType([StructField("a", IntegerType()), StructField("b", IntegerType())]))


def grey_of_bgr(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Luma of an image row as Spark's image source gives it (blue, green, red)."""
    p = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return np.rint(p[..., 0] if channels == 1 else 0.114 * p[..., 0] + 0.587 * p[..., 1] + 0.299 * p[..., 2]).astype(np.uint8)


def otsu_threshold(grey: np.ndarray) -> int:
    n = np.bincount(grey.ravel(), minlength=256).astype(np.float64)
    w, s = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        v = w * (w[-1] - w) * (s / w - (s[-1] - s) / (w[-1] - w)) ** 2
    return int(np.argmax(np.nan_to_num(v, nan=0.0, posinf=0.0)))


def binarize(grey: np.ndarray) -> np.ndarray:
    """True where there is ink, the darker class."""
    return grey <= otsu_threshold(grey)


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges of consecutive true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def without_rules(ink: np.ndarray, share: float = 0.9) -> np.ndarray:
    """Ink without the lines that span nearly the whole width or height."""
    out = ink.copy()
    out[ink.mean(axis=1) >= share, :] = False
    out[:, ink.mean(axis=0) >= share] = False
    return out


def row_bands(ink: np.ndarray) -> list[tuple[int, int]]:
    return runs(ink.any(axis=1))


def segments(ink: np.ndarray) -> list[tuple[int, int]]:
    return runs(ink.any(axis=0))


def fit(ink: np.ndarray, width: int = GLYPH_W, height: int = GLYPH_H, stretch: bool = False) -> np.ndarray:
    """The tight box of the ink as a grey raster of a fixed size, centred at its own shape or stretched."""
    ys, xs = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    out = np.zeros((height, width))
    if not len(ys):
        return out
    box = ink[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1].astype(np.float64)
    h, w = box.shape
    scale = min(height / h, width / w)
    th, tw = (height, width) if stretch else (max(1, round(h * scale)), max(1, round(w * scale)))
    y, x = (np.arange(th) + 0.5) * h / th - 0.5, (np.arange(tw) + 0.5) * w / tw - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, h - 1), np.clip(np.floor(x).astype(int), 0, w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    small = (box[y0][:, x0] * (1 - fx) + box[y0][:, x1] * fx) * (1 - fy) + (box[y1][:, x0] * (1 - fx) + box[y1][:, x1] * fx) * fy
    oy, ox = (height - th) // 2, (width - tw) // 2
    out[oy : oy + th, ox : ox + tw] = small
    return out


def labels(ink: np.ndarray) -> np.ndarray:
    """4-connected components, numbered by their smallest pixel index; 0 is background."""
    label = np.where(ink, np.arange(1, ink.size + 1).reshape(ink.shape), 0)
    while True:
        p = np.pad(np.where(ink, label, ink.size + 1), 1, constant_values=ink.size + 1)
        new = np.where(ink, np.minimum.reduce([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]), 0)
        if np.array_equal(new, label):
            return label
        label = new


def hole_count(ink: np.ndarray, least: int = 2) -> int:
    """Background regions of at least ``least`` pixels that do not touch the border."""
    frame = np.pad(~ink, 1, constant_values=True)
    label = labels(frame)
    ids, size = np.unique(label[label > 0], return_counts=True)
    return int(np.count_nonzero((size >= least) & (ids != label[0, 0])))


def features(ink: np.ndarray) -> dict[str, float]:
    ys, xs = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    half = ink.shape[0] // 2
    aspect = (xs[-1] - xs[0] + 1) / (ys[-1] - ys[0] + 1) if len(ys) else 0.0
    return {"density": float(ink.mean()), "upper": float(ink[:half].mean()), "lower": float(ink[half:].mean()), "aspect": float(aspect), "holes": hole_count(ink)}


def structural_score(a: dict[str, float], b: dict[str, float]) -> float:
    balance = abs((a["upper"] - a["lower"]) - (b["upper"] - b["lower"]))
    loss = HOLES * min(abs(a["holes"] - b["holes"]), 2) / 2 + DENSITY * abs(a["density"] - b["density"]) + BALANCE * min(balance, 1) + ASPECT * min(abs(a["aspect"] - b["aspect"]), 1)
    return max(0.0, 1 - loss)


def ncc(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a.ravel() - a.mean(), b.ravel() - b.mean()
    d = float(np.sqrt((a @ a) * (b @ b)))
    return 0.0 if d < 1e-10 else float(a @ b) / d


def shifted_ncc(a: np.ndarray, b: np.ndarray) -> float:
    """The best correlation over the overlap at no shift and one pixel each way."""
    h, w = a.shape
    best = -1.0
    for dy, dx in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)):
        ya, xa = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
        yb, xb = slice(max(0, dy), min(h, h + dy)), slice(max(0, dx), min(w, w + dx))
        best = max(best, ncc(a[ya, xa], b[yb, xb]))
    return best


def split_wide(parts: list[tuple[int, int]], pitch: float, ratio: float = 1.45) -> list[tuple[int, int]]:
    """Segments much wider than a glyph, cut evenly at the pitch."""
    out: list[tuple[int, int]] = []
    for a, b in parts:
        n = max(1, round((b - a) / pitch)) if b - a > ratio * pitch else 1
        edges = [round(a + (b - a) * i / n) for i in range(n + 1)]
        out += zip(edges[:-1], edges[1:])
    return out


def pitch_of(parts: list[tuple[int, int]]) -> float:
    """The upper median distance of successive starts among the closer ones."""
    steps = np.sort(np.diff([a for a, _ in parts]))
    if not len(steps):
        return float(parts[0][1] - parts[0][0]) if parts else 0.0
    near = steps[steps <= 1.5 * steps[0]]
    return float(near[len(near) // 2])


@F.pandas_udf(_RUN)
def row_band_column(image: pd.DataFrame) -> pd.Series:
    """Row bands (a, b) of each image struct (width, height, nChannels, data)."""
    return pd.Series([[{"a": a, "b": b} for a, b in row_bands(without_rules(binarize(grey_of_bgr(d, w, h, c))))] for w, h, c, d in zip(image["width"], image["height"], image["nChannels"], image["data"])])


@F.pandas_udf(ArrayType(DoubleType()))
def glyph_vector(image: pd.DataFrame) -> pd.Series:
    """The fitted grey raster of each image as one vector, for ranking against a template bank."""
    return pd.Series([fit(binarize(grey_of_bgr(d, w, h, c))).ravel().tolist() for w, h, c, d in zip(image["width"], image["height"], image["nChannels"], image["data"])])


def clipped_rows(bands: DataFrame) -> DataFrame:
    """Bands (grid, top, bottom, height) of grids with three or more that come within a pixel of an edge and differ from
    the upper median height by over 15 %."""
    h = F.col("bottom") - F.col("top")
    typical = middles(bands.withColumn("h", h), ["grid"], "h").where("n_values >= 3").select("grid", F.col("upper").alias("typical"))
    edge = (F.col("top") <= 1) | (F.col("bottom") >= F.col("height") - 1)
    return bands.join(typical, "grid", "left").withColumn("clipped", F.coalesce(edge & (F.abs(h - F.col("typical")) / F.col("typical") > 0.15), F.lit(False))).drop("typical")


def bands_in_range(bands: DataFrame, scale: float) -> DataFrame:
    """Bands (grid, top, bottom) with whether their height is one of a text row at this scale (5 to 30 pixels of source)."""
    return bands.withColumn("in_range", (F.col("bottom") - F.col("top")).between(5 * scale, 30 * scale))
