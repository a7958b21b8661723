"""Neighbourhood operators.

All pack scan lines into bytes and run on bands of lines with a halo (``lines.banded``).
About one row a line is shuffled, whatever the number of taps or kernels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.kernels import Kernel
from ..layout import as_pixels, require
from .lines import banded

WEIGHT_LIMIT = (1 << 20) // 255  # weights times 255 stay below 2^20


def convolve_band(
    view: np.ndarray, top: int, rows: int, kernels: list[Kernel], radius: int
) -> np.ndarray:
    """Kernels x rows x columns x channels: weighted sums, div, bias, clamped."""
    cols = view.shape[1]
    wide = np.pad(view.astype(np.int32), ((radius, radius), (radius, radius), (0, 0)))
    out = np.empty((len(kernels), rows, cols, view.shape[2]), dtype=np.uint8)
    for n, kernel in enumerate(kernels):
        total = np.zeros((rows, cols, view.shape[2]), dtype=np.int32)
        for dy, dx, w in kernel.taps():
            y, x = top + radius + dy, radius + dx
            total += w * wide[y : y + rows, x : x + cols]
        # division truncates toward zero
        share = np.abs(total) // abs(kernel.divisor)
        if (total < 0).any() or kernel.divisor < 0:
            share *= np.sign(total) * np.sign(kernel.divisor)
        out[n] = np.clip(share + kernel.bias, 0, 255)
    return out


def convolve(df: DataFrame, kernel: Kernel, region: Column | None = None) -> DataFrame:
    """Integer convolution; taps outside the image are skipped, alpha is kept."""
    return convolve_each(df, [kernel], region).drop("kernel")


def convolve_each(
    df: DataFrame, kernels: list[Kernel], region: Column | None = None, rows: int | None = None
) -> DataFrame:
    """Several kernels in one pass over the bands; adds ``kernel``."""
    for kernel in kernels:
        require(kernel.divisor != 0, f"the divisor of {kernel.name} is zero")
        total = sum(abs(w) for _, _, w in kernel.taps())
        require(total <= WEIGHT_LIMIT, f"weights of {kernel.name} are too large")
    radius = max([max(abs(dy), abs(dx)) for k in kernels for dy, dx, _ in k.taps()], default=0)

    def run(view, top, rows):
        return convolve_band(view, top, rows, kernels, radius)

    names = [k.name for k in kernels]
    new = banded(df, radius, run, rows, names)
    if region is None:
        return new
    outside = as_pixels(df.where(~region)).withColumn("kernel", F.explode(F.lit(names)))
    return new.where(region).unionByName(outside)


def blur_band(view: np.ndarray, top: int, rows: int, radius: int) -> np.ndarray:
    """Average of a square: sums along the lines, then sums of those along the columns."""
    side = 2 * radius + 1
    near = view[max(0, top - radius) : top + rows + radius].astype(np.int32)
    missing = (max(0, radius - top), max(0, top + rows + radius - len(view)))
    wide = np.pad(near, (missing, (radius, radius), (0, 0)))
    line = sum(wide[:, i : i + view.shape[1]] for i in range(side))
    return (sum(line[i : i + rows] for i in range(side)) // (side * side)).astype(np.uint8)


def moving_sum(values: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """For every row the sum of the rows up to radius before and after it in its group."""
    out = values.copy()
    for step in range(1, radius + 1):
        near = (group[step:] == group[:-step])[:, None]
        out[step:] += near * values[:-step]
        out[:-step] += near * values[step:]
    return out


def blur_rows(y: np.ndarray, x: np.ndarray, data: np.ndarray, radius: int) -> np.ndarray:
    """``blur_band`` where pixels are missing or repeated: neighbours are those next in order."""
    values, order = data.astype(np.int64), np.lexsort((x, y))
    line = moving_sum(values[order], y[order], radius)
    column = np.lexsort((y[order], x[order]))
    total = np.empty_like(line)
    total[order[column]] = moving_sum(line[column], x[order][column], radius)
    return (total // (2 * radius + 1) ** 2).clip(0, 255).astype(np.uint8)


def box_blur_separable(df: DataFrame, radius: int) -> DataFrame:
    """Average kernel of side 2 * radius + 1 as two one-dimensional sums."""
    require(1 <= radius <= 3, "average kernels have radius 1..3")

    def run(view, top, rows):
        return blur_band(view, top, rows, radius)

    def uneven(y, x, data):
        return blur_rows(y, x, data, radius)

    return banded(df, radius, run, uneven=uneven)


def isolated_band(view: np.ndarray, top: int, rows: int) -> np.ndarray:
    """The colour of eight equal neighbours, else the pixel's own."""
    cols = view.shape[1]
    code = view.astype(np.int32) @ np.array([65536, 256, 1], np.int32)
    wide = np.pad(code, 1, constant_values=-1)
    around = [
        wide[top + dy : top + dy + rows, dx : dx + cols]
        for dy in range(3)
        for dx in range(3)
        if (dy, dx) != (1, 1)
    ]
    lone = around[0] >= 0
    for other in around[1:]:
        lone &= other == around[0]
    new = np.where(lone, around[0], code[top : top + rows])
    return np.stack([new >> 16, new >> 8 & 255, new & 255], axis=-1)


def remove_isolated(df: DataFrame, region: Column | None = None) -> DataFrame:
    """Replace a pixel whose eight neighbours share one colour by that colour."""
    return _within(df, banded(df, 1, isolated_band, separate=False), region)


class ColumnHistograms:
    """For every column, how many of its pixels inside the window's lines are at most a level.

    The window moves down a line at a time: the line that enters is counted in its
    columns and the one that leaves is taken out. Sums over neighbouring columns then
    come from one running sum along the line, so a pixel costs the same at any radius.
    Counts are taken modulo 2^16: a window has fewer than 2^16 pixels.
    """

    def __init__(self, plane: np.ndarray, radius: int):
        self.levels, self.plane = np.unique(plane, return_inverse=True)
        self.plane = self.plane.reshape(plane.shape)
        self.radius, self.low, self.high = radius, 0, 0
        self.grid = np.arange(len(self.levels))
        self.columns = np.zeros((plane.shape[1], len(self.levels)), np.uint16)
        self.sums = np.zeros((plane.shape[1] + 1, len(self.levels)), np.uint16)

    def move(self, y: int) -> np.ndarray:
        """Running sums over the columns for the window around line y, clipped to the view."""
        while self.high < min(len(self.plane), y + self.radius + 1):
            self.columns += self.grid >= self.plane[self.high][:, None]
            self.high += 1
        while self.low < y - self.radius:
            self.columns -= self.grid >= self.plane[self.low][:, None]
            self.low += 1
        np.cumsum(self.columns, axis=0, dtype=np.uint16, out=self.sums[1:])
        return self.sums


def median_band(view: np.ndarray, top: int, rows: int, radius: int) -> np.ndarray:
    """Median per channel; beyond the image its edge pixels repeat."""
    above, below = radius - min(radius, top), radius - min(radius, len(view) - top - rows)
    wide = np.pad(view, ((above, below), (radius, radius), (0, 0)), mode="edge")
    side, first = 2 * radius + 1, top + above
    middle = side * side // 2
    if radius <= 2:
        near = wide[first - radius : first + rows + radius]
        patches = np.lib.stride_tricks.sliding_window_view(near, (side, side), axis=(0, 1))
        flat = patches.reshape(rows, view.shape[1], view.shape[2], side * side)
        return np.partition(flat, middle, axis=3)[..., middle]
    out = np.empty((rows, *view.shape[1:]), np.uint8)
    for channel in range(view.shape[2]):
        moving = ColumnHistograms(wide[first - radius : first + rows + radius, :, channel], radius)
        for y in range(rows):
            sums = moving.move(y + radius)
            upto = sums[side:] - sums[:-side]
            out[y, :, channel] = moving.levels[(upto <= middle).sum(axis=1)]
    return out


def median(
    df: DataFrame, radius: int, region: Column | None = None, rows: int | None = None
) -> DataFrame:
    """Median of the (2R+1)^2 neighbourhood per channel, R in 1..5; alpha kept."""
    require(1 <= radius <= 5, "median radius lies in 1..5")

    def run(view, top, rows):
        return median_band(view, top, rows, radius)

    return _within(df, banded(df, radius, run, rows), region)


def local_equalise_band(view: np.ndarray, top: int, rows: int, radius: int) -> np.ndarray:
    """255 * (neighbours <= v) div (neighbours), window clipped to the image."""
    cols = view.shape[1]
    x, y = np.arange(cols), np.arange(top, top + rows)
    x_lo, x_hi = np.maximum(0, x - radius), np.minimum(cols, x + radius + 1)
    tall = np.minimum(len(view), y + radius + 1) - np.maximum(0, y - radius)
    out = np.empty((rows, cols, view.shape[2]), np.uint8)
    for channel in range(view.shape[2]):
        near = max(0, top - radius)
        moving = ColumnHistograms(view[near : top + rows + radius, :, channel], radius)
        for i in range(rows):
            sums = moving.move(top - near + i)
            v = moving.plane[top - near + i]
            below = (sums[x_hi, v] - sums[x_lo, v]).astype(np.int32)
            out[i, :, channel] = below * 255 // (tall[i] * (x_hi - x_lo))
    return out


def hist_eq_local(
    df: DataFrame, radius: int, region: Column | None = None, rows: int | None = None
) -> DataFrame:
    """Local histogram equalisation in a (2R+1)^2 window, R in 1..64."""
    require(1 <= radius <= 64, "local radius lies in 1..64")

    def run(view, top, rows):
        return local_equalise_band(view, top, rows, radius)

    return _within(df, banded(df, radius, run, rows), region)


def _within(df: DataFrame, new: DataFrame, region: Column | None) -> DataFrame:
    """Results inside the region, source pixels elsewhere."""
    if region is None:
        return new
    return new.where(region).unionByName(as_pixels(df.where(~region)))
