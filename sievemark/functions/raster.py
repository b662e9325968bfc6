"""Pictures as flat arrays: gray values, resampling to another size, small affine changes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of red, green and blue in a gray value, in 65,536ths, rounded to whole values.
LUMA = (19595, 38470, 7471)
# A value this little below a half still rounds up, so that all engines agree on halves.
TIE = 1e-9


@lru_cache(maxsize=512)
def axis_weights(before: int, after: int) -> np.ndarray:
    """Share of each of ``before`` cells in each of ``after``: a triangle around the new cell's middle.

    The triangle reaches one old cell to each side when a picture grows and
    one new cell when it shrinks, so that no old cell is skipped; shares add up to 1.
    """
    step = before / after
    reach = max(step, 1.0)
    middle = (np.arange(after) + 0.5) * step
    shares = np.maximum(0.0, 1.0 - np.abs(np.arange(before) + 0.5 - middle[:, None]) / reach)
    return shares / shares.sum(axis=1, keepdims=True)


def whole(values: np.ndarray) -> np.ndarray:
    return np.floor(values + 0.5 + TIE)


def gray(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Gray values of pixels in rows, in blue-green-red order; a fourth channel, opacity, does not count."""
    cells = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(np.int64)
    if channels == 1:
        return cells[:, :, 0].astype(float)
    red, green, blue = LUMA
    return ((cells[:, :, 2] * red + cells[:, :, 1] * green + cells[:, :, 0] * blue + 32768) >> 16).astype(float)


def resampled(cells: np.ndarray, width: int, height: int) -> np.ndarray:
    """Whole values of a picture at another size: along its rows, then along its columns."""
    return whole(axis_weights(cells.shape[0], height) @ whole(cells @ axis_weights(cells.shape[1], width).T))


def gray_features(width: Column, height: Column, channels: Column, pixels: Column, to_width: int, to_height: int) -> Column:
    """Gray intensities, row by row, at the model's size; NULL where the bytes are not those of such a picture.

    Two matrix products a picture, in Arrow batches; weights are made once per size.
    """

    @F.pandas_udf("array<double>")
    def features(width: pd.Series, height: pd.Series, channels: pd.Series, pixels: pd.Series) -> pd.Series:
        out = []
        for w, h, c, data in zip(width, height, channels, pixels, strict=True):
            known = not pd.isna(w) and not pd.isna(h) and c in (1, 3, 4) and data is not None
            if known and w > 0 and h > 0 and len(data) == w * h * c:
                out.append(resampled(gray(data, int(w), int(h), int(c)), to_width, to_height).ravel())
            else:
                out.append(None)
        return pd.Series(out, dtype=object)

    return features(width, height, channels, pixels)


def side_of(vec: Column) -> Column:
    """The side of a square picture; NULL for a vector of another length."""
    side = F.round(F.sqrt(F.size(vec))).cast("int")
    return F.when(side * side == F.size(vec), side)


def affine(vec: Column, width: Column, scale_x: Column, scale_y: Column, shift_x: Column, shift_y: Column, degrees: Column) -> Column:
    """The picture stretched about its middle by two factors, turned by ``degrees`` and shifted by cells, as one array expression.

    Each new cell looks up the place it comes from, by the inverse of the
    change, and takes the four cells around that place by nearness; cells
    beyond the edge count as 0. Unchanged parameters give the input.
    """
    height = F.floor(F.size(vec) / width).cast("int")
    turn = F.radians(degrees)

    def at(place: Column) -> Column:
        row, column = F.floor(place / width), place % width
        x = column - (width - 1) / 2.0 - shift_x
        y = row - (height - 1) / 2.0 - shift_y
        from_x = (x * F.cos(turn) + y * F.sin(turn)) / scale_x + (width - 1) / 2.0
        from_y = (y * F.cos(turn) - x * F.sin(turn)) / scale_y + (height - 1) / 2.0
        return F.struct(from_x.alias("x"), from_y.alias("y"))

    def cell(column: Column, row: Column) -> Column:
        inside = column.between(0, width - 1) & row.between(0, height - 1)
        return F.when(inside, F.get(vec, (row * width + column).cast("int"))).otherwise(0.0)

    def value(origin: Column) -> Column:
        left, top = F.floor(origin["x"]), F.floor(origin["y"])
        right_share, low_share = origin["x"] - left, origin["y"] - top
        upper = cell(left, top) * (1.0 - right_share) + cell(left + 1, top) * right_share
        lower = cell(left, top + 1) * (1.0 - right_share) + cell(left + 1, top + 1) * right_share
        return upper * (1.0 - low_share) + lower * low_share

    places = F.transform(F.sequence(F.lit(0), F.size(vec) - 1), at)
    return F.when(F.size(vec) > 0, F.transform(places, value)).otherwise(vec)
