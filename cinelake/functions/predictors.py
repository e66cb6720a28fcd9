"""Predictors, scalers and scan orders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zigzag() -> list[int]:
    cells = sorted(
        ((r, c) for r in range(8) for c in range(8)),
        key=lambda rc: (rc[0] + rc[1], rc[0] if (rc[0] + rc[1]) % 2 else rc[1]),
    )
    return [r * 8 + c for r, c in cells]


# Scan orders: raster index (row*8 + column) per scan position. The zigzag follows a rule;
# the others are fixed values of the formats.
SCAN_ORDERS: dict[str, list[int]] = {
    "zigzag": _zigzag(),
    # fixed values
    "alternate_horizontal": [
        0, 1, 2, 3, 8, 9, 16, 17, 10, 11, 4, 5, 6, 7, 15, 14,
        13, 12, 19, 18, 24, 25, 32, 33, 26, 27, 20, 21, 22, 23, 28, 29,
        30, 31, 34, 35, 40, 41, 48, 49, 42, 43, 36, 37, 38, 39, 44, 45,
        46, 47, 50, 51, 56, 57, 58, 59, 52, 53, 54, 55, 60, 61, 62, 63,
    ],
    "alternate_vertical": [
        0, 8, 16, 24, 1, 9, 2, 10, 17, 25, 32, 40, 48, 56, 57, 49,
        41, 33, 26, 18, 3, 11, 4, 12, 19, 27, 34, 42, 50, 58, 35, 43,
        51, 59, 20, 28, 5, 13, 6, 14, 21, 29, 36, 44, 52, 60, 37, 45,
        53, 61, 22, 30, 7, 15, 23, 31, 38, 46, 54, 62, 39, 47, 55, 63,
    ],
    "wmv1_intra": [
        0, 8, 1, 2, 9, 16, 24, 17, 10, 3, 4, 11, 18, 25, 32, 40,
        33, 48, 26, 19, 12, 5, 6, 13, 20, 27, 34, 41, 56, 49, 57, 42,
        35, 28, 21, 14, 7, 15, 22, 29, 36, 43, 50, 58, 51, 59, 44, 37,
        30, 23, 31, 38, 45, 52, 60, 53, 61, 46, 39, 47, 54, 62, 55, 63,
    ],
    "wmv1_alternate_vertical": [
        0, 8, 16, 1, 24, 32, 40, 9, 2, 3, 10, 17, 25, 48, 56, 41,
        33, 26, 18, 11, 4, 5, 12, 19, 27, 34, 49, 57, 50, 42, 35, 28,
        20, 13, 6, 7, 14, 21, 29, 36, 43, 51, 58, 59, 52, 44, 37, 30,
        22, 15, 23, 31, 38, 45, 60, 53, 46, 39, 47, 54, 61, 62, 55, 63,
    ],
    "wmv1_alternate_horizontal": [
        0, 1, 8, 2, 3, 9, 16, 24, 17, 10, 4, 5, 11, 18, 25, 32,
        40, 48, 33, 26, 19, 12, 6, 7, 13, 20, 27, 34, 41, 56, 49, 57,
        42, 35, 28, 21, 14, 15, 22, 29, 36, 43, 50, 58, 51, 44, 37, 30,
        23, 31, 38, 45, 52, 59, 60, 53, 46, 39, 47, 54, 61, 62, 55, 63,
    ],
    "wmv1_inter": [
        0, 8, 1, 2, 9, 16, 24, 17, 10, 3, 4, 11, 18, 25, 32, 40,
        48, 56, 41, 33, 26, 19, 12, 5, 6, 13, 20, 27, 34, 49, 57, 58,
        50, 42, 35, 28, 21, 14, 7, 15, 22, 29, 36, 43, 51, 59, 60, 52,
        44, 37, 30, 23, 31, 38, 45, 53, 61, 62, 54, 46, 39, 47, 55, 63,
    ],
}


def dc_scaler(q: Column, component: str = "luma", family: str = "mpeg4") -> Column:
    """DC step for a quantiser: the MPEG-4 ladders, the WMV1 half-step ladder, or a constant 8."""
    if component not in ("luma", "chroma"):
        raise ValueError("component is 'luma' or 'chroma'")
    if family == "fixed8":
        return F.lit(8)
    if family == "wmv1":
        from_q = 4 if component == "luma" else 3
        return F.lit(8) + F.shiftright(F.greatest(q - from_q, F.lit(0)), 1)
    if family != "mpeg4":
        raise ValueError("family is 'mpeg4', 'wmv1' or 'fixed8'")
    if component == "luma":
        return F.when(q <= 4, 8).when(q <= 8, 2 * q).when(q <= 24, q + 8).otherwise(2 * q - 16)
    return F.when(q <= 4, 8).when(q <= 24, F.shiftright(q + 13, 1)).otherwise(q - 6)


def default_predictor(scaler: Column) -> Column:
    """Predictor of a block with no neighbours: mid grey (1024) in units of the scaler, rounded."""
    return F.floor((F.lit(2048) + scaler) / (2 * scaler)).cast("int")


def gradient_pred(left: Column, topleft: Column, top: Column, tie: str = "top") -> Column:
    """Follow the smaller gradient: STRUCT<pred, from_left>. ``tie`` decides equal gradients."""
    across, down = F.abs(left - topleft), F.abs(topleft - top)
    if tie == "top":
        from_left = across > down
    elif tie == "left":
        from_left = across >= down
    else:
        raise ValueError("tie is 'top' or 'left'")
    return F.struct(F.when(from_left, left).otherwise(top).alias("pred"), from_left.alias("from_left"))


def cbp_pred(left: Column, topleft: Column, top: Column) -> Column:
    """Coded-flag predictor; XOR it with the raw flag to get the coded flag."""
    return F.when(top != topleft, top).otherwise(left)


def coded_flag(raw: Column, left: Column, topleft: Column, top: Column) -> Column:
    return raw.bitwiseXOR(cbp_pred(left, topleft, top))


def median3(a: Column, b: Column, c: Column) -> Column:
    return a + b + c - F.greatest(a, b, c) - F.least(a, b, c)


def wrap_mv(v: Column) -> Column:
    """Bring a vector component back inside +-63 by adding or subtracting 64 once."""
    return F.when(v <= -64, v + 64).when(v >= 64, v - 64).otherwise(v)


def mv_pred(left: Column, top: Column, topright: Column, row: Column, rule: str = "median") -> Column:
    """Vector predictor: ``median`` of three (left alone in row 0), or ``left`` alone.

    A missing neighbour counts as 0.
    """
    left_or_0 = F.coalesce(left, F.lit(0))
    if rule == "left":
        return left_or_0
    if rule != "median":
        raise ValueError("rule is 'median' or 'left'")
    three = median3(left_or_0, F.coalesce(top, F.lit(0)), F.coalesce(topright, F.lit(0)))
    return F.when(row == 0, left_or_0).otherwise(three)


def reorder(arr: Column, order: list[int] | Column) -> Column:
    """``out[k] = arr[order[k]]`` with zero-based indices."""
    if isinstance(order, Column):
        return F.transform(order, lambda i: F.element_at(arr, i.cast("int") + 1))
    return F.array(*[F.get(arr, F.lit(i)) for i in order])
