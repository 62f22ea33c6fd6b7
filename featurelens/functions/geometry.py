"""Crop, letterbox, mask-block and token-grid arithmetic as Column expressions.

Rounding is half-even throughout (``rint``). A box is a struct (left, top, right,
bottom) with exclusive right and bottom; a null box stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _round(value) -> Column:
    return F.rint(value).cast("bigint")


def box(left, top, right, bottom) -> Column:
    named = zip(("left", "top", "right", "bottom"), (left, top, right, bottom))
    return F.struct(*[c.cast("bigint").alias(n) for n, c in named])


def add_margin(bounds: Column, margin: float, width: Column, height: Column) -> Column:
    """Grow a foreground box by a share of its size and clamp it to the frame."""
    mx = _round((bounds["right"] - bounds["left"]) * F.lit(margin))
    my = _round((bounds["bottom"] - bounds["top"]) * F.lit(margin))
    zero = F.lit(0).cast("bigint")
    grown = box(
        F.greatest(zero, bounds["left"] - mx),
        F.greatest(zero, bounds["top"] - my),
        F.least(width.cast("bigint"), bounds["right"] + mx),
        F.least(height.cast("bigint"), bounds["bottom"] + my),
    )
    return F.when(bounds.isNotNull(), grown)


def recrop(bounds: Column, scale: Column, width: Column, height: Column) -> Column:
    """Scale a box about its centre and clamp it to the frame."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    w = F.greatest(one, _round((bounds["right"] - bounds["left"]) * scale))
    h = F.greatest(one, _round((bounds["bottom"] - bounds["top"]) * scale))
    left = _round((bounds["left"] + bounds["right"]) / 2 - w / 2)
    top = _round((bounds["top"] + bounds["bottom"]) / 2 - h / 2)
    moved = box(
        F.greatest(zero, left),
        F.greatest(zero, top),
        F.least(width.cast("bigint"), left + w),
        F.least(height.cast("bigint"), top + h),
    )
    return F.when(bounds.isNotNull(), moved)


def letterbox(width: Column, height: Column, size: int, contain: bool = True) -> Column:
    """Output size and offsets of an image placed in a ``size`` x ``size`` canvas.

    ``contain`` keeps the aspect ratio: the longer side fills the canvas and the other
    is rounded (at least one pixel). Otherwise the image is squashed to the canvas.
    """
    full = F.lit(size).cast("bigint")
    if contain:
        out_w = F.when(width >= height, full).otherwise(_round(width / height * F.lit(size)))
        out_h = F.when(height >= width, full).otherwise(_round(height / width * F.lit(size)))
        out_w, out_h = F.greatest(out_w, F.lit(1)), F.greatest(out_h, F.lit(1))
    else:
        out_w, out_h = full, full
    return F.struct(
        out_w.alias("out_w"),
        out_h.alias("out_h"),
        F.floor((full - out_w) / 2).alias("off_x"),
        F.floor((full - out_h) / 2).alias("off_y"),
    )


def block_size(grid: int, scale: float, aspect: Column) -> Column:
    """Height and width in cells of a mask block of a target area and aspect ratio."""
    area = F.lit(float(max(1, round(grid * grid * scale))))
    side, one = F.lit(grid).cast("bigint"), F.lit(1).cast("bigint")
    return F.struct(
        F.least(side, F.greatest(one, _round(F.sqrt(area * aspect)))).alias("height"),
        F.least(side, F.greatest(one, _round(F.sqrt(area / aspect)))).alias("width"),
    )


def tube_tokens(cells: Column, steps: int, grid: int) -> Column:
    """Token numbers of spatial cells repeated over every time step."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(steps - 1)),
            lambda t: F.transform(cells, lambda c: t * F.lit(grid * grid) + c),
        )
    )


def token_coordinates(token: Column, grid: int) -> Column:
    """(time, row, column) of a row-major token number."""
    area = grid * grid
    return F.struct(
        F.floor(token / area).alias("t"),
        F.floor((token % area) / grid).alias("row"),
        (token % grid).alias("column"),
    )
