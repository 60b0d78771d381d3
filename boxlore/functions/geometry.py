"""Boxes as columns: ``ARRAY<DOUBLE>`` of x1, y1, x2, y2, normalized to the unit square. Invalid boxes are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .binding import let

#: An annotator's box must be wider and taller than this.
LEAST_EXTENT = 1e-6


def box(x1, y1, x2, y2) -> Column:
    return F.array(*(F.lit(v).cast("double") if not isinstance(v, Column) else v.cast("double") for v in (x1, y1, x2, y2)))


def at(b: Column, k: int) -> Column:
    """Coordinate k; null where the box is shorter."""
    return F.get(b, k)


def round6(x: Column) -> Column:
    """To six decimals, by way of twelve: exact on both Spark and other engines, and stays in generated code."""
    return x.cast("decimal(20,12)").cast("decimal(20,6)").cast("double")


@F.udf(DoubleType(), useArrow=True)
def round6_exact(x):
    """To six decimals as Python rounds: the exact binary value, ties to even. The one place where Python is needed."""
    return None if x is None else round(x, 6)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def valid_box(b: Column, normalized: bool = True) -> Column:
    """The box if it has four finite ordered coordinates (within [0, 1] if ``normalized``), else null."""
    bad = F.exists(b, lambda x: ~_finite(x) | ((x < 0) | (x > 1) if normalized else F.lit(False)))
    return F.when((F.size(b) == 4) & ~bad & (at(b, 0) < at(b, 2)) & (at(b, 1) < at(b, 3)), b)


def pixel_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, clip: bool = True, exact: bool = False) -> Column:
    """Pixel corner and extent to a normalized box, clipped to the image and rounded; null if nothing is left."""
    rounded = round6_exact if exact else round6
    edge = lambda v, size: rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / size)) if clip else v / size)
    usable = _finite(x) & _finite(y) & _finite(w) & _finite(h) & (width > 0) & (height > 0)
    edges = F.array(edge(x, width), edge(y, height), edge(x + w, width), edge(y + h, height))
    return F.when(usable, valid_box(edges) if exact else let(edges, valid_box))  # a Python function has no place in a lambda


def strict_pixel_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """As ``pixel_box`` without clipping or rounding: null unless the extent is positive and within the image."""
    inside = (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= width) & (y + h <= height) & (width > 0) & (height > 0)
    return F.when(inside, F.array(x / width, y / height, (x + w) / width, (y + h) / height))


def annotator_box(b: Column, exact: bool = False) -> Column:
    """(box, reason): clipped to the unit square and rounded; a box of no extent or with a bad coordinate has a reason instead."""
    rounded = round6_exact if exact else round6
    clipped = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), at(b, k))) for k in range(4)]
    reason = (
        F.when(b.isNull() | (F.size(b) != 4), "a box has four coordinates")
        .when(F.exists(b, lambda x: ~_finite(x)), "a coordinate is not finite")
        .when((clipped[2] - clipped[0] <= LEAST_EXTENT) | (clipped[3] - clipped[1] <= LEAST_EXTENT), "a box needs an extent")
    )
    return F.struct(F.when(reason.isNull(), F.array(*map(rounded, clipped))).alias("box"), reason.alias("reason"))


def quantize(b: Column) -> Column:
    """Integers of 0 to 1000, ties to even; a box never loses its extent. Null for an invalid box."""
    return let(valid_box(b), _quantized)


def _quantized(ok: Column) -> Column:
    q = lambda k: F.bround(at(ok, k) * 1000).cast("int")
    x1, y1 = F.least(F.lit(999), q(0)), F.least(F.lit(999), q(1))
    return F.when(ok.isNotNull(), F.array(x1, y1, F.greatest(x1 + 1, q(2)), F.greatest(y1 + 1, q(3))))


def area(b: Column) -> Column:
    return (at(b, 2) - at(b, 0)) * (at(b, 3) - at(b, 1))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes that are known to be valid."""
    w = F.greatest(F.lit(0.0), F.least(at(a, 2), at(b, 2)) - F.greatest(at(a, 0), at(b, 0)))
    h = F.greatest(F.lit(0.0), F.least(at(a, 3), at(b, 3)) - F.greatest(at(a, 1), at(b, 1)))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where either box is invalid."""
    return F.when(valid_box(a).isNotNull() & valid_box(b).isNotNull(), overlap(a, b)).otherwise(0.0)


def is_hit(score: Column, threshold: float = 0.5) -> Column:
    return score >= threshold


def mirror_box(b: Column, exact: bool = False) -> Column:
    """The box in the horizontally mirrored image."""
    rounded = round6_exact if exact else round6
    return F.when(b.isNotNull(), F.array(rounded(1 - at(b, 2)), at(b, 1), rounded(1 - at(b, 0)), at(b, 3)))


def dragged_box(ax: Column, ay: Column, bx: Column, by: Column, width: Column, height: Column) -> Column:
    """Two pixel corners in any order to a normalized box within the image."""
    clip = lambda v, size: F.greatest(F.lit(0.0), F.least(size.cast("double"), v))
    x1, x2 = clip(F.least(ax, bx), width), clip(F.greatest(ax, bx), width)
    y1, y2 = clip(F.least(ay, by), height), clip(F.greatest(ay, by), height)
    return F.array(round6(x1 / width), round6(y1 / height), round6(x2 / width), round6(y2 / height))


def to_pixels(b: Column, width: Column, height: Column) -> Column:
    """(x, y, w, h) in pixels."""
    return F.struct((at(b, 0) * width).alias("x"), (at(b, 1) * height).alias("y"), ((at(b, 2) - at(b, 0)) * width).alias("w"), ((at(b, 3) - at(b, 1)) * height).alias("h"))


def screen_to_image(x: Column, y: Column, scale: Column, left: Column, top: Column) -> Column:
    """A point on screen to image pixels, given the image's scale and where its corner is drawn; ``image_to_screen`` turns it back."""
    return F.struct(((x - left) / scale).alias("x"), ((y - top) / scale).alias("y"))


def image_to_screen(x: Column, y: Column, scale: Column, left: Column, top: Column) -> Column:
    return F.struct((x * scale + left).alias("x"), (y * scale + top).alias("y"))


def stand_in_box(text: Column) -> Column:
    """A box that depends on the text alone, from the first bytes of its SHA-256: runs the whole path without a model."""
    digest = F.sha2(text, 256)
    part = lambda k: F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("double") / 255.0
    x1, y1 = F.lit(0.05) + part(0) * 0.40, F.lit(0.05) + part(1) * 0.40
    x2, y2 = x1 + 0.15 + part(2) * 0.25, y1 + 0.15 + part(3) * 0.25
    return F.array(*(F.bround(v, 6) for v in (x1, y1, F.least(x2, F.lit(1.0)), F.least(y2, F.lit(1.0)))))
