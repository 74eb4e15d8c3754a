"""Box, crop and position arithmetic as Column expressions.

Rounding is half to even (``rint``) unless a name says truncation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def half(x: Column) -> Column:
    return F.rint(x).cast("int")


def short_side(width: Column, height: Column) -> Column:
    """The shorter side; null where either is missing or not positive."""
    return F.when((width > 0) & (height > 0), F.least(width, height))


def target_size(width: Column, height: Column, cap: int, floor: int) -> tuple[Column, Column]:
    """(width, height) to store: the long side at most cap, unless the short one would fall under floor.

    Null means that the bytes are copied as they are.
    """
    long, short = F.greatest(width, height), F.least(width, height)
    scale = F.lit(float(cap)) / long
    scale = F.when(short * scale < floor, F.lit(float(floor)) / short).otherwise(scale)
    resized = (long > cap) & (scale < 1)
    return tuple(F.when(resized, F.greatest(F.lit(1), half(side * scale))) for side in (width, height))  # type: ignore[return-value]


def clip_box(x: Column, y: Column, w: Column, h: Column, fw: Column, fh: Column, least: int = 2) -> Column:
    """struct(x0, y0, x1, y1) of the rounded box inside the frame; null if a side is under least."""
    rx, ry, rw, rh = half(x), half(y), half(w), half(h)
    x0, y0 = F.greatest(F.lit(0), rx), F.greatest(F.lit(0), ry)
    x1, y1 = F.least(fw, rx + rw), F.least(fh, ry + rh)
    return F.when((x1 - x0 >= least) & (y1 - y0 >= least), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def clamp_box(x: Column, y: Column, w: Column, h: Column, fw: Column, fh: Column) -> Column:
    """struct(x, y, w, h, clamped) with truncated numbers inside the frame."""
    ix, iy, iw, ih = (c.cast("int") for c in (x, y, w, h))
    cx, cy = F.least(F.greatest(ix, F.lit(0)), fw), F.least(F.greatest(iy, F.lit(0)), fh)
    cw, ch = F.greatest(F.lit(0), F.least(ix + iw, fw) - cx), F.greatest(F.lit(0), F.least(iy + ih, fh) - cy)
    moved = (cx != ix) | (cy != iy) | (cw != iw) | (ch != ih)
    return F.struct(cx.alias("x"), cy.alias("y"), cw.alias("w"), ch.alias("h"), moved.alias("clamped"))


def square_for(x: Column, y: Column, w: Column, h: Column, fw: Column, fh: Column, margin: float) -> Column:
    """struct(side, sx, sy, tier, shifted, pad_fraction): the square crop of a box.

    The side is the longer one with its margin where the frame has room for it,
    else as much as the frame allows (margin_reduced); a box longer than the
    frame's short side is padded.  The square is centred on the box and shifted
    into the frame.
    """
    longest, short_frame = F.greatest(w, h), F.least(fw, fh)
    wished = half(longest * (1 + margin))
    tier = F.when(wished <= short_frame, "fits").when(longest <= short_frame, "margin_reduced").otherwise("padded")
    side = F.when(wished <= short_frame, wished).when(longest <= short_frame, short_frame.cast("int")).otherwise(half(longest))
    ideal_x, ideal_y = half(x + w / 2 - side / 2), half(y + h / 2 - side / 2)
    sx = F.when(side <= fw, F.least(F.greatest(ideal_x, F.lit(0)), fw - side)).otherwise(ideal_x)
    sy = F.when(side <= fh, F.least(F.greatest(ideal_y, F.lit(0)), fh - side)).otherwise(ideal_y)
    inside_w = F.least(fw, sx + side) - F.greatest(F.lit(0), sx)
    inside_h = F.least(fh, sy + side) - F.greatest(F.lit(0), sy)
    pad = 1 - (inside_w * inside_h).cast("double") / (side * side)
    return F.struct(side.cast("int").alias("side"), sx.cast("int").alias("sx"), sy.cast("int").alias("sy"), tier.alias("tier"), ((sx != ideal_x) | (sy != ideal_y)).alias("shifted"), F.round(pad, 6).alias("pad_fraction"))


def overlap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Area shared by two boxes (x, y, w, h)."""
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union; 0 for boxes without area."""
    shared = overlap(a, b).cast("double")
    union = a[2] * a[3] + b[2] * b[3] - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def touches(a: Sequence[Column], b: Sequence[Column], margin: float = 0) -> Column:
    """True if the boxes overlap when b is widened by margin on every side (strictly)."""
    return (a[0] < b[0] + b[2] + margin) & (b[0] - margin < a[0] + a[2]) & (a[1] < b[1] + b[3] + margin) & (b[1] - margin < a[1] + a[3])


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def valid_position(lat: Column, lon: Column) -> Column:
    """In range and not the (0, 0) placeholder."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def patch_grid(width: Column, height: Column, patch: int, budget: int, steps: int = 30) -> Column:
    """struct(w, h): largest size of whole patches with the aspect ratio kept and at most budget patches.

    The scale is bisected on a fixed number of steps inside one fold.
    """

    def side(length: Column, scale: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(length * scale / patch - 1e-9).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        fits = side(width, mid) * side(height, mid) <= budget
        return F.struct(F.when(fits, mid).otherwise(s["lo"]).alias("lo"), F.when(fits, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(1e-6).alias("lo"), F.lit(100.0).alias("hi")), halve)["lo"]
    return F.struct((side(width, found) * patch).alias("w"), (side(height, found) * patch).alias("h"))


def square_profile(w: Column, h: Column, fw: Column, fh: Column, margin: float) -> Column:
    """struct(tier, side, pad_fraction) of the older profile: the padded share is 1 - (short side / side) squared.

    Not that of ``square_for``: a padded square keeps its margin, and its share
    does not depend on where the box lies.
    """
    longest, short = F.greatest(w, h), F.least(fw, fh)
    wished = half(longest * (1 + margin))
    padded = longest > short
    pad = F.when(padded & (wished > 0), F.greatest(F.lit(0.0), 1 - (short * short).cast("double") / (wished * wished))).otherwise(0.0)
    tier = F.when(padded, "padded").when(wished > short, "margin_reduced").otherwise("fits")
    return F.struct(tier.alias("tier"), F.when(padded, wished).otherwise(F.least(wished, short)).cast("int").alias("side"), F.round(pad, 6).alias("pad_fraction"))


def inside_square(x: Column, y: Column, w: Column, h: Column, square: Column) -> Column:
    """struct(x, y, w, h) of a box in the coordinates of its square (side, sx, sy)."""
    return F.struct((x - square["sx"]).alias("x"), (y - square["sy"]).alias("y"), w.alias("w"), h.alias("h"))


def input_size(w: Column, h: Column, geometry: str) -> Column:
    """struct(w, h, dx, dy): the canvas that an image is put on; letterbox is square with the image in its middle, distort square, others as they are."""
    side = F.greatest(w, h)
    if geometry == "letterbox":
        return F.struct(side.alias("w"), side.alias("h"), F.floor((side - w) / 2).cast("int").alias("dx"), F.floor((side - h) / 2).cast("int").alias("dy"))
    own = (side, side) if geometry == "distort" else (w, h)
    return F.struct(own[0].alias("w"), own[1].alias("h"), F.lit(0).alias("dx"), F.lit(0).alias("dy"))
